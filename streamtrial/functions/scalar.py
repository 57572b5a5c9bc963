"""Scalar functions of the learners as SQL text, which means the same in Spark and in ANSI SQL."""

from __future__ import annotations

FLOOR = "ln(1e-300)"


def gaussian_log_density(x: str, n: str, s: str, q: str) -> str:
    """Log density of x under count, sum and sum of squares (sample variance), at least ln 1e-300.

    Below two values it is the floor; without variance it is 0 at the mean and the floor elsewhere.
    """
    mean, var = f"({s} / {n})", f"(({q} - {s} * {s} / {n}) / ({n} - 1))"
    return f"""CASE WHEN {n} < 2 THEN {FLOOR} WHEN {var} <= 1e-12 * {q} / {n} THEN (CASE WHEN abs({x} - {mean}) <= 1e-9 THEN 0.0 ELSE {FLOOR} END)
 ELSE greatest({FLOOR}, -0.5 * ({x} - {mean}) * ({x} - {mean}) / {var} - 0.5 * ln(2 * pi() * {var})) END"""


def hoeffding_bound(spread: str, delta: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN sqrt({spread} * {spread} * ln(1 / {delta}) / (2 * {n})) ELSE {spread} END"


def entropy(counts: list[str]) -> str:
    total = "(" + " + ".join(counts) + ")"
    return " + ".join(f"CASE WHEN {c} > 0 THEN -({c} / {total}) * log2({c} / {total}) ELSE 0 END" for c in counts)


def gini(counts: list[str]) -> str:
    total = "(" + " + ".join(counts) + ")"
    return f"CASE WHEN {total} > 0 THEN 1 - " + " - ".join(f"({c} / {total}) * ({c} / {total})" for c in counts) + " ELSE 0 END"


def sigmoid(z: str) -> str:
    return f"1 / (1 + exp(-greatest(-500.0, least(500.0, {z}))))"


def softmax(scores: list[str]) -> list[str]:
    top = "greatest(" + ", ".join(scores) + ")"
    total = " + ".join(f"exp({s} - {top})" for s in scores)
    return [f"exp({s} - {top}) / ({total})" for s in scores]


def normal_cdf(z: str) -> str:
    """Abramowitz and Stegun 26.2.17, absolute error below 7.5e-8."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END"


def clipped(x: str, most: str = "1e150") -> str:
    """Predictions kept finite; what is not a number becomes 0."""
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 0.0 ELSE greatest(-{most}, least({most}, {x})) END"


def argmax(scores: list[str], labels: list, otherwise: str) -> str:
    """The first label whose score is the greatest; nulls take no part."""
    if len(scores) == 1:
        return f"CASE WHEN {scores[0]} IS NULL THEN {otherwise} ELSE {labels[0]} END"
    top = "greatest(" + ", ".join(f"coalesce({s}, -1e308)" for s in scores) + ")"
    none = " AND ".join(f"{s} IS NULL" for s in scores)
    return f"CASE WHEN {none} THEN {otherwise} " + " ".join(f"WHEN {s} >= {top} THEN {v}" for s, v in zip(scores, labels)) + " END"
