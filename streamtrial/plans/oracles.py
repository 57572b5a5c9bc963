"""DuckDB SQL for the registered queries, from the stream definitions and the same formulas."""

from __future__ import annotations

from streamtrial.functions import scalar
from streamtrial.operators import naive_bayes as nb
from streamtrial.plans.streams import STREAMS, stream_sql

BEFORE = "(PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
UPTO = "(PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def naive_bayes_cte(name: str) -> str:
    """CTEs up to ``z``: stream_id, seq, y, z<c> of naive Bayes before each row."""
    s = STREAMS[name]
    means = ", ".join(f"avg(f{f}) AS m{f}" for f in range(s.width))
    sums = nb.measures(s.classes, s.width, [f"m{f}" for f in range(s.width)])
    ran = ", ".join(f"coalesce(sum({v}) OVER {BEFORE}, 0) AS {k}" for k, v in sums.items())
    scores = nb.scores(s.classes, s.width, [f"m{f}" for f in range(s.width)])
    return f"""WITH i AS MATERIALIZED ({stream_sql(name)}), m AS (SELECT {means} FROM i),
r AS MATERIALIZED (SELECT stream_id, seq, y, {', '.join(f'f{f}, m{f}' for f in range(s.width))}, {ran} FROM i CROSS JOIN m),
z AS MATERIALIZED (SELECT stream_id, seq, y, {', '.join(f'{e} AS z{c}' for c, e in zip(s.classes, scores))} FROM r)"""


def naive_bayes(name: str) -> str:
    s = STREAMS[name]
    pred = scalar.argmax([f"z{c}" for c in s.classes], list(s.classes), "-1")
    return f"{naive_bayes_cte(name)} SELECT stream_id, seq, y, CAST({pred} AS INTEGER) AS pred FROM z"


def knn(name: str, k: int, window: int, regression: bool) -> str:
    s = STREAMS[name]
    d = " + ".join(f"(a.f{f} - b.f{f}) * (a.f{f} - b.f{f})" for f in range(s.width))
    near = f"""WITH i AS MATERIALIZED ({stream_sql(name)}),
p AS (SELECT a.stream_id, a.seq, b.y AS v, b.seq AS bs, sqrt({d}) AS d FROM i a JOIN i b ON a.stream_id = b.stream_id AND b.seq < a.seq AND b.seq >= a.seq - {window}),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stream_id, seq ORDER BY d, v, bs) <= {k})"""
    if regression:
        w = "CASE WHEN d <= 1e-10 THEN 1e10 ELSE 1 / d END"
        return f"{near} SELECT i.stream_id, i.seq, i.y, round(coalesce(q.pred, 0), 6) AS pred FROM i LEFT JOIN (SELECT stream_id, seq, sum({w} * v) / sum({w}) AS pred FROM t GROUP BY 1, 2) q ON i.stream_id = q.stream_id AND i.seq = q.seq"
    return f"""{near}, c AS (SELECT stream_id, seq, v, count(*) AS n FROM t GROUP BY 1, 2, 3),
q AS (SELECT stream_id, seq, v FROM c QUALIFY row_number() OVER (PARTITION BY stream_id, seq ORDER BY n DESC, v) = 1)
SELECT i.stream_id, i.seq, i.y, CAST(coalesce(q.v, -1) AS INTEGER) AS pred FROM i LEFT JOIN q ON i.stream_id = q.stream_id AND i.seq = q.seq"""


def _mixed_recursion(name: str, start: dict[str, str], middle: list[str], step: dict[str, str], pred: str, shown: str, shards: int, shard_rows: int) -> str:
    """The same over the shards of one stream side by side; where a round ends all go on from their mean weights."""
    s = STREAMS[name]
    seen = {k for k in start if k.startswith("s")}

    def mean(c: str) -> str:
        own = f"s{c[1:].partition('_')[0]}"
        over = f"max({c}) OVER ()" if c in seen else f"sum({c} * {own}) OVER () / greatest(sum({own}) OVER (), 1)" if own in seen else f"avg({c}) OVER ()"
        return f"CASE WHEN t > 0 AND t % {shard_rows} = 0 THEN {over} ELSE {c} END AS {c}"

    inner = f"SELECT {', '.join('r.' + c for c in start)}, i.shard AS sh, i.t AS tt, i.seq AS sq, i.y AS yy, {', '.join(f'i.f{f}' for f in range(s.width))} FROM (SELECT shard, t, {', '.join(map(mean, start))} FROM r) r JOIN i ON i.shard = r.shard AND i.t = r.t + 1"
    for layer in middle:
        inner = f"SELECT *, {layer} FROM ({inner})"
    kind = "INTEGER" if s.task == "classification" else "DOUBLE"
    return f"""WITH RECURSIVE i AS MATERIALIZED (SELECT *, ((seq - 1) // {shard_rows}) % {shards} AS shard, ((seq - 1) // {shards * shard_rows}) * {shard_rows} + (seq - 1) % {shard_rows} + 1 AS t FROM ({stream_sql(name)})),
r AS (SELECT DISTINCT shard, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS seq, CAST(NULL AS {kind}) AS y, CAST(NULL AS {kind}) AS pred, {', '.join(f'{v} AS {c}' for c, v in start.items())} FROM i
UNION ALL SELECT sh, tt, sq, yy, CAST({pred} AS {kind}), {', '.join(step[c] for c in start)} FROM ({inner}))
SELECT '{name}' AS stream_id, seq, y, {shown} AS pred FROM r WHERE seq > 0"""


def _recursion(name: str, start: dict[str, str], middle: list[str], step: dict[str, str], pred: str, shown: str, mix: tuple[int, int] | None = None) -> str:
    """A sequential recurrence over each stream: state columns, layers of intermediate columns, next state."""
    if mix:
        return _mixed_recursion(name, start, middle, step, pred, shown, *mix)
    s = STREAMS[name]
    state = list(start)
    inner = f"SELECT {', '.join('r.' + c for c in state)}, i.stream_id AS sid, i.seq AS sq, i.y AS yy, {', '.join(f'i.f{f}' for f in range(s.width))} FROM r JOIN i ON i.stream_id = r.stream_id AND i.seq = r.seq + 1"
    for layer in middle:
        inner = f"SELECT *, {layer} FROM ({inner})"
    kind = "INTEGER" if s.task == "classification" else "DOUBLE"
    return f"""WITH RECURSIVE i AS MATERIALIZED ({stream_sql(name)}),
r AS (SELECT DISTINCT stream_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS {kind}) AS y, CAST(NULL AS {kind}) AS pred, {', '.join(f'{v} AS {c}' for c, v in start.items())} FROM i
UNION ALL SELECT sid, sq, yy, CAST({pred} AS {kind}), {', '.join(step[c] for c in state)} FROM ({inner}))
SELECT stream_id, seq, y, {shown} AS pred FROM r WHERE seq > 0"""


def linear_classifier(name: str, algo: str, lr: float = 0.01, c: float = 1.0, mix: tuple[int, int] | None = None) -> str:
    """perceptron, logistic, softmax and passive_aggressive; class k takes part once s<k> is set."""
    s = STREAMS[name]
    ks, fs = s.classes, range(s.width)
    start = {f"w{k}_{f}": "CAST(0 AS DOUBLE)" for k in ks for f in fs} | {f"b{k}": "CAST(0 AS DOUBLE)" for k in ks} | {f"s{k}": "0" for k in ks}
    dot = {k: " + ".join([*(f"w{k}_{f} * f{f}" for f in fs), f"b{k}"]) for k in ks}
    had = {k: f"CASE WHEN s{k} = 1 THEN {dot[k]} END AS h{k}" for k in ks}
    has = {k: f"CASE WHEN s{k} = 1 OR yy = {k} THEN {dot[k]} END AS z{k}" for k in ks}
    middle = [", ".join([*had.values(), *has.values()])]
    pred = scalar.argmax([f"h{k}" for k in ks], list(ks), "0")
    lr_, z = f"{lr!r}::DOUBLE", {k: f"z{k}" for k in ks}
    if algo in ("perceptron", "passive_aggressive"):
        if algo == "perceptron":
            middle.append(scalar.argmax([z[k] for k in ks], list(ks), "0") + " AS q")
            amount = {k: f"(CASE WHEN q <> yy AND yy = {k} THEN {lr_} WHEN q <> yy AND q = {k} THEN -{lr_} ELSE 0 END)" for k in ks}
        else:
            middle.append(", ".join([f"CASE WHEN yy = {k} THEN NULL ELSE z{k} END AS o{k}" for k in ks] + ["CASE yy " + " ".join(f"WHEN {k} THEN z{k}" for k in ks) + " END AS own"]))
            middle.append(scalar.argmax([f"o{k}" for k in ks], list(ks), "NULL") + " AS q, greatest(" + ", ".join(f"o{k}" for k in ks) + ") AS other, " + " + ".join(f"f{f} * f{f}" for f in fs) + " + 1 AS ns")
            middle.append(f"CASE WHEN q IS NULL THEN 0 ELSE least({c}::DOUBLE, greatest(0.0, 1 - (own - other)) / (2 * ns)) END AS tau")
            amount = {k: f"(CASE WHEN yy = {k} THEN tau WHEN q = {k} THEN -tau ELSE 0 END)" for k in ks}
    else:
        if algo == "logistic":
            share = {k: scalar.sigmoid(z[k]) for k in ks}
        else:
            share = dict(zip(ks, scalar.softmax([f"coalesce(z{k}, -1e308)" for k in ks])))
        middle.append(", ".join(f"CASE WHEN z{k} IS NULL THEN 0 ELSE (CASE WHEN yy = {k} THEN 1 ELSE 0 END) - ({share[k]}) END AS e{k}" for k in ks))
        amount = {k: f"{lr_} * e{k}" for k in ks}
    step = {f"w{k}_{f}": f"w{k}_{f} + {amount[k]} * f{f}" for k in ks for f in fs} | {f"b{k}": f"b{k} + {amount[k]}" for k in ks}
    touched = {k: f"CASE WHEN s{k} = 1 OR yy = {k} THEN 1 ELSE 0 END" for k in ks}
    return _recursion(name, start, middle, step | {f"s{k}": touched[k] for k in ks}, pred, "pred", mix)


def linear_regressor(name: str, algo: str, lr: float = 0.01, c: float = 1.0, epsilon: float = 0.1, mix: tuple[int, int] | None = None) -> str:
    s = STREAMS[name]
    fs = range(s.width)
    start = {f"w{f}": "CAST(0 AS DOUBLE)" for f in fs} | {"b": "CAST(0 AS DOUBLE)"}
    middle = [" + ".join([*(f"w{f} * f{f}" for f in fs), "b"]) + " AS p"]
    clip = lambda e: f"greatest(-10.0, least(10.0, {e}))"
    if algo == "passive_aggressive_reg":
        norm = " + ".join(f"f{f} * f{f}" for f in fs)
        middle.append(f"least({c}::DOUBLE, greatest(0.0, abs(yy - p) - {epsilon}) / (1 + {norm})) * (CASE WHEN yy - p > 0 THEN 1 ELSE -1 END) AS t")
        step = {f"w{f}": f"w{f} + t * f{f}" for f in fs} | {"b": "b + t"}
    else:
        middle.append(clip("yy - p") + " AS e")
        if algo == "linear":
            step = {f"w{f}": f"w{f} + {lr} * {clip(f'e * f{f}')}" for f in fs} | {"b": f"b + {lr} * e"}
        else:
            start |= {f"v{f}": "CAST(1 AS DOUBLE)" for f in fs} | {"vb": "CAST(0 AS DOUBLE)"}
            step = {f"w{f}": f"w{f} + {clip(f'f{f} * e / (v{f} + f{f} * f{f})')}" for f in fs} | {f"v{f}": f"v{f} + f{f} * f{f}" for f in fs} | {"b": "b + e / (vb + 1)", "vb": "vb + 1"}
    return _recursion(name, start, middle, step, "p", "round(pred, 6)", mix)


def gradient_leaf(name: str, lr: float = 0.1, penalty: float = 0.1) -> str:
    p = scalar.sigmoid("w")
    middle = [f"{p} AS p", "g + p - (CASE WHEN yy > 0 THEN 1 ELSE 0 END) AS g2, h + greatest(p * (1 - p), 1e-6) AS h2"]
    zero = "CAST(0 AS DOUBLE)"
    return _recursion(name, {"w": zero, "g": zero, "h": zero}, middle, {"w": f"w - {lr} * g2 / (h2 + {penalty})", "g": "g2", "h": "h2"}, "CASE WHEN w >= 0 THEN 1 ELSE 0 END", "pred")


def eddm(name: str, ratio: float = 0.9, least: int = 30) -> str:
    """stream_id, seq of every drift that early drift detection tells of the errors y: all epochs, one after the other."""
    middle = [
        "n0 + 1 AS r1",
        "CASE WHEN yy = 1 THEN r1 - last END AS gap",
        "CASE WHEN gap IS NULL THEN k ELSE k + 1 END AS k1",
        "CASE WHEN gap IS NULL THEN mean ELSE mean + (gap - mean) / k1 END AS mean1",
        "CASE WHEN gap IS NULL THEN m2 ELSE m2 + (gap - mean) * (gap - mean1) END AS m21",
        f"CASE WHEN gap IS NOT NULL AND k1 >= {least} THEN mean1 + 2 * sqrt(m21 / k1) END AS level",
        "CASE WHEN level IS NULL THEN top ELSE greatest(top, level) END AS top1",
        f"coalesce(level < {ratio} * top1, FALSE) AS hit",
    ]
    whole, real = "CAST(0 AS BIGINT)", "CAST(0 AS DOUBLE)"
    start = {"n0": whole, "last": whole, "k": whole, "mean": real, "m2": real, "top": real}
    after = {"n0": "r1", "last": "CASE WHEN gap IS NULL THEN last ELSE r1 END", "k": "k1", "mean": "mean1", "m2": "m21", "top": "top1"}
    return f"SELECT stream_id, seq FROM ({_recursion(name, start, middle, {c: f'CASE WHEN hit THEN 0 ELSE {v} END' for c, v in after.items()}, 'CASE WHEN hit THEN 1 ELSE 0 END', 'pred')}) WHERE pred = 1"


def classification_metrics(preds: str, by: str) -> str:
    """Counts and macro metrics over labels seen as truth or prediction; ``by``: grouping columns."""
    return f"""WITH p AS MATERIALIZED ({preds}), k AS (SELECT * FROM p WHERE pred IS NOT NULL),
l AS (SELECT {by}, label, sum(t) AS t, sum(g) AS g, sum(tp) AS tp FROM (
  SELECT {by}, y AS label, 1 AS t, 0 AS g, CASE WHEN y = pred THEN 1 ELSE 0 END AS tp FROM k UNION ALL SELECT {by}, pred, 0, 1, 0 FROM k) GROUP BY {by}, label),
q AS (SELECT *, CASE WHEN g > 0 THEN tp / g ELSE 0 END AS a, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS b FROM l),
m AS (SELECT {by}, sum(tp) / sum(t) AS accuracy, avg(a) AS precision, avg(b) AS recall, avg(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END) AS f1 FROM q GROUP BY {by})
SELECT {by}, n.n_samples, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM (SELECT {by}, count(*) AS n_samples FROM p GROUP BY {by}) n LEFT JOIN m USING ({by})"""


def regression_metrics(preds: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n_samples, round(avg(abs(y - pred)), 6) AS mae, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
round(CASE WHEN var_pop(y) * count(y) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)) ELSE 0 END, 6) AS r2 FROM ({preds}) GROUP BY {by}"""
