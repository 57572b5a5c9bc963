"""The registered queries over the reference's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtrial.functions import scalar
from streamtrial.operators import drift, ensemble, metrics, moments, neighbours, parameter_mixing, scaling, tree_growth
from streamtrial.operators.fold import prequential, prequential_each, register, sweep
from streamtrial.operators.naive_bayes import fit, naive_bayes
from streamtrial.operators.numbering import numbered
from streamtrial.operators.scan import scan
from streamtrial.plans import oracles, search, suite
from streamtrial.plans.storage import shared_dir, stored
from streamtrial.plans.streams import STREAMS, instances, stream_sql
from streamtrial.sources import results, tables
from streamtrial.streaming.live import live_predictions, run_available
from streamtrial.streaming.typed import typed_predictions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _flat(df: DataFrame, width: int) -> DataFrame:
    return df.select("stream_id", "seq", "y", *[F.col("x")[f].alias(f"f{f}") for f in range(width)])


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- sources ---------------------------------------------------------------------------------------------

_META = " UNION ALL ".join(f"SELECT '{s.name}' AS name, '{s.task}' AS task, count(*) AS n_samples, {s.width} AS n_features, {'count(DISTINCT y)' if s.task == 'classification' else 'CAST(0 AS BIGINT)'} AS n_classes FROM ({stream_sql(s.name)})" for s in STREAMS.values())


@query("a2_dataset_meta", _META)
def a2(spark, sf):
    """The catalog with sizes: streams of one table and order are counted in one pass, and numbered only if a target asks for it."""
    groups: dict[tuple, list] = {}
    for s in STREAMS.values():
        placed = bool(re.search(r"\b(seq|n)\b", s.target)) and s.task == "classification"
        groups.setdefault((s.table, *((s.order, s.key) if placed else ())), []).append(s)
    out = None
    for (name, *order), streams in groups.items():
        rows = spark.read.parquet(f"{sf}/{name}.parquet")
        if order:
            lead, key = order
            rows = numbered(rows.withColumn("_key", F.expr(key)), list(lead), "_key") if key else numbered(rows, list(lead))
        classes = [F.size(F.collect_set(F.expr(s.target).cast("int"))).cast("long") if s.task == "classification" else F.lit(0).cast("long") for s in streams]  # a handful of labels
        counts = rows.agg(F.count("*").alias("n_samples"), F.array(*classes).alias("classes"))
        told = F.explode(F.array(*[F.struct(F.lit(s.name).alias("name"), F.lit(s.task).alias("task"), F.lit(s.width).alias("n_features"), F.col("classes")[i].alias("n_classes")) for i, s in enumerate(streams)]))
        one = counts.select("n_samples", told.alias("t")).select("t.name", "t.task", "n_samples", "t.n_features", "t.n_classes")
        out = one if out is None else out.union(one)
    return out


def _stream_query(name: str):
    s = STREAMS[name]
    return lambda spark, sf: _flat(instances(spark, sf, name), s.width)


for _name in ("li_flag", "li_abrupt", "li_gradual", "li_revenue", "ev_users", "ev_error"):
    QUERIES[f"a3_stream_{_name}"] = _stream_query(_name)
    ORACLES[f"a3_stream_{_name}"] = f"SELECT stream_id, seq, y, {', '.join(f'f{f}' for f in range(STREAMS[_name].width))} FROM ({stream_sql(_name)})"


@query("a5_csv_loader", "SELECT e.event_id, e.value AS f0, CAST(e.user_id AS DOUBLE) AS f1, 0.0::DOUBLE AS f2, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS y FROM events e")
def a5(spark, sf):
    """The events written as CSV and loaded: label coded in sorted order, a text feature counts as 0."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.csv"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "user_id", F.concat(F.lit("k"), "event_type").alias("kind"), "event_type")
    events.write.csv(path, header=True)
    rows = tables.csv_classification(spark, path, "event_type", "event_id", "event_id long, value double, user_id long, kind string, event_type string")
    return rows.select("event_id", *[F.col("x")[i].alias(f"f{i}") for i in range(3)], "y")


@query("a6_unit_range", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS l_quantity, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS l_extendedprice FROM lineitem")
def a6(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return _rounded(tables.unit_range(line, ["l_quantity", "l_extendedprice"]), "l_quantity", "l_extendedprice")


# --- projections and scalers -----------------------------------------------------------------------------

@query("b1_drop_nan", "SELECT event_id, len(list_filter([CASE WHEN event_type = 'error' THEN NULL ELSE value END, CAST(user_id AS DOUBLE)], lambda e: e IS NOT NULL)) AS features, list_sum(list_filter([CASE WHEN event_type = 'error' THEN NULL ELSE value END, CAST(user_id AS DOUBLE)], lambda e: e IS NOT NULL)) AS total FROM events")
def b1(spark, sf):
    """Values that are not numbers are dropped from a map of features."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    x = F.create_map(F.lit("value"), value, F.lit("user"), F.col("user_id").cast("double"))
    kept = F.map_filter(x, lambda _, v: ~F.isnan(v))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.size(kept).cast("long").alias("features"), F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v).alias("total"))


def _window_sql(expressions: list[str], name: str, window: str) -> str:
    s = STREAMS[name]
    return f"SELECT stream_id, seq, y, {', '.join(f'round({e}, 6) AS g{i}' for i, e in enumerate(expressions))} FROM (SELECT *, count(*) OVER {window} AS wn FROM ({stream_sql(name)}))" if s else ""


def _unit(f: str, window: str) -> str:
    lo, hi = f"min({f}) OVER {window}", f"max({f}) OVER {window}"
    return f"coalesce(CASE WHEN {hi} > {lo} THEN ({f} - {lo}) / ({hi} - {lo}) ELSE 0 END, 0)"


def _standard(f: str, window: str) -> str:
    mean, sq = f"avg({f}) OVER {window}", f"avg({f} * {f}) OVER {window}"
    return f"coalesce(CASE WHEN {sq} - {mean} * {mean} > 1e-12 * {sq} THEN ({f} - {mean}) / sqrt({sq} - {mean} * {mean}) ELSE 0 END, 0)"


def _maxabs(f: str, window: str) -> str:
    top = f"max(abs({f})) OVER {window}"
    return f"coalesce(CASE WHEN {top} > 0 THEN {f} / {top} ELSE 0 END, 0)"


def _scaled(name: str, kind: str, inclusive: bool):
    s = STREAMS[name]
    return lambda spark, sf: _rounded(scaling.scaled(stored(instances(spark, sf, name)), s.width, kind, inclusive), *[f"g{i}" for i in range(s.width)])


for _id, _kind, _sql, _incl in (("b2_online_minmax", "online", _unit, True), ("b3_minmax_learn", "minmax", _unit, True), ("b4_standard_learn", "standard", _standard, True), ("b5_maxabs_learn", "maxabs", _maxabs, True), ("b6_minmax_predict", "minmax", _unit, False), ("b6_standard_predict", "standard", _standard, False)):
    _over = oracles.UPTO if _incl else oracles.BEFORE
    QUERIES[_id] = _scaled("li_flag", _kind, _incl)
    ORACLES[_id] = _window_sql([_sql(f"f{f}", _over) for f in range(4)], "li_flag", _over)


@query("b7_variance_threshold", "SELECT stream_id, seq, " + ", ".join(f"(n0 < 2 OR q{f} * n0 - s{f} * s{f} > 0.05 * n0 * n0) AS k{f}" for f in range(3)) + " FROM (SELECT stream_id, seq, count(*) OVER w AS n0, " + ", ".join(f"coalesce(sum(f{f}) OVER w, 0) AS s{f}, coalesce(sum(f{f} * f{f}) OVER w, 0) AS q{f}" for f in range(3)) + f" FROM ({stream_sql('li_rule')}) WINDOW w AS {oracles.BEFORE})")
def b7(spark, sf):
    return scaling.variance_kept(stored(instances(spark, sf, "li_rule")), 3, 0.05, 2)


def _corr(f: int) -> str:
    v = f"(n0 * q{f} - s{f} * s{f}) * (n0 * qy - sy * sy)"
    return f"round(CASE WHEN {v} > 1e-9 THEN abs(n0 * c{f} - s{f} * sy) / sqrt({v}) ELSE 0 END, 6)"


@query("b8_k_best", "SELECT stream_id, seq, list_sort(list_transform(list_slice(list_sort([" + ", ".join(f"{{'s': -{_corr(f)}, 'f': {f}}}" for f in range(3)) + "]), 1, 2), lambda e: e.f)) AS best FROM (SELECT stream_id, seq, count(*) OVER w AS n0, coalesce(sum(y) OVER w, 0) AS sy, coalesce(sum(y * y) OVER w, 0) AS qy, " + ", ".join(f"coalesce(sum(f{f}) OVER w, 0) AS s{f}, coalesce(sum(f{f} * f{f}) OVER w, 0) AS q{f}, coalesce(sum(f{f} * y) OVER w, 0) AS c{f}" for f in range(3)) + f" FROM ({stream_sql('li_rule')}) WINDOW w AS {oracles.BEFORE})")
def b8(spark, sf):
    return scaling.k_best(stored(instances(spark, sf, "li_rule")), 3, 2)


@query("b9_target_norm", f"SELECT stream_id, seq, round(y, 6) AS y, round(m, 6) AS mean, round(CASE WHEN n0 < 2 THEN 1 ELSE d END, 6) AS std, round(CASE WHEN n0 < 2 THEN y - m WHEN d > 0 THEN (y - m) / d ELSE 0 END, 5) AS z FROM (SELECT stream_id, seq, y, count(*) OVER w AS n0, avg(y) OVER w AS m, sqrt(greatest(avg(y * y) OVER w - (avg(y) OVER w) * (avg(y) OVER w), 0)) AS d FROM ({stream_sql('li_revenue')}) WINDOW w AS {oracles.UPTO})")
def b9(spark, sf):
    out = scaling.target_normalised(stored(instances(spark, sf, "li_revenue")))
    return _rounded(_rounded(out, "y", "mean", "std"), "z", places=5)


_WILD = "CASE WHEN l_linenumber = 1 THEN CAST('NaN' AS DOUBLE) WHEN l_linenumber = 2 THEN l_extendedprice * 1e200 ELSE -l_extendedprice END"
_B11 = f"SELECT l_orderkey, l_linenumber, {scalar.clipped(f'({_WILD})')} AS clipped, (isnan({_WILD}) OR abs({_WILD}) > 1e6) AS diverged FROM lineitem"


@query("b11_safe_clip", _B11)
def b11(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", F.expr(scalar.clipped(f"({_WILD})")).alias("clipped"), F.expr(f"isnan({_WILD}) OR abs({_WILD}) > 1e6").alias("diverged"))


_USER = "SELECT user_id, CAST(count(*) AS DOUBLE) AS n, sum(value / 100) AS s, sum(value / 100 * value / 100) AS q, " + ", ".join(f"CAST(count(CASE WHEN event_type = '{t}' THEN 1 END) AS DOUBLE) AS c{i}" for i, t in enumerate(("click", "error", "purchase", "signup", "view"))) + " FROM events GROUP BY user_id"
_COUNTS = [f"c{i}" for i in range(5)]
_SCALARS = {
    "b13_gaussian_density": f"exp({scalar.gaussian_log_density('0.5', 'n', 's', 'q')})",
    "b14_normal_cdf": scalar.normal_cdf("(s / n - 0.5)"),
    "b15_entropy": scalar.entropy(_COUNTS),
    "b15_gini": scalar.gini(_COUNTS),
    "b16_hoeffding_bound": scalar.hoeffding_bound("2.32", "1e-7", "n"),
    "b17_sigmoid": scalar.sigmoid("(c0 - c1) * 100"),
    "b17_softmax": scalar.softmax(_COUNTS)[2],
}
_SHARES = "(SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2)"
#: The same values from the events by other formulas; the normal distribution has none that all engines share.
_SCALAR_SQL = {
    "b13_gaussian_density": "CASE WHEN count(*) < 2 THEN 0 WHEN var_samp(value) = 0 THEN CASE WHEN avg(value) = 50 THEN 1 ELSE 0 END ELSE exp(-pow(50 - avg(value), 2) / (2 * var_samp(value))) / sqrt(2 * pi() * var_samp(value) / 10000) END",
    "b16_hoeffding_bound": "2.32 * sqrt(7 * ln(10) / (2 * count(*)))",
    "b17_sigmoid": "(1 + tanh(greatest(-500, least(500, 100 * (count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'error')))) / 2)) / 2",
    "b17_softmax": "1 / (" + " + ".join(f"exp(count(*) FILTER (event_type = '{t}') - count(*) FILTER (event_type = 'purchase'))" for t in ("click", "error", "purchase", "signup", "view")) + ")",
}
for _id, _e in _SCALARS.items():
    ORACLES[_id] = f"SELECT user_id, round({_SCALAR_SQL[_id]}, 6) AS v FROM events GROUP BY user_id" if _id in _SCALAR_SQL else f"SELECT user_id, round({_e}, 6) AS v FROM ({_USER})"
    if _id.startswith("b15"):
        ORACLES[_id] = f"SELECT user_id, round({'-sum(p * log2(p))' if _id == 'b15_entropy' else '1 - sum(p * p)'}, 6) AS v FROM {_SHARES} GROUP BY user_id"

    def _scalar(spark, sf, e=_e):
        spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("events")
        return spark.sql(f"SELECT user_id, round({e.replace('1e-300', '1e-300D')}, 6) AS v FROM ({_USER})")

    QUERIES[_id] = _scalar


def _minkowski_sql(p: int) -> str:
    inner = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda e: pow(abs(e[1]::DOUBLE - e[2]::DOUBLE), %d)))" % p
    return f"SELECT a.vec_id, round(pow({inner}, 1.0 / {p}), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


for _p in (1, 2, 3):
    ORACLES[f"b18_minkowski_p{_p}"] = _minkowski_sql(_p)

    def _mink(spark, sf, p=_p):
        e = spark.read.parquet(f"{sf}/embeddings.parquet")
        other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        parts = F.zip_with("embedding", "other", lambda a, b: F.pow(F.abs(a.cast("double") - b.cast("double")), F.lit(p)))
        return e.join(other, "vec_id").select("vec_id", F.round(F.pow(F.aggregate(parts, F.lit(0.0), lambda a, v: a + v), F.lit(1.0 / p)), 5).alias("d"))

    QUERIES[f"b18_minkowski_p{_p}"] = _mink


@query("b20_dot_score", "WITH m AS (SELECT avg(value) AS a, avg(user_id) AS b FROM events) SELECT event_id, round(value * a + user_id * b, 4) AS score FROM events CROSS JOIN m")
def b20(spark, sf):
    """Scores by weights learned from the table (its means), broadcast as one row."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    w = e.agg(F.array(F.avg("value"), F.avg("user_id")).alias("w"))
    x = F.array(F.col("value"), F.col("user_id").cast("double"))
    dot = F.aggregate(F.zip_with(x, "w", lambda a, b: F.coalesce(a, F.lit(0.0)) * b), F.lit(0.0), lambda a, v: a + v)
    return e.join(F.broadcast(w)).select("event_id", F.round(dot, 4).alias("score"))


# --- learners --------------------------------------------------------------------------------------------

def _nb(spark, sf, name):
    s = STREAMS[name]
    return stored(naive_bayes(stored(instances(spark, sf, name)), s.classes, s.width))  # metrics read it more than once


for _name in ("li_flag", "li_rule", "li_abrupt", "ev_users"):
    QUERIES[f"d1_naive_bayes_{_name}"] = lambda spark, sf, n=_name: _nb(spark, sf, n)
    ORACLES[f"d1_naive_bayes_{_name}"] = oracles.naive_bayes(_name)


@query("d1_naive_bayes_fit", "SELECT y, count(*) AS n, " + ", ".join(f"round(avg(f{f}), 4) AS mean{f}, round(var_samp(f{f}), 4) AS var{f}" for f in range(4)) + f" FROM ({stream_sql('li_flag')}) GROUP BY y")
def d1_fit(spark, sf):
    return _rounded(fit(instances(spark, sf, "li_flag"), 4), *[f"{k}{f}" for f in range(4) for k in ("mean", "var")], places=4)


@query("d10_probabilities", oracles.naive_bayes_cte("li_rule") + " SELECT stream_id, seq, " + ", ".join(f"round({p}, 5) AS p{c}" for c, p in enumerate(scalar.softmax(["coalesce(z0, -1e308)", "coalesce(z1, -1e308)"]))) + " FROM z")
def d10(spark, sf):
    out = naive_bayes(stored(instances(spark, sf, "li_rule")), (0, 1), 3, proba=True)
    return _rounded(out.select("stream_id", "seq", "p0", "p1"), "p0", "p1", places=5)


for _id, _algo in (("d2_perceptron", "perceptron"), ("d3_logistic", "logistic"), ("d4_passive_aggressive", "passive_aggressive"), ("d5_softmax", "softmax")):
    QUERIES[_id] = lambda spark, sf, a=_algo: prequential(instances(spark, sf, "ev_users"), a)
    ORACLES[_id] = oracles.linear_classifier("ev_users", _algo)

for _id, _algo in (("d11_linear", "linear"), ("d12_bayesian_linear", "bayesian_linear"), ("d13_passive_aggressive_reg", "passive_aggressive_reg")):
    QUERIES[_id] = lambda spark, sf, a=_algo: _rounded(prequential(instances(spark, sf, "ev_value"), a), "pred")
    ORACLES[_id] = oracles.linear_regressor("ev_value", _algo)

for _id, _algo, _name, _params in (("d7_hoeffding_tree", "hoeffding_tree", "ev_users", {"grace": 20, "delta": 0.1}), ("d8_efdt", "efdt", "ev_users", {"grace": 20}), ("d15_hoeffding_regressor", "hoeffding_tree_reg", "ev_value", {"grace": 20, "delta": 0.1})):
    QUERIES[_id] = lambda spark, sf, a=_algo, n=_name, p=_params: _rounded(prequential(instances(spark, sf, n), a, p), "pred")

#: Parameter mixing over streams without a key, (shards, rows of a shard); with one shard a round it is the fold.
_MIXES = {
    "d2_mix_perceptron": ("li_rule", "perceptron", (8, 500)), "d3_mix_logistic": ("li_flag", "logistic", (16, 2000)), "d11_mix_one_shard": ("ev_amount", "linear", (1, 2500)),
    "d4_mix_passive_aggressive": ("li_abrupt", "passive_aggressive", (8, 500)), "d5_mix_softmax": ("li_rule", "softmax", (16, 500)), "d11_mix_linear": ("li_revenue", "linear", (16, 2000)), "d13_mix_passive_aggressive_reg": ("li_revenue", "passive_aggressive_reg", (8, 1000)),
}
for _id, (_name, _algo, _mix) in _MIXES.items():
    QUERIES[_id] = lambda spark, sf, n=_name, a=_algo, m=_mix: _mixed(spark, sf, n, a, m)
    ORACLES[_id] = (oracles.linear_classifier if STREAMS[_name].task == "classification" else oracles.linear_regressor)(_name, _algo, mix=_mix)
QUERIES["d12_mix_bayesian_linear"] = lambda spark, sf: _mixed(spark, sf, "li_revenue", "bayesian_linear", (16, 1000))


def _mixed(spark, sf, name: str, algo: str, mix: tuple[int, int]) -> DataFrame:
    return _rounded(parameter_mixing.mixed(stored(instances(spark, sf, name)), algo, None, *mix), "pred")


for _id, _algo, _name in (("d7_hoeffding_lots", "hoeffding_tree", "li_lots"), ("d8_efdt_lots", "efdt", "li_lots"), ("d15_hoeffding_lots", "hoeffding_tree_reg", "li_lots_revenue")):
    QUERIES[_id] = lambda spark, sf, a=_algo, n=_name: _rounded(prequential(instances(spark, sf, n), a), "pred")


def _grown(spark, sf, name: str, block: int, **params) -> DataFrame:
    s = STREAMS[name]
    return tree_growth.grown(stored(instances(spark, sf, name)), s.classes, s.width, block, **params)[0]


QUERIES["d7_grown_tree"] = lambda spark, sf: _grown(spark, sf, "li_flag", 20_000)
QUERIES["d8_grown_efdt"] = lambda spark, sf: _grown(spark, sf, "li_rule", 20_000, delta=1e-5)


QUERIES["d9_gradient_tree"] = lambda spark, sf: prequential(instances(spark, sf, "ev_users"), "gradient_tree")
ORACLES["d9_gradient_tree"] = oracles.gradient_leaf("ev_users")

QUERIES["d6_knn"] = lambda spark, sf: neighbours.knn_classify(instances(spark, sf, "ev_type"), 5, 200)
ORACLES["d6_knn"] = oracles.knn("ev_type", 5, 200, False)
QUERIES["d14_knn_regress"] = lambda spark, sf: _rounded(neighbours.knn_regress(instances(spark, sf, "ev_value"), 5, 500), "pred")
ORACLES["d14_knn_regress"] = oracles.knn("ev_value", 5, 500, True)
QUERIES["d6_knn_lineitem"] = lambda spark, sf: neighbours.knn_classify(instances(spark, sf, "li_flag"), 5, 1000)


# --- metrics and evaluation ------------------------------------------------------------------------------

@query("c1_welford", f"SELECT stream_id, seq, n0, round(m + 1e-8, 5) AS mean, round(CASE WHEN n0 > 1 THEN v ELSE 0 END, 4) AS var FROM (SELECT stream_id, seq, count(*) OVER w AS n0, avg(f0) OVER w AS m, var_samp(f0) OVER w AS v FROM ({stream_sql('ev_type')}) WINDOW w AS {oracles.UPTO})")
def c1(spark, sf):
    rows = _flat(stored(instances(spark, sf, "ev_type")), 1)
    mean = float(rows.agg(F.avg("f0")).first()[0] or 0.0)
    d = F.col("f0") - mean
    ran = scan(rows, {"n0": ("sum", F.lit(1).cast("long")), "s": ("sum", d), "q": ("sum", d * d)}, inclusive=True)
    var = F.when(F.col("n0") > 1, (F.col("q") - F.col("s") * F.col("s") / F.col("n0")) / (F.col("n0") - 1)).otherwise(0.0)
    return ran.select("stream_id", "seq", "n0", F.round(F.col("s") / F.col("n0") + mean + 1e-8, 5).alias("mean"), F.round(var, 4).alias("var"))


_TIMES = ensemble.poisson_sql(6.0, "'0|0|' || stream_id || '|' || seq")
_WEIGHTED = f"(SELECT *, {_TIMES} AS w FROM ({stream_sql('ev_users')}))"


def _times() -> F.Column:
    """How often online bagging learns a row: seed 0, member 0."""
    return ensemble.poisson(6.0, F.lit(0), F.lit(0), F.col("stream_id"), F.col("seq"))


@query("c1_weighted", f"SELECT stream_id, seq, n0 AS n, round(s / n0 + 1e-8, 5) AS mean, round(CASE WHEN n0 > 1 THEN greatest(q - s * s / n0, 0) / (n0 - 1) ELSE 0 END, 5) AS var FROM (SELECT stream_id, seq, (sum(w) OVER u)::DOUBLE AS n0, sum(w * f0) OVER u AS s, sum(w * f0 * f0) OVER u AS q FROM {_WEIGHTED} WINDOW u AS {oracles.UPTO})")
def c1_weighted(spark, sf):
    """Running mean and variance where each row counts as often as a Poisson draw says."""
    rows = _flat(stored(instances(spark, sf, "ev_users")), 1).withColumn("w", _times())
    return _rounded(_rounded(moments.running(rows, "f0", "w", shift=0.5), "var", places=5).withColumn("mean", F.col("mean") + 1e-8), "mean", places=5)


@query("c1_merged", f"SELECT sum(w)::DOUBLE AS n, round(sum(w * f0) / sum(w), 6) AS mean, round((sum(w * f0 * f0) - sum(w * f0) * sum(w * f0) / sum(w)) / (sum(w) - 1), 6) AS var FROM {_WEIGHTED}")
def c1_merged(spark, sf):
    """Moments per user and half of the users' rows, merged into one per user and then into one of all."""
    rows = _flat(instances(spark, sf, "ev_users"), 1).withColumn("w", _times())
    half = lambda odd: F.col("seq") % 2 == odd
    per = rows.groupBy("stream_id").agg(*[moments.state(F.when(half(i), F.col("f0")), F.col("w"), 0.5).alias(f"s{i}") for i in (0, 1)])
    one = per.select(moments.merged(F.col("s0"), F.col("s1")).alias("s")).agg(moments.total(F.col("s"), 0.5).alias("s"))
    return one.select(F.round("s.n", 4).alias("n"), F.round("s.mean", 6).alias("mean"), F.round(moments.variance(F.col("s")), 6).alias("var"))


@query("b6_weighted_standard", f"SELECT stream_id, seq, y, round(CASE WHEN n0 > 0 AND q / n0 - (s / n0) * (s / n0) > 1e-12 * q / n0 THEN (f0 - s / n0) / sqrt(q / n0 - (s / n0) * (s / n0)) ELSE 0 END, 4) AS g0 FROM (SELECT *, sum(w) OVER u AS n0, sum(w * f0) OVER u AS s, sum(w * f0 * f0) OVER u AS q FROM {_WEIGHTED} WINDOW u AS {oracles.UPTO})")
def b6_weighted(spark, sf):
    """What a bagged member learns: rows scaled by statistics to which each row went as often as it was drawn."""
    return _rounded(scaling.scaled(stored(instances(spark, sf, "ev_users")), 1, "standard", weight=_times()), "g0", places=4)


@query("c2_class_priors", f"SELECT stream_id, y, count(*) AS c FROM ({stream_sql('ev_users')}) GROUP BY 1, 2")
def c2(spark, sf):
    return instances(spark, sf, "ev_users").groupBy("stream_id", "y").agg(F.count("*").alias("c"))


_METRICS = ("accuracy", "precision", "recall", "f1")


@query("c4_macro_metrics", oracles.classification_metrics(oracles.naive_bayes("ev_users"), "stream_id"))
def c4(spark, sf):
    return _rounded(metrics.classification(_nb(spark, sf, "ev_users"), "stream_id"), *_METRICS)


@query("c6_regression_metrics", oracles.regression_metrics(oracles.linear_regressor("ev_value", "linear").replace("round(pred, 6)", "pred"), "stream_id"))
def c6(spark, sf):
    return _rounded(metrics.regression(prequential(instances(spark, sf, "ev_value"), "linear"), "stream_id"), "mae", "rmse", "r2")


_WARM = "SELECT stream_id, seq, y, CASE WHEN seq > 20 THEN pred END AS pred FROM (%s)"


@query("c7_null_predictions", oracles.classification_metrics(_WARM % oracles.naive_bayes("ev_users"), "stream_id"))
def c7(spark, sf):
    preds = _nb(spark, sf, "ev_users").withColumn("pred", F.when(F.col("seq") > 20, F.col("pred")))
    return _rounded(metrics.classification(preds, "stream_id"), *_METRICS)


_WINDOWED = "SELECT *, CAST(floor((seq - 1) / 1000) AS BIGINT) AS window_no FROM (%s)"


def windowed_naive_bayes(spark, sf, name="li_flag"):
    """The flagship: accuracy and macro metrics per 1000 rows, the partial last window included."""
    return _rounded(metrics.classification(_nb(spark, sf, name), metrics.window_no()), *_METRICS)


QUERIES["c9_windowed_naive_bayes"] = windowed_naive_bayes
ORACLES["c9_windowed_naive_bayes"] = oracles.classification_metrics(_WINDOWED % oracles.naive_bayes("li_flag"), "window_no")


@query("c10_complete_windows", f"SELECT stream_id, count(*) AS windows, round(avg(a), 6) AS accuracy FROM (SELECT stream_id, floor((seq - 1) / 1000) AS w, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS a FROM ({oracles.naive_bayes('li_rule')}) GROUP BY 1, 2 HAVING count(*) = 1000) GROUP BY 1")
def c10(spark, sf):
    return _rounded(metrics.complete_windows(_nb(spark, sf, "li_rule")), "accuracy")


@query("c14_majority_baseline", f"SELECT stream_id, arg_max(y, c * 100 - y) AS label, round(max(c) / sum(c), 6) AS share FROM (SELECT stream_id, y, count(*) AS c FROM ({stream_sql('ev_users')}) GROUP BY 1, 2) GROUP BY 1")
def c14(spark, sf):
    return _rounded(metrics.majority(instances(spark, sf, "ev_users")), "share")


@query("c15_trend", f"WITH w AS (SELECT stream_id, floor((seq - 1) / 1000) AS w, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS a FROM ({oracles.naive_bayes('li_abrupt')}) GROUP BY 1, 2), n AS (SELECT *, max(w) OVER (PARTITION BY stream_id) + 1 AS n FROM w) SELECT stream_id, round(avg(CASE WHEN 2 * w < n THEN a END), 6) AS first_half, round(avg(CASE WHEN 2 * w >= n THEN a END), 6) AS second_half, round(avg(CASE WHEN w < 5 THEN a END), 6) AS first, round(avg(CASE WHEN w >= n - 5 THEN a END), 6) AS last FROM n GROUP BY 1")
def c15(spark, sf):
    return _rounded(metrics.trend(_nb(spark, sf, "li_abrupt")), "first_half", "second_half", "first", "last")


#: A run per user and learner; "runs" of one dataset are users, so seeds stay out of it.
def _runs(spark, sf) -> DataFrame:
    algos = ("perceptron", "logistic")
    preds = stored(prequential_each(instances(spark, sf, "ev_users"), algos))  # metrics read it more than once
    per = metrics.classification(preds, "member", "stream_id")
    return per.select(F.array(*map(F.lit, algos))[F.col("member")].alias("framework"), F.concat(F.lit("ev"), (F.col("stream_id").cast("long") % 3).cast("string")).alias("dataset"), F.lit("classification").alias("task"), F.col("stream_id").cast("long").alias("run_id"), F.lit(None).cast("long").alias("seed"), "n_samples", "accuracy", F.when(F.col("stream_id").cast("long") % 7 == 0, F.lit("stopped")).alias("error"))


_RUNS_SQL = " UNION ALL ".join(f"SELECT '{a}' AS framework, 'ev' || (CAST(stream_id AS BIGINT) % 3) AS dataset, 'classification' AS task, CAST(stream_id AS BIGINT) AS run_id, count(*) AS n_samples, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS accuracy, CASE WHEN CAST(stream_id AS BIGINT) % 7 = 0 THEN 'stopped' END AS error FROM ({oracles.linear_classifier('ev_users', a)}) GROUP BY stream_id" for a in ("perceptron", "logistic"))


@query("a7_runs_csv", f"SELECT run_id, '' AS seed, framework, dataset, task, n_samples, CASE WHEN error IS NULL THEN printf('%.6f', accuracy) ELSE '' END AS accuracy, coalesce(error, '') AS error FROM ({_RUNS_SQL})")
def a7(spark, sf):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.csv"
    results.to_csv(_runs(spark, sf), ["accuracy"], path)
    back = spark.read.csv(path, header=True, schema="run_id long, seed string, framework string, dataset string, task string, n_samples long, accuracy string, error string")
    return back.fillna("", ["seed", "accuracy", "error"])


@query("a8_runs_json", f"SELECT framework, dataset, task, run_id, n_samples, round(accuracy, 6) AS accuracy FROM ({_RUNS_SQL})")
def a8(spark, sf):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.json"
    results.to_json(_runs(spark, sf), path)
    back = spark.read.schema("run_id long, n_samples long, accuracy double, framework string, dataset string, task string").json(path)
    return _rounded(back.select("framework", "dataset", "task", "run_id", "n_samples", "accuracy"), "accuracy")


@query("a9_merged_runs", f"SELECT framework, count(*) AS runs FROM (SELECT * FROM ({_RUNS_SQL}) UNION ALL SELECT * FROM ({_RUNS_SQL})) GROUP BY 1")
def a9(spark, sf):
    runs = stored(_runs(spark, sf))
    return results.merged(runs, runs).groupBy("framework").agg(F.count("*").alias("runs"))


@query("c11_run_summary", f"SELECT framework, dataset, count(*) AS n_runs, count(CASE WHEN error IS NULL THEN 1 END) AS n_ok, count(error) AS n_failed, round(avg(a), 6) AS accuracy_mean, round(CASE WHEN count(a) > 1 THEN stddev_samp(a) WHEN count(a) = 1 THEN 0 END, 6) AS accuracy_std, round(min(a), 6) AS accuracy_min, round(max(a), 6) AS accuracy_max FROM (SELECT *, CASE WHEN error IS NULL THEN accuracy END AS a FROM ({_RUNS_SQL})) GROUP BY 1, 2")
def c11(spark, sf):
    return metrics.summary(_runs(spark, sf), ["accuracy"])


@query("c12_mean_curves", f"WITH v AS (SELECT CAST(stream_id AS BIGINT) AS run_id, 'ev' || (CAST(stream_id AS BIGINT) % 3) AS dataset, CAST(floor((seq - 1) / 10) AS BIGINT) AS window_no, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS value FROM ({oracles.linear_classifier('ev_users', 'softmax')}) GROUP BY 1, 2, 3), s AS (SELECT dataset, min(m) AS m FROM (SELECT dataset, run_id, max(window_no) AS m FROM v GROUP BY 1, 2) GROUP BY 1) SELECT 'softmax' AS framework, dataset, window_no, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM v JOIN s USING (dataset) WHERE window_no <= m GROUP BY 2, 3")
def c12(spark, sf):
    preds = prequential(instances(spark, sf, "ev_users"), "softmax")
    per = preds.groupBy(F.col("stream_id").cast("long").alias("run_id"), metrics.window_no(10)).agg(F.avg((F.col("y") == F.col("pred")).cast("int")).alias("value"))
    per = stored(per.select(F.lit("softmax").alias("framework"), F.concat(F.lit("ev"), (F.col("run_id") % 3).cast("string")).alias("dataset"), "run_id", "window_no", "value"))
    return _rounded(metrics.mean_curves(per), "mean", "std")


@query("c13_leaderboard", f"SELECT framework, dataset, CAST(run_id AS VARCHAR) AS run_id, round(accuracy, 6) AS score FROM ({_RUNS_SQL}) UNION ALL SELECT framework, dataset, 'mean', round(avg(accuracy), 6) FROM ({_RUNS_SQL}) WHERE error IS NULL GROUP BY 1, 2 HAVING count(*) > 1")
def c13(spark, sf):
    return _rounded(metrics.leaderboard(stored(_runs(spark, sf)), "accuracy"), "score")


_SWEEP = [("a", "logistic", {"lr": 0.01}), ("b", "logistic", {"lr": 0.1}), ("c", "passive_aggressive", {"c": 0.5})]
_SWEEP_SQL = " UNION ALL ".join(f"SELECT '{i}' AS config_id, stream_id, count(*) AS n, CAST(sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS BIGINT) AS good FROM ({oracles.linear_classifier('ev_users', a, p.get('lr', 0.01), p.get('c', 1.0))}) GROUP BY stream_id" for i, a, p in _SWEEP)


@query("e7_config_sweep", _SWEEP_SQL)
def e7(spark, sf):
    preds = sweep(instances(spark, sf, "ev_users"), _SWEEP)
    return preds.groupBy("config_id", "stream_id").agg(F.count("*").alias("n"), F.sum((F.col("y") == F.col("pred")).cast("long")).alias("good"))


@query("e9_failed_configs", f"SELECT 'x' AS config_id, stream_id, CAST(NULL AS BIGINT) AS good, TRUE AS failed FROM ({stream_sql('ev_users')}) GROUP BY stream_id UNION ALL SELECT config_id, stream_id, good, FALSE FROM ({_SWEEP_SQL}) WHERE config_id = 'a'")
def e9(spark, sf):
    """A configuration with an unknown learner fails on its own; the other one runs."""
    preds = sweep(instances(spark, sf, "ev_users"), [_SWEEP[0], ("x", "no such learner", {})])
    return preds.groupBy("config_id", "stream_id").agg(F.sum((F.col("y") == F.col("pred")).cast("long")).alias("good"), F.max(F.col("error").isNotNull()).alias("failed"))


@query("e3_sliding_window", f"SELECT stream_id, seq, count(f0) OVER w AS c, round(coalesce(avg(f0) OVER w, 0) + 1e-8, 5) AS mean FROM ({stream_sql('ev_users')}) WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)")
def e3(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(-25, -1)
    rows = _flat(instances(spark, sf, "ev_users"), 1)
    return rows.select("stream_id", "seq", F.count("f0").over(w).alias("c"), F.round(F.coalesce(F.avg("f0").over(w), F.lit(0.0)) + 1e-8, 5).alias("mean"))


# --- evaluator and suite ---------------------------------------------------------------------------------

@query("a4_row_cap", f"SELECT stream_id, count(*) AS n, round(sum(f0), 6) AS total FROM ({stream_sql('ev_users')}) WHERE seq <= 30 GROUP BY 1")
def a4(spark, sf):
    """The first 30 rows of every stream."""
    rows = suite.prepared(instances(spark, sf, "ev_users"), 3, most=30)
    return _rounded(rows.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("x")[0]).alias("total")), "total")


def _prepared_sql(name: str, target: bool = False) -> str:
    """The stream's rows, features scaled by their ranges so far, and the normalised target if wanted."""
    fs = [f"f{f}" for f in range(STREAMS[name].width)]
    y = f"CASE WHEN n0 < 2 THEN y - m WHEN d > 0 THEN (y - m) / d ELSE 0 END AS y, y AS own, m, CASE WHEN n0 < 2 THEN 1 ELSE d END AS d" if target else "y"
    scaled = ", ".join(f"{_unit(f, oracles.UPTO)} AS g{f[1:]}" for f in fs)
    stats = f"count(*) OVER {oracles.UPTO} AS n0, avg(y) OVER {oracles.UPTO} AS m, sqrt(greatest(avg(y * y) OVER {oracles.UPTO} - (avg(y) OVER {oracles.UPTO}) * (avg(y) OVER {oracles.UPTO}), 0)) AS d"
    return f"SELECT stream_id, seq, n, {', '.join(f'g{f[1:]} AS {f}' for f in fs)}, {y} FROM (SELECT *, {scaled}, {stats} FROM ({stream_sql(name)}))"


def _swapped(sql: str, name: str, own: str) -> str:
    return sql.replace(f"({stream_sql(name)})", f"({own})")


_REG = suite.Suite({"line": ("linear", {})}, "regression", ["ev_value"], normalize=True)
_REG_Z = _swapped(oracles.linear_regressor("ev_value", "linear").replace("round(pred, 6)", "pred"), "ev_value", _prepared_sql("ev_value", True))


@query("e1_evaluator_reg", f"SELECT 'line' AS framework, 'ev_value' AS dataset, p.stream_id, p.seq, round(i.own, 6) AS y, round(p.pred * i.d + i.m, 5) AS pred FROM ({_REG_Z}) p JOIN ({_prepared_sql('ev_value', True)}) i ON p.stream_id = i.stream_id AND p.seq = i.seq")
def e1_reg(spark, sf):
    """A linear model on scaled features and targets; its predictions on the targets' own scale."""
    preds = _REG.predictions(spark, sf).select("framework", "dataset", "stream_id", "seq", "y", "pred")
    return _rounded(_rounded(preds, "y"), "pred", places=5)


_SUITE = suite.Suite({"perceptron": ("perceptron", {}), "softmax": ("softmax", {}), "wrong": ("no such learner", {})}, "classification", ["ev_users"], n_runs=2, seeds=[7, 3], window=20, normalize=True)
_KEPT = {m: _swapped(oracles.linear_classifier("ev_users", m), "ev_users", _prepared_sql("ev_users")) for m in ("perceptron", "softmax")}
_PLACES = "CROSS JOIN (SELECT 0 AS run_id, 7 AS seed UNION ALL SELECT 1, 3)"
_BOTH = " UNION ALL ".join(f"SELECT '{m}' AS framework, {i} AS place, s.* FROM (SELECT * FROM ({oracles.classification_metrics(q, 'one').replace('WITH p AS MATERIALIZED (', 'WITH p AS MATERIALIZED (SELECT *, 1 AS one FROM (').replace('), k AS', ')), k AS', 1)})) s" for i, (m, q) in enumerate(_KEPT.items()))


def _suite_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    preds = _SUITE.predictions(spark, sf)
    return preds, stored(_SUITE.runs(preds))


_RUNS_OF_SUITE = f"SELECT framework, 'ev_users' AS dataset, run_id, seed, n_samples, accuracy, precision, recall, f1, 'finished' AS status, run_id * 3 + place + 1 AS task_index FROM ({_BOTH}) {_PLACES} UNION ALL SELECT 'wrong', 'ev_users', run_id, seed, 0, NULL, NULL, NULL, NULL, 'failed', run_id * 3 + 3 FROM (SELECT 1) {_PLACES}"


@query("j6_suite_runs", f"SELECT framework, dataset, run_id, seed, n_samples, accuracy, precision, recall, f1, status, task_index, 6 AS task_total FROM ({_RUNS_OF_SUITE})")
def j6(spark, sf):
    """Two learners and one that doesn't exist, with two seeds, over the users' streams."""
    runs = _suite_runs(spark, sf)[1]
    return _rounded(runs, *_METRICS).select("framework", "dataset", "run_id", "seed", "n_samples", *_METRICS, "status", "task_index", "task_total")


_FIRST_WINDOWS = " UNION ALL ".join(f"SELECT '{m}' AS framework, run_id, stream_id, CAST(floor((seq - 1) / 20) AS BIGINT) AS window_no, count(*) AS n_samples, round(avg(CASE WHEN y = pred THEN 1 ELSE 0 END), 6) AS accuracy FROM ({q}) {_PLACES} GROUP BY ALL" for m, q in _KEPT.items())


@query("j6_suite_windows", _FIRST_WINDOWS)
def j6_windows(spark, sf):
    return _rounded(_SUITE.windows(_SUITE.predictions(spark, sf), "accuracy"), "accuracy").select("framework", "run_id", "stream_id", "window_no", "n_samples", "accuracy")


@query("j7_run_events", f"SELECT framework, run_id, seed, task_index, 6 AS task_total, event, CASE WHEN event = 'task_finished' THEN status END AS state, TRUE AS timed FROM ({_RUNS_OF_SUITE}) CROSS JOIN (SELECT 'task_started' AS event UNION ALL SELECT 'task_finished')")
def j7(spark, sf):
    told = suite.events(_suite_runs(spark, sf)[1])
    return told.select("framework", "run_id", "seed", "task_index", "task_total", "event", "state", (F.col("at") > 0).alias("timed"))


@query("c16_throughput", f"SELECT framework, run_id, n_samples, n_samples > 0 AS fast FROM ({_RUNS_OF_SUITE})")
def c16(spark, sf):
    """Rows a second of every run; shown is whether there is a rate, as the rate itself is never the same twice."""
    return _suite_runs(spark, sf)[1].select("framework", "run_id", "n_samples", (F.coalesce("rows_per_s", F.lit(0.0)) > 0).alias("fast"))


@query("c13_ranking", f"SELECT dataset, framework, n_runs, score, rank() OVER (PARTITION BY dataset ORDER BY score DESC) AS rank FROM (SELECT dataset, framework, count(*) AS n_runs, round(avg(accuracy), 6) AS score FROM ({_RUNS_OF_SUITE}) WHERE status = 'finished' GROUP BY 1, 2)")
def c13_rank(spark, sf):
    return suite.ranking(_suite_runs(spark, sf)[1], "classification")


@query("a8_result_tables", f"SELECT framework, count(*) AS n_runs, count(CASE WHEN status = 'finished' THEN 1 END) AS n_ok, count(CASE WHEN status = 'failed' THEN 1 END) AS n_errors, max(n_samples) AS n_samples, round(avg(accuracy), 6) AS accuracy_mean, CAST(3 AS BIGINT) AS least_seed, count(*) AS summary_rows FROM ({_RUNS_OF_SUITE}) GROUP BY 1")
def a8_tables(spark, sf):
    """The result tables written and read back: aggregate with seeds and errors, and the flat summary."""
    runs = _suite_runs(spark, sf)[1]
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    results.write_tables(runs, suite.aggregated(runs, "classification"), path)
    total = spark.read.schema("n_runs long, n_ok long, errors array<string>, seeds array<long>, n_samples long, accuracy_mean double, framework string").json(f"{path}/aggregate")
    flat = spark.read.schema("framework string").json(f"{path}/summary").groupBy("framework").agg(F.count("*").alias("summary_rows"))
    return total.join(flat, "framework").select("framework", "n_runs", "n_ok", F.size("errors").cast("long").alias("n_errors"), "n_samples", "accuracy_mean", F.col("seeds")[0].alias("least_seed"), "summary_rows")


QUERIES["d1_naive_bayes_kernel"] = lambda spark, sf: prequential(instances(spark, sf, "ev_users"), "naive_bayes")
ORACLES["d1_naive_bayes_kernel"] = oracles.naive_bayes("ev_users")
QUERIES["d6_knn_kernel"] = lambda spark, sf: prequential(instances(spark, sf, "ev_users"), "knn", {"window": 40})
ORACLES["d6_knn_kernel"] = oracles.knn("ev_users", 5, 40, False)


@query("j5_seeded_runs")
def j5(spark, sf):
    """Bagging with three seeds: seeds are keys of the same job."""
    one = suite.Suite({"bagging": ("bagged_naive_bayes", {"members": 3})}, "classification", ["ev_users"], n_runs=3)
    return _rounded(one.runs(stored(one.predictions(spark, sf))), *_METRICS).select("framework", "dataset", "run_id", "seed", "n_samples", *_METRICS)


class _Majority:
    """A learner from outside the library: the commonest label so far, the smallest of equals."""

    def __init__(self, width: int, **_):
        self.counts: dict[int, int] = {}

    def predict(self, x) -> int:
        return min(self.counts, key=lambda c: (-self.counts[c], c)) if self.counts else 0

    def learn(self, x, y: int) -> None:
        self.counts[int(y)] = self.counts.get(int(y), 0) + 1


_SO_FAR = ", ".join(f"count(*) FILTER (y = {c}) OVER {oracles.BEFORE} AS c{c}" for c in range(5))


@query("j3_registered_learner", f"SELECT stream_id, seq, y, CAST({scalar.argmax([f'c{c}' for c in range(5)], list(range(5)), '0')} AS INTEGER) AS pred FROM (SELECT stream_id, seq, y, {_SO_FAR} FROM ({stream_sql('ev_users')}))")
def j3(spark, sf):
    """Any class with predict and learn runs in the fold once it is registered."""
    register("majority", _Majority, "classification")
    return prequential(instances(spark, sf, "ev_users"), "majority")


@query("e6_sorted_runs", f"SELECT framework, dataset, run_id, row_number() OVER (ORDER BY run_id, framework, dataset) AS place FROM ({_RUNS_SQL})")
def e6(spark, sf):
    """Runs in the order of results, numbered by it."""
    return numbered(stored(_runs(spark, sf).select("framework", "dataset", "run_id")), ["run_id", "framework", "dataset"]).select("framework", "dataset", "run_id", F.col("seq").alias("place"))


@query("a1_datasets", " UNION ALL ".join(f"SELECT '{t}' AS task, '{n}' AS name, {i + 1} AS place, count(*) AS n_samples FROM {STREAMS[n].table}" for t in ("classification", "regression") for i, n in enumerate(sorted(s.name for s in STREAMS.values() if s.task == t))))
def a1(spark, sf):
    """The catalog's names per task, sorted, with the rows of their tables."""
    names = [(t, n, i + 1, STREAMS[n].table) for t in ("classification", "regression") for i, n in enumerate(suite.list_datasets(t))]
    rows = None
    for table in sorted({n[-1] for n in names}):
        one = spark.read.parquet(f"{sf}/{table}.parquet").agg(F.count("*").alias("n_samples")).withColumn("table", F.lit(table))
        rows = one if rows is None else rows.union(one)
    return spark.createDataFrame(names, "task string, name string, place int, table string").join(F.broadcast(rows), "table").select("task", "name", "place", "n_samples")


# --- ensembles and drift ---------------------------------------------------------------------------------

_TEAM = ("perceptron", "logistic", "passive_aggressive")


def _team(spark, sf) -> DataFrame:
    return prequential_each(instances(spark, sf, "ev_users"), _TEAM)


_TEAM_SQL = " UNION ALL ".join(f"SELECT {i} AS member, * FROM ({oracles.linear_classifier('ev_users', a)})" for i, a in enumerate(_TEAM))


@query("f3_recency_vote", f"SELECT stream_id, seq, y, pred FROM (SELECT stream_id, seq, y, pred, sum((member + 1) / 3) AS w, min(member) AS o FROM ({_TEAM_SQL}) GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY stream_id, seq ORDER BY round(w, 9) DESC, o) = 1")
def f3(spark, sf):
    return ensemble.recency_vote(_team(spark, sf), 3)


_LINES = ("linear", "bayesian_linear", "passive_aggressive_reg")
_LINES_SQL = " UNION ALL ".join(f"SELECT {i} AS member, * FROM ({oracles.linear_regressor('ev_value', a).replace('round(pred, 6)', 'pred')})" for i, a in enumerate(_LINES))


def _lines(spark, sf) -> DataFrame:
    return prequential_each(instances(spark, sf, "ev_value"), _LINES)


@query("f4_mean_vote", f"SELECT stream_id, seq, y, round(avg(pred), 5) AS pred FROM ({_LINES_SQL}) GROUP BY 1, 2, 3")
def f4(spark, sf):
    return _rounded(ensemble.mean_vote(_lines(spark, sf)), "pred", places=5)


@query("f5_guarded_mean", f"WITH b AS (SELECT stream_id, seq, coalesce(avg(y) OVER {oracles.BEFORE}, 0) AS running FROM ({stream_sql('ev_value')})), m AS (SELECT stream_id, seq, y, sum(CASE WHEN abs(pred) <= 0.8 THEN pred * (member + 1) / 3 END) / sum(CASE WHEN abs(pred) <= 0.8 THEN (member + 1) / 3 END) AS m FROM ({_LINES_SQL}) GROUP BY 1, 2, 3) SELECT stream_id, seq, y, round(coalesce(m, running), 4) AS pred FROM m JOIN b USING (stream_id, seq)")
def f5(spark, sf):
    rows = stored(instances(spark, sf, "ev_value")).select("stream_id", "seq", "y")
    ran = scan(rows, {"n": ("sum", F.lit(1)), "s": ("sum", F.col("y"))})
    running = ran.select("stream_id", "seq", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("running"))
    return _rounded(ensemble.guarded_mean(_lines(spark, sf), running, 3, most=0.8), "pred", places=4)


@query("f6_best_member", f"WITH p AS ({_TEAM_SQL}), r AS (SELECT *, coalesce(sum(CASE WHEN y = pred THEN 1 ELSE 0 END) OVER (PARTITION BY member, stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good FROM p) SELECT stream_id, seq, y, pred FROM r QUALIFY row_number() OVER (PARTITION BY stream_id, seq ORDER BY good DESC, member) = 1")
def f6(spark, sf):
    """As of each row, the prediction of the member that was right most often before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("member", "stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = _team(spark, sf).withColumn("good", F.coalesce(F.sum((F.col("y") == F.col("pred")).cast("int")).over(w), F.lit(0)))
    return rows.groupBy("stream_id", "seq", "y").agg(F.max_by("pred", F.struct("good", -F.col("member"))).alias("pred"))


@query("f1_bagging")
def f1(spark, sf):
    return ensemble.recency_vote(ensemble.bagging(instances(spark, sf, "ev_users"), "logistic", 5), 5)


@query("f2_probability_vote")
def f2(spark, sf):
    return ensemble.probability_vote(prequential_each(instances(spark, sf, "li_lots"), ("logistic", "softmax", "hoeffding_tree"), proba=True))


def _errors(spark, sf, name="ev_error") -> DataFrame:
    return instances(spark, sf, name).select("stream_id", "seq", F.col("y").alias("value"))


QUERIES["g1_adwin"] = lambda spark, sf: drift.detect(_errors(spark, sf, "li_lots_error"), "adwin")
QUERIES["g2_eddm"] = lambda spark, sf: drift.detect(_errors(spark, sf, "li_lots_error"), "eddm")
ORACLES["g2_eddm"] = oracles.eddm("li_lots_error")


QUERIES["g2_eddm_stream"] = lambda spark, sf: drift.every_eddm(stored(_errors(spark, sf)))
ORACLES["g2_eddm_stream"] = oracles.eddm("ev_error")


@query("g2_first_eddm", f"WITH e AS (SELECT stream_id, seq, seq - coalesce(lag(seq) OVER (PARTITION BY stream_id ORDER BY seq), 0) AS gap FROM ({stream_sql('li_lots_error')}) WHERE y = 1), l AS (SELECT stream_id, seq, avg(gap) OVER w + 2 * stddev_pop(gap) OVER w AS level, count(*) OVER w AS n FROM e WINDOW w AS {oracles.UPTO}), t AS (SELECT *, max(level) OVER {oracles.UPTO} AS top FROM l WHERE n >= 30) SELECT stream_id, min(seq) AS seq FROM t WHERE level < 0.9 * top GROUP BY 1")
def g2_first(spark, sf):
    return drift.first_eddm(_errors(spark, sf, "li_lots_error"))


@query("g3_score_drops", f"WITH w AS (SELECT stream_id, CAST(floor((seq - 1) / 500) AS BIGINT) AS window_no, 1 - avg(y) AS score FROM ({stream_sql('ev_error')}) GROUP BY 1, 2), b AS (SELECT *, lag(score) OVER (PARTITION BY stream_id ORDER BY window_no) AS before FROM w) SELECT stream_id, window_no, round(score, 6) AS score, round(before, 6) AS before FROM b WHERE score < 0.95 * before")
def g3(spark, sf):
    per = _errors(spark, sf).groupBy("stream_id", metrics.window_no(500)).agg((1 - F.avg("value")).alias("score"))
    return _rounded(drift.score_drops(per), "score", "before")


# --- search ----------------------------------------------------------------------------------------------

def _curve(preds: DataFrame, task: str) -> DataFrame:
    """What a search is judged by: its score on each stream per 1,000 rows."""
    if task == "classification":
        score = F.avg((F.col("y") == F.col("pred")).cast("int"))
    else:
        score = F.sqrt(F.avg((F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))))
    return preds.groupBy("seed", "stream_id", metrics.window_no(1000)).agg(F.count("*").alias("n"), F.round(score, 6).alias("score"))


#: Strategies with their usual windows and budgets, on streams of some 6,000 rows each.
_SEARCHES = {
    "h6_adaptive_search": ("adaptive", "li_lots", {}), "h7_drift_reaction": ("adaptive", "li_lots_abrupt", {}), "h8_adaptive_search_reg": ("adaptive_reg", "li_lots_revenue", {}),
    "h9_evolutionary_bagging": ("evolving", "li_lots", {}), "h9_evolutionary_bagging_reg": ("evolving_reg", "li_lots_revenue", {}),
    "h10_genetic_search": ("genetic", "li_lots", {}), "h13_online_automl": ("online", "li_lots_abrupt", {}), "h14_champion": ("champion", "li_lots_revenue", {}),
}
for _id, (_strategy, _name, _params) in _SEARCHES.items():
    QUERIES[_id] = lambda spark, sf, s=_strategy, n=_name, p=_params: _curve(search.searched(instances(spark, sf, n), s, p), STREAMS[n].task)


@query("h7_search_log")
def h7_log(spark, sf):
    """Windows, falls, drift and the return to normal on streams whose labels flip half-way."""
    return _rounded(search.search_log(instances(spark, sf, "li_lots_abrupt"), "adaptive"), "score")


QUERIES["h15_forest"] = lambda spark, sf: _rounded(prequential(instances(spark, sf, "li_lots_revenue"), "forest_reg", {"models": 3}), "pred")


@query("h12_holdout_search")
def h12(spark, sf):
    """Twenty random pipelines on every user's stream, each judged by the rows it hasn't learned."""
    return _rounded(search.holdout_search(instances(spark, sf, "ev_users")), "score")



# --- live ------------------------------------------------------------------------------------------------

@query("j1_live_learning", oracles.linear_classifier("ev_users", "logistic"))
def j1(spark, sf):
    """The stream written as files, then learned from as a live stream until all are read."""
    top = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = instances(spark, sf, "ev_users").select("stream_id", "seq", "x", "y")
    rows.repartition(4, "stream_id").write.parquet(f"{top}/in")
    live = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
    run_available(live_predictions(live, "logistic"), f"{top}/out", f"{top}/state")
    return spark.read.parquet(f"{top}/out").select("stream_id", "seq", "y", "pred")


@query("j1_typed_state", oracles.linear_regressor("ev_value", "bayesian_linear"))
def j1_typed(spark, sf):
    """The same with weights and precisions as typed state, over several micro-batches."""
    top = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = instances(spark, sf, "ev_value").select("stream_id", "seq", "x", "y")
    for part in ("seq <= 30", "seq > 30"):  # a file is a micro-batch
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{top}/in")
    live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    run_available(typed_predictions(live, "bayesian_linear"), f"{top}/out", f"{top}/state")
    return _rounded(spark.read.parquet(f"{top}/out").select("stream_id", "seq", "y", "pred"), "pred")


@query("j2_live_windows", f"SELECT stream_id, CAST(floor((seq - 1) / 20) AS BIGINT) AS window_no, count(*) AS n, CAST(sum(CASE WHEN y = pred THEN 1 ELSE 0 END) AS BIGINT) AS good FROM ({oracles.linear_classifier('ev_users', 'perceptron')}) GROUP BY 1, 2")
def j2(spark, sf):
    """Count windows of a live stream, added up batch by batch."""
    top = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = instances(spark, sf, "ev_users").select("stream_id", "seq", "x", "y")
    rows.repartition(3, "stream_id").write.parquet(f"{top}/in")
    live = live_predictions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"), "perceptron", window=20)

    def add(batch: DataFrame, epoch: int) -> None:
        part = batch.groupBy("stream_id", "window_no").agg(F.count("*").alias("n"), F.sum((F.col("y") == F.col("pred")).cast("long")).alias("good"))
        part.write.mode("overwrite").parquet(f"{top}/windows/epoch={epoch}")

    live.writeStream.foreachBatch(add).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{top}/windows").groupBy("stream_id", "window_no").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
