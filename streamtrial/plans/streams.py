"""The catalog of labelled streams over the given tables.

A definition is SQL text that means the same in Spark and in ANSI SQL, so a stream and the SQL that checks it
come from one place. ``seq`` numbers the rows of a stream from 1 in its order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtrial.operators.numbering import numbered


@dataclass(frozen=True)
class Stream:
    name: str
    task: str
    table: str
    order: tuple[str, ...]
    features: tuple[str, ...]
    target: str  # may use seq and n, the number of rows
    classes: tuple[int, ...] = ()
    key: str | None = None  # a stream of its own per value; SQL text

    @property
    def width(self) -> int:
        return len(self.features)


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
_RULE = ("l_quantity / 50", "l_discount * 10", "l_tax * 10")
_IS = "(CASE WHEN l_quantity / 50 + l_discount * 10 > 1 THEN 1 ELSE 0 END)"
#: Ten suppliers: some 6,000 rows at every size of the table, so there are more lots in a larger one, not longer ones.
_LOT = "CAST(floor((l_suppkey - 1) / 10) AS BIGINT)"
#: Errors that become six times as frequent in the middle of a stream.
_ERROR = "CASE WHEN (seq * 7919) % 100 < (CASE WHEN 2 * seq > n THEN 60 ELSE 10 END) THEN 1 ELSE 0 END"
_EVENT = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_PROPS = ("value", "CAST(hour(ts) AS DOUBLE)", "CAST(get_json_object(props, '$.k') AS DOUBLE)")

STREAMS = {
    s.name: s
    for s in (
        Stream("li_flag", "classification", "lineitem", _LINE, ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END", (0, 1, 2)),
        Stream("li_rule", "classification", "lineitem", _LINE, _RULE, _IS, (0, 1)),
        Stream("li_abrupt", "classification", "lineitem", _LINE, _RULE, f"CASE WHEN 2 * seq > n THEN 1 - {_IS} ELSE {_IS} END", (0, 1)),
        Stream("li_gradual", "classification", "lineitem", _LINE, _RULE, f"CASE WHEN ((seq * 7919) % 100) * n < 100 * seq THEN 1 - {_IS} ELSE {_IS} END", (0, 1)),
        Stream("li_lots", "classification", "lineitem", _LINE, _RULE, _IS, (0, 1), _LOT),
        Stream("li_lots_abrupt", "classification", "lineitem", _LINE, _RULE, f"CASE WHEN 2 * seq > n THEN 1 - {_IS} ELSE {_IS} END", (0, 1), _LOT),
        Stream("li_lots_revenue", "regression", "lineitem", _LINE, ("l_extendedprice / 100000", "l_discount * 10", "l_tax * 10"), "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 100000", (), _LOT),
        Stream("li_lots_error", "classification", "lineitem", _LINE, ("l_quantity / 50",), _ERROR, (0, 1), _LOT),
        Stream("li_revenue", "regression", "lineitem", _LINE, ("l_extendedprice / 100000", "l_discount * 10", "l_tax * 10"), "l_extendedprice * (1 - l_discount) * (1 + l_tax) / 100000"),
        Stream("ev_type", "classification", "events", ("event_id",), _PROPS, _EVENT, (0, 1, 2, 3, 4)),
        Stream("ev_users", "classification", "events", ("event_id",), ("value / 100", "CAST(hour(ts) AS DOUBLE) / 24", "CAST(get_json_object(props, '$.k') AS DOUBLE) / 100"), _EVENT, (0, 1, 2, 3, 4), "user_id"),
        Stream("ev_value", "regression", "events", ("event_id",), ("CAST(hour(ts) AS DOUBLE) / 24", "CAST(get_json_object(props, '$.k') AS DOUBLE) / 100", f"CAST({_EVENT} AS DOUBLE) / 4"), "value / 100", (), "user_id"),
        Stream("ev_amount", "regression", "events", ("event_id",), ("CAST(hour(ts) AS DOUBLE) / 24", "CAST(get_json_object(props, '$.k') AS DOUBLE) / 100", f"CAST({_EVENT} AS DOUBLE) / 4"), "value / 100"),
        Stream("doc_quality", "classification", "documents", ("doc_id",), ("CAST(n_chars AS DOUBLE)",), "CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END", (0, 1)),
        Stream("ev_error", "classification", "events", ("event_id",), ("value",), _ERROR, (0, 1)),
    )
}


def instances(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """stream_id, seq, n, x array<double>, y of a stream, in one range-dealt numbering pass."""
    s = STREAMS[name]
    table = spark.read.parquet(f"{sf_dir}/{s.table}.parquet")
    if s.key:
        table = table.withColumn("_key", F.expr(s.key))
    rows = numbered(table, list(s.order), "_key" if s.key else None)
    kind = "int" if s.task == "classification" else "double"
    stream = F.col("_key").cast("string") if s.key else F.lit(name)
    x = F.array(*[F.expr(f).cast("double") for f in s.features])
    return rows.select(stream.alias("stream_id"), "seq", "n", x.alias("x"), F.expr(s.target).cast(kind).alias("y"))


def stream_sql(name: str) -> str:
    """The same rows for DuckDB, with features f0, f1, ... in columns of their own."""
    s = STREAMS[name]
    by = f"PARTITION BY {s.key}" if s.key else ""
    fix = lambda e: e.replace("get_json_object(props, '$.k')", "(props->>'$.k')")
    features = ", ".join(f"CAST({fix(f)} AS DOUBLE) AS f{i}" for i, f in enumerate(s.features))
    kind = "INTEGER" if s.task == "classification" else "DOUBLE"
    stream = f"CAST({s.key} AS VARCHAR)" if s.key else f"'{name}'"
    return f"""SELECT {stream} AS stream_id, seq, n, {features}, CAST({fix(s.target)} AS {kind}) AS y
FROM (SELECT *, row_number() OVER ({by} ORDER BY {', '.join(s.order)}) AS seq, count(*) OVER ({by}) AS n FROM {s.table})"""
