"""The registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamtrial.llm import clustering, extraction, fingerprints, jaccard, langid, linededup, lm_scoring, mixing, packing, quality, ranking, toxicity, urlfilter
from streamtrial.llm.common import documents

TOXIC_AT = 0.6


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    labelled = docs.where(~F.coalesce("held_out", F.lit(False)))
    return langid.identify(docs, labelled, keep=["doc_id", "held_out"])


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(documents(spark, sf_dir), labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), toxicity_chain(spark, sf_dir))
    return scored.withColumn("toxic", F.col("p_toxic") >= TOXIC_AT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality.judge(documents(spark, sf_dir), trusted)


def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(documents(spark, sf_dir))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jaccard.join(documents(spark, sf_dir), n=3, num=90, den=100)
    return rows.select("doc_id", "n_shingles", "component_id")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.pseudo_likelihood(documents(spark, sf_dir))


MIX = {"fraction": 0.5, "epochs": 2, "seed": 17, "weights": {"domain": {"d1": 3, "d0": 2}, "lang": {"en": 4, "de": 3, "fr": 2}}}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), **MIX)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir), tokenizer_path()))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dims=64, k=16, rounds=3, seed=1)


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_langid, op2_toxicity, op3_fingerprints, op4_quality, op5_urlfilter, op6_linededup, op7_jaccard, op8_lm_scoring, op9_mixing, op10_packing, op11_clustering, op12_extraction, op13_ranking)}

# Words of whole texts, lower-cased in ASCII; three-word shingles; all pairs that share one; reachability.
OP7_SQL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END) AS sh
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""


def _cases(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(weights.items())) + " ELSE 1 END" if weights else "1"


def _mix_sql(fraction: float, epochs: int, seed: int, weights: dict[str, dict[str, int]]) -> str:
    """The same budgets, level by level, and the head of the epochs by plain running sums."""
    steps, above = [], ["1"]
    given = "top"
    for level in mixing.LEVELS:
        key = [*[k for k in above if k != "1"], level]
        part = ", ".join(k for k in key[:-1])
        by = f"PARTITION BY {part}" if part else ""
        using = f"JOIN {given} USING ({part})" if part else f"CROSS JOIN {given}"
        steps.append(f"""{level}_a AS (SELECT {', '.join(key)}, sum(cap)::DOUBLE AS c, ({_cases(level, weights.get(level, {}))})::DOUBLE AS w FROM leaf GROUP BY {', '.join(key)}),
{level}_b AS (SELECT *, coalesce(sum(c) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0, coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
  sum(w) OVER ({by}) AS wall FROM {level}_a {using} WINDOW o AS ({by} ORDER BY c / w, {level})),
{level}_c AS (SELECT *, (given - c0) / (wall - w0) AS rate FROM {level}_b),
{level}_d AS (SELECT *, first(CASE WHEN c > rate * w THEN rate END ORDER BY c > rate * w DESC, c / w, {level}) OVER ({by}) AS open FROM {level}_c),
{level}_e AS (SELECT {', '.join(key)}, CASE WHEN c <= rate * w THEN c ELSE open * w END AS given FROM {level}_d)""")
        above, given = key, f"{level}_e"
    return f"""
WITH doc AS MATERIALIZED (
  SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n,
    'd' || coalesce(regexp_extract(source, '([0-9])', 1), '') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
leaf AS MATERIALIZED (SELECT domain, lang, source, sum(n) * {epochs} AS cap FROM doc GROUP BY ALL),
top AS (SELECT least(floor(sum(cap) / {epochs} * {fraction}), sum(cap))::DOUBLE AS given FROM leaf),
{','.join(steps)},
want AS (SELECT domain, lang, source, floor(given)::BIGINT AS budget FROM {given}),
dealt AS (SELECT doc.*, e.epoch, md5('{seed}|' || e.epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS k FROM doc CROSS JOIN (SELECT unnest(range({epochs})) AS epoch) e),
run AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY epoch, k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM dealt)
SELECT doc_id, epoch::INTEGER AS epoch FROM run JOIN want USING (domain, lang, source) WHERE budget > 0 AND upto <= budget
"""


def _url_sql() -> str:
    """Rules, host edges, and the rounds of propagation one after the other."""
    rules = sorted(urlfilter.RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for h, p, v in rules) + " END"
    lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    found = lambda k: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {k}), '')"
    link = urlfilter._LINK.replace("'", "''")
    d, state, rounds = urlfilter.DAMPING, "source", []
    for i in range(urlfilter.ROUNDS):
        rounds.append(f"s{i} AS MATERIALIZED (SELECT host, kind, sum(mass) AS mass FROM (SELECT t.stop AS host, kind, mass * share * {d} AS mass FROM {state} JOIN steps t USING (host, kind) UNION ALL SELECT * FROM source) GROUP BY 1, 2)")
        state = f"s{i}"
    return f"""
WITH r AS MATERIALIZED (SELECT page_id, html, {lower(found(1))} AS host, {found(2)} AS path FROM pages),
told AS MATERIALIZED (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS listed FROM r),
counts AS MATERIALIZED (SELECT host, count(*) AS pages, count(CASE WHEN listed = 'allow' THEN 1 END) AS trust, count(CASE WHEN listed = 'block' THEN 1 END) AS distrust FROM told GROUP BY 1),
links AS (SELECT src, dst, count(*) AS weight FROM (SELECT host AS src, regexp_replace({lower('x')}, '^.*@', '') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM r)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
parts AS (SELECT string_split(host, '.') AS a FROM counts WHERE len(string_split(host, '.')) > 2),
up AS (SELECT DISTINCT array_to_string(a[i:], '.') AS src, array_to_string(a[i + 1:], '.') AS dst FROM (SELECT a, unnest(range(1, len(a) - 1)) AS i FROM parts)),
edges AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY 1, 2),
steps AS MATERIALIZED (SELECT 'trust' AS kind, src AS host, dst AS stop, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM edges),
source AS MATERIALIZED (SELECT host, 'trust' AS kind, trust * (1 - {d}) AS mass FROM counts WHERE trust > 0 UNION ALL SELECT host, 'distrust', distrust * (1 - {d}) FROM counts WHERE distrust > 0),
{', '.join(rounds)},
ranks AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN mass ELSE 0 END)::DOUBLE AS t, sum(CASE WHEN kind = 'distrust' THEN mass ELSE 0 END)::DOUBLE AS d FROM {state} GROUP BY 1),
v AS (SELECT host, pages, coalesce(t, 0) AS t, coalesce(d, 0) AS d FROM counts LEFT JOIN ranks USING (host))
SELECT page_id, told.host, path, rule, coalesce(listed, CASE WHEN told.host <> '' AND d - t >= pages * (1 - {d}) / 2 THEN 'block' ELSE 'allow' END) AS verdict, round(t, 6) AS trust, round(d, 6) AS distrust
FROM told LEFT JOIN v USING (host)
"""


def _lloyd_sql(k: int, rounds: int, seed: int) -> str:
    """Rows (vector, dimension, component) against rows of the centroids, a round after the other."""
    steps, now = [], "c0"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, k, dist FROM (SELECT r, k, sum((d.x - c.x) * (d.x - c.x))::BIGINT AS dist FROM d JOIN {now} c USING (i) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, k) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM d JOIN a{i} USING (r) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c.x)::BIGINT AS x FROM {now} c LEFT JOIN m{i} USING (k, i))""")
            now = f"c{i + 1}"
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(x) AS x FROM v),
f AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k})),
c0 AS MATERIALIZED (SELECT k, unnest(range(64)) AS i, unnest(x) AS x FROM f),
{', '.join(steps)},
n AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS sha FROM {now} GROUP BY 1)
SELECT vec_id, k::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, sha AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN n USING (k)
"""


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
# Every document against every item by plain joins of their terms.
OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY 1, 2),
s AS (SELECT count(*) AS N, sum(len(ts))::BIGINT AS L FROM t WHERE len(ts) > 0),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) CROSS JOIN s),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(ts) * N) // L AS m FROM t CROSS JOIN s WHERE len(ts) > 0 AND doc_id IS NOT NULL),
x AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM x JOIN m USING (r) WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10
"""

ORACLES = {"op5_urlfilter": _url_sql(), "op7_jaccard": OP7_SQL, "op9_mixing": _mix_sql(**MIX), "op11_clustering": _lloyd_sql(16, 3, 1), "op13_ranking": OP13_SQL}
