"""The thirteen operators on the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import (
    ballkmeans,
    interleave,
    language,
    licenses,
    merges,
    packing,
    periodic,
    personal,
    piecewise,
    simhash,
    tokencount,
    toxicity,
    vptree,
)
from jobweave.llm.common import remainder
from jobweave.queries.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SHARDS = 24


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    index = vptree.staged_index(vectors)
    return vptree.nearest(index, vectors.filter(F.col("vec_id") % 50 == 0), k=5, factor=1.0)


@query
def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, folder, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleave.interleave(rows, SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, folder, "documents")))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.label_toxicity(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


@query
def op7_piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    return piecewise.fingerprint_neighbours(table(spark, folder, "documents"))


@query
def op8_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return merges.with_round_trip(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded").eqNullSafe(F.col("text"))).alias("lossless"),
    )


@query
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.identify(docs, language.train(docs))
    return found.withColumn("held_out", remainder("doc_id", 4) == 2)


@query
def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal.find_personal_data(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*personal.BASE))
    return found.select(
        "doc_id",
        *map(count, personal.BASE),
        F.sha2(personal.joined(base).cast("binary"), 256).alias("base_sha256"),
        personal.joined(F.col("spans")).alias("spans"),
    )


@query
def op11_ball_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = ballkmeans.encode(table(spark, folder, "embeddings"))
    return ballkmeans.with_group_error(coded).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def planted_period(doc_id: int | None, words: list[str]) -> list[str]:
    """One id in ten, by its crc32, repeats the words from some place on with some period."""
    number = zlib.crc32(str(doc_id).encode())
    if doc_id is None or number % 10 or not words:
        return words
    turn = number // 10
    begin = turn % len(words)
    period = 1 + (len(words) - begin) // (3 + turn % 8)
    return words[:begin] + [words[begin + i % period] for i in range(len(words) - begin)]


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.find_runs(table(spark, folder, "documents"), edit=planted_period)
    best = periodic.longest("runs")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-best.start).alias("start"),
        best.length.alias("length"),
        (-best.period).alias("period"),
        F.floor(1000 * best.length / -best.period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"))


SQL["op1_nearest_neighbours"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_reduce(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x), lambda a, b: a + b)) AS n
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b)
           / (q.n * c.n) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

SQL["op2_shards"] = f"""
WITH RECURSIVE step AS (
  SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS crc FROM step WHERE k = 8),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS body, hex(encode(coalesce(text, ''))) AS digits
  FROM documents),
s AS (
  SELECT doc_id, source, CAST(len(digits) // 2 + 8 AS BIGINT) AS size,
         CAST(xor(list_reduce(
           list_prepend(CAST(4294967295 AS UBIGINT), list_transform(
             string_split_regex(regexp_replace(digits, '(..)', '\\1 ', 'g'), ' ')[1:len(digits) // 2],
             lambda b: CAST('0x' || b AS UBIGINT))),
           lambda a, b: xor(a // 256, tab.crc[CAST(xor(a % 256, b) AS BIGINT) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM d, tab),
m AS (
  SELECT *, md5('7:' || doc_id) AS mix,
         CAST('0x' || md5('7:' || source)[1:8] AS BIGINT) / 4294967296.0::DOUBLE AS begin
  FROM s),
f AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY mix, doc_id, source, size, text_crc32) - 1 + begin)
            / count(*) OVER (PARTITION BY source) AS share
  FROM m),
g AS (
  SELECT *, row_number() OVER (ORDER BY share, source) - 1 AS place, count(*) OVER () AS total FROM f),
h AS (SELECT *, CAST(place * {SHARDS} // total AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
       CAST(place - (shard * total + {SHARDS - 1}) // {SHARDS} AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM h
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(
    f"({i}, {_quoted(name)}, {len(pairs)}, {few}, {many}, [{', '.join(map(_quoted, pairs))}])"
    for i, (name, pairs, few, many) in enumerate(licenses.template_rows())
)
_ANCHORS = ", ".join(f"({t}, {place}, {_quoted(pair)})" for t, place, pair in licenses.anchor_rows())
SQL["op3_licenses"] = f"""
WITH known(t, name, m, few, many, pairs) AS (VALUES {_KNOWN}),
anchor(t, place, pair) AS (VALUES {_ANCHORS}),
want AS (SELECT t, unnest(pairs) AS pair FROM known),
plain AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')),
           '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), ' ' || chr(10)) AS body
  FROM documents),
unit AS (
  SELECT DISTINCT doc_id, unnest(list_concat(list_concat(
           string_split(body, chr(10)),
           list_transform(string_split_regex(body, '\\n\\n+'), lambda p: replace(p, chr(10), ' '))),
           [regexp_replace(body, '\\n+', ' ', 'g')])) AS unit
  FROM plain),
sized AS (
  SELECT doc_id, unit, string_split(unit, ' ') AS words, len(unit) - len(replace(unit, ' ', '')) AS n FROM unit),
near AS (
  SELECT * FROM sized WHERE n >= (SELECT min(few) FROM known WHERE m <= {licenses.SHORT})
    AND n <= (SELECT max(many) FROM known WHERE m <= {licenses.SHORT})),
pair AS (
  SELECT doc_id, unit, n, unnest(list_transform(range(1, n + 1), lambda i: words[i] || ' ' || words[i + 1])) AS pair
  FROM near),
bag AS (
  SELECT doc_id, unit, n, pair || ' ' || (row_number() OVER (PARTITION BY doc_id, unit, pair) - 1) AS pair FROM pair),
hit AS (
  SELECT b.doc_id, b.unit, k.name, count(*) * 2 / (any_value(b.n) + any_value(k.m))::DOUBLE AS score
  FROM bag b JOIN want w ON b.pair = w.pair JOIN known k
    ON k.t = w.t AND b.n BETWEEN k.few AND k.many AND k.m <= {licenses.SHORT}
  GROUP BY b.doc_id, b.unit, k.t, k.name HAVING score >= {licenses.LEAST}),
line AS (SELECT doc_id, string_split(regexp_replace(body, '\\n+', ' ', 'g'), ' ') AS words FROM plain),
place AS (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM line),
start AS (
  SELECT DISTINCT p.doc_id, p.words, k.t, k.name, k.m, k.few, p.i - 1 - a.place AS s
  FROM place p JOIN anchor a ON a.pair = p.words[p.i] || ' ' || p.words[p.i + 1] JOIN known k ON k.t = a.t),
wide AS (SELECT doc_id, t, name, m, few, words[greatest(s, 0) + 1 : least(s + m + 1, len(words))] AS words FROM start),
frame AS (
  SELECT doc_id, t, name, m, array_to_string(words, ' ') AS unit, len(words) - 1 AS n,
         list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM (SELECT DISTINCT * FROM wide) WHERE len(words) > few),
framed AS (SELECT doc_id, t, name, m, unit, n, unnest(pairs) AS pair FROM frame),
frame_bag AS (
  SELECT doc_id, t, name, m, unit, n,
         pair || ' ' || (row_number() OVER (PARTITION BY doc_id, t, unit, pair) - 1) AS pair FROM framed),
frame_hit AS (
  SELECT b.doc_id, b.unit, b.name, count(*) * 2 / (any_value(b.n) + any_value(b.m))::DOUBLE AS score
  FROM frame_bag b JOIN want w ON b.pair = w.pair AND b.t = w.t
  GROUP BY b.doc_id, b.unit, b.t, b.name HAVING score >= {licenses.LEAST}),
every AS (SELECT * FROM hit UNION ALL SELECT * FROM frame_hit),
best AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(score) AS best_score,
         count(DISTINCT unit) AS n_units
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(b.licenses, '') AS licenses,
       (SELECT min(name) FROM every h WHERE h.doc_id = d.doc_id AND h.score = b.best_score) AS best_license,
       coalesce(b.best_score, 0.0::DOUBLE) AS best_score, CAST(coalesce(b.n_units, 0) AS INTEGER) AS n_units
FROM documents d LEFT JOIN best b USING (doc_id)
"""


def _ball_sql(parts: int = ballkmeans.PARTS, entries: int = ballkmeans.ENTRIES, rounds: int = ballkmeans.ROUNDS) -> str:
    """Plain k-means of every part against every entry, one common table per round."""
    steps = [
        f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({ballkmeans.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
  FROM kept, range({parts}) t(p)),
books0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min((d, e)) AS best, any_value(x) AS x
  FROM (SELECT vec_id, label, part.p, x, e,
               list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
        FROM part JOIN books{r} USING (p))
  GROUP BY vec_id, label, p)"""
        )
        if r < rounds:
            steps.append(
                f"""
mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c
  FROM (SELECT p, best[2] AS e, i, (sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
        FROM near{r}, range(1, len(x) + 1) t(i) GROUP BY p, best[2], i)
  GROUP BY p, e),
books{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(mean{r}.c, books{r}.c) AS c FROM books{r} LEFT JOIN mean{r} USING (p, e))"""
            )
    return ",".join(steps) + f""",
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id, label),
books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded, books
"""


SQL["op11_ball_codes"] = _ball_sql()
