"""One thin query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe, brown, codebooks, decontaminate, langcnn, licences, nearest, quality, ranked, secrets, similar, toxicity, warc
from sparkweave.llm.registry import query, table


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _fold(modulus: int) -> Column:
    """crc32 of the id as text, by its remainder; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


@query()
def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = brown.fit(docs.where(_fold(10) != 0))
    scored = brown.score(docs, model, counts)
    return scored.select("doc_id", (_fold(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    network = langcnn.fit(docs.where(_fold(5) != 0))
    found = langcnn.predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (_fold(5) == 0).alias("held_out"), "lang_pred", "score")


@query()
def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _fold(4) == 2
    weights = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _fold(5) == 0
    fitted = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, fitted)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query()
def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where("leak").drop("leak")


@query()
def op3_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.roundtrip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    """WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    sqrt(list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""
)
def op8_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors.where(F.col("vec_id") % 100 == 0), vectors)


@query()
def op5_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar.join(docs, similar.Rule(width=4, num=85, den=100))


def _rounds_sql(parts: int, entries: int, rounds: int) -> str:
    """Codes, errors and codebooks from their definition: each round is an assignment of all parts and new entries from it."""
    apart = "CAST(list_sum(list_transform(list_zip(t.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    text = f"""WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda e: CAST(floor(4096 * e) AS BIGINT)) AS x FROM embeddings
  WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(embedding) > 0 AND len(embedding) % {parts} = 0),
cut AS MATERIALIZED (SELECT i, p.range AS p, x[p.range * len(x) // {parts} + 1 : (p.range + 1) * len(x) // {parts}] AS v FROM kept CROSS JOIN range({parts}) p),
c0 AS MATERIALIZED (SELECT p, i - 1 AS e, v FROM cut WHERE i <= {entries})"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT i, p, v, e, d FROM (SELECT t.i, t.p, t.v, c.e, {apart} AS d, row_number() OVER (PARTITION BY t.i, t.p ORDER BY {apart}, c.e) AS r FROM cut t JOIN c{r} c ON c.p = t.p) WHERE r = 1)"""
        if r < rounds:
            text += f""",
n{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT p, e, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, e, unnest(v) AS y, generate_subscripts(v, 1) AS j FROM a{r}) GROUP BY p, e, j) GROUP BY p, e),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN n{r} n ON n.p = c.p AND n.e = c.e)"""
    return f"""{text},
coded AS (SELECT i, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY i)
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept k JOIN coded o ON o.i = k.i"""


@query(_rounds_sql(codebooks.PARTS, codebooks.ENTRIES, codebooks.ROUNDS))
def op11_part_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codebooks.digest(books)).alias("codebooks_sha256"))


@query()
def op12_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "top_cost")


@query(
    r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
q AS MATERIALIZED (SELECT DISTINCT k, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL)),
whole AS (SELECT CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(t)) AS BIGINT) AS length FROM d WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT i, doc_id, CAST(n AS BIGINT) AS n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT i, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY i, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) CROSS JOIN whole),
scored AS (SELECT q.k, q.item_id, tf.i, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * tf.n * documents) // length))))) AS BIGINT) AS score
  FROM q JOIN tf ON tf.term = q.term JOIN w ON w.term = q.term CROSS JOIN whole GROUP BY q.k, q.item_id, tf.i, tf.doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""
)
def op13_windowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
