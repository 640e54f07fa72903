"""The dealt operators bound to the given tables, over whole tables and whole texts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structpeak.llm import alignment, boilerplate, byte_pairs, fuzzy_lines, hyperminhash, language, packing, pieces, quality, resampling, stream_dedup, suffixes, warc

QUERIES: dict = {}
ORACLES: dict = {}
TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id"):
    """True for the quarter of documents that no model learns from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", "quality")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with a quality label that models may learn from, joined by sorting at every size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(~held_out())
    return docs.join(_learnable(spark, sf_dir).hint("merge"), "doc_id").select("text", "quality")


def labelled_sample(spark: SparkSession, sf_dir: str, rows: int = boilerplate.FIT_DOCUMENTS) -> DataFrame:
    """Texts of at most ``rows`` labelled ids a class, drawn by hash from the labels alone; only these ids meet the texts."""
    cell = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(rows))
    drawn = _learnable(spark, sf_dir).groupBy("quality", cell.alias("cell")).agg(F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(drawn), "doc_id").select("text", "quality")  # two classes of `rows` ids at most


@query("op1_best_two_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), summarise=lambda ids: [F.crc32(ids).alias("ids_crc32")])
    return packing.pack(pieces)


@query("op2_naive_bayes_support_vectors")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(labelled(spark, sf_dir))
    scored = quality.predict(table(spark, sf_dir, "documents"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_random_field_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~held_out()).select("text", "lang"))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op6_forced_boundary_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_pairs.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op8_boilerplate_field")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = boilerplate.train(labelled_sample(spark, sf_dir))
    return boilerplate.judge(table(spark, sf_dir, "documents"), chain)


@query("op9_hyperminhash_near_duplicates")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents")).drop("lead", "r1", "r2")


@query("op7_fuzzy_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.line_components(table(spark, sf_dir, "documents")).drop("r1", "r2", "copy")


@query("op3_suffix_sort_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""


@query("op5_stateful_stream_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


@query("op10_warc_derivatives")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return out.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "content_type", F.octet_length("block").cast("long").alias("content_length"),
        "block_digest", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"), "source_payload_digest", "source_block_digest", "source_content_type",
    )


@query("op11_galloping_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


@query("op12_distinct_chunk_pieces")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


#: crc32 is spelled out from its polynomial, over the bytes of every distinct word.
OP13_SQL = r"""
WITH bits AS (SELECT n, n::UINTEGER AS c FROM range(256) t(n)),
steps AS (SELECT n, list_reduce(range(8)::UINTEGER[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, c) AS c FROM bits),
crc AS (SELECT list(c ORDER BY n) AS of FROM steps),
source AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
s AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM source) GROUP BY word),
t AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM goal) GROUP BY word),
seen AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM s UNION SELECT word FROM t)),
hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(strlen(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::UINTEGER),
                               lambda c, b: xor(c >> 8, of[(xor(c, b) & 255) + 1]), 4294967295::UINTEGER), 4294967295::UINTEGER) % 10000 AS bucket
  FROM seen, crc),
buckets AS (SELECT bucket, coalesce(sum(s.n), 0)::DOUBLE AS s, coalesce(sum(t.n), 0)::DOUBLE AS t FROM hashed LEFT JOIN s USING (word) LEFT JOIN t USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM buckets),
gain AS (SELECT bucket, floor(1000 * ln((b.t + 1) * (a.s + 10000) / ((b.s + 1) * (a.t + 10000))))::BIGINT AS gain FROM buckets b, totals a),
weight AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM (SELECT doc_id, unnest(words) AS word FROM source) JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weight USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op13_radix_resampling", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
