"""Exact deduplication of a stream, by keyed state on disk.

Documents arrive as a Structured Streaming source. State is kept in RocksDB for every distinct
normalised text (A-Z lower-cased, null as empty), keyed by its SHA-256 digest, without watermark or
expiry: the stable identifier that stays (largest key), how many rows had the text, and a content
locator (the key of the row whose bytes stand for it). Rows of a batch are aggregated before they
are dealt to the state, so a text that most rows share costs one row a task. A hit is checked on
full bytes: every row whose digest was seen is compared with the text its locator names.
Rows that differ from it in spite of the digest are grouped by their own bytes instead.

The checkpoint folder carries offsets and state: a stopped stream goes on where it was, and later files
only add. Each batch writes the changed state rows under its number, so a batch that runs again
overwrites its own output. Keys may repeat or be null, as in SQL: every row gives one row, the largest key
stays, ``kept`` is null where a key is, and a group of null keys alone has a null ``keep_id``. An empty source gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structpeak.llm.storage import saved, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), UPPER, LOWER)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, stream: DataFrame, folder: str, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """Runs ``stream`` until its source is drained; returns ``digest, keep_id, group_size``, one row a digest.

    ``folder`` holds the checkpoint and the changed rows of each batch; the same folder resumes.
    """
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    state = stream.groupBy(digest(normalised(text)).alias("digest")).agg(F.max(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    kind = state.schema

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        job = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _batches(spark, folder):
        return spark.createDataFrame([], kind)
    changes = spark.read.schema(kind).parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))  # both only grow


def _batches(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text`` and two hashes that name equal rows, whatever the key."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(key, body).alias("k1"), F.hash(body, key).alias("k2"), F.col(key).alias("key"), F.col(text).alias("text"))


def resolve(docs: DataFrame, state: DataFrame, key: str = "doc_id", text: str = "text", digest=sha256) -> DataFrame:
    """``key, keep_id, group_size, kept, text_sha256`` for every row of ``docs`` that ``state`` has seen; hits are checked on full bytes."""
    rows = _named(docs, key, text)
    body = rows.select("k1", "k2", "key", normalised("text").alias("body"))
    named = saved(body.select("k1", "k2", "key", digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("text_sha256")), "digests")
    known = saved(named.join(state, "digest"), "decisions")
    single = known.where("group_size = 1").select("key", "keep_id", "group_size", "text_sha256")
    hit = known.where("group_size > 1").select("k1", "k2", "digest", "keep_id", "text_sha256").dropDuplicates(["k1", "k2"])  # equal rows once
    texts = rows.join(hit, ["k1", "k2"])  # the texts are dealt out once
    hits = saved(texts.select("key", "digest", "keep_id", "text_sha256", normalised("text").alias("body")), "hits")
    # several rows may carry the key that stays; any one of them gives the bytes the others are compared with
    located = hits.where(F.col("key").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("standing"))
    checked = hits.join(located, "digest").select("key", "digest", "text_sha256", F.when(F.col("body") != F.col("standing"), F.col("body")).alias("other"))
    checked = saved(checked, "checked")
    own = checked.groupBy("digest", "other").agg(F.max("key").alias("own_id"), F.count(F.lit(1)).alias("own_size"))
    whole = checked.alias("c").join(own.alias("o"), (F.col("c.digest") == F.col("o.digest")) & F.col("c.other").eqNullSafe(F.col("o.other")))
    many = whole.select("key", F.col("own_id").alias("keep_id"), F.col("own_size").alias("group_size"), "text_sha256")
    out = single.unionByName(many)
    return out.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("key") == F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text", bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Streams the Parquet table at ``path`` through the state and returns the decision for every row."""
    docs = spark.read.parquet(path)
    glob = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the path may be one file or a folder of files
    source = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(glob)
    state = stream_state(spark, source, shared_folder(spark, "stream"), key, text)
    return resolve(docs, state, key, text)
