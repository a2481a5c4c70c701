"""Exact deduplication with stateful streaming.

Documents pass as a stream of (digest, id, locator).  A streaming aggregation
keyed by digest keeps, in a RocksDB state store on disk and without expiry, the
digest, the stable identifier of the document that stays (the largest id), that
document's content locator, and the number of documents seen.  The state and its
changelog are in the shared checkpoint folder, so a query resumes after a loss
and later files are judged against all earlier ones.

A digest seen before is a hit.  The locator says where the content of the
document that stays is read again, and the full bytes of all hits are compared
with it; a digest with unlike texts is regrouped by whole texts.  Only hits'
texts are moved.

The main path is DataFrame operations and the JVM's state store only.  Texts of
hits are combined to unlike ones before they are shuffled, and digests that many
rows share meet their state by broadcast (``skew``), so a third of all rows in
one group loads no single task.

Defined cases: null texts count as empty and are equal to each other; texts are
equal when identical after lower-casing A-Z; rows are judged each by itself, so
rows that repeat an id may be in different groups, and all rows of a group with
its kept id are kept; a null id is never the kept one unless the group has no
other, then ``keep_id`` is null and the rows are kept; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import KEY, LOCATOR, keyed, without
from .scratch import fresh_path, materialize
from .skew import join_totals

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most this many hits are joined by broadcast; more are shuffled.
BROADCAST_ROWS = 300_000
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
}


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest=sha256_digest) -> DataFrame:
    """(key, doc_id, digest, locator); the locator is the row's place: its file
    and row number, or its key where the source has no files."""
    text = lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return keyed(docs, locator=True).select(KEY, F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest"), F.col(LOCATOR).alias("locator"))


def run_stream(stream: DataFrame, checkpoint: str, output: str) -> None:
    """Fold all that a stream of fingerprints has into the keyed state.

    Changed keys of each micro-batch go to a folder of ``output`` named by the
    batch, which a repeated batch overwrites.
    """
    best = F.max(F.struct("doc_id", "locator"))
    state = stream.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.select("digest", "best.*", "n").write.mode("overwrite").parquet(f"{output}/batch={number}")

    with _settings(stream.sparkSession, _STATE):
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()


def keyed_state(spark: SparkSession, output: str) -> DataFrame:
    """The latest state of each digest: both values only grow."""
    rows = spark.read.schema("digest string, doc_id long, locator string, n long, batch int").parquet(output)
    best = F.max(F.struct("n", "doc_id", "locator"))
    return rows.groupBy("digest").agg(best.alias("s")).select("digest", F.col("s.doc_id").alias("keep_id"), F.col("s.locator").alias("keep_locator"), F.col("s.n").alias("group_size"))


def _judged(docs: DataFrame, text_col: str, id_col: str, digest) -> DataFrame:
    """Per row of the keyed ``docs``: what its group keeps."""
    spark = docs.sparkSession
    prints = materialize(fingerprints(docs, text_col, id_col, digest), "fingerprints")
    base = fresh_path(spark, "exact-dedup")
    if prints.isEmpty():
        return prints.withColumns({"keep_id": F.lit(None).cast("long"), "keep_locator": F.lit(None).cast("string"), "group_size": F.lit(0).cast("long")})
    run_stream(spark.readStream.schema(prints.schema).parquet(prints._scratch_path), f"{base}/checkpoint", f"{base}/state")
    state = materialize(keyed_state(spark, f"{base}/state"), "state")
    judged = join_totals(prints, state, ["digest"], "group_size")
    hits = materialize(judged.where("group_size > 1").select(KEY, "doc_id", "digest", "locator", "keep_locator"), "hits")
    variants, unlike = _unlike_digests(docs, hits, text_col)
    if unlike.isEmpty():
        return judged
    again = _bytes_of(docs, hits.join(unlike, "digest", "left_semi"), text_col).join(variants, ["digest", "bytes"])
    again = again.select(KEY, "doc_id", "digest", "locator", F.col("best.doc_id").alias("keep_id"), F.col("best.locator").alias("keep_locator"), "group_size")
    return judged.join(unlike, "digest", "left_anti").unionByName(again)


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", digest=sha256_digest) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, keep_locator."""
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    judged = _judged(keyed(docs, locator=True), text_col, id_col, digest)
    return judged.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"), "keep_locator")


def _bytes_of(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` of the keyed ``docs`` with their normalised text as ``bytes``."""
    few = rows.count() <= BROADCAST_ROWS
    text = lower_ascii(F.coalesce(F.col("_raw").cast("string"), F.lit("")))
    return docs.select(KEY, F.col(text_col).alias("_raw")).join(F.broadcast(rows) if few else rows, KEY).select(*rows.columns, text.alias("bytes"))


def _unlike_digests(docs: DataFrame, hits: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of each hit digest with their groups, and the digests
    of which some text is not the one at the kept document's locator."""
    best = F.max(F.struct("doc_id", "locator"))
    texts = _bytes_of(docs, hits, text_col).groupBy("digest", "bytes").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    variants = materialize(texts, "variants")
    stays = _bytes_of(docs, hits.where("locator = keep_locator").select(KEY, "digest"), text_col).select("digest", F.col("bytes").alias("kept_bytes"))
    return variants, materialize(variants.join(stays, "digest").where("bytes <> kept_bytes").select("digest").distinct(), "unlike")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns: of equal texts one, that with
    the largest id; one without an id only where no copy has one."""
    docs = keyed(docs)
    return without(docs, _judged(docs, text_col, id_col, sha256_digest).where("locator <> keep_locator"))
