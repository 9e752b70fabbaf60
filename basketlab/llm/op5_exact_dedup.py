"""Exact deduplication as a stateful stream over the documents.

Every row's normalised text (each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null
counts as empty) is digested with SHA-256. A Structured Streaming aggregation keyed by
the digest keeps, in a disk-backed (RocksDB) state store without expiry, the smallest
identifier, the locator of that row's content (file and row in it) and the group's
count. The state is then read back, rows join their group by digest, and every hit is
checked on full bytes: its normalised text is compared with the content found at the
locator. Hits that fail the check (colliding digests) are regrouped by their text.

Results for the odd cases: null text is an empty text; two rows with the same id are
two rows of their group, of which the one with the smallest locator stays (``kept`` is
true for that one row only); a null id loses against any id; empty input gives no rows.
DataFrame operations only: no Python runs on the executors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import scratch_path, staged

# The stores sit on disk and are let go once a batch is committed: the state lives on in
# the shared folder, and executors keep no open store (and its files) per partition.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def locator():
    """Where a row's content is: file and row in it."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.row_index").alias("row"))


def normalised(text):
    """Each whitespace run becomes one space (only runs other than a lone space match)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")),
                            r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def digest(text):
    return F.sha2(normalised(text).cast("binary"), 256)


def digest_state(spark: SparkSession, path: str, id_col: str, text_col: str,
                 max_bytes_per_batch: int = 1 << 36) -> DataFrame:
    """Stream the Parquet table at path once through the keyed state and return the
    final state: (digest, keep struct<missing, id, file, row>, group_size)."""
    schema = spark.read.parquet(path).schema
    # as a pattern of one match, so that the stream takes a folder and a single file alike
    only = f"{path[:-1]}[{path[-1]}]"
    rows = (spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_batch)
            .parquet(only).select(
                digest(F.col(text_col)).alias("digest"),
                F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"),
                         F.col("_metadata.file_path").alias("file"),
                         F.col("_metadata.row_index").alias("row")).alias("keep")))
    groups = rows.groupBy("digest").agg(F.min("keep").alias("keep"),
                                        F.count(F.lit(1)).alias("group_size"))
    place = scratch_path(spark, "digest-state")
    before = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        (groups.writeStream.format("noop").outputMode("update")
         .option("checkpointLocation", place).trigger(availableNow=True)
         .start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.format("statestore").load(place).select(
        F.col("key.digest").alias("digest"), F.col("value.*")).toDF("digest", "keep", "group_size")


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                max_bytes_per_batch: int = 1 << 36) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    state = digest_state(spark, path, id_col, text_col, max_bytes_per_batch)
    table = spark.read.parquet(path)
    rows = table.select(F.col(id_col).alias("id"), locator().alias("at"),
                        digest(F.col(text_col)).alias("digest"))
    found = staged(rows.join(state, "digest").select(
        "id", "at", "digest", "keep", "group_size",
        F.struct("keep.file", "keep.row").alias("keep_at")), "digests")

    # full-byte check of the hits: only rows of groups of two and more meet their text
    hits = found.where("group_size > 1").select("at", "keep_at", "digest")
    texts = table.select(locator().alias("at"), F.col(text_col).alias("text"))
    with_text = staged(texts.join(hits, "at").withColumn("text", normalised(F.col("text"))), "hits")
    held = with_text.where("at = keep_at").select(
        "keep_at", F.col("text").alias("held_text"))
    wrong = staged(with_text.where("at != keep_at").join(held, "keep_at")
                   .where("text != held_text").select("at", "text", "digest"), "collisions")

    good = found.join(wrong.select("at"), "at", "left_anti")
    if wrong.isEmpty():
        return _decide(found)
    # colliding digests: those rows form groups by their text; the others lose them
    lost = wrong.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    rest = (found.select("id", "at", "group_size", "digest", "keep").join(wrong, ["at", "digest"]))
    own = rest.groupBy("digest", "text").agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "at.file", "at.row"))
        .alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = (rest.select("id", "at", "digest", "text").join(own, ["digest", "text"])
             .select("id", "at", "digest", "keep", "group_size",
                     F.struct("keep.file", "keep.row").alias("keep_at")))
    fixed = (good.join(lost, "digest", "left")
             .withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
             .drop("lost").select(again.columns))
    return _decide(fixed.unionByName(again))


def _decide(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id"), F.col("keep.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("at") == F.col("keep_at")).alias("kept"), F.col("digest").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents."""
    return (exact_dedup(spark, f"{sf_dir}/documents.parquet")
            .withColumnRenamed("id", "doc_id"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
           FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept,
       sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
