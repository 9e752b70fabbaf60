"""Helpers the operators of this folder share: tables, lineage cuts, text buffers."""
from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.session import ensure_checkpoint_dir


def read_columns(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one input table (nothing else reaches the scan)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, removed when the session ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the frame to the shared folder and read it back. The
    shuffle files of the write are let go at once, as nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def learnable(doc_id: str, modulus: int, held: int):
    """True where crc32 of the id's decimal text leaves another remainder than held."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus != held


# --- text buffers inside Arrow tasks -----------------------------------------

# [^\x20\x09-\x0D]: bytes of a whitespace-delimited word (UTF-8 bytes >= 0x80 included).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z: digits, letters, non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_slices(column):
    """UTF-8 bytes of each value of an Arrow string column as uint8 views; null: None."""
    import pyarrow as pa
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield data[offsets[i]:offsets[i + 1]] if valid[i] else None


def word_bounds(data: np.ndarray, member: np.ndarray):
    """Start and end byte offsets of the maximal runs of member bytes."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = member[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element (a bijection of 64-bit words)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


WORD_TABLE = random_words(11, 256)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash of the bytes of each word [start, end)."""
    if not len(starts):
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    # sum of table[byte] * base^(distance to the word's start), modulo 2^64
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    where = np.arange(total) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), base, np.uint64))
    values = WORD_TABLE[data[where + np.repeat(starts, lengths)]] * powers[where]
    return mix(np.add.reduceat(values, first) ^ lengths.astype(np.uint64))


# --- corpus-wide histograms of fixed size -------------------------------------

SLICES = 64


def histogram_rows(counts: np.ndarray):
    """One task's histogram as (slice, little-endian int64 counts) rows."""
    for i, part in enumerate(np.array_split(counts.astype("<i8"), SLICES)):
        if part.any():
            yield i, part.tobytes()


def summed_histogram(rows: DataFrame, size: int) -> np.ndarray:
    """Add up histogram_rows of all tasks slice by slice; the driver gets the one
    total, whose size is the constant the caller chose, whatever the input."""
    def add(key, table):
        import pyarrow as pa
        blobs = table.column("counts").to_pylist()
        total = np.frombuffer(blobs[0], "<i8").copy()
        for blob in blobs[1:]:
            total += np.frombuffer(blob, "<i8")
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()),
                         "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size, np.int64)
    parts = np.array_split(out, SLICES)
    # a first sum over (slice, a share of the tasks) keeps each group small
    salted = (rows.withColumn("salt", F.spark_partition_id() % 64).groupBy("slice", "salt")
              .applyInArrow(add, "slice int, counts binary")
              .groupBy("slice").applyInArrow(add, "slice int, counts binary"))
    for r in salted.collect():
        parts[r["slice"]] += np.frombuffer(r["counts"], "<i8")
    return out
