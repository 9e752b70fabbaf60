"""Supervised subword embeddings as a quality classifier.

A document is the average of learned vectors, one for each of its hashed word n-grams
(1 and 2 words) and character n-grams (3 and 4 bytes); a softmax layer on the average
gives the class probabilities. The vectors and the layer are trained by numpy stochastic
gradient descent on a bounded sample of labelled rows.

Bounds of the training sample, both parameters: ``sample_rows`` labelled ids, split over
the labels (a label with fewer leaves its part to the other; of each those with the smallest
id hash), and ``sample_features`` distinct features over them, in the order of that hash. The
score is then moved to the labels' shares among all learnable ids. Labels serve only where crc32 of the id's text modulo ``folds`` is not 0. Scoring reads
every whole text: as the layer is linear in the average, each feature's score is folded
into one number beforehand, which changes nothing in the result.

Texts are cut into pieces of about a megabyte at white space, so a very long text needs
bounded memory; n-grams don't cross such a cut. Odd cases: null and empty text get the
score of the layer's bias alone; an id labelled twice counts with its higher label; without labelled
rows, or with one class only, every score is the (smoothed) share of that class; rows
with equal ids are scored each; empty tables give no rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import (NOT_SPACE, learnable, mix, random_words, read_columns, staged,
                                  text_slices, word_bounds, word_hashes)
from basketlab.llm.op10_langid import sampled_ids

BUCKETS = 1 << 17
PIECE = 1 << 20


def pieces(data: np.ndarray, size: int = PIECE):
    """The text in pieces cut at white space, or hard where there is none."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            space = np.flatnonzero(~NOT_SPACE[data[at:end]])
            if len(space) and space[-1]:
                end = at + int(space[-1])
        yield data[at:end]
        at = end


def feature_ids(data: np.ndarray) -> np.ndarray:
    """Bucket of every word n-gram and character n-gram of one piece."""
    salt = random_words(5, 4)
    words = word_hashes(data, *word_bounds(data, NOT_SPACE))
    out = [words ^ salt[0], mix(words[:-1] * salt[1] + words[1:])] if len(words) else []
    wide = data.astype(np.uint64)
    for n in (3, 4):
        if len(data) >= n:
            gram = wide[:len(data) - n + 1].copy()
            for i in range(1, n):
                gram |= wide[i:len(data) - n + 1 + i] << np.uint64(8 * i)
            out.append(mix(gram * salt[2] + np.uint64(n)))
    if not out:
        return np.empty(0, np.int64)
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64)


def feature_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for piece in pieces(data):
        total += np.bincount(feature_ids(piece), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  folds: int, sample_rows: int, sample_features: int):
    """[(ids, counts, label)] of the bounded sample, in a fixed order; and the number of
    learnable ids of each label."""
    known = staged(labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y"))
                   .where(F.col("k").isNotNull() & F.col("y").isNotNull() & learnable("k", folds, 0))
                   .groupBy("k").agg(F.max("y").alias("y")), "labels")
    all_of = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, chosen = sampled_ids(known.select(F.col("y").cast("string").alias("lang"), "k"), sample_rows)
    chosen = chosen.select("k", F.col("lang").cast("int").alias("y"))

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for k, y, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                  text_slices(batch.column(2))):
                ids, n = feature_counts(data if data is not None else np.empty(0, np.uint8))
                rows.append({"k": str(k), "y": y, "ids": ids.astype("<i4").tobytes(),
                             "n": n.astype("<i4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("k", pa.string()), ("y", pa.int32()), ("ids", pa.binary()), ("n", pa.binary())]))

    sample = (docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
              .join(F.broadcast(chosen), "k").select("k", "y", "text")
              .mapInArrow(count, "k string, y int, ids binary, n binary")
              .orderBy(F.xxhash64("k"), "k", "ids", "n"))
    # two growing buffers, not thousands of small arrays: the driver gives them back whole
    ids, counts, ends, labels_of = bytearray(), bytearray(), [0], []
    for r in sample.toLocalIterator():
        if labels_of and len(ids) + len(r["ids"]) > 4 * sample_features:
            break
        ids += r["ids"]
        counts += r["n"]
        ends.append(len(ids) // 4)
        labels_of.append(r["y"])
    ids, counts = np.frombuffer(ids, "<i4"), np.frombuffer(counts, "<i4")
    return [(ids[a:b], counts[a:b], y) for a, b, y in zip(ends, ends[1:], labels_of)], all_of


def train(rows, classes: int = 2, dim: int = 12, epochs: int = 6, rate: float = 4.0,
          seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the buckets, layer weights and bias, by stochastic gradient descent
    with a linearly falling rate (the gradient of the mean cross-entropy)."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = np.zeros((classes, dim), np.float32), np.zeros(classes, np.float32)
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            ids, counts, y = rows[j]
            share = (counts / max(1, counts.sum())).astype(np.float32)
            now = rate * (1 - step / steps)
            step += 1
            mean = share @ vectors[ids]
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= now * np.outer(p, mean)
            bias -= 0.02 * now * p
            # shares are small numbers: the vectors take a step of their own scale
            vectors[ids] -= (now * 8) * share[:, None] * back[None, :]
    return vectors, layer, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", folds: int = 5, sample_rows: int = 4000,
        sample_features: int = 12_000_000) -> tuple[np.ndarray, float]:
    """(score of each bucket, bias) of the two-class model: label 1 against label 0."""
    rows, all_of = training_rows(docs, labels, id_col, text_col, label_col, folds, sample_rows, sample_features)
    rows = [(ids, counts, int(y == 1)) for ids, counts, y in rows]
    ones = sum(y for *_, y in rows)
    if ones in (0, len(rows)):
        return np.zeros(BUCKETS, np.float32), float(np.log((ones + 1) / (len(rows) - ones + 1)))
    vectors, layer, bias = train(rows)
    # the sample has the labels in other shares than all learnable rows
    all_ones = all_of[1]
    shift = np.log(all_ones / (sum(all_of.values()) - all_ones)) - np.log(ones / (len(rows) - ones))
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0] + shift)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text",
          out: str = "score") -> DataFrame:
    """The frame with the probability of label 1 added (a column of that name is
    replaced); one pass, no shuffle."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        weights, bias = shared.value
        for batch in batches:
            p = np.empty(len(batch))
            for i, data in enumerate(text_slices(batch.column(text_col))):
                total, n = 0.0, 0
                for piece in pieces(data if data is not None else np.empty(0, np.uint8)):
                    ids = feature_ids(piece)
                    total += float(weights[ids].sum(dtype=np.float64))
                    n += len(ids)
                p[i] = 1 / (1 + np.exp(-np.clip(bias + total / max(n, 1), -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)],
                                             [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{out}` double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the rows outside the held-out fold."""
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, read_columns(spark, sf_dir, "labels", "doc_id", "quality"))
    return score(docs, model).select(
        "doc_id", F.coalesce(~learnable("doc_id", 5, 0), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))
