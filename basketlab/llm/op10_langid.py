"""Language identification: sparse multinomial logistic regression on TF-IDF weights of
hashed character n-grams, trained by follow-the-regularised-leader (FTRL-proximal) with
an elastic-net penalty, then calibrated by one temperature.

Features: every run of 1, 2 and 3 letters' characters of the lower-cased text (white space
runs count as one blank, other non-letters are left out), hashed into ``BUCKETS``. Term
weights are ``1 + log(count)`` times the inverse document frequency, scaled to length 1.
Document frequencies are counted over all learnable documents (language given, id
outside the held-out fold); the counts have a fixed size whatever the input. The weights
are fitted on a bounded sample, both bounds parameters: ``sample_rows`` learnable ids, split
over the languages (a language with fewer ids leaves its part to the others; one id each at
least), of each language those with the smallest id hash; and ``sample_features`` distinct
features over them, the languages taking turns. Of each language's rows the second and every
tenth after it are left for the temperature.

Odd cases: a null text, or one without a letter, is ``und`` with score 0; without any learnable row all
are ``und``; with one language all others get it with score 1; rows with equal ids are
judged each; very long texts are counted piece by piece.
"""
from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.llm.common import (histogram_rows, learnable, mix, random_words, read_columns,
                                  summed_histogram)

BUCKETS = 1 << 15
PIECE = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"(?:[^\w\s]|[\d_])+")
BLANK = re.compile(r"\s+")


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the text's character 1- to 3-grams and their counts."""
    salt = random_words(17, 4)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), PIECE):
        piece = BLANK.sub(" ", OTHER.sub("", text[at:at + PIECE].lower()))
        codes = np.frombuffer(f" {piece} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        for n in (1, 2, 3):
            if len(codes) >= n:
                gram = codes[:len(codes) - n + 1].copy()
                for i in range(1, n):
                    gram |= codes[i:len(codes) - n + 1 + i] << np.uint64(21 * i)
                ids = mix(gram * salt[n]) & np.uint64(BUCKETS - 1)
                total += np.bincount(ids.astype(np.int64), minlength=BUCKETS)
    ids = np.flatnonzero(total)
    return ids, total[ids]


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[ids]
    return w / max(float(np.sqrt(w @ w)), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the learnable rows (column text) each bucket occurs; and their number."""
    def count(batches):
        import pyarrow as pa
        total = np.zeros(BUCKETS + 64, np.int64)  # the last slice holds the number of rows
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if has_letter(text):
                    total[gram_counts(text)[0]] += 1
                    total[BUCKETS] += 1
        rows = list(histogram_rows(total))
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array([i for i, _ in rows], pa.int32()),
             "counts": pa.array([c for _, c in rows], pa.binary())})

    total = summed_histogram(docs.select("text").mapInArrow(count, "slice int, counts binary"),
                             BUCKETS + 64)
    return total[:BUCKETS], int(total[BUCKETS])


def ftrl(rows, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 2e-3, l2: float = 1e-3, seed: int = 5) -> np.ndarray:
    """FTRL-proximal on softmax regression: rows of (ids, values, class); the last
    bucket's column is the intercept. Returns sparse weights, buckets x classes."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros_like(z)

    def weights(ids):
        zi, ni = z[ids], n[ids]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for j in rng.permutation(len(rows)):
            ids, x, y = rows[j]
            w = weights(ids)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            old = n[ids]
            new = old + g * g
            z[ids] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[ids] = new
    return weights(np.arange(BUCKETS + 1))


def temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature with the least cross-entropy on the rows left out (golden section)."""
    def loss(log_t):
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), classes]))

    if not len(scores):
        return 1.0
    a, b, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """total split evenly over the languages, what one can't use going to the others; at
    least one each."""
    out, left = {}, total
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = max(min(n, left // (len(counts) - i)), 1)
        left = max(left - out[lang], 0)
    return out


def sampled_ids(known: DataFrame, sample_rows: int) -> tuple[list[str], DataFrame]:
    """The languages, and (lang, k, rank) of each language's sampled ids."""
    ids = known.select("lang", "k").distinct()
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # hashes are uniform: a bound a little above the share keeps all rows it needs and few more
    rows = [(lang, n, int(min(-2**63 + 2**64 * (n + 8 * n ** 0.5 + 50) / counts[lang], 2**63 - 1024)))
            for lang, n in shares(counts, sample_rows).items()]
    most = known.sparkSession.createDataFrame(rows, "lang string, share long, bound long")
    h = F.xxhash64("k")
    few = ids.join(F.broadcast(most), "lang").where((F.col("bound") >= 2**63 - 1024) | (h <= F.col("bound")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "k"))
    return sorted(counts), few.withColumn("rank", rank).where("rank <= share").select("lang", "k", "rank")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        folds: int = 4, held: int = 2, sample_rows: int = 5000,
        sample_features: int = 8_000_000) -> dict | None:
    """The model: languages, idf, weights and temperature; None without learnable rows."""
    known = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()
                       & learnable(id_col, folds, held)).select(
        F.col(id_col).alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    freq, total = document_frequencies(known)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + freq)) + 1

    langs, chosen = sampled_ids(known, sample_rows)

    def count(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for rank, k, text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                if has_letter(text):
                    ids, n = gram_counts(text)
                    rows.append({"rank": rank, "k": str(k), "lang": lang, "ids": ids.astype("<i4").tobytes(),
                                 "n": n.astype("<i4").tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("rank", pa.int32()), ("k", pa.string()), ("lang", pa.string()), ("ids", pa.binary()), ("n", pa.binary())]))

    sample = (known.join(F.broadcast(chosen), ["lang", "k"]).select("rank", "k", "text", "lang")
              .mapInArrow(count, "rank int, k string, lang string, ids binary, n binary")
              .orderBy("rank", "lang", "k", "ids", "n"))
    place = {lang: i for i, lang in enumerate(langs)}
    kept, left, seen, size = [], [], [0] * len(langs), 0
    for r in sample.toLocalIterator():
        ids = np.frombuffer(r["ids"], "<i4")
        size += len(ids)
        if kept and size > sample_features:
            break
        x = weighted(ids, np.frombuffer(r["n"], "<i4"), idf)
        y = place[r["lang"]]
        (left if seen[y] % 10 == 1 else kept).append(
            (np.append(ids, np.int32(BUCKETS)), np.append(x, 1.0), y))
        seen[y] += 1
    weights = ftrl(kept, len(langs))
    scores = np.array([x @ weights[ids] for ids, x, _ in left])
    return {"langs": langs, "idf": idf, "weights": weights,
            "temperature": temperature(scores, np.array([y for *_, y in left]))}


def predict(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The frame with lang_pred and score added (columns of these names are replaced);
    one pass, no shuffle."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_col).to_pylist():
                if m is None or not has_letter(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                ids, n = gram_counts(text)
                w = m["weights"]
                s = (weighted(ids, n, m["idf"]) @ w[ids] + w[BUCKETS]) / m["temperature"]
                p = np.exp(s - s.max())
                best = int(p.argmax())
                langs.append(m["langs"][best])
                scores.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out fold."""
    model = fit(read_columns(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return predict(read_columns(spark, sf_dir, "documents", "doc_id", "text"), model).select(
        "doc_id", F.coalesce(~learnable("doc_id", 4, 2), F.lit(False)).alias("held_out"),
        "lang_pred", "score")
