"""Fill-in-the-middle transformation by a learned rank index.

A text is cut into tokens (a run of ASCII letters, or one other character). All token
boundaries are held as a piecewise-linear index from rank to character offset: a segment
grows while one line through its first boundary stays within ``EPSILON`` of all its
boundaries (the cone of possible slopes is narrowed boundary by boundary), and each
boundary keeps its residual, one byte. A cut at a rank is predicted on its segment's line
and corrected by the stored residual, which gives the exact offset. Lines are evaluated in
fixed-point integers, so prediction and residual agree everywhere. Long texts are indexed
piece by piece; the index takes about a byte a token.

Where the cuts lie, and the form, follow from a hash of the document's id and the seed, so
reruns agree.

Odd cases: a null text is an empty one; empty texts, and texts that hold a mark already, stay
plain; a null id is hashed as the empty string; rows with equal ids and texts get equal
cuts; one result row per input row; an empty table gives no rows. One pass, no shuffle.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns

EPSILON = 100
SHIFT = 20
PIECE = 1 << 20
# the first window in which a segment's slopes are narrowed; doubled while it holds
WINDOW = 256


def segments(offsets: np.ndarray):
    """(first, end, fixed-point slope) of maximal runs that one line through the first
    boundary meets within EPSILON."""
    first, total = 0, len(offsets)
    while first < total:
        low, high, at, width, end = 0.0, np.inf, first + 1, WINDOW, total
        while at < total:
            to = min(at + width, total)
            run = np.arange(at - first, to - first)
            rise = offsets[at:to] - offsets[first]
            lows = np.maximum(np.maximum.accumulate((rise - EPSILON) / run), low)
            highs = np.minimum(np.minimum.accumulate((rise + EPSILON) / run), high)
            over = lows > highs
            if over.any():
                stop = int(over.argmax())
                if stop:
                    low, high = lows[stop - 1], highs[stop - 1]
                end = at + stop
                break
            low, high, at, width = lows[-1], highs[-1], to, width * 2
        slope = 0 if high == np.inf else int(round((low + high) / 2 * (1 << SHIFT)))
        yield first, end, slope
        first = end


class RankIndex:
    """Token boundaries of one text, by rank."""

    def __init__(self, text: str):
        self.firsts, self.starts, self.slopes, self.residuals = [], [], [], []
        self.size, inside = 0, False
        for at in range(0, len(text), PIECE):
            codes = np.frombuffer(text[at:at + PIECE].encode("utf-32-le"), np.uint32)
            letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
            starts = ~letter
            starts[1:] |= ~letter[:-1]
            starts[0] |= not inside
            inside = bool(letter[-1])
            self._add(np.flatnonzero(starts) + at)
        self.tokens = self.size
        self._add(np.array([len(text)]))

    def _add(self, offsets: np.ndarray) -> None:
        for first, end, slope in segments(offsets):
            self.firsts.append(self.size + first)
            self.starts.append(int(offsets[first]))
            self.slopes.append(slope)
            line = offsets[first] + ((slope * np.arange(end - first, dtype=np.int64)) >> SHIFT)
            self.residuals.append((offsets[first:end] - line).astype(np.int8))
        self.size += len(offsets)

    def predicted(self, rank: int) -> tuple[int, int]:
        """The line's offset at a rank, and the residual stored there."""
        s = bisect_right(self.firsts, rank) - 1
        k = rank - self.firsts[s]
        return self.starts[s] + ((self.slopes[s] * k) >> SHIFT), int(self.residuals[s][k])

    def offset(self, rank: int) -> int:
        """Where token ``rank`` starts; the text's length for the number of tokens."""
        guess, residual = self.predicted(rank)
        return guess + residual


def transform(text: str, key: str, seed: int, plain_above: int, spm_below: int,
              marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, characters of prefix and middle (null if plain), output."""
    index = RankIndex(text)
    n = index.tokens
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in marks) or h3 % 100 >= plain_above:
        return n, "plain", None, None, text
    a, b = sorted(index.offset(x % (n + 1)) for x in (h1, h2))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
                   plain_above: int = 90, spm_below: int = 20,
                   marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output: one row per row of docs. Of 100
    texts, ``plain_above`` are rearranged, and of 100 of these ``spm_below`` start with the
    suffix. No mark may hold another's first character past its own first one."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            out = [transform(t or "", "" if k is None else k, seed, plain_above, spm_below, marks)
                   for k, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            n, form, prefix, middle, text = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                 pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(text, pa.string())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    key = F.col(id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(key.alias("id"), key.cast("string").alias("key"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output, form, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> F.Column:
    """The text that an output of that form was made from: the marks stand in it once each."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its form, with digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
             CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
             CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[:a], ''), '') AS p,
             coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
