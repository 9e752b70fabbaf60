"""Binned feature rows for the tree models.

Numeric columns become bin numbers (at most 256 bins each: between all values where there
are few, between quantiles otherwise), every value of a categorical column becomes a
feature of two bins (an unseen value is 0 in all of them). A row's bins are one byte each
in one binary column, so that a table of any size is read as plain byte matrices.
Missing numbers count as 0, as everywhere in the model input.
"""
from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 256
# a column with at most so many values has a cut between any two of them
FEW_VALUES = 200


def number(c: str) -> F.Column:
    """The column as a double; null and NaN are 0."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))


class FeatureSpace:
    """Names, cuts and categories of the model's features, in vector order: a number x has
    bin b where b cuts are below it, so it is <= cut[b] exactly if its bin is <= b."""

    def __init__(self, numeric: list[str], cuts: list[np.ndarray], categorical: list[tuple[str, list[str]]]):
        self.numeric, self.cuts, self.categorical = numeric, cuts, categorical

    @property
    def names(self) -> list[str]:
        return list(self.numeric) + [f"{c}_{v}" for c, values in self.categorical for v in values]

    def without(self, left_out) -> FeatureSpace:
        """The same space without some numeric features."""
        kept = [i for i, c in enumerate(self.numeric) if c not in left_out]
        return FeatureSpace([self.numeric[i] for i in kept], [self.cuts[i] for i in kept], self.categorical)

    @property
    def widths(self) -> np.ndarray:
        """Number of bins of each feature."""
        return np.array([len(c) + 1 for c in self.cuts] + [2] * (len(self.names) - len(self.cuts)))

    def bins(self, numbers: list[np.ndarray], texts: list[list]) -> np.ndarray:
        """Rows x features, one byte each."""
        n = len(numbers[0]) if numbers else len(texts[0])
        out = np.zeros((n, len(self.names)), np.uint8)
        for j, (cut, x) in enumerate(zip(self.cuts, numbers)):
            out[:, j] = np.searchsorted(cut, x, side="left")
        j = len(self.cuts)
        for (_, values), column in zip(self.categorical, texts):
            place = {v: j + i for i, v in enumerate(values)}
            at = np.array([place.get(v, -1) for v in column], np.int64)
            seen = np.flatnonzero(at >= 0)
            out[seen, at[seen]] = 1
            j += len(values)
        return out

    def to_json(self) -> str:
        return json.dumps({"numeric": self.numeric, "cuts": [c.tolist() for c in self.cuts],
                           "categorical": self.categorical})

    @staticmethod
    def from_json(text: str) -> FeatureSpace:
        d = json.loads(text)
        return FeatureSpace(d["numeric"], [np.array(c, np.float64) for c in d["cuts"]],
                            [(c, v) for c, v in d["categorical"]])


def fit_space(train: DataFrame, numeric: list[str], categorical: list[str]) -> FeatureSpace:
    """Cuts and categories from two aggregates over the training rows."""
    first = train.agg(
        *[F.approx_count_distinct(number(c)).alias(f"n{i}") for i, c in enumerate(numeric)],
        *[F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(categorical)]).first()
    # sketches of a fixed size: all values where they are few, quantiles that occur otherwise
    steps = F.array(*[F.lit(k / MAX_BINS) for k in range(1, MAX_BINS)])
    few = [first[f"n{i}"] <= FEW_VALUES for i in range(len(numeric))]
    values = train.agg(*[
        F.sort_array(F.collect_set(number(c))).alias(f"v{i}") if few[i]
        else F.array_sort(F.array_distinct(F.percentile_approx(number(c), steps, F.lit(10_000)))).alias(f"v{i}")
        for i, c in enumerate(numeric)]).first() if numeric else ()
    cuts = []
    for i in range(len(numeric)):
        v = np.array(values[i] if values[i] is not None else [], np.float64)
        cuts.append((v[1:] + v[:-1]) / 2 if few[i] and len(v) <= MAX_BINS else v[:MAX_BINS - 1])
    return FeatureSpace(list(numeric), cuts, [(c, list(first[f"c{i}"] or [])) for i, c in enumerate(categorical)])


def binned(df: DataFrame, space: FeatureSpace, keep: list[str], out: str = "bins") -> DataFrame:
    """The columns of ``keep`` and the row's bins (binary). One pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(space)
    k, m = len(keep), len(space.numeric)

    def run(batches):
        import pyarrow as pa
        space = shared.value
        for batch in batches:
            numbers = [batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(m)]
            texts = [batch.column(k + m + i).to_pylist() for i in range(len(space.categorical))]
            rows = (space.bins(numbers, texts) if batch.num_rows and (numbers or texts)
                    else np.zeros((batch.num_rows, 0), np.uint8))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(k)), pa.array([r.tobytes() for r in rows], pa.binary())],
                [*batch.schema.names[:k], out])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(*keep, *[number(c).alias(f"n{i}") for i, c in enumerate(space.numeric)],
                     *[F.col(c).cast("string").alias(f"c{i}") for i, (c, _) in enumerate(space.categorical)]
                     ).mapInArrow(run, f"{schema}{out} binary")


def matrix(column, width: int) -> np.ndarray:
    """Rows x width bytes of an Arrow binary column of rows of that width."""
    if not len(column) or not width:
        return np.zeros((len(column), width), np.uint8)
    import pyarrow as pa
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data.reshape(len(column), width)


def chunks(batches, rows: int):
    """Arrow batches joined to tables of about that many rows."""
    import pyarrow as pa
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


# --- hashes that stand for random draws -----------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads its input (two multiply and shift rounds)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
