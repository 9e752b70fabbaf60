"""Vector code compression: product-quantised vectors whose nearest entries are found by
Orchard search.

Components become integers, ``floor(scale * x)``; a vector is cut into equal consecutive
parts (where the length isn't a multiple, the first parts are one longer). Each part
position has a codebook, seeded by that part of the vectors with the smallest ids and
refined in rounds: one scan a round assigns all parts and adds up components per entry in
its task; Spark sums those rows, and the driver gets one row per component of a codebook
(parts x entries x part length, a constant).

The nearest entry is found with a distance-sorted neighbour list for every entry: a query
walks the list of its best entry so far, marks what it visits, jumps to the list of an
entry that is nearer (or as near with a lower index), and stops beyond twice its current
distance, where by the triangle inequality no entry can be as near. All queries of a batch
take their steps together in numpy. Distances are exact integers; numbers too large for 64
bits are computed with Python's.

Odd cases: rows whose vector is null or holds null, a non-finite number or one beyond the
range of a 32-bit float go; the vectors' length is that of the one with the smallest id (of
ids with several vectors, the smallest vector), others have null codes and errors and no
part in the codebooks; with fewer ids than entries the codebooks are smaller; a null id
seeds nothing; without any id all codes are null; repeated rows count each; errors beyond
a long are null; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns, staged

FLOAT_MAX = float(np.finfo(np.float32).max)
LOW_BITS = 62
# label totals are broadcast up to this many rows (about 2 MB), joined by a shuffle beyond
BROADCAST_ROWS = 100_000


def usable(vector) -> F.Column:
    """True where the vector and all its components are there, finite and in range."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > FLOAT_MAX))
    return vector.isNotNull() & ~bad


def integers(column, length: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors of that length, and the rows they stand in."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == length)
    flat = column.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * scale)
    if len(whole) and np.abs(whole).max() >= 2.0**24:
        whole = np.array([math.floor(v) for v in whole.tolist()], dtype=object)
    else:
        whole = whole.astype(np.int64)
    return whole.reshape(len(rows), length), rows


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    ends = np.cumsum([len(p) for p in np.array_split(np.arange(length), parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the others by distance, and these (squared) distances."""
    apart = np.stack([squared(book, e) for e in book])
    own = apart.copy()
    np.fill_diagonal(own, -1)
    order = np.argsort(own, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(apart, order, axis=1)


def orchard(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x its nearest entry (lowest index on ties), the squared distance,
    and how many distances were computed."""
    near, apart = neighbour_lists(book)
    n, k = len(x), len(book)
    best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    dist = squared(x, book[0])
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    live, measured = (np.arange(n) if k > 1 else np.empty(0, np.int64)), n
    while len(live):
        # the list's next entry, unless it lies beyond twice the current distance
        live = live[(apart[best[live], at[live]] <= 4 * dist[live]).astype(bool)]
        entry = near[best[live], at[live]]
        at[live] += 1
        new = ~seen[live, entry]
        rows, entry = live[new], entry[new]
        seen[rows, entry] = True
        measured += len(rows)
        d = squared(x[rows], book[entry])
        better = ((d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))).astype(bool)
        rows = rows[better]
        best[rows], dist[rows], at[rows] = entry[better], d[better], 0
        live = live[at[live] < k - 1]
    return best, dist, measured


def seeds(vectors: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the smallest ids, each id once, of the first one's length."""
    known = vectors.where("id is not null")
    length, found, last = None, {}, None
    while len(found) < entries:
        left = known if last is None else known.where(F.col("id") > F.lit(last))
        if length is not None:
            left = left.where(F.size("vector") == length)
        rows = left.select("id").orderBy("id").limit(entries).collect()
        if not rows:
            break
        ids = sorted({r["id"] for r in rows})
        least = (left.where(F.col("id").isin(ids)).groupBy("id")
                 .agg(F.min(F.struct(F.size("vector"), "vector")).alias("v")).orderBy("id").collect())
        length = len(least[0]["v"]["vector"]) if length is None else length
        found |= {r["id"]: r["v"]["vector"] for r in least if len(r["v"]["vector"]) == length}
        last = ids[-1]
    return [found[i] for i in sorted(found)[:entries]]


def dtype_of(*arrays) -> type:
    """int64 while 4 times a squared distance fits in it, else Python's integers."""
    top = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    width = max(a.shape[-1] for a in arrays)
    return np.int64 if 16 * top * top * max(width, 1) < 2**62 else object


def assign(x: np.ndarray, books: list[np.ndarray], bounds):
    """Per part: its position, the rows' parts, nearest entries and squared distances."""
    for p, (a, b) in enumerate(bounds):
        kind = dtype_of(x[:, a:b], books[p])
        part = x[:, a:b].astype(kind)
        best, dist, _ = orchard(part, books[p].astype(kind))
        yield p, part, best, dist


def entry_sums(vectors: DataFrame, books: list[np.ndarray], bounds, length: int, scale: int) -> dict:
    """(part, entry, place) -> (count, sum) over all vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        import pyarrow as pa
        books = shared.value
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x, rows = integers(batch.column(0), length, scale)
            if not len(rows):
                continue
            for p, part, best, _ in assign(x, books, bounds):
                counts[p] += np.bincount(best, minlength=len(books[p]))
                for e in np.unique(best):
                    sums[p][e] += part[best == e].sum(axis=0).astype(object)
        out = [(p, e, i, int(counts[p][e]), int(v) & ((1 << LOW_BITS) - 1), int(v) >> LOW_BITS)
               for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()
               for i, v in enumerate(sums[p][e])]
        big = pa.decimal128(38, 0)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), big, big]
        cols = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         ["part", "entry", "place", "n", "low", "high"])

    # sums stay exact: a low word of 62 bits and the rest, both as decimals
    rows = vectors.select("vector").mapInArrow(
        add, "part int, entry int, place int, n long, low decimal(38,0), high decimal(38,0)")
    total = rows.groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    return {(r["part"], r["entry"], r["place"]): (r["n"], int(r["low"]) + (int(r["high"]) << LOW_BITS))
            for r in total.collect()}


def fit(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8,
        entries: int = 16, rounds: int = 6, scale: int = 4096) -> dict:
    """Codebooks (integer arrays, one for each part), part bounds, length and scale."""
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(
        usable(F.col("vector")))
    first = seeds(vectors, entries)
    length = len(first[0]) if first else 0
    bounds = part_bounds(length, parts)
    start = np.array([[math.floor(float(v) * scale) for v in s] for s in first],
                     dtype=object).reshape(len(first), length)
    books = [start[:, a:b] for a, b in bounds]
    for _ in range(rounds if first and length else 0):
        sums = entry_sums(vectors, books, bounds, length, scale)
        books = [b.copy() for b in books]
        for (p, e, i), (n, total) in sums.items():
            books[p][e, i] = total // n
    return {"books": books, "bounds": bounds, "length": length if first else None, "scale": scale}


def digest(model: dict) -> str:
    """SHA-256 of the entries' components by part, entry and position, comma-joined."""
    values = (str(v) for book in model["books"] for entry in book for v in entry)
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def encode(df: DataFrame, model: dict, vector_col: str = "embedding") -> DataFrame:
    """Usable rows, with code (two hex digits a part) and error (exact, long) in place of the
    vector; columns of these names are replaced. One pass, no shuffle."""
    df = df.drop("code", "error").where(usable(F.col(vector_col)))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            if m["length"] is not None:
                x, rows = integers(batch.column(vector_col), m["length"], m["scale"])
                index = np.zeros((len(rows), len(m["books"])), np.uint8)
                error = np.zeros(len(rows), dtype=object)
                for p, _, best, dist in assign(x, m["books"], m["bounds"]):
                    index[:, p] = best
                    error += dist.astype(object)
                for r, code, e in zip(rows.tolist(), index, error):
                    codes[r] = code.tobytes().hex()
                    errors[r] = int(e) if e < 2**63 else None
            rest = [n for n in batch.schema.names if n != vector_col]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                [*rest, "code", "error"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields
                     if f.name != vector_col)
    return df.mapInArrow(run, f"{schema}code string, error long")


def decode(df: DataFrame, model: dict, out: str = "decoded") -> DataFrame:
    """The frame with the vector each code stands for (entry components / scale)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            vectors = [None if c is None else
                       [float(v) / m["scale"] for book, e in zip(m["books"], bytes.fromhex(c)) for v in book[e]]
                       for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` array<double>")


def with_group_sum(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """The frame with the sum of value over rows of equal by (nulls together)."""
    sums = staged(df.groupBy(F.col(by).alias("group_key")).agg(F.try_sum(value).alias(out)), "group-sums")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return df.join(sums, F.col(by).eqNullSafe(F.col("group_key"))).drop("group_key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors and their errors."""
    vectors = read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    model = fit(vectors)
    coded = staged(encode(vectors, model), "codes")
    return with_group_sum(coded, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(model)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Long form: one row per (vector, part, place) and per (part, entry, place)."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding, len(embedding) // {parts} AS w
  FROM embeddings WHERE embedding IS NOT NULL
  AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (SELECT r, i // w AS p, i % w AS d, CAST(floor({scale} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM kept, generate_series(0, {parts} * w - 1) AS g(i)),
seed AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT p, e, d, x AS c FROM cells JOIN seed USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, p, min(s * {entries} + e) % {entries} AS e, min(s * {entries} + e) // {entries} AS s
  FROM (SELECT r, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS s FROM cells JOIN b{i} USING (p, d) GROUP BY r, p, e)
  GROUP BY r, p)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT p, e, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM cells JOIN a{i} USING (r, p) GROUP BY p, e, d),
b{i + 1} AS MATERIALIZED (SELECT p, e, d, CASE WHEN n IS NULL THEN c ELSE (t - ((t % n) + n) % n) // n END AS c
  FROM b{i} LEFT JOIN m{i} USING (p, e, d))""")
    return "WITH " + ",".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(s) AS BIGINT) AS error
  FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, d)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM book) AS codebooks_sha256
FROM kept JOIN coded USING (r)"""


ORACLE = _oracle()
