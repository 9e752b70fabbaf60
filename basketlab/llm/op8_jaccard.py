"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

A document's set is its distinct 5-word shingles (64-bit hashes; A-Z lower-cased words
``[^\\x20\\x09-\\x0D]+``). Two documents link when 100 * intersection >= 75 * union.

1. One pass gives each row its set size and a 128-bit signature of its set, and counts
   shingles in a histogram of fixed size (the same whatever the input). Rows with equal
   signatures form one class; its smallest id stands for it.
2. All sets are put in one global order: rarer histogram cells first, then by hash. With
   n shingles, a document's prefix for l matches has ``n - ceil(0.75 n) + l`` tokens, and
   two linked documents share at least ``min(l, l')`` tokens of their prefixes. Each
   document takes the l with the least estimated cost (tokens to look up plus candidates
   to verify, from the histogram). Tokens go, packed by numpy, to their bucket, and those
   of one document only end there.
3. First every document is verified against one other: each token has a pivot, and the
   pivot of most of the document's tokens is taken, if it is that of a tenth of the set,
   so a group of any size gives one pair per document. What links forms components.
4. Then all pairs across different components that share the smaller l of prefix tokens
   are verified, so no link between components is lost; pairs inside a component can't
   change it and are never made. What counts as prefix depends on both sizes here (the
   overlap that a link of these sizes needs), and common tokens are dealt by size bands. Components of all links follow by min-label
   rounds with pointer jumping.

Verification counts the two whole sets. Odd cases: null text and texts without words
have no shingles and link with nothing; texts of 1 to 4 words have one shingle, the whole
sequence; rows with the same id are one document that links through each of its texts (if
an id has several, rows are joined as documents of their own first, and ids after); a null
id links with nothing and has no component; empty tables give no rows.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import (LOWER, NOT_SPACE, histogram_rows, mix, random_words, read_columns,
                                  staged, summed_histogram, text_slices, word_bounds, word_hashes)

CELLS = 1 << 20
NUMERATOR, DENOMINATOR = 75, 100
SALT = random_words(23, 8)


def shingles(data: np.ndarray | None, width: int = 5) -> np.ndarray:
    """The distinct shingle hashes of one text, sorted."""
    if data is None or not len(data):
        return np.empty(0, np.uint64)
    data = LOWER[data]
    words = word_hashes(data, *word_bounds(data, NOT_SPACE))
    n = min(width, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * SALT[0] + words[i:len(words) - n + 1 + i]
    return np.unique(mix(out + np.uint64(n)))


def cells_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def profile(docs: DataFrame, kind: str) -> DataFrame:
    """Rows (id, n, s1, s2) of documents, and rows (slice, counts) of the histogram."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros(CELLS, np.int64)
        id_type = None
        empty = pa.schema([("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
        names = ["id", "n", "s1", "s2", "slice", "counts"]
        for batch in batches:
            id_type = batch.schema.field(0).type
            rows = np.zeros((len(batch), 3), np.int64)
            for i, data in enumerate(text_slices(batch.column(1))):
                tokens = shingles(data)
                np.add.at(total, cells_of(tokens), 1)
                rows[i] = (len(tokens), mix(tokens + SALT[1]).sum(dtype=np.uint64).astype(np.int64),
                           mix(tokens * SALT[2]).sum(dtype=np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(rows[:, j], f.type) for j, f in enumerate(empty)),
                 pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], names)
        if id_type is not None:
            parts = list(histogram_rows(total))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), id_type), *(pa.nulls(len(parts), f.type) for f in empty),
                 pa.array([i for i, _ in parts], pa.int32()),
                 pa.array([c for _, c in parts], pa.binary())], names)

    return docs.mapInArrow(run, f"id {kind}, n long, s1 long, s2 long, slice int, counts binary")


def prefix_length(n: int, matches: int) -> int:
    return min(n, n - -(-NUMERATOR * n // DENOMINATOR) + matches)


def adaptive_prefix(tokens: np.ndarray, counts: np.ndarray, usual: float, most: int = 6,
                    verify_cost: float = 40.0) -> tuple[np.ndarray, int]:
    """(prefix in global order, number of matches asked for). What a cell counts beyond
    the usual estimates how many documents share a token of it."""
    often = counts[cells_of(tokens)]
    order = np.lexsort((tokens, often))
    reach = np.cumsum(np.maximum(often[order] - usual, 0.0))
    n, best, least = len(tokens), 1, None
    for l in range(1, min(most, -(-NUMERATOR * n // DENOMINATOR)) + 1):  # no more than linked sets share
        p = prefix_length(n, l)
        cost = p + reach[p - 1] * (1 + verify_cost / l)
        if least is None or cost < least:
            best, least = l, cost
    return tokens[order[:prefix_length(n, best)]], best


RECORD = [("token", "<u8"), ("doc", "<u4"), ("low", "<u2"), ("high", "<u2")]  # place = high, low
OWNER = np.dtype([("id", "<i8"), ("n", "<u4"), ("l", "<u2"), ("common", "<u2")])


def prefix_blobs(docs: DataFrame, counts: np.ndarray, buckets: int,
                 flush: int = 1_500_000) -> DataFrame:
    """(bucket, tokens, owners): prefix tokens by bucket, packed per task."""
    middle = float(np.median(counts))
    usual = middle + 4 * middle ** 0.5  # four deviations of a cell's ordinary load
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.float32))

    def run(batches):
        import pyarrow as pa
        held, owners, size = [], [], 0

        def packed():
            tokens = np.concatenate([t for t, _ in held])
            place = np.concatenate([np.arange(len(t)) for t, _ in held])
            doc = np.concatenate([np.full(len(t), i, np.uint32) for t, i in held])
            own = np.array(owners, OWNER)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            rows = {"bucket": [], "tokens": [], "owners": []}
            for a, b in zip(edges, edges[1:]):
                mine = order[a:b]
                who, local = np.unique(doc[mine], return_inverse=True)
                fields = (tokens[mine], local, place[mine] & 0xFFFF, place[mine] >> 16)
                rows["bucket"].append(int(bucket[mine[0]]))
                # by field, so that the shuffle's compression finds the runs
                rows["tokens"].append(b"".join(
                    x.astype(t).tobytes() for x, (_, t) in zip(fields, RECORD)))
                rows["owners"].append(own[who].tobytes())
            return pa.RecordBatch.from_pydict(rows, pa.schema([
                ("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary())]))

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), text_slices(batch.column(1))):
                tokens = shingles(data)
                if len(tokens) and k is not None:
                    prefix, l = adaptive_prefix(tokens, shared.value, usual)
                    common = (shared.value[cells_of(tokens)] > usual).mean()
                    held.append((prefix, len(owners)))
                    owners.append((k, len(tokens), l, round(1000 * common)))
                    size += len(prefix)
                if size >= flush:
                    yield packed()
                    held, owners, size = [], [], 0
        if held:
            yield packed()

    return docs.mapInArrow(run, "bucket int, tokens binary, owners binary")


def shared_tokens(blobs: DataFrame) -> DataFrame:
    """(token, id, n, l, place, pivot) of the tokens that at least two documents hold; the pivot
    is the token's document with the largest share of common shingles, and of these the
    one with the smallest id hash: in a group of near copies the one changed least, to
    which most of the others link."""
    def run(key, table):
        import pyarrow as pa
        tokens, places, ids, n, l, common = [], [], [], [], [], []
        for t, o in zip(table.column("tokens").to_pylist(), table.column("owners").to_pylist()):
            own = np.frombuffer(o, OWNER)
            count = len(t) // 16
            tokens.append(np.frombuffer(t, "<u8", count))
            who = np.frombuffer(t, "<u4", count, 8 * count)
            places.append(np.frombuffer(t, "<u2", count, 12 * count)
                          + 65536 * np.frombuffer(t, "<u2", count, 14 * count).astype(np.int32))
            for out, field in ((ids, "id"), (n, "n"), (l, "l"), (common, "common")):
                out.append(own[field][who])
        tokens, places, ids, n, l, common = (
            np.concatenate(x) for x in (tokens, places, ids, n, l, common))
        rank = mix(ids.astype(np.uint64) + SALT[3])
        order = np.lexsort((rank, -common.astype(np.int64), tokens))
        tokens, places, ids, n, l = tokens[order], places[order], ids[order], n[order], l[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        many = np.zeros(len(start), bool)
        np.logical_or.at(many, group[~new], ids[~new] != ids[start[group[~new]]])
        keep = many[group]
        return pa.table({"token": tokens[keep].view(np.int64), "id": ids[keep],
                         "n": n[keep].astype(np.int32), "l": l[keep].astype(np.int32),
                         "place": places[keep].astype(np.int32),
                         "pivot": ids[start[group[keep]]]})

    return blobs.groupBy("bucket").applyInArrow(
        run, "token long, id long, n int, l int, place int, pivot long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        last, known = None, None

        def tokens_of(blob):
            return shingles(np.frombuffer(unpack.decompress(blob), np.uint8))

        for batch in batches:
            keep = []
            for b, za, zb in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                 batch.column(3).to_pylist()):
                if b != last:
                    last, known = b, tokens_of(zb)
                mine = tokens_of(za)
                both = len(np.intersect1d(mine, known, assume_unique=True))
                keep.append(DENOMINATOR * both >= NUMERATOR * (len(mine) + len(known) - both))
            out = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield out

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, z): compressed text of the wanted documents, one row per id."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([packer.compress((t or "").encode())
                                            for t in batch.column(1).to_pylist()], pa.binary())],
                ["id", "z"])

    return (docs.mapInArrow(run, "id long, z binary").join(ids, "id", "left_semi")
            .groupBy("id").agg(F.max("z").alias("z")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, comp): smallest id reachable from each end of the edges (a, b). Each round
    takes the smallest label among the neighbours and then jumps to the label's label."""
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(),
                  "links")
    label = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c"))
                   .withColumnRenamed("a", "v"), "labels")
    for _ in range(rounds):
        near = (both.join(label, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m")))
        best = (label.join(near, F.col("v") == F.col("a"), "left")
                .select("v", F.least("c", F.coalesce("m", "c")).alias("m"), F.col("c").alias("old")))
        jump = label.select(F.col("v").alias("w"), F.col("c").alias("further"))
        new = staged(best.join(jump, F.col("m") == F.col("w"), "left").select(
            "v", F.least("m", F.coalesce("further", "m")).alias("c"), "old"), "labels")
        changed = not new.where("c != old").isEmpty()
        label = new.select("v", "c")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select(F.col("v").alias("id"), F.col("c").alias("comp"))


def within(place, n, m, matches):
    """Whether a token at this place of a document of n shingles lies in its prefix for
    `matches` matches with a document of m: both must share the overlap that a link of
    these sizes needs, so that many tokens come after the first ones shared."""
    overlap = F.ceil(NUMERATOR * (n + m) / (NUMERATOR + DENOMINATOR))
    return place <= n - overlap + matches - 1


BAND = 1.06  # sizes of one band differ by this factor at most
FEW = 8      # documents of a token up to which sizes needn't be told apart first


def band_of(n):
    return F.floor(F.log(n) / F.log(F.lit(BAND)) + 1e-9)


def pairs_across(held: DataFrame) -> DataFrame:
    """(a, b): documents of different components that share as many tokens of their
    prefixes as the smaller of their numbers of matches.

    A token of many documents is first dealt by the pair of size bands: with partners
    of a given size a prefix is shorter than for any size, and most documents leave a
    common token's group that way. Components meet before their documents do, so pairs
    inside a component are never made."""
    held = held.withColumn("own", band_of(F.col("n")))
    cols = ["comp", "id", "n", "l", "place"]
    few = held.where(F.col("docs") <= FEW).select(
        "token", F.lit(-1).cast("long").alias("b1"), F.lit(-1).cast("long").alias("b2"), *cols)
    many, n = held.where(F.col("docs") > FEW), F.col("n")

    def side(step: int) -> DataFrame:
        """The rows whose token stands in the prefix for partners in each band of the
        sizes that can link, upwards (step 1) or downwards (step -1) from their own."""
        out = few
        for k in range(int(math.log(DENOMINATOR / NUMERATOR) / math.log(BAND)) + 2):
            partner = F.col("own") + step * k
            least = F.greatest(F.floor(F.pow(F.lit(BAND), partner)), F.ceil(NUMERATOR * n / DENOMINATOR))
            out = out.unionByName(many.where(within(F.col("place"), n, least, 1)).select(
                "token", F.least("own", partner).alias("b1"), F.greatest("own", partner).alias("b2"),
                *cols))
        return out
    low, high = staged(side(1), "low"), staged(side(-1), "high")  # each is read twice
    keys = ["token", "b1", "b2"]
    meet = (low.select(*keys, "comp").distinct()
            .join(high.select(*keys, F.col("comp").alias("other")).distinct(), keys)
            .where("comp < other or (comp > other and b1 < b2)"))
    one = low.select(*keys, "comp", *[F.col(c).alias(f"{c}1") for c in ("id", "n", "l", "place")])
    two = high.select(*keys, F.col("comp").alias("other"),
                      *[F.col(c).alias(f"{c}2") for c in ("id", "n", "l", "place")])

    def inside(matches):
        return (within(F.col("place1"), F.col("n1"), F.col("n2"), matches)
                & within(F.col("place2"), F.col("n2"), F.col("n1"), matches))
    # l shared tokens among the prefixes for l matches include one of those for one match
    met = meet.join(one, [*keys, "comp"]).join(two, [*keys, "other"]).where(
        (DENOMINATOR * F.least("n1", "n2") >= NUMERATOR * F.greatest("n1", "n2")) & inside(1))
    met = staged(met.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
                 .distinct(), "met")
    matches = F.least("l1", "l2")
    first, second = ([F.col("id").alias(e), "token", *[F.col(c).alias(f"{c}{i}") for c in (
        "n", "l", "place")]] for i, e in ((1, "a"), (2, "b")))
    return (met.join(held.select(*first), "a").join(held.select(*second), ["b", "token"])
            .where(inside(matches)).groupBy("a", "b", matches.alias("asked"))
            .agg(F.count(F.lit(1)).alias("shared")).where("shared >= asked").select("a", "b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_shingles, component_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = staged(profile(docs, "bigint"), "profile")
    rows = made.where("slice is null").select("id", "n", "s1", "s2")
    sets = rows.where("id is not null").groupBy("id").agg(
        F.min(F.struct("s1", "s2")).alias("first"), F.max(F.struct("s1", "s2")).alias("last"))
    if sets.where("first != last").isEmpty():
        return _components_of(docs, made, rows)
    # ids with several texts: every row is a document of its own first
    own = staged(docs.withColumn("row", F.when(F.col("id").isNotNull(), F.monotonically_increasing_id())), "rows")
    own_docs = own.select(F.col("row").alias("id"), "text")
    made = staged(profile(own_docs, "bigint"), "profile")
    found = staged(_components_of(own_docs, made, made.where("slice is null").select("id", "n", "s1", "s2")),
                   "row-components").withColumnRenamed("id", "row")
    ids = own.where("row is not null").select("row", "id")
    of_rows = staged(found.join(ids, "row").select("id", "n_shingles", "component_id").join(
        ids.select(F.col("row").alias("component_id"), F.col("id").alias("other")), "component_id"), "by-id")
    comp = components(of_rows.select(F.col("id").alias("a"), F.col("other").alias("b")))
    nameless = found.where("row is null").select(
        F.lit(None).cast("long").alias("id"), "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return of_rows.join(comp, "id", "left").select(
        "id", "n_shingles", F.coalesce("comp", "id").alias("component_id")).unionByName(nameless)


def _components_of(docs: DataFrame, made: DataFrame, rows: DataFrame) -> DataFrame:
    """The components where all rows of an id have one set; made is the documents' profile."""
    spark = docs.sparkSession
    counts = summed_histogram(made.where("slice is not null").select("slice", "counts"), CELLS)

    total = int(counts.sum()) // 4
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_500_000))
    tokens = staged(shared_tokens(prefix_blobs(docs, counts, buckets)), "tokens")

    # classes of equal sets
    classes = rows.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    copies = staged(rows.join(classes, ["n", "s1", "s2"]).where("id != rep")
                    .select("id", "rep").distinct(), "copies")
    texts = staged(packed_texts(docs, tokens.select("id").distinct()
                                .join(copies.select("id"), "id", "left_anti")), "texts")

    # of each document's pivots the one with which it shares most tokens, between classes
    near = (tokens.where("id != pivot").groupBy("id", "n", "pivot").agg(F.count(F.lit(1)).alias("c"))
            .where("10 * c >= n").groupBy("id").agg(F.max(F.struct("c", "pivot")).alias("best"))
            .select("id", F.col("best.pivot").alias("pivot")))
    star = (near.join(copies, "id", "left").select(F.coalesce("rep", "id").alias("a"), "pivot")
            .join(copies.withColumnRenamed("id", "pivot"), "pivot", "left")
            .select("a", F.coalesce("rep", "pivot").alias("b")).where("a != b"))
    star = staged(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .distinct(), "star")
    edges = staged(verified(star, texts).union(copies.select(F.col("id").alias("a"), "rep")), "edges")
    comp = components(edges)

    # all further pairs across components
    held = tokens.drop("pivot").distinct().join(
        copies.select("id"), "id", "left_anti").join(comp, "id", "left").withColumn(
        "comp", F.coalesce("comp", "id"))
    apart = held.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                      F.count(F.lit(1)).alias("docs")).where("lo != hi")
    held = staged(held.join(apart.select("token", "docs"), "token"), "apart")
    pairs = staged(pairs_across(held).join(star, ["a", "b"], "left_anti"), "pairs")
    more = staged(verified(pairs, texts), "more")
    if not more.isEmpty():
        comp = components(edges.union(more))
    return (rows.join(comp, "id", "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents among all documents."""
    return jaccard_components(
        read_columns(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x20\x09-\x0D]+') AS w
      FROM documents, az),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * inter >= 75 * (a.n + b.n - inter)),
e2 AS MATERIALIZED (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT doc_id AS v, doc_id AS r FROM w
          UNION SELECT reach.v, e2.y FROM reach JOIN e2 ON e2.x = reach.r),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.v = w.doc_id
"""
