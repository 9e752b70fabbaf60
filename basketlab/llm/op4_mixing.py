"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources (its membership pattern). Documents are
aggregated to one row per pattern; a flow network routes token capacity from patterns to
source quotas, where each pattern has one arc per repetition and later repetitions cost
more (convex costs), so nothing is repeated while fresh text is left. The flow gives the
tokens to take from each pattern: every document of it is taken ``flow // size`` times and
documents in a seeded order once more until the rest is used up. The place where that
order is cut is found by two passes over hash digits (per pattern and digit one sum), so
no task ever holds a whole pattern, however hot.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; they share the
total size; a target stops at ``max_repeats`` times its source's size and the excess is
shared again by weight among the others until none is above.

Odd cases: null or empty text has size 0, takes no words and passes through; a document
without any source belongs to the null source; rows with the same id are rows of their
own; an empty table gives no rows. The patterns (not documents) pass through the driver:
one row for each set of sources that occurs.
"""
from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from basketlab.llm.common import read_columns, staged

DIGITS = 3  # hex digits of the seeded order looked at in each of the two passes


def size_of(text):
    """Number of whitespace-delimited words; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "x")
    return F.length(F.translate(squeezed, " \t\n\u000b\f\r", "")).cast("long")


def source_targets(sizes: dict, max_repeats: int = 3) -> dict:
    """Each source's target; sizes by source, None allowed as a source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, free, full = sum(sizes.values()), list(order), set()
    while True:
        left = total - sum(max_repeats * sizes[s] for s in order if s in full)
        shares = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] > max_repeats * sizes[s] * shares]
        if not over:
            return {s: float(max_repeats * sizes[s]) if s in full
                    else (left * weight[s] / shares if shares else 0.0) for s in order}
        full.update(over)
        free = [s for s in free if s not in full]


def min_cost_flow(patterns: list[tuple[tuple, int]], quotas: dict, max_repeats: int) -> list[int]:
    """Tokens to route from each pattern (members, size) so that the quotas are met as
    far as capacity goes, at the least cost; repetition r costs r per token. Successive
    cheapest augmenting paths with potentials."""
    sources = {s: i for i, s in enumerate(quotas)}
    start, base = 0, 1 + len(patterns)
    sink = base + len(sources)
    heads, caps, costs, out = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a, b, cap, cost):
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out[x].append(len(heads))
            heads.append(y)
            caps.append(c)
            costs.append(w)

    for i, (members, size) in enumerate(patterns):
        for r in range(max_repeats):
            arc(start, 1 + i, size, r)
        for s in members:
            arc(1 + i, base + sources[s], max_repeats * size, 0)
    for s, q in quotas.items():
        arc(base + sources[s], sink, q, 0)

    height = [0] * (sink + 1)
    while True:
        far, via, heap = [None] * (sink + 1), [-1] * (sink + 1), [(0, start)]
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                if caps[e]:
                    y, n = heads[e], d + costs[e] + height[x] - height[heads[e]]
                    if far[y] is None or n < far[y]:
                        far[y], via[y] = n, e
                        heapq.heappush(heap, (n, y))
        if far[sink] is None:
            break
        limit = max(d for d in far if d is not None)
        height = [h + (limit if d is None else d) for h, d in zip(height, far)]
        path, x = [], sink
        while x != start:
            path.append(via[x])
            x = heads[via[x] ^ 1]
        flow = min(caps[e] for e in path)
        for e in path:
            caps[e] -= flow
            caps[e ^ 1] += flow
    left = [0] * base
    for e in out[start]:
        left[heads[e]] += caps[e]
    return [max_repeats * size - left[1 + i] for i, (_, size) in enumerate(patterns)]


def mix(docs: DataFrame, id_col: str, text_col: str, members, seed: int = 7,
        max_repeats: int = 3, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """members: a Column, array of the sources a row belongs to. Returns one row per
    document (id, members, size, repeats, taken, and the columns to carry) and one per
    source (source, source_size, target)."""
    spark = docs.sparkSession
    base = staged(docs.select(
        F.col(id_col).alias("id"), size_of(F.col(text_col)).alias("size"),
        F.array_sort(F.array_distinct(members)).alias("members"), *carry), "mix-sizes")
    # seeded order: equal ids get equal places, and then go by size
    base = base.withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))))

    rows = (base.groupBy("members").agg(F.sum("size").alias("size"))
            .orderBy("members").collect())
    patterns = [(tuple(r["members"]), r["size"]) for r in rows]
    sizes: dict = {}
    for m, n in patterns:  # a shared document counts in full for each of its sources
        for s in m:
            sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, max_repeats)
    flows = min_cost_flow(patterns, {s: int(t + 0.5) for s, t in targets.items()}, max_repeats)

    plan_type = T.StructType([
        T.StructField("pattern", T.ArrayType(T.StringType())), T.StructField("whole", T.LongType()),
        T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame(
        [(list(m), f // n if n else 0, f % n if n else 0)
         for (m, n), f in zip(patterns, flows)], plan_type)
    # null-safe key of a pattern: an array with a null member never equals itself in a join
    key = lambda c: F.to_json(F.struct(F.transform(c, lambda s: F.coalesce(
        F.concat(F.lit("="), s), F.lit("-"))).alias("m")))
    plan = plan.select(key(F.col("pattern")).alias("key"), "whole", "rest")
    rows = base.withColumn("key", key(F.col("members"))).join(plan, "key")

    # first pass: sum per leading digits; second: per next digits inside the digit cut
    cut = None
    for start in (1, 1 + DIGITS):
        inside = rows if cut is None else rows.join(cut, "key").where(
            F.substring("place", 1, DIGITS) == F.col("d1"))
        digit = F.substring("place", start, DIGITS)
        before = F.lit(0) if cut is None else F.col("before")
        sums = inside.groupBy("key", "rest", before.alias("from"), digit.alias("digit")).agg(
            F.sum("size").alias("n"))
        upto = F.sum("n").over(W.Window.partitionBy("key").orderBy("digit")
                               .rowsBetween(W.Window.unboundedPreceding, 0)) + F.col("from")
        found = (sums.withColumn("upto", upto).where("upto >= rest")
                 .groupBy("key").agg(F.min(F.struct("digit", (F.col("upto") - F.col("n"))
                                                    .alias("before"))).alias("c")))
        if cut is None:
            cut = found.select("key", F.col("c.digit").alias("d1"), F.col("c.before").alias("before"))
        else:
            cut = cut.drop("before").join(found.select(
                "key", F.col("c.digit").alias("d2"), F.col("c.before").alias("before")), "key")
    cut = staged(cut.withColumn("edge", F.concat("d1", "d2")), "mix-cuts")

    rows = rows.join(cut.select("key", "edge", "before"), "key", "left")
    head = F.substring("place", 1, 2 * DIGITS)
    at_edge = rows.where(head == F.col("edge"))
    upto = F.col("before") + F.sum("size").over(
        W.Window.partitionBy("key").orderBy("place", "id", "size")
        .rowsBetween(W.Window.unboundedPreceding, 0))
    # the document on the cut goes in when at least half of it fits
    at_edge = at_edge.withColumn("upto", upto).withColumn(
        "more", (2 * (F.col("upto") - F.col("rest")) <= F.col("size")).cast("long")).drop("upto")
    others = rows.where(F.coalesce(head != F.col("edge"), F.lit(True))).withColumn(
        "more", F.coalesce((head < F.col("edge")), F.lit(False)).cast("long"))
    out = others.unionByName(at_edge.select(others.columns))
    repeats = F.when(F.col("size") > 0, F.least(
        F.col("whole") + F.when(F.col("rest") > 0, F.col("more")).otherwise(0),
        F.lit(max_repeats))).otherwise(F.lit(0))
    stats_type = T.StructType([T.StructField("source", T.StringType()),
                               T.StructField("source_size", T.LongType()),
                               T.StructField("target", T.DoubleType())])
    stats = spark.createDataFrame([(s, sizes[s], t) for s, t in targets.items()], stats_type)
    picked = out.select("id", "members", "size", repeats.alias("repeats"),
                        (F.col("size") * repeats).alias("taken"), *carry)
    return picked, stats


def by_source(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    return mix(docs, "doc_id", "text", F.array(F.col("source")), carry=carry)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, each in its one source."""
    picked, stats = by_source(read_columns(spark, sf_dir, "documents", "doc_id", "text", "source"))
    picked = picked.withColumn("source", F.element_at("members", 1))
    return (picked.join(stats, picked["source"].eqNullSafe(stats["source"]))
            .select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5('7:' || doc_id::VARCHAR) AS place,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
r AS (SELECT *, (SELECT sum(size) FROM d)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING
                                       AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW
                               AND UNBOUNDED FOLLOWING) AS shares FROM w),
f AS (SELECT *, rest * weight > cap * shares AS is_full FROM r),
lv AS (SELECT (SELECT sum(size) FROM d) - coalesce(sum(cap) FILTER (WHERE is_full), 0) AS rest,
              sum(weight) FILTER (WHERE NOT is_full) AS shares FROM f),
t AS (SELECT f.source, f.source_size,
             CASE WHEN is_full THEN cap::DOUBLE
                  ELSE (lv.rest * weight)::DOUBLE / lv.shares::DOUBLE END AS target FROM f, lv),
q AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS flow FROM t),
p AS (SELECT d.*, q.source_size, q.target,
             CASE WHEN q.source_size > 0 THEN q.flow // q.source_size ELSE 0 END AS whole,
             CASE WHEN q.source_size > 0 THEN q.flow % q.source_size ELSE 0 END AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (size * least(3, whole + CASE WHEN extra > 0 AND upto - size < extra
                                          AND 2 * (upto - extra) <= size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
