"""Data audit jobs.

Each audit is one aggregate per input (global or small-keyed), never a collect of
rows; medians of per-key counts are computed exactly from a value histogram,
whose size is bounded by the number of distinct count values, not by the data.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.scalars import clip

# The eleven foreign-key edges of the shop schema.
FK_EDGES = [
    ("sessions", "user_id", "users", "user_id"),
    ("interactions", "user_id", "users", "user_id"),
    ("interactions", "session_id", "sessions", "session_id"),
    ("interactions", "product_id", "products", "product_id"),
    ("purchases", "user_id", "users", "user_id"),
    ("purchases", "session_id", "sessions", "session_id"),
    ("purchases", "product_id", "products", "product_id"),
    ("purchases", "interaction_id", "interactions", "interaction_id"),
    ("reviews", "user_id", "users", "user_id"),
    ("reviews", "product_id", "products", "product_id"),
    ("reviews", "purchase_id", "purchases", "purchase_id"),
]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# D20 -------------------------------------------------------------------------
def null_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, dtype, nulls, rows): one aggregate pass per table, then the
    single result row is unpivoted with ``stack``."""
    out = []
    for name, df in tables.items():
        aggs = [F.count(F.lit(1)).alias("_rows")] + [
            F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]
        one = df.agg(*aggs)
        pairs = ", ".join(f"'{c}', '{t}', _n{i}" for i, (c, t) in enumerate(df.dtypes))
        out.append(one.select(
            F.lit(name).alias("table"), F.col("_rows").alias("rows"),
            F.expr(f"stack({len(df.columns)}, {pairs}) AS (`column`, dtype, nulls)"))
            .select("table", "column", "dtype", "nulls", "rows"))
    return union_all(out)


# D21 -------------------------------------------------------------------------
def event_vocabulary(interactions: DataFrame) -> DataFrame:
    return (interactions.where(F.col("interaction_type").isNotNull())
            .groupBy("interaction_type").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("interaction_type")))


# D22 -------------------------------------------------------------------------
def base_rate(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.avg("is_converted").alias("base_rate"),
                        F.sum("is_converted").cast("bigint").alias("positives"),
                        F.count(F.lit(1)).alias("sessions"))


# C14 / D23 -------------------------------------------------------------------
def session_type_count(sessions: DataFrame, interactions: DataFrame, itype: str,
                       name: str) -> DataFrame:
    per = (interactions.where(F.col("interaction_type") == itype)
           .groupBy("session_id").agg(F.count(F.lit(1)).alias(name)))
    return (sessions.join(per, "session_id", "left")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("bigint")))


def conversion_by_cart_bucket(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """P(converted) by gross add-to-cart count, clipped to 0..4 (4 = "4+")."""
    s = session_type_count(sessions, interactions, "add_to_cart", "carts")
    return (s.groupBy(clip("carts", 0, 4).alias("carts"))
            .agg(F.avg("is_converted").alias("rate"), F.count(F.lit(1)).alias("n")))


# D24 -------------------------------------------------------------------------
def conversion_by(sessions: DataFrame, cols=("device_type", "referrer_source")) -> DataFrame:
    """Conversion rate per value of each column, as one GROUPING SETS aggregate
    (one scan, one shuffle) reshaped to (feature, value, rate, n)."""
    cols = list(cols)
    g = sessions.groupingSets([[c] for c in cols], *cols).agg(
        F.avg("is_converted").alias("rate"), F.count(F.lit(1)).alias("n"),
        *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    feature = None
    value = None
    for c in cols:
        cond = F.col(f"_g_{c}") == 0
        feature = F.when(cond, F.lit(c)) if feature is None else feature.when(cond, F.lit(c))
        value = (F.when(cond, F.col(c).cast("string")) if value is None
                 else value.when(cond, F.col(c).cast("string")))
    return (g.select(feature.alias("feature"), value.alias("value"), "rate", "n")
            .where(F.col("value").isNotNull()))  # rows without a value form no group


# C14 / D25 -------------------------------------------------------------------
def dwell_by_outcome(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    """Mean over sessions of the session's mean dwell, by outcome (sessions
    without interactions have no mean and are skipped)."""
    d = interactions.groupBy("session_id").agg(F.avg("dwell_time_ms").alias("dwell"))
    return (sessions.join(d, "session_id", "left").groupBy("is_converted")
            .agg(F.round(F.avg("dwell"), 6).alias("mean_dwell_ms")))


# D26 -------------------------------------------------------------------------
def spread(hist: DataFrame) -> DataFrame:
    """mean / exact median / max / sample std per level from a histogram of counts
    (level, v, f): one row per distinct count value, so the running totals and the
    sums below see that many rows, not the data."""
    w = Window.partitionBy("level").orderBy("v")
    total = Window.partitionBy("level")
    c = hist.withColumns({
        "cum": F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "N": F.sum("f").over(total), "S": F.sum(F.col("v") * F.col("f")).over(total)})
    mean = F.col("S") / F.col("N")
    lo = F.min(F.when(F.col("cum") >= F.floor((F.col("N") + 1) / 2), F.col("v")))
    hi = F.min(F.when(F.col("cum") >= F.floor(F.col("N") / 2) + 1, F.col("v")))
    square = F.sum(F.col("f") * (F.col("v") - mean) * (F.col("v") - mean))
    return c.groupBy("level").agg(
        F.first(mean).alias("mean"), ((lo + hi) / 2).cast("double").alias("median"),
        F.max("v").cast("bigint").alias("max"),
        F.round(F.sqrt(F.try_divide(square, F.first("N") - 1)), 6).alias("std"))


def event_spread(interactions: DataFrame) -> DataFrame:
    """Events per session, user and product: one grouping-sets aggregate counts all
    three keys in one scan and shuffle; the rest runs on the histogram of counts."""
    levels = {"session_id": "per session", "user_id": "per user", "product_id": "per product"}
    keys = list(levels)
    counts = interactions.groupingSets([[k] for k in keys], *keys).agg(
        F.count(F.lit(1)).alias("v"), *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    level = F.coalesce(*[F.when((F.col(f"_g_{k}") == 0) & F.col(k).isNotNull(), F.lit(name))
                         for k, name in levels.items()])
    hist = (counts.select(level.alias("level"), "v").where(F.col("level").isNotNull())
            .groupBy("level", "v").agg(F.count(F.lit(1)).alias("f")))
    return spread(hist)


# D27 -------------------------------------------------------------------------
def coverage(users: DataFrame, products: DataFrame, interactions: DataFrame) -> DataFrame:
    """Products and users with any interaction vs. totals, and the cold share."""
    def distinct(key, name):  # the distinct keys first: no row is multiplied per key
        return (interactions.select(key).where(F.col(key).isNotNull()).distinct()
                .agg(F.count(F.lit(1)).alias(name)))

    def total(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))
    a = distinct("product_id", "products_with_events")
    for one in (total(products, "products_total"), distinct("user_id", "users_with_events"),
                total(users, "users_total")):
        a = a.join(F.broadcast(one), how="inner", on=F.lit(True))  # one row each
    return a.withColumn("cold_share", F.lit(1.0) - F.try_divide(
        F.col("users_with_events").cast("double"), F.col("users_total").cast("double")))


# D31 -------------------------------------------------------------------------
def engagement_by_outcome(sessions: DataFrame, interactions: DataFrame) -> DataFrame:
    per = interactions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("interaction_type") == "click").alias("clicks"))
    s = sessions.join(per, "session_id", "left").fillna(0, ["events", "clicks"])
    return s.groupBy("is_converted").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.avg("events").alias("mean_events"),
        F.avg(F.when(F.col("clicks") > 0, 1).otherwise(0)).alias("share_with_click"))


# D32 -------------------------------------------------------------------------
def median_of(df: DataFrame, col: str, name: str) -> DataFrame:
    """Exact median from the histogram of values. Running totals are made inside
    ranges of the value and over the ranges' totals, so no task holds all values."""
    v = F.col(col)
    hist = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("f"))
    edge = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_n"))
    part = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")),
                              F.lit(0.0)) * 4095)
    hist = hist.join(F.broadcast(edge), how="inner", on=F.lit(True)).withColumn("r", part)
    before = hist.groupBy("r").agg(F.sum("f").alias("n")).select("r", F.coalesce(F.sum("n").over(
        Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    cum = F.col("n0") + F.sum("f").over(
        Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    c = hist.join(F.broadcast(before), "r").withColumn("cum", cum)
    return c.agg(((F.min(F.when(F.col("cum") >= F.floor((F.col("_n") + 1) / 2), F.col("v")))
                   + F.min(F.when(F.col("cum") >= F.floor(F.col("_n") / 2) + 1, F.col("v"))))
                  / 2).alias(name))


def column_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    """Ranges and cardinalities of the six tables: each table is aggregated alone,
    and the one-row results stand side by side."""
    products, sessions, interactions = (tables[t] for t in ("products", "sessions", "interactions"))
    users, purchases, reviews = (tables[t] for t in ("users", "purchases", "reviews"))

    def ends(df, col, low, high):
        return df.agg(F.min(col).alias(low), F.max(col).alias(high))

    def kinds(df, col, name):
        return df.select(col).where(F.col(col).isNotNull()).distinct().agg(
            F.count(F.lit(1)).alias(name))
    ones = [
        ends(products, "price", "price_min", "price_max"),
        median_of(products, "price", "price_median"),
        kinds(products, "brand", "brands"), kinds(products, "category", "categories"),
        kinds(sessions, "referrer_source", "referrers"),
        ends(sessions, "start_time", "first_session", "last_session"),
        interactions.agg(F.min("timestamp").alias("first_event"),
                         F.max("timestamp").alias("last_event"),
                         F.min("dwell_time_ms").alias("dwell_min"),
                         F.max("dwell_time_ms").alias("dwell_max")),
        ends(users, "age", "age_min", "age_max"),
        ends(purchases, "order_date", "first_order", "last_order"),
        reviews.agg(F.min("rating").alias("rating_min"), F.max("rating").alias("rating_max"),
                    F.min("review_date").alias("first_review"),
                    F.max("review_date").alias("last_review")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b), how="inner", on=F.lit(True)), ones)


# G2 --------------------------------------------------------------------------
def fk_orphans(tables: dict[str, DataFrame], edges=FK_EDGES) -> DataFrame:
    """Distinct non-null child keys with no parent row, per edge.

    Each table is scanned once and emits one row per key it holds: (parent table, key,
    which edges' child it is, whether it is the parent). One aggregate by (parent, key)
    ors the edges together, so a key is one row however often it occurs, and keys
    without a parent are counted per edge. One keyed shuffle, no join, no distinct."""
    emitted = {}
    for i, (child, ck, parent, pk) in enumerate(edges):
        emitted.setdefault(child, {}).setdefault((parent, ck, False), 0)
        emitted[child][(parent, ck, False)] |= 1 << i
        emitted.setdefault(parent, {})[(parent, pk, True)] = 0
    parts = []
    for name, keys in emitted.items():
        arr = F.array(*[F.struct(F.lit(parent).alias("parent"), F.col(k).cast("string").alias("k"),
                                 F.lit(mask).cast("long").alias("mask"), F.lit(own).alias("own"))
                        for (parent, k, own), mask in keys.items()])
        parts.append(tables[name].select(F.inline(arr)))
    keyed = (union_all(parts).where(F.col("k").isNotNull()).groupBy("parent", "k")
             .agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where(~F.col("own")))
    counts = keyed.agg(*[F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(f"e{i}")
                         for i in range(len(edges))])
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(
        ("child", "child_key", "parent", "parent_key"), e)],
        F.col(f"e{i}").cast("bigint").alias("orphans")) for i, e in enumerate(edges)]
    return counts.select(F.inline(F.array(*rows)))


# G3 --------------------------------------------------------------------------
def leak_check(sessions: DataFrame, purchases: DataFrame) -> DataFrame:
    """Is the set of sessions with a purchase the set of converted sessions?"""
    a = purchases.select("session_id").where(F.col("session_id").isNotNull()).distinct()
    b = sessions.where(F.col("is_converted") == 1).select("session_id").distinct()
    only_a = a.join(b, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    only_b = b.join(a, "session_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    r = only_a.select(F.col("n").alias("purchase_not_converted")).join(
        only_b.select(F.col("n").alias("converted_without_purchase")), how="inner",
        on=F.lit(True))
    return r.withColumn("sets_equal", (F.col("purchase_not_converted") == 0)
                        & (F.col("converted_without_purchase") == 0))


# A4 --------------------------------------------------------------------------
def reconcile_counts(src: dict[str, DataFrame], dst: dict[str, DataFrame]) -> DataFrame:
    rows = []
    for name in src:
        s = src[name].agg(F.count(F.lit(1)).alias("src_rows"))
        d = dst[name].agg(F.count(F.lit(1)).alias("dst_rows"))
        rows.append(s.join(d, how="inner", on=F.lit(True))
                    .select(F.lit(name).alias("table"), "src_rows", "dst_rows"))
    out = union_all(rows)
    return out.withColumn("ok", F.col("src_rows") == F.col("dst_rows"))


def assert_reconciled(report: DataFrame) -> DataFrame:
    """The report itself, or an error that names the tables whose counts differ (one
    row per table reaches the driver)."""
    bad = [f"{r['table']}: {r['src_rows']} read, {r['dst_rows']} written"
           for r in report.where(~F.col("ok")).collect()]
    if bad:
        raise ValueError("row counts differ after landing: " + "; ".join(bad))
    return report
