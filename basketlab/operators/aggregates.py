"""The serving tables: product, category, month, headline and session rollups.

Each function is ``DataFrame(s) -> DataFrame``. Fact tables (interactions,
purchases) are only ever aggregated by key with partial (map-side) aggregation
before the shuffle, so a hot product or session collapses to one row per task
before anything moves; joins happen between already-aggregated, key-grained
frames.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.scalars import (INTERACTION_TYPES, day_of_week, flag, hour_of,
                                         is_weekend, net, safe_ratio, seconds_between,
                                         tenure_days, zero_fill_long)

TYPE_COUNT_COLS = [f"n_{t}" for t in INTERACTION_TYPES]


def money_sum(c) -> F.Column:
    """Order-independent sum of a two-decimal amount: exact in decimal, then double."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(18,2)")).cast("double")


def type_counts(types=INTERACTION_TYPES, prefix="n_") -> list:
    """One ``count_if`` per fixed event type (D1–D3). A fixed vocabulary keeps the
    schema independent of the data and needs a single shuffle, unlike ``pivot``."""
    return [F.count_if(F.col("interaction_type") == t).cast("bigint").alias(f"{prefix}{t}")
            for t in types]


def event_counts(interactions: DataFrame, key: str | list[str]) -> DataFrame:
    """Events per key and type, fixed six-column schema."""
    keys = [key] if isinstance(key, str) else key
    return (interactions.where(F.col(keys[0]).isNotNull())
            .groupBy(*keys).agg(*type_counts()))


def purchases_by_product(purchases: DataFrame) -> DataFrame:
    """Purchase rows, units and revenue per product."""
    return (purchases.where(F.col("product_id").isNotNull())
            .groupBy("product_id").agg(
                F.count(F.lit(1)).alias("n_purchases"),
                F.sum("quantity").cast("bigint").alias("units_sold"),
                money_sum("total_amount").alias("revenue")))


PRODUCT_ATTRS = ["product_name", "category", "subcategory", "brand", "price",
                 "rating_avg", "review_count", "stock_quantity", "blurb"]


def product_stats(products: DataFrame, interactions: DataFrame,
                  purchases: DataFrame) -> DataFrame:
    """One row per catalog product with event counts, purchases, revenue and
    view-to-purchase (NULL when never viewed)."""
    attrs = ["product_id"] + [c for c in PRODUCT_ATTRS if c in products.columns]
    ps = (products.select(*attrs)
          .join(event_counts(interactions, "product_id"), "product_id", "left")
          .join(purchases_by_product(purchases), "product_id", "left"))
    ps = zero_fill_long(ps, TYPE_COUNT_COLS + ["n_purchases", "units_sold"])
    return ps.withColumns({
        "revenue": F.coalesce(F.col("revenue"), F.lit(0.0)),
        "view_to_purchase": safe_ratio("n_purchases", "n_view"),
    })


def category_stats(pstats: DataFrame) -> DataFrame:
    """Per-category rollup of product_stats. avg_rating is the plain mean of the
    products' ratings that exist (unrated products are skipped, not zeroed)."""
    return (pstats.where(F.col("category").isNotNull())
            .groupBy("category").agg(
                F.count("product_name").alias("products"),
                F.sum("n_view").cast("bigint").alias("views"),
                F.sum("n_add_to_cart").cast("bigint").alias("carts"),
                F.sum("n_purchases").cast("bigint").alias("purchases"),
                money_sum("revenue").alias("revenue"),
                F.round(money_sum("price") / F.count("price"), 6).alias("avg_price"),
                F.round(F.avg("rating_avg"), 6).alias("avg_rating"))
            .withColumn("view_to_purchase", safe_ratio("purchases", "views")))


def monthly_trend(sessions: DataFrame, purchases: DataFrame) -> DataFrame:
    """D7 + C4: sessions/conversions and orders/revenue per calendar month, with a
    row for every month between the first and last session month (empty months
    get zeros and a NULL rate). Purchases outside that span are dropped."""
    month = lambda c: F.to_date(F.date_trunc("month", F.col(c)))
    sm = (sessions.where(F.col("start_time").isNotNull())
          .groupBy(month("start_time").alias("month"))
          .agg(F.count(F.lit(1)).alias("sessions"),
               F.sum("is_converted").cast("bigint").alias("conversions")))
    pm = (purchases.where(F.col("order_date").isNotNull())
          .groupBy(month("order_date").alias("month"))
          .agg(F.count(F.lit(1)).alias("orders"), money_sum("total_amount").alias("revenue")))
    # The month spine is calendar-sized (a few hundred rows at most).
    spine = (sm.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
             .where(F.col("lo").isNotNull())
             .select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month")))
                     .alias("month")))
    t = spine.join(sm, "month", "left").join(pm, "month", "left")
    t = zero_fill_long(t, ["sessions", "conversions", "orders"])
    return t.select(
        "month", "sessions", "conversions", "orders",
        F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue"),
        safe_ratio("conversions", "sessions").alias("conversion_rate"))


def overview(users: DataFrame, products: DataFrame, sessions: DataFrame,
             interactions: DataFrame, purchases: DataFrame, reviews: DataFrame) -> DataFrame:
    """The headline KPI row. All inputs are narrowed, tagged and unioned so the
    whole row is one global aggregate (one pass, no joins); the average order value
    pre-aggregates orders by order_id first."""
    t = F.col("_t")
    orders = (purchases.groupBy("order_id")
              .agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("order_total")))
    parts = [
        users.select(F.lit("users").alias("_t")),
        products.select(F.lit("products").alias("_t"), "rating_avg"),
        sessions.select(F.lit("sessions").alias("_t"), "is_converted"),
        interactions.select(F.lit("interactions").alias("_t")),
        purchases.select(F.lit("purchases").alias("_t"),
                         F.col("total_amount").cast("decimal(18,2)").alias("amount")),
        orders.select(F.lit("orders").alias("_t"), "order_total"),
        reviews.select(F.lit("reviews").alias("_t"), "rating"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    return u.agg(
        F.count_if(t == "users").alias("total_users"),
        F.count_if(t == "products").alias("total_products"),
        F.count_if(t == "sessions").alias("total_sessions"),
        F.count_if(t == "interactions").alias("total_interactions"),
        F.count_if(t == "purchases").alias("total_purchases"),
        F.avg("is_converted").alias("conversion_rate"),
        F.sum("amount").cast("double").alias("total_revenue"),
        F.try_divide(F.sum("order_total").cast("double"),
                     F.count("order_total").cast("double")).alias("avg_order_value"),
        F.avg("rating").alias("avg_rating"),
        F.count("rating_avg").alias("rated_products"),
    )


def session_interaction_stats(interactions: DataFrame) -> DataFrame:
    """D9 (+ D2 in the same aggregate): per-session counts by type, events, distinct
    products, dwell sum/mean/max and first/last event time."""
    return (interactions.where(F.col("session_id").isNotNull())
            .groupBy("session_id").agg(
                *type_counts(),
                F.count(F.lit(1)).alias("n_interactions"),
                F.countDistinct("product_id").alias("n_products"),
                F.sum("dwell_time_ms").cast("bigint").alias("total_dwell_ms"),
                F.avg("dwell_time_ms").alias("mean_dwell_ms"),
                F.max("dwell_time_ms").cast("bigint").alias("max_dwell_ms"),
                F.min("timestamp").alias("first_ts"),
                F.max("timestamp").alias("last_ts")))


def with_prior_sessions(sessions: DataFrame, bucket: str = "hour") -> DataFrame:
    """Number of the user's earlier sessions (time order, session_id breaks ties)
    and the returning flag.

    Skew-safe two-level rank: a single window over ``user_id`` would put a bot-like
    user's whole history into one task. Instead sessions are numbered within
    (user, time bucket) groups, and each bucket's offset is the count of the user's
    sessions in earlier buckets, from a window over the small per-(user, bucket)
    count table (one row per active bucket). Session rows are shuffled once, by
    (user_id, bucket), for the window; the offset branch only moves the
    map-side-combined per-(user, bucket) counts."""
    b = F.date_trunc(bucket, F.col("start_time"))
    s = sessions.withColumn("_b", b)
    counts = s.groupBy("user_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    w_off = (Window.partitionBy("user_id").orderBy("_b")
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("user_id", "_b",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_local = Window.partitionBy("user_id", "_b").orderBy("start_time", "session_id")
    local = s.withColumn("_rn", F.row_number().over(w_local))
    out = local.join(offsets, ["user_id", "_b"], "left")
    prior = (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn") - 1).cast("bigint")
    return (out.withColumn("prior_sessions", prior)
            .withColumn("is_returning", flag(F.col("prior_sessions") > 0))
            .drop("_b", "_rn", "_off"))


SESSION_FEATURE_COLS = [
    "session_id", "user_id", "start_time", "device_type", "referrer_source",
    "is_converted", *TYPE_COUNT_COLS, "n_interactions", "n_products",
    "total_dwell_ms", "mean_dwell_ms", "max_dwell_ms", "duration_s", "net_cart",
    "net_wishlist", "hour", "day_of_week", "is_weekend", "prior_sessions",
    "is_returning", "loyalty_tier", "income_level", "age", "tenure_days"]


def session_features(sessions: DataFrame, interactions: DataFrame,
                     users: DataFrame) -> DataFrame:
    """The 29-column session table. Sessions without interactions keep NULL
    counts (the trainer zero-fills); nothing comes from purchases (a perfect leak)."""
    f = sessions.join(session_interaction_stats(interactions), "session_id", "left")
    f = f.withColumns({
        "duration_s": seconds_between("first_ts", "last_ts"),
        "net_cart": net("n_add_to_cart", "n_remove_from_cart"),
        "net_wishlist": net("n_add_to_wishlist", "n_remove_from_wishlist"),
        "hour": hour_of("start_time"),
        "day_of_week": day_of_week("start_time"),
    }).withColumn("is_weekend", is_weekend("day_of_week"))
    f = with_prior_sessions(f)
    u = users.select("user_id", "signup_date", "loyalty_tier", "income_level", "age")
    f = f.join(u, "user_id", "left")
    f = f.withColumn("tenure_days", tenure_days("start_time", "signup_date"))
    return f.select(*SESSION_FEATURE_COLS)
