"""Result sets read by dashboards and reports (F rows)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaky_products(pstats: DataFrame, min_views: int = 100, n: int = 10) -> DataFrame:
    """heavily viewed products with the lowest view-to-purchase ratio."""
    return (pstats.where((F.col("n_view") >= min_views) & F.col("view_to_purchase").isNotNull())
            .orderBy(F.col("view_to_purchase").asc(), F.col("product_id").asc())
            .limit(n)
            .select("product_id", "product_name", "category", "n_view", "n_purchases",
                    "view_to_purchase"))


# ---------------------------------------------------------------------------
from basketlab.functions.scalars import bubble_size, month_key, pct, short_name  # noqa: E402

CATALOG_COLS = ["product_id", "product_name", "category", "brand", "price", "rating_avg",
                "review_count", "n_view", "n_purchases", "revenue", "view_to_purchase"]


def catalog(pstats: DataFrame, category: str | None = None, limit: int = 20,
            must_exist: bool = False) -> DataFrame:
    """F1 (+ B19): products by revenue, then views; optional category filter. An
    unknown category gives an empty result, or with ``must_exist`` an error (one row is
    looked for). A limit outside 1..200 is an error."""
    if not 1 <= int(limit) <= 200:
        raise ValueError(f"limit must be between 1 and 200, not {limit}")
    if category and must_exist and pstats.where(F.col("category") == F.lit(category)).isEmpty():
        raise LookupError(f"no products in category {category!r}")
    df = pstats.where(F.col("category") == F.lit(category)) if category else pstats
    return (df.select(*[c for c in CATALOG_COLS if c in pstats.columns])
            .orderBy(F.col("revenue").desc(), F.col("n_view").desc(), F.col("product_id"))
            .limit(limit))


def top_viewed(pstats: DataFrame, n: int = 12) -> DataFrame:
    """most viewed products; purchases scaled x20 for the shared chart axis."""
    return (pstats.orderBy(F.col("n_view").desc(), F.col("product_id")).limit(n)
            .select("product_id", "product_name", "category", "n_view", "n_purchases",
                    (F.col("n_purchases") * 20).alias("purchases_x20"),
                    short_name("product_name", 22).alias("label")))


def low_rated(pstats: DataFrame, max_rating: float = 3, min_views: int = 50,
              n: int = 10) -> DataFrame:
    """rated at most ``max_rating`` yet viewed at least ``min_views`` times."""
    return (pstats.where(F.col("rating_avg").isNotNull() & (F.col("rating_avg") <= max_rating)
                         & (F.col("n_view") >= min_views))
            .orderBy(F.col("n_view").desc(), F.col("product_id")).limit(n)
            .select("product_id", "product_name", "category", "rating_avg", "review_count",
                    "n_view"))


def funnel_points(pstats: DataFrame, min_views: int = 20) -> DataFrame:
    """F5 (+ B21): scatter points with bubble size and colour from revenue."""
    return (pstats.where((F.col("n_view") >= min_views) & F.col("view_to_purchase").isNotNull())
            .select("product_id", "product_name", "n_view", "view_to_purchase", "revenue",
                    bubble_size("revenue").alias("size"),
                    F.coalesce(F.col("revenue"), F.lit(0.0)).alias("color")))


def category_ranking(cstats: DataFrame) -> DataFrame:
    """categories by revenue (rank), with the conversion percent for the chart,
    flags for the best-revenue and worst-converting category."""
    best = cstats.agg(F.max_by("category", F.struct("revenue", F.col("category")))
                      .alias("_best"))
    worst = (cstats.where(F.col("view_to_purchase").isNotNull())
             .agg(F.min_by("category", F.struct("view_to_purchase", F.col("category")))
                  .alias("_worst")))
    w = Window.orderBy(F.col("revenue").desc(), F.col("category"))  # catalog categories
    return (cstats.join(F.broadcast(best), how="inner", on=F.lit(True))
            .join(F.broadcast(worst), how="left", on=F.lit(True))
            .select(F.row_number().over(w).cast("bigint").alias("rank"), "category",
                    F.round("revenue", 2).alias("revenue"), "views",
                    pct("view_to_purchase", 3).alias("conversion_pct"),
                    (F.col("category") == F.col("_best")).alias("is_best_revenue"),
                    F.coalesce(F.col("category") == F.col("_worst"), F.lit(False))
                    .alias("is_worst_conversion")))


def trend(mtrend: DataFrame) -> DataFrame:
    """F7 (+ B21): month key text and conversion percent, in month order."""
    return (mtrend.orderBy("month")
            .select(month_key("month").alias("month_key"), "sessions", "orders", "revenue",
                    pct("conversion_rate", 2).alias("conversion_pct")))


def rated_products(ov: DataFrame) -> DataFrame:
    """rated vs unrated catalog products."""
    return ov.select("rated_products", "total_products",
                     (F.col("total_products") - F.col("rated_products")).alias("unrated_products"))


# KPI card labels and sub-labels.
KPI_CARDS = [
    ("Shoppers", "total_users", "signed up"),
    ("Products", "total_products", "in the catalog"),
    ("Store visits", "total_sessions", "in the last year"),
    ("Shopper actions", "total_interactions", "views, clicks, cart adds"),
    ("Items bought", "total_purchases", "across all orders"),
    ("Visits that buy", "conversion_rate", "of all store visits"),
    ("Average order", "avg_order_value", "spent per order"),
    ("Average rating", "avg_rating", "out of 5 stars"),
]


def kpi_cards(ov: DataFrame) -> DataFrame:
    """the overview row unpivoted to (position, label, value, sub) with the
    percent card scaled to percent and all values rounded to two places."""
    parts = []
    for i, (label, col, sub) in enumerate(KPI_CARDS, start=1):
        v = F.col(col).cast("double")
        if col == "conversion_rate":
            v = v * 100
        parts += [F.lit(i), F.lit(label), F.round(v, 2), F.lit(sub)]
    return ov.select(F.inline(F.array(*[F.struct(
        parts[k].alias("position"), parts[k + 1].alias("label"), parts[k + 2].alias("value"),
        parts[k + 3].alias("sub")) for k in range(0, len(parts), 4)])))


def relative_to_max(df: DataFrame, col: str, out: str, scale: float = 100.0,
                    digits: int = 1) -> DataFrame:
    """Value as a share of the column maximum (a zero maximum divides by 1).
    The maximum is one global aggregate joined back as a one-row broadcast."""
    mx = df.agg(F.max(col).alias("_mx"))
    denom = F.coalesce(F.when(F.col("_mx") != 0, F.col("_mx")), F.lit(1))
    return (df.join(F.broadcast(mx), how="inner", on=F.lit(True))
            .withColumn(out, F.round(F.col(col) / denom * scale, digits)).drop("_mx"))


def share_of_total(df: DataFrame, col: str, out: str) -> DataFrame:
    """Value / column total (one global aggregate, broadcast back)."""
    tot = df.agg(F.sum(col).alias("_tot"))
    return (df.join(F.broadcast(tot), how="inner", on=F.lit(True))
            .withColumn(out, F.try_divide(F.col(col).cast("double"),
                                          F.col("_tot").cast("double")))
            .drop("_tot"))


def option_lists(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sorted distinct values of the four categorical model inputs."""
    parts = [sessions.select(F.lit(c).alias("field"), F.col(c).alias("value"))
             for c in ("device_type", "referrer_source")]
    parts += [users.select(F.lit(c).alias("field"), F.col(c).alias("value"))
              for c in ("loyalty_tier", "income_level")]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def cold_users(users: DataFrame, interactions: DataFrame) -> DataFrame:
    """Users with no interactions (anti join, NULL-safe unlike NOT IN)."""
    return users.select("user_id").join(interactions.select("user_id"), "user_id", "left_anti")


def known_ids(ids: DataFrame, users: DataFrame) -> DataFrame:
    """Requested ids that exist."""
    return ids.join(users.select("user_id"), "user_id", "left_semi")


def unknown_ids(ids: DataFrame, users: DataFrame) -> DataFrame:
    """C8 side output: requested ids with no user row."""
    return ids.join(users.select("user_id"), "user_id", "left_anti")


def active_users(interactions: DataFrame, min_events: int = 12, n: int = 8) -> DataFrame:
    """Most active users with at least ``min_events`` interactions."""
    return (interactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_events)
            .orderBy(F.col("n").desc(), F.col("user_id")).limit(n))


def _thousands(c) -> F.Column:
    return F.format_number(c, 0)


def insights(ov: DataFrame, cstats: DataFrame, pstats: DataFrame,
             min_views: int = 100) -> DataFrame:
    """F11, data rows: (position, kind, headline, detail) for overall conversion,
    the best/worst category and the three leakiest high-traffic products. All
    inputs are one-row or catalog-sized; the texts are fixed templates."""
    conv = ov.select(
        F.lit(1).alias("position"), F.lit("conversion").alias("kind"),
        F.concat(F.lit("Overall conversion sits at "),
                 F.format_string("%.2f%%", F.col("conversion_rate") * 100)).alias("headline"),
        F.concat(_thousands("total_purchases"), F.lit(" purchases across "),
                 _thousands("total_sessions"), F.lit(" sessions, generating $"),
                 _thousands("total_revenue"), F.lit(".")).alias("detail"))
    best = cstats.agg(F.max_by(F.struct("category", "revenue"),
                               F.struct("revenue", F.col("category"))).alias("b"))
    worst = (cstats.where(F.col("view_to_purchase").isNotNull())
             .agg(F.min_by(F.struct("category", "view_to_purchase"),
                           F.struct("view_to_purchase", F.col("category"))).alias("w")))
    cat = best.join(worst, how="inner", on=F.lit(True)).select(
        F.lit(2).alias("position"), F.lit("category").alias("kind"),
        F.concat(F.col("b.category"), F.lit(" leads revenue at $"),
                 _thousands(F.col("b.revenue"))).alias("headline"),
        F.concat(F.lit("Lowest view-to-purchase category is "), F.col("w.category"),
                 F.lit(" at "),
                 F.format_string("%.3f%%", F.col("w.view_to_purchase") * 100),
                 F.lit(".")).alias("detail"))
    leaky = leaky_products(pstats, min_views=min_views, n=3).select(
        F.struct("view_to_purchase", "product_id",
                 F.concat(F.col("product_name"), F.lit(" ("), _thousands("n_view"),
                          F.lit(" views → "), F.col("n_purchases").cast("string"),
                          F.lit(" purchases)")).alias("t")).alias("s"))
    leak = leaky.agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")),
                                              lambda x: x["t"]), "; ").alias("detail")).select(
        F.lit(3).alias("position"), F.lit("funnel_leak").alias("kind"),
        F.lit("High-traffic products converting near zero").alias("headline"), "detail")
    return conv.unionByName(cat).unionByName(leak)


def recommendation_bundle(recs: DataFrame, history: DataFrame, segments: DataFrame) -> DataFrame:
    """per user, the ordered recommendation list, history list (both at most
    n entries) and segment name, as one row."""
    r = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "product_id", "product_name", "score", "reason"))).alias("recommendations"),
        F.first("strategy").alias("strategy"))
    h = history.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", "product_id", "product_name", "weight"))).alias("history"))
    seg = segments.select("user_id", F.col("name").alias("segment"))
    return r.join(h, "user_id", "left").join(seg, "user_id", "left")


def model_insights(metrics: DataFrame, segments: DataFrame) -> DataFrame:
    """F11, model rows: the cart-signal finding and, when present, the Heavy
    Browsers segment (fixed templates over one-row inputs)."""
    best = metrics.where(F.col("chosen")).select(
        F.col("roc_auc").alias("auc"), F.col("f1").alias("f1"))
    abl = metrics.where(F.col("role") == "ablation").select(F.col("f1").alias("abl_f1"))
    model = best.join(abl, how="inner", on=F.lit(True)).select(
        F.lit(4).alias("position"), F.lit("model").alias("kind"),
        F.concat(F.lit("Cart activity drives conversion prediction (ROC-AUC "),
                 F.format_string("%.3f", "auc"), F.lit(")")).alias("headline"),
        F.concat(F.lit("Removing cart features drops F1 from "), F.format_string("%.3f", "f1"),
                 F.lit(" to "), F.format_string("%.3f", "abl_f1"),
                 F.lit(" — the signal is concentrated in add-to-cart behaviour.")).alias("detail"))
    hb = segments.where(F.col("name") == "Heavy Browsers").limit(1).select(
        F.lit(5).alias("position"), F.lit("segment").alias("kind"),
        F.concat(F.format_number("size", 0), F.lit(" users are Heavy Browsers ("),
                 F.format_string("%.1f%%", F.col("share") * 100), F.lit(" of base)"))
        .alias("headline"),
        F.concat(F.lit("They average "), F.format_string("%.1f", "n_views"),
                 F.lit(" views but only "), F.format_string("%.2f", "n_purchases"),
                 F.lit(" purchases — the largest untapped conversion pool.")).alias("detail"))
    return model.unionByName(hb)


def _long(df: DataFrame, section: str, items: list[tuple[str, str]]) -> DataFrame:
    """One (section, item, value, label) row per listed column of a one-row frame."""
    return df.select(F.inline(F.array(*[F.struct(
        F.lit(section).alias("section"), F.lit(c).alias("item"),
        F.col(c).cast("double").alias("value"), F.lit(label).alias("label"))
        for c, label in items])))


def model_report(metrics: DataFrame, importances: DataFrame, scorecard: DataFrame,
                 density: DataFrame, coverage: DataFrame, overview: DataFrame) -> DataFrame:
    """F14 as a long (section, item, value, label) table: full vs ablated metrics,
    right/wrong totals, per-class scorecard, top-12 importances, and what the
    recommender covers (users with history and cold users with their shares, items,
    catalog share)."""
    best = metrics.where(F.col("chosen"))
    names = [("roc_auc", "ROC-AUC"), ("precision", "precision"), ("recall", "recall"), ("f1", "F1")]
    matrix = best.select((F.col("tn") + F.col("tp")).alias("right"),
                         (F.col("fp") + F.col("fn")).alias("wrong"))
    cards = scorecard.where(F.col("class").isin("converted", "not converted")).select(
        F.explode(F.array(*[F.struct(
            F.lit("scorecard").alias("section"),
            F.concat_ws(": ", "class", F.lit(c)).alias("item"),
            F.col(c).cast("double").alias("value"), F.col("class").alias("label"))
            for c in ("precision", "recall", "f1", "support")])).alias("x")).select("x.*")
    users = density.select(F.col("n_users").alias("users_with_history"), F.col("n_items").alias("items")
                           ).join(F.broadcast(overview.select("total_users")), how="inner", on=F.lit(True))
    cold = F.col("total_users") - F.col("users_with_history")
    users = users.withColumns({
        "user_share": F.try_divide(F.col("users_with_history").cast("double"),
                                   F.col("total_users").cast("double")),
        "cold_users": cold,
        "cold_share": F.try_divide(cold.cast("double"), F.col("total_users").cast("double"))})
    parts = [
        _long(best, "full", names), _long(metrics.where(F.col("role") == "ablation"), "ablated", names),
        _long(matrix, "matrix", [("right", "correct predictions"), ("wrong", "wrong predictions")]),
        cards,
        importances.where(F.col("rank") <= 12).select(
            F.lit("importance").alias("section"), F.col("feature").alias("item"),
            F.col("importance").alias("value"), "label"),
        _long(users, "coverage", [
            ("users_with_history", "users in the matrix"), ("user_share", "share of all users"),
            ("cold_users", "users without history"), ("cold_share", "share of all users"),
            ("items", "items in the catalog")]),
        _long(coverage, "coverage", [("catalog_share", "catalog reachable in top-10 lists")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
