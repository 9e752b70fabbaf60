"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through ``basketlab.sources.fixtures`` and
runs over them whole. Threshold parameters are fixed per query (the reference's
defaults suit its own data; the values used here are listed in FIXTURES.md §4).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketlab.operators import aggregates as agg
from basketlab.session import apply_job_conf
from basketlab.sources.fixtures import Shop

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_job_conf(spark)
            return fn(Shop(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def _cache_key(s: Shop):
    """Trained artifacts are reused per Spark application and input files."""
    return s.key


def product_stats_of(s: Shop) -> DataFrame:
    return s.landed("product_stats",
                    lambda: agg.product_stats(s.products, s.interactions, s.purchases))


def category_stats_of(s: Shop) -> DataFrame:
    return s.landed("category_stats", lambda: agg.category_stats(product_stats_of(s)))


# --- table layer ------------------------------------------------------------
for _t in ["users", "products", "sessions", "interactions", "purchases", "reviews"]:
    register(f"fx_{_t}")(lambda s, _t=_t: getattr(s, _t))


@register("event_counts_by_product")
def _(s):
    """Events per product and type."""
    return agg.event_counts(s.interactions, "product_id")


@register("event_counts_by_user")
def _(s):
    """D3: events per user and type."""
    return agg.event_counts(s.interactions, "user_id")


@register("purchases_by_product")
def _(s):
    """D4."""
    return agg.purchases_by_product(s.purchases)


@register("product_stats")
def _(s):
    """D5 (D1, D4, C1, B8, B9)."""
    return product_stats_of(s)


@register("category_stats")
def _(s):
    """D6."""
    return agg.category_stats(product_stats_of(s))


@register("monthly_trend")
def _(s):
    """D7, C4."""
    return agg.monthly_trend(s.sessions, s.purchases)


@register("overview")
def _(s):
    """D8."""
    return agg.overview(s.users, s.products, s.sessions, s.interactions, s.purchases,
                        s.reviews)


@register("session_interaction_stats")
def _(s):
    """D9, D2."""
    return agg.session_interaction_stats(s.interactions)


@register("session_features")
def _(s):
    """D10 (C2, C3, E1, B10–B13)."""
    return agg.session_features(s.sessions, s.interactions, s.users)


# --- recommender ------------------------------------------------------------
from basketlab.operators import recommender as rec  # noqa: E402
from basketlab.operators.joins import materialize  # noqa: E402


class _RecoModel:
    """The three recommender tables (weights, neighbours, bestsellers) of one
    folder; weights and neighbours are written as Parquet since every job reuses
    them. Trained once per folder and process, like a loaded model artifact."""

    def __init__(self, s: Shop):
        self.shop = s
        self.ui = materialize(rec.user_item_weights(s.interactions, s.purchases), "ui")
        self.neighbors = materialize(rec.top_neighbors(rec.item_similarity(self.ui)),
                                     "neighbors")
        self.best = rec.bestsellers(product_stats_of(s))


_RECO: dict = {}


def RecoModel(s: Shop) -> _RecoModel:  # noqa: N802
    key = _cache_key(s)
    if key not in _RECO:
        _RECO[key] = _RecoModel(s)
    return _RECO[key]


@register("feedback_events")
def _(s):
    """G1, B16."""
    return rec.feedback_events(s.interactions, s.purchases)


@register("user_item_weights")
def _(s):
    """D17 (B15, B17)."""
    return rec.user_item_weights(s.interactions, s.purchases)


@register("item_norms")
def _(s):
    """D18."""
    return rec.item_norms(rec.user_item_weights(s.interactions, s.purchases))


@register("item_cooccurrence")
def _(s):
    """Blocked Mᵀ·M."""
    return rec.item_cooccurrence(materialize(rec.user_item_weights(s.interactions,
                                                                   s.purchases)))


@register("item_similarity")
def _(s):
    """C9 + D18: cosine."""
    return rec.item_similarity(materialize(rec.user_item_weights(s.interactions,
                                                                 s.purchases)))


@register("top_neighbors")
def _(s):
    """E2."""
    return RecoModel(s).neighbors


@register("bestsellers")
def _(s):
    """F8."""
    return rec.bestsellers(product_stats_of(s))


@register("score_candidates")
def _(s):
    """C10, C11."""
    m = RecoModel(s)
    return rec.score_candidates(m.ui, m.neighbors).withColumn(
        "score", F.round(F.col("score").cast("double"), 9))


@register("recommendations")
def _(s):
    """F9 (C12, C13, E3, B26) for every user."""
    m = RecoModel(s)
    return rec.recommend_all(s.users, m.ui, m.neighbors, m.best, s.products, n=5)


@register("user_history")
def _(s):
    """E5."""
    return rec.user_history(rec.user_item_weights(s.interactions, s.purchases), s.products)


@register("matrix_density")
def _(s):
    """D19."""
    return rec.matrix_density(rec.user_item_weights(s.interactions, s.purchases), s.products)


@register("catalog_coverage")
def _(s):
    """Top-10 lists of a seeded 500-user sample."""
    m = RecoModel(s)
    sample = rec.coverage_sample(m.ui, 500)
    recs = rec.recommend_all(sample, m.ui, m.neighbors, m.best, s.products, n=10)
    return rec.catalog_coverage(recs, sample, s.products)


# --- audit ------------------------------------------------------------------
from pyspark.sql import functions as F  # noqa: E402

from basketlab.operators import audit  # noqa: E402
from basketlab.operators import results as res  # noqa: E402
from basketlab.sources import sinks  # noqa: E402

# Thresholds used on the fixture tables (FIXTURES.md §4: the reference's defaults
# of 100/50/20 views select nothing below sf0.1).
MIN_VIEWS = 15


@register("null_profile")
def _(s):
    """D20."""
    return audit.null_profile(s.all())


@register("event_vocabulary")
def _(s):
    """D21."""
    return audit.event_vocabulary(s.interactions)


@register("base_rate")
def _(s):
    """D22."""
    return audit.base_rate(s.sessions)


@register("conversion_by_cart_bucket")
def _(s):
    """D23 (C14, B18)."""
    return audit.conversion_by_cart_bucket(s.sessions, s.interactions)


@register("conversion_by_channel")
def _(s):
    """D24."""
    return audit.conversion_by(s.sessions)


@register("dwell_by_outcome")
def _(s):
    """D25 (C14)."""
    return audit.dwell_by_outcome(s.sessions, s.interactions)


@register("event_spread")
def _(s):
    """D26."""
    return audit.event_spread(s.interactions)


@register("coverage")
def _(s):
    """D27."""
    return audit.coverage(s.users, s.products, s.interactions)


@register("engagement_by_outcome")
def _(s):
    """D31."""
    return audit.engagement_by_outcome(s.sessions, s.interactions)


@register("column_ranges")
def _(s):
    """D32."""
    return audit.column_ranges(s.all())


@register("fk_orphans")
def _(s):
    """G2 (11 edges)."""
    return audit.fk_orphans(s.all())


@register("leak_check")
def _(s):
    """G3."""
    return audit.leak_check(s.sessions, s.purchases)


@register("reconcile_counts")
def _(s):
    """A3 + A4: write the six tables, read them back, compare row counts."""
    src = s.all()
    shop = sinks.TableSet(s.spark, sinks.scratch_table_dir(s.spark, "shop"))
    dst = shop.read(shop.publish(src))
    return audit.assert_reconciled(audit.reconcile_counts(src, dst))


# --- result sets --------------------------------------------------------------
@register("catalog")
def _(s):
    """F1."""
    return res.catalog(product_stats_of(s), limit=20)


@register("catalog_in_category")
def _(s):
    """F1 + B19 (category filter)."""
    return res.catalog(product_stats_of(s), category="SMALL", limit=15)


@register("top_viewed")
def _(s):
    """F2 (B21)."""
    return res.top_viewed(product_stats_of(s))


@register("leaky_products")
def _(s):
    """F3."""
    return res.leaky_products(product_stats_of(s), min_views=MIN_VIEWS, n=10)


@register("low_rated")
def _(s):
    """F4."""
    return res.low_rated(product_stats_of(s), max_rating=3, min_views=MIN_VIEWS, n=10)


@register("funnel_points")
def _(s):
    """F5 (B21)."""
    return res.funnel_points(product_stats_of(s), min_views=MIN_VIEWS)


@register("leaky_products_100")
def _(s):
    """F3 at the reference's own threshold."""
    return res.leaky_products(product_stats_of(s))


@register("low_rated_50")
def _(s):
    """F4 at the reference's own threshold."""
    return res.low_rated(product_stats_of(s), max_rating=3, min_views=50, n=10)


@register("funnel_points_20")
def _(s):
    """F5 at the reference's own threshold."""
    return res.funnel_points(product_stats_of(s), min_views=20)


@register("category_ranking")
def _(s):
    """F6."""
    return res.category_ranking(category_stats_of(s))


@register("trend")
def _(s):
    """F7 (B21)."""
    return res.trend(agg.monthly_trend(s.sessions, s.purchases))


def overview_of(s):
    return s.landed("overview", lambda: agg.overview(
        s.users, s.products, s.sessions, s.interactions, s.purchases, s.reviews))


@register("rated_products")
def _(s):
    """F10."""
    return res.rated_products(overview_of(s))


@register("kpi_cards")
def _(s):
    """F15."""
    return res.kpi_cards(overview_of(s))


@register("insights")
def _(s):
    """F11 (data rows)."""
    return res.insights(overview_of(s), category_stats_of(s), product_stats_of(s),
                        min_views=MIN_VIEWS)


@register("product_view_bars")
def _(s):
    """E6 over the F1 table."""
    return res.relative_to_max(res.catalog(product_stats_of(s), limit=15), "n_view",
                               "view_bar")


@register("category_shares")
def _(s):
    """Share of views and revenue per category."""
    c = category_stats_of(s).select("category", "views", "revenue")
    c = res.share_of_total(c, "views", "view_share")
    c = res.share_of_total(c, "revenue", "revenue_share")
    return c.withColumns({"view_share": F.round("view_share", 9),
                          "revenue_share": F.round("revenue_share", 9)})


@register("option_lists")
def _(s):
    """B22."""
    return res.option_lists(s.sessions, s.users)


@register("cold_users")
def _(s):
    """C7."""
    return res.cold_users(s.users, s.interactions)


def _review_user_ids(s):
    return s.reviews.select("user_id").distinct()


@register("known_review_users")
def _(s):
    """reviewers' ids checked against users (semi join)."""
    return res.known_ids(_review_user_ids(s), s.users)


@register("unknown_review_users")
def _(s):
    """C8 side output (anti join)."""
    return res.unknown_ids(_review_user_ids(s), s.users)


@register("active_users")
def _(s):
    """D28."""
    return res.active_users(s.interactions, min_events=12, n=8)


# --- segmentation -------------------------------------------------------------
from basketlab.operators import segmentation as seg  # noqa: E402
from basketlab.sources.fixtures import LOYALTY_TIERS  # noqa: E402


def user_features_of(s):
    return s.landed("user_features", lambda: seg.user_features(
        s.users, s.interactions, s.products, s.purchases, s.reviews, s.sessions))


def tier_labels(s):
    """Given labels for the label-driven operators: loyalty tier as 0..3."""
    tiers = F.array(*[F.lit(t) for t in LOYALTY_TIERS])
    return s.users.select("user_id", (F.array_position(tiers, F.col("loyalty_tier")) - 1)
                          .cast("bigint").alias("cluster"))


@register("user_features")
def _(s):
    """D16 (D3, D11–D15, C5, C6)."""
    return user_features_of(s)


@register("profile_by_loyalty_tier")
def _(s):
    """D29 + H20 on given labels (loyalty tier)."""
    f = user_features_of(s)
    prof = seg.segment_profiles(f, tier_labels(s))
    return seg.name_segments(prof, seg.population_means(f))


@register("silhouette_by_tier")
def _(s):
    """H17 on given labels: Euclidean silhouette of the standardized features,
    labelled by loyalty tier, on the seeded 5,000-user sample."""
    z = seg.standardize(user_features_of(s)).join(tier_labels(s), "user_id")
    return seg.silhouette(seg.seeded_sample(z, size=seg.SILHOUETTE_SAMPLE))


# --- conversion model -----------------------------------------------------------
from basketlab.operators import conversion as conv  # noqa: E402

# A run is trained once per input files and parameters, whichever session asks first
# (``sources.artifacts``); a session opens it once.
_RUNS: dict = {}


def session_features_of(s):
    return s.landed("session_features", lambda: agg.session_features(
        s.sessions, s.interactions, s.users))


def conversion_run(s) -> conv.ConversionRun:
    key = _cache_key(s)
    if key not in _RUNS:
        _RUNS[key] = conv.trained_run(session_features_of(s), s.files)
    return _RUNS[key]


REQUEST_FIELDS = ["n_view", "n_click", "n_add_to_cart", "n_remove_from_cart",
                  "n_add_to_wishlist", "n_remove_from_wishlist", "n_products",
                  "mean_dwell_ms", "max_dwell_ms", "duration_s", "hour", "day_of_week",
                  "prior_sessions", "tenure_days", "age", "device_type", "referrer_source",
                  "loyalty_tier", "income_level"]


def request_rows(s):
    """Each session's observable fields shaped like a scoring request (sessions
    without interactions leave their counts missing)."""
    return session_features_of(s).select("session_id", *REQUEST_FIELDS)


@register("conversion_split")
def _(s):
    """H1 (B14): split sizes per class."""
    d = conv.split(conv.model_input(session_features_of(s)))
    return d.groupBy("is_test", "label").agg(F.count(F.lit(1)).alias("n"))


@register("unlabelled_sessions")
def _(s):
    """Rows that train nothing: without a label or an id."""
    return conv.unlabelled_sessions(conv.model_input(session_features_of(s)))


@register("class_weights")
def _(s):
    """H7."""
    d = conv.split(conv.model_input(session_features_of(s)))
    return conv.class_weights(d.where(~F.col("is_test")))


@register("repaired_features")
def _(s):
    """H15 + B24 defaults on request-shaped rows."""
    valid, _rejected = conv.validate_sessions(request_rows(s))
    return conv.repair_features(valid)


@register("feature_row_validation")
def _(s):
    """Valid vs rejected request rows."""
    valid, rejected = conv.validate_sessions(request_rows(s))
    return (valid.select(F.lit("valid").alias("status"))
            .unionByName(rejected.select(F.lit("rejected").alias("status")))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


@register("feature_labels")
def _(s):
    """B23 over the model's input names (numeric names and one-hot names built
    from the categorical values present in the data)."""
    sf = session_features_of(s)
    onehot = None
    for c in conv.CATEGORICAL:
        part = sf.select(F.concat(F.lit(c + "_"), F.col(c)).alias("feature")).where(
            F.col(c).isNotNull())
        onehot = part if onehot is None else onehot.unionByName(part)
    numeric = s.spark.createDataFrame([(c,) for c in conv.NUMERIC], "feature string")
    names = onehot.unionByName(numeric).distinct()
    return names.select("feature", conv.feature_label("feature").alias("label"))


@register("conversion_metrics")
def _(s):
    """Contenders and ablation on the held-out split."""
    return conv.metrics_table(conversion_run(s))


@register("classification_report")
def _(s):
    """H8: per-class scorecard of the chosen model."""
    r = conversion_run(s)
    return conv.classification_report(conv.confusion(conv.scored(r.best_model, r.test)))


@register("roc_points")
def _(s):
    """H9: every 5th ROC point of the chosen model."""
    r = conversion_run(s)
    return conv.roc_points(conv.scored(r.best_model, r.test))


@register("feature_importance")
def _(s):
    """Top 15 importances of the chosen model, with labels."""
    r = conversion_run(s)
    imp = conv.importances(r.best_model, r.train)
    return (imp.where(F.col("rank") <= 15)
            .withColumn("label", conv.feature_label("feature")))


@register("conversion_scores")
def _(s):
    """H13 (+ H15): batch scoring of every session's repaired request row."""
    r = conversion_run(s)
    valid, _ = conv.validate_sessions(request_rows(s))
    return conv.score_sessions(conv.repair_features(valid), r.best_model, r.base_rate,
                               r.best_name)


@register("top_factors")
def _(s):
    """Five global factors with each session's values."""
    r = conversion_run(s)
    imp = conv.importances(r.best_model, r.train)
    valid, _ = conv.validate_sessions(request_rows(s))
    return conv.top_factors(conv.repair_features(valid), imp)


# --- segmentation model --------------------------------------------------------
_SEG: dict = {}


class SegmentationRun:
    def __init__(self, s: Shop):
        self.features = user_features_of(s)
        self.scaled = materialize(seg.standardize(self.features), "scaled")
        self.sweep, self.models = seg.trained_sweep(self.scaled, s.files)
        self.choice = seg.choose_k(self.sweep).first()
        model = self.models[self.choice["k"]]
        self.assign = materialize(model.transform(self.scaled).select("user_id", "cluster"),
                                  "assignments")
        prof = seg.segment_profiles(self.features, self.assign)
        self.segments = materialize(
            seg.name_segments(prof, seg.population_means(self.features)), "segments")


def segmentation_run(s) -> SegmentationRun:
    key = _cache_key(s)
    if key not in _SEG:
        _SEG[key] = SegmentationRun(s)
    return _SEG[key]


@register("segment_sweep")
def _(s):
    """Inertia and silhouette per k, chosen and rejected flags."""
    r = segmentation_run(s)
    return r.sweep.select(
        "k", "inertia", "silhouette",
        (F.col("k") == F.lit(r.choice["k"])).alias("chosen"),
        ((F.col("k") == F.lit(r.choice["global_k"])) & F.lit(r.choice["global_rejected"]))
        .alias("rejected"))


@register("segments")
def _(s):
    """Named segments by size."""
    return segmentation_run(s).segments.orderBy(F.col("size").desc(), "cluster")


@register("user_segments")
def _(s):
    """Every user's segment record."""
    r = segmentation_run(s)
    return seg.user_segments(r.assign, r.segments.select("cluster", "name", "description",
                                                         "size", "share"))


@register("segment_radar")
def _(s):
    """Radar axes divided by their maximum over segments."""
    return seg.radar(segmentation_run(s).segments)


@register("model_insights")
def _(s):
    """F11, model rows (needs both trained models)."""
    return res.model_insights(conv.metrics_table(conversion_run(s)),
                              segmentation_run(s).segments)


@register("model_report")
def _(s):
    """F14; the share of the catalog is taken over the lists of all users with history."""
    r = conversion_run(s)
    m = RecoModel(s)
    users = rec.matrix_users(m.ui)
    recs10 = rec.recommend_all(users, m.ui, m.neighbors, m.best, s.products, n=10)
    return res.model_report(conv.metrics_table(r), conv.importances(r.best_model, r.train)
                            .withColumn("label", conv.feature_label("feature")),
                            conv.classification_report(conv.confusion(
                                conv.scored(r.best_model, r.test))),
                            rec.matrix_density(m.ui, s.products),
                            rec.catalog_coverage(recs10, users, s.products), overview_of(s))


@register("recommendation_bundle")
def _(s):
    """recommendations + history + segment per user."""
    m = RecoModel(s)
    recs = rec.recommend_all(s.users, m.ui, m.neighbors, m.best, s.products, n=5)
    hist = rec.user_history(m.ui, s.products)
    segs = seg.user_segments(segmentation_run(s).assign, segmentation_run(s).segments)
    return res.recommendation_bundle(recs, hist, segs)


# --- sources, sinks, streaming, scalar functions --------------------------------
from basketlab.functions import scalars as fn  # noqa: E402
from basketlab.sources import raw as raw_src  # noqa: E402
from basketlab.streaming import scoring as stream_scoring  # noqa: E402
from pyspark.sql.types import StringType  # noqa: E402

DATE_OF = {"users": "signup_date", "sessions": "start_time", "interactions": "timestamp",
           "purchases": "order_date", "reviews": "review_date"}


@register("csv_roundtrip")
def _(s):
    """A1 (+ B1): export the six tables as CSV with timestamps as text, read them back
    with explicit schemas, clean, and report rows and time span (products: none) per table."""
    folder = sinks.scratch_table_dir(s.spark, "csv")
    tables = s.all()
    text = {n: df.withColumn(DATE_OF[n], F.date_format(DATE_OF[n], "yyyy-MM-dd HH:mm:ss.SSSSSS"))
            if n in DATE_OF else df for n, df in tables.items()}
    raw_src.write_csv(text, folder)
    schemas = {n: [(f.name, StringType() if f.name == DATE_OF.get(n) else f.dataType)
                   for f in df.schema.fields] for n, df in tables.items()}
    back = raw_src.clean_tables(raw_src.read_raw(s.spark, folder, schemas))
    at = {n: F.col(DATE_OF[n]) if n in DATE_OF else F.lit(None).cast("timestamp") for n in back}
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(at[n]).alias("first_ts"),
                    F.max(at[n]).alias("last_ts")).select(F.lit(n).alias("table"), "*")
             for n, df in back.items()]
    return audit.union_all(parts)



@register("streamed_scores")
def _(s):
    """H13 on a stream: request rows land as Parquet files, a Structured Streaming
    query (availableNow trigger, checkpointed) scores them into a Parquet sink."""
    r = conversion_run(s)
    base = sinks.scratch_table_dir(s.spark, "stream")
    rows = request_rows(s)
    rows.repartition(4).write.mode("overwrite").parquet(f"{base}/in")
    q = stream_scoring.start_scoring(s.spark, f"{base}/in", rows.schema, r.best_model,
                                     r.base_rate, r.best_name, f"{base}/out",
                                     f"{base}/checkpoint")
    q.awaitTermination()
    return s.spark.read.parquet(f"{base}/out").drop("batch")


@register("persisted_model_scores")
def _(s):
    """A5 + A6: save the chosen model and the metrics document, reload the model, and
    score every session with the reloaded one."""
    r = conversion_run(s)
    base = sinks.scratch_table_dir(s.spark, "models")
    conv.save_model(s.spark, r.best_model, f"{base}/conversion")
    sinks.write_metrics(conv.metrics_table(r), f"{base}/conversion_metrics")
    model = conv.load_model(s.spark, r.best_name, f"{base}/conversion")
    valid, _ = conv.validate_sessions(request_rows(s))
    return conv.score_sessions(conv.repair_features(valid), model, r.base_rate, r.best_name)


@register("text_functions")
def _(s):
    """B4, B6, B21 (short names), B25 (trim) over product names."""
    p = s.products
    return p.select("product_id", fn.first_line("product_name", 180).alias("blurb"),
                    fn.truncate("product_name", 6).alias("name_6"),
                    fn.short_name("product_name", 22).alias("name_22"),
                    fn.short_name("product_name", 34).alias("name_34"),
                    fn.trim(F.concat(F.lit(" \t"), F.col("brand"), F.lit("\n "))).alias("brand_key"))


@register("time_functions")
def _(s):
    """B1 (text -> timestamp, floored), B10, B11, B12, B21 month key over sessions."""
    text = F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return s.sessions.join(s.users.select("user_id", "signup_date"), "user_id", "left").select(
        "session_id", fn.parse_ts(text).alias("parsed"), fn.month_key("start_time").alias("month"),
        fn.hour_of("start_time").alias("hour"), fn.day_of_week("start_time").alias("dow"),
        fn.is_weekend(fn.day_of_week("start_time")).alias("weekend"),
        fn.seconds_between("signup_date", "start_time").alias("secs_since_signup"),
        fn.tenure_days("start_time", "signup_date").alias("tenure_days"))


@register("numeric_functions")
def _(s):
    """B9, B14, B15, B17, B18 over interactions."""
    i = s.interactions
    w = fn.event_weight("interaction_type")
    return i.select("interaction_id", w.alias("weight"),
                    fn.clip_low(w, 0.0).alias("weight_clipped"),
                    fn.to_number("interaction_type").alias("type_as_number"),
                    fn.clip(F.floor(F.col("dwell_time_ms") / 60000), 0, 4).cast("bigint")
                    .alias("dwell_bucket"),
                    fn.safe_ratio("dwell_time_ms", F.col("dwell_time_ms") - 500)
                    .alias("dwell_ratio"))


@register("review_functions")
def _(s):
    """B3, B7, B13, B16, B21 (percent) over reviews."""
    r = s.reviews
    return r.select("user_id", "product_id", "purchase_id", "rating",
                    fn.is_verified("purchase_id").alias("is_verified"),
                    fn.flag(F.col("rating") >= 4).alias("is_positive"),
                    fn.net("rating", F.lit(3)).alias("rating_vs_mid"),
                    fn.pct(F.col("rating") / 5.0, 1).alias("rating_pct"),
                    F.lit("purchase").alias("tag"))


# --- operators on given labels, scores and ids ---------------------------------
def given_scores(s):
    """Every session with its label and, as a given score, a hash of its id."""
    h = F.conv(F.substring(F.md5("session_id"), 1, 3), 16, 10).cast("double") / 4096
    return s.sessions.select("session_id", F.col("is_converted").cast("double").alias("label"),
                             h.alias("p")).withColumn(
        "pred", (F.col("p") >= conv.THRESHOLD).cast("double"))


@register("scorecard_on_given_scores")
def _(s):
    """H8: confusion counts, precision, recall and F1 of the given scores."""
    cm = conv.metrics_from_confusion(conv.confusion(given_scores(s)))
    return cm.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@register("report_on_given_scores")
def _(s):
    """H8: the per-class scorecard of the given scores."""
    rep = conv.classification_report(conv.confusion(given_scores(s)))
    return rep.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@register("auc_on_given_scores")
def _(s):
    """H8: exact area under the ROC curve of the given scores (many ties)."""
    return conv.roc_auc(given_scores(s)).select(F.round("roc_auc", 9).alias("roc_auc"))


@register("roc_on_given_scores")
def _(s):
    """H9: ROC points of the given scores."""
    return conv.roc_points(given_scores(s)).withColumns(
        {c: F.round(c, 9) for c in ("fpr", "tpr")})


@register("chosen_k_on_given_sweep")
def _(s):
    """H18 on a given sweep: the share of each k's users older than 40 stands for its
    silhouette (users dealt to k = 2..8 by id)."""
    sweep = s.users.groupBy((F.col("user_id") % 7 + 2).cast("int").alias("k")).agg(
        F.round(F.avg((F.col("age") > 40).cast("int")), 6).alias("silhouette"))
    return seg.choose_k(sweep)


@register("segments_by_tier")
def _(s):
    """C15 + F13 on given labels: every user's segment record, by loyalty tier."""
    f = user_features_of(s)
    named = seg.name_segments(seg.segment_profiles(f, tier_labels(s)), seg.population_means(f))
    return seg.user_segments(tier_labels(s), named.select("cluster", "name", "size"))


def requests_with_faults(s):
    """Request rows of which some are out of range: by the first hex digit of the
    session id's hash, f gets a day more, e a negative age, d both."""
    h = F.substring(F.md5("session_id"), 1, 1)
    return request_rows(s).withColumns({
        "hour": F.when(h.isin("f", "d"), F.col("hour") + 24).otherwise(F.col("hour")),
        "age": F.when(h.isin("e", "d"), F.lit(-1)).otherwise(F.col("age")).cast("bigint")})


@register("rejected_sessions")
def _(s):
    """Rejected request rows with their reasons."""
    return conv.validate_sessions(requests_with_faults(s))[1].select("session_id", "reason")


@register("recommendations_for_ids")
def _(s):
    """Lists for requested ids with white space around them, every tenth
    of them unknown."""
    u = F.col("user_id")
    ids = s.users.select(F.concat(
        F.lit(" \t"), F.when(u % 10 == 0, u + 1_000_000_000).otherwise(u).cast("string"),
        F.lit("\n")).alias("requested"))
    m = RecoModel(s)
    return rec.recommend_for(ids, s.users, m.ui, m.neighbors, m.best, s.products, n=5).select(
        fn.trim("requested").alias("requested"), "status", "rank", "product_id", "score",
        "strategy")


@register("reloaded_recommendations")
def _(s):
    """A5: save the recommender, load it again, and recommend with the loaded one."""
    m = RecoModel(s)
    base = sinks.scratch_table_dir(s.spark, "recommender")
    sinks.save_recommender(m.ui, m.neighbors, m.best, base)
    back = sinks.load_recommender(s.spark, base)
    return rec.recommend_all(s.users, back["weights"], back["neighbors"], back["bestsellers"],
                             s.products, n=5)


@register("reloaded_segments")
def _(s):
    """A5: save the chosen k-means model, load it again, and assign every user."""
    r = segmentation_run(s)
    base = sinks.scratch_table_dir(s.spark, "segments")
    r.models[r.choice["k"]].save(s.spark, base)
    return seg.CentersModel.load(s.spark, base).transform(r.scaled).select("user_id", "cluster")


@register("conversion_document")
def _(s):
    """The nested metrics document of the conversion model, written as JSON and
    read back (its ROC points are the table ``roc_points``)."""
    r = conversion_run(s)
    base = sinks.scratch_table_dir(s.spark, "document")
    doc = conv.metrics_document(r)
    sinks.write_metrics(doc, base)
    return s.spark.read.schema(doc.schema).json(base).select(
        F.to_json(F.struct("*")).alias("document"))


@register("segmentation_document")
def _(s):
    """The nested document of the segmentation (sweep, chosen and rejected k,
    segments), written as JSON and read back."""
    r = segmentation_run(s)
    base = sinks.scratch_table_dir(s.spark, "document")
    doc = seg.segmentation_document(r.sweep, seg.choose_k(r.sweep), r.segments)
    sinks.write_metrics(doc, base)
    return s.spark.read.schema(doc.schema).json(base).select(
        F.to_json(F.struct("*")).alias("document"))


@register("document_text_functions")
def _(s):
    """B4, B6 over real multi-line text: first line (180 characters) and the first 400
    characters of every document."""
    d = s.spark.read.parquet(f"{s.sf_dir}/documents.parquet").select("doc_id", "text")
    return d.select("doc_id", fn.first_line("text", 180).alias("blurb"),
                    fn.truncate("text", 400).alias("review_text"))


@register("csv_free_text")
def _(s):
    """A1, B4-B6 on free text: every document as a product description and a review,
    exported as CSV with line breaks in the fields, read back and cleaned."""
    d = s.spark.read.parquet(f"{s.sf_dir}/documents.parquet").select("doc_id", "text", "source")
    folder = sinks.scratch_table_dir(s.spark, "csv-text")
    raw_src.write_csv({
        "products": d.select(F.col("doc_id").cast("string").alias("product_id"),
                             F.col("text").alias("product_description"),
                             F.concat(F.lit(" \t"), F.col("source")).alias("category")),
        "reviews": d.select(F.col("doc_id").cast("string").alias("review_id"),
                            F.col("text").alias("review_text"))}, folder)
    schemas = {"products": [(c, StringType()) for c in
                            ("product_id", "product_description", "category")],
               "reviews": [(c, StringType()) for c in ("review_id", "review_text")]}
    back = raw_src.clean_tables(raw_src.read_raw(s.spark, folder, schemas))
    return back["products"].join(back["reviews"],
                                 F.col("product_id") == F.col("review_id")).select(
        F.col("product_id").cast("bigint").alias("product_id"), "category", "blurb", "review_text")
