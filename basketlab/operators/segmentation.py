"""Behavioural segmentation of every user: features, k sweep, silhouette, naming.

* ``user_features`` tags and unions the narrow per-table projections and runs ONE
  ``groupBy(user_id)`` over them (one shuffle of the facts, map-side combined)
  instead of six aggregates and six joins; the users table is joined once.
* Scaling uses population statistics from one global aggregate.
* k-means runs all (k, restart) center sets of a sweep in the same passes (``kmeans``),
  keeping the least inertia of each k.
* The Euclidean silhouette is exact on a seeded sample whose size is a parameter
  (5,000 by default, as in the reference): the sample is broadcast once (its size
  is bounded by construction) and every task scores its share of sample points
  against it with numpy, so no pair rows are ever materialised.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.operators.joins import materialize
from basketlab.operators.kmeans import CentersModel, batched_kmeans
from basketlab.session import release
from basketlab.sources.artifacts import ArtifactStore

# The twelve segmentation inputs, in order.
FEATURES = ["n_views", "n_clicks", "n_cart_adds", "n_wishlist_adds", "n_purchases",
            "total_spend", "avg_order_value", "n_reviews", "avg_rating_given",
            "category_diversity", "n_sessions", "conversion_rate"]
K_RANGE = range(2, 9)
SILHOUETTE_SAMPLE = 5000

# Segment names and descriptions, rule order = precedence.
SEGMENT_TEXT = {
    "Dormant Signups": "Registered but never browsed — zero sessions, zero interactions",
    "High-Value Buyers": "Convert often at above-average order values — the revenue core",
    "Converting Regulars": "Buy steadily at typical basket sizes",
    "Heavy Browsers": "High engagement, little conversion — the biggest untapped upside",
    "Wishlist Collectors": "Save intent heavily but rarely check out",
    "Low-Touch Visitors": "Brief, shallow sessions with minimal engagement",
    "Casual Shoppers": "Moderate browsing, occasional purchase",
}


# D3, D11–D16, C5, C6 -----------------------------------------------------------
def user_features(users: DataFrame, interactions: DataFrame, products: DataFrame,
                  purchases: DataFrame, reviews: DataFrame, sessions: DataFrame) -> DataFrame:
    """The 12 per-user features for every user. Missing activity is 0; a user
    without reviews gets the mean of the reviewers' average ratings."""
    cats = products.select("product_id", "category")
    key_t = users.schema["user_id"].dataType
    it = interactions.join(cats, "product_id", "left").select(
        "user_id", F.lit("i").alias("_t"), "interaction_type", "category")
    orders = (purchases.groupBy("user_id", "order_id")
              .agg(F.sum(F.col("total_amount").cast("decimal(18,2)")).alias("order_total")))
    parts = [
        it,
        purchases.select("user_id", F.lit("p").alias("_t"),
                         F.col("total_amount").cast("decimal(18,2)").alias("amount")),
        orders.select("user_id", F.lit("o").alias("_t"), "order_total"),
        reviews.select("user_id", F.lit("r").alias("_t"), "rating"),
        sessions.select("user_id", F.lit("s").alias("_t"), "is_converted"),
    ]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    t, it_ = F.col("_t"), F.col("interaction_type")
    per = (u.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count_if((t == "i") & (it_ == "view")).alias("n_views"),
        F.count_if((t == "i") & (it_ == "click")).alias("n_clicks"),
        F.count_if((t == "i") & (it_ == "add_to_cart")).alias("n_cart_adds"),
        F.count_if((t == "i") & (it_ == "add_to_wishlist")).alias("n_wishlist_adds"),
        F.count_if(t == "p").alias("n_purchases"),
        F.sum("amount").cast("double").alias("total_spend"),
        F.try_divide(F.sum("order_total").cast("double"),
                     F.count("order_total").cast("double")).alias("avg_order_value"),
        F.count_if(t == "r").alias("n_reviews"),
        F.avg("rating").alias("avg_rating_given"),
        F.countDistinct(F.when(t == "i", F.col("category"))).alias("category_diversity"),
        F.count_if(t == "s").alias("n_sessions"),
        F.avg("is_converted").alias("conversion_rate")))
    f = users.select(F.col("user_id").cast(key_t)).join(per, "user_id", "left")
    # mean of the users' own average ratings, from the reviews branch alone
    fill = (reviews.where(F.col("user_id").isNotNull()).groupBy("user_id")
            .agg(F.avg("rating").alias("r"))
            .join(users.select("user_id"), "user_id", "left_semi")
            .agg(F.avg("r").alias("_fill")))
    f = f.join(F.broadcast(fill), how="inner", on=F.lit(True))
    counts = ["n_views", "n_clicks", "n_cart_adds", "n_wishlist_adds", "n_purchases",
              "n_reviews", "category_diversity", "n_sessions"]
    out = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts}
    out.update({c: F.coalesce(F.col(c), F.lit(0.0))
                for c in ["total_spend", "avg_order_value", "conversion_rate"]})
    out["avg_rating_given"] = F.round(F.coalesce(F.col("avg_rating_given"), F.col("_fill"),
                                                 F.lit(0.0)), 9)
    return f.withColumns(out).select("user_id", *FEATURES)


# H2 --------------------------------------------------------------------------
def standardize(df: DataFrame, cols=FEATURES, out: str = "features") -> DataFrame:
    """(x - mean) / population std per column (a zero std leaves the centred
    value), assembled into a vector column. Statistics: one global aggregate."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols],
                   *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    j = df.join(F.broadcast(stats), how="inner", on=F.lit(True))
    scaled = {f"_z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(
        F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")), F.lit(1.0)) for c in cols}
    j = j.withColumns(scaled)
    va = VectorAssembler(inputCols=[f"_z_{c}" for c in cols], outputCol=out)
    return va.transform(j).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols],
                                *[f"_z_{c}" for c in cols])


# H17 -------------------------------------------------------------------------
def seeded_sample(df: DataFrame, key: str = "user_id", size: int = SILHOUETTE_SAMPLE):
    """``size`` rows with the smallest md5 of the key: reproducible, engine-neutral."""
    return (df.withColumn("_h", F.md5(F.col(key).cast("string")))
            .orderBy("_h", key).limit(size).drop("_h"))


def silhouettes(points: DataFrame, labels: list[str], features: str = "features",
                key: str = "user_id", max_points: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """Mean Euclidean silhouette of ``points`` (a bounded sample) under each of the label
    columns; singletons score 0. One row (label, silhouette, n) a column (none without
    points). All columns are scored by the same job from the same distances: the plans and
    code of a job a column would stay in the driver."""
    pts = points.select(key, F.array(*[F.col(c).cast("bigint") for c in labels]).alias("_l"),
                        vector_to_array(features).alias("_x"))
    spark = points.sparkSession
    ref = pts.limit(max_points + 1).toPandas()
    if len(ref) > max_points:
        raise ValueError(f"silhouette sample exceeds {max_points} rows")
    if ref.empty:
        return spark.createDataFrame([], "label string, silhouette double, n bigint")
    numbers = lambda arrays: np.array(arrays.tolist(), np.float64)
    bc = spark.sparkContext.broadcast((numbers(ref["_x"]), numbers(ref["_l"])))

    def score(batches):
        X_all, lab = bc.value
        groups = []
        for i in range(lab.shape[1]):
            uniq = np.unique(lab[:, i])
            members = [lab[:, i] == c for c in uniq]
            groups.append((uniq, members, np.array([m.sum() for m in members])))
        for pdf in batches:
            for lo in range(0, len(pdf), 64):  # 64 x n_sample x dims per step
                chunk = pdf.iloc[lo:lo + 64]
                xs = np.vstack(chunk["_x"].to_numpy())
                d = np.sqrt(((xs[:, None, :] - X_all[None, :, :]) ** 2).sum(-1))
                mine, rows = numbers(chunk["_l"]), np.arange(len(xs))
                for i, (uniq, members, counts) in enumerate(groups):
                    sums = np.stack([d[:, m].sum(1) for m in members], axis=1)
                    own = np.searchsorted(uniq, mine[:, i])
                    n_own = counts[own]
                    a = sums[rows, own] / np.maximum(n_own - 1, 1)
                    if len(uniq) > 1:
                        means = sums / counts[None, :]
                        means[rows, own] = np.inf
                        b = means.min(1)
                        den = np.maximum(a, b)
                        s = np.where((n_own > 1) & (den > 0), (b - a) / np.where(den > 0, den, 1),
                                     0.0)
                    else:
                        s = np.zeros(len(xs))
                    yield pd.DataFrame({"label": labels[i], "s": s})

    per_point = pts.repartition(max(1, min(64, len(ref) // 256 + 1))).mapInPandas(
        score, schema="label string, s double")
    return per_point.groupBy("label").agg(F.round(F.avg("s"), 6).alias("silhouette"),
                                          F.count(F.lit(1)).alias("n"))


def silhouette(points: DataFrame, label: str = "cluster", features: str = "features",
               key: str = "user_id", max_points: int = SILHOUETTE_SAMPLE) -> DataFrame:
    """Mean Euclidean silhouette of ``points`` (a bounded sample). Singletons
    score 0. Returns one row (silhouette, n)."""
    one = silhouettes(points, [label], features, key, max_points)
    return one.agg(F.max("silhouette").alias("silhouette"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


# H16 / H18 / H19 ---------------------------------------------------------------
def k_sweep(scaled: DataFrame, ks=K_RANGE, restarts: int = 10, seed: int = 42,
            sample_size: int = SILHOUETTE_SAMPLE):
    """Fit every k (best of ``restarts`` seeded starts, all in the same passes), inertia +
    silhouette on the seeded sample. Returns (sweep DataFrame, {k: model})."""
    spark = scaled.sparkSession
    # every pass reads the points: files enough for all cores, however few megabytes they are
    points = materialize(scaled.select(
        F.xxhash64("user_id").alias("key"), vector_to_array("features").alias("x")).repartition(
        2 * spark.sparkContext.defaultParallelism), "points")
    best, _ = batched_kmeans(points, list(ks), restarts, seed)
    release(spark)
    sample = materialize(seeded_sample(scaled.select("user_id", "features"), size=sample_size), "sample")
    models = {k: CentersModel(best[k].centers) for k in ks}
    for k in ks:
        sample = models[k].transform(sample, out=f"cluster_{k}")
    # one row a k; the labels are written, as the sample is read twice
    found = {r["label"]: r["silhouette"] for r in silhouettes(
        materialize(sample, "labelled"), [f"cluster_{k}" for k in ks], max_points=sample_size).collect()}
    sweep = spark.createDataFrame([(k, float(best[k].cost), found.get(f"cluster_{k}")) for k in ks],
                                  "k int, inertia double, silhouette double")
    return sweep, models


# Part of a sweep's address; to be raised when fitting gives other centers.
VERSION = 1


def trained_sweep(scaled: DataFrame, files, store: ArtifactStore | None = None, ks=K_RANGE,
                  restarts: int = 10, seed: int = 42):
    """The sweep of these inputs and its models, from the artifact store or fitted now
    (A5). ``files`` names the input that the features follow from."""
    spark = scaled.sparkSession
    store = store or ArtifactStore(spark)
    address = store.digest(version=VERSION, files=files, features=FEATURES, ks=list(ks),
                           restarts=restarts, seed=seed, sample=SILHOUETTE_SAMPLE)

    def fit(path: str) -> None:
        sweep, models = k_sweep(scaled, ks, restarts, seed)
        sweep.coalesce(1).write.mode("overwrite").parquet(f"{path}/sweep")
        for k, model in models.items():
            model.save(spark, f"{path}/centers-{k}")

    path = store.get("segments", address, fit)
    return (spark.read.parquet(f"{path}/sweep"),
            {k: CentersModel.load(spark, f"{path}/centers-{k}") for k in ks})


def choose_k(sweep: DataFrame, min_k: int = 3) -> DataFrame:
    """Best silhouette among k >= min_k; the global best is reported alongside and
    flagged rejected when it is below min_k."""
    best = sweep.where(F.col("k") >= min_k).agg(
        F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"),
        F.max("silhouette").alias("silhouette"))
    glob = sweep.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("global_k"),
                     F.max("silhouette").alias("global_silhouette"))
    return best.join(glob, how="inner", on=F.lit(True)).withColumn(
        "global_rejected", F.col("global_k") < min_k)


# D29 -------------------------------------------------------------------------
def segment_profiles(features: DataFrame, assignments: DataFrame,
                     label: str = "cluster") -> DataFrame:
    """Mean of the 12 features per cluster, size and share (one aggregate + one
    global total)."""
    j = features.join(assignments.select("user_id", label), "user_id")
    prof = j.groupBy(label).agg(*[F.round(F.avg(c), 9).alias(c) for c in FEATURES],
                                F.count(F.lit(1)).alias("size"))
    tot = prof.agg(F.sum("size").alias("_n"))
    return (prof.join(F.broadcast(tot), how="inner", on=F.lit(True))
            .withColumn("share", F.col("size") / F.col("_n")).drop("_n"))


def population_means(features: DataFrame) -> DataFrame:
    return features.agg(*[F.round(F.avg(c), 9).alias(f"o_{c}") for c in FEATURES])


# H20 -------------------------------------------------------------------------
def name_segments(profiles: DataFrame, overall: DataFrame, label: str = "cluster"):
    """First matching rule names the segment; a repeated name gets " II" per
    earlier holder (cluster order)."""
    p, o = F.col, lambda c: F.col(f"o_{c}")
    name = (F.when((p("n_sessions") == 0) & (p("n_views") == 0), "Dormant Signups")
            .when((p("n_purchases") >= o("n_purchases") * 2)
                  & (p("avg_order_value") >= o("avg_order_value")), "High-Value Buyers")
            .when(p("n_purchases") >= o("n_purchases"), "Converting Regulars")
            .when((p("n_views") >= o("n_views") * 1.4)
                  & (p("n_purchases") < o("n_purchases")), "Heavy Browsers")
            .when(p("n_wishlist_adds") >= o("n_wishlist_adds") * 1.3, "Wishlist Collectors")
            .when(p("n_views") < o("n_views") * 0.6, "Low-Touch Visitors")
            .otherwise("Casual Shoppers"))
    desc = F.create_map(*[x for k, v in SEGMENT_TEXT.items() for x in (F.lit(k), F.lit(v))])
    named = (profiles.join(F.broadcast(overall), how="inner", on=F.lit(True))
             .withColumn("base_name", name))
    w = Window.partitionBy("base_name").orderBy(label)  # rows = clusters (k <= 8)
    named = named.withColumn("_rn", F.row_number().over(w))
    return named.select(
        label,
        F.concat(F.col("base_name"), F.expr("repeat(' II', _rn - 1)")).alias("name"),
        desc[F.col("base_name")].alias("description"), "size", "share",
        *[F.col(c) for c in FEATURES])


# C15 -------------------------------------------------------------------------
def user_segments(assignments: DataFrame, segments: DataFrame,
                  label: str = "cluster") -> DataFrame:
    return assignments.select("user_id", label).join(F.broadcast(segments), label)


# E6 over segments (radar): each axis divided by its maximum over segments.
RADAR_AXES = ["n_views", "n_clicks", "n_cart_adds", "n_purchases", "avg_order_value",
              "n_reviews", "category_diversity"]


def radar(segments: DataFrame) -> DataFrame:
    mx = segments.agg(*[F.max(c).alias(f"_x_{c}") for c in RADAR_AXES])
    j = segments.join(F.broadcast(mx), how="inner", on=F.lit(True))
    return j.select("cluster", "name", *[
        F.round(F.col(c) / F.coalesce(F.when(F.col(f"_x_{c}") != 0, F.col(f"_x_{c}")),
                                       F.lit(1.0)), 3).alias(c) for c in RADAR_AXES])


# A6 ----------------------------------------------------------------------------
def segmentation_document(sweep: DataFrame, choice: DataFrame, segments: DataFrame) -> DataFrame:
    """One nested row: chosen and rejected k, the sweep and the named segments (each
    list has one entry per k or cluster)."""
    sw = sweep.agg(F.array_sort(F.collect_list(F.struct("k", "inertia", "silhouette"))).alias("sweep"))
    sg = segments.agg(F.array_sort(F.collect_list(F.struct(
        "cluster", "name", "description", "size", "share"))).alias("segments"))
    return (choice.join(F.broadcast(sw), how="inner", on=F.lit(True))
            .join(F.broadcast(sg), how="inner", on=F.lit(True)))
