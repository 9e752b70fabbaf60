"""Session conversion model: split, weights, pipelines, evaluation, ablation,
importances and batch (or streaming) scoring.

The baseline is a ``pyspark.ml`` pipeline; the forest and the boosted trees are grown by
``forest`` and ``boosting`` from binned rows. Metrics (split sizes, class weights,
confusion counts, exact AUC, ROC) are plain aggregates. Nothing is fitted on the driver,
and a trained run is an artifact that other sessions load (``sources.artifacts``).
"""
from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.functions.scalars import flag, to_number
from basketlab.operators.binning import fit_space
from basketlab.operators.boosting import BoostedModel, Settings, fit_boosted
from basketlab.operators.forest import ForestModel, fit_forest
from basketlab.operators.joins import materialize
from basketlab.session import release, shared_path
from basketlab.sources.artifacts import ArtifactStore

# Model inputs.
NUMERIC = ["n_interactions", "n_products", "n_view", "n_click", "n_add_to_cart",
           "n_remove_from_cart", "n_add_to_wishlist", "n_remove_from_wishlist",
           "net_cart", "net_wishlist", "total_dwell_ms", "mean_dwell_ms", "max_dwell_ms",
           "duration_s", "hour", "day_of_week", "is_weekend", "prior_sessions",
           "is_returning", "tenure_days", "age"]
CATEGORICAL = ["device_type", "referrer_source", "loyalty_tier", "income_level"]
CART_FEATURES = ["n_add_to_cart", "n_remove_from_cart", "net_cart"]
TARGET = "is_converted"
THRESHOLD = 0.5

# Population defaults for missing scoring inputs.
DEFAULTS = {
    "n_interactions": 5, "n_products": 3, "n_view": 3, "n_click": 1,
    "n_add_to_cart": 0, "n_remove_from_cart": 0, "n_add_to_wishlist": 0,
    "n_remove_from_wishlist": 0, "net_cart": 0, "net_wishlist": 0,
    "total_dwell_ms": 60000, "mean_dwell_ms": 12000, "max_dwell_ms": 30000,
    "duration_s": 300, "hour": 14, "day_of_week": 2, "is_weekend": 0,
    "prior_sessions": 0, "is_returning": 0, "tenure_days": 180, "age": 35,
    "device_type": "desktop", "referrer_source": "organic_search",
    "loyalty_tier": "bronze", "income_level": "medium",
}
# Accepted ranges of request fields (lower, upper; None = open).
RANGES = {
    "n_view": (0, None), "n_click": (0, None), "n_add_to_cart": (0, None),
    "n_remove_from_cart": (0, None), "n_add_to_wishlist": (0, None),
    "n_remove_from_wishlist": (0, None), "n_products": (0, None),
    "mean_dwell_ms": (0, None), "max_dwell_ms": (0, None), "duration_s": (0, None),
    "hour": (0, 23), "day_of_week": (0, 6), "prior_sessions": (0, None),
    "tenure_days": (0, None), "age": (0, None),
}
# Plain-language feature labels.
FEATURE_LABELS = {
    "net_cart": "Items still in cart",
    "n_add_to_cart": "Times added to cart",
    "n_remove_from_cart": "Times removed from cart",
    "n_add_to_wishlist": "Items saved to wishlist",
    "n_remove_from_wishlist": "Items removed from wishlist",
    "net_wishlist": "Items still on wishlist",
    "n_view": "Products viewed",
    "n_click": "Products clicked",
    "n_products": "Different products seen",
    "n_interactions": "Total actions taken",
    "total_dwell_ms": "Total time on products",
    "mean_dwell_ms": "Average time per product",
    "max_dwell_ms": "Longest time on one product",
    "duration_s": "Visit length",
    "hour": "Time of day",
    "day_of_week": "Day of week",
    "is_weekend": "Weekend visit",
    "prior_sessions": "Previous visits",
    "is_returning": "Returning shopper",
    "tenure_days": "Days since signing up",
    "age": "Shopper age",
}
PREFIX_LABELS = {"device_type": "Device", "referrer_source": "Came from",
                 "loyalty_tier": "Loyalty tier", "income_level": "Income bracket"}


# B23 -------------------------------------------------------------------------
def feature_label(c) -> F.Column:
    """Model feature name -> label: known name, else one-hot ``prefix_value`` ->
    "Label: value" (underscores in the value become spaces), else underscores ->
    spaces."""
    col = F.col(c) if isinstance(c, str) else c
    known = F.create_map(*[x for k, v in FEATURE_LABELS.items() for x in (F.lit(k), F.lit(v))])
    expr = F.try_element_at(known, col)
    for prefix, label in PREFIX_LABELS.items():
        rest = F.substring(col, len(prefix) + 2, 1 << 20)
        expr = F.coalesce(expr, F.when(
            col.startswith(prefix + "_"),
            F.concat(F.lit(label + ": "), F.regexp_replace(rest, "_", " "))))
    return F.coalesce(expr, F.regexp_replace(col, "_", " "))


# B14 / H1 / H7 ------------------------------------------------------------------
def model_input(features: DataFrame) -> DataFrame:
    """Numeric inputs coerced to numbers (NULL -> 0), label as double."""
    return features.select(
        "session_id", *[to_number(c).alias(c) for c in NUMERIC],
        *[F.col(c) for c in CATEGORICAL],
        F.col(TARGET).cast("double").alias("label"))


def split_cuts(df: DataFrame, key: str = "session_id", share: float = 0.25, label: str = "label",
               digits: int = 3) -> dict:
    """class -> the largest md5(key) of its test rows, so that each class (rows without a
    label being one) has exactly round(share * n) of them: its smallest hashes.

    No class is sorted: rows are counted by class and the hash's leading digits, then, in
    the one cell that the quota ends in, by the next digits, until it ends with a cell.
    A pass returns at most 16^digits counts a class (4,096, as the driver holds them); two
    to four passes find the cut. (Rows of equal keys fall on one side, so a repeated key may
    leave the quota short of them.)"""
    h = F.md5(F.col(key).cast("string"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(label).alias("c"), h.alias("h"))
    left = {r["c"]: int(share * r["n"] + 0.5) for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = {c: "" for c, n in left.items() if n == 0}
    prefix = {c: "" for c in left if c not in cuts}
    for at in range(1, 33, digits):
        if not prefix:
            break
        inside = F.lit(False)
        for c, p in prefix.items():
            inside = inside | (F.col("c").eqNullSafe(F.lit(c)) & F.col("h").startswith(p))
        cells = rows.where(inside).groupBy("c", F.substring("h", at, digits).alias("d")).agg(
            F.count(F.lit(1)).alias("n")).collect()
        for c in list(prefix):
            for d, n in sorted((r["d"], r["n"]) for r in cells if r["c"] == c):
                if n < left[c]:
                    left[c] -= n
                    cuts[c] = (prefix[c] + d).ljust(32, "f")
                    continue
                if n == left[c]:
                    cuts[c] = (prefix.pop(c) + d).ljust(32, "f")
                else:
                    prefix[c] += d
                break
    return cuts


def split(df: DataFrame, key: str = "session_id", label: str = "label", cuts: dict | None = None) -> DataFrame:
    """is_test: a quarter of each class, chosen by the key's hash, reproducible in any
    engine; rows without a key are training rows."""
    cuts = split_cuts(df, key, label=label) if cuts is None else cuts
    h, test = F.md5(F.col(key).cast("string")), F.lit(False)
    for c, cut in cuts.items():
        test = test | (F.col(label).eqNullSafe(F.lit(c)) & (h <= F.lit(cut)))
    return df.withColumn("is_test", F.coalesce(test, F.lit(False)))


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 * n_class), from one small aggregate. Rows without a
    label form no class (and train nothing; ``unlabelled_sessions`` counts them)."""
    c = train.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n_class"))
    tot = c.agg(F.sum("n_class").alias("n"))
    return (c.join(F.broadcast(tot), how="inner", on=F.lit(True))
            .select(label, "n_class", (F.col("n") / (2.0 * F.col("n_class"))).alias("weight")))


def with_weights(train: DataFrame, label: str = "label") -> DataFrame:
    w = class_weights(train, label).select(label, "weight")
    return train.join(F.broadcast(w), label)


# H2–H6 -------------------------------------------------------------------------
def conversion_pipeline(numeric, categorical, estimator) -> Pipeline:
    """Scale numerics, one-hot categoricals (unseen -> all zeros), then fit."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__idx", handleInvalid="keep",
                         stringOrderType="alphabetAsc") for c in categorical]
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in categorical],
                        outputCols=[f"{c}__ohe" for c in categorical], dropLast=True,
                        handleInvalid="keep")
    num = VectorAssembler(inputCols=list(numeric), outputCol="num_vec")
    scaler = StandardScaler(inputCol="num_vec", outputCol="num_scaled", withMean=True,
                            withStd=True)
    feats = VectorAssembler(inputCols=["num_scaled"] + [f"{c}__ohe" for c in categorical],
                            outputCol="features")
    return Pipeline(stages=[*idx, ohe, num, scaler, feats, estimator])


# Contender and ablation names.
BASELINE, FOREST, BOOSTED = ("LogisticRegression (baseline)", "RandomForest",
                             "GradientBoostedTrees")
ABLATION = "RandomForest (no cart features)"


def baseline(n_train: int) -> LogisticRegression:
    """The same penalty as a unit C over n rows."""
    return LogisticRegression(maxIter=2000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                              standardization=False, weightCol="weight")


# H8 --------------------------------------------------------------------------
def with_probability(model, df: DataFrame, out: str = "p") -> DataFrame:
    """df with the model's probability of a conversion."""
    if isinstance(model, PipelineModel):
        cols = [F.col(c) for c in df.columns]
        return model.transform(df).select(*cols, vector_to_array("probability").getItem(1).alias(out))
    return model.with_probability(df, out)


def scored(model, df: DataFrame) -> DataFrame:
    return with_probability(model, df).withColumn("pred", (F.col("p") >= THRESHOLD).cast("double"))


def confusion(scored_df: DataFrame, by=()) -> DataFrame:
    """tn, fp, fn, tp from one aggregate, one row for each value of the columns ``by``."""
    y, yhat = F.col("label"), F.col("pred")
    return scored_df.groupBy(*by).agg(
        F.count_if((y == 0) & (yhat == 0)).alias("tn"),
        F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"),
        F.count_if((y == 1) & (yhat == 1)).alias("tp"))


def metrics_from_confusion(cm: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    prec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    return (cm.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", F.coalesce(F.try_divide(
                2 * F.col("precision") * F.col("recall"),
                F.col("precision") + F.col("recall")), F.lit(0.0))))


MEASURES = ["name", "roc_auc", "precision", "recall", "f1", "tn", "fp", "fn", "tp"]


def evaluate(scores: DataFrame) -> DataFrame:
    """AUC + precision/recall/F1 at 0.5 + confusion counts of (name, p, pred, label), one row
    for each name. All models are measured by the same few jobs: their plans and code stay
    in the driver, so its memory would follow the number of models otherwise."""
    m = metrics_from_confusion(confusion(scores, ["name"])).join(F.broadcast(roc_auc(scores, by=["name"])), "name")
    return m.select(*MEASURES)


def classification_report(cm: DataFrame) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages."""
    # one row: else the scoring's plan would stand in the report's ten times
    cm = materialize(cm, "confusion")
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    sd = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = []
    for cls, p, r, sup in [("not converted", sd(tn, tn + fn), sd(tn, tn + fp), tn + fp),
                           ("converted", sd(tp, tp + fp), sd(tp, tp + fn), tp + fn)]:
        rows.append(cm.select(F.lit(cls).alias("class"), p.alias("precision"),
                              r.alias("recall"), sup.alias("support")))
    per = rows[0].unionByName(rows[1]).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                      F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("_n"))
    j = per.join(F.broadcast(tot), how="inner", on=F.lit(True))
    macro = j.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.sum("support").alias("support"),
                  F.avg("f1").alias("f1"))
    wavg = j.agg(F.lit("weighted avg").alias("class"),
                 *[(F.sum(F.col(c) * F.col("support")) / F.first("_n")).alias(c)
                   for c in ("precision", "recall")],
                 F.sum("support").alias("support"),
                 (F.sum(F.col("f1") * F.col("support")) / F.first("_n")).alias("f1"))
    return per.unionByName(macro).unionByName(wavg)


# H8 / H9 ---------------------------------------------------------------------
THRESHOLDS_PER_RANGE = 100_000


def running_totals(scored_df: DataFrame, per_range: int = THRESHOLDS_PER_RANGE, by=()) -> DataFrame:
    """Per distinct score, from the highest: (r, t, pos, neg, tp, fp, P, N, next, is_first),
    where tp and fp count the rows at or above it, and next are the counts of the score
    below it; for each value of the columns ``by`` (never null), which stand in front.

    Totals are made in two levels, so that no task holds all thresholds: inside ranges of
    equally many distinct scores (rows of one score meet before), and over the ranges'
    totals, one row for each. Crowded scores make more ranges there, not larger ones."""
    per_t = materialize(scored_df.groupBy(*by, F.col("p").alias("t")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")),
        "thresholds")
    ranges = 1 + per_t.count() // per_range
    dealt = materialize(per_t.repartitionByRange(ranges, *by, F.col("t").desc()).withColumn(
        "r", F.spark_partition_id()), "ranges")
    down = Window.partitionBy(*by).orderBy("r")
    inside = Window.partitionBy(*by, "r").orderBy(F.col("t").desc())
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt.groupBy(*by, "r").agg(
        F.sum("pos").alias("rp"), F.sum("neg").alias("rn"),
        F.max_by(F.struct("pos", "neg"), "t").alias("first"))
    heads = heads.select(
        *by, "r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p0"),
        F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n0"),
        F.lead("first").over(down).alias("after"), F.row_number().over(down).alias("nth"))
    tot = dealt.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    c = dealt.join(F.broadcast(heads), [*by, "r"]).join(F.broadcast(tot), how="inner", on=list(by) or F.lit(True))
    return c.select(
        *by, "r", "t", "P", "N", (F.col("p0") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("n0") + F.sum("neg").over(upto)).alias("fp"), "pos", "neg",
        F.coalesce(F.lead(F.struct("pos", "neg")).over(inside), F.col("after")).alias("next"),
        ((F.col("nth") == 1) & (F.row_number().over(inside) == 1)).alias("is_first"))


def roc_auc(scored_df: DataFrame, per_range: int = THRESHOLDS_PER_RANGE, by=()) -> DataFrame:
    """One row (for each value of ``by``): the exact area under the ROC curve, ties counting
    half (0 without both classes). Of each positive, the negatives below it are counted twice and those level
    with it once, in whole numbers."""
    c = running_totals(scored_df, per_range, by)
    wide = lambda x: F.col(x).cast("decimal(18,0)")
    pairs = F.sum(wide("pos") * (2 * (wide("N") - wide("fp")) + wide("neg")))
    area = F.try_divide(pairs.cast("double"), 2.0 * F.first("P").cast("double") * F.first("N").cast("double"))
    return c.groupBy(*by).agg(F.coalesce(area, F.lit(0.0)).alias("roc_auc"))


def roc_points(scored_df: DataFrame, step: int = 5, per_range: int = THRESHOLDS_PER_RANGE) -> DataFrame:
    """ROC points at every distinct score, without the collinear ones, every
    ``step``-th kept, after the origin: (i, fpr, tpr)."""
    c = running_totals(scored_df, per_range)
    # a point lies on the line through its neighbours if both steps are the same
    bend = (F.col("is_first") | F.col("next").isNull() | (F.col("pos") != F.col("next.pos"))
            | (F.col("neg") != F.col("next.neg")))
    kept = materialize(c.where(bend).select("r", "t", "tp", "fp", "P", "N"), "roc")
    above = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = kept.groupBy("r").agg(F.count(F.lit(1)).alias("k")).select(
        "r", F.coalesce(F.sum("k").over(above), F.lit(0)).alias("k0"))
    inside = Window.partitionBy("r").orderBy(F.col("t").desc())
    pts = kept.join(F.broadcast(before), "r").select(
        (F.col("k0") + F.row_number().over(inside)).cast("bigint").alias("i"),
        F.coalesce(F.try_divide(F.col("fp"), F.col("N")), F.lit(0.0)).alias("fpr"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("P")), F.lit(0.0)).alias("tpr"))
    origin = scored_df.limit(1).select(
        F.lit(0).cast("bigint").alias("i"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts).where(F.col("i") % step == 0)


# H12 -------------------------------------------------------------------------
def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled vector slots: numerics, then ``<col>_<value>`` per
    one-hot slot (read from the fitted indexers)."""
    names = []
    stages = model.stages
    num = [s for s in stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "num_vec"]
    names += num[0].getInputCols()
    for s in stages:
        if hasattr(s, "labelsArray") and s.__class__.__name__ == "StringIndexerModel":
            col = s.getInputCol()
            labels = s.labelsArray[0]
            names += [f"{col}_{v}" for v in labels]  # dropLast drops the 'unseen' slot
    return names


def importances(model, df: DataFrame) -> DataFrame:
    """(rank, feature, importance): a forest's share of impurity removed, the number of
    splits of boosted trees, or |coefficients| of a linear model, sorted descending. There
    is one entry per model input (dozens), so they are turned into rows directly."""
    if isinstance(model, PipelineModel):
        rows = [(n, float(v)) for n, v in zip(feature_names(model, df), abs(model.stages[-1].coefficients.toArray()))]
    else:
        rows = model.feature_importance()
    imp = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w).cast("bigint"))


# H15 / B24 ------------------------------------------------------------------------
def validate_sessions(rows: DataFrame):
    """Split request rows into (valid, rejected) by the accepted ranges; rejected rows
    carry ``reason``, one clause for each field out of range."""
    faults = []
    for c, (lo, hi) in RANGES.items():
        if c in rows.columns:
            v = F.col(c)
            bad = v < lo if hi is None else (v < lo) | (v > hi)
            text = f"{c} must be at least {lo}" if hi is None else f"{c} must be {lo} to {hi}"
            faults.append(F.when(bad, F.lit(text)))
    reason = F.concat_ws("; ", *faults) if faults else F.lit("")
    tagged = rows.withColumn("reason", reason)
    return tagged.where("reason = ''").drop("reason"), tagged.where("reason != ''")


def repair_features(rows: DataFrame) -> DataFrame:
    """Defaults for missing fields, then the derived fields recomputed: net
    counts, weekend and returning flags, total actions at least the sum of the
    adding actions, total dwell = mean dwell x max(actions, 1)."""
    filled = {}
    for c, v in DEFAULTS.items():
        filled[c] = (F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    r = rows.withColumns(filled)
    r = r.withColumns({
        "net_cart": F.col("n_add_to_cart") - F.col("n_remove_from_cart"),
        "net_wishlist": F.col("n_add_to_wishlist") - F.col("n_remove_from_wishlist"),
        "is_weekend": flag(F.col("day_of_week") >= 5),
        "is_returning": flag(F.col("prior_sessions") > 0),
        "n_interactions": F.greatest(F.col("n_interactions"),
                                     F.col("n_view") + F.col("n_click") + F.col("n_add_to_cart")
                                     + F.col("n_add_to_wishlist")),
    })
    return r.withColumn("total_dwell_ms", F.col("mean_dwell_ms")
                        * F.greatest(F.col("n_interactions"), F.lit(1)))


# H13 / H14 ----------------------------------------------------------------------
def score_sessions(rows: DataFrame, model, base_rate: float,
                   model_name: str) -> DataFrame:
    """Probability, label at 0.5, lift vs the base rate. Stateless, so it runs
    unchanged on a streaming DataFrame."""
    x = rows.select("session_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC],
                    *[F.col(c).cast("string").alias(c) for c in CATEGORICAL])
    out = with_probability(model, x)
    p = F.col("p")
    return out.select(
        "session_id", F.round(p, 4).alias("conversion_probability"),
        (p >= THRESHOLD).cast("int").alias("predicted_label"),
        F.lit(round(base_rate, 4)).alias("base_rate"),
        F.round(p / F.lit(base_rate), 2).alias("lift_vs_base"),
        F.lit(model_name).alias("model"))


def top_factors(rows: DataFrame, imp: DataFrame, pool: int = 8, n: int = 5) -> DataFrame:
    """The first ``pool`` global importances that are numeric inputs, first ``n``
    of them, with each row's value and label (global ranking, row values). The
    chosen names (at most ``n``) are read once; each row is unpivoted to just
    those columns, so a row yields at most ``n`` output rows and no join."""
    top = (imp.where(F.col("rank") <= pool).where(F.col("feature").isin(NUMERIC))
           .orderBy("rank").limit(n).collect())  # <= n rows by construction
    if not top:
        return rows.sparkSession.createDataFrame(
            [], "session_id string, position bigint, feature string, label string, "
                "value double, importance double")
    entries = [F.struct(F.lit(k).cast("bigint").alias("position"),
                        F.lit(r["feature"]).alias("feature"),
                        F.col(r["feature"]).cast("double").alias("value"),
                        F.lit(round(float(r["importance"]), 4)).alias("importance"))
               for k, r in enumerate(top, start=1)]
    out = rows.select("session_id", F.inline(F.array(*entries)))
    return out.select("session_id", "position", "feature",
                      feature_label("feature").alias("label"), "value", "importance")


# The training job ----------------------------------------------------
# Part of an artifact's address; to be raised when training gives other models.
VERSION = 2
MODEL_KEYS = {BASELINE: "baseline", FOREST: "forest", BOOSTED: "boosted", ABLATION: "ablation"}


class Parameters:
    """What a training run is made with."""

    def __init__(self, trees: int = 300, min_leaf: int = 5, rounds: int = 300, leaves: int = 31,
                 rate: float = 0.05, seed: int = 42):
        self.trees, self.min_leaf, self.rounds, self.leaves = trees, min_leaf, rounds, leaves
        self.rate, self.seed = rate, seed


def save_model(spark: SparkSession, model, path: str) -> None:
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(path)
    else:
        model.save(spark, path)


def load_model(spark: SparkSession, name: str, path: str):
    kind = {BASELINE: PipelineModel, BOOSTED: BoostedModel}.get(name, ForestModel)
    return PipelineModel.load(path) if kind is PipelineModel else kind.load(spark, path)


class ConversionRun:
    """A trained run, read from its artifact: measures at once, models when asked for."""

    def __init__(self, features: DataFrame, path: str):
        self.spark, self.path = features.sparkSession, path
        self.facts = json.loads(self.spark.read.text(f"{path}/facts").first()["value"])
        cuts = {None if c is None else float(c): cut for c, cut in self.facts["cuts"]}
        self.data = split(model_input(features), cuts=cuts)
        self.train = self.data.where(~F.col("is_test"))
        self.test = self.data.where(F.col("is_test"))
        self._models: dict = {}

    @property
    def results(self) -> list[dict]:
        return self.facts["contenders"]

    @property
    def ablation(self) -> dict:
        return self.facts["ablation"]

    @property
    def base_rate(self) -> float:
        return self.facts["base_rate"]

    @property
    def best_name(self) -> str:
        return self.facts["best"]

    def model(self, name: str):
        if name not in self._models:
            self._models[name] = load_model(self.spark, name, f"{self.path}/{MODEL_KEYS[name]}")
        return self._models[name]

    @property
    def best_model(self):
        return self.model(self.best_name)


def train_conversion(features: DataFrame, path: str, progress: str, p: Parameters) -> None:
    """Fit every contender on the split's training rows, measure each on its test rows, fit
    the ablation (a forest without the cart features), and write models and measures to
    path; the best contender is that with the largest AUC."""
    spark = features.sparkSession
    inputs = materialize(model_input(features), "model-input")
    cuts = split_cuts(inputs)
    data = split(inputs, cuts=cuts)
    train = materialize(with_weights(data.where(~F.col("is_test"))), "train")
    test = data.where(F.col("is_test"))
    per_class = {r["label"]: r["weight"] for r in class_weights(train).collect()}  # two rows
    weights = (per_class.get(0.0, 1.0), per_class.get(1.0, 1.0))
    n_train = train.count()
    space = fit_space(train, NUMERIC, CATEGORICAL)
    without = space.without(CART_FEATURES)
    release(spark)
    fits = {
        BASELINE: lambda: conversion_pipeline(NUMERIC, CATEGORICAL, baseline(n_train)).fit(train),
        FOREST: lambda: fit_forest(train, space, weights, trees=p.trees, min_leaf=p.min_leaf, seed=p.seed),
        BOOSTED: lambda: fit_boosted(train, space, weights, Settings(p.rounds, p.leaves, p.rate), progress),
        ABLATION: lambda: fit_forest(train, without, weights, trees=p.trees, min_leaf=p.min_leaf, seed=p.seed),
    }

    scores = shared_path(spark, "scored")

    def one(name: str) -> str:
        model, to = fits[name](), f"{scores}/{MODEL_KEYS[name]}"
        save_model(spark, model, f"{path}/{MODEL_KEYS[name]}")
        scored(model, test).select(F.lit(name).alias("name"), "p", "pred", "label").write.parquet(to)
        release(spark)
        return to

    # two at a time fill one another's gaps (the boosted trees' rounds are the longest chain);
    # more would only add up in the driver, which plans and compiles the jobs of all of them
    with ThreadPoolExecutor(2) as pool:
        written = list(pool.map(one, [BOOSTED, FOREST, BASELINE, ABLATION]))
    nothing = dict.fromkeys(MEASURES[1:5], 0.0) | dict.fromkeys(MEASURES[5:], 0)  # without test rows
    measured = {name: {"name": name} | nothing for name in fits} | {
        r["name"]: r.asDict() for r in evaluate(spark.read.parquet(*written)).collect()}  # a row a model
    contenders = [measured[n] for n in (BASELINE, FOREST, BOOSTED)]
    facts = {"contenders": contenders, "ablation": measured[ABLATION],
             "best": max(contenders, key=lambda m: m["roc_auc"])["name"],
             "cuts": list(cuts.items()),
             "base_rate": float(data.agg(F.avg("label")).first()[0] or 0.0)}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/facts")


def trained_run(features: DataFrame, files, p: Parameters | None = None,
                store: ArtifactStore | None = None) -> ConversionRun:
    """The run of these features, from the artifact store or trained now. ``files`` names
    the input that the features follow from (path, size and time of each file)."""
    p = p or Parameters()
    store = store or ArtifactStore(features.sparkSession)
    address = store.digest(version=VERSION, files=files, numeric=NUMERIC, categorical=CATEGORICAL,
                           target=TARGET, parameters=vars(p))
    path = store.find("conversion", address)
    if path is None:
        path = store.publish("conversion", address, lambda folder: train_conversion(
            features, folder, store.progress("conversion", address), p))
        store.drop_progress("conversion", address)
    return ConversionRun(features, path)


def metrics_table(run: ConversionRun) -> DataFrame:
    """One row per contender plus the ablation, with the chosen flag."""
    spark = run.data.sparkSession
    rows = []
    for role, ev in [("contender", r) for r in run.results] + [("ablation", run.ablation)]:
        name = ev["name"]
        rows.append((role, name, ev["roc_auc"], ev["precision"], ev["recall"], ev["f1"],
                     ev["tn"], ev["fp"], ev["fn"], ev["tp"],
                     role == "contender" and name == run.best_name))
    return spark.createDataFrame(rows, "role string, name string, roc_auc double, "
                                 "precision double, recall double, f1 double, tn bigint, "
                                 "fp bigint, fn bigint, tp bigint, chosen boolean")


def metrics_document(run: ConversionRun) -> DataFrame:
    """One nested row with everything the training run measured: best model, sizes,
    base rate, metrics, 2x2 matrix, per-class report, importances, contenders, ablation
    and inputs. Every list has a fixed number of entries."""
    spark = run.data.sparkSession
    best = next(ev for ev in run.results if ev["name"] == run.best_name)
    sizes = run.data.agg(F.count_if(~F.col("is_test")).alias("n_train"),
                         F.count_if(F.col("is_test")).alias("n_test"))
    report = classification_report(confusion(scored(run.best_model, run.test))).agg(
        F.collect_list(F.struct("class", "precision", "recall", "f1", "support")).alias("report"))
    imp = importances(run.best_model, run.train).where(F.col("rank") <= 15).agg(
        F.array_sort(F.collect_list(F.struct("rank", "feature", "importance")))
        .alias("feature_importance"))
    names = ("name", "roc_auc", "precision", "recall", "f1")
    entry = "struct<name: string, roc_auc: double, precision: double, recall: double, f1: double>"
    fixed = spark.createDataFrame([(
        run.best_name, run.base_rate, *[best[c] for c in names[1:]],
        [[best["tn"], best["fp"]], [best["fn"], best["tp"]]],
        [tuple(ev[c] for c in names) for ev in run.results],
        tuple(run.ablation[c] for c in names), list(NUMERIC), list(CATEGORICAL))],
        "best_model string, base_rate double, roc_auc double, precision double, recall double, "
        f"f1 double, confusion_matrix array<array<bigint>>, contenders array<{entry}>, "
        f"ablation {entry}, numeric_features array<string>, categorical_features array<string>")
    for one in (sizes, report, imp):
        fixed = fixed.join(F.broadcast(one), how="inner", on=F.lit(True))
    return fixed


def unlabelled_sessions(data: DataFrame) -> DataFrame:
    """How many rows train nothing because their label or their id is missing."""
    return data.agg(F.count_if(F.col("label").isNull()).alias("no_label"),
                    F.count_if(F.col("session_id").isNull()).alias("no_id"),
                    F.count(F.lit(1)).alias("sessions"))
