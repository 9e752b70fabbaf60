"""Value rules, limits, rejected rows, bounded cells and exact metrics."""
import random

import pytest
from pyspark.sql import functions as F

from basketlab.functions import scalars as fn
from basketlab.operators import audit, conversion as conv, recommender as rec, results as res
from basketlab.sources import sinks


def test_trim_takes_every_white_space(spark):
    df = spark.createDataFrame([("home\t",), ("\u00a0\u2003home\r\n",), (" a b ",), (None,)], "c string")
    assert [r.c for r in fn.trim_cols(df, ["c"]).collect()] == ["home", "home", "a b", None]


def test_text_nan_counts_as_zero(spark):
    df = spark.createDataFrame([("NaN",), ("x",), (None,), ("2.5",)], "c string")
    assert [r.n for r in df.select(fn.to_number("c").alias("n")).collect()] == [0.0, 0.0, 0.0, 2.5]


def test_null_keys_form_no_group(spark):
    i = spark.createDataFrame([("view",), (None,), ("view",)], "interaction_type string")
    assert [tuple(r) for r in audit.event_vocabulary(i).collect()] == [("view", 2)]
    s = spark.createDataFrame([("pc", None, 1), (None, "ad", 0)],
                              "device_type string, referrer_source string, is_converted int")
    got = {(r.feature, r.value): (r.rate, r.n) for r in audit.conversion_by(s).collect()}
    assert got == {("device_type", "pc"): (1.0, 1), ("referrer_source", "ad"): (0.0, 1)}


@pytest.mark.parametrize("limit", [0, -1, 201])
def test_catalog_limit_out_of_range_raises(spark, limit):
    df = spark.createDataFrame([(1, "a", 1.0, 1)],
                               "product_id int, category string, revenue double, n_view int")
    with pytest.raises(ValueError, match="between 1 and 200"):
        res.catalog(df, limit=limit)
    assert res.catalog(df, limit=200).count() == 1
    assert res.catalog(df, category="b").count() == 0
    with pytest.raises(LookupError, match="no products in category 'b'"):
        res.catalog(df, category="b", must_exist=True)


def test_tiny_scores_stay_and_rank(spark):
    ui = spark.createDataFrame([(1, 10, 1.0), (2, 11, 1.0)], "user_id long, product_id long, w double")
    nb = spark.createDataFrame([(10, 20, 1e-10), (10, 21, 2e-10)], "item long, neighbor long, sim double")
    got = rec.score_candidates(ui, nb).orderBy(F.col("score").desc()).collect()
    assert [(r.rec_id, float(r.score)) for r in got] == [(21, 2e-10), (20, 1e-10)]


def test_cells_stay_bounded_under_a_hot_item(spark):
    rng = random.Random(3)
    rows = [(u, 0, 1.0) for u in range(4000)] + [
        (u, i, float(1 + (u + i) % 5)) for u in range(4000) for i in rng.sample(range(1, 60), 2)]
    ui = spark.createDataFrame(rows, "user_id long, product_id long, w double")
    left, right = rec.cooccurrence_cells(ui, items_per_block=8, cell_rows=1000)
    for side in (left, right):
        assert side.groupBy("ub", "p", "q").count().agg(F.max("count")).first()[0] <= 1000
    got = {(r.item, r.neighbor): r.dot for r in
           rec.item_cooccurrence(ui, items_per_block=8, cell_rows=1000).collect()}
    a, b = ui.alias("a"), ui.alias("b")
    want = a.join(b, (F.col("a.user_id") == F.col("b.user_id"))
                  & (F.col("a.product_id") != F.col("b.product_id"))).groupBy(
        F.col("a.product_id").alias("i"), F.col("b.product_id").alias("j")).agg(
        F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    assert got == {(r.i, r.j): r.dot for r in want.collect()}


def test_auc_and_roc_use_every_threshold(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        y = rng.random() < 0.3
        rows.append((float(y), 0.1 + 1e-7 * (i % 2900) + 1e-5 * y * rng.random()))
    df = spark.createDataFrame(rows, "label double, p double")
    scores = sorted(rows, key=lambda r: r[1])
    ranks, i = {}, 0
    while i < len(scores):  # mean rank of ties
        j = i
        while j < len(scores) and scores[j][1] == scores[i][1]:
            j += 1
        ranks[scores[i][1]] = (i + 1 + j) / 2
        i = j
    n1 = sum(y for y, _ in rows)
    exact = (sum(ranks[p] for y, p in rows if y) - n1 * (n1 + 1) / 2) / (n1 * (len(rows) - n1))
    vec = df.withColumn("probability", array_to_vector(F.array(1 - F.col("p"), "p")))
    auc = BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0).evaluate(vec)
    assert abs(auc - exact) < 1e-9
    pts = sorted((r.i, r.fpr, r.tpr) for r in conv.roc_points(df, step=1).collect())
    area = sum((b[1] - a[1]) * (a[2] + b[2]) / 2 for a, b in zip(pts, pts[1:]))
    assert abs(area - exact) < 1e-9 and len(pts) > 1000
    assert [p[0] for p in pts] == list(range(len(pts)))


def test_rejected_rows_carry_reasons(spark):
    df = spark.createDataFrame([("a", 24, 5), ("b", 3, -1), ("c", None, 30), ("d", -1, -1)],
                               "session_id string, hour long, age long")
    valid, rejected = conv.validate_sessions(df)
    assert [r.session_id for r in valid.collect()] == ["c"]
    assert {r.session_id: r.reason for r in rejected.collect()} == {
        "a": "hour must be 0 to 23", "b": "age must be at least 0",
        "d": "hour must be 0 to 23; age must be at least 0"}


def test_recommendations_for_given_ids(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    ui = spark.createDataFrame([(1, 10, 1.0)], "user_id long, product_id long, w double")
    nb = spark.createDataFrame([(10, 20, 0.5)], "item long, neighbor long, sim double")
    best = spark.createDataFrame([(1, 30)], "rank long, product_id long")
    prods = spark.createDataFrame([(10, "a", "c", "b", 1.0), (20, "b", "c", "b", 1.0), (30, "d", "c", "b", 1.0)],
                                  "product_id long, product_name string, category string, brand string, price double")
    ids = spark.createDataFrame([(" 1\t",), ("2",), ("9",), ("x y",), (None,)], "requested string")
    got = {(r.requested, r.status, r.product_id) for r in
           rec.recommend_for(ids, users, ui, nb, best, prods).collect()}
    assert got == {(" 1\t", "found", 20), ("2", "found", 30), ("9", "unknown", None),
                   ("x y", "unknown", None), (None, "unknown", None)}
    with pytest.raises(ValueError, match="between 1 and 20"):
        rec.recommend_for(ids, users, ui, nb, best, prods, n=21)


def test_count_mismatch_after_landing_raises(spark):
    a, b = spark.range(5), spark.range(4)
    ok = audit.reconcile_counts({"t": a}, {"t": a})
    assert audit.assert_reconciled(ok) is ok
    with pytest.raises(ValueError, match="t: 5 read, 4 written"):
        audit.assert_reconciled(audit.reconcile_counts({"t": a}, {"t": b}))


def test_landing_deals_rows_by_month(spark, scratch_dir):
    import glob
    df = spark.range(4000).repartition(16).select(
        F.col("id").alias("session_id"),
        F.when(F.col("id") > 0, F.expr("timestamp'2024-01-01' + make_interval(0, cast(id % 6 as int))"))
        .alias("start_time"))
    back = sinks.land_tables({"sessions": df}, f"{scratch_dir}/months")["sessions"]
    assert back.count() == 4000 and back.where("month = 'none'").count() == 1
    assert len(glob.glob(f"{scratch_dir}/months/sessions/month=*/*.parquet")) <= 14


def test_median_of_skewed_values(spark):
    values = [1.0] * 50 + [2.0, 3.0, 1e9, None] + [2.5] * 49
    df = spark.createDataFrame([(v,) for v in values], "price double")
    import statistics
    assert audit.median_of(df, "price", "m").first()["m"] == statistics.median(
        v for v in values if v is not None)
    assert audit.median_of(df.where("price > 1e12"), "price", "m").first()["m"] is None


def test_model_report_covers_all_users(spark, monkeypatch):
    # 700 users, each with an item and one neighbour of its own: 700 of 1,400 items are reached
    from types import SimpleNamespace

    from basketlab.plans import registry
    users = range(700)
    ui = spark.createDataFrame([(u, u, 1.0) for u in users], "user_id long, product_id long, w double")
    nb = spark.createDataFrame([(u, 1000 + u, 0.5) for u in users], "item long, neighbor long, sim double")
    best = spark.createDataFrame([], "rank long, product_id long")
    prods = spark.createDataFrame([(i, "p", "c", "b", 1.0) for u in users for i in (u, 1000 + u)],
                                  "product_id long, product_name string, category string, brand string, price double")
    monkeypatch.setattr(registry, "RecoModel", lambda s: SimpleNamespace(ui=ui, neighbors=nb, best=best))
    monkeypatch.setattr(registry.Shop, "__getattr__", lambda s, name: prods)
    monkeypatch.setattr(registry, "conversion_run", lambda s: SimpleNamespace(best_model=None, train=None, test=None))
    monkeypatch.setattr(registry, "overview_of", lambda s: None)
    for name in ("metrics_table", "importances", "scored", "confusion", "classification_report"):
        monkeypatch.setattr(registry.conv, name, lambda *a: spark.range(1))
    monkeypatch.setattr(registry.conv, "feature_label", lambda c: F.lit("x"))
    monkeypatch.setattr(registry.res, "model_report", lambda *a: a[4])
    got = registry.QUERIES["model_report"](spark, "/nowhere").first()
    assert (got.sample_size, got.catalog_reachable, got.catalog_share) == (700, 700, 0.5)
