"""Invariants of the rows-only (model) queries on the sf0.001 tables."""
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def q():
    return entry.queries()


def test_conversion_metrics_invariants(spark, q):
    m = q["conversion_metrics"](spark, SMALL).collect()
    split = {(r.is_test, r.label): r.n for r in q["conversion_split"](spark, SMALL).collect()}
    n_test = sum(v for (t, _), v in split.items() if t)
    assert sum(r.chosen for r in m) == 1
    assert {r.role for r in m} == {"contender", "ablation"}
    for r in m:
        assert 0.0 <= r.roc_auc <= 1.0
        assert r.tn + r.fp + r.fn + r.tp == n_test
        assert 0.0 <= r.precision <= 1.0 and 0.0 <= r.recall <= 1.0
    best = max((r for r in m if r.role == "contender"), key=lambda r: r.roc_auc)
    assert best.chosen


def test_report_roc_and_importances(spark, q):
    rep = {r["class"]: r for r in q["classification_report"](spark, SMALL).collect()}
    assert set(rep) == {"not converted", "converted", "macro avg", "weighted avg"}
    assert rep["macro avg"].support == rep["converted"].support + rep["not converted"].support
    roc = q["roc_points"](spark, SMALL).orderBy("i").collect()
    assert roc[0].fpr == 0.0 and roc[0].tpr == 0.0
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(roc, roc[1:]))
    imp = q["feature_importance"](spark, SMALL).orderBy("rank").collect()
    assert 0 < len(imp) <= 15
    assert all(a.importance >= b.importance for a, b in zip(imp, imp[1:]))
    assert all(r.label for r in imp)


def test_scores_and_factors(spark, q):
    sc = q["conversion_scores"](spark, SMALL)
    n = sc.count()
    assert n == q["fx_sessions"](spark, SMALL).count()
    r = sc.agg({"conversion_probability": "max"}).first()[0]
    assert 0.0 <= r <= 1.0
    f = q["top_factors"](spark, SMALL)
    assert f.groupBy("session_id").count().agg({"count": "max"}).first()[0] <= 5


def test_segmentation_invariants(spark, q):
    sweep = q["segment_sweep"](spark, SMALL).collect()
    assert [r.k for r in sorted(sweep, key=lambda r: r.k)] == list(range(2, 9))
    chosen = [r for r in sweep if r.chosen]
    assert len(chosen) == 1 and chosen[0].k >= 3
    segs = q["segments"](spark, SMALL).collect()
    users = q["fx_users"](spark, SMALL).count()
    assert sum(r.size for r in segs) == users
    assert abs(sum(r.share for r in segs) - 1.0) < 1e-9
    assert len({r.name for r in segs}) == len(segs)
    assert q["user_segments"](spark, SMALL).count() == users
    radar = q["segment_radar"](spark, SMALL).collect()
    assert all(0.0 <= v <= 1.0 for r in radar for v in r[2:])


def test_split_is_exact_from_few_counts(spark, monkeypatch):
    import hashlib

    from pyspark.sql import functions as F

    from basketlab.operators.conversion import split, split_cuts
    df = spark.range(24_000).select(F.concat(F.lit("s"), F.col("id")).alias("session_id"),
                                    (F.col("id") % 3 == 0).cast("double").alias("label"))
    seen, collect = [], type(df).collect
    with monkeypatch.context() as m:
        m.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
        cuts = split_cuts(df)
    assert max(map(len, seen)) <= 2 * 4096
    test = {r.session_id for r in split(df, cuts=cuts).where("is_test").collect()}
    for one in (True, False):
        keys = [f"s{i}" for i in range(24_000) if (i % 3 == 0) == one]
        keys.sort(key=lambda k: hashlib.md5(k.encode()).hexdigest())
        assert test & set(keys) == set(keys[:len(keys) // 4])


def test_report_holds_its_scoring_once(spark):
    from pyspark.sql import functions as F

    from basketlab.operators.conversion import classification_report, confusion
    rows = spark.range(40).select((F.col("id") % 2).alias("label"), (F.col("id") % 3 % 2).alias("pred"))
    rep = classification_report(confusion(rows))
    plan = rep._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan
    assert {r["class"]: r.support for r in rep.collect()}["macro avg"] == 40
