"""Distributed operators against brute force on small random inputs."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from basketlab.operators import audit
from basketlab.operators import recommender as rec
from basketlab.operators import segmentation as seg


def _ui(spark, rng, users=12, items=9, density=0.5, hot_user=True):
    rows = []
    for u in range(users):
        for i in range(items):
            if rng.random() < density or (hot_user and u == 0):
                rows.append((u, i, float(rng.integers(1, 9))))
    return spark.createDataFrame(rows, "user_id long, product_id long, w double"), \
        pd.DataFrame(rows, columns=["user_id", "product_id", "w"])


def test_blocked_cooccurrence_equals_self_join(spark):
    rng = np.random.default_rng(7)
    sdf, pdf = _ui(spark, rng)
    # tiny blocks force several user and item blocks, including p < q cells
    got = rec.item_cooccurrence(sdf, items_per_block=2, cell_rows=20).toPandas()
    j = pdf.merge(pdf, on="user_id")
    j = j[j.product_id_x != j.product_id_y]
    want = (j.assign(dot=j.w_x * j.w_y).groupby(["product_id_x", "product_id_y"]).dot.sum()
            .reset_index().rename(columns={"product_id_x": "item", "product_id_y": "neighbor"}))
    a = got.sort_values(["item", "neighbor"]).reset_index(drop=True)
    b = want.sort_values(["item", "neighbor"]).reset_index(drop=True)
    assert len(a) == len(b)
    assert (a[["item", "neighbor"]].values == b[["item", "neighbor"]].values).all()
    assert np.array_equal(a["dot"].values, b["dot"].values)


def test_cooccurrence_user_chunks(spark):
    rng = np.random.default_rng(9)
    sdf, pdf = _ui(spark, rng, users=30, items=5)
    got = rec.item_cooccurrence(sdf, items_per_block=512, user_chunk=4).toPandas()
    j = pdf.merge(pdf, on="user_id")
    j = j[j.product_id_x != j.product_id_y]
    want = j.assign(d=j.w_x * j.w_y).groupby(["product_id_x", "product_id_y"]).d.sum()
    got = got.set_index(["item", "neighbor"])["dot"].sort_index()
    assert np.array_equal(got.values, want.sort_index().values)


def test_cosine_matches_dense(spark):
    rng = np.random.default_rng(3)
    sdf, pdf = _ui(spark, rng, users=10, items=6)
    m = pdf.pivot_table(index="user_id", columns="product_id", values="w", fill_value=0.0)
    mn = m / np.sqrt((m ** 2).sum(0))
    dense = mn.T @ mn
    got = rec.item_similarity(sdf, items_per_block=2, cell_rows=16).toPandas()
    for r in got.itertuples():
        assert abs(dense.loc[r.item, r.neighbor] - r.sim) < 1e-12


def test_silhouette_matches_numpy(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)),
                   rng.normal(-3, 1, (1, 3))])
    lab = np.array([0] * 20 + [1] * 15 + [2])
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("user_id", T.LongType()),
                           T.StructField("cluster", T.LongType()),
                           T.StructField("features", VectorUDT())])
    df = spark.createDataFrame([(i, int(lab[i]), Vectors.dense(x[i])) for i in range(len(x))],
                               schema)
    got = seg.silhouette(df).first().silhouette
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert abs(got - round(float(np.mean(s)), 6)) < 1e-9


def test_histogram_median_is_exact(spark):
    for vals in ([1, 5, 2, 9], [3, 3, 3], [4, 1, 7, 7, 2]):
        df = spark.createDataFrame([(v,) for v in vals], "n long")
        hist = df.groupBy(F.lit("x").alias("level"), F.col("n").alias("v")).agg(
            F.count(F.lit(1)).alias("f"))
        r = audit.spread(hist).first()
        assert r.median == float(np.median(vals))
        assert r.max == max(vals)
        assert abs(r.mean - np.mean(vals)) < 1e-12


def test_top_neighbors_ties_break_on_id(spark):
    sim = spark.createDataFrame([(1, 5, 0.5), (1, 3, 0.5), (1, 4, 0.9)],
                                "item long, neighbor long, sim double")
    got = [r.neighbor for r in rec.top_neighbors(sim, k=2).orderBy("rank").collect()]
    assert got == [4, 3]


def test_fk_orphans_counts_distinct_missing_keys(spark):
    t = {"c": spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"),
         "p": spark.createDataFrame([(1,)], "k long")}
    r = audit.fk_orphans(t, [("c", "k", "p", "k")]).first()
    assert r.orphans == 1


def test_conversion_by_grouping_sets(spark):
    s = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 0)],
                              "device_type string, referrer_source string, is_converted long")
    got = {(r.feature, r.value): (r.rate, r.n) for r in audit.conversion_by(s).collect()}
    assert got[("device_type", "a")] == (0.5, 2)
    assert got[("referrer_source", "x")] == (0.5, 2)
    assert len(got) == 4


def test_prior_sessions_two_level_rank_matches_plain_rank(spark):
    import datetime as dt
    from basketlab.operators.aggregates import with_prior_sessions
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        user = 0 if k < 200 else int(rng.integers(1, 5))  # user 0 is the hot one
        minute = int(rng.integers(0, 60 * 30))            # spans many hour buckets
        rows.append((f"s{k:03d}", user, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)))
    df = spark.createDataFrame(rows, "session_id string, user_id long, start_time timestamp")
    got = {r.session_id: r.prior_sessions for r in with_prior_sessions(df).collect()}
    pdf = pd.DataFrame(rows, columns=["session_id", "user_id", "start_time"])
    pdf = pdf.sort_values(["user_id", "start_time", "session_id"])
    pdf["want"] = pdf.groupby("user_id").cumcount()
    assert got == dict(zip(pdf.session_id, pdf.want))
