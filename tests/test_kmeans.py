"""Batched k-means against plain numpy and against single fits."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlab.operators import kmeans


@pytest.fixture(scope="module")
def cloud(spark, scratch_dir):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.6, (150, 3)) for c in ([0, 0, 0], [4, 0, 1], [0, 5, 0], [3, 3, 3])])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").select(
        F.xxhash64("id").alias("key"), "x", "id").repartition(5).write.parquet(f"{scratch_dir}/cloud")
    return spark.read.parquet(f"{scratch_dir}/cloud"), x


def cost_of(x, centers):
    return ((x[:, None, :] - centers[None]) ** 2).sum(-1).min(1).sum()


def test_centers_are_settled_and_costs_exact(cloud):
    points, x = cloud
    best, passes = kmeans.batched_kmeans(points.select("key", "x"), [2, 3, 4, 5], restarts=4)
    assert passes <= 110
    for k, s in best.items():
        assert s.centers.shape == (k, 3) and abs(s.cost - cost_of(x, s.centers)) < 1e-3
        near = ((x[:, None, :] - s.centers[None]) ** 2).sum(-1).argmin(1)
        means = np.array([x[near == c].mean(0) for c in range(k)])
        assert ((means - s.centers) ** 2).sum() < 1e-3
    costs = [best[k].cost for k in (2, 3, 4, 5)]
    assert costs == sorted(costs, reverse=True)


def test_no_worse_than_single_fits(spark, cloud):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    points, x = cloud
    best, _ = kmeans.batched_kmeans(points.select("key", "x"), [3, 4], restarts=10)
    data = points.select(array_to_vector("x").alias("features"))
    for k in (3, 4):
        single = min(KMeans(k=k, seed=r, maxIter=100).fit(data).summary.trainingCost for r in range(4))
        assert best[k].cost <= 1.001 * single


def test_the_same_on_any_number_of_tasks(cloud, spark, scratch_dir):
    points, _ = cloud
    points.select("key", "x").coalesce(1).write.parquet(f"{scratch_dir}/cloud-one")
    one = spark.read.parquet(f"{scratch_dir}/cloud-one")
    a, _ = kmeans.batched_kmeans(points.select("key", "x"), [3], restarts=3)
    b, _ = kmeans.batched_kmeans(one, [3], restarts=3)
    assert (a[3].centers == b[3].centers).all() and a[3].cost == b[3].cost


def test_settled_sets_leave_the_passes(cloud, monkeypatch):
    points, _ = cloud
    sizes = []
    real = kmeans.pass_sums
    monkeypatch.setattr(kmeans, "pass_sums", lambda p, sets, dims: sizes.append(len(sets)) or real(p, sets, dims))
    kmeans.batched_kmeans(points.select("key", "x"), [2, 5], restarts=5)
    assert sizes[0] == 10 and sizes[-2] < 10 and sizes[-1] == 10


def test_starts_are_spread_by_distance(cloud):
    """Drawn by squared distance, four centers meet all four groups in nearly every start."""
    points, x = cloud
    sets = [kmeans.CenterSet(4, r) for r in range(30)]
    for step in range(4):
        kmeans.draw_centers(points.select("key", "x"), sets, 3, step, 1)
    middles = np.array([[0, 0, 0], [4, 0, 1], [0, 5, 0], [3, 3, 3]])
    met = [len({int(((c - middles) ** 2).sum(1).argmin()) for c in s.centers}) for s in sets]
    assert np.mean([m == 4 for m in met]) > 0.6 and all(any((x == c).all(1)) for s in sets for c in s.centers)


def test_few_points_and_none(spark, scratch_dir):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 2.0])], "key long, x array<double>")
    best, _ = kmeans.batched_kmeans(df, [2, 3], restarts=2)
    assert best[2].cost == 0 and best[3].cost == 0
    assert kmeans.batched_kmeans(df.where("key > 9"), [2], restarts=2)[0][2].centers.size == 0


def test_model_round_trip(spark, cloud, tmp_path):
    points, x = cloud
    model = kmeans.CentersModel(np.array([[0.0, 0, 0], [4, 0, 1], [0, 0, 0]]))
    model.save(spark, str(tmp_path / "m"))
    again = kmeans.CentersModel.load(spark, str(tmp_path / "m"))
    got = {r.id: r.cluster for r in again.transform(points, features="x").collect()}
    want = ((x[:, None, :] - model.centers[None]) ** 2).sum(-1).argmin(1)
    assert all(got[i] == w for i, w in enumerate(want))


def test_nearest_center_is_the_lower_number_on_ties():
    d = np.array([[3.0, 1.0, 2.0, 0.0], [2.0, 1.0, 2.0, 5.0], [2.0, 0.5, 2.0, 0.0]])
    hot, near = kmeans.nearest(d)
    assert hot.argmax(axis=0).tolist() == d.argmin(axis=0).tolist() == [1, 2, 0, 0]
    assert hot.sum(axis=0).tolist() == [1, 1, 1, 1] and near.tolist() == d.min(axis=0).tolist()


def test_sums_of_one_pass_are_exact_over_several_chunks(cloud, monkeypatch):
    points, x = cloud
    sets = [kmeans.CenterSet(2, 0), kmeans.CenterSet(3, 0)]
    sets[0].centers, sets[1].centers = x[[0, 200]], x[[0, 200, 400]]
    monkeypatch.setattr(kmeans, "ROWS", 7)
    found = kmeans.pass_sums(points.select("key", "x"), sets, 3)
    for i, s in enumerate(sets):
        d = ((x[:, None, :] - s.centers[None]) ** 2).sum(-1)
        for r in found[i]:
            mine = x[d.argmin(1) == r["c"]]
            assert r["n"] == len(mine) and r["s"] == np.rint(mine * kmeans.FIXED).astype(np.int64).sum(0).tolist()
        assert sum(r["n"] for r in found[i]) == len(x)


def test_a_sweep_reads_its_points_with_all_cores(spark, monkeypatch):
    from basketlab.operators import segmentation as seg
    from pyspark.ml.functions import array_to_vector
    df = spark.range(60).select(F.col("id").alias("user_id"), array_to_vector(F.array(
        (F.col("id") % 7).cast("double"), (F.col("id") % 2).cast("double"))).alias("features")).coalesce(1)
    files, real = [], seg.batched_kmeans
    monkeypatch.setattr(seg, "batched_kmeans", lambda points, *a: files.append(len(points.inputFiles())) or real(points, *a))
    seg.k_sweep(df, ks=[2, 3], restarts=2, sample_size=20)
    assert files[0] >= spark.sparkContext.defaultParallelism


def test_a_sweep_scores_all_its_silhouettes_in_one_job(spark, monkeypatch):
    """The driver keeps the plan and code of each job, so they must not follow the ks."""
    from basketlab.operators import segmentation as seg
    from pyspark.ml.functions import array_to_vector
    df = spark.range(90).select(F.col("id").alias("user_id"), array_to_vector(F.array(
        (F.col("id") % 7).cast("double"), (F.col("id") % 4).cast("double"))).alias("features"))
    calls, real = [], seg.silhouettes
    monkeypatch.setattr(seg, "silhouettes", lambda *a, **b: calls.append(1) or real(*a, **b))
    sweep, models = seg.k_sweep(df, ks=[2, 3, 4], restarts=2, sample_size=60)
    assert len(calls) == 1
    sample = seg.seeded_sample(df, size=60)
    want = {k: seg.silhouette(m.transform(sample), max_points=60).first().silhouette for k, m in models.items()}
    assert {r.k: r.silhouette for r in sweep.collect()} == want and all(0 < v < 1 for v in want.values())


def test_silhouettes_with_missing_labels_and_without_points(spark):
    from basketlab.operators import segmentation as seg
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 1.0), (3, 1, 9.0), (4, 1, 8.0)], "user_id long, a int, x double")
    from pyspark.ml.functions import array_to_vector
    df = df.select("user_id", "a", F.when(F.col("a") == 1, 1).alias("b"), array_to_vector(F.array("x")).alias("features"))
    got = {r.label: r for r in seg.silhouettes(df, ["a", "b"]).collect()}
    assert got["a"].n == got["b"].n == 4 and got["a"].silhouette > 0.8 and got["b"].silhouette == 0
    none = seg.silhouette(df.where("user_id > 9"), "a").first()
    assert none.silhouette is None and none.n == 0


def test_the_driver_lets_go_of_finished_passes(cloud, monkeypatch):
    points, _ = cloud
    freed = []
    monkeypatch.setattr(kmeans, "RELEASE_EVERY", 2)
    monkeypatch.setattr(kmeans, "release", freed.append)
    _, passes = kmeans.batched_kmeans(points.select("key", "x"), [5], restarts=3)
    # 5 draws, then moves, and a last pass for the costs
    assert len(freed) >= (passes - 7) // 2 > 0
