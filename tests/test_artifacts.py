"""The artifact store: one training for many sessions, nothing half visible."""
import subprocess
import sys
from pathlib import Path

import pytest

from basketlab.sources.artifacts import ArtifactStore

REPO = str(Path(__file__).resolve().parents[1])

APPLICATION = """
import sys
sys.path.insert(0, {repo!r})
from basketlab.operators import conversion as conv
from basketlab.operators import segmentation as seg
from basketlab.plans.registry import session_features_of, user_features_of
from basketlab.session import build_session
from basketlab.sources.fixtures import Shop
spark = build_session("local[2]", shuffle_partitions=4, extra={{
    "spark.checkpoint.dir": {shared!r} + "/ckpt", "spark.local.dir": {shared!r} + "/local"}})
if {forbidden}:
    def no(*a, **k):
        raise AssertionError("trained again")
    conv.train_conversion = seg.k_sweep = no
s = Shop(spark, {sf_dir!r})
run = conv.trained_run(session_features_of(s), s.files, conv.Parameters(trees=3, rounds=3))
rows = sorted(tuple(r) for r in conv.metrics_table(run).collect())
top = conv.with_probability(run.best_model, run.test).agg({{"p": "sum"}}).first()[0]
sweep, models = seg.trained_sweep(seg.standardize(user_features_of(s)), s.files, ks=[2, 3], restarts=2)
found = [tuple(r) for r in sweep.orderBy("k").collect()], [models[k].centers.round(9).tolist() for k in (2, 3)]
print("RESULT", run.path.rpartition("-")[2], rows, round(top, 9), found)
"""


def application(shared, sf_dir, forbidden):
    code = APPLICATION.format(repo=REPO, shared=str(shared), sf_dir=str(sf_dir), forbidden=forbidden)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    return next(line for line in out.stdout.splitlines() if line.startswith("RESULT"))


def test_two_applications_train_once_and_a_changed_file_trains_again(tmp_path):
    import os
    import shutil
    data = tmp_path / "data"
    shutil.copytree("/root/testdata/sf0.001", data)
    first = application(tmp_path, data, False)
    assert application(tmp_path, data, True) == first
    os.utime(data / "events.parquet", (1, 1))
    with pytest.raises(AssertionError, match="trained again"):
        application(tmp_path, data, True)


def test_a_lost_writer_leaves_nothing_visible(spark, tmp_path):
    store = ArtifactStore(spark, f"file://{tmp_path}")
    address = store.digest(a=1, b=["x"])

    def lost(path):
        spark.range(3).write.parquet(f"{path}/half")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.get("thing", address, lost)
    assert store.find("thing", address) is None
    path = store.get("thing", address, lambda p: spark.range(5).write.parquet(f"{p}/rows"))
    assert store.get("thing", address, lost) == path and spark.read.parquet(f"{path}/rows").count() == 5
    assert store.find("thing", store.digest(a=2, b=["x"])) is None
    gone = store.sweep(older_than_sec=-60)
    assert len(gone) == 1 and store.find("thing", address) == path
    assert spark.read.parquet(f"{path}/rows").count() == 5


def test_two_writers_leave_one_whole_artifact(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))

    def slow(path):
        spark.range(2).write.parquet(f"{path}/rows")
        store.publish("thing", "d", lambda p: spark.range(7).write.parquet(f"{p}/rows"))

    store.publish("thing", "d", slow)
    found = store.find("thing", "d")
    assert spark.read.parquet(f"{found}/rows").count() in (2, 7)
