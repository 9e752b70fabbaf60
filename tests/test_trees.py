"""Forest and boosted trees against plain Python, and restarts."""
import math
import os

import numpy as np
import pytest

from basketlab.operators import binning, boosting, forest
from basketlab.operators.conversion import roc_auc, roc_points


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        a, b, c = int(rng.integers(0, 9)), float(np.round(rng.normal(), 1)), rng.choice(["x", "y", "z", None])
        p = 1 / (1 + math.exp(-(a - 4 + 2 * b + (c == "x"))))
        rows.append((f"k{i}", float(rng.random() < p), a, b, int(rng.integers(0, 2)), c))
    return spark.createDataFrame(rows, "session_id string, label double, a int, b double, c int, d string").repartition(3)


@pytest.fixture(scope="module")
def space(train):
    return binning.fit_space(train, ["a", "b", "c"], ["d"])


def tree_table(spark, trees):
    from basketlab.operators.joins import materialize
    return materialize(spark.createDataFrame(trees, "tree int, slot int, nodes binary"), "trees")


def python_rows(train, space):
    import pyspark.sql.functions as F
    rows = train.select(F.xxhash64("session_id").alias("key"), "label", "a", "b", "c", "d").collect()
    bins = space.bins([np.array([float(r[c]) for r in rows]) for c in "abc"], [[r["d"] for r in rows]])
    return (np.array([r["key"] for r in rows], np.int64).view(np.uint64),
            np.array([int(r["label"]) for r in rows]), bins)


def test_space_has_a_cut_between_any_two_values(space, train):
    assert space.names == ["a", "b", "c", "d_x", "d_y", "d_z"]
    assert space.cuts[0].tolist() == [i + 0.5 for i in range(8)] and space.cuts[2].tolist() == [0.5]
    again = binning.FeatureSpace.from_json(space.to_json())
    assert again.names == space.names and all((x == y).all() for x, y in zip(again.cuts, space.cuts))


def test_bins_follow_the_cuts(spark, space):
    df = spark.createDataFrame([(0, -5, 0.0, None, "x"), (1, 99, float("nan"), 1, "new"), (2, 3, None, 0, None)],
                               "id long, a int, b double, c int, d string")
    got = {r.id: list(r.bins) for r in binning.binned(df, space, ["id"]).collect()}
    zero = int((space.cuts[1] < 0).sum())
    assert got == {0: [0, zero, 0, 1, 0, 0], 1: [8, zero, 1, 0, 0, 0], 2: [3, zero, 0, 0, 0, 0]}


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(20_000).selectExpr("cast(id as double) / 7 AS v")
    space = binning.fit_space(df, ["v"], [])
    counts = [r["count"] for r in binning.binned(df, space, ["v"]).groupBy("bins").count().collect()]
    assert len(space.cuts[0]) == 255 and max(counts) < 3 * 20_000 / 256


# --- forest ---------------------------------------------------------------------------

def slow_tree(bins, label, times, node_id, spec):
    """A nested tree, node by node, every split tried: (feature, cut, left, right) or value."""
    rows = [i for i in range(len(bins)) if times[i]]
    w = spec.weights

    def counts(part):
        return sum(times[i] * (1 - label[i]) for i in part), sum(times[i] * label[i] for i in part)

    def pure(a, b):
        a, b = a * w[0], b * w[1]
        return (a * a + b * b) / (a + b) if a + b > 0 else 0.0

    def at(part, ident):
        a, b = counts(part)
        value = b * w[1] / (a * w[0] + b * w[1])
        if not a or not b or len(part) < 2 * spec.min_leaf:
            return value
        order = forest.feature_order(np.array([ident], np.uint64), spec.features)[0]
        best = None
        for start in range(0, spec.features, spec.tried):
            for f in order[start:start + spec.tried]:
                for cut in sorted({int(bins[i, f]) for i in part}):
                    left = [i for i in part if bins[i, f] <= cut]
                    if min(len(left), len(part) - len(left)) >= spec.min_leaf:
                        la, lb = counts(left)
                        score = pure(la, lb) + pure(a - la, b - lb)
                        if best is None or score > best[0]:
                            best = (score, int(f), cut, left)
            if best:
                break
        if not best:
            return value
        _, f, cut, left = best
        right = [i for i in part if bins[i, f] > cut]
        return (f, cut, at(left, forest.child_ids(np.uint64(ident), 0)), at(right, forest.child_ids(np.uint64(ident), 1)))

    return at(rows, node_id)


def nested(nodes, i=0):
    if nodes["feature"][i] < 0:
        return float(nodes["value"][i])
    left = int(nodes["left"][i])
    return (int(nodes["feature"][i]), int(nodes["cut"][i]), nested(nodes, left), nested(nodes, left + 1))


def trees_of(model):
    sub = {(r.tree, r.slot): np.frombuffer(r.nodes, forest.NODE) for r in model.subtrees.collect()}
    return [nested(forest.joined(model.upper[t], {s: n for (u, s), n in sub.items() if u == t})) for t in sorted(model.upper)]


@pytest.mark.parametrize("rows_per_task", [100_000, 60])
def test_every_split_equals_plain_python(train, space, rows_per_task):
    """Trees finished from the root in tasks, and trees handed over below several passes."""
    model = forest.fit_forest(train, space, (0.8, 1.3), trees=4, rows_per_task=rows_per_task)
    keys, label, bins = python_rows(train, space)
    spec = forest.Spec(6, (0.8, 1.3), 4)
    want = [slow_tree(bins, label.tolist(), forest.row_counts(keys, t, 42).tolist(), forest.root_id(t, 42), spec)
            for t in range(4)]
    assert trees_of(model) == want
    if rows_per_task == 60:
        assert sum(len(u) for u in model.upper.values()) > 40


def test_a_table_that_fits_a_task_is_not_dealt_by_tree(train, space, monkeypatch):
    def dealt(*_):
        raise AssertionError("rows were dealt once a tree")
    with monkeypatch.context() as m:
        m.setattr(forest, "deal", dealt)
        whole = forest.fit_forest(train, space, (0.8, 1.3), trees=5)
    monkeypatch.setattr(forest, "WHOLE", 0)
    assert trees_of(whole) == trees_of(forest.fit_forest(train, space, (0.8, 1.3), trees=5))


def test_large_levels_are_split_some_nodes_at_a_time(monkeypatch):
    rng = np.random.default_rng(8)
    bins, label = rng.integers(0, [256, 2, 9, 40, 1], (3000, 5)).astype(np.uint8), rng.integers(0, 2, 3000)
    times, spec = 1 + rng.poisson(1, 3000), forest.Spec(5, (0.7, 1.4))
    want, removed = forest.grow(bins, label, times, np.uint64(3), spec)
    for rows in (1, 50, 700):
        monkeypatch.setattr(forest, "GROUP_ROWS", rows)
        nodes, also = forest.grow(bins, label, times, np.uint64(3), spec)
        assert (nodes == want).all() and (also == removed).all()
    assert nested(want) == slow_tree(bins, label.tolist(), times.tolist(), np.uint64(3), spec)


def test_no_leaf_is_small_and_depth_has_no_limit(spark):
    # one value after the other splits off: a tree as deep as it gets with five rows a leaf
    rows = [(f"k{i}", float(i // 5 % 2), float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "session_id string, label double, v double")
    space = binning.fit_space(df, ["v"], [])
    model = forest.fit_forest(df, space, (1.0, 1.0), trees=3)

    def depth(t):
        return 1 + max(depth(t[2]), depth(t[3])) if isinstance(t, tuple) else 0
    assert max(depth(t) for t in trees_of(model)) >= 8


def test_both_ways_of_scoring_agree(spark, train, space, monkeypatch, tmp_path):
    model = forest.fit_forest(train, space, (1.0, 1.0), trees=6, rows_per_task=80)
    model.save(spark, str(tmp_path / "m"))
    model = forest.ForestModel.load(spark, str(tmp_path / "m"))
    one = {r.session_id: r.p for r in model.with_probability(train).collect()}
    monkeypatch.setattr(forest, "BROADCAST_BYTES", -1)
    two = {r.session_id: r.p for r in model.with_probability(train).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)
    good = sum((one[r.session_id] >= 0.5) == (r.label == 1) for r in train.collect()) / 900
    assert good > 0.85
    assert abs(sum(v for _, v in model.feature_importance()) - 1) < 1e-9
    assert max(model.feature_importance(), key=lambda x: x[1])[0] in ("a", "b")


@pytest.mark.parametrize("rows_per_task", [100_000, 80])
def test_rows_are_dealt_once_a_pack_of_subtrees(spark, train, space, monkeypatch, rows_per_task):
    model = forest.fit_forest(train, space, (1.0, 1.0), trees=12, rows_per_task=rows_per_task)
    one = {r.session_id: r.p for r in model.with_probability(train).collect()}
    monkeypatch.setattr(forest, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(forest, "PACK_ROWS", 200)
    size = model.subtrees.selectExpr("sum(length(nodes))").first()[0]
    monkeypatch.setattr(forest, "PACK_BYTES", size // 3)
    two = {r.session_id: r.p for r in model.with_probability(train).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_walks_end_at_leaves_of_any_depth():
    # a chain: bin b of the only feature leaves it at depth b + 1
    nodes = np.zeros(2 * 100 + 1, forest.NODE)
    nodes["feature"] = -1
    for i in range(100):
        at = 0 if i == 0 else 2 * i
        nodes["feature"][at], nodes["cut"][at], nodes["left"][at] = 0, i, 2 * i + 1
    bins = np.arange(256, dtype=np.uint8)[:, None]
    want = [2 * b + 1 if b < 100 else 200 for b in range(256)]
    assert forest.walk(nodes, bins).tolist() == want
    assert forest.walk(nodes[-1:], np.zeros((3, 0), np.uint8)).tolist() == [0, 0, 0]


def test_dealt_rows_never_go_to_the_driver(spark, train, space, monkeypatch):
    # a row is dealt once a tree: the input's size, small here, must not make it a broadcast
    model = forest.fit_forest(train, space, (1.0, 1.0), trees=3)
    monkeypatch.setattr(forest, "BROADCAST_BYTES", -1)
    plan = model.with_probability(train)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_trees_of_some_megabytes_never_go_to_the_driver(spark, monkeypatch):
    # 60 trees of 9 MB in all; a tree's root is a leaf here, what follows it is never reached
    from pyspark.sql import functions as F
    values = np.random.default_rng(3).random(60)
    nodes = np.zeros(10_000, forest.NODE)
    nodes["feature"] = -1
    trees = []
    for t, v in enumerate(values):
        nodes["value"][0] = v
        trees.append((t, 0, bytearray(nodes.tobytes())))
    subtrees = tree_table(spark, trees)
    upper = {t: nodes[:1].copy() for t in range(60)}
    model = forest.ForestModel(binning.FeatureSpace(["v"], [np.array([0.5])], []), subtrees, upper, np.ones(1))
    rows = spark.range(300).select(F.col("id"), (F.col("id") % 2).alias("v"))

    collect = type(rows).collect

    def watched(self):
        assert "nodes" not in self.columns, "trees were collected"
        return collect(self)
    with monkeypatch.context() as m:
        m.setattr(type(rows), "collect", watched)
        scored = [model.with_probability(rows.repartition(n)) for n in (2, 7)]
    found = {r.p for df in scored for r in df.select("p").collect()}
    assert len(found) == 1 and abs(found.pop() - values.mean()) < 1e-12


def test_large_nodes_that_nothing_splits_stay_leaves(spark):
    rows = [(f"k{i}", float(i % 2), 1.0 if i < 400 else 2.0) for i in range(800)]
    df = spark.createDataFrame(rows, "session_id string, label double, v double")
    model = forest.fit_forest(df, binning.fit_space(df, ["v"], []), (1.0, 1.0), trees=2, rows_per_task=50)
    assert [t[:2] for t in trees_of(model)] == [(0, 0)] * 2 and model.subtrees.count() == 4


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([(f"k{i}", 1.0, float(i)) for i in range(30)], "session_id string, label double, v double")
    space = binning.fit_space(df, ["v"], [])
    model = forest.fit_forest(df, space, (1.0, 1.0), trees=2)
    assert {r.p for r in model.with_probability(df).collect()} == {1.0}
    none = df.where("label > 5")
    assert forest.fit_forest(none, space, (1.0, 1.0), trees=2).with_probability(df).count() == 30
    boosted = boosting.fit_boosted(none, space, (1.0, 1.0), boosting.Settings(rounds=2), "/tmp/none")
    assert {r.p for r in boosted.with_probability(df).collect()} == {0.5}


# --- boosting -----------------------------------------------------------------------------

def slow_boost(bins, label, weights, s):
    """Leaf-wise boosting, every split of every leaf tried on sums of whole numbers."""
    w = [weights[y] for y in label]
    ones, zeros = sum(label), len(label) - sum(label)
    start = math.log(ones * weights[1] / (zeros * weights[0]))
    score, trees = [start] * len(label), []
    for _ in range(s.rounds):
        p = [1 / (1 + np.exp(-x)) for x in score]
        g = [int(np.rint(wi * (pi - y) * boosting.FIXED)) for wi, pi, y in zip(w, p, label)]
        h = [int(np.rint(wi * pi * (1 - pi) * boosting.FIXED)) for wi, pi in zip(w, p)]

        def best(part):
            found = (0.0, -1, 0)
            G, H = sum(g[i] for i in part) / boosting.FIXED, sum(h[i] for i in part) / boosting.FIXED
            for f in range(bins.shape[1]):
                for cut in range(int(bins[:, f].max())):
                    left = [i for i in part if bins[i, f] <= cut]
                    if min(len(left), len(part) - len(left)) < s.min_rows:
                        continue
                    gl, hl = sum(g[i] for i in left) / boosting.FIXED, sum(h[i] for i in left) / boosting.FIXED
                    gain = gl**2 / hl + (G - gl) ** 2 / (H - hl) - G**2 / H
                    if gain > found[0]:
                        found = (gain, f, cut)
            return found

        nodes, parts = [None], [list(range(len(label)))]
        bests = [best(parts[0])]
        while sum(n is None for n in nodes) < s.leaves:
            at = max((i for i in range(len(nodes)) if nodes[i] is None), key=lambda i: (bests[i][0], -i))
            gain, f, cut = bests[at]
            if gain <= 0:
                break
            nodes[at] = (f, cut, len(nodes))
            for side in (0, 1):
                parts.append([i for i in parts[at] if (bins[i, f] > cut) == side])
                nodes.append(None)
                bests.append(best(parts[-1]))
        for n, part in zip(nodes, parts):
            if n is None:
                v = -s.rate * sum(g[i] for i in part) / sum(h[i] for i in part)
                for i in part:
                    score[i] += v
        trees.append([n for n in nodes])
    return trees


def shape(nodes):
    return [(int(f), int(c), int(left)) if f >= 0 else None for f, c, left, _ in nodes.tolist()]


@pytest.mark.parametrize("weight", [1.0, 1e7])
def test_features_are_counted_together(weight, monkeypatch):
    """Histograms from a few codes a row, with curvatures that share a number with the rows or not."""
    rng = np.random.default_rng(2)
    widths = [2] * 18 + [256, 7, 1, 30]
    bins = rng.integers(0, widths, (5000, 22)).astype(np.uint8)
    g = rng.integers(-boosting.FIXED, boosting.FIXED, 5000) * weight // 1
    h = rng.integers(0, boosting.FIXED, 5000) * weight // 1
    cells = boosting.Cells(widths)
    assert len(cells.groups) == 4 and sum(cells.groups, []) == list(range(22))
    monkeypatch.setattr(boosting.Cells, "CHUNK", 999)
    codes = cells.codes(bins)
    for rows in (None, np.flatnonzero(rng.random(5000) < 0.3), np.zeros(0, np.int64)):
        some = slice(None) if rows is None else rows
        want = np.zeros((cells.total, 3), np.int64)
        for f in range(22):
            for j, v in enumerate((g, h, np.ones(5000))):
                np.add.at(want[:, j], cells.first[f] + bins[some, f], v[some].astype(np.int64))
        assert (cells.count(codes, g, h, rows) == want).all()


@pytest.mark.parametrize("rows_per_task", [100_000, 100])
def test_leafwise_trees_equal_plain_python(train, space, tmp_path, rows_per_task):
    """All rounds in one task, and by passes over the table."""
    s = boosting.Settings(rounds=3, leaves=6, rate=0.3, save_every=2)
    small = train.where("substring(session_id, -1) < '4'")
    model = boosting.fit_boosted(small, space, (0.9, 1.2), s, str(tmp_path), rows_per_task=rows_per_task)
    _, label, bins = python_rows(small, space)
    assert [shape(t) for t in model.trees] == slow_boost(bins, label.tolist(), (0.9, 1.2), s)


def test_passes_walk_few_trees_again_and_leave_one_table(train, space, tmp_path, monkeypatch):
    """Between two writings of the scores a pass sends rows down less than SCORE_EVERY trees."""
    s, again, written = boosting.Settings(rounds=9, leaves=4, save_every=25), [], []
    passes, scores = boosting.pass_histograms, boosting.with_scores
    monkeypatch.setattr(boosting, "pass_histograms", lambda *a: again.append(len(a[3])) or passes(*a))
    monkeypatch.setattr(boosting, "with_scores", lambda *a: written.append(a[-1]) or scores(*a))
    many = boosting.fit_boosted(train, space, (1.0, 1.0), s, str(tmp_path / "a"), rows_per_task=100)
    assert len(many.trees) == 9 and max(again) < 5 and len(written) == 2
    left = [os.path.exists(p.removeprefix("file:")) for p in written]
    assert left == [False, True]
    one = boosting.fit_boosted(train, space, (1.0, 1.0), s, str(tmp_path / "b"))
    assert all((x == y).all() for x, y in zip(one.trees, many.trees))


def test_both_ways_make_the_same_trees(spark, train, space, tmp_path):
    s = boosting.Settings(rounds=6, leaves=9, save_every=4)
    one = boosting.fit_boosted(train, space, (0.9, 1.2), s, str(tmp_path / "a"))
    two = boosting.fit_boosted(train, space, (0.9, 1.2), s, str(tmp_path / "b"), rows_per_task=100)
    assert one.start == two.start and all((x == y).all() for x, y in zip(one.trees, two.trees))
    one.save(spark, str(tmp_path / "m"))
    back = boosting.BoostedModel.load(spark, str(tmp_path / "m"))
    assert all((x == y).all() for x, y in zip(one.trees, back.trees)) and back.space.names == space.names


@pytest.mark.parametrize("rows_per_task", [100_000, 100])
def test_a_training_that_dies_goes_on_from_its_last_file(train, space, tmp_path, monkeypatch, rows_per_task):
    s = boosting.Settings(rounds=7, leaves=5, save_every=2)
    whole = boosting.fit_boosted(train, space, (1.0, 1.0), s, str(tmp_path / "a"), rows_per_task=rows_per_task)

    def lost(folder, start, trees, write=boosting.write_progress):
        if len(trees) > 4:
            raise RuntimeError("executor lost")
        write(folder, start, trees)

    with monkeypatch.context() as m:
        m.setattr(boosting, "write_progress", lost)
        with pytest.raises(Exception, match="executor lost"):
            boosting.fit_boosted(train, space, (1.0, 1.0), s, str(tmp_path / "b"), rows_per_task=rows_per_task)
    assert len(boosting.unpacked(boosting.last_progress(str(tmp_path / "b")))[1]) == 4
    grown = []
    name = "grow_tree" if rows_per_task > 100 else "tree_by_passes"
    if name == "tree_by_passes":
        real = boosting.tree_by_passes
        monkeypatch.setattr(boosting, name, lambda *a: grown.append(1) or real(*a))
    again = boosting.fit_boosted(train, space, (1.0, 1.0), s, str(tmp_path / "b"), rows_per_task=rows_per_task)
    assert all((x == y).all() for x, y in zip(whole.trees, again.trees)) and len(again.trees) == 7
    assert len(grown) in (0, 3)


# --- AUC and ROC -----------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["ties", "crowded", "one class"])
def test_auc_and_roc_over_many_ranges(spark, kind):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 4, 500) / 4 if kind == "ties" else 0.5 + rng.random(500) / 100
    y = np.ones(500) if kind == "one class" else (rng.random(500) < 0.3 + 0.4 * (p > 0.5)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, label double")
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)) if len(neg) else 0.0
    for per_range in (100_000, 20):
        assert abs(roc_auc(df, per_range).first()[0] - want) < 1e-12
    few = [tuple(r) for r in roc_points(df, 1, 20).orderBy("i").collect()]
    assert few == [tuple(r) for r in roc_points(df, 1).orderBy("i").collect()]
    if kind == "crowded":
        from basketlab.operators.conversion import running_totals
        sizes = [r["count"] for r in running_totals(df, 20).groupBy("r").count().collect()]
        assert len(sizes) > 15 and max(sizes) < 80


def test_models_are_measured_together_as_one_by_one(spark):
    from basketlab.operators.conversion import evaluate, running_totals
    rng = np.random.default_rng(4)
    rows = [(n, float(p), float(p >= 0.5), float(y)) for n, digits in [("a", 1), ("b", 3), ("one class", 2)]
            for p, y in zip(rng.random(300).round(digits), rng.random(300) < (0.4 if len(n) == 1 else 0.0))]
    df = spark.createDataFrame(rows, "name string, p double, pred double, label double")
    found = {r["name"]: r for r in evaluate(df).collect()}
    for name in ("a", "b", "one class"):
        mine = df.where(df.name == name)
        p, y = (np.array([r[i] for r in rows if r[0] == name]) for i in (1, 3))
        pos, neg = p[y == 1], p[y == 0]
        want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)) if len(pos) else 0.0
        assert abs(found[name]["roc_auc"] - want) < 1e-12
        assert found[name]["tp"] == ((p >= 0.5) & (y == 1)).sum() and found[name]["fp"] == ((p >= 0.5) & (y == 0)).sum()
        # few scores a range: ranges may hold the end of one name and the start of the next
        each = sorted(tuple(r) for r in running_totals(mine, 20).drop("r", "next").collect())
        both = running_totals(df, 20, ["name"])
        assert each == sorted(tuple(r) for r in both.where(both.name == name).drop("name", "r", "next").collect())


def test_training_measures_all_models_by_one_set_of_jobs(spark, tmp_path, monkeypatch):
    """One set a model filled the driver with plans and compiled code."""
    from basketlab.operators import conversion as conv
    rng = np.random.default_rng(5)
    rows = [(str(i), *rng.integers(0, 9, len(conv.NUMERIC)).tolist(), *rng.choice(["x", "y"], len(conv.CATEGORICAL)).tolist(),
             int(rng.random() < 0.4)) for i in range(240)]
    features = spark.createDataFrame(rows, "session_id string, " + ", ".join(
        [f"{c} long" for c in conv.NUMERIC] + [f"{c} string" for c in conv.CATEGORICAL]) + f", {conv.TARGET} long")
    calls, real = [], conv.running_totals
    monkeypatch.setattr(conv, "running_totals", lambda *a, **k: calls.append(1) or real(*a, **k))
    conv.train_conversion(features, str(tmp_path / "run"), str(tmp_path / "progress"), conv.Parameters(trees=3, rounds=3))
    assert len(calls) == 1
    run = conv.ConversionRun(features, str(tmp_path / "run"))
    monkeypatch.undo()
    for m in [*run.results, run.ablation]:
        s = conv.scored(run.model(m["name"]), run.test)
        assert abs(roc_auc(s).first()[0] - m["roc_auc"]) < 1e-12
        assert conv.confusion(s).first().asDict() == {c: m[c] for c in ("tn", "fp", "fn", "tp")}
