"""Operators as Spark jobs against brute force, and learned ones on rows held out."""
import hashlib
import zlib

import pytest
from llm_helpers import BASE, NEAR, SMALL, oracle_rows, rows_of, write_tables

import corpus_pipeline
from basketlab.llm import common, op1_decontaminate, op3_line_dedup, op4_mixing, op5_exact_dedup
from basketlab.llm import op10_langid, op2_quality, op6_suffix_dedup, op7_licenses, op8_jaccard
from basketlab.llm import queries as llm

MIDDLE = "/root/testdata/sf0.01"


def texts(spark, folder):
    return [(r.doc_id, r.text) for r in
            spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def test_benchmark_in_shards_gives_the_same(spark):
    docs = common.read_columns(spark, SMALL, "documents", "doc_id", "text")
    items = common.read_columns(spark, SMALL, "benchmark", "item_id", "text")
    one = op1_decontaminate.decontaminate(docs, items)
    many = op1_decontaminate.decontaminate(docs, items, max_pattern_bytes=20_000)
    assert rows_of(one) == rows_of(many) and one.where("n_hit > 0").count() > 0


def test_hit_spans_are_places_of_the_text(spark):
    docs = spark.createDataFrame([(1, "Intro: ONE,two\nThree! end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three")], "item_id long, text string")
    row = op1_decontaminate.decontaminate(docs, items).first()
    (a, b), = row.spans
    assert row.text[a:b] == "ONE,two\nThree" and row.items == ["7"] and row.runs == [[1, 4]]


def brute_suffix(rows):
    first, out = {}, []
    rows = [(k, (t or "").encode()) for k, t in rows]
    for k, b in rows:
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, k), k)
    for k, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < k:
                gone[p:p + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((k, hashlib.sha256(kept).hexdigest(), len(b), sum(gone), runs))
    return sorted(out, key=repr)


@pytest.mark.parametrize("where", ["given", "odd"])
def test_suffix_dedup_is_exact(spark, request, where):
    folder = SMALL if where == "given" else request.getfixturevalue("odd")
    got = rows_of(llm.queries()["op6_suffix_dedup"](spark, folder))
    want = brute_suffix(texts(spark, folder))
    assert got == want and sum(r[3] for r in want) > 0


def test_one_passage_in_all_documents(spark):
    """Every document holds one anchor and most hold near-equal stretches: one bucket sorts
    windows that differ in a single byte, at any of its places."""
    import random
    rng = random.Random(8)
    passage = "the same passage stands in all of the documents, every one: "
    rows = []
    for i in range(150):
        at = rng.randrange(len(passage))
        changed = passage[:at] + chr(65 + i % 20) + passage[at + 1:] if i % 3 == 0 else passage
        rows.append((i // 2 if i % 10 == 0 else i, f"{i * i} own {'x' * (i % 7)} {changed * (1 + i % 3)}tail {i % 5}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.id, hashlib.sha256(r.kept).hexdigest(), r.n_bytes, r.n_removed, len(r.spans))
                  for r in op6_suffix_dedup.suffix_dedup(docs).collect()), key=repr)
    assert got == brute_suffix(rows) and sum(r[3] for r in got) > 5000


def test_suffix_dedup_across_small_flushes(spark):
    docs = common.read_columns(spark, SMALL, "documents", "doc_id", "text").selectExpr(
        "doc_id as id", "hash(text) as hash", "text").repartition(5)
    big = op6_suffix_dedup.removed_spans(docs, 7).select("id").distinct()
    small = op6_suffix_dedup.removed_spans(docs, 3, flush=2000).select("id").distinct()
    assert rows_of(big) == rows_of(small)


def brute_lines(rows, depth=3, similarity=0.8, min_docs=5):
    """Line dedup in plain Python, apart from the choice of a leaf's head."""
    import re
    kinds, places = {}, []
    for k, t in rows:
        for i, raw in enumerate((t or "").split("\n") if t is not None else []):
            tokens = [re.sub(".*[0-9].*", "<*>", x) for x in re.split("[ \t\r]+", raw) if x]
            if tokens:
                leaf = (len(tokens), tuple(tokens[:depth]))
                kinds.setdefault(leaf, {}).setdefault(tuple(tokens), []).append((k, t, i))
    return kinds


def test_line_dedup_drops_recurring_lines_but_their_first(spark):
    line = "Cookie notice number {} of this site, click here to accept all of them now"
    rows = [(i, f"{chr(97 + i) * 5} own text\n{line.format(i * 37)}\n\n{chr(98 + i) * 4} tail end")
            for i in range(8)]
    rows += [(100, "copy line that is in two documents only"), (101, "x\ncopy line that is in two documents only")]
    rows += [(200 + i, "an exact copy of a whole document\nwith two lines") for i in range(20)]
    out = {r.doc_id: r for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and out[0].n_dropped == 0
    for i in range(1, 8):
        assert out[i].text == f"{chr(97 + i) * 5} own text\n\n{chr(98 + i) * 4} tail end"
        assert (out[i].n_lines, out[i].n_dropped) == (4, 1)
    assert all(out[k].n_dropped == 0 for k in out if k >= 100)


def test_line_dedup_keeps_lines_outside_recurring_leaves(spark):
    """No line goes whose (length, leading tokens) stand in fewer than 5 texts, or, with more
    than 50 tokens, in fewer than 2."""
    rows = texts(spark, SMALL)
    kinds = brute_lines(rows)
    safe = {(k, i) for (n, _), leaf in kinds.items()
            if len({t for g in leaf.values() for _, t, _ in g}) < (2 if n > 50 else 5)
            for g in leaf.values() for k, _, i in g}
    out = {r.doc_id: r for r in llm.queries()["op3_line_dedup"](spark, SMALL).collect()}
    assert sum(r.n_dropped for r in out.values()) > 0
    for k, t in rows:
        left = out[k].text.split("\n") if t is not None else []
        for i, raw in enumerate((t or "").split("\n")):
            if (k, i) in safe:
                assert raw in left


def all_lines(spark, rows, similarity=0.8, min_docs=5, long_words=50):
    """Line dedup in plain Python with all its rules: {id: (text, n_lines, n_dropped)}. Only
    the order of equally frequent lines (by Spark's hash of the tokens) is taken from Spark."""
    leaves = brute_lines(rows)
    kinds = [list(t) for leaf in leaves.values() for t in leaf]
    sig = {tuple(r.t): r.sig for r in spark.createDataFrame([(k,) for k in kinds], "t array<string>")
           .selectExpr("t", "xxhash64(t) AS sig").collect()}
    gone = set()
    for (n, *_), leaf in leaves.items():
        need, groups = 2 if n > long_words else min_docs, []
        for t in sorted(leaf, key=lambda t: (len(leaf[t]), sig[t]), reverse=True):
            for head, places in groups:
                if sum(a == b for a, b in zip(t, head)) >= similarity * n:
                    places += leaf[t]
                    break
            else:
                groups.append((t, list(leaf[t])))
        for _, places in groups:
            if len({text for _, text, _ in places}) >= need:
                first = min((k, i) for k, _, i in places)
                gone |= {(k, i) for k, _, i in places} - {first}
    out = {}
    for k, t in rows:
        parts = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(parts) if (k, i) not in gone]
        out[k] = ("\n".join(kept) if t is not None else None, len(parts), len(parts) - len(kept))
    return out


def test_line_dedup_equals_plain_python(spark):
    rows = texts(spark, SMALL)
    # more of a leaf: templates with a variable name, of one frequency and of several
    rows += [(10**6 + i, f"{'abcdefghij'[i % 10] * (3 + i // 10)} own\nwe are the {kind} of {'klmnopqrst'[i % 10] * 2} here "
              "for all of you now") for i, kind in enumerate(["page"] * 12 + ["house"] * 12 + ["two words"] * 4)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = all_lines(spark, rows)
    assert got == want and sum(w[2] for w in want.values()) > 20


def test_license_base_columns_on_a_whole_table(spark):
    import re
    rows = texts(spark, SMALL)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in llm.queries()["op7_licenses"](spark, SMALL).collect()}
    for k, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+",
                       "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = [(i, label) for phrase, label in op7_licenses.PHRASES.items() for i in range(len(w))
              if w[i:i + len(phrase.split())] == phrase.split()]
        places = [i for i, _ in at]
        assert got[k] == (len(w), len(at), min(places, default=None), max(places, default=None),
                          ",".join(sorted({label for _, label in at})))
    assert sum(g[1] for g in got.values()) > 0


def test_pipeline_stages_decide_as_plain_python(spark):
    """Lines, near copies and contamination on the given table; the mix against its SQL."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, stages = texts(spark, SMALL), dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, docs, SMALL).collect() for name in list(stages)[1:]}

    want = all_lines(spark, rows)
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == {k: w[0] for k, w in want.items()}

    sets, comp = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b]) if a < b else 0
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((comp[a], comp[b]))
                comp = {k: x if c == y else c for k, c in comp.items()}
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted(k for k in comp if comp[k] == k)

    patterns = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = op1_decontaminate.WORD.findall("".join(c.lower() if c.isascii() else c for c in r.text or ""))
        n = min(13, len(w))
        patterns |= {tuple(w[i:i + n]) for i in range(len(w) - n + 1) if n}
    clean = []
    for k, t in rows:
        w = op1_decontaminate.WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        hit = {j for n in {len(p) for p in patterns} for i in range(len(w) - n + 1)
               if tuple(w[i:i + n]) in patterns for j in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(k)
    assert sorted(r.doc_id for r in kept["benchmark_decontamination"]) == sorted(clean)
    assert len(clean) < len(rows)

    mixed = oracle_rows(op4_mixing.ORACLE, SMALL)  # doc_id, size, source_size, taken, target
    assert {r.doc_id: r.repeats for r in kept["mix_sources"]} == {
        k: taken // size for k, size, _, taken, _ in mixed if taken}


def test_long_lines_go_from_their_second_document_on(spark):
    long, short = (" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
                   for w, n in (("pass", 51), ("tail", 50)))
    rows = [(1, f"one own\n{long}\n{short}"), (2, f"two other\n{short}\n{long}"), (3, f"{long}\nthree")]
    out = {r.doc_id: r for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].text == rows[0][1]
    assert (out[2].text, out[2].n_dropped) == (f"two other\n{short}", 1)
    assert (out[3].text, out[3].n_dropped) == ("three", 1)


def test_long_lines_are_compared_token_by_token(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)]
    rows = []
    for i in range(6):  # 98 of 100 tokens agree, the others far apart
        line = list(words)
        line[10], line[90] = "first" + "x" * i, "second" + "y" * i
        rows.append((i, " ".join(line)))
    far = [w if j < 79 else w + "far" for j, w in enumerate(words)]
    rows.append((6, " ".join(far)))
    out = {r.doc_id: r.n_dropped for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}


def test_second_template_of_a_leaf_is_found(spark):
    """A fixed line is the head; another template of the leaf differs in a name each time,
    and more unlike lines than one round has heads come before it."""
    names = "abcdefgh"
    rows = [(i, f"{names[i] * 4} own\nthis is the fixed foot of every page here now") for i in range(8)]
    rows += [(20 + i, f"{names[i] * 5} own\nthis is the page of user {names[i] * 3} in our shop") for i in range(8)]
    for i in range(20):
        unlike = " ".join(f"{chr(97 + i)}{c}" for c in "tuvwxyz")
        rows += [(100 + 2 * i + j, f"{chr(97 + i) * (6 + j)} own\nthis is the {unlike}") for j in range(2)]
    out = {r.doc_id: r.n_dropped for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {k: int(0 < k < 8 or 20 < k < 28) for k, _ in rows}


def test_thousands_of_unlike_lines_in_a_leaf_need_no_more_rounds(spark, monkeypatch):
    """3,000 lines of one leaf that agree with none, short ones and long ones, and a template
    among them: few rounds, and the plain-Python result."""
    import random
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, f"Posted by user {word()}\nit was said {' '.join(word() for _ in range(9))}") for i in range(3000)]
    kept = "it was said once more that all of it holds {} so"
    rows += [(5000 + i, f"own {word()}\n{kept.format(word())}") for i in range(7)]
    rounds = []
    real = op3_line_dedup.leaf_heads
    monkeypatch.setattr(op3_line_dedup, "leaf_heads", lambda *a: rounds.append(1) or real(*a))
    out = {r.doc_id: r for r in op3_line_dedup.line_dedup(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rounds) <= 2
    assert sum(r.n_dropped for r in out.values()) == 6 and all(out[i].n_dropped == 0 for i in range(3000))


def test_bands_lose_no_line_that_agrees(spark):
    """Lines with as many different tokens as may differ, at every place past the leading ones."""
    import itertools
    base = [f"t{chr(97 + i)}" for i in range(11)]
    lines = [" ".join(base)] + [" ".join("x" * (j + 1) if j in at else t for j, t in enumerate(base))
                                for at in itertools.combinations(range(3, 11), 2)]
    rows = [(i, t) for i, t in enumerate(lines)] + [(1000 + i, " ".join(base) + f"\nown {'y' * i}") for i in range(9)]
    out = op3_line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in out if r.n_dropped == 0) == [0]


def test_exact_dedup_in_several_batches(spark, odd, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    spark.read.parquet(f"{odd}/documents.parquet").repartition(6).write.parquet(path)
    one = op5_exact_dedup.exact_dedup(spark, path).drop("keep_at")
    many = op5_exact_dedup.exact_dedup(spark, path, max_bytes_per_batch=20_000)
    assert rows_of(one) == rows_of(many)


def test_colliding_digests_are_told_apart(spark, odd, monkeypatch):
    from pyspark.sql import functions as F
    right = rows_of(op5_exact_dedup.exact_dedup(spark, f"{odd}/documents.parquet").drop("text_sha256"))
    monkeypatch.setattr(op5_exact_dedup, "digest",
                        lambda t: F.substring(F.sha2(op5_exact_dedup.normalised(t).cast("binary"), 256), 1, 1))
    got = rows_of(op5_exact_dedup.exact_dedup(spark, f"{odd}/documents.parquet").drop("text_sha256"))
    assert got == right


def test_mix_of_overlapping_sources(spark):
    from pyspark.sql import functions as F
    rows = [(i, "w " * (1 + i % 50), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None])
            for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    picked, stats = op4_mixing.mix(docs, "doc_id", "text", F.col("members"))
    rows, again = picked.collect(), rows_of(op4_mixing.mix(docs, "doc_id", "text", F.col("members"))[0])
    assert len(rows) == 600 and rows_of(picked) == again
    assert all(r.taken == r.repeats * r.size and r.repeats <= 3 for r in rows)
    total = sum(r.target for r in stats.collect())
    assert abs(sum(r.taken for r in rows) - total) <= 3 * 50 + 3


def test_taken_words_come_near_the_targets(spark):
    rows = llm.queries()["op4_mixing"](spark, MIDDLE).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    groups = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        groups.setdefault(docs[r.doc_id], []).append(r)
    for g in groups.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= max(r.size for r in g) / 2 + 1


def shingle_set(t):
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", "".join(
        c.lower() if c.isascii() else c for c in t or "")) if x]
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_links_of_many_near_copies(spark):
    """A large group of near copies, chains that only link through a middle, and texts
    that share a long passage without being near copies."""
    rows = [(i, " ".join(f"g{j}" if j != i % 90 else f"own{i}" for j in range(90))) for i in range(300)]
    words = [f"c{j}" for j in range(100)]
    for step in range(6):  # each differs from the next by a few words
        rows.append((1000 + step, " ".join([f"new{step}"] * 0 + [f"n{j}" if j < 4 * step else w
                                                                  for j, w in enumerate(words)])))
    rows += [(2000 + i, " ".join(f"p{j}" for j in range(40)) + " "
              + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(80)]
    rows += [(3000, None), (3001, ""), (3002, "A b"), (3003, "a  B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.id: r.component_id for r in op8_jaccard.jaccard_components(docs).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    comp = {k: k for k in sets}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    assert got == {k: root(k) for k in keys}


def test_every_text_of_a_repeated_id_links(spark):
    a, b = (" ".join(f"{c}{j}" for j in range(60)) for c in "ab")
    rows = [(1, a), (2, f"{a} more"), (3, f"{b} more"), (2, b), (4, "alone it is"), (None, a), (4, None), (2, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.id or 0, r.n_shingles, r.component_id) for r in op8_jaccard.jaccard_components(docs).collect())
    assert got == sorted([(1, 56, 1), (2, 57, 1), (3, 57, 1), (2, 56, 1), (2, 56, 1), (4, 1, 4), (4, 0, 4), (0, 56, None)])


def test_items_without_an_id_hit(spark):
    docs = spark.createDataFrame([(1, "A b c d zz"), (2, "x y")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b c d"), (7, "x y"), (None, "x y")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in op1_decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (4, []), 2: (2, ["7"])}


@pytest.mark.parametrize("from_files", [True, False])
def test_rows_that_agree_keep_their_own_count_in_the_mix(spark, tmp_path, from_files):
    """Ten rows of one id and size, of which the mix takes some once more than others."""
    rows = [(1, f"w{i} x", "a") for i in range(10)] + [(2, "y " * 13, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if from_files:
        docs.write.parquet(str(tmp_path / "d"))
        docs = spark.read.parquet(str(tmp_path / "d"))
    kept = dict(corpus_pipeline.STAGES)["mix_sources"](spark, docs, SMALL).collect()
    picked, stats = op4_mixing.by_source(docs)
    want = picked.where("id = 1").agg({"taken": "sum"}).first()[0]
    got = sum(2 * r.repeats for r in kept if r.doc_id == 1)
    target = next(r.target for r in stats.collect() if r.source == "a")
    assert got == want and abs(got - target) <= 2 and len({r.text for r in kept if r.doc_id == 1}) == sum(
        r.doc_id == 1 for r in kept)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7) % n, (i * 7 + 7) % n) for i in range(n - 1)], "a long, b long")
    got = {r.id: r.comp for r in op8_jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(n)}


def test_license_phrases(spark):
    rows = [(1, "cc by cc by, CC-BY"), (2, "MIT\nLicense and the GNU general publik license"), (3, None)]
    out = {r.id: r for r in op7_licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1].n_base, out[1].first_word, out[1].last_word, out[1].base_labels) == (3, 0, 4, "cc-by")
    assert (out[2].n_base, out[2].base_labels, out[2].labels) == (1, "mit", "gpl,mit")
    assert (out[3].n_words, out[3].first_word, out[3].labels, out[3].score) == (0, None, "", 0.0)


def test_worse_notice_before_a_better_one_is_found():
    found = op7_licenses.Finder(op7_licenses.NOTICES).find("mozilla publik license mozilla public license")
    assert [(a, b, e) for a, b, i, e in found if op7_licenses.NOTICES[i][1] == "mpl"] == [(0, 22, 1), (23, 45, 0)]


def brute_notices(finder, flat):
    """All notices of a text without seeds: the best match of the whole text, then of the
    parts beside it, and so on."""
    out = []
    for i, pattern in enumerate(finder.patterns):
        parts = [(0, len(flat))]
        while parts:
            a, b = parts.pop()
            m = pattern.search(flat, a, b) if a < b else None
            if m and m.end() > m.start():
                out.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                parts += [(a, m.start()), (m.end(), b)]
    return sorted(out)


def test_notices_equal_a_search_without_seeds(spark):
    """Spans, labels and scores over a whole table, and on texts full of notices with edits."""
    import random
    finder, rng = op7_licenses.Finder(op7_licenses.NOTICES), random.Random(3)
    made = []
    for _ in range(40):
        words = []
        for _ in range(rng.randint(1, 6)):
            t = list(rng.choice(op7_licenses.NOTICES)[0])
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(["", "x", "e", "ab"])
            words.append("".join(t))
        made.append(rng.choice([" ", " and ", ""]).join(words))
    for text in made:
        assert finder.find(text) == brute_notices(finder, text), text
    rows = texts(spark, SMALL)
    got = {r.id: r for r in op7_licenses.scan(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    some = 0
    for k, t in rows:
        flat, lost = op7_licenses.flatten(op7_licenses.lowered(t))
        want = brute_notices(finder, flat) if len(flat) < 6000 else finder.find(flat)
        some += bool(want)
        places = [(f.start, f.end) for f in got[k].found]
        assert sorted(places) == sorted((op7_licenses.original(a, lost), op7_licenses.original(b - 1, lost) + 1)
                                        for a, b, _, _ in want)
        labels = set(filter(None, got[k].base_labels.split(","))) | {op7_licenses.NOTICES[i][1] for _, _, i, _ in want}
        assert got[k].labels == ",".join(sorted(labels))
        best = max([1 - e / len(op7_licenses.NOTICES[i][0]) for _, _, i, e in want], default=0.0)
        assert got[k].score == pytest.approx(1.0 if got[k].n_base else best)
    assert some > 3


def test_repeated_notices_take_linear_time():
    import time
    finder = op7_licenses.Finder(op7_licenses.NOTICES)
    times = []
    for n in (400, 1600, 6400):
        text = "all rihgts reserved " * n
        t0 = time.perf_counter()
        found = finder.find(text)
        times.append(time.perf_counter() - t0)
        assert len(found) == n
    assert times[1] < 0.5 and times[2] < 12 * max(times[1], 0.05)


def test_rare_label_is_learned(spark):
    """One label in two thousand: the sample holds its rows, and scores tell them apart."""
    rows = [(i, f"{'zq jxk vvq' if i % 2000 == 7 else 'the and of to in'} w{i % 31} w{i % 17} x{i % 7}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2000 = 7) AS quality")
    out = op2_quality.score(docs, op2_quality.fit(docs, labels, sample_rows=600)).collect()
    bad = [r.score for r in out if r.doc_id % 2000 == 7]
    good = sorted(r.score for r in out if r.doc_id % 2000 != 7)
    assert len(bad) == 10 and min(bad) > good[-20] and good[-1000] < 0.01


def plain_features(text):
    """Buckets of a short text, gram by gram."""
    import numpy as np
    from basketlab.llm.common import NOT_SPACE, mix, random_words, word_bounds, word_hashes
    data, salt, out = np.frombuffer((text or "").encode(), np.uint8), random_words(5, 4), []
    words = word_hashes(data, *word_bounds(data, NOT_SPACE))
    out += [int(w ^ salt[0]) for w in words]
    out += [int(mix(np.array([a * salt[1] + b]))[0]) for a, b in zip(words, words[1:])]
    for n in (3, 4):
        for at in range(len(data) - n + 1):
            gram = np.uint64(sum(int(data[at + j]) << (8 * j) for j in range(n)))
            out.append(int(mix(np.array([gram * salt[2] + np.uint64(n)]))[0]))
    return [x % op2_quality.BUCKETS for x in out]


def test_scores_equal_a_plain_forward_pass(spark):
    """The fitted model's scores over a whole table, and the pipeline stage's decisions."""
    import math
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights, bias = op2_quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {}
    for k, t in texts(spark, SMALL):
        ids = plain_features(t)
        z = bias + (sum(float(weights[i]) for i in ids) / len(ids) if ids else 0.0)
        want[k] = 1 / (1 + math.exp(-z))
    got = {r.doc_id: r.score for r in llm.queries()["op2_quality"](spark, SMALL).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, SMALL).collect()}
    assert kept == {k for k, p in got.items() if p >= 0.3} and 0 < len(kept) < len(got)


def test_languages_equal_a_plain_forward_pass(spark):
    import math
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    m = op10_langid.fit(docs)
    got = {r.doc_id: r for r in op10_langid.predict(docs, m).collect()}
    for k, t in texts(spark, SMALL):
        if not op10_langid.has_letter(t):
            assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
            continue
        ids, n = op10_langid.gram_counts(t)
        x = [(1 + math.log(c)) * float(m["idf"][i]) for i, c in zip(ids, n)]
        norm = math.sqrt(sum(v * v for v in x))
        z = [(sum(v / norm * float(m["weights"][i][c]) for v, i in zip(x, ids)) + float(m["weights"][-1][c]))
             / m["temperature"] for c in range(len(m["langs"]))]
        p = [math.exp(v - max(z)) for v in z]
        best = max(range(len(z)), key=lambda c: z[c])
        assert got[k].lang_pred == m["langs"][best] and abs(got[k].score - p[best] / sum(p)) < 1e-9


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    rows = llm.queries()["op2_quality"](spark, MIDDLE).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= 0.9


def test_language_on_held_out_rows(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = llm.queries()["op10_langid"](spark, MIDDLE).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.97


def test_rare_language_is_learned(spark):
    """Three ids of a rare language among 600 others, with a sample of 40 rows."""
    rows = [(i, f"the quick brown fox number {'abcdefghij'[i % 10] * 3} jumps", "en") for i in range(600)]
    rare = [i for i in range(1000, 1020) if zlib.crc32(str(i).encode()) % 4 != 2][:3]
    rows += [(i, "žluťoučký kůň úpěl ďábelské ódy", "cs") for i in rare]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = docs.selectExpr("doc_id AS k", "text", "lang")
    langs, ids = op10_langid.sampled_ids(known, 40)
    picked = [(r.lang, r.k) for r in ids.collect()]
    assert langs == ["cs", "en"] and len(picked) == 40
    assert {k for lang, k in picked if lang == "cs"} == set(rare)
    model = op10_langid.fit(docs, sample_rows=40)
    out = {r.doc_id: r.lang_pred for r in op10_langid.predict(docs, model).collect()}
    assert all(out[k] == lang for k, _, lang in rows)


def test_pipeline_stages_keep_columns_and_clean_documents(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, before, SMALL), name)
        want = before.columns + (["repeats"] if name == "mix_sources" else [])
        assert after.columns == want
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        left = {r.doc_id for r in after.select("doc_id").collect()}
        assert left <= ids
        if name == "line_dedup":
            assert left == ids
        if name == "near_copies":
            sets = {r.doc_id: shingle_set(r.text) for r in before.collect()}
            for k in ids - left:  # each dropped one has a near copy among the input
                assert any(o != k and 100 * len(sets[k] & sets[o]) >= 75 * len(sets[k] | sets[o])
                           for o in ids if sets[o])
            for a in left:
                for b in left:
                    n = len(sets[a] & sets[b])
                    assert a >= b or not n or 100 * n < 75 * len(sets[a] | sets[b])
        before = after
    assert rows_of(corpus_pipeline.run(spark, SMALL)) == rows_of(before)


def test_pipeline_on_odd_and_empty_tables(spark, odd, nulls, empty):
    for folder in (odd, nulls, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert set(docs.columns) <= set(out.columns)
        assert out.count() <= 3 * docs.count()


def test_one_of_each_near_group_stays(spark, tmp_path):
    folder = write_tables(spark, str(tmp_path), [(1, BASE, "en", "a"), (2, NEAR, "en", "a"), (3, "x y", "en", "a")])
    out = corpus_pipeline.near_copies(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
