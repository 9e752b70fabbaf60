"""Pieces that run inside tasks, against brute force."""
import hashlib
import random

import numpy as np
import pytest
import zstandard

from basketlab.llm import op1_decontaminate as op1
from basketlab.llm import op2_quality as op2
from basketlab.llm import op4_mixing as op4
from basketlab.llm import op6_suffix_dedup as op6
from basketlab.llm import op7_licenses as op7
from basketlab.llm import op8_jaccard as op8
from basketlab.llm import op9_warc as op9
from basketlab.llm import op10_langid as op10


def data(text):
    return np.frombuffer(text.encode(), np.uint8)


# --- decontamination ---------------------------------------------------------

def test_words_lower_only_ascii_letters():
    assert op1.item_words("ÀB-c3 Ünd_x") == ["Àb", "c3", "Ünd", "x"]
    assert op1.item_words(None) == op1.item_words("-- ..") == []


def test_runs_that_touch_become_one():
    assert op1._merged([(5, 8), (0, 3), (3, 5), (9, 10), (6, 7)]) == [(0, 8), (9, 10)]


# --- suffix dedup ------------------------------------------------------------

def test_runs_of_a_text_hold_every_window_once(monkeypatch):
    rng = random.Random(1)
    text = data("".join(rng.choice("ab ") for _ in range(3000)) + "z" * 400)
    monkeypatch.setattr(op6, "STRETCH", 700)
    runs = op6.text_runs(text, op6.Powers())
    seen = sorted(p for a, b in zip(runs["lo"], runs["hi"]) for p in range(a, b + 1))
    assert seen == list(range(len(text) - op6.DEPTH + 1))


def test_equal_windows_have_equal_anchors():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcde ") for _ in range(120))
    a, b = data("x" * 37 + shared + "y" * 50), data("q" * 91 + shared + "p" * 60)
    key = []
    for text, at in ((a, 37), (b, 91)):
        runs = op6.text_runs(text, op6.Powers())
        owner = {p: r for i, r in enumerate(runs) for p in range(runs["lo"][i], runs["hi"][i] + 1)}
        key.append([int(owner[at + i]["anchor"]) for i in range(len(shared) - op6.DEPTH + 1)])
    assert key[0] == key[1]


@pytest.mark.parametrize("differ_at", [0, 7, 8, 31, 41, 42, 47, 48, 49])
def test_digits_cover_every_byte(differ_at):
    """Two suffixes are equal to depth only if all 50 bytes are."""
    text = np.concatenate([data("k" * 60), data("k" * 60)])
    place, ids = np.array([0, 60]), np.array([4, 9])
    assert op6.radix_sort(text, place, ids).tolist() == [False, True]
    text[60 + differ_at] = ord("j")
    assert not op6.radix_sort(text, place, ids).any()


def test_radix_sort_equals_comparing_all_suffixes():
    rng = np.random.default_rng(6)
    parts = [rng.integers(97, 99, 12) for _ in range(4)]
    text = np.concatenate([parts[i] for i in rng.integers(0, 4, 120)]).astype(np.uint8)
    place = np.arange(len(text) - op6.DEPTH + 1)
    ids = rng.integers(0, 40, len(place))
    first = {}
    for p, i in zip(place, ids):
        w = text[p:p + op6.DEPTH].tobytes()
        first[w] = min(first.get(w, i), i)
    want = [bool(first[text[p:p + op6.DEPTH].tobytes()] < i) for p, i in zip(place, ids)]
    assert op6.radix_sort(text, place, ids).tolist() == want and any(want) and not all(want)


def test_stretches_are_unpacked_as_they_were():
    import zstandard
    rng, held, want = random.Random(3), op6.Stretches(1 << 30), {}
    for doc in range(5):
        text = data("".join(rng.choice("abc") for _ in range(400)))
        lo = np.array(sorted(rng.sample(range(300), 6)))
        hi, bucket = lo + np.array([rng.randint(0, 30) for _ in lo]), np.array([rng.randint(0, 2) for _ in lo])
        held.add(doc, doc * 7, text, lo, hi, bucket)
        for x, y, b in zip(lo, hi, bucket):
            want.setdefault(int(b), []).append((doc, doc * 7, int(x), text[x:y + op6.DEPTH].tobytes()))
    got = {}
    for r in held.rows().to_pylist():
        parts = [zstandard.ZstdDecompressor().decompress(x) for x in op6.parted(r["records"])]
        doc, lo, size = (op6.from_plane(x, r["n"]) for x in parts[:3])
        own, at = np.frombuffer(r["owners"], op6.OWNER), 0
        for d, x, n in zip(doc, lo, size):
            got.setdefault(r["bucket"], []).append((int(own["id"][d]), int(own["hash"][d]), int(x), parts[3][at:at + n]))
            at += int(n)
    assert {b: sorted(v) for b, v in got.items()} == {b: sorted(v) for b, v in want.items()}


def test_merged_spans():
    a, b = op6.merged(np.array([5, 0, 3, 20]), np.array([9, 4, 5, 21]))
    assert a.tolist() == [0, 20] and b.tolist() == [9, 21]


# --- Jaccard -----------------------------------------------------------------

def test_prefixes_of_linked_sets_share_the_asked_number():
    """The theorem the join rests on: min(l, l') tokens in common."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, op8.CELLS).astype(np.float32)
    for _ in range(400):
        n = int(rng.integers(1, 60))
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        keep = base[rng.random(len(base)) > 0.15]
        other = np.unique(np.concatenate((keep, rng.integers(0, 2**63, int(rng.integers(0, 4)), dtype=np.uint64))))
        if not len(other):
            continue
        both = len(np.intersect1d(base, other))
        if 100 * both < 75 * (len(base) + len(other) - both):
            continue
        (p, l), (q, k) = (op8.adaptive_prefix(x, counts, float(rng.integers(0, 50))) for x in (base, other))
        assert len(np.intersect1d(p, q)) >= min(l, k)
        need = -(-75 * (len(base) + len(other)) // 175)  # the prefixes for just these sizes
        p, q = (x[:len(y) - need + min(l, k)] for x, y in ((p, base), (q, other)))
        assert len(np.intersect1d(p, q)) >= min(l, k)


def test_shingles_of_short_and_cased_texts():
    assert len(op8.shingles(data(""))) == len(op8.shingles(data(" \t\n"))) == len(op8.shingles(None)) == 0
    assert (op8.shingles(data("A b")) == op8.shingles(data("a  B"))).all()
    assert len(op8.shingles(data("a b c d e f"))) == 2
    assert len(np.intersect1d(op8.shingles(data("a b c d")), op8.shingles(data("a b c d e")))) == 0


# --- mixing ------------------------------------------------------------------

def test_targets_stop_at_three_times_the_size():
    t = op4.source_targets({"a": 1, "b": 1000, "c": 10, None: 100})
    assert t["a"] == 3 and t["c"] == 30 and abs(sum(t.values()) - 1111) < 1e-6
    assert all(t[s] <= 3 * n for s, n in {"a": 1, "b": 1000, "c": 10, None: 100}.items())


def test_flow_of_overlapping_sources_is_cheapest():
    """Against brute force over all splits in steps of one token."""
    patterns = [(("a",), 4), (("a", "b"), 4), (("b",), 2)]
    for qa in range(0, 9):
        for qb in range(0, 9):
            flows = op4.min_cost_flow(patterns, {"a": qa, "b": qb}, 3)
            best = None
            for x in range(0, qa + 1):          # a's tokens from pattern 0, rest from 1
                for y in range(0, qb + 1):      # b's tokens from pattern 2, rest from 1
                    use = [x, qa - x + qb - y, y]
                    if all(u <= 3 * n for u, (_, n) in zip(use, patterns)):
                        c = sum(cost(u, n) for u, (_, n) in zip(use, patterns))
                        best = c if best is None else min(best, c)
            if best is not None:
                assert sum(flows) == qa + qb
                assert sum(cost(f, n) for f, (_, n) in zip(flows, patterns)) == best


def cost(used, size):
    return sum(max(0, min(used - r * size, size)) * r for r in range(3))


# --- licences ----------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_notices_with_edits_are_found_and_verified():
    finder = op7.Finder(op7.NOTICES)
    rng = random.Random(4)
    for text, label, k in op7.NOTICES:
        for n in range(k + 1):
            chars = list(text)
            for _ in range(n):
                at = rng.randrange(len(chars))
                rng.choice([lambda: chars.__setitem__(at, "q"), lambda: chars.pop(at),
                            lambda: chars.insert(at, "q")])()
            flat = f"lorem {''.join(chars)} ipsum"
            hits = [(a, b, e) for a, b, i, e in finder.find(flat) if op7.NOTICES[i][0] == text]
            assert hits, (flat, text)
            for a, b, e in hits:
                assert e <= k and edits(flat[a:b], text) <= e
    assert finder.find("nothing of that kind stands here") == []


def test_spans_point_into_the_original():
    low = "x  all\n\n rights   reserved. y"
    flat, lost = op7.flatten(low)
    (a, b, _, e), = op7.Finder(op7.NOTICES).find(flat)
    start, end = op7.original(a, lost), op7.original(b - 1, lost) + 1
    assert e == 0 and low[start:end] == "all\n\n rights   reserved"


# --- archives ----------------------------------------------------------------

def archive(records, dictionary=b""):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    pack = zstandard.ZstdCompressor(dict_data=d, write_checksum=True)
    return op9.dictionary_frame(dictionary) + b"".join(pack.compress(r) for r in records)


def test_archive_round_trip_with_and_without_dictionary():
    payloads = [b"", b"x" * 5000, "ü\r\n\r\nß".encode(), bytes(range(256)) * 300]
    records = [op9.encode_record(i, f"http://{i}", p, None) for i, p in enumerate(payloads)]
    records.append(op9.encode_record(9, "u", payloads[1], 1))
    trained = zstandard.train_dictionary(2048, [f"{i} some html {i % 7} page".encode() * 20 for i in range(200)])
    for d in (b"", trained.as_bytes()):
        back = list(op9.read_archive(archive(records, d), "t"))
        assert [r[0] for r in back] == [0, 1, 2, 3, 9]
        assert [r[6] for r in back] == [*payloads, None]
        assert back[4][2:6] == (5000, hashlib.sha1(payloads[1]).hexdigest(), "revisit", 1)


@pytest.mark.parametrize("broken, what", [
    (lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1"), "version line"),
    (lambda r: r.replace(b"WARC-Date", b"WARC-Dat"), "WARC-Date is missing"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"), "as long as"),
    (lambda r: r.replace(b"Content-Length: ", b"Content-Length: x"), "not a number"),
    (lambda r: r.replace(b"hello", b"jello"), "digest differs"),
    (lambda r: r[:-2], "as long as"),
])
def test_broken_records_raise(broken, what):
    record = broken(op9.encode_record(1, "u", b"hello", None))
    with pytest.raises(op9.WarcError, match=what):
        list(op9.read_archive(archive([record]), "t"))


def test_broken_frames_raise():
    good = archive([op9.encode_record(1, "u", b"hello" * 100, None)])
    for bad in (good[4:], good[:-3], good[:20], b""):
        with pytest.raises(op9.WarcError):
            list(op9.read_archive(bad, "t"))


# --- learned models ----------------------------------------------------------

def test_features_of_pieces_add_up():
    text = data("some words here, " * 50)
    ids, n = op2.feature_counts(text)
    assert n.sum() == len(op2.feature_ids(text))
    assert len(op2.feature_counts(data(""))[0]) == 0
    parts = list(op2.pieces(text, 100))
    assert b"".join(p.tobytes() for p in parts) == text.tobytes() and max(map(len, parts)) <= 100


def test_folded_scores_equal_the_network():
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, op2.BUCKETS, 20)), None, int(i % 2)) for i in range(40)]
    rows = [(ids, np.full(len(ids), 1 / len(ids), np.float32), y) for ids, _, y in rows]
    vectors, layer, bias = op2.train(rows, epochs=3)
    weights, b = vectors @ (layer[1] - layer[0]), bias[1] - bias[0]
    for ids, share, y in rows:
        z = layer @ (share @ vectors[ids]) + bias
        p = np.exp(z[1]) / np.exp(z).sum()
        assert abs(1 / (1 + np.exp(-(share @ weights[ids] + b))) - p) < 1e-4
        assert (p > 0.5) == y


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(6)
    rows = []
    for i in range(120):
        y = i % 3
        ids = np.unique(np.append(rng.integers(100 * y, 100 * y + 50, 8), rng.integers(1000, 30000, 4)))
        rows.append((np.append(ids, op10.BUCKETS), np.append(np.full(len(ids), 0.3), 1.0), y))
    w = op10.ftrl(rows, 3)
    assert (w == 0).mean() > 0.9
    assert all((x @ w[ids]).argmax() == y for ids, x, y in rows)


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(7)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(op10.temperature(5 * z, y) - 5) < 0.6


def test_letters():
    assert op10.has_letter("1 é") and not op10.has_letter("123 _ !") and not op10.has_letter(None)
