"""Vector codes, chat formatting and fill-in-the-middle against plain Python."""
import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import SMALL, vector

from basketlab.llm import common
from basketlab.llm import op11_vector_codes as codes
from basketlab.llm import op12_chat_format as chat
from basketlab.llm import op13_fill_in_middle as fim


# --- vector codes -------------------------------------------------------------------

@pytest.mark.parametrize("kind", [np.int64, object])
@pytest.mark.parametrize("entries", [1, 2, 16, 64])
def test_orchard_finds_the_nearest_entry(entries, kind):
    rng = np.random.default_rng(entries)
    # few distinct values: many ties, repeated entries
    book, x = rng.integers(-4, 5, (entries, 3)).astype(kind), rng.integers(-5, 6, (400, 3)).astype(kind)
    best, dist, _ = codes.orchard(x, book)
    for v, b, d in zip(x, best, dist):
        all_d = [int(((v - e) ** 2).sum()) for e in book]
        assert (int(d), int(b)) == min((s, i) for i, s in enumerate(all_d))


def test_orchard_leaves_far_entries_out():
    rng = np.random.default_rng(3)
    centres = np.repeat(np.arange(64)[:, None] * 1000, 4, axis=1)
    x = centres[rng.integers(0, 64, 2000)] + rng.integers(-9, 10, (2000, 4))
    best, _, measured = codes.orchard(x, centres)
    assert (best == np.rint(x.mean(axis=1) / 1000)).all() and measured < 0.7 * 2000 * 64


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """[(id, code, error)] and books with Python's integers only."""
    import math
    whole = [(k, [math.floor(4096 * float(np.float32(v))) for v in vec]) for k, vec in rows]
    w = len(whole[0][1]) // parts
    cut = [(k, [v[p * w:(p + 1) * w] for p in range(parts)]) for k, v in whole]
    books = [[list(v[p]) for _, v in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(v[p], books[p])[1] for _, v in cut]
            for e in range(len(books[p])):
                group = [v[p] for (_, v), m in zip(cut, mine) if m == e]
                if group:
                    books[p][e] = [sum(c) // len(group) for c in zip(*group)]
    out = []
    for k, v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append((k, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return sorted(out), books


@pytest.mark.parametrize("factor", [1.0, 1e5])
def test_codes_equal_plain_python(spark, factor):
    """Also with components whose squares need more than 64 bits on the way."""
    rows = [(i, [v * factor for v in vector(i * i, 16)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    model = codes.fit(df)
    got = sorted((r.vec_id, r.code, r.error) for r in codes.encode(df, model).collect())
    want, books = brute_codes([(k, v) for k, v, _ in rows])
    assert got == want
    assert [[[int(c) for c in e] for e in b] for b in model["books"]] == books


def test_huge_components_and_other_lengths(spark):
    rows = [(i, [3e38 * (-1) ** i] * 8) for i in range(4)] + [(9, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {r.vec_id: r for r in codes.encode(df, codes.fit(df)).collect()}
    # the four agree with entries 0 and 1; the shorter vector has no code
    assert [out[i].code[:2] for i in range(4)] == ["00", "01", "00", "01"]
    assert all(out[i].error == 0 for i in range(4)) and out[9].code is None and out[9].error is None


def test_decoded_vectors_are_the_entries(spark):
    df = spark.createDataFrame([(i, vector(i), 0) for i in range(10)], "vec_id long, embedding array<float>, label int")
    model = codes.fit(df)
    for r in codes.decode(codes.encode(df, model), model).collect():
        # ten vectors, sixteen entries wanted: every vector is its own entry
        assert np.allclose(r.decoded, vector(r.vec_id), atol=1 / 4096) and r.error == 0


def test_repeated_ids_seed_once(spark):
    df = spark.createDataFrame([(1, vector(2))] * 30 + [(2, vector(5)), (None, vector(6))],
                               "vec_id long, embedding array<float>")
    assert [len(b) for b in codes.fit(df)["books"]] == [2] * 8


# --- chat formatting ------------------------------------------------------------------

RECORDS = {
    "turn": ({"role": "tool", "text": "x"}, [("tool", "x")]),
    "messages": ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant"}], "id": 3},
                 [("user", "a"), ("assistant", "")]),
    "parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
              [("user", "ab")]),
    "from": ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
             [("user", "a"), ("assistant", "b")]),
    "prompt": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "response": ({"system": "s", "prompt": "p", "response": 5}, [("system", "s"), ("user", "p"), ("assistant", "5")]),
    "instruction": ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    "no input": ({"instruction": "i", "input": "", "output": None}, [("user", "i"), ("assistant", "")]),
    "unknown": ({"prompt": "p"}, []),
    "nested unknown": ({"messages": [[{"role": "user", "content": "a"}]]}, []),
    "list": ([1, 2], []),
}


@pytest.mark.parametrize("name", RECORDS)
def test_layouts_become_canonical_turns(name):
    record, want = RECORDS[name]
    assert chat.canonical(json.dumps(record), *chat.layout_table()) == want


def test_broken_records_have_no_turn():
    table = chat.layout_table()
    assert [chat.canonical(r, *table) for r in (None, "", "{", "3", "[" * 100_000)] == [[]] * 5
    assert chat.canonical('{"role": "user", "text": "\\ud800x"}', *table) == [("user", "\ufffdx")]


def test_equal_paths_of_two_layouts_are_refused():
    with pytest.raises(ValueError):
        chat.layout_table((*chat.LAYOUTS, chat.Layout("again", (chat.Turn(("text",), role_at="role"),))))


MARKS = st.text(st.sampled_from(list("\\#</turn>: \nax")), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(MARKS, MARKS), max_size=5))
def test_any_turns_are_read_back(turns):
    text, spans = "", []
    for role, said in turns:
        t, a, b = chat.format_turn(role, said)
        spans.append((len(text) + a, len(text) + b))
        text += t
    assert chat.parse(text) == turns
    assert [chat.unescaped(text[a:b]) for a, b in spans] == [said for _, said in turns]


def test_texts_that_are_no_output_are_refused():
    for bad in ("x", "### user: a", "### user: a</turn>\nrest", "### user a</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_long_conversations_over_many_rows_and_tasks(spark):
    rng = random.Random(1)
    turns = [(k, i, rng.choice(["user", "assistant"]), "word # ### \\ " * rng.randint(0, 9))
             for k in (1, 2, 3, 4, 5) for i in range(600 if k == 3 else 4)]
    rng.shuffle(turns)
    df = spark.createDataFrame([(k, i, json.dumps({"role": r, "text": t})) for k, i, r, t in turns],
                               "conv_id long, turn long, record string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = common.staged(chat.format_chats(df, "conv_id", "turn", "record", piece_chars=500), "chats")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = made.collect()
    assert len({(r.part, r.piece) for r in rows if r.conv_id == 3}) > 20
    assert len({r.part for r in rows if r.conv_id == 3}) > 1 and any(r.whole for r in rows)
    got = {r.conv_id: r for r in chat.read_chats(made, "conv_id").collect()}
    for k in (1, 2, 3, 4, 5):
        mine = [(r, t) for c, _, r, t in sorted(turns) if c == k]
        lost = "".join(t for r, t in mine if r == "assistant")
        assert got[k].n_turns == len(mine)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in mine).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
        assert got[k].formatted_chars == sum(len(chat.format_turn(*m)[0]) for m in mine)


def test_conversations_without_turns_stay(spark):
    df = spark.createDataFrame([(1, 0, "{}"), (2, 0, None)], "conv_id long, turn long, record string")
    out = chat.read_chats(chat.format_chats(df, "conv_id", "turn", "record"), "conv_id").collect()
    assert sorted((r.conv_id, r.n_turns, r.formatted_chars) for r in out) == [(1, 0, 0), (2, 0, 0)]


# --- fill-in-the-middle -----------------------------------------------------------------

def token_offsets(text):
    import re
    return [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]


HARD = ["", "a", "é", "a" * 5000, "." * 5000, ("a" * 300 + ".") * 40 + "." * 900 + "b" * 900, "ab \n\U0001f600é " * 700,
        "".join("x" * (i % 97) + "-" for i in range(900)), "a" * 250 + "1" + "b" * 7]


@pytest.mark.parametrize("piece", [1 << 20, 64, 1])
def test_every_boundary_is_found(monkeypatch, piece):
    monkeypatch.setattr(fim, "PIECE", piece)
    for text in HARD if piece > 1 else [t[:500] for t in HARD]:
        index, want = fim.RankIndex(text), token_offsets(text)
        assert index.tokens == len(want) - 1
        assert [index.offset(r) for r in range(len(want))] == want
        assert all(abs(res) <= fim.EPSILON + 2 for r in range(len(want)) for res in [index.predicted(r)[1]])


def test_regular_texts_need_few_segments():
    index = fim.RankIndex("word " * 100_000)
    assert len(index.firsts) < 10 and sum(r.nbytes for r in index.residuals) == index.tokens + 1


def test_forms_and_restored_texts(spark):
    """All forms occur; marks in a text keep it plain; every text is rebuilt."""
    import pyspark.sql.functions as F
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, "a <S> b"), (-2, "<"), (-3, "P><<S"), (None, "x y")], docs.schema))
    made = fim.fill_in_middle(docs)
    back = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).join(
        docs, made.id.eqNullSafe(docs.doc_id))
    rows = back.collect()
    assert {r.form for r in rows} == {"plain", "psm", "spm"} and len(rows) == docs.count()
    assert all(r.back == (r.text or "") for r in rows)
    assert [r.form for r in rows if r.id == -1] == ["plain"]
