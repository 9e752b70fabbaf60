"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
joined by single spaces. Every run of ``window`` consecutive words of a benchmark item is
a pattern (an item of fewer words is one pattern; one of none has none). One automaton over all patterns
scans each normalised document once; a match's end is mapped to its word, and words to
their place in the original text, so hits come back as spans of the original.

The benchmark's patterns are distinct strings with the items that hold them. They are
broadcast only while they stay under ``max_pattern_bytes``; beyond that they are dealt
by hash into shards of about that size and the documents are scanned once per shard, the
hits so far being written to the shared folder in between.

Odd cases: null text has no words; empty texts and empty tables give rows without hits
(or no rows); rows with equal ids are judged row by row; items with the same text are
separate items; an item without an id
hits, but no list names it.
"""
from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns, staged

HITS = {"n_words": "long", "n_hit": "long", "items": "array<string>",
        "runs": "array<array<bigint>>", "spans": "array<array<bigint>>"}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text: str | None) -> str:
    """A-Z lower-cased and nothing else (bytes.lower leaves non-ASCII bytes alone)."""
    return (text or "").encode().lower().decode()


def item_words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text))


def patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, items): each distinct window with the sorted ids of its items."""
    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = item_words(text)
                n = min(window, len(words))
                rows += [{"pattern": f" {' '.join(words[i:i + n])} ", "item": item}
                         for i in range(len(words) - n + 1) if n]
            yield pa.RecordBatch.from_pylist(
                rows, pa.schema([("pattern", pa.string()), ("item", pa.string())]))

    cuts = (benchmark.select(F.col(item_col).cast("string").alias("item"),
                             F.col(text_col).alias("text"))
            .mapInArrow(cut, "pattern string, item string"))
    return cuts.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def scan(docs: DataFrame, text_col: str, found: list[tuple[str, list[str]]],
         earlier: bool = False) -> DataFrame:
    """One pass over the documents with one automaton: the frame with n_words, n_hit,
    items, runs and spans added, or replaced and added to if there are earlier hits."""
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        import ahocorasick
        import pyarrow as pa
        automaton = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(shared.value):
            automaton.add_word(pattern, (k, pattern.count(" ") - 1))
        if len(automaton):
            automaton.make_automaton()
        words_of = WORD.finditer
        schema = pa.schema([
            ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
            ("runs", pa.list_(pa.list_(pa.int64()))), ("spans", pa.list_(pa.list_(pa.int64())))])
        for batch in batches:
            more = []
            known = zip(*(batch.column(c).to_pylist() for c in ("runs", "items"))) if earlier \
                else [None] * len(batch)
            for text, before in zip(batch.column(text_col).to_pylist(), known):
                low = lowered(text)
                words = WORD.findall(low)
                line = f" {' '.join(words)} "
                hits, items = [], set()
                if before:
                    hits, items = [tuple(r) for r in before[0]], set(before[1])
                if words and len(automaton):
                    ends = None
                    for end, (k, n) in automaton.iter(line):
                        if ends is None:
                            ends = _ends(words)
                        last = ends[end]
                        hits.append((last - n + 1, last + 1))
                        items.update(shared.value[k][1])
                runs = _merged(hits)
                spans = []
                if runs:
                    places = [m.span() for m in words_of(low)]
                    spans = [[places[a][0], places[b - 1][1]] for a, b in runs]
                more.append({"n_words": len(words), "n_hit": sum(b - a for a, b in runs),
                             "items": sorted(items), "runs": [list(r) for r in runs],
                             "spans": spans})
            out = pa.RecordBatch.from_pylist(more, schema)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *out.columns], [*kept, *schema.names])

    kept = [c for c in docs.columns if c not in HITS]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                      for f in docs.schema.fields if f.name in kept)
    return docs.mapInArrow(run, kinds + "".join(f", {c} {t}" for c, t in HITS.items()))


def _ends(words: list[str]) -> dict[int, int]:
    """Offset of the blank after each word in the joined line -> the word's index."""
    at, ends = 0, {}
    for i, w in enumerate(words):
        at += len(w) + 1
        ends[at] = i
    return ends


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as disjoint ones in order; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = 13,
                  max_pattern_bytes: int = 64 << 20) -> DataFrame:
    """The documents with n_words, n_hit, items (sorted as strings), runs (hit words,
    [from, to)) and spans (the same in characters of the text) added; columns of these
    names are replaced."""
    found = staged(patterns(benchmark, item_col, item_text, window), "patterns")
    total = found.agg(F.sum(F.length("pattern") + 8 * F.size("items"))).first()[0] or 0
    shards = -(-total // max_pattern_bytes) or 1
    out = docs.drop(*HITS)
    for i in range(shards):
        mine = [(r["pattern"], r["items"]) for r in found.where(
            F.pmod(F.xxhash64("pattern"), F.lit(shards)) == i).toLocalIterator()]
        out = scan(staged(out, "hits") if i else out, text_col, mine, earlier=i > 0)
    return out


def contaminated(n_hit, n_words):
    """The contract's rule: some hit, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    items = read_columns(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


ORACLE = r"""
WITH az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, az),
ip AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
       FROM iw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS pattern FROM ip),
lens AS (SELECT DISTINCT n FROM pat),
dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, az),
dp AS (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT dp.rid, dp.i, dp.n, pat.item_id
        FROM dp JOIN pat ON pat.n = dp.n AND pat.pattern = array_to_string(dp.w[dp.i:dp.i + dp.n - 1], ' ')),
words AS (SELECT rid, count(DISTINCT k) AS n_hit
          FROM (SELECT DISTINCT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
