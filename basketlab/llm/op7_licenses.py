"""Licence scan: fuzzy search for short notices.

Each notice may be matched with ``allowed`` character edits (insertions, deletions,
substitutions). By the pigeonhole principle a text with at most k edits holds at least
one of the notice's k + 1 pieces unchanged, so the exact pieces (seeds, found by one
Aho-Corasick automaton over all notices) are the only places to look at. Around each
seed the regex library matches the notice with its error bound and so verifies the
edits; the best match (fewest edits, then leftmost) is reported with its span in the text,
then the best ones of what is left before and after it, and so on. Text is compared with
A-Z lower-cased and white space runs as one blank; spans are mapped back.

Base places are kept apart: a phrase's words standing consecutively among the words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.

The score is the largest ``1 - edits / length`` of the notices found, 1 where a base
phrase stands, and 0 without any. Odd cases: null text is empty; empty texts get zero counts, null
places, empty labels; each seed costs searches of about a notice's length, so the time
follows the number of seeds, also in a text that repeats a notice; rows with equal ids are
judged each.
"""
from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from heapq import heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns

# The contract's phrases and labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Short notices, their labels, and the edits allowed in each.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license, version 2.0", "apache", 3),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted, free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under cc by", "cc-by", 2),
    ("all rights reserved", "all-rights-reserved", 2),
    ("released into the public domain", "public-domain", 3),
]

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACES = re.compile(r"[\x20\x09-\x0d]+")


def seeds_of(notice: str, allowed: int) -> list[tuple[int, str]]:
    """The notice cut into allowed + 1 pieces: (offset, piece)."""
    edge = [len(notice) * i // (allowed + 1) for i in range(allowed + 2)]
    return [(a, notice[a:b]) for a, b in zip(edge, edge[1:])]


def lowered(text: str | None) -> str:
    return (text or "").encode().lower().decode()


class Finder:
    """The automaton of all seeds and the compiled notices, built once per task."""

    def __init__(self, notices):
        import ahocorasick
        import regex
        self.notices = notices
        places: dict[str, list[tuple[int, int]]] = {}
        for i, (text, _, k) in enumerate(notices):
            for at, piece in seeds_of(text, k):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(t)}){{e<={k}}}") for t, _, k in notices]

    def find(self, flat: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the verified places in blank-normalised text."""
        windows: dict[int, dict] = {}
        for end, (n, where) in self.automaton.iter(flat):
            for i, at in where:
                text, _, k = self.notices[i]
                a = end + 1 - n - at - k
                windows.setdefault(i, {})[max(a, 0), min(a + len(text) + 2 * k, len(flat))] = True
        return sorted((x, y, i, e) for i, mine in windows.items() for x, y, e in self.matches(i, flat, mine))

    def matches(self, i: int, flat: str, windows):
        """(start, end, edits) of disjoint matches in the windows: the best one (fewest edits,
        then leftmost) first, then the best in what it leaves free, and so on. A window is
        a notice and its edits long, so each search is short and the time is linear in the
        number of windows, however often a text repeats the notice."""
        text, _, k = self.notices[i]
        least, found, starts = max(len(text) - k, 1), [], []

        def search(a, b):
            m = self.patterns[i].search(flat, a, b) if b - a >= least else None
            if m and m.end() > m.start():
                heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        heap: list[tuple] = []
        for a, b in windows:
            search(a, b)
        while heap:
            edits, x, y, a, b = heappop(heap)
            j = bisect_left(starts, y)  # matches from here on start at its end or later
            if not j or found[j - 1][1] <= x:
                starts.insert(j, x)
                found.insert(j, (x, y, edits))
                # what is left of the window may hold another
                search(a, x)
                search(y, b)
                continue
            lo = j - 1
            while lo and found[lo - 1][1] > a:
                lo -= 1
            hi = bisect_left(starts, b)
            edges = [a, *(e for x2, y2, _ in found[lo:hi] for e in (x2, y2)), b]
            for free, to in zip(edges[::2], edges[1::2]):
                search(max(free, a), min(to, b))
        return found


def flatten(low: str) -> tuple[str, list[tuple[int, int]]]:
    """Text with white space runs as one blank, and (place, characters lost up to it)."""
    lost, total = [], 0
    for m in SPACES.finditer(low):
        if m.end() - m.start() > 1:
            total += m.end() - m.start() - 1
            lost.append((m.end() - total, total))
    return SPACES.sub(" ", low), lost


def original(at: int, lost: list[tuple[int, int]]) -> int:
    i = bisect_right(lost, (at, 1 << 62))
    return at + (lost[i - 1][1] if i else 0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         notices=None, phrases=None) -> DataFrame:
    """One row per document: id, word and base counts and places, labels, score, and
    notices found (label, start, end, edits; characters of the text)."""
    notices, phrases = notices or NOTICES, phrases or PHRASES

    def run(batches):
        import pyarrow as pa
        finder = Finder(notices)
        hit = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                         ("edits", pa.int64())])
        schema = pa.schema([
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
            ("score", pa.float64()), ("found", pa.list_(hit))])
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                low = lowered(text)
                words = WORD.findall(low)
                line, places, base = f" {' '.join(words)} ", [], set()
                for phrase, label in phrases.items():
                    at, before, n = line.find(f" {phrase} "), 0, 0
                    while at >= 0:
                        n, before = n + line.count(" ", before, at), at
                        places.append(n)
                        base.add(label)
                        at = line.find(f" {phrase} ", at + 1)
                flat, lost = flatten(low)
                found = finder.find(flat)
                named = {notices[i][1] for _, _, i, _ in found}
                best = max([1 - e / len(notices[i][0]) for _, _, i, e in found], default=0.0)
                rows.append({
                    "n_words": len(words), "n_base": len(places),
                    "first_word": min(places, default=None), "last_word": max(places, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | named)),
                    "score": 1.0 if base else max(best, 0.0),
                    "found": [{"label": notices[i][1], "start": original(a, lost),
                               "end": original(b - 1, lost) + 1, "edits": e} for a, b, i, e in found]})
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["id", *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, "
             "base_labels string, labels string, score double, "
             "found array<struct<label: string, start: bigint, `end`: bigint, edits: bigint>>")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan(read_columns(spark, sf_dir, "documents", "doc_id", "text")).drop(
        "found").withColumnRenamed("id", "doc_id")
