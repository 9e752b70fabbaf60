"""Suffix-array deduplication: a depth-limited radix sort of suffixes by digit passes.

Byte strings of ``depth`` bytes that also start in a document with a smaller id are
removed wherever they stand. The suffixes' first ``depth`` bytes are sorted by
most-significant-digit passes over their own bytes, eight a digit: each pass orders the
groups of the one before by the next digit, and a group that has shrunk to one document
leaves the sort. Groups left after the last digit are equal byte by byte, exactly the
repeated windows; all but those of its smallest id are removed.

Two filters in front keep most suffixes out of the sort. Windows are handled in runs: each
window of ``depth`` bytes contains one anchor, its least-hashed 16-byte string (leftmost of
equals), which depends on the window's bytes alone; equal windows therefore have equal
anchors, and neighbouring windows mostly share theirs.

1. Of equal runs (all bytes that the windows of one anchor cover) the smallest id stays, and
   the others are covered by it as a whole.
2. Runs that share neither the anchor's 16 bytes with the 17 to its right, nor those with
   the 17 to its left, with another document end here, as equal windows share one of the two.

The runs left are dealt by anchor with their bytes (a stretch of about 66 bytes for 17
windows), and each bucket's windows are sorted as above. In the first filter equal runs are
told by the anchor (40 bits and the bucket) and a hash of all bytes (64 bits); the sort
compares bytes. Run records are packed by numpy per task and bucket and combined before they
move: of equal records of a task only the smallest id travels. Results of each step go to
the shared folder; nothing unbounded passes the driver.

Odd cases: null text is empty; a text shorter than ``depth`` loses nothing; rows with the
same id never remove from each other; a null id counts as larger than any id; rows that
agree in id and text get equal results; very long texts are cut into stretches that
overlap by a window, so memory stays bounded; empty tables give no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import mix, random_words, read_columns, staged, text_slices

DEPTH, ANCHOR = 50, 16
STRETCH = 1 << 20
LOW = np.uint64((1 << 21) - 1)
NO_ID = (1 << 63) - 1
BYTES = random_words(31, 256)
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)

RUN = [("anchor", "<u8"), ("run", "<u8"), ("right", "<u2"), ("left", "<u2"), ("doc", "<u4"),
       ("lo", "<u4"), ("hi", "<u4")]
# Of a window's bytes beside its anchor, half stand on one side at least: so equal windows
# share the anchor and SIDE bytes to its right, or to its left.
SIDE = (DEPTH - ANCHOR) // 2
# Where the digits of a window start: eight bytes each, the last one overlapping.
DIGITS = [*range(0, DEPTH - 7, 8), *([DEPTH - 8] if DEPTH % 8 else [])]
OWNER = np.dtype([("id", "<i8"), ("hash", "<i4")])


class Powers:
    """base^i and base^-i modulo 2^64, for places in a stretch."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            one = np.ones(1, np.uint64)
            self.up = np.concatenate((one, np.cumprod(np.full(n, BASE, np.uint64))))
            self.down = np.concatenate((one, np.cumprod(np.full(n, BACK, np.uint64))))
        return self.up, self.down


def sums_of(data: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of table[byte] * base^place: the hash of data[a:b] is
    (sums[b] - sums[a]) * base^-a."""
    up, _ = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[:len(data)], out=sums[1:])
    return sums


def hash_of(sums, a, b, powers: Powers) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers.upto(len(sums))[1][a])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor place, first window, last window) of one stretch's runs."""
    n = len(data) - 7
    data = np.ascontiguousarray(data)
    words = np.ndarray((n,), "<u8", data, 0, (1,))
    x = words[:-8] * BYTES[0]
    x ^= x >> np.uint64(32)
    x += words[8:]
    x *= BYTES[1]
    x ^= x >> np.uint64(29)
    x *= BYTES[2]
    x ^= x >> np.uint64(32)
    least = (x & ~LOW) | np.arange(len(x), dtype=np.uint64)
    width, span = DEPTH - ANCHOR + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    owner = (least & LOW).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    place = owner[first]
    return x[place], place, first, last


def text_runs(data: np.ndarray, powers: Powers) -> np.ndarray:
    """The runs of a whole text as RUN records (doc left 0)."""
    out = []
    for at in range(0, len(data) - DEPTH + 1, STRETCH):
        piece = data[at:at + STRETCH + DEPTH - 1]
        key, place, first, last = anchors(piece)
        sums = sums_of(piece, powers)
        rec = np.zeros(len(key), RUN)
        rec["anchor"] = key
        shape = ((place - first) * 64 + (last - first)).astype(np.uint64)
        rec["run"] = mix(hash_of(sums, first, last + DEPTH, powers) + shape)
        rec["lo"], rec["hi"] = first + at, last + at
        # 0 where no window of the run has that many bytes on that side
        right, left = place - last <= SIDE, place - first >= SIDE
        a = place[right]
        rec["right"][right] = hash_of(sums, a, a + ANCHOR + SIDE, powers) % np.uint64(65535) + np.uint64(1)
        a = place[left]
        rec["left"][left] = hash_of(sums, a - SIDE, a + ANCHOR, powers) % np.uint64(65535) + np.uint64(1)
        out.append(rec)
    return np.concatenate(out) if out else np.empty(0, RUN)


def smallest_first(rec: np.ndarray, ids: np.ndarray):
    """Order by (anchor, run, id); group starts, and each record's smallest id in its group."""
    order = np.lexsort((ids, rec["run"], rec["anchor"]))
    rec, ids = rec[order], ids[order]
    new = np.ones(len(rec), bool)
    new[1:] = (rec["anchor"][1:] != rec["anchor"][:-1]) | (rec["run"][1:] != rec["run"][:-1])
    return rec, ids, ids[np.flatnonzero(new)][np.cumsum(new) - 1]


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b)."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
    return a[new], b[np.append(new[1:], len(a)) - 1]


SPANS = "id long, hash int, kind int, spans binary"


def span_rows(kind: int, ids, hashes, a, b, bucket: int = 0):
    """Per document one SPANS row: its [a, b) pairs of kind 0, merged; of kind 1 its runs'
    first and last windows, and the bucket."""
    order = np.lexsort((a, hashes, ids))
    ids, hashes, a, b = ids[order], hashes[order], a[order], b[order]
    edge = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))) \
        if len(ids) else np.empty(0, np.int64)
    for i, j in zip(edge, np.append(edge[1:], len(ids))):
        x, y = a[i:j], b[i:j]
        if kind == 0:
            x, y = merged(x, y)
        parts = (x, y) if kind == 0 else (x, y, np.full(len(x), bucket))
        yield int(ids[i]), int(hashes[i]), kind, np.concatenate(parts).astype("<u4").tobytes()


def span_batch(rows):
    import pyarrow as pa
    cols = list(zip(*rows)) or [(), (), (), ()]
    return {"id": pa.array(cols[0], pa.int64()), "hash": pa.array(cols[1], pa.int32()),
            "kind": pa.array(cols[2], pa.int32()), "spans": pa.array(cols[3], pa.binary())}


def unpacked(blobs, columns: int = 2) -> tuple[np.ndarray, ...]:
    parts = [np.frombuffer(x, "<u4").reshape(columns, -1) for x in blobs]
    both = np.concatenate(parts, axis=1) if parts else np.empty((columns, 0), np.uint32)
    return tuple(x.astype(np.int64) for x in both)


PACKED = "bucket int, n int, records binary, owners binary"


class Packer:
    """Collects run records of many documents, combines equal ones and packs them by bucket."""

    def __init__(self, buckets: int, flush: int):
        self.buckets, self.flush = buckets, flush
        self.held, self.owners, self.size = [], [], 0

    def add(self, key, hashed, rec) -> bool:
        if len(rec):
            rec["doc"] = len(self.owners)
            self.held.append(rec)
            self.owners.append((NO_ID if key is None else key, hashed))
            self.size += len(rec)
        return self.size >= self.flush

    def rows(self):
        import zstandard
        out = {"bucket": [], "n": [], "records": [], "owners": []}
        if self.held:
            rec, own = np.concatenate(self.held), np.array(self.owners, OWNER)
            rec, ids, least = smallest_first(rec, own["id"][rec["doc"]])
            over = ids > least  # covered by another document of this task
            gone = rec[over]
            who = own[gone["doc"]]
            for i, row in enumerate(span_rows(0, who["id"], who["hash"], gone["lo"].astype(np.int64),
                                              gone["hi"].astype(np.int64) + DEPTH)):
                # covered stretches travel along, to any bucket
                out["bucket"].append(i % self.buckets)
                out["n"].append(-1)
                out["records"].append(row[3])
                out["owners"].append(np.array([row[:2]], OWNER).tobytes())
            rec = rec[~over]
            bucket = ((rec["anchor"] >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)
            order = np.lexsort((rec["lo"], rec["doc"], bucket))
            rec, bucket = rec[order], bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=self.buckets))
            press = zstandard.ZstdCompressor(level=1)
            for i, j in zip(edges, edges[1:]):
                mine = rec[i:j]
                who, local = np.unique(mine["doc"], return_inverse=True)
                # field by field and byte by byte: places and documents shrink to little
                head = mine["anchor"].copy().view(np.uint8).reshape(-1, 8)[:, :5]
                planes = [head.tobytes(), mine["run"].tobytes(), mine["right"].tobytes(), mine["left"].tobytes()]
                planes += [press.compress(plane(x)) for x in (local, mine["lo"], mine["hi"] - mine["lo"])]
                out["bucket"].append(int(bucket[i]))
                out["n"].append(len(mine))
                out["records"].append(joined(planes))
                out["owners"].append(own[who].tobytes())
        self.held, self.owners, self.size = [], [], 0
        return packed_batch(out)


def packed_batch(out: dict):
    import pyarrow as pa
    return pa.RecordBatch.from_pydict(out, pa.schema([
        ("bucket", pa.int32()), ("n", pa.int32()), ("records", pa.binary()), ("owners", pa.binary())]))


def plane(x: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_plane(blob: bytes, n: int) -> np.ndarray:
    flat = np.frombuffer(blob, np.uint8).reshape(4, n)
    return np.ascontiguousarray(flat.T).view("<u4")[:, 0]


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def parted(blob: bytes) -> list[bytes]:
    parts, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "little")
        parts.append(blob[at + 4:at + 4 + size])
        at += 4 + size
    return parts


def unpack(records: bytes, owners: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard
    rec, own, parts = np.empty(n, RUN), np.frombuffer(owners, OWNER), parted(records)
    head = np.zeros((n, 8), np.uint8)
    head[:, :5] = np.frombuffer(parts[0], np.uint8).reshape(n, -1)
    rec["anchor"], rec["run"] = head.view("<u8")[:, 0], np.frombuffer(parts[1], "<u8")
    rec["right"], rec["left"] = np.frombuffer(parts[2], "<u2"), np.frombuffer(parts[3], "<u2")
    press = zstandard.ZstdDecompressor()
    for name, part in zip(("doc", "lo", "hi"), parts[4:]):
        rec[name] = from_plane(press.decompress(part), n)
    rec["hi"] += rec["lo"]
    return rec, own


class Stretches:
    """Collects the bytes of runs that stay in the sort, and packs them by bucket."""

    def __init__(self, flush: int):
        self.flush = flush
        self.runs, self.bytes, self.owners, self.size = [], [], [], 0

    def add(self, key, hashed, data, lo, hi, bucket) -> bool:
        size = hi - lo + DEPTH
        for at in range(0, len(lo), 4096):
            n = size[at:at + 4096]
            first = np.cumsum(n) - n
            self.bytes.append(data[np.arange(n.sum()) + np.repeat(lo[at:at + 4096] - first, n)])
        self.runs.append(np.stack([bucket, np.full(len(lo), len(self.owners)), lo, size]))
        self.owners.append((key, hashed))
        self.size += int(size.sum())
        return self.size >= self.flush

    def rows(self):
        import zstandard
        out = {"bucket": [], "n": [], "records": [], "owners": []}
        if self.runs:
            bucket, doc, lo, size = np.concatenate(self.runs, axis=1)
            text, own = np.concatenate(self.bytes), np.array(self.owners, OWNER)
            start = np.cumsum(size) - size
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
            press = zstandard.ZstdCompressor(level=1)
            for i, j in zip(edges, edges[1:]):
                mine = order[i:j]
                who, local = np.unique(doc[mine], return_inverse=True)
                n = size[mine]
                mine_text = text[np.arange(n.sum()) + np.repeat(start[mine] - (np.cumsum(n) - n), n)]
                planes = [press.compress(x) for x in (plane(local), plane(lo[mine]), plane(n), mine_text.tobytes())]
                out["bucket"].append(int(bucket[mine[0]]))
                out["n"].append(len(mine))
                out["records"].append(joined(planes))
                out["owners"].append(own[who].tobytes())
        self.runs, self.bytes, self.owners, self.size = [], [], [], 0
        return packed_batch(out)


def shared(rec: np.ndarray, ids: np.ndarray, side: str) -> np.ndarray:
    """Which records have another document's record with the same anchor and side."""
    out = np.zeros(len(rec), bool)
    at = np.flatnonzero(rec[side])
    if len(at):
        at = at[np.lexsort((rec[side][at], rec["anchor"][at]))]
        anchor, other = rec["anchor"][at], rec[side][at]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (other[1:] != other[:-1]))
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        out[at] = (np.minimum.reduceat(ids[at], start) != np.maximum.reduceat(ids[at], start))[group]
    return out


def equal_runs(packed: DataFrame) -> DataFrame:
    """The filters in front, by bucket: SPANS rows of kind 0 (covered) and of kind 1 (runs
    whose windows are sorted)."""
    def run(key, table):
        import pyarrow as pa
        rows, recs, ids, hashes = [], [], [], []
        for n, r, o in zip(*(table.column(c).to_pylist() for c in ("n", "records", "owners"))):
            if n < 0:
                own = np.frombuffer(o, OWNER)[0]
                rows.append((int(own["id"]), int(own["hash"]), 0, r))
                continue
            rec, own = unpack(r, o, n)
            recs.append(rec)
            ids.append(own["id"][rec["doc"]])
            hashes.append(own["hash"][rec["doc"]])
        if recs:
            rec, ids, hashes = np.concatenate(recs), np.concatenate(ids), np.concatenate(hashes)
            rec["doc"] = np.arange(len(rec))
            rec, ids, least = smallest_first(rec, ids)
            hashes = hashes[rec["doc"]]
            over = ids > least
            lo, hi = rec["lo"].astype(np.int64), rec["hi"].astype(np.int64)
            rows += span_rows(0, ids[over], hashes[over], lo[over], hi[over] + DEPTH)
            rec, ids, hashes, lo, hi = rec[~over], ids[~over], hashes[~over], lo[~over], hi[~over]
            stay = shared(rec, ids, "right") | shared(rec, ids, "left")
            rows += span_rows(1, ids[stay], hashes[stay], lo[stay], hi[stay], key[0].as_py())
        return pa.table(span_batch(rows))

    return packed.groupBy("bucket").applyInArrow(run, SPANS)


def radix_sort(text: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each suffix (its place in the text, its document's id): whether its first DEPTH
    bytes are those of a suffix with a smaller id. Passes over the digits, most significant
    first, each on the groups that still hold two documents."""
    over = np.zeros(len(place), bool)
    if not len(place):
        return over
    words = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), 0, (1,))
    live, group = np.arange(len(place)), np.zeros(len(place), np.int64)
    for at in DIGITS:
        digit = words[place[live] + at]
        order = np.lexsort((digit, group)) if at else np.argsort(digit, kind="stable")
        live, digit, group = live[order], digit[order], group[order]
        new = np.ones(len(live), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        mine = ids[live]
        least = np.minimum.reduceat(mine, start)
        two = (least != np.maximum.reduceat(mine, start))[group]
        live, group = live[two], group[two]
        if not len(live):
            return over
    over[live] = ids[live] > least[group]
    return over


def sorted_windows(packed: DataFrame) -> DataFrame:
    """The sort of each bucket's windows: SPANS rows of kind 0."""
    def run(key, table):
        import pyarrow as pa
        import zstandard
        press, texts, cols = zstandard.ZstdDecompressor(), [], []
        for n, r, o in zip(*(table.column(c).to_pylist() for c in ("n", "records", "owners"))):
            parts = [press.decompress(x) for x in parted(r)]
            doc, lo, size = (from_plane(x, n).astype(np.int64) for x in parts[:3])
            own = np.frombuffer(o, OWNER)[doc]
            texts.append(np.frombuffer(parts[3], np.uint8))
            cols.append((own["id"], own["hash"], lo, size))
        if not texts:
            return pa.table(span_batch([]))
        text = np.concatenate(texts)
        ids, hashes, lo, size = (np.concatenate(c) for c in zip(*cols))
        count = size - DEPTH + 1  # a run's windows, one place after the other
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        over = np.flatnonzero(radix_sort(text, np.repeat(np.cumsum(size) - size, count) + step,
                                         np.repeat(ids, count)))
        of = np.repeat(np.arange(len(lo)), count)[over]
        at = lo[of] + step[over]
        return pa.table(span_batch(list(span_rows(0, ids[of], hashes[of], at, at + DEPTH))))

    return packed.groupBy("bucket").applyInArrow(run, SPANS)


def removed_spans(docs: DataFrame, buckets: int, flush: int = 1_000_000) -> DataFrame:
    """(id, hash, spans): covered stretches of every document, in several pieces."""
    def pack_runs(batches):
        powers, packer = Powers(), Packer(buckets, flush)
        for batch in batches:
            for key, hashed, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         text_slices(batch.column(2))):
                if data is not None and packer.add(key, hashed, text_runs(data, powers)):
                    yield packer.rows()
        yield packer.rows()

    def pack_stretches(batches):
        packer = Stretches(8 * flush)
        for batch in batches:
            for key, hashed, data, spans in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                    text_slices(batch.column(2)), batch.column(3).to_pylist()):
                if packer.add(key, hashed, data, *unpacked(spans, 3)):
                    yield packer.rows()
        yield packer.rows()

    found = staged(equal_runs(docs.mapInArrow(pack_runs, PACKED)), "runs")
    stay = found.where("kind = 1").groupBy("id", "hash").agg(F.collect_list("spans").alias("spans"))
    again = (docs.withColumn("id", F.coalesce("id", F.lit(NO_ID))).join(stay, ["id", "hash"])
             .select("id", "hash", "text", "spans"))
    more = staged(sorted_windows(again.mapInArrow(pack_stretches, PACKED)), "windows")
    return found.where("kind = 0").unionByName(more).select("id", "hash", "spans")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_removed, spans (array of [from, to) byte pairs) and
    kept, the remaining bytes (cutting may split a character, so they are binary)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.hash(F.col(text_col)).alias("hash"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = removed_spans(docs, buckets).groupBy("id", "hash").agg(
        F.collect_list("spans").alias("spans"))

    def cut(batches):
        import pyarrow as pa
        pair = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            n, gone, where, kept = [], [], [], []
            for data, blobs in zip(text_slices(batch.column(1)), batch.column(2).to_pylist()):
                a, b = merged(*unpacked(blobs or []))
                edge = np.zeros(len(data) + 1, np.int8)
                edge[a] = 1
                edge[b] -= 1
                n.append(len(data))
                gone.append(int((b - a).sum()))
                where.append(np.stack((a, b), axis=1).tolist())
                kept.append(data[np.cumsum(edge[:-1]) == 0].tobytes() if len(a) else data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(where, pair), pa.array(kept, pa.binary())],
                ["id", "n_bytes", "n_removed", "spans", "kept"])

    rows = (docs.withColumn("own", F.col("id")).withColumn("id", F.coalesce("id", F.lit(NO_ID)))
            .join(spans, ["id", "hash"], "left").select(F.col("own").alias("id"), "text", "spans"))
    return rows.mapInArrow(cut, "id long, n_bytes long, n_removed long, "
                                "spans array<array<bigint>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of earlier documents."""
    return suffix_dedup(read_columns(spark, sf_dir, "documents", "doc_id", "text")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h,
                  octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS s
                   FROM (SELECT rid, doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS MATERIALIZED (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
c AS (SELECT rid, p FROM w JOIN f USING (s) WHERE first_id < doc_id),
g AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run
      FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 50
                                THEN 0 ELSE 1 END AS new FROM c)),
r AS (SELECT rid, run, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY rid, run),
k AS (SELECT d.rid, count(*) AS n_spans, sum(b - a) AS n_removed,
             substr(any_value(h), 1, 2 * min(a)) ||
             string_agg(substr(h, 2 * b + 1, 2 * (coalesce(next_a, n) - b)), '' ORDER BY a) AS kept
      FROM (SELECT *, lead(a) OVER (PARTITION BY rid ORDER BY a) AS next_a FROM r)
      JOIN d USING (rid) GROUP BY d.rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (rid)
"""
