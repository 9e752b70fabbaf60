"""WARC archives of Zstandard frames with a shared dictionary: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself one Zstandard frame; each record after it is one frame of its own. The reader
loads the dictionary from that first frame, walks the archive frame by frame (a frame's
end follows from its own block headers), decodes one record per frame and validates the
version line, the mandatory headers, Content-Length and the payload digest.

Writing: of rows with equal payloads of at least ``min_revisit`` bytes the one with the
largest id becomes the response, the others become revisits that refer to it and carry
no payload; shorter payloads are all responses. Each task writes archives of bounded
size to a shared folder under a name that a repeated task writes again, so a lost
executor leaves neither gaps nor doubles.

Odd cases: null html is an empty payload; rows with the same id and payload as the
largest are all responses; a null id is written as no id and read back as null; an empty
table gives one archive folder without records and no rows. A broken archive raises
``WarcError`` that names the archive and the record.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns, scratch_path

# Fixed values of the file format.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, "
           "record_type string, refers_to long, payload binary")


class WarcError(ValueError):
    """An archive that breaks the format."""


# --- one record ----------------------------------------------------------------

def record_id(page_id) -> str:
    return "<urn:page:%s>" % ("" if page_id is None else page_id)


def page_of(value: str | None) -> int | None:
    digits = (value or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def encode_record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if refers_to is not None else http + payload
    clean = "".join(c for c in url or "" if c not in "\r\n")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"),
               ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"),
               ("WARC-Target-URI", clean), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", "sha1:" + hashlib.sha1(payload).hexdigest()),
               ("WARC-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def decode_record(data: bytes, where: str) -> tuple:
    """The record as a row of RECORDS; raises WarcError when it breaks the format."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError(f"{where}: no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"{where}: header line without a colon: {line[:80]!r}")
        headers[key.strip().lower()] = value.strip()
    for name in MANDATORY:
        if name.lower() not in headers:
            raise WarcError(f"{where}: {name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError(f"{where}: Content-Length is not a number")
    if len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"{where}: the block is not as long as Content-Length says")
    kind, payload = headers["warc-type"], None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    length = int(headers.get("warc-payload-length", -1))
    refers = page_of(headers.get("warc-refers-to"))
    if kind == "response":
        _, gap, payload = rest[:-4].partition(b"\r\n\r\n")
        if not gap:
            raise WarcError(f"{where}: the HTTP header has no end")
        if length not in (-1, len(payload)) or digest not in ("", hashlib.sha1(payload).hexdigest()):
            raise WarcError(f"{where}: payload length or digest differs")
        length = len(payload)
    elif kind == "revisit" and (refers is None or not digest or length < 0):
        raise WarcError(f"{where}: a revisit needs what it refers to and the payload's digest")
    return (page_of(headers["warc-record-id"]), headers.get("warc-target-uri"), length, digest,
            kind, refers, payload)


# --- one archive ----------------------------------------------------------------

def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return DICT_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def load_dictionary(archive, where: str) -> tuple[bytes, int]:
    """The dictionary and where the records start."""
    import zstandard
    if len(archive) < 8 or int.from_bytes(archive[:4], "little") != DICT_MAGIC:
        raise WarcError(f"{where}: no leading dictionary frame")
    end = 8 + int.from_bytes(archive[4:8], "little")
    if end > len(archive):
        raise WarcError(f"{where}: the dictionary frame is cut off")
    body = bytes(archive[8:end])
    if int.from_bytes(body[:4], "little") == FRAME_MAGIC:
        body = zstandard.ZstdDecompressor().decompress(body)
    return body, end


def frame_end(archive, at: int, where: str) -> int:
    """Where the frame at `at` ends, from its header and block headers (RFC 8878)."""
    import zstandard
    try:
        info = zstandard.get_frame_parameters(archive[at:at + 18])
        pos = at + zstandard.frame_header_size(archive[at:at + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"{where}: bad frame header: {e}") from None
    last = False
    while not last:
        if pos + 3 > len(archive):
            raise WarcError(f"{where}: the frame is cut off")
        block = int.from_bytes(archive[pos:pos + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * bool(info.has_checksum)
    if pos > len(archive):
        raise WarcError(f"{where}: the frame is cut off")
    return pos


def read_archive(archive, where: str):
    """The archive's records, one frame after the other."""
    import zstandard
    archive = memoryview(archive)
    dictionary, at = load_dictionary(archive, where)
    context = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    n = 0
    while at < len(archive):
        here = f"{where}, record {n}"
        end = frame_end(archive, at, here)
        try:
            data = context.decompress(archive[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"{here}: {e}") from None
        yield decode_record(data, here)
        at, n = end, n + 1


def train_dictionary(pages: DataFrame, id_col: str, html_col: str, rows: int = 400,
                     sample_bytes: int = 4 << 20, size: int = 64 << 10) -> bytes:
    """A dictionary from at most `rows` pages (those with the smallest id hash) and
    `sample_bytes` of them; compression only, so results don't depend on it."""
    import zstandard
    ids = (pages.select(F.col(id_col).alias("k")).where("k is not null").distinct()
           .orderBy(F.xxhash64("k"), "k").limit(rows))
    each = max(1024, sample_bytes // rows)
    sample = [r[0] for r in pages.join(F.broadcast(ids), F.col(id_col) == F.col("k"))
              .select(F.substring(F.col(html_col).cast("binary"), 1, each).alias("h"))
              .where("length(h) > 0").limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, [bytes(s) for s in sorted(sample)]).as_bytes()
    except zstandard.ZstdError:  # too little text for a dictionary
        return b""


# --- the Spark jobs ---------------------------------------------------------------

def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", min_revisit: int = 1000) -> DataFrame:
    """(page_id, url, payload, refers_to): which rows are revisits, and of what."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    long = F.length("payload") >= min_revisit
    # a short payload gets no key, and spreads by its id
    rows = rows.withColumn("key", F.when(long, F.sha2("payload", 256)))
    first = (rows.where("key is not null").groupBy("key")
             .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("key", "holder"))
    held = (F.col("holder").isNotNull()
            & (F.col("page_id").isNull() | (F.col("page_id") < F.col("holder"))))
    return (rows.join(first, "key", "left")
            .select("page_id", "url", "payload", F.when(held, F.col("holder")).alias("refers_to")))


def write_archives(records: DataFrame, folder: str, dictionary: bytes,
                   archive_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Write the planned records as archives into the shared folder (any file system
    pyarrow opens by URI); returns one row per archive: name, records, bytes."""
    def write(batches):
        import pyarrow as pa
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        made: list[tuple] = []

        def close(frames, n):
            name = f"part-{context.partitionId():06d}-{len(made):05d}.warc.zst"
            tried = f"{base}/.{name}.{context.taskAttemptId()}"
            with system.open_output_stream(tried) as out:
                for f in frames:
                    out.write(f)
            system.move(tried, f"{base}/{name}")  # a repeated task replaces it whole
            made.append((name, n, sum(map(len, frames))))

        packer = zstandard.ZstdCompressor(
            level=level, write_checksum=True, write_content_size=True,
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        lead = dictionary_frame(dictionary)
        frames, n, size = [lead], 0, 0
        for batch in batches:
            for page_id, url, payload, refers in zip(*(c for c in batch.columns)):
                frames.append(packer.compress(encode_record(
                    page_id.as_py(), url.as_py(), payload.as_py(), refers.as_py())))
                n, size = n + 1, size + len(frames[-1])
                if size >= archive_bytes:
                    close(frames, n)
                    frames, n, size = [lead], 0, 0
        if n:
            close(frames, n)
        yield pa.RecordBatch.from_pylist(
            [{"name": a, "records": b, "bytes": c} for a, b, c in made],
            pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(
        write, "name string, records long, bytes long")


def read_archives(spark: SparkSession, folder: str, pattern: str = "*.warc.zst") -> DataFrame:
    """All records of the folder's archives, one row each."""
    def read(batches):
        import pyarrow as pa
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary())])
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, size = [], 0
                for r in read_archive(content.as_buffer(), path.as_py()):
                    rows.append(dict(zip(schema.names, r)))
                    size += len(r[-1] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
            .select("path", "content").mapInArrow(read, RECORDS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives, read the archives back, and report each record."""
    pages = read_columns(spark, sf_dir, "pages", "page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop_path)
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    written = write_archives(plan_records(pages), uri, train_dictionary(pages, "page_id", "html"))
    total = written.agg(F.sum("records")).first()[0] or 0
    back = read_archives(spark, folder)
    if not total:
        return spark.createDataFrame([], RECORDS).drop("url", "payload")
    return back.drop("url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS t FROM pages),
h AS (SELECT t, max(page_id) AS holder FROM p WHERE octet_length(b) >= 1000 GROUP BY t)
SELECT p.page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.t) AS payload_digest,
       CASE WHEN p.page_id < h.holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < h.holder THEN h.holder END AS refers_to
FROM p LEFT JOIN h USING (t)
"""
