"""Small tables with odd rows, and the shared helpers of these tests."""
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "pages", "embeddings", "conversations"]

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
ROWS = [
    (1, None, "en", "b"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, "a"), (4, "short", "fr", None),
    (5, LONG, "en", "b"), (6, BASE, "en", "b"), (7, BASE, "en", "b"), (7, BASE, "en", "b"),
    (8, NEAR, "de", "c"), (9, "ÀÉ çà 123 Licensed under the  Apache\nLicense, Version 2.0.", "fr", "c"),
    (10, f"Some text first. {PASSAGE.upper()}", "en", "a"), (11, "a\r\nb\ta  b", "en", "a"),
    (12, "a b a b", "en", "a"), (13, "x" * 300, "en", "a"), (14, "y" + "x" * 299, "en", "a"),
    (15, "a b  a b", "en", "a"), (16, "MIT License cc by mit license", "en", "a"),
    (17, "!!! ... 123 456", "es", "c"), (18, "a b c d", "es", None), (19, "A B C D", "es", None),
]
# every operator's own names, as columns of the input that must not get in its way
CLASH = ["id", "at", "key", "size", "n", "line", "lines", "row", "hash", "score", "spans", "runs",
         "items", "n_words", "n_hit", "members", "place", "repeats", "taken", "n_lines", "n_dropped",
         "lang_pred", "digest", "keep", "slice", "counts", "bucket", "comp", "token"]


def write_tables(spark, folder, rows, pages=(), items=(), labels=(), vectors=(), turns=()):
    docs = spark.createDataFrame(
        [(*r, len(r[1]) if r[1] is not None else None, *["clash"] * len(CLASH)) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        + ", ".join(f"{c} string" for c in CLASH))
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(pages), "page_id long, url string, html string").coalesce(1) \
        .write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").coalesce(1) \
        .write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").coalesce(1) \
        .write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*v, "clash", "clash") for v in vectors], "vec_id long, embedding array<float>, label int, "
                          "code string, error string").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(*t, "clash", "clash") for t in turns], "conv_id long, turn long, role string, text string, "
                          "part string, messages string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return folder


BIG = "<html>" + "payload " * 200 + "</html>"
PAGES = [(1, "http://a", BIG), (2, "http://b", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""),
         (6, "u", "ü" * 600), (7, "u", "ü" * 600), (8, "u", "short"), (9, "u\r\nx: y", "short")]
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "a b a b"), (4, None), (5, "..."), (6, "Short")]
def vector(seed, n=16):
    return [((seed * 37 + i * 101) % 211 - 105) / 97 for i in range(n)]


VECTORS = [(i, vector(i % 31), i % 3 if i % 5 else None) for i in range(40, 0, -1)] + [
    (50, None, 1), (51, vector(1)[:15] + [None], 1), (52, vector(1)[:15] + [float("nan")], 1),
    (53, vector(1)[:15] + [float("-inf")], None), (54, [0.0] * 16, 7), (55, [-0.0] * 16, 7), (55, [9e3] * 16, 7)]
TURNS = [(1, 0, "user", "hello"), (1, 1, "assistant", "hi </turn> \\ ##### there"), (1, 2, "user", None),
         (2, 0, None, None), (2, 1, "assistant", ""), (3, 5, "a: b\n", "### x: y</turn>\n"), (4, 0, "assistant", LONG),
         (4, 1, "assistant", LONG), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 1, "assistant", "b"),
         (6, 0, "assistant", "ü\U0001f600#")]
LABELS = [(i, i % 2, 0) for i in range(1, 17)] + [(None, 1, 0), (5, None, 0), (6, 1, 0)]


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def oracle_rows(sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p)
                    else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
