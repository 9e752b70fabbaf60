"""Line deduplication with a log-template tree of fixed depth.

A line's tokens are its blank-separated words, those with a digit being variable
(``<*>``). The tree's levels are the number of tokens and the leading ``depth`` tokens;
a leaf holds the lines that share them. Within a leaf the most frequent line is a
template, and a line that agrees with it in at least ``similarity`` of its tokens (compared
one by one) is an instance of it, so that the tokens that differ are variable fields too;
the most frequent of the other lines is the next template, and so on (equal counts: larger
hash first).

Only the distinct lines of leaves that hold several are compared, and of these only lines
that can agree with another: where m tokens may differ, those past the leading ones are
dealt into m + 1 bands, and two lines that agree have a band in common. A line with no band
that another one of its leaf has (and any line so short that no token may differ) is a
template of its own at once. The others are compared in rounds that find up to ``HEADS``
templates a leaf each, until no leaf is left whose unmatched lines could still make a
template that recurs often enough. So the number of rounds follows the most unlike lines of
a leaf that share a band with another, however many lines there are besides.

A template that recurs in at least ``min_docs`` documents of different text is dropped
from all of them but its first place (smallest id, then text hash, then line); a template
of more than ``long_words`` tokens goes from its second document on (``LONG_DOCS``), as a
passage of that length doesn't recur by chance. Both numbers hold at every size. Exact
copies of one document count once here and are left to document deduplication (README).

Everything is DataFrame operations. Only hashes of lines are shuffled and counted, per
template after partial aggregation (a line that stands in a third of all documents is one
row per task and document hash); the texts move once, to meet their dropped line numbers.

Odd cases: null text stays null and has no lines; blank lines are never templates and
stay; a document that loses every line keeps its row with an empty text; rows that agree
in id and text get the same result; a null id sorts last; empty tables give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.llm.common import read_columns, staged

LONG_DOCS = 2
HEADS = 16


def row_key(id_col: str, text_col: str):
    """What identifies a row: id (null last) and text hash; equal inside joins."""
    return F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"),
                    F.xxhash64(F.col(text_col)).alias("hash"))


def line_rows(docs: DataFrame, id_col: str, text_col: str, depth: int, min_docs: int,
              long_words: int) -> DataFrame:
    """(at, line, leaf, need, sig, words) of each line that isn't blank; need: in how many
    documents a template of its length recurs when it is dropped; words: the tokens in one
    string, blanks between them."""
    lines = docs.select(row_key(id_col, text_col).alias("at"),
                        F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "raw"))
    # translate goes character by character, so only lines that need it pay for it
    blank = F.when(F.col("raw").contains("\t") | F.col("raw").contains("\r"),
                   F.translate("raw", "\t\r", "  ")).otherwise(F.col("raw"))
    masked = F.when(F.col("raw").rlike("[0-9]"),
                    F.regexp_replace(blank, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(blank)
    lines = lines.select("at", "line", masked.alias("words")).select(
        "*", tokens_of("words").alias("t")).where("size(t) > 0")
    n = F.size("t")
    need = F.when(n > long_words, min(LONG_DOCS, min_docs)).otherwise(min_docs)
    return lines.select("at", "line", F.xxhash64(n, F.slice("t", 1, depth)).alias("leaf"),
                        need.alias("need"),
                        F.xxhash64("t").alias("sig"), "words")


def tokens_of(words):
    return F.array_remove(F.split(words, " "), "")


def lonely(kinds: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(leaf, sig) of the kinds that agree with no other kind of their leaf for sure."""
    n = F.size("tokens")
    may = n - F.ceil(F.lit(similarity) * n - F.lit(1e-9)).cast("int")  # tokens that may differ
    shown = kinds.select("leaf", "sig", "tokens", n.alias("n"), may.alias("may"))
    rest, lead = F.col("n") - F.least(F.lit(depth), F.col("n")), F.least(F.lit(depth), F.col("n"))
    # without a token to spare past the leading ones, the whole leaf is one band
    bands = F.when(F.col("may") >= rest, 1).otherwise(F.col("may") + 1)
    cut = lambda i: lead + F.floor(i * rest / bands).cast("int")
    band = shown.where("may > 0").select("leaf", "sig", "tokens", "n", "may", F.explode(
        F.sequence(F.lit(0), bands - 1)).alias("i")).select(
        "leaf", "sig", F.when(F.col("may") >= rest, F.xxhash64("leaf")).otherwise(F.xxhash64(
            "i", F.slice("tokens", cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))))).alias("band"))
    band = staged(band, "bands")
    met = band.groupBy("leaf", "band").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo != hi")
    known = band.join(met.select("leaf", "band"), ["leaf", "band"], "left_semi").select("leaf", "sig").distinct()
    return kinds.select("leaf", "sig").join(known, ["leaf", "sig"], "left_anti")


def alike(a, b, similarity: float):
    """Whether two lines of one leaf agree in enough of their tokens."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return same >= similarity * F.size(a)


def leaf_heads(kinds: DataFrame, similarity: float, most: int) -> DataFrame:
    """(leaf, heads): of each leaf's ``most`` most frequent kinds those that agree with no
    more frequent one, in order."""
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("n"), F.desc("sig")))
    top = kinds.select("leaf", F.struct("n", "sig", "tokens").alias("kind"), rank.alias("rank")).where(
        F.col("rank") <= most).groupBy("leaf").agg(F.collect_list("kind").alias("top"))
    top = top.withColumn("top", F.reverse(F.array_sort("top")))
    none = F.slice("top", 1, 0)
    return top.select("leaf", F.aggregate("top", none, lambda heads, x: F.when(
        F.exists(heads, lambda h: alike(h["tokens"], x["tokens"], similarity)), heads)
        .otherwise(F.concat(heads, F.array(x)))).alias("heads"))


def matched_kinds(kinds: DataFrame, similarity: float, most: int = HEADS) -> list[DataFrame]:
    """(leaf, sig, template) of all kinds, in parts: each round the kinds that agree with one
    of the leaf's next templates (the first such) leave."""
    done = []
    while True:
        heads = leaf_heads(kinds, similarity, most)
        first = F.aggregate("heads", F.lit(None).cast("long"), lambda found, h: F.coalesce(
            found, F.when(alike(h["tokens"], F.col("tokens"), similarity), h["sig"])))
        tried = staged(kinds.join(heads, "leaf").select(*kinds.columns, first.alias("template")), "tried")
        done.append(tried.where("template IS NOT NULL").select("leaf", "sig", "template"))
        rest = tried.where("template IS NULL").drop("template")
        # one kind, or fewer lines than documents needed: nothing to find any more
        open_ = rest.groupBy("leaf", "need").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
        open_ = open_.where("kinds > 1 AND all >= need").select("leaf", F.lit(True).alias("more"))
        rest = staged(rest.join(open_, "leaf", "left"), "unmatched")
        done.append(rest.where("more IS NULL").select("leaf", "sig", F.col("sig").alias("template")))
        kinds = rest.where("more").drop("more")
        if kinds.isEmpty():
            return done


def templates(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(leaf, sig, template) of the distinct lines of leaves with enough lines."""
    place = F.xxhash64("at", "line")
    kinds = lines.groupBy("leaf", "need", "sig").agg(F.count(F.lit(1)).alias("n"),
                                                     F.min(place).alias("place"))
    leaves = kinds.groupBy("leaf", "need").agg(F.sum("n").alias("all"),
                                               F.count(F.lit(1)).alias("kinds"))
    leaves = leaves.where(F.col("all") >= F.col("need")).select("leaf", "kinds")
    kinds = staged(kinds.join(leaves, "leaf"), "line-kinds")
    # one line of each kind brings its tokens; the place spreads a hot line over the tasks
    several = kinds.where("kinds > 1").select("leaf", "need", "sig", "place", "n")
    several = staged(lines.select("leaf", "sig", "words", place.alias("place")).join(
        several, ["leaf", "sig", "place"]).dropDuplicates(["leaf", "sig"]).select(
        "leaf", "need", "sig", "n", tokens_of("words").alias("tokens")), "several")
    apart = staged(lonely(several, similarity, depth), "lonely")
    matched = matched_kinds(staged(several.join(apart, ["leaf", "sig"], "left_anti"), "comparable"), similarity)
    alone = kinds.where("kinds = 1").select("leaf", "sig").unionByName(apart).select(
        "leaf", "sig", F.col("sig").alias("template"))
    for part in matched:
        alone = alone.unionByName(part)
    return staged(alone, "line-templates")


def dropped_lines(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """(at, lines): the line numbers to drop, one row per document that loses any."""
    kinds = templates(lines, similarity, depth)
    placed = staged(lines.select("at", "line", "leaf", "need", "sig").join(kinds, ["leaf", "sig"]).select(
        "at", "line", "need", F.xxhash64("leaf", "template").alias("template")), "template-lines")
    by_text = placed.groupBy("template", "need", F.col("at.hash").alias("hash")).agg(
        F.min(F.struct("at", "line")).alias("first"))
    # written out, so that the join below has plain sides and may split a hot template
    recurring = staged(by_text.groupBy("template", "need").agg(
        F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).where(
        F.col("docs") >= F.col("need")).select("template", "first"), "recurring")
    return (placed.join(recurring, "template")
            .where(F.struct("at", "line") != F.col("first"))
            .groupBy("at").agg(F.collect_set("line").alias("lines")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 3,
               similarity: float = 0.8, min_docs: int = 5, long_words: int = 50) -> DataFrame:
    """The frame with the text deduplicated and n_lines, n_dropped added (columns of
    these names are replaced)."""
    docs = docs.drop("n_lines", "n_dropped")
    lines = staged(line_rows(docs, id_col, text_col, depth, min_docs, long_words), "lines")
    drops = dropped_lines(lines, similarity, depth)
    whole = docs.select(row_key(id_col, text_col).alias("at"), F.struct(*docs.columns).alias("row"))
    joined = whole.join(drops, "at", "left")
    old = F.col("row")[text_col]
    parts = F.split(old, "\n")
    kept = F.transform(F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "lines")),
                       lambda i: parts[i])
    new = F.when(F.col("lines").isNull(), old).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(new if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns],
        F.when(old.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of recurring templates."""
    return line_dedup(read_columns(spark, sf_dir, "documents", "doc_id", "text"))
