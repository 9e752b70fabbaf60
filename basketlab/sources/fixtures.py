"""The six shop tables as views over the driver's parquet tables.

users <- customer, products <- part (+ reviews), sessions/interactions/purchases
<- events, reviews <- lineitem x orders. The mapping is fixed (see FIXTURES.md)
and mirrored for DuckDB in ``basketlab.plans.fixtures_sql``. Cleaning rules of the
shop's loader (floor timestamps to the second, trim categoricals, integer target)
are applied here, so every downstream job sees cleaned tables.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlab.functions.scalars import floor_second, trim_cols
from basketlab.operators.joins import materialize

# Fixed values of the view mapping (must match the oracle SQL).
LOYALTY_TIERS = ["bronze", "silver", "gold", "platinum"]
INCOME_LEVELS = ["low", "medium", "high", "very_high"]
DEVICE_TYPES = ["desktop", "mobile", "tablet"]
REFERRERS = ["direct", "organic_search", "paid_search", "email", "social",
             "referral", "display_ad"]

# Columns read from each driver table (explicit projection -> ReadSchema pruning).
SOURCE_COLUMNS = {
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                 "l_returnflag", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey"],
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cols = SOURCE_COLUMNS.get(name)
    return df.select(*cols) if cols else df


def _pick(values, idx_col):
    """values[idx] for a small fixed vocabulary, as a CASE expression."""
    expr = None
    for i, v in enumerate(values[:-1]):
        cond = idx_col == i
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def events(spark, sf_dir) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        floor_second("ts").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.to_date("ts").cast("string")).alias("session_id"),
    )


def users(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    out = c.select(
        key.alias("user_id"),
        (F.lit(18) + key % 53).cast("bigint").alias("age"),
        F.col("c_mktsegment").alias("preferred_category"),
        _pick(LOYALTY_TIERS, key % 4).alias("loyalty_tier"),
        _pick(INCOME_LEVELS, F.col("c_nationkey") % 4).alias("income_level"),
        F.date_add(F.lit("2023-01-01").cast("date"), (key % 365).cast("int"))
        .cast("timestamp").alias("signup_date"),
    )
    return trim_cols(out, ["income_level", "preferred_category", "loyalty_tier"])


def interactions(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") != "purchase")
    even = F.col("k") % 2 == 0
    itype = (F.when(F.col("event_type").isin("view", "click"), F.col("event_type"))
             .when((F.col("event_type") == "signup") & even, "add_to_cart")
             .when(F.col("event_type") == "signup", "add_to_wishlist")
             .when((F.col("event_type") == "error") & even, "remove_from_cart")
             .when(F.col("event_type") == "error", "remove_from_wishlist")
             .otherwise(F.col("event_type")))
    dwell = F.least(F.greatest(F.round(F.col("value") * 1000), F.lit(500)), F.lit(300000))
    out = e.select(
        F.col("event_id").alias("interaction_id"), "user_id",
        F.col("k").alias("product_id"), "session_id",
        itype.alias("interaction_type"),
        F.col("ts").alias("timestamp"),
        dwell.cast("bigint").alias("dwell_time_ms"),
    )
    return trim_cols(out, ["interaction_type"])


def purchases(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("purchase_id"),
        F.col("session_id").alias("order_id"),
        "user_id", F.col("k").alias("product_id"), "session_id",
        F.col("event_id").alias("interaction_id"),
        (F.lit(1) + F.col("k") % 3).cast("bigint").alias("quantity"),
        F.col("value").alias("total_amount"),
        F.col("ts").alias("order_date"),
    )


def sessions(spark, sf_dir) -> DataFrame:
    e = events(spark, sf_dir)
    s = e.groupBy("session_id", "user_id").agg(
        F.min("ts").alias("start_time"),
        F.min("event_id").alias("_first_event"),
        F.max((F.col("event_type") == "purchase").cast("int")).cast("bigint")
        .alias("is_converted"),
    )
    out = s.select(
        "session_id", "user_id", "start_time",
        _pick(DEVICE_TYPES, F.col("_first_event") % 3).alias("device_type"),
        _pick(REFERRERS, F.col("_first_event") % 7).alias("referrer_source"),
        "is_converted",
    )
    return trim_cols(out, ["device_type", "referrer_source"])


def reviews(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("bigint"))
        .otherwise(F.col("l_orderkey")).alias("purchase_id"),
        (F.lit(1) + F.col("l_quantity").cast("bigint") % 5).cast("bigint").alias("rating"),
        floor_second("l_shipdate").alias("review_date"),
    )


def products(spark, sf_dir) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    r = reviews(spark, sf_dir).groupBy("product_id").agg(
        F.avg("rating").alias("rating_avg"), F.count(F.lit(1)).alias("review_count"))
    j = p.join(r, p.p_partkey == r.product_id, "left")
    rated = F.col("p_partkey") % 2 == 0
    out = j.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"),
        # the catalog shows ratings of every second product, so that some are unrated
        F.when(rated, F.col("rating_avg")).alias("rating_avg"),
        F.coalesce(F.when(rated, F.col("review_count")), F.lit(0)).cast("bigint").alias("review_count"),
        F.col("p_size").cast("bigint").alias("stock_quantity"),
    )
    return trim_cols(out, ["category", "brand"])


TABLES = {
    "users": users, "products": products, "sessions": sessions,
    "interactions": interactions, "purchases": purchases, "reviews": reviews,
}


# --- landing: each table is derived once per input ------------------------------
_LANDED: dict = {}


def input_key(spark: SparkSession, sf_dir: str) -> tuple:
    """Application, folder and its files: a file that is added, overwritten or gone
    (path, size or time) makes a new key."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed, it = [], fs.listFiles(path, True)
    while it.hasNext():
        f = it.next()
        listed.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return (spark.sparkContext.applicationId, sf_dir, tuple(sorted(listed)))


class Shop:
    """The six clean tables of one data folder. Each is derived from the raw tables
    once, landed as Parquet in the shared folder, and read from there by every job."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._key: tuple | None = None

    @property
    def files(self) -> list:
        """(path, size, time) of each input file: the same in every session."""
        return [list(f) for f in self.key[2]]

    @property
    def key(self) -> tuple:
        if self._key is None:
            self._key = input_key(self.spark, self.sf_dir)
        return self._key

    def landed(self, name: str, build) -> DataFrame:
        """The table `name`, built and written on first use."""
        at = (self.key, name)
        if at not in _LANDED:
            _LANDED[at] = materialize(build(), name)
        return _LANDED[at]

    def __getattr__(self, name):
        if name in TABLES:
            return self.landed(name, lambda: TABLES[name](self.spark, self.sf_dir))
        raise AttributeError(name)

    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLES}
