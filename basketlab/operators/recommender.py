"""Item-based collaborative filtering on implicit feedback, for every user at once.

Data never takes matrix form on the driver: the user-item matrix is the long table
``(user_id, product_id, w)``, the similarity matrix is ``(item, neighbor, sim)``.

Scale notes
* Mᵀ·M (item co-occurrence) is a blocked Gram product: entries are bucketed into
  (user block, item block) cells; each pair of item blocks is cogrouped per user
  block and multiplied with numpy inside the task. A cell emits at most
  |items_p| x |items_q| pre-aggregated partial dot products, however many items a
  single (bot-like) user touched, so a hot user is split across item blocks and
  never produces its full pair list in one task. Partials are then summed per
  (item, neighbor) with map-side combine.
* Integer event weights make every dot product an exact integer in float64, so
  the similarity is bit-identical regardless of summation order.
* Scoring joins the user rows to the top-k neighbour table (catalog x k rows):
  fan-out is bounded by k per user-item pair; whether the neighbour table is
  broadcast is the planner's choice by bytes, and AQE's skew join splits hot items.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlab.functions.scalars import clip_low, event_weight, tag_purchases, trim

# Recommendation reasons shown to shoppers.
REASON_CF_PREFIX = "Shoppers who liked “"
REASON_CF_SUFFIX = "” tend to like this too"
REASON_NEW_SHOPPER = "New shopper — showing the store's bestsellers"
REASON_NO_MATCH = "Nothing close enough to match — showing the store's bestsellers"
STRATEGY_CF = "item_based_cf"
STRATEGY_FALLBACK = "popularity_fallback"
TOP_K = 50
BESTSELLERS_N = 50


# G1 / B16 --------------------------------------------------------------------
def feedback_events(interactions: DataFrame, purchases: DataFrame) -> DataFrame:
    cols = ["user_id", "product_id", "interaction_type"]
    return (interactions.select(*cols)
            .unionByName(tag_purchases(purchases.select("user_id", "product_id"))
                         .select(*cols)))


# D17 / B15 / B17 -------------------------------------------------------------
def user_item_weights(interactions: DataFrame, purchases: DataFrame) -> DataFrame:
    """Summed event weight per (user, item), clipped at 0 and kept where > 0."""
    ev = (feedback_events(interactions, purchases)
          .where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
          .withColumn("w", event_weight("interaction_type")))
    return (ev.groupBy("user_id", "product_id").agg(F.sum("w").alias("w"))
            .withColumn("w", clip_low("w", 0.0))
            .where(F.col("w") > 0))


# D18 -------------------------------------------------------------------------
def item_norms(ui: DataFrame) -> DataFrame:
    return ui.groupBy("product_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


# C9 --------------------------------------------------------------------------
CELL_ROWS = 200_000  # rows of one cogroup cell (both sides), held by one task
USER_CHUNK = 4096    # users per dense product inside a cell


def _cell_gram(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame,
               user_chunk: int = USER_CHUNK) -> pd.DataFrame:
    """Partial Gram block of one (user block, item block p, item block q) cell:
    dense products over chunks of users, accumulated into |items_p| x |items_q|."""
    if lpdf.empty or rpdf.empty:
        return pd.DataFrame({"item": lpdf.product_id.iloc[:0],
                             "neighbor": lpdf.product_id.iloc[:0], "dot": np.zeros(0)})
    li, litems = pd.factorize(lpdf.product_id)
    ri, ritems = pd.factorize(rpdf.product_id)
    users = pd.Index(pd.unique(np.concatenate([lpdf.user_id.to_numpy(),
                                               rpdf.user_id.to_numpy()])))
    lu, ru = users.get_indexer(lpdf.user_id), users.get_indexer(rpdf.user_id)
    lw, rw = lpdf.w.to_numpy(), rpdf.w.to_numpy()
    g = np.zeros((len(litems), len(ritems)))
    for lo in range(0, len(users), user_chunk):
        hi = min(lo + user_chunk, len(users))
        lm, rm = (lu >= lo) & (lu < hi), (ru >= lo) & (ru < hi)
        if not lm.any() or not rm.any():
            continue
        a = np.zeros((hi - lo, len(litems)))
        b = np.zeros((hi - lo, len(ritems)))
        np.add.at(a, (lu[lm] - lo, li[lm]), lw[lm])
        np.add.at(b, (ru[rm] - lo, ri[rm]), rw[rm])
        g += a.T @ b
    ii, jj = np.nonzero(g)
    out = pd.DataFrame({"item": np.asarray(litems)[ii], "neighbor": np.asarray(ritems)[jj],
                        "dot": g[ii, jj]})
    if key[1] == key[2]:
        return out[out["item"] != out["neighbor"]]
    mirror = out.rename(columns={"item": "neighbor", "neighbor": "item"})
    return pd.concat([out, mirror[["item", "neighbor", "dot"]]], ignore_index=True)


def cooccurrence_cells(ui: DataFrame, items_per_block: int = 512,
                       cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells (user block, item block p, item block q), for p's and for
    q's items; a cell holds about ``cell_rows`` rows of both sides."""
    n_items = ui.agg(F.approx_count_distinct("product_id").alias("i")).first()["i"] or 0
    nbi = max(1, math.ceil(n_items / items_per_block))
    block = F.pmod(F.xxhash64("product_id"), F.lit(nbi))
    cells = ui.select("user_id", "product_id", F.col("w").cast("double").alias("w"),
                      block.alias("ib"))
    rows_of = cells.groupBy("ib").agg(F.count(F.lit(1)).alias("rows"))
    if nbi > 1:
        # Route each row only to partner blocks its own user touches: replication
        # is min(items of the user, nbi), not nbi. The block set per user has at
        # most nbi entries (an aggregate, then a join on user_id).
        touched = (ui.select(F.col("user_id").alias("_u"), block.alias("_ib"))
                   .groupBy("_u").agg(F.collect_set("_ib").alias("_blocks"))
                   .withColumnRenamed("_u", "user_id"))
        cells = cells.join(touched, "user_id")
        partners_hi = F.filter("_blocks", lambda b: b >= F.col("ib"))
        partners_lo = F.filter("_blocks", lambda b: b <= F.col("ib"))
    else:
        partners_hi = partners_lo = F.array(F.lit(0).cast("bigint"))
    # Each pair of blocks is split by users into as many cells as its own rows ask
    # for, so a block with a hot item is cut into more cells, never a larger one.
    n_p = rows_of.select(F.col("ib").alias("p"), F.col("rows").alias("_rp"))
    n_q = rows_of.select(F.col("ib").alias("q"), F.col("rows").alias("_rq"))
    splits = F.ceil((F.col("_rp") + F.col("_rq")) / F.lit(cell_rows))
    # Left copy of block p meets right copies of blocks q >= p; mirrored after.
    side_cols = ["ub", "p", "q", "user_id", "product_id", "w"]

    def side(df: DataFrame) -> DataFrame:
        df = df.join(n_p, "p").join(n_q, "q").withColumn(
            "ub", F.pmod(F.xxhash64("user_id"), splits))
        # fresh aliases give each side its own attribute ids for the cogroup
        return df.select(*[F.col(c).alias(c) for c in side_cols])

    left = side(cells.withColumn("q", F.explode(partners_hi)).withColumnRenamed("ib", "p"))
    right = side(cells.withColumn("p", F.explode(partners_lo)).withColumnRenamed("ib", "q"))
    return left, right


def item_cooccurrence(ui: DataFrame, items_per_block: int = 512,
                      cell_rows: int = CELL_ROWS, user_chunk: int = USER_CHUNK) -> DataFrame:
    """Σ_u w_ui · w_uj for every item pair i != j sharing a user, as
    ``(item, neighbor, dot)`` (both directions)."""
    key_t = ui.schema["product_id"].dataType.simpleString()
    left, right = cooccurrence_cells(ui, items_per_block, cell_rows)
    partial = (left.groupBy("ub", "p", "q")
               .cogroup(right.groupBy("ub", "p", "q"))
               .applyInPandas(lambda k, a, b: _cell_gram(k, a, b, user_chunk),
                              schema=f"item {key_t}, neighbor {key_t}, dot double"))
    return partial.groupBy("item", "neighbor").agg(F.sum("dot").alias("dot"))


def item_similarity(ui: DataFrame, **block_kw) -> DataFrame:
    """Cosine similarity of item columns, pairs with sim > 0, no diagonal."""
    norms = item_norms(ui)
    ni = norms.select(F.col("product_id").alias("item"), F.col("norm").alias("norm_i"))
    nj = norms.select(F.col("product_id").alias("neighbor"), F.col("norm").alias("norm_j"))
    d = item_cooccurrence(ui, **block_kw).join(ni, "item").join(nj, "neighbor")
    return (d.select("item", "neighbor",
                     (F.col("dot") / (F.col("norm_i") * F.col("norm_j"))).alias("sim"))
            .where(F.col("sim") > 0))


# E2 / E3 / E5 ----------------------------------------------------------------
def top_n_per(df: DataFrame, key: str, order: list, n: int, rank_col: str = "rank"):
    """Rows ranked 1..n within ``key``. The rank filter lets Catalyst insert a
    partial WindowGroupLimit before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= n)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def top_neighbors(sim: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_n_per(sim, "item", [F.col("sim").desc(), F.col("neighbor").asc()], k)


# F8 --------------------------------------------------------------------------
def bestsellers(pstats: DataFrame, n: int = BESTSELLERS_N) -> DataFrame:
    """Top n products by purchases then views (product_id breaks ties), ranked."""
    order = [F.col("n_purchases").desc(), F.col("n_view").desc(), F.col("product_id").asc()]
    top = pstats.select("product_id", "n_purchases", "n_view").orderBy(*order).limit(n)
    # window over at most n rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


# C10 / C11 ------------------------------------------------------------------
def _neighbor_side(neighbors: DataFrame) -> DataFrame:
    return neighbors.select(F.col("item").alias("product_id"),
                            F.col("neighbor").alias("rec_id"), "sim")


def score_candidates(ui: DataFrame, neighbors: DataFrame, nb_side: DataFrame | None = None
                     ) -> DataFrame:
    """score(u, j) = Σ_i w_ui · sim(i, j) over the user's items i whose top-k
    neighbour list holds j; items the user already engaged with are excluded.
    Fan-out is at most k rows per (user, item); the sum is a hash aggregate with
    map-side combine, keyed by (user, candidate) so a hot user spreads over
    candidates. Parts are summed as two whole numbers, billionths and billionths of
    these, so the order of rows can't swap close candidates, and the score is exact to 18
    places (decimal). The sums have room for a total weight and a number of parts of nine
    billion each; an overflow is an error, never a wrong score."""
    nb = nb_side if nb_side is not None else _neighbor_side(neighbors)
    part = F.col("w") * F.col("sim") * F.lit(1e9)
    scored = ui.join(nb, "product_id").groupBy("user_id", "rec_id").agg(
        F.sum(F.floor(part)).alias("high"),
        F.sum(F.floor((part - F.floor(part)) * F.lit(1e9) + F.lit(0.5))).alias("low"))
    scored = scored.select("user_id", "rec_id", F.expr(
        "CAST(CAST(high + low DIV 1000000000L AS DECIMAL(19,0)) * 0.000000001BD AS DECIMAL(37,18))"
        " + CAST(low % 1000000000L AS DECIMAL(9,0)) * 0.000000000000000001BD").alias("score"))
    seen = ui.select("user_id", F.col("product_id").alias("rec_id"))
    return (scored.join(seen, ["user_id", "rec_id"], "left_anti")
            .where(F.col("score") > 0))


# E4 --------------------------------------------------------------------------
def seed_items(pairs: DataFrame, ui: DataFrame, neighbors: DataFrame,
               nb_side: DataFrame | None = None) -> DataFrame:
    """For each (user_id, rec_id) pair, the user's item contributing most to the
    score (largest w·sim; the smallest id on exact ties). Computed only for the
    pairs asked for (the final top-n lists), so the struct-ordered aggregate sees
    n x |items of the user| rows per user instead of every candidate."""
    nb = nb_side if nb_side is not None else _neighbor_side(neighbors)
    x = pairs.select("user_id", "rec_id").join(ui, "user_id").join(nb, ["product_id", "rec_id"])
    c = F.col("w") * F.col("sim")
    return x.groupBy("user_id", "rec_id").agg(
        F.min_by("product_id", F.struct((-c).alias("nc"), F.col("product_id"))).alias("seed_id"))


# F9 (C12, C13, E3, B26) -------------------------------------------------------
def recommend_all(users: DataFrame, ui: DataFrame, neighbors: DataFrame,
                  best: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Top-n recommendations for every user: item-based CF where any candidate
    scores above 0, otherwise the bestseller list (with the reason why)."""
    nb = _neighbor_side(neighbors)
    attrs = products.select("product_id", "product_name", "category", "brand", "price")
    cand = score_candidates(ui, neighbors, nb).join(users.select("user_id"), "user_id",
                                                    "left_semi")
    cf = top_n_per(cand, "user_id", [F.col("score").desc(), F.col("rec_id").asc()], n)
    cf = cf.join(seed_items(cf, ui, neighbors, nb), ["user_id", "rec_id"], "left")
    names = attrs.select(F.col("product_id").alias("seed_id"),
                         F.col("product_name").alias("seed_name"))
    cf_rows = (cf.join(names, "seed_id", "left")
               .select("user_id", "rank", F.col("rec_id").alias("product_id"),
                       F.round(F.col("score").cast("double"), 9).alias("score"),
                       F.lit(False).alias("cold_start"),
                       F.lit(STRATEGY_CF).alias("strategy"),
                       F.concat(F.lit(REASON_CF_PREFIX), F.col("seed_name"),
                                F.lit(REASON_CF_SUFFIX)).alias("reason"),
                       "seed_id"))
    in_matrix = ui.select("user_id").distinct()
    has_cf = cf.select("user_id").distinct()
    fallback = (users.select("user_id")
                .join(in_matrix.withColumn("_m", F.lit(True)), "user_id", "left")
                .join(has_cf, "user_id", "left_anti")
                .select("user_id",
                        F.when(F.col("_m"), F.lit(REASON_NO_MATCH))
                        .otherwise(F.lit(REASON_NEW_SHOPPER)).alias("reason"),
                        F.explode(F.sequence(F.lit(1).cast("bigint"),
                                             F.lit(n).cast("bigint"))).alias("rank")))
    # Equi-join on rank against the (at most n-row) bestseller list.
    top = F.broadcast(best.where(F.col("rank") <= n).select("rank", "product_id"))
    fb_rows = (fallback.join(top, "rank")
               .select("user_id", "rank", "product_id", F.lit(0.0).alias("score"),
                       F.lit(True).alias("cold_start"),
                       F.lit(STRATEGY_FALLBACK).alias("strategy"), "reason",
                       F.lit(None).cast(ui.schema["product_id"].dataType).alias("seed_id")))
    return cf_rows.unionByName(fb_rows).join(attrs, "product_id", "left").select(
        "user_id", "rank", "product_id", "score", "cold_start", "strategy", "reason",
        "seed_id", "product_name", "category", "brand", "price")


# F12 / C8 / B25 ---------------------------------------------------------------
def recommend_for(ids: DataFrame, users: DataFrame, ui: DataFrame, neighbors: DataFrame,
                  best: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    """Top-n lists for the requested ids (a text column ``requested``, white space at
    its ends ignored): a row per recommendation with status ``found``, and one row
    with status ``unknown`` for each id that no user has."""
    if not 1 <= int(n) <= 20:
        raise ValueError(f"n must be between 1 and 20, not {n}")
    key = users.schema["user_id"].dataType.simpleString()
    asked = ids.select("requested").distinct().select(
        "requested", trim("requested").alias("_id"))
    known = users.select(F.col("user_id").cast("string").alias("_id"), "user_id")
    asked = asked.join(known, "_id", "left")
    found = asked.where(F.col("user_id").isNotNull()).select("requested", "user_id")
    recs = recommend_all(found.select(F.col("user_id").cast(key)).distinct(), ui, neighbors,
                         best, products, n)
    rows = found.join(recs, "user_id").select(
        "requested", F.lit("found").alias("status"), "rank", "product_id", "score", "strategy")
    missing = asked.where(F.col("user_id").isNull()).select(
        "requested", F.lit("unknown").alias("status"),
        *[F.lit(None).cast(rows.schema[c].dataType).alias(c)
          for c in ("rank", "product_id", "score", "strategy")])
    return rows.unionByName(missing)


# E5 --------------------------------------------------------------------------
def user_history(ui: DataFrame, products: DataFrame, n: int = 5) -> DataFrame:
    h = top_n_per(ui, "user_id", [F.col("w").desc(), F.col("product_id").asc()], n)
    attrs = products.select("product_id", "product_name", "category")
    return h.join(attrs, "product_id", "left").select(
        "user_id", "rank", "product_id", F.col("w").alias("weight"), "product_name",
        "category")


# D19 -------------------------------------------------------------------------
def matrix_density(ui: DataFrame, products: DataFrame) -> DataFrame:
    """Users, catalog items, non-zeros and density of the user-item matrix, as one
    global aggregate over the two tagged inputs (no join)."""
    t = F.col("_t")
    u = (ui.select(F.lit("ui").alias("_t"), "user_id")
         .unionByName(products.select(F.lit("p").alias("_t")), allowMissingColumns=True))
    m = u.agg(F.countDistinct(F.when(t == "ui", F.col("user_id"))).alias("n_users"),
              F.count_if(t == "p").alias("n_items"),
              F.count_if(t == "ui").alias("nnz"))
    return m.withColumn("density", F.try_divide(
        F.col("nnz").cast("double"), (F.col("n_users") * F.col("n_items")).cast("double")))


# D30 -------------------------------------------------------------------------
def coverage_sample(ui: DataFrame, size: int = 500) -> DataFrame:
    """A seeded, reproducible sample of matrix users: the ``size`` users with the
    smallest md5 of their id (bounded by ``size``: sampling is the feature)."""
    u = ui.select("user_id").distinct().withColumn(
        "_h", F.md5(F.col("user_id").cast("string")))
    return u.orderBy("_h", "user_id").limit(size).select("user_id")


def matrix_users(ui: DataFrame) -> DataFrame:
    """Every user of the matrix."""
    return ui.select("user_id").distinct()


def catalog_coverage(recs: DataFrame, sample: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct catalog items reachable in the sample users' lists (one aggregate)."""
    t = F.col("_t")
    u = (recs.join(sample, "user_id", "left_semi")
         .select(F.lit("r").alias("_t"), "user_id", "product_id")
         .unionByName(sample.select(F.lit("s").alias("_t"), "user_id"),
                      allowMissingColumns=True)
         .unionByName(products.select(F.lit("p").alias("_t")), allowMissingColumns=True))
    c = u.agg(F.countDistinct(F.when(t == "r", F.col("product_id"))).alias("catalog_reachable"),
              F.count_if(t == "p").alias("n_items"),
              F.count_if(t == "s").alias("sample_size"),
              F.countDistinct(F.when(t == "r", F.col("user_id"))).alias("users_served"))
    return c.select("catalog_reachable", "n_items",
                    F.try_divide(F.col("catalog_reachable").cast("double"),
                                 F.col("n_items").cast("double")).alias("catalog_share"),
                    "sample_size", "users_served")
