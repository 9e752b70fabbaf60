"""DuckDB oracle SQL for the recommender."""
from __future__ import annotations

from basketlab.plans.fixtures_sql import with_fixtures
from basketlab.plans.oracle_aggregates import EXTRA

REASON_CF = "'Shoppers who liked “' || sp.product_name || '” tend to like this too'"
REASON_NEW = "'New shopper — showing the store''s bestsellers'"
REASON_NO_MATCH = "'Nothing close enough to match — showing the store''s bestsellers'"

RECO_CTES = {
    "product_stats": EXTRA["product_stats"],
    "fb": """
  SELECT user_id, product_id, interaction_type FROM fx_interactions
  UNION ALL SELECT user_id, product_id, 'purchase' FROM fx_purchases""",
    "ui": """
  SELECT user_id, product_id, greatest(sum(w), CAST(0.0 AS DOUBLE)) AS w FROM (
    SELECT user_id, product_id,
           CAST(CASE interaction_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0
                WHEN 'add_to_wishlist' THEN 3.0 WHEN 'add_to_cart' THEN 4.0
                WHEN 'purchase' THEN 5.0 WHEN 'remove_from_cart' THEN -2.0
                WHEN 'remove_from_wishlist' THEN -1.0 END AS DOUBLE) AS w
    FROM fb WHERE user_id IS NOT NULL AND product_id IS NOT NULL)
  GROUP BY user_id, product_id HAVING greatest(sum(w), CAST(0.0 AS DOUBLE)) > 0""",
    "norms": "SELECT product_id, sqrt(sum(w * w)) AS norm FROM ui GROUP BY product_id",
    "dots": """
  SELECT a.product_id AS item, b.product_id AS neighbor, sum(a.w * b.w) AS dot
  FROM ui a JOIN ui b ON a.user_id = b.user_id AND a.product_id <> b.product_id
  GROUP BY 1, 2""",
    "sims": """
  SELECT item, neighbor, dot / (ni.norm * nj.norm) AS sim
  FROM dots JOIN norms ni ON ni.product_id = item JOIN norms nj ON nj.product_id = neighbor
  WHERE dot / (ni.norm * nj.norm) > 0""",
    "nbrs": """
  SELECT * FROM (SELECT item, neighbor, sim,
                        row_number() OVER (PARTITION BY item ORDER BY sim DESC, neighbor) AS rank
                 FROM sims) WHERE rank <= 50""",
    "best": """
  SELECT product_id, n_purchases, n_view,
         row_number() OVER (ORDER BY n_purchases DESC, n_view DESC, product_id) AS rank
  FROM product_stats ORDER BY n_purchases DESC, n_view DESC, product_id LIMIT 50""",
    "scored": """
  SELECT ui.user_id, n.neighbor AS rec_id, sum(CAST(floor(ui.w * n.sim * 1e9) AS HUGEINT) * 1000000000
             + CAST(floor((ui.w * n.sim * 1e9 - floor(ui.w * n.sim * 1e9)) * 1e9 + 0.5) AS HUGEINT)) AS score,
         first(ui.product_id ORDER BY ui.w * n.sim DESC, ui.product_id) AS seed_id
  FROM ui JOIN nbrs n ON n.item = ui.product_id GROUP BY 1, 2""",
    "cand": """
  SELECT s.* FROM scored s
  WHERE s.score > 0 AND NOT EXISTS (SELECT 1 FROM ui WHERE ui.user_id = s.user_id
                                                      AND ui.product_id = s.rec_id)""",
}


def reco_sql(n: int, users_sql: str) -> dict[str, str]:
    """CTEs producing ``recs`` (top-n per user of ``users_sql``) like recommend_all."""
    return {
        "rusers": users_sql,
        "cf": f"""
  SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.user_id
                                                ORDER BY c.score DESC, c.rec_id) AS rank
                 FROM cand c WHERE c.user_id IN (SELECT user_id FROM rusers))
  WHERE rank <= {n}""",
        "fbu": f"""
  SELECT u.user_id,
         CASE WHEN u.user_id IN (SELECT user_id FROM ui) THEN {REASON_NO_MATCH}
              ELSE {REASON_NEW} END AS reason
  FROM rusers u WHERE u.user_id NOT IN (SELECT user_id FROM cf)""",
        "recs": f"""
  SELECT r.user_id, r.rank, r.product_id, r.score, r.cold_start, r.strategy, r.reason,
         r.seed_id, p.product_name, p.category, p.brand, p.price
  FROM (SELECT cf.user_id, cf.rank, cf.rec_id AS product_id,
               round(CAST(cf.score AS DOUBLE) / 1e18, 9) AS score,
               false AS cold_start, 'item_based_cf' AS strategy, {REASON_CF} AS reason,
               cf.seed_id
        FROM cf LEFT JOIN fx_products sp ON sp.product_id = cf.seed_id
        UNION ALL
        SELECT f.user_id, b.rank, b.product_id, 0.0, true, 'popularity_fallback',
               f.reason, CAST(NULL AS BIGINT)
        FROM fbu f JOIN best b ON b.rank <= {n}) r
  LEFT JOIN fx_products p ON p.product_id = r.product_id""",
    }


def q(body: str, extra: dict | None = None) -> str:
    ctes = dict(RECO_CTES)
    ctes.update(extra or {})
    return with_fixtures(body, ctes)


SAMPLE = """
  SELECT user_id FROM (SELECT DISTINCT user_id FROM ui)
  ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 500"""

ORACLE = {
    "feedback_events": q("SELECT * FROM fb"),
    "user_item_weights": q("SELECT * FROM ui"),
    "item_norms": q("SELECT * FROM norms"),
    "item_cooccurrence": q("SELECT * FROM dots"),
    "item_similarity": q("SELECT * FROM sims"),
    "top_neighbors": q("SELECT item, neighbor, sim, rank FROM nbrs"),
    "bestsellers": q("SELECT * FROM best"),
    "score_candidates": q("SELECT user_id, rec_id, round(CAST(score AS DOUBLE) / 1e18, 9) AS score FROM cand"),
    "recommendations": q("SELECT * FROM recs",
                         reco_sql(5, "SELECT user_id FROM fx_users")),
    "user_history": q("""
SELECT h.user_id, h.rank, h.product_id, h.w AS weight, p.product_name, p.category
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, product_id) AS rank
      FROM ui) h
LEFT JOIN fx_products p USING (product_id) WHERE h.rank <= 5"""),
    "matrix_density": q("""
SELECT (SELECT count(DISTINCT user_id) FROM ui) AS n_users,
       (SELECT count(*) FROM fx_products) AS n_items,
       (SELECT count(*) FROM ui) AS nnz,
       CAST((SELECT count(*) FROM ui) AS DOUBLE)
         / CAST((SELECT count(DISTINCT user_id) FROM ui) * (SELECT count(*) FROM fx_products)
                AS DOUBLE) AS density"""),
    "catalog_coverage": q("""
SELECT count(DISTINCT r.product_id) AS catalog_reachable,
       (SELECT count(*) FROM fx_products) AS n_items,
       CAST(count(DISTINCT r.product_id) AS DOUBLE)
         / CAST((SELECT count(*) FROM fx_products) AS DOUBLE) AS catalog_share,
       (SELECT count(*) FROM rusers) AS sample_size,
       count(DISTINCT r.user_id) AS users_served
FROM recs r""", reco_sql(10, SAMPLE)),
}
