"""DuckDB oracle SQL for user features and the label-driven segmentation operators."""
from __future__ import annotations

from basketlab.plans.fixtures_sql import with_fixtures

FEATURES = ["n_views", "n_clicks", "n_cart_adds", "n_wishlist_adds", "n_purchases",
            "total_spend", "avg_order_value", "n_reviews", "avg_rating_given",
            "category_diversity", "n_sessions", "conversion_rate"]
COUNTS = ["n_views", "n_clicks", "n_cart_adds", "n_wishlist_adds", "n_purchases",
          "n_reviews", "category_diversity", "n_sessions"]

SEG_CTES = {
    "ip": """
  SELECT i.user_id,
         count(*) FILTER (WHERE interaction_type = 'view') AS n_views,
         count(*) FILTER (WHERE interaction_type = 'click') AS n_clicks,
         count(*) FILTER (WHERE interaction_type = 'add_to_cart') AS n_cart_adds,
         count(*) FILTER (WHERE interaction_type = 'add_to_wishlist') AS n_wishlist_adds,
         count(DISTINCT p.category) AS category_diversity
  FROM fx_interactions i LEFT JOIN fx_products p USING (product_id)
  WHERE i.user_id IS NOT NULL GROUP BY i.user_id""",
    "pp": """
  SELECT user_id, count(*) AS n_purchases,
         CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
  FROM fx_purchases WHERE user_id IS NOT NULL GROUP BY user_id""",
    "ao": """
  SELECT user_id, CAST(sum(t) AS DOUBLE) / CAST(count(t) AS DOUBLE) AS avg_order_value
  FROM (SELECT user_id, order_id, sum(CAST(total_amount AS DECIMAL(18,2))) AS t
        FROM fx_purchases GROUP BY user_id, order_id)
  WHERE user_id IS NOT NULL GROUP BY user_id""",
    "rv": """
  SELECT user_id, count(*) AS n_reviews, avg(rating) AS avg_rating_given
  FROM fx_reviews WHERE user_id IS NOT NULL GROUP BY user_id""",
    "ss": """
  SELECT user_id, count(*) AS n_sessions, avg(is_converted) AS conversion_rate
  FROM fx_sessions WHERE user_id IS NOT NULL GROUP BY user_id""",
    "uf_raw": """
  SELECT u.user_id, ip.n_views, ip.n_clicks, ip.n_cart_adds, ip.n_wishlist_adds,
         pp.n_purchases, pp.total_spend, ao.avg_order_value, rv.n_reviews,
         rv.avg_rating_given, ip.category_diversity, ss.n_sessions, ss.conversion_rate
  FROM fx_users u LEFT JOIN ip USING (user_id) LEFT JOIN pp USING (user_id)
  LEFT JOIN ao USING (user_id) LEFT JOIN rv USING (user_id) LEFT JOIN ss USING (user_id)""",
    "uf": "SELECT user_id, "
          + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in COUNTS) + ", "
          + ", ".join(f"coalesce({c}, 0.0) AS {c}"
                      for c in ["total_spend", "avg_order_value", "conversion_rate"])
          + ", round(coalesce(avg_rating_given, (SELECT avg(avg_rating_given) FROM uf_raw),"
            " 0.0), 9) AS avg_rating_given FROM uf_raw",
    "tiers": """
  SELECT user_id, CAST(CASE loyalty_tier WHEN 'bronze' THEN 0 WHEN 'silver' THEN 1
                            WHEN 'gold' THEN 2 WHEN 'platinum' THEN 3 END AS BIGINT) AS cluster
  FROM fx_users""",
}


def q(body: str, extra: dict | None = None) -> str:
    ctes = dict(SEG_CTES)
    ctes.update(extra or {})
    return with_fixtures(body, ctes)


def _profile_sql() -> str:
    means = ", ".join(f"round(avg(f.{c}), 9) AS {c}" for c in FEATURES)
    overall = ", ".join(f"round(avg({c}), 9) AS o_{c}" for c in FEATURES)
    return {
        "prof": f"""
  SELECT t.cluster, {means}, count(*) AS size
  FROM uf f JOIN tiers t USING (user_id) GROUP BY t.cluster""",
        "ov": f"SELECT {overall} FROM uf",
        "named": """
  SELECT p.*, CASE
      WHEN p.n_sessions = 0 AND p.n_views = 0 THEN 'Dormant Signups'
      WHEN p.n_purchases >= o.o_n_purchases * 2 AND p.avg_order_value >= o.o_avg_order_value
        THEN 'High-Value Buyers'
      WHEN p.n_purchases >= o.o_n_purchases THEN 'Converting Regulars'
      WHEN p.n_views >= o.o_n_views * 1.4 AND p.n_purchases < o.o_n_purchases
        THEN 'Heavy Browsers'
      WHEN p.n_wishlist_adds >= o.o_n_wishlist_adds * 1.3 THEN 'Wishlist Collectors'
      WHEN p.n_views < o.o_n_views * 0.6 THEN 'Low-Touch Visitors'
      ELSE 'Casual Shoppers' END AS base_name,
    CAST(p.size AS DOUBLE) / CAST(sum(p.size) OVER () AS DOUBLE) AS share
  FROM prof p, ov o""",
    }


DESCRIPTIONS = """CASE base_name
  WHEN 'Dormant Signups' THEN 'Registered but never browsed — zero sessions, zero interactions'
  WHEN 'High-Value Buyers' THEN 'Convert often at above-average order values — the revenue core'
  WHEN 'Converting Regulars' THEN 'Buy steadily at typical basket sizes'
  WHEN 'Heavy Browsers' THEN 'High engagement, little conversion — the biggest untapped upside'
  WHEN 'Wishlist Collectors' THEN 'Save intent heavily but rarely check out'
  WHEN 'Low-Touch Visitors' THEN 'Brief, shallow sessions with minimal engagement'
  ELSE 'Moderate browsing, occasional purchase' END"""


def _silhouette_sql() -> dict:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END AS z_{c}"
                  for c in FEATURES)
    dist = " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in FEATURES)
    return {
        "zst": f"SELECT {stats} FROM uf",
        "z": f"SELECT uf.user_id, t.cluster, {z} FROM uf JOIN tiers t USING (user_id), zst",
        "smp": "SELECT * FROM z ORDER BY md5(CAST(user_id AS VARCHAR)), user_id LIMIT 5000",
        "csize": "SELECT cluster, count(*) AS n FROM smp GROUP BY cluster",
        "pd": f"""
  SELECT a.user_id, a.cluster AS own, b.cluster AS other, sum(sqrt({dist})) AS dsum
  FROM smp a JOIN smp b ON a.user_id <> b.user_id GROUP BY 1, 2, 3""",
        "pa": """
  SELECT s.user_id, s.cluster AS own, c.n AS n_own,
         coalesce((SELECT dsum FROM pd WHERE pd.user_id = s.user_id AND pd.other = s.cluster),
                  0.0) / greatest(c.n - 1, 1) AS a,
         (SELECT min(pd.dsum / c2.n) FROM pd JOIN csize c2 ON c2.cluster = pd.other
          WHERE pd.user_id = s.user_id AND pd.other <> s.cluster) AS b
  FROM smp s JOIN csize c ON c.cluster = s.cluster""",
    }


ORACLE = {
    "user_features": q("SELECT user_id, " + ", ".join(FEATURES) + " FROM uf"),
    "profile_by_loyalty_tier": q(f"""
SELECT cluster,
       base_name || repeat(' II', CAST(row_number() OVER (PARTITION BY base_name
                                                          ORDER BY cluster) - 1 AS INTEGER))
         AS name,
       {DESCRIPTIONS} AS description, size, share, {", ".join(FEATURES)}
FROM named""", _profile_sql()),
    "silhouette_by_tier": q("""
SELECT round(avg(CASE WHEN n_own > 1 AND b IS NOT NULL AND greatest(a, b) > 0
                      THEN (b - a) / greatest(a, b) ELSE 0.0 END), 6) AS silhouette,
       count(*) AS n
FROM pa""", _silhouette_sql()),
}
