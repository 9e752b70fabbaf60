"""DuckDB twins of ``basketlab.sources.fixtures``: the six shop tables as CTEs over
the driver's pre-registered views. Oracle SQL strings are ``with_fixtures(body)``.
"""
from __future__ import annotations

FIXTURE_CTES = {
    "fx_events": """
  SELECT event_id, user_id, event_type, value,
         date_trunc('second', ts) AS ts,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id
  FROM events""",
    "fx_users": """
  SELECT c_custkey AS user_id,
         CAST(18 + c_custkey % 53 AS BIGINT) AS age,
         trim(c_mktsegment) AS preferred_category,
         CASE c_custkey % 4 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver'
              WHEN 2 THEN 'gold' ELSE 'platinum' END AS loyalty_tier,
         CASE c_nationkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium'
              WHEN 2 THEN 'high' ELSE 'very_high' END AS income_level,
         CAST(DATE '2023-01-01' + CAST(c_custkey % 365 AS INTEGER) AS TIMESTAMP) AS signup_date
  FROM customer""",
    "fx_interactions": """
  SELECT event_id AS interaction_id, user_id, k AS product_id, session_id,
         CASE WHEN event_type IN ('view', 'click') THEN event_type
              WHEN event_type = 'signup' AND k % 2 = 0 THEN 'add_to_cart'
              WHEN event_type = 'signup' THEN 'add_to_wishlist'
              WHEN event_type = 'error' AND k % 2 = 0 THEN 'remove_from_cart'
              WHEN event_type = 'error' THEN 'remove_from_wishlist'
              ELSE trim(event_type) END AS interaction_type,
         ts AS "timestamp",
         CAST(least(greatest(round(value * 1000), 500), 300000) AS BIGINT) AS dwell_time_ms
  FROM fx_events WHERE event_type <> 'purchase'""",
    "fx_purchases": """
  SELECT event_id AS purchase_id, session_id AS order_id, user_id, k AS product_id,
         session_id, event_id AS interaction_id,
         CAST(1 + k % 3 AS BIGINT) AS quantity, value AS total_amount, ts AS order_date
  FROM fx_events WHERE event_type = 'purchase'""",
    "fx_sessions": """
  SELECT session_id, user_id, min(ts) AS start_time,
         CASE min(event_id) % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile'
              ELSE 'tablet' END AS device_type,
         CASE min(event_id) % 7 WHEN 0 THEN 'direct' WHEN 1 THEN 'organic_search'
              WHEN 2 THEN 'paid_search' WHEN 3 THEN 'email' WHEN 4 THEN 'social'
              WHEN 5 THEN 'referral' ELSE 'display_ad' END AS referrer_source,
         CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS is_converted
  FROM fx_events GROUP BY session_id, user_id""",
    "fx_reviews": """
  SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS review_id,
         o_custkey AS user_id, l_partkey AS product_id,
         CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_orderkey END AS purchase_id,
         CAST(1 + CAST(l_quantity AS BIGINT) % 5 AS BIGINT) AS rating,
         date_trunc('second', l_shipdate) AS review_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_products": """
  SELECT p_partkey AS product_id, p_name AS product_name, trim(p_type) AS category,
         trim(p_brand) AS brand, p_retailprice AS price,
         CASE WHEN p_partkey % 2 = 0 THEN r.rating_avg END AS rating_avg,
         CAST(CASE WHEN p_partkey % 2 = 0 THEN coalesce(r.review_count, 0) ELSE 0 END AS BIGINT) AS review_count,
         CAST(p_size AS BIGINT) AS stock_quantity
  FROM part LEFT JOIN (SELECT product_id, avg(rating) AS rating_avg,
                              count(*) AS review_count
                       FROM fx_reviews GROUP BY product_id) r
    ON p_partkey = r.product_id""",
}


def with_fixtures(body: str, extra_ctes: dict[str, str] | None = None) -> str:
    ctes = dict(FIXTURE_CTES)
    ctes.update(extra_ctes or {})
    parts = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in ctes.items())
    return f"WITH {parts}\n{body}"
