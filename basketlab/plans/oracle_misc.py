"""DuckDB oracle SQL for the source round trip and the scalar-function themes."""
from __future__ import annotations

from basketlab.plans.fixtures_sql import with_fixtures

DATE_OF = {"users": "signup_date", "sessions": "start_time", "interactions": "timestamp",
           "purchases": "order_date", "reviews": "review_date"}

ORACLE = {
    "csv_roundtrip": with_fixtures("\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS \"rows\", min(\"{c}\") AS first_ts, "
        f"max(\"{c}\") AS last_ts FROM fx_{t}" for t, c in DATE_OF.items())
        + "\nUNION ALL SELECT 'products', count(*), NULL, NULL FROM fx_products"),
    "text_functions": with_fixtures("""
SELECT product_id, substring(split_part(product_name, chr(10), 1), 1, 180) AS blurb,
       substring(product_name, 1, 6) AS name_6, substring(product_name, 1, 22) AS name_22,
       substring(product_name, 1, 34) AS name_34, regexp_replace(chr(32) || chr(9) || brand || chr(10) || chr(32),
                                                     '^[[:space:]]+|[[:space:]]+$', '', 'g') AS brand_key
FROM fx_products"""),
    "document_text_functions": """
SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 180) AS blurb,
       substring(text, 1, 400) AS review_text FROM documents""",
    "csv_free_text": """
SELECT doc_id AS product_id, source AS category,
       substring(split_part(text, chr(10), 1), 1, 180) AS blurb,
       substring(text, 1, 400) AS review_text FROM documents""",
    "time_functions": with_fixtures("""
SELECT s.session_id, date_trunc('second', s.start_time) AS parsed,
       strftime(s.start_time, '%Y-%m') AS month,
       CAST(hour(s.start_time) AS BIGINT) AS hour,
       CAST(isodow(s.start_time) - 1 AS BIGINT) AS dow,
       CAST(CASE WHEN isodow(s.start_time) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS weekend,
       CAST(epoch(s.start_time) - epoch(u.signup_date) AS DOUBLE) AS secs_since_signup,
       CAST(floor((epoch(s.start_time) - epoch(u.signup_date)) / 86400) AS BIGINT)
         AS tenure_days
FROM fx_sessions s LEFT JOIN fx_users u USING (user_id)"""),
    "numeric_functions": with_fixtures("""
SELECT interaction_id, w AS weight, greatest(w, CAST(0.0 AS DOUBLE)) AS weight_clipped,
       coalesce(TRY_CAST(interaction_type AS DOUBLE), 0.0) AS type_as_number,
       CAST(least(greatest(floor(dwell_time_ms / 60000), 0), 4) AS BIGINT) AS dwell_bucket,
       CAST(dwell_time_ms AS DOUBLE) / CAST(nullif(dwell_time_ms - 500, 0) AS DOUBLE)
         AS dwell_ratio
FROM (SELECT *, CAST(CASE interaction_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0
                     WHEN 'add_to_wishlist' THEN 3.0 WHEN 'add_to_cart' THEN 4.0
                     WHEN 'purchase' THEN 5.0 WHEN 'remove_from_cart' THEN -2.0
                     WHEN 'remove_from_wishlist' THEN -1.0 END AS DOUBLE) AS w
      FROM fx_interactions)"""),
    "review_functions": with_fixtures("""
SELECT user_id, product_id, purchase_id, rating,
       CAST(purchase_id IS NOT NULL AS BIGINT) AS is_verified,
       CAST(rating >= 4 AS BIGINT) AS is_positive, rating - 3 AS rating_vs_mid,
       round(coalesce(rating / 5.0, 0.0) * 100, 1) AS rating_pct, 'purchase' AS tag
FROM fx_reviews"""),
}
