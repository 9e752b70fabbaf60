"""DuckDB oracle SQL for the SQL-expressible parts of the conversion job."""
from __future__ import annotations

from basketlab.plans.oracle_aggregates import q as agg_q

# Stated here again, so that a wrong value in the operator shows.
NUMERIC = [
    "n_interactions", "n_products", "n_view", "n_click", "n_add_to_cart", "n_remove_from_cart",
    "n_add_to_wishlist", "n_remove_from_wishlist", "net_cart", "net_wishlist",
    "total_dwell_ms", "mean_dwell_ms", "max_dwell_ms", "duration_s", "hour", "day_of_week",
    "is_weekend", "prior_sessions", "is_returning", "tenure_days", "age",
]
CATEGORICAL = [
    "device_type", "referrer_source", "loyalty_tier", "income_level",
]
DEFAULTS = {
    "n_interactions": 5,
    "n_products": 3,
    "n_view": 3,
    "n_click": 1,
    "n_add_to_cart": 0,
    "n_remove_from_cart": 0,
    "n_add_to_wishlist": 0,
    "n_remove_from_wishlist": 0,
    "net_cart": 0,
    "net_wishlist": 0,
    "total_dwell_ms": 60000,
    "mean_dwell_ms": 12000,
    "max_dwell_ms": 30000,
    "duration_s": 300,
    "hour": 14,
    "day_of_week": 2,
    "is_weekend": 0,
    "prior_sessions": 0,
    "is_returning": 0,
    "tenure_days": 180,
    "age": 35,
    "device_type": "desktop",
    "referrer_source": "organic_search",
    "loyalty_tier": "bronze",
    "income_level": "medium",
}
FEATURE_LABELS = {
    "net_cart": "Items still in cart",
    "n_add_to_cart": "Times added to cart",
    "n_remove_from_cart": "Times removed from cart",
    "n_add_to_wishlist": "Items saved to wishlist",
    "n_remove_from_wishlist": "Items removed from wishlist",
    "net_wishlist": "Items still on wishlist",
    "n_view": "Products viewed",
    "n_click": "Products clicked",
    "n_products": "Different products seen",
    "n_interactions": "Total actions taken",
    "total_dwell_ms": "Total time on products",
    "mean_dwell_ms": "Average time per product",
    "max_dwell_ms": "Longest time on one product",
    "duration_s": "Visit length",
    "hour": "Time of day",
    "day_of_week": "Day of week",
    "is_weekend": "Weekend visit",
    "prior_sessions": "Previous visits",
    "is_returning": "Returning shopper",
    "tenure_days": "Days since signing up",
    "age": "Shopper age",
}
PREFIX_LABELS = {
    "device_type": "Device",
    "referrer_source": "Came from",
    "loyalty_tier": "Loyalty tier",
    "income_level": "Income bracket",
}

REQUEST_FIELDS = ["n_view", "n_click", "n_add_to_cart", "n_remove_from_cart",
                  "n_add_to_wishlist", "n_remove_from_wishlist", "n_products",
                  "mean_dwell_ms", "max_dwell_ms", "duration_s", "hour", "day_of_week",
                  "prior_sessions", "tenure_days", "age", "device_type", "referrer_source",
                  "loyalty_tier", "income_level"]

SPLIT = """
, mi AS (SELECT session_id, CAST(is_converted AS DOUBLE) AS label,
                row_number() OVER (PARTITION BY is_converted ORDER BY md5(session_id))
                  <= round(count(*) OVER (PARTITION BY is_converted) * 0.25) AS is_test
         FROM session_features)"""


def _lit(v):
    return f"'{v}'" if isinstance(v, str) else str(v)


def _repaired() -> str:
    filled = ", ".join(f"coalesce({c}, {_lit(DEFAULTS[c])}) AS {c}" for c in REQUEST_FIELDS)
    adds = "n_view + n_click + n_add_to_cart + n_add_to_wishlist"
    return f"""
, req AS (SELECT session_id, {filled} FROM session_features)
SELECT session_id, {", ".join(REQUEST_FIELDS)},
       n_add_to_cart - n_remove_from_cart AS net_cart,
       n_add_to_wishlist - n_remove_from_wishlist AS net_wishlist,
       CAST(day_of_week >= 5 AS BIGINT) AS is_weekend,
       CAST(prior_sessions > 0 AS BIGINT) AS is_returning,
       greatest(5, {adds}) AS n_interactions,
       mean_dwell_ms * greatest(greatest(5, {adds}), 1) AS total_dwell_ms
FROM req"""


def _labels() -> str:
    known = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items())
    pref = " ".join(
        f"WHEN starts_with(feature, '{p}_') THEN '{lab}: ' || "
        f"replace(substr(feature, {len(p) + 2}), '_', ' ')" for p, lab in PREFIX_LABELS.items())
    onehot = " UNION ALL ".join(
        f"SELECT '{c}_' || {c} AS feature FROM session_features WHERE {c} IS NOT NULL"
        for c in CATEGORICAL)
    numeric = " UNION ALL ".join(f"SELECT '{c}'" for c in NUMERIC)
    return f"""
SELECT feature, CASE feature {known} ELSE CASE {pref} ELSE replace(feature, '_', ' ') END END
         AS label
FROM (SELECT DISTINCT feature FROM ({onehot} UNION ALL {numeric}))"""


ORACLE = {
    "unlabelled_sessions": agg_q("""
SELECT count(*) FILTER (WHERE is_converted IS NULL) AS no_label,
       count(*) FILTER (WHERE session_id IS NULL) AS no_id, count(*) AS sessions
FROM session_features""", "session_features"),
    "conversion_split": agg_q(SPLIT + """
SELECT is_test, label, count(*) AS n FROM mi GROUP BY is_test, label""", "session_features"),
    "class_weights": agg_q(SPLIT + """
, c AS (SELECT label, count(*) AS n_class FROM mi WHERE NOT is_test GROUP BY label)
SELECT label, n_class, CAST((SELECT sum(n_class) FROM c) AS DOUBLE) / (2.0 * n_class) AS weight
FROM c""", "session_features"),
    "repaired_features": agg_q(_repaired(), "session_features"),
    "feature_row_validation": agg_q("""
SELECT CASE WHEN coalesce(n_view, 0) >= 0 AND coalesce(n_click, 0) >= 0
             AND coalesce(n_add_to_cart, 0) >= 0 AND coalesce(n_remove_from_cart, 0) >= 0
             AND coalesce(n_add_to_wishlist, 0) >= 0 AND coalesce(n_remove_from_wishlist, 0) >= 0
             AND coalesce(n_products, 0) >= 0 AND coalesce(mean_dwell_ms, 0) >= 0
             AND coalesce(max_dwell_ms, 0) >= 0 AND coalesce(duration_s, 0) >= 0
             AND coalesce(hour, 0) BETWEEN 0 AND 23 AND coalesce(day_of_week, 0) BETWEEN 0 AND 6
             AND coalesce(prior_sessions, 0) >= 0 AND coalesce(tenure_days, 0) >= 0
             AND coalesce(age, 0) >= 0 THEN 'valid' ELSE 'rejected' END AS status,
       count(*) AS n
FROM session_features GROUP BY 1""", "session_features"),
    "feature_labels": agg_q(_labels(), "session_features"),
}
