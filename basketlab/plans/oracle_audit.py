"""DuckDB oracle SQL for the audit jobs and the result sets."""
from __future__ import annotations

from basketlab.plans.fixtures_sql import with_fixtures
from basketlab.plans.oracle_aggregates import EXTRA

MIN_VIEWS = 15

# Spark type names of the six views (fixed by the view mapping).
SCHEMAS = {
    "users": [("user_id", "bigint"), ("age", "bigint"), ("preferred_category", "string"),
              ("loyalty_tier", "string"), ("income_level", "string"),
              ("signup_date", "timestamp")],
    "products": [("product_id", "bigint"), ("product_name", "string"),
                 ("category", "string"), ("brand", "string"), ("price", "double"),
                 ("rating_avg", "double"), ("review_count", "bigint"),
                 ("stock_quantity", "bigint")],
    "sessions": [("session_id", "string"), ("user_id", "bigint"),
                 ("start_time", "timestamp"), ("device_type", "string"),
                 ("referrer_source", "string"), ("is_converted", "bigint")],
    "interactions": [("interaction_id", "bigint"), ("user_id", "bigint"),
                     ("product_id", "bigint"), ("session_id", "string"),
                     ("interaction_type", "string"), ("timestamp", "timestamp"),
                     ("dwell_time_ms", "bigint")],
    "purchases": [("purchase_id", "bigint"), ("order_id", "string"), ("user_id", "bigint"),
                  ("product_id", "bigint"), ("session_id", "string"),
                  ("interaction_id", "bigint"), ("quantity", "bigint"),
                  ("total_amount", "double"), ("order_date", "timestamp")],
    "reviews": [("review_id", "bigint"), ("user_id", "bigint"), ("product_id", "bigint"),
                ("purchase_id", "bigint"), ("rating", "bigint"),
                ("review_date", "timestamp")],
}

# The eleven foreign-key edges of the shop schema.
FK_EDGES = [
    ("sessions", "user_id", "users", "user_id"),
    ("interactions", "user_id", "users", "user_id"),
    ("interactions", "session_id", "sessions", "session_id"),
    ("interactions", "product_id", "products", "product_id"),
    ("purchases", "user_id", "users", "user_id"),
    ("purchases", "session_id", "sessions", "session_id"),
    ("purchases", "product_id", "products", "product_id"),
    ("purchases", "interaction_id", "interactions", "interaction_id"),
    ("reviews", "user_id", "users", "user_id"),
    ("reviews", "product_id", "products", "product_id"),
    ("reviews", "purchase_id", "purchases", "purchase_id"),
]


def q(body: str, *needs: str) -> str:
    extra = {}
    want = set(needs)
    if "category_stats" in want or "overview_row" in want:
        want.add("product_stats")
    for name in ["product_stats", "category_stats"]:
        if name in want:
            extra[name] = EXTRA[name]
    if "overview_row" in want:
        extra["overview_row"] = OVERVIEW
    return with_fixtures(body, extra)


OVERVIEW = """
  SELECT (SELECT count(*) FROM fx_users) AS total_users,
         (SELECT count(*) FROM fx_products) AS total_products,
         (SELECT count(*) FROM fx_sessions) AS total_sessions,
         (SELECT count(*) FROM fx_interactions) AS total_interactions,
         (SELECT count(*) FROM fx_purchases) AS total_purchases,
         (SELECT avg(is_converted) FROM fx_sessions) AS conversion_rate,
         (SELECT CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) FROM fx_purchases)
           AS total_revenue,
         (SELECT CAST(sum(t) AS DOUBLE) / CAST(count(t) AS DOUBLE) FROM
            (SELECT sum(CAST(total_amount AS DECIMAL(18,2))) AS t FROM fx_purchases
             GROUP BY order_id)) AS avg_order_value,
         (SELECT avg(rating) FROM fx_reviews) AS avg_rating,
         (SELECT count(rating_avg) FROM fx_products) AS rated_products"""


def _null_profile() -> str:
    parts = []
    for t, cols in SCHEMAS.items():
        for c, typ in cols:
            parts.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{typ}' AS dtype, "
                f"count(*) FILTER (WHERE \"{c}\" IS NULL) AS nulls, count(*) AS \"rows\" "
                f"FROM fx_{t}")
    return "\nUNION ALL ".join(parts)


def _fk_orphans() -> str:
    parts = []
    for child, ck, parent, pk in FK_EDGES:
        parts.append(
            f"SELECT '{child}' AS child, '{ck}' AS child_key, '{parent}' AS parent, "
            f"'{pk}' AS parent_key, count(*) AS orphans FROM "
            f"(SELECT DISTINCT {ck} AS k FROM fx_{child} WHERE {ck} IS NOT NULL) c "
            f"WHERE NOT EXISTS (SELECT 1 FROM fx_{parent} p WHERE p.{pk} = c.k)")
    return "\nUNION ALL ".join(parts)


def _spread(key: str, level: str) -> str:
    return f"""
SELECT '{level}' AS level, avg(n) AS mean, CAST(median(n) AS DOUBLE) AS median,
       CAST(max(n) AS BIGINT) AS max, round(stddev_samp(n), 6) AS std
FROM (SELECT {key}, count(*) AS n FROM fx_interactions WHERE {key} IS NOT NULL
      GROUP BY {key})"""


KPIS = [
    ("Shoppers", "total_users", "signed up"),
    ("Products", "total_products", "in the catalog"),
    ("Store visits", "total_sessions", "in the last year"),
    ("Shopper actions", "total_interactions", "views, clicks, cart adds"),
    ("Items bought", "total_purchases", "across all orders"),
    ("Visits that buy", "conversion_rate", "of all store visits"),
    ("Average order", "avg_order_value", "spent per order"),
    ("Average rating", "avg_rating", "out of 5 stars"),
]


def _kpis() -> str:
    parts = []
    for i, (label, col, sub) in enumerate(KPIS, start=1):
        v = f"CAST({col} AS DOUBLE)" + (" * 100" if col == "conversion_rate" else "")
        parts.append(f"SELECT {i} AS position, '{label}' AS label, round({v}, 2) AS value, "
                     f"'{sub}' AS sub FROM overview_row")
    return "\nUNION ALL ".join(parts)


CATALOG = """
SELECT product_id, product_name, category, brand, price, rating_avg, review_count, n_view,
       n_purchases, revenue, view_to_purchase
FROM product_stats {where} ORDER BY revenue DESC, n_view DESC, product_id LIMIT {limit}"""

LEAKY = f"""
SELECT product_id, product_name, category, n_view, n_purchases, view_to_purchase
FROM product_stats WHERE n_view >= {{mv}} AND view_to_purchase IS NOT NULL
ORDER BY view_to_purchase, product_id LIMIT {{n}}"""

ORACLE = {
    "null_profile": q(_null_profile()),
    "event_vocabulary": q("""
SELECT interaction_type, count(*) AS n FROM fx_interactions
WHERE interaction_type IS NOT NULL GROUP BY interaction_type"""),
    "base_rate": q("""
SELECT avg(is_converted) AS base_rate, CAST(sum(is_converted) AS BIGINT) AS positives,
       count(*) AS sessions FROM fx_sessions"""),
    "conversion_by_cart_bucket": q("""
SELECT least(greatest(coalesce(c.carts, 0), 0), 4) AS carts, avg(s.is_converted) AS rate,
       count(*) AS n
FROM fx_sessions s LEFT JOIN (SELECT session_id, count(*) AS carts FROM fx_interactions
                              WHERE interaction_type = 'add_to_cart' GROUP BY session_id) c
  USING (session_id)
GROUP BY 1"""),
    "conversion_by_channel": q("""
SELECT 'device_type' AS feature, device_type AS value, avg(is_converted) AS rate,
       count(*) AS n FROM fx_sessions WHERE device_type IS NOT NULL GROUP BY device_type
UNION ALL
SELECT 'referrer_source', referrer_source, avg(is_converted), count(*) FROM fx_sessions
WHERE referrer_source IS NOT NULL GROUP BY referrer_source"""),
    "dwell_by_outcome": q("""
SELECT s.is_converted, round(avg(d.dwell), 6) AS mean_dwell_ms
FROM fx_sessions s LEFT JOIN (SELECT session_id, avg(dwell_time_ms) AS dwell
                              FROM fx_interactions GROUP BY session_id) d USING (session_id)
GROUP BY s.is_converted"""),
    "event_spread": q(_spread("session_id", "per session") + "\nUNION ALL"
                      + _spread("user_id", "per user") + "\nUNION ALL"
                      + _spread("product_id", "per product")),
    "coverage": q("""
SELECT (SELECT count(DISTINCT product_id) FROM fx_interactions) AS products_with_events,
       (SELECT count(*) FROM fx_products) AS products_total,
       (SELECT count(DISTINCT user_id) FROM fx_interactions) AS users_with_events,
       (SELECT count(*) FROM fx_users) AS users_total,
       1.0 - CAST((SELECT count(DISTINCT user_id) FROM fx_interactions) AS DOUBLE)
             / CAST((SELECT count(*) FROM fx_users) AS DOUBLE) AS cold_share"""),
    "engagement_by_outcome": q("""
SELECT s.is_converted, count(*) AS sessions, avg(coalesce(p.events, 0)) AS mean_events,
       avg(CASE WHEN coalesce(p.clicks, 0) > 0 THEN 1 ELSE 0 END) AS share_with_click
FROM fx_sessions s
LEFT JOIN (SELECT session_id, count(*) AS events,
                  count(*) FILTER (WHERE interaction_type = 'click') AS clicks
           FROM fx_interactions GROUP BY session_id) p USING (session_id)
GROUP BY s.is_converted"""),
    "column_ranges": q("""
SELECT (SELECT min(price) FROM fx_products) AS price_min,
       (SELECT CAST(median(price) AS DOUBLE) FROM fx_products) AS price_median,
       (SELECT max(price) FROM fx_products) AS price_max,
       (SELECT count(DISTINCT brand) FROM fx_products) AS brands,
       (SELECT count(DISTINCT category) FROM fx_products) AS categories,
       (SELECT count(DISTINCT referrer_source) FROM fx_sessions) AS referrers,
       (SELECT min(start_time) FROM fx_sessions) AS first_session,
       (SELECT max(start_time) FROM fx_sessions) AS last_session,
       (SELECT min("timestamp") FROM fx_interactions) AS first_event,
       (SELECT max("timestamp") FROM fx_interactions) AS last_event,
       (SELECT min(dwell_time_ms) FROM fx_interactions) AS dwell_min,
       (SELECT max(dwell_time_ms) FROM fx_interactions) AS dwell_max,
       (SELECT min(age) FROM fx_users) AS age_min, (SELECT max(age) FROM fx_users) AS age_max,
       (SELECT min(order_date) FROM fx_purchases) AS first_order,
       (SELECT max(order_date) FROM fx_purchases) AS last_order,
       (SELECT min(rating) FROM fx_reviews) AS rating_min,
       (SELECT max(rating) FROM fx_reviews) AS rating_max,
       (SELECT min(review_date) FROM fx_reviews) AS first_review,
       (SELECT max(review_date) FROM fx_reviews) AS last_review"""),
    "fk_orphans": q(_fk_orphans()),
    "leak_check": q("""
SELECT a.n AS purchase_not_converted, b.n AS converted_without_purchase,
       (a.n = 0 AND b.n = 0) AS sets_equal
FROM (SELECT count(*) AS n FROM (SELECT DISTINCT session_id FROM fx_purchases
                                 WHERE session_id IS NOT NULL
                                 EXCEPT SELECT session_id FROM fx_sessions
                                 WHERE is_converted = 1)) a,
     (SELECT count(*) AS n FROM (SELECT DISTINCT session_id FROM fx_sessions
                                 WHERE is_converted = 1
                                 EXCEPT SELECT session_id FROM fx_purchases)) b"""),
    "reconcile_counts": q("\nUNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS src_rows, count(*) AS dst_rows, true AS ok "
        f"FROM fx_{t}" for t in SCHEMAS)),
    # --- result sets ---
    "catalog": q(CATALOG.format(where="", limit=20), "product_stats"),
    "catalog_in_category": q(CATALOG.format(where="WHERE category = 'SMALL'", limit=15),
                             "product_stats"),
    "top_viewed": q("""
SELECT product_id, product_name, category, n_view, n_purchases,
       n_purchases * 20 AS purchases_x20, substring(product_name, 1, 22) AS label
FROM product_stats ORDER BY n_view DESC, product_id LIMIT 12""", "product_stats"),
    "leaky_products": q(LEAKY.format(mv=MIN_VIEWS, n=10), "product_stats"),
    "low_rated": q(f"""
SELECT product_id, product_name, category, rating_avg, review_count, n_view
FROM product_stats
WHERE rating_avg IS NOT NULL AND rating_avg <= 3 AND n_view >= {MIN_VIEWS}
ORDER BY n_view DESC, product_id LIMIT 10""", "product_stats"),
    "funnel_points": q(f"""
SELECT product_id, product_name, n_view, view_to_purchase, revenue,
       least(24.0, 6.0 + coalesce(revenue, 0.0) / 260) AS size,
       coalesce(revenue, 0.0) AS color
FROM product_stats WHERE n_view >= {MIN_VIEWS} AND view_to_purchase IS NOT NULL""",
                       "product_stats"),
    "category_ranking": q("""
SELECT CAST(row_number() OVER (ORDER BY revenue DESC, category) AS BIGINT) AS rank,
       category, round(revenue, 2) AS revenue, views,
       round(coalesce(view_to_purchase, 0.0) * 100, 3) AS conversion_pct,
       category = (SELECT category FROM category_stats ORDER BY revenue DESC, category DESC
                   LIMIT 1) AS is_best_revenue,
       coalesce(category = (SELECT category FROM category_stats
                            WHERE view_to_purchase IS NOT NULL
                            ORDER BY view_to_purchase, category LIMIT 1), false)
         AS is_worst_conversion
FROM category_stats""", "category_stats"),
    "trend": q("""
, sm AS (SELECT CAST(date_trunc('month', start_time) AS DATE) AS month, count(*) AS sessions,
                CAST(sum(is_converted) AS BIGINT) AS conversions
         FROM fx_sessions WHERE start_time IS NOT NULL GROUP BY 1),
pm AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, count(*) AS orders,
              CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
       FROM fx_purchases WHERE order_date IS NOT NULL GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP),
                                             CAST(max(month) AS TIMESTAMP),
                                             INTERVAL 1 MONTH)) AS DATE) AS month
          FROM sm HAVING min(month) IS NOT NULL)
SELECT strftime(spine.month, '%Y-%m') AS month_key,
       CAST(coalesce(sm.sessions, 0) AS BIGINT) AS sessions,
       CAST(coalesce(pm.orders, 0) AS BIGINT) AS orders,
       coalesce(pm.revenue, 0.0) AS revenue,
       round(coalesce(CAST(coalesce(sm.conversions, 0) AS DOUBLE)
         / CAST(nullif(coalesce(sm.sessions, 0), 0) AS DOUBLE), 0.0) * 100, 2) AS conversion_pct
FROM spine LEFT JOIN sm USING (month) LEFT JOIN pm USING (month)"""),
    "rated_products": q("""
SELECT rated_products, total_products, total_products - rated_products AS unrated_products
FROM overview_row""", "overview_row"),
    "kpi_cards": q(_kpis(), "overview_row"),
    "insights": q(f"""
SELECT 1 AS position, 'conversion' AS kind,
       'Overall conversion sits at ' || printf('%.2f%%', conversion_rate * 100) AS headline,
       format('{{:,}}', total_purchases) || ' purchases across ' ||
       format('{{:,}}', total_sessions) || ' sessions, generating $' ||
       format('{{:,.0f}}', total_revenue) || '.' AS detail
FROM overview_row
UNION ALL
SELECT 2, 'category',
       b.category || ' leads revenue at $' || format('{{:,.0f}}', b.revenue),
       'Lowest view-to-purchase category is ' || w.category || ' at ' ||
       printf('%.3f%%', w.view_to_purchase * 100) || '.'
FROM (SELECT category, revenue FROM category_stats
      ORDER BY revenue DESC, category DESC LIMIT 1) b,
     (SELECT category, view_to_purchase FROM category_stats
      WHERE view_to_purchase IS NOT NULL ORDER BY view_to_purchase, category LIMIT 1) w
UNION ALL
SELECT 3, 'funnel_leak', 'High-traffic products converting near zero',
       coalesce(string_agg(product_name || ' (' || format('{{:,}}', n_view) || ' views → ' ||
                           CAST(n_purchases AS VARCHAR) || ' purchases)', '; '
                           ORDER BY view_to_purchase, product_id), '')
FROM ({LEAKY.format(mv=MIN_VIEWS, n=3)})""", "category_stats", "overview_row"),
    "product_view_bars": q(f"""
SELECT *, round(n_view / coalesce(nullif(max(n_view) OVER (), 0), 1) * 100, 1) AS view_bar
FROM ({CATALOG.format(where="", limit=15)})""", "product_stats"),
    "category_shares": q("""
SELECT category, views, revenue,
       round(CAST(views AS DOUBLE) / CAST(sum(views) OVER () AS DOUBLE), 9) AS view_share,
       round(revenue / sum(revenue) OVER (), 9) AS revenue_share
FROM category_stats""", "category_stats"),
    "option_lists": q("""
SELECT DISTINCT * FROM (
  SELECT 'device_type' AS field, device_type AS value FROM fx_sessions
  UNION ALL SELECT 'referrer_source', referrer_source FROM fx_sessions
  UNION ALL SELECT 'loyalty_tier', loyalty_tier FROM fx_users
  UNION ALL SELECT 'income_level', income_level FROM fx_users) WHERE value IS NOT NULL"""),
    "cold_users": q("""
SELECT user_id FROM fx_users u
WHERE NOT EXISTS (SELECT 1 FROM fx_interactions i WHERE i.user_id = u.user_id)"""),
    "known_review_users": q("""
SELECT DISTINCT user_id FROM fx_reviews r
WHERE EXISTS (SELECT 1 FROM fx_users u WHERE u.user_id = r.user_id)"""),
    "unknown_review_users": q("""
SELECT DISTINCT user_id FROM fx_reviews r
WHERE NOT EXISTS (SELECT 1 FROM fx_users u WHERE u.user_id = r.user_id)"""),
    "active_users": q("""
SELECT user_id, count(*) AS n FROM fx_interactions GROUP BY user_id HAVING count(*) >= 12
ORDER BY n DESC, user_id LIMIT 8"""),
}
# the same result sets at the reference's own thresholds
ORACLE["leaky_products_100"] = q(LEAKY.format(mv=100, n=10), "product_stats")
for _name, _own, _views in (("low_rated_50", "low_rated", 50),
                            ("funnel_points_20", "funnel_points", 20)):
    ORACLE[_name] = ORACLE[_own].replace(f"n_view >= {MIN_VIEWS}", f"n_view >= {_views}")
