"""DuckDB oracle SQL for the table layer (fixture tables, D1–D10)."""
from __future__ import annotations

from basketlab.plans.fixtures_sql import with_fixtures

TYPES = ["view", "click", "add_to_cart", "add_to_wishlist", "remove_from_wishlist",
         "remove_from_cart"]


def type_counts_sql(prefix: str = "n_") -> str:
    return ",\n  ".join(
        f"CAST(count(*) FILTER (WHERE interaction_type = '{t}') AS BIGINT) AS {prefix}{t}"
        for t in TYPES)


def zero_filled(cols, alias="") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join(f"CAST(coalesce({a}{c}, 0) AS BIGINT) AS {c}" for c in cols)


N_COLS = [f"n_{t}" for t in TYPES]

EXTRA = {
    "product_stats": f"""
  SELECT p.product_id, p.product_name, p.category, p.brand, p.price, p.rating_avg,
         p.review_count, p.stock_quantity,
         {zero_filled(N_COLS + ['n_purchases', 'units_sold'])},
         coalesce(pc.revenue, 0.0) AS revenue,
         CAST(coalesce(pc.n_purchases, 0) AS DOUBLE)
           / CAST(nullif(coalesce(ic.n_view, 0), 0) AS DOUBLE)
           AS view_to_purchase
  FROM fx_products p
  LEFT JOIN (SELECT product_id, {type_counts_sql()} FROM fx_interactions
             WHERE product_id IS NOT NULL GROUP BY product_id) ic USING (product_id)
  LEFT JOIN (SELECT product_id, count(*) AS n_purchases,
                    CAST(sum(quantity) AS BIGINT) AS units_sold,
                    CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
             FROM fx_purchases WHERE product_id IS NOT NULL GROUP BY product_id) pc
    USING (product_id)""",
    "category_stats": """
  SELECT category, count(product_name) AS products,
         CAST(sum(n_view) AS BIGINT) AS views,
         CAST(sum(n_add_to_cart) AS BIGINT) AS carts,
         CAST(sum(n_purchases) AS BIGINT) AS purchases,
         CAST(sum(CAST(revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
         round(CAST(sum(CAST(price AS DECIMAL(18,2))) AS DOUBLE) / count(price), 6) AS avg_price,
         round(avg(rating_avg), 6) AS avg_rating,
         CAST(sum(n_purchases) AS DOUBLE) / CAST(nullif(sum(n_view), 0) AS DOUBLE)
           AS view_to_purchase
  FROM product_stats WHERE category IS NOT NULL GROUP BY category""",
    "session_stats": f"""
  SELECT session_id, {type_counts_sql()},
         count(*) AS n_interactions,
         count(DISTINCT product_id) AS n_products,
         CAST(sum(dwell_time_ms) AS BIGINT) AS total_dwell_ms,
         avg(dwell_time_ms) AS mean_dwell_ms,
         CAST(max(dwell_time_ms) AS BIGINT) AS max_dwell_ms,
         min("timestamp") AS first_ts, max("timestamp") AS last_ts
  FROM fx_interactions WHERE session_id IS NOT NULL GROUP BY session_id""",
    "session_features": """
  SELECT s.session_id, s.user_id, s.start_time, s.device_type, s.referrer_source,
         s.is_converted, st.n_view, st.n_click, st.n_add_to_cart, st.n_add_to_wishlist,
         st.n_remove_from_wishlist, st.n_remove_from_cart, st.n_interactions,
         st.n_products, st.total_dwell_ms, st.mean_dwell_ms, st.max_dwell_ms,
         CAST(epoch(st.last_ts) - epoch(st.first_ts) AS DOUBLE) AS duration_s,
         st.n_add_to_cart - st.n_remove_from_cart AS net_cart,
         st.n_add_to_wishlist - st.n_remove_from_wishlist AS net_wishlist,
         CAST(hour(s.start_time) AS BIGINT) AS hour,
         CAST(isodow(s.start_time) - 1 AS BIGINT) AS day_of_week,
         CAST(CASE WHEN isodow(s.start_time) - 1 >= 5 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
         CAST(row_number() OVER (PARTITION BY s.user_id
                                 ORDER BY s.start_time, s.session_id) - 1 AS BIGINT)
           AS prior_sessions,
         CAST(CASE WHEN row_number() OVER (PARTITION BY s.user_id
                                           ORDER BY s.start_time, s.session_id) > 1
                   THEN 1 ELSE 0 END AS BIGINT) AS is_returning,
         u.loyalty_tier, u.income_level, u.age,
         CAST(floor((epoch(s.start_time) - epoch(u.signup_date)) / 86400) AS BIGINT)
           AS tenure_days
  FROM fx_sessions s
  LEFT JOIN session_stats st USING (session_id)
  LEFT JOIN fx_users u USING (user_id)""",
}


def q(body: str, *needs: str) -> str:
    extra = {}
    order = ["product_stats", "category_stats", "session_stats", "session_features"]
    want = set(needs)
    # pull in dependencies of the requested helper views
    if "category_stats" in want:
        want.add("product_stats")
    if "session_features" in want:
        want.add("session_stats")
    for name in order:
        if name in want:
            extra[name] = EXTRA[name]
    return with_fixtures(body, extra)


ORACLE = {
    "fx_users": q("SELECT * FROM fx_users"),
    "fx_products": q("SELECT * FROM fx_products"),
    "fx_sessions": q("SELECT * FROM fx_sessions"),
    "fx_interactions": q("SELECT * FROM fx_interactions"),
    "fx_purchases": q("SELECT * FROM fx_purchases"),
    "fx_reviews": q("SELECT * FROM fx_reviews"),
    "event_counts_by_product": q(f"""
SELECT product_id, {type_counts_sql()} FROM fx_interactions
WHERE product_id IS NOT NULL GROUP BY product_id"""),
    "event_counts_by_user": q(f"""
SELECT user_id, {type_counts_sql()} FROM fx_interactions
WHERE user_id IS NOT NULL GROUP BY user_id"""),
    "purchases_by_product": q("""
SELECT product_id, count(*) AS n_purchases, CAST(sum(quantity) AS BIGINT) AS units_sold,
       CAST(sum(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM fx_purchases WHERE product_id IS NOT NULL GROUP BY product_id"""),
    "product_stats": q("SELECT * FROM product_stats", "product_stats"),
    "category_stats": q("SELECT * FROM category_stats", "category_stats"),
    "monthly_trend": q("""
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
SELECT spine.month, CAST(coalesce(sm.sessions, 0) AS BIGINT) AS sessions,
       CAST(coalesce(sm.conversions, 0) AS BIGINT) AS conversions,
       CAST(coalesce(pm.orders, 0) AS BIGINT) AS orders,
       coalesce(pm.revenue, 0.0) AS revenue,
       CAST(coalesce(sm.conversions, 0) AS DOUBLE)
         / CAST(nullif(coalesce(sm.sessions, 0), 0) AS DOUBLE) AS conversion_rate
FROM spine LEFT JOIN sm USING (month) LEFT JOIN pm USING (month)"""),
    "overview": q("""
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
       (SELECT count(rating_avg) FROM fx_products) AS rated_products"""),
    "session_interaction_stats": q("SELECT * FROM session_stats", "session_stats"),
    "session_features": q("SELECT * FROM session_features", "session_features"),
}
