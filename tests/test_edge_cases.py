"""Hand-made edge rows (FIXTURES.md §5)."""
import datetime as dt

from pyspark.sql import functions as F

from basketlab.operators import aggregates as agg
from basketlab.operators import recommender as rec
from basketlab.operators import segmentation as seg

TS = dt.datetime


def _products(spark):
    return spark.createDataFrame(
        [(1, "Lamp", "home", "B1", 10.0, 4.0, 2, 5), (2, "Desk", "home", "B2", 20.0, None, 0, 1)],
        "product_id long, product_name string, category string, brand string, price double, "
        "rating_avg double, review_count long, stock_quantity long")


def _interactions(spark, rows):
    return spark.createDataFrame(
        rows, "interaction_id long, user_id long, product_id long, session_id string, "
              "interaction_type string, timestamp timestamp, dwell_time_ms long")


def _purchases(spark, rows):
    return spark.createDataFrame(
        rows, "purchase_id long, order_id string, user_id long, product_id long, "
              "session_id string, interaction_id long, quantity long, total_amount double, "
              "order_date timestamp")


def test_zero_views_one_purchase_gives_null_ratio(spark):
    inter = _interactions(spark, [(1, 7, 1, "s1", "view", TS(2024, 1, 1), 1000)])
    pur = _purchases(spark, [(9, "o1", 7, 2, "s1", 9, 1, 20.0, TS(2024, 1, 1))])
    ps = {r.product_id: r for r in agg.product_stats(_products(spark), inter, pur).collect()}
    assert ps[2].n_view == 0 and ps[2].n_purchases == 1
    assert ps[2].view_to_purchase is None
    assert ps[1].view_to_purchase == 0.0
    assert ps[2].revenue == 20.0 and ps[1].revenue == 0.0


def test_session_without_interactions_keeps_null_counts(spark):
    sess = spark.createDataFrame(
        [("s1", 7, TS(2024, 1, 1, 10), "mobile", "direct", 0),
         ("s2", 7, TS(2024, 1, 1, 10), "mobile", "direct", 1)],
        "session_id string, user_id long, start_time timestamp, device_type string, "
        "referrer_source string, is_converted long")
    users = spark.createDataFrame(
        [(7, TS(2024, 1, 1, 11), "gold", "low", 30)],
        "user_id long, signup_date timestamp, loyalty_tier string, income_level string, age long")
    inter = _interactions(spark, [(1, 7, 1, "s1", "view", TS(2024, 1, 1, 10, 5), 1000)])
    f = {r.session_id: r for r in agg.session_features(sess, inter, users).collect()}
    assert f["s2"].n_view is None and f["s2"].net_cart is None
    assert f["s1"].n_view == 1
    # signup one hour after the session start -> tenure -1, not 0
    assert f["s1"].tenure_days == -1
    # two sessions at one time -> ordered by session_id
    assert (f["s1"].prior_sessions, f["s2"].prior_sessions) == (0, 1)
    assert (f["s1"].is_returning, f["s2"].is_returning) == (0, 1)


def test_empty_month_between_two_others(spark):
    sess = spark.createDataFrame(
        [("a", 1, TS(2024, 1, 5), 1), ("b", 1, TS(2024, 3, 5), 0)],
        "session_id string, user_id long, start_time timestamp, is_converted long")
    pur = _purchases(spark, [(1, "o", 1, 1, "a", 1, 1, 5.5, TS(2024, 1, 5)),
                             (2, "o", 1, 1, "a", 2, 1, 1.0, TS(2024, 6, 1))])
    t = agg.monthly_trend(sess, pur).orderBy("month").collect()
    assert [r.sessions for r in t] == [1, 0, 1]
    assert t[1].conversion_rate is None and t[1].orders == 0
    assert t[0].revenue == 5.5  # the June purchase lies outside the session span


def test_net_negative_pair_and_unknown_type_vanish(spark):
    inter = _interactions(spark, [
        (1, 7, 1, "s", "view", TS(2024, 1, 1), 500),
        (2, 7, 1, "s", "remove_from_cart", TS(2024, 1, 1), 500),
        (3, 7, 2, "s", "teleport", TS(2024, 1, 1), 500),
        (4, 7, 3, "s", "click", TS(2024, 1, 1), 500)])
    pur = _purchases(spark, [])
    ui = {(r.user_id, r.product_id): r.w for r in rec.user_item_weights(inter, pur).collect()}
    assert ui == {(7, 3): 2.0}


def test_user_without_neighbours_gets_bestsellers(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    ui = spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0)],
                               "user_id long, product_id long, w double")
    nb = spark.createDataFrame([], "item long, neighbor long, sim double, rank long")
    products = spark.createDataFrame(
        [(10, "A", "c", "b", 1.0), (20, "B", "c", "b", 2.0)],
        "product_id long, product_name string, category string, brand string, price double")
    best = spark.createDataFrame([(20, 1), (10, 2)], "product_id long, rank long")
    out = rec.recommend_all(users, ui, nb, best, products, n=2).collect()
    by_user = {}
    for r in out:
        by_user.setdefault(r.user_id, []).append(r)
    assert all(r.cold_start and r.score == 0.0 for r in out)
    assert [r.product_id for r in sorted(by_user[3], key=lambda r: r.rank)] == [20, 10]
    assert by_user[3][0].reason.startswith("New shopper")
    assert by_user[1][0].reason.startswith("Nothing close enough")


def test_duplicate_segment_names_get_suffix(spark):
    cols = ", ".join(f"{c} double" for c in seg.FEATURES)
    zeros = tuple(0.0 for _ in seg.FEATURES)
    prof = spark.createDataFrame([(0, *zeros, 5, 0.5), (1, *zeros, 5, 0.5)],
                                 f"cluster long, {cols}, size long, share double")
    overall = spark.createDataFrame([tuple(1.0 for _ in seg.FEATURES)],
                                    ", ".join(f"o_{c} double" for c in seg.FEATURES))
    names = {r.cluster: r.name for r in seg.name_segments(prof, overall).collect()}
    assert names == {0: "Dormant Signups", 1: "Dormant Signups II"}


def test_nanosecond_timestamp_text_floors_to_second(spark):
    from basketlab.functions.scalars import parse_ts
    df = spark.createDataFrame([("2023-01-16 12:57:18.000000115",)], "t string")
    assert df.select(parse_ts("t").alias("x")).first().x == TS(2023, 1, 16, 12, 57, 18)


def test_csv_with_embedded_newline(spark, scratch_dir):
    from basketlab.sources.raw import clean_tables, read_raw
    folder = f"{scratch_dir}/csv_nl"
    import os
    os.makedirs(f"{folder}/products.csv", exist_ok=True)
    with open(f"{folder}/products.csv/part-0.csv", "w") as fh:
        fh.write("product_id,product_name,product_description,category,subcategory,brand,"
                 "price,rating_avg,review_count,stock_quantity,date_added\n")
        fh.write('p1,Lamp,"First line\nsecond line", home , lights ,B1,10.5,,0,3,'
                 '2023-01-16 12:57:18.000000115\n')
    raw = read_raw(spark, folder, {"products": __import__(
        "basketlab.sources.raw", fromlist=["RAW_SCHEMAS"]).RAW_SCHEMAS["products"]})
    p = clean_tables(raw)["products"].first()
    assert p.blurb == "First line" and p.category == "home" and p.rating_avg is None
    assert p.date_added == TS(2023, 1, 16, 12, 57, 18)


def test_feature_labels(spark):
    from basketlab.operators.conversion import feature_label
    df = spark.createDataFrame([("net_cart",), ("device_type_mobile",),
                                ("referrer_source_organic_search",), ("some_thing",)], "f string")
    got = [r.l for r in df.select(feature_label("f").alias("l")).collect()]
    assert got == ["Items still in cart", "Device: mobile", "Came from: organic search",
                   "some thing"]


def test_missing_scoring_fields_take_defaults(spark):
    from basketlab.operators.conversion import repair_features
    rows = spark.createDataFrame([("x", 2, None, 1, 0, 6)],
                                 "session_id string, n_view long, n_click long, "
                                 "n_add_to_cart long, prior_sessions long, day_of_week long")
    r = repair_features(rows).first()
    assert r.n_click == 1 and r.mean_dwell_ms == 12000 and r.device_type == "desktop"
    assert r.net_cart == 1 and r.is_weekend == 1 and r.is_returning == 0
    assert r.n_interactions == 5  # max(default 5, 2 + 1 + 1 + 0)
    assert r.total_dwell_ms == 12000 * 5
