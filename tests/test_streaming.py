"""Structured Streaming scoring end to end on a small trained pipeline."""
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from basketlab.operators import conversion as conv
from basketlab.sources.fixtures import Shop
from basketlab.operators import aggregates as agg
from basketlab.streaming.scoring import start_scoring

SMALL = "/root/testdata/sf0.001"


def test_stream_scores_every_request(spark, scratch_dir):
    s = Shop(spark, SMALL)
    feats = agg.session_features(s.sessions, s.interactions, s.users)
    data = conv.split(conv.model_input(feats))
    train = conv.with_weights(data.where(~F.col("is_test")))
    model = conv.conversion_pipeline(conv.NUMERIC, conv.CATEGORICAL,
                                     LogisticRegression(maxIter=20, weightCol="weight")).fit(train)
    rows = feats.select("session_id", "n_view", "n_click", "n_add_to_cart", "n_remove_from_cart",
                        "n_add_to_wishlist", "n_remove_from_wishlist", "n_products",
                        "mean_dwell_ms", "max_dwell_ms", "duration_s", "hour", "day_of_week",
                        "prior_sessions", "tenure_days", "age", "device_type",
                        "referrer_source", "loyalty_tier", "income_level")
    # an unseen device category must score (all-zero one-hot), not fail
    rows = rows.withColumn("device_type", F.when(F.col("hour") == 3, "smart_tv")
                           .otherwise(F.col("device_type")))
    rows.repartition(3).write.parquet(f"{scratch_dir}/stream_in")
    q = start_scoring(spark, f"{scratch_dir}/stream_in", rows.schema, model, 0.3, "lr",
                      f"{scratch_dir}/stream_out", f"{scratch_dir}/stream_ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{scratch_dir}/stream_out")
    assert out.count() == rows.count()
    r = out.agg(F.min("conversion_probability"), F.max("conversion_probability")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
