"""Registered queries against their DuckDB oracle on the sf0.001 tables."""
import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
NAMES = ["fx_sessions", "fx_products", "product_stats", "category_stats", "monthly_trend",
         "overview", "session_features", "user_item_weights", "item_cooccurrence",
         "top_neighbors", "recommendations", "null_profile", "conversion_by_channel",
         "event_spread", "fk_orphans", "kpi_cards", "insights", "user_features",
         "profile_by_loyalty_tier", "class_weights", "repaired_features", "feature_labels",
         "time_functions"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        else:
            df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v)
                              else (round(v, 9) if isinstance(v, float) else v))
    key = df.astype(str)
    return df.loc[key.sort_values(list(key.columns)).index].reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    pd.testing.assert_frame_equal(_norm(got), _norm(want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["product_id", "product_name", "category", "n_view", "n_purchases",
                          "view_to_purchase"]
    assert len(rows) > 0
