"""Every registered query of the folder: odd rows, null keys, empty tables, oracle."""
import pytest
from llm_helpers import SMALL, oracle_rows, rows_of

import __spark_entry__ as entry
from basketlab.llm import queries as llm

COLUMNS = {
    "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_line_dedup": ["doc_id", "text", "n_lines", "n_dropped"],
    "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op6_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                     "labels", "score"],
    "op8_jaccard": ["doc_id", "n_shingles", "component_id"],
    "op9_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op10_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                         "formatted_chars"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                            "restored_sha256"],
}

ORACLES = sorted(llm.oracle_sql())
OTHER_TABLES = {"op9_warc": 1, "op11_vector_codes": 2, "op12_chat_format": 3}
# documents, pages, usable vectors, conversations and the one added
EXPECTED_ROWS = {"odd": (20, 9, 43, 7), "nulls": (9, 3, 5, 3), "empty": (0, 0, 0, 1)}


def test_all_operators_and_the_pipeline_are_registered():
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("tables", ["odd", "nulls", "empty"])
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_rows_and_columns(spark, request, name, tables):
    """One result row per input row, whatever the rows hold."""
    df = llm.queries()[name](spark, request.getfixturevalue(tables))
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == EXPECTED_ROWS[tables][OTHER_TABLES.get(name, 0)]


# the SQL of op6 cuts every window of a text by place, too slow for the very long one;
# test_suffix_dedup_is_exact has these rows
@pytest.mark.parametrize("name", [n for n in ORACLES if n != "op6_suffix_dedup"])
def test_odd_rows_match_sql(spark, odd, name):
    assert rows_of(llm.queries()[name](spark, odd)) == oracle_rows(llm.oracle_sql()[name], odd)


@pytest.mark.parametrize("name", ORACLES)
def test_given_tables_match_sql(spark, name):
    got = rows_of(llm.queries()[name](spark, SMALL))
    assert got == oracle_rows(llm.oracle_sql()[name], SMALL)
