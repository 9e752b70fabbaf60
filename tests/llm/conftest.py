import tempfile

import pytest
from llm_helpers import BASE, BIG, ITEMS, LABELS, PAGES, ROWS, TURNS, VECTORS, vector, write_tables


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows in every table."""
    return write_tables(spark, tempfile.mkdtemp(prefix="llm-odd-"), ROWS, PAGES, ITEMS, LABELS, VECTORS, TURNS)


@pytest.fixture(scope="session")
def nulls(spark):
    """Null keys, null everything."""
    rows = [*ROWS[:6], (None, BASE, "en", "b"), (None, None, None, None), (None, BASE, None, "b")]
    return write_tables(spark, tempfile.mkdtemp(prefix="llm-null-"), rows,
                        [(None, None, None), (None, "u", BIG), (1, "u", BIG)],
                        [(None, "short"), (1, None)], [(None, None, None)],
                        [(None, None, None), (None, vector(3), None), (4, vector(4), None), (4, vector(5), 1),
                         (5, vector(5, 9), 1), (6, [], 1)],
                        [(None, None, None, None), (None, 1, None, "x"), (1, None, "user", None), (1, 0, "user", "y")])


@pytest.fixture(scope="session")
def empty(spark):
    return write_tables(spark, tempfile.mkdtemp(prefix="llm-empty-"), [])
