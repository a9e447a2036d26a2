"""Queries of the browsing pages that differed from their SQL, or took too long, on larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lorewright import catalog
from lorewright.operators import browse
from tests.compare import connect, same

TEXTS = ['token = "a448b066" et le', "pass\\word = 'x|y` la le", "Licensed under CC BY 4.0\n\n  The rest  \n   \nof it", "x" * 126 + "  \n\nmore of it", "x" * 150, "  \n \n lead " + "y " * 80, "the an", ""]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "src0") for i, t in enumerate(TEXTS)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY d TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["ui_words", "ui_excerpt", "ui_bigrams", "rrf_fusion"])
def test_odd_texts_as_their_sql_has_it(spark, odd, name):
    assert same(catalog.queries()[name](spark, odd), connect(odd), catalog.oracle_sql()[name])


def test_texts_are_worked_out_once(spark):
    """A title may be a long expression; each place that named it split a whole body again."""
    pairs = browse.bigrams(F.col("title"))
    assert str(pairs).count("regexp_replace") == 1
    assert str(browse.alike(pairs, F.array(F.lit("th")))).count("regexp_replace") == 1
