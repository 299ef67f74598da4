"""The queries that SQL can express, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from tests.llm.test_filters import PAGES, linked_pages
from vellumite.llm import oracles
from vellumite.llm.queries import URL_RULES, oracle_sql, queries
from vellumite.llm.url_filter import url_verdicts


def rows(df):
    return sorted(repr([None if x is None or x != x else x for x in r]) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(queries()[name](spark, sf).toPandas()) == rows(con.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("pages", [PAGES, linked_pages()])
def test_links(spark, pages):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    got = url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).toPandas()
    assert rows(got) == rows(con.execute(oracles.url_filter()).df())
