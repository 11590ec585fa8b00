"""Queries against their SQL on pages of which several have one url or none, and whose titles are cut anywhere."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siteaudit.functions.html_facts import parse
from siteaudit.functions.markup import whole_references
from tests.conftest import SF

ROWS_APART = ("compare_added", "compare_changes", "compare_removed", "compare_totals", "metrics_upsert", "sitemap_seed")


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """40 pages, their urls once more on pages of other ids, and a title cut inside references."""
    path = str(tmp_path_factory.mktemp("same"))
    some = spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 40")
    cut = F.expr("regexp_replace(html, '<title>.*?</title>', '<title>A &amp; B &amp</title>')")
    again = some.withColumns({"page_id": F.col("page_id") + 41, "html": F.when(F.col("page_id") % 2 == 0, cut).otherwise(F.col("html"))})
    some.unionByName(again).coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def differing(spark, path, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/pages.parquet/*.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    wanted, got = Counter(found.fetchall()), Counter(map(tuple, entry.queries()[name](spark, path).select(*columns).collect()))
    assert wanted
    return (got - wanted) + (wanted - got)


@pytest.mark.parametrize("name", ROWS_APART)
def test_pages_with_one_url_are_rows_apart(spark, pages, name):
    assert not differing(spark, pages, name)


def test_what_is_left_of_a_cut_reference_stays(spark, pages):
    assert not differing(spark, pages, "page_facts")


@pytest.fixture(scope="module")
def blank_pages(spark, tmp_path_factory):
    """Pages of which some have no url and some no html."""
    path = str(tmp_path_factory.mktemp("blank"))
    gone = {"url": F.when(F.col("page_id") % 7 != 0, F.col("url")), "html": F.when(F.col("page_id") % 9 != 2, F.col("html"))}
    spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 40").withColumns(gone).coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ("band_totals", "counts_all", "report_metaDescription", "report_table_headings", "compare_changes", "compare_removed", "compare_totals"))
def test_pages_without_url_or_html(spark, blank_pages, name):
    assert not differing(spark, blank_pages, name)


def test_whole_references():
    assert whole_references("a &amp; b &amp &ampx; &#65; &#x42; &#65 &am") == "a & b &amp &ampx; A B &#65 &am"
    assert parse("<title>A &amp</title>").title == "A &" and parse("<title>A &amp</title>", whole_references).title == "A &amp"
