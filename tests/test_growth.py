"""What passes the driver or a Python worker does not grow with the pages."""

import pytest
from pyspark.sql import functions as F

from siteaudit import queries, site_queries
from siteaudit.functions.html_facts import Facts
from siteaudit.operators import ordinal
from siteaudit.sources import tables
from siteaudit.sources.pages import page_facts
from tests.conftest import SF


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("few"))
    spark.read.parquet(f"{SF}/pages.parquet").where("page_id < 40").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def broadcasts(spark, run):
    """How many tables went through the driver: key relations, not single rows."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = 0
    ran = store.executionsList()
    for i in range(before, ran.size()):
        nodes = store.planGraph(ran.apply(i).executionId()).allNodes()
        for k in range(nodes.size()):
            found += nodes.apply(k).name() == "BroadcastExchange" and "HashedRelation" in nodes.apply(k).desc()
    return found


#: How many broadcasts a query asks for by itself: where numbers of partitions begin, and the catalogue of filters.
ASKED = {"report_table_security": 1, "band_totals": 2, "report_metaDescription": 1, "counts_maintained": 1}


@pytest.mark.parametrize("name", ASKED)
def test_only_small_tables_are_broadcast(spark, pages, monkeypatch, name):
    monkeypatch.setattr(queries, "_CRAWLS", {})
    monkeypatch.setattr(queries, "_VIEWS", {})
    query = queries.QUERIES.get(name) or site_queries.QUERIES[name]
    assert broadcasts(spark, lambda: query(spark, pages).collect()) <= ASKED[name]


@pytest.mark.parametrize("name", ("compare_changes", "compare_removed", "compare_totals"))
def test_compared_crawls_are_not_broadcast(spark, pages, name):
    queries.crawl_and_view(spark, pages)
    assert broadcasts(spark, lambda: queries.QUERIES[name](spark, pages).collect()) == 0


def test_setting_comes_back(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), tables.without_broadcasts(spark):
        assert spark.conf.get(key) == "-1"
        raise ValueError
    assert spark.conf.get(key) == was


def test_pages_are_read_once_and_in_small_batches(spark, pages, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    read = spark.sparkContext.accumulator(0)

    def reader(html):
        read.add(1)
        return Facts(word_count=len(html or ""))

    facts = page_facts(spark.read.parquet(f"{pages}/pages.parquet"), reader=reader).select("page_id", "word_count")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(tables.PAGE_BATCH)
    order = ordinal.build(facts, [F.col("word_count").desc(), F.col("page_id")], str(tmp_path))
    assert read.value == order.total == 40
