"""Physical plans: what reaches the scan, what is limited before the shuffle, what must not appear."""

import pytest
from pyspark.sql import functions as F

from pitspark.operators import evidence as ev
from pitspark.operators import ledger as lg
from pitspark.operators import warehouse as wh
from pitspark.plans import views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables") / "market_bars")
    views.market_bars(spark, SF).write.parquet(path)
    return path


def test_cutoff_and_key_filters_reach_the_scan(spark, stored):
    bars = spark.read.parquet(stored)
    text = plan(wh.bars_as_of(bars, F.lit("1998-07-01").cast("timestamp"), "YF:S1").select("event_time", "close"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "LessThanOrEqual(available_at" in scan and "EqualTo(instrument_id,YF:S1)" in scan
    assert "StringStartsWith(data_version,snapshot-v2:)" in scan and "volume" not in scan.split("ReadSchema")[1]


def test_latest_version_is_limited_before_the_shuffle(spark, stored):
    text = plan(ev.market_section(spark.read.parquet(stored), F.lit("1998-07-01").cast("timestamp")))
    below = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_bars_aggregate_without_sorting_the_source(spark):
    text = plan(views.bars(spark, SF))
    # the full ordering key is only used above the join that keeps the first and last order of a day
    below = text[text.rindex("SortAggregate") :]
    assert below.index("Join") < below.index("FileScan")


def test_running_scan_never_groups_by_the_key_alone_at_row_level(spark):
    fills = views.fills(spark, SF).withColumn("bin", F.expr("l_orderkey div 1000"))
    text = plan(lg.running_positions(fills, ["day", "bin"], ["day", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]))
    assert text.count("FileScan") <= 3
    # the only exchange on the symbol alone carries daily totals
    keyed = [line for line in text.splitlines() if "hashpartitioning(symbol" in line and "day" not in line.split("hashpartitioning")[1]]
    assert all("Aggregate" in text[text.index(line) :].splitlines()[1] for line in keyed)


def test_no_cartesian_products(spark):
    from pitspark.plans.catalog import all_queries

    for name in ("timing_labels", "macro_at_month_starts", "forward_quotes", "position_ledger", "signal_settlement", "evidence_news"):
        text = plan(all_queries()[name].run(spark, SF))
        assert "CartesianProduct" not in text, name
    spark.catalog.clearCache()
