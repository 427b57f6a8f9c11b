"""Every quote reaches the quote streams: those without an instant leave by a counted reject output."""

import os

import pytest

from pitspark.plans import stream_queries, views
from pitspark.plans.catalog import all_queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not mounted")


@pytest.mark.parametrize("name", ["stream_deduplicated_quotes", "stream_hourly_spreads", "stream_last_states", "stream_rejected_quotes"])
def test_against_sql(spark, name):
    con = duck(SF)
    assert compare(all_queries()[name].run(spark, SF), con, all_queries()[name].sql) is None
    con.close()


def test_read_and_rejected_rows_are_all_rows(spark):
    quotes = views.quote_records(spark, SF)
    missing = quotes.filter("event_ns IS NULL").count()
    assert missing > 0
    hourly, rejected = stream_queries._hourly(spark, SF)
    assert rejected.count() == missing
    assert hourly.agg({"quotes": "sum"}).first()[0] + missing == quotes.count()
