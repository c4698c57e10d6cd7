"""Tables that grow with the input are joined without collecting them on the driver, however small they are as files."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from cityloom.operators import models
from cityloom.plans import chain, publication, queries as plans  # noqa: F401
from cityloom.sources.files import stored


def plans_of(name, spark, monkeypatch):
    """The plans of all that a query writes, and its own, as Spark makes them before it knows any size but those of files."""
    told, write = [], DataFrameWriter.parquet
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def parquet(self, *args, **named):
        told.append(text(self._df))
        return write(self, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return [text(plans.QUERIES[name](spark, "/root/testdata/sf0.001")), *told]


@pytest.mark.parametrize("name", ["end_to_end"])
def test_no_table_of_buildings_is_sent_to_all_tasks(spark, monkeypatch, name):
    found = plans_of(name, spark, monkeypatch)
    assert len(found) > 3 and any("SortMergeJoin" in p for p in found)
    # the codes of the zones are sent, which are keyed by a text
    sent = [line.strip() for p in found for line in p.splitlines() if re.search(r"BroadcastExchange HashedRelationBroadcastMode\(List\((?!input\[0, string)", line)]
    assert not sent


def test_oversampling_sends_no_table_to_all_tasks(spark):
    """The models' part of end_to_end_model: neighbours and copies are joined by sorting, too."""
    rows = stored(spark.range(3000).selectExpr("id AS bid", "id % 97 * 1.5D AS a", "id % 89 * 0.5D AS b", "cast(id % 4 = 0 AS int) AS y"), "rows")
    plan = models.oversample(rows, "y", "bid", ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
