"""Catalog helpers: create (idempotent), list, drop, crawl, declared read."""

from pyspark.sql import types as T

from conftest import SF_SMALL
from strata.plans import registered_io as RIO
from strata.sources import catalog as CAT
from strata.sources import io as IO
from strata.sources.crawler import crawl
from strata.streaming.jobs import scratch


def test_create_list_drop(spark):
    path = RIO._monthly_written(spark, SF_SMALL)
    spec = {"ms_cat": {"location": path, "format": "parquet", "partition_by": ["order_year", "order_month"]}}
    first = CAT.create_tables(spark, spec, "strata_t").collect()
    again = CAT.create_tables(spark, spec, "strata_t").collect()
    assert first[0]["success"] and again[0]["success"]
    assert "ms_cat" in {r["table_name"] for r in CAT.list_tables(spark, "strata_t").collect()}
    assert spark.table("strata_t.ms_cat").count() == spark.read.parquet(path).count()
    CAT.drop_table(spark, "strata_t.ms_cat")
    CAT.drop_table(spark, "strata_t.ms_cat")  # missing table is fine
    assert "ms_cat" not in {r["table_name"] for r in CAT.list_tables(spark, "strata_t").collect()}


def test_crawl_reports_new_and_vanished(spark):
    path = RIO._monthly_written(spark, SF_SMALL)
    known = T.StructType([T.StructField("currency", T.StringType()), T.StructField("gone", T.IntegerType())])
    rows = {r["column_name"]: r["change"] for r in crawl(spark, path, known).collect()}
    assert rows["currency"] == "same"
    assert rows["gone"] == "vanished"
    assert rows["total_revenue"] == "new"


def test_declared_read_quarantines_ragged_rows(spark):
    path = scratch(spark, "ragged")
    lines = ["a,b", "1,x", "2,y,EXTRA", "3,z"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = IO.schema_from_json([{"name": "a", "type": "int"}, {"name": "b", "type": "string"}])
    good, bad = IO.read_declared(spark, path, schema)
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert [r["_corrupt_record"] for r in bad.collect()] == ["2,y,EXTRA"]
