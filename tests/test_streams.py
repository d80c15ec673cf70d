"""Streams over files equal the batch result on the same files."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.plans import registered_io as RIO
from strata.sources import adapters as AD
from strata.streaming import jobs as S


def test_event_log_stream_equals_batch(spark):
    out = RIO.stream_event_log(spark, SF_SMALL)
    batch = S.event_log_rows(AD.events(spark, SF_SMALL))
    assert out.count() == batch.count()
    assert out.select("event_id").exceptAll(batch.select("event_id")).count() == 0


def test_metric_windows_match_batch_for_closed_windows(spark):
    out = RIO.stream_metrics(spark, SF_SMALL)
    batch = S.metric_windows(AD.metrics(spark, SF_SMALL))
    # Every emitted window equals the batch window (late data cannot occur in
    # one micro-batch); windows still open at the watermark are not emitted.
    diff = out.exceptAll(batch)
    assert diff.count() == 0
    assert out.count() <= batch.count()
