"""Interval unions, ranks, alarms, publishing, crawling and records on hand-made rows."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.operators import quality as Q
from strata.operators import reports as R
from strata.operators import telemetry as TL
from strata.plans import pipeline as P
from strata.sources import crawler as CR
from strata.sources import io as IO
from strata.sources import publish as PB
from strata.streaming import jobs as S
from strata.streaming.alarms import alarm_stream, closed_rows

SPAN = "trace_id string, span_id int, parent_span_id int, start_time timestamp_ntz, duration_ms decimal(12,2), service_name string, operation_name string"
T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.mark.parametrize("sweep_us", [1_000_000, 7_000])
def test_self_time_is_what_no_child_covers(spark, sweep_us):
    """Nested, equal, touching, overlapping and outlasting children, a hot
    parent, and spans without times, against a count of milliseconds."""
    r = random.Random(4)
    spans = [("t", 0, None, at(0), D(100))]
    spans += [("t", k, 0, at(r.randrange(-20, 110)), D(r.choice([0, 1, 5, 5, 30]))) for k in range(1, 60)]
    spans += [("t", 60 + k, r.randrange(1, 60), at(r.randrange(0, 100)), D(r.randrange(0, 12))) for k in range(80)]
    spans += [("u", 0, None, at(0), D(50)), ("u", 1, 0, at(10), D(20)), ("u", 2, 0, at(10), D(20)), ("u", 3, 0, at(15), D(5)), ("u", 4, 0, at(30), D(5)), ("u", 5, 9, at(0), D(5))]
    spans += [("v", 0, None, None, D(5)), ("v", 1, 0, at(0), None), ("v", 2, 1, at(0), D(1))]
    ms = lambda x: int((x - T0).total_seconds() * 1000)
    want = {}
    for t, i, _, s, d in spans:
        kids = [x for x in spans if x[0] == t and x[2] == i]
        if s is None or d is None:
            want[t, i] = (len(kids), d)
            continue
        own = set(range(ms(s), ms(s) + int(d)))
        for _, _, _, ks, kd in kids:
            own -= set(range(ms(ks), ms(ks) + int(kd))) if ks is not None and kd is not None else set()
        want[t, i] = (len(kids), D(len(own)))
    got = TL.span_parenting(spark.createDataFrame([(*x, "s", "o") for x in spans], SPAN), sweep_us).collect()
    assert {(x["trace_id"], x["span_id"]): (x["n_children"], x["self_time_ms"]) for x in got} == want
    assert [x["span_id"] for x in got if x["is_orphan"]] == [5]


def test_spans_of_a_hot_trace_are_ranked_by_ranges(spark):
    r = random.Random(1)
    rows = [(f"t{0 if k % 3 else k % 40}", k, None, at(r.randrange(50)), D(1), "s", "o") for k in range(3000)]
    df = spark.createDataFrame(rows, SPAN).repartition(7)
    got = {x["span_id"]: (x["trace_id"], x["position"]) for x in TL.trace_spans(df).collect()}
    want = {}
    for t in {x[0] for x in rows}:
        for p, x in enumerate(sorted((x for x in rows if x[0] == t), key=lambda x: (x[3], x[1])), 1):
            want[x[1]] = (t, p)
    assert got == want


METRICS = "namespace string, name string, value decimal(12,2), unit string, dimensions map<string,string>, timestamp timestamp_ntz"


def sample(hour, value, ns="n", dim="a", minute=0):
    return (ns, "m", D(value), "Count", {"d": dim}, T0 + dt.timedelta(hours=hour, minutes=minute))


def test_alarms_are_of_one_metric(spark):
    rows = [sample(h, 9) for h in (0, 1, 3, 4)] + [sample(2, 9, "other"), sample(2, 9, dim="b")] + [sample(h, 9, dim="c") for h in range(5)]
    rows += [sample(-400_000, 9, dim="old"), sample(0, 9, dim="old")]  # a stray sample long ago
    got = TL.alarm_consecutive(spark.createDataFrame(rows, METRICS), "5", 4)
    hours = {(x["dimensions"], x["hour"]): x["in_alarm"] for x in got.where("dimensions != 'd=old'").collect() if x["namespace"] == "n"}
    assert [h for (d, h), on in hours.items() if on and d == "d=c"] == [T0 + dt.timedelta(hours=h) for h in (3, 4)]
    assert not any(on for (d, _), on in hours.items() if d != "d=c") and (("d=a", T0 + dt.timedelta(hours=2))) in hours
    assert got.where("dimensions = 'd=old'").count() == 400_001
    assert TL.metric_alarm(spark.createDataFrame(rows, METRICS), "5").where("namespace = 'other'").count() == 1


def test_alarm_stream_equals_the_batch_over_restarts(spark):
    """Each batch starts the job anew; silence ends an alarm."""
    root, r = S.scratch(spark, "alarms"), random.Random(7)
    batches, rows = [], []
    for k in range(4):
        part = [sample(6 * k + h, r.choice([4, 8, 9]), dim=d, minute=r.randrange(60)) for h in range(6) for d in "ab" if (d, k) != ("b", 1) and r.random() < 0.9]
        batches.append(part)
        rows += part
    batches.append([sample(40, 1, dim="z")])  # moves the watermark on
    schema = spark.createDataFrame([], METRICS).schema
    for part in batches:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/in")
        stream = alarm_stream(S.file_stream(spark, f"{root}/in", schema), "5", 3, delay="1 minute")
        S.append_to_parquet(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = S.read_sink(spark, f"{root}/out", stream.schema)
    key = lambda x: (x["dimensions"], x["hour"])
    rows_of = lambda df: sorted((*key(x), x["max_value"], x["breaching"], x["in_alarm"]) for x in df.collect())
    want = TL.alarm_consecutive(spark.createDataFrame(rows, METRICS), "5", 3)
    ends = {d: max(x[5] for x in rows if x[4]["d"] == d).replace(minute=0) for d in "ab"}
    inside = [x for x in got.collect() if x["hour"] <= ends.get(x["dimensions"][2:], T0)]
    as_rows = sorted(((*key(x), x["max_value"], x["breaching"], x["in_alarm"]) for x in inside), key=str)
    assert as_rows == sorted(rows_of_plain(want), key=str)
    after = [x for x in got.collect() if x["dimensions"] != "d=z" and x["hour"] > ends[x["dimensions"][2:]]]
    assert sorted((x["dimensions"], x["silent"], x["in_alarm"]) for x in after) == [("d=a", True, False), ("d=b", True, False)]


def rows_of_plain(df):
    return [(x["dimensions"], x["hour"], x["max_value"], x["breaching"], x["in_alarm"]) for x in df.collect()]


def test_closed_rows_keep_the_streak():
    rows, state = closed_rows(None, 0, False, {5: 9, 6: 9, 9: 9}, 7, 5, 2)
    assert rows == [(5, 9, True, False, False), (6, 9, True, True, False)] and state == (6, 2, False, {9: 9})
    rows, state = closed_rows(*state, 20, 5, 2)
    assert rows == [(7, None, False, False, False), (8, None, False, False, False), (9, 9, True, False, False), (10, None, False, False, True)]
    assert closed_rows(*state, 30, 5, 2) == ([], state)


def test_a_failed_run_leaves_the_published_marts(spark):
    out = S.scratch(spark, "publish")
    first = P.run_pipeline(spark, SF_SMALL, out)
    before = {n: (r["location"], r["row_count"]) for n, r in PB.published(spark, out).items()}
    assert first.version == 1 and {"customer_analytics", "product_analytics", "monthly_sales"} <= set(before)

    def broken(T):
        return P.M.monthly_sales(T).withColumn("x", F.raise_error(F.lit("third mart")))
    marts = {**P.MARTS_A, "monthly_sales": (broken, None, None)}
    res = P.run_pipeline(spark, SF_SMALL, out, raise_errors=False, marts=marts)
    assert not res.success and "third mart" in res.errors[0] and res.errors[0].startswith("monthly_sales")
    twice = {**P.MARTS_A, "product_analytics": (lambda T: P.M.product_analytics(T).unionByName(P.M.product_analytics(T)), None, ["product_id"])}
    with pytest.raises(PB.ValidationError, match="product_id is no key"):
        P.run_pipeline(spark, SF_SMALL, out, marts=twice)
    assert {n: (r["location"], r["row_count"]) for n, r in PB.published(spark, out).items()} == before
    assert PB.read_published(spark, out, "monthly_sales").count() == before["monthly_sales"][1]
    assert P.run_pipeline(spark, SF_SMALL, out).version == 2
    old = PB.read_published(spark, out, "monthly_sales", 1).count()
    assert old == before["monthly_sales"][1] and len(PB.expire(spark, out, keep=1)) == 1
    assert PB.read_published(spark, out, "monthly_sales").count() == old


def test_raw_input_is_validated_first(spark):
    class Raw:
        def __init__(self, t, **changed):
            self.t, self.changed = t, changed

        def __getattr__(self, name):
            return self.changed.get(name, getattr(self.t, name))
    t, out = P.Tables(spark, SF_SMALL), S.scratch(spark, "raw-check")
    for bad, message in ((t.orders.limit(0), "orders: no raw rows"), (t.orders.drop("order_date"), "orders: no column order_date")):
        res = P.run_pipeline(spark, SF_SMALL, out, raise_errors=False, tables=Raw(t, orders=bad))
        assert not res.success and message in res.errors[0] and not PB.published(spark, out)


def test_marts_are_reused_until_the_input_changes(spark):
    sf, out = S.scratch(spark, "input"), S.scratch(spark, "reuse")
    for t in P.INPUTS:
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{sf}/{t}.parquet")
    rows = R.completeness_check(*(P.current_marts(spark, sf, "a", out)[m] for m in ("customer_analytics", "product_analytics"))).collect()
    again = P.current_marts(spark, sf, "a", out)
    plan = R.completeness_check(again["customer_analytics"], again["product_analytics"])
    assert plan.collect() == rows and {r["version"] for r in PB.published(spark, out).values()} == {1}
    spark.read.parquet(f"{SF_SMALL}/part.parquet").limit(5).withColumn("p_partkey", F.col("p_partkey") + 10**9).write.mode("append").parquet(f"{sf}/part.parquet")
    more = P.current_marts(spark, sf, "a", out)
    assert {r["version"] for r in PB.published(spark, out).values()} == {2}
    assert more["product_analytics"].count() >= again["product_analytics"].count()


def test_profile_counts_repeated_keys(spark):
    rows = Q.profile(spark.createDataFrame([(1, "a"), (1, "b"), (1, None)], "k int, v string")).collect()
    assert {r["column_name"]: (r["total_rows"], r["null_count"], r["distinct_count"]) for r in rows} == {"k": (3, 0, 1), "v": (3, 1, 2)}


def test_crawler_updates_the_catalog(spark):
    """Three formats and a loose file; a new column becomes readable through
    the table, a vanished one is reported, new partitions are listed."""
    base, db = S.scratch(spark, "lake"), "strata_crawl"
    rows = spark.createDataFrame([(1, "a", 2020), (2, "b", 2021)], "id int, name string, year int")
    rows.write.partitionBy("year").parquet(f"{base}/sales")
    rows.select("id", "name").write.json(f"{base}/logs")
    rows.select("id", "name").write.option("header", "true").csv(f"{base}/people")
    found = {r["table_name"]: r["format"] for r in CR.found_tables(spark, base).collect()}
    assert found == {"sales": "parquet", "logs": "json", "people": "csv"}
    first = CR.crawl_update(spark, base, db).collect()
    assert all(r["change"] == "new" and r["applied"] for r in first) and spark.table(f"{db}.sales").count() == 2
    assert {r["column_name"] for r in first if r["is_partition"]} == {"year"}
    more = spark.createDataFrame([(3, "c", 2022, 1.5)], "id int, name string, year int, score double")
    more.write.mode("append").partitionBy("year").parquet(f"{base}/sales")
    more.select("id", "name", "score").write.mode("overwrite").option("header", "true").csv(f"{base}/people")
    more.select("id").write.mode("overwrite").json(f"{base}/logs")
    second = {(r["table_name"], r["column_name"]): (r["change"], r["applied"]) for r in CR.crawl_update(spark, base, db).collect()}
    assert second["sales", "score"] == ("new", True) and second["people", "score"] == ("new", True)
    assert second["logs", "name"] == ("vanished", False) and second["sales", "id"] == ("same", False)
    assert sorted((r["id"], r["score"], r["year"]) for r in spark.table(f"{db}.sales").collect()) == [(1, None, 2020), (2, None, 2021), (3, 1.5, 2022)]
    assert [r["score"] for r in spark.table(f"{db}.people").collect()] == [1.5]
    spark.createDataFrame([("x",)], "v string").coalesce(1).write.parquet(f"{base}/one")
    name = spark.read.format("binaryFile").load(f"{base}/one").first()["path"].rsplit("/", 1)[1]
    loose = CR.found_tables(spark, f"{base}/one").collect()
    assert [(r["table_name"], r["files"]) for r in loose] == [("one", 1)] and name.endswith(".parquet")
    for t in ("sales", "logs", "people"):
        spark.sql(f"DROP TABLE {db}.{t}")


def test_loose_files_are_tables_beside_folders(spark, tmp_path):
    (tmp_path / "lake" / "days").mkdir(parents=True)
    (tmp_path / "lake" / "days" / "a.csv").write_text("d\n1\n")
    (tmp_path / "lake" / "orders-2024.json").write_text('{"id": 1}\n')
    got = {r["table_name"]: (r["format"], r["files"]) for r in CR.found_tables(spark, str(tmp_path / "lake")).collect()}
    assert got == {"days": ("csv", 1), "orders_2024": ("json", 1)}
    assert {(r["table_name"], r["column_name"]) for r in CR.crawl(spark, str(tmp_path / "lake")).collect()} == {("days", "d"), ("orders_2024", "id")}


TWO = IO.schema_from_json([{"name": "a", "type": "int"}, {"name": "b", "type": "string"}])


def declared(spark, tmp_path, text, **how):
    (tmp_path / "f.csv").write_text(text)
    good, bad = IO.read_declared(spark, str(tmp_path / "f.csv"), TWO, **how)
    return sorted((r["a"], r["b"]) for r in good.collect()), sorted(r["_corrupt_record"] for r in bad.collect())


def test_records_span_lines(spark, tmp_path):
    text = 'a,b\n1,"x\ny"\n2,plain\n3,"say ""hi"",\n\nthere, 4,z"\n5,5" pipe\n6,"q"\n'
    good, bad = declared(spark, tmp_path, text, escape='"')
    assert good == [(1, "x\ny"), (2, "plain"), (3, 'say "hi",\n\nthere, 4,z'), (5, '5" pipe'), (6, "q")] and bad == []
    good, bad = declared(spark, tmp_path, text.replace('""', '\\"'))
    assert good == [(1, "x\ny"), (2, "plain"), (3, 'say "hi",\n\nthere, 4,z'), (5, '5" pipe'), (6, "q")] and bad == []


def test_a_torn_quote_is_one_reject(spark, tmp_path):
    good, bad = declared(spark, tmp_path, 'a,b\n1,"torn\n2,x\n3,"y\nz"\n4,w\n')
    assert good == [(2, "x"), (4, "w")] and bad == ['1,"torn', '3,"y', 'z"']
    good, bad = declared(spark, tmp_path, 'a,b\n1,x\n2,"torn\n3,z\n')
    assert good == [(1, "x"), (3, "z")] and bad == ['2,"torn']
    text = 'a,b\n1,"torn\n' + "".join(f"{k},v\n" for k in range(2, 30)) + '30,"x\ny"\n'
    good, bad = declared(spark, tmp_path, text, max_lines=5)
    assert len(good) == 29 and good[-1] == (30, "x\ny") and bad == ['1,"torn']


def test_a_header_in_another_order_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="declared columns are a,b"):
        declared(spark, tmp_path, "b,a\nx,1\n")


def test_records_over_splits(spark, tmp_path):
    """Small splits: records that begin in one and end in another."""
    rows = [(k, f"line {k}\n" * (k % 4) + "end") for k in range(400)]
    text = "a,b\n" + "".join(f'{k},"{v}"\n' for k, v in rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        good, bad = declared(spark, tmp_path, text)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert good == rows and bad == []
