"""Rules that oracle and implementation could get wrong alike, on hand-made rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL

from strata.functions.numeric import money
from strata.operators import clean as C
from strata.operators import costs as CO
from strata.operators import governance as G
from strata.operators import joins as J
from strata.operators import marts as M
from strata.operators import quality as Q
from strata.operators import storage as ST
from strata.operators import telemetry as TL
from strata.sources import io as IO
from strata.sources.publish import read_published
from strata.streaming import jobs as S


def costs(spark, rows):
    return spark.createDataFrame([(dt.date(2024, 1, d), s, D(a), p) for d, s, a, p in rows],
                                 "date date, service string, amount decimal(18,6), project string")


def test_sums_are_compared_before_they_are_rounded(spark):
    c = costs(spark, [(1, "a", "0.004", "x"), (1, "b", "0.012", "x"), (1, "c", "9.987", "y")])
    assert {r["service"] for r in CO.cost_by_service(c, "2024-01-01", dt.date(2024, 1, 2)).collect()} == {"a", "b", "c"}
    assert {r["service"] for r in CO.top_services(c, dt.date(2024, 1, 2)).collect()} == {"b", "c"}
    r = CO.daily_cost_alert(c, "10").first()
    assert (r["total_cost"], r["alert"], r["breakdown"]) == (D("10.00"), True, "c:9.99, b:0.01")
    assert CO.daily_cost_alert(c, "10", project="x").first()["total_cost"] == D("0.02")


def test_budget_alerts_are_greater_than(spark):
    c = costs(spark, [(1, "a", "80", "x"), (2, "a", "20", "x"), (3, "a", "0.01", "x")])
    got = {r["date"].day: (r["crosses_80"], r["crosses_100"]) for r in CO.budget_running(c, "100").collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True)}
    at = lambda day: CO.budget_status(c, dt.date(2024, 1, day), "100").first()
    assert not at(2)["actual_80"] and at(3)["actual_80"] and not at(3)["actual_100"] and at(4)["actual_100"]


def test_anomaly_window_is_calendar_days(spark):
    c = costs(spark, [(1, "a", "1", "x"), (2, "a", "1", "x"), (3, "a", "1.1", "x"), (28, "a", "50", "x")])
    got = {r["date"].day: (r["trailing_days"], r["is_anomaly"]) for r in CO.cost_anomaly(c).collect()}
    assert got[28] == (0, False) and got[3] == (2, True)


def test_cluster_filters(spark):
    t = dt.datetime(2024, 1, 1)
    runs = spark.createDataFrame([(1, "etl-a", "RUNNING", t), (2, "etl-b", "TERMINATED", t), (3, "web", "WAITING", t)],
                                 "id int, name string, state string, creation_time timestamp_ntz")
    assert [r["id"] for r in CO.cluster_run_cost(runs, dt.datetime(2024, 1, 2), name_prefix="etl").collect()] == [1]


def test_versions_are_not_delete_markers(spark):
    o = spark.createDataFrame([("b", True), ("b", False), ("b", False)], "bucket string, is_delete_marker boolean")
    assert ST.version_counts(o).first().asDict() == {"bucket": "b", "versions": 2, "delete_markers": 1, "live_versions": 2}


def test_age_is_whole_days_before_as_of(spark):
    o = spark.createDataFrame([("b", "k", "clean", dt.datetime(2024, 1, 1, 12))], "bucket string, key string, layer string, modified timestamp_ntz")
    tier = lambda *at: ST.lifecycle_tier(ST.with_age(o, dt.datetime(*at))).first()
    assert (tier(2024, 1, 31, 11)["age_days"], tier(2024, 1, 31, 11)["target_tier"]) == (29, "STANDARD")
    assert (tier(2024, 1, 31, 12)["age_days"], tier(2024, 1, 31, 12)["target_tier"]) == (30, "STANDARD_IA")


def test_spans_of_two_traces_with_equal_ids(spark):
    t = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("t1", 1, None, D(10), t), ("t1", 2, 1, D(4), t), ("t2", 1, None, D(20), t), ("t2", 2, 1, D(5), t), ("t2", 3, 9, D(1), t)],
                              "trace_id string, span_id int, parent_span_id int, duration_ms decimal(12,2), start_time timestamp_ntz")
    got = {(r["trace_id"], r["span_id"]): (r["n_children"], r["self_time_ms"], r["is_orphan"]) for r in TL.span_parenting(s).collect()}
    assert got == {("t1", 1): (1, D(6), False), ("t1", 2): (0, D(4), False), ("t2", 1): (1, D(15), False), ("t2", 2): (0, D(5), False), ("t2", 3): (0, D(1), True)}


def test_short_values_are_masked_whole(spark):
    df = spark.createDataFrame([("1234", "a@b"), ("12", "a@b"), ("000-00-1234", None)], "sensitive_ssn string, email string")
    assert [r["sensitive_ssn"] for r in G.apply_policy(df, "analyst").collect()] == ["****", "**", "***-**-1234"]
    plain, salted = (G.apply_policy(df, "analyst", salt=s).first()["email"] for s in ("", "pepper"))
    assert plain != salted and len(salted) == 64


def test_totals_beyond_18_digits(spark):
    df = spark.range(100).select(F.lit(D("9999999999999999.99")).cast("decimal(18,2)").alias("x"))
    assert df.agg(money(F.sum("x")).alias("t")).first()["t"] == D("999999999999999999.00")


@pytest.mark.parametrize("block", [1_000, 50])
def test_pairs_of_a_large_order(spark, block):
    rows = [(1, p) for p in range(300)] + [(2, 5), (2, 7), (2, 7), (3, 9)]
    items = spark.createDataFrame(rows, "order_id int, product_id int")
    got = {(r["product_a"], r["product_b"]): r["pair_count"] for r in J.basket_pairs(items, block_lines=block).collect()}
    assert len(got) == 300 * 299 // 2 and got[5, 7] == 2 and sum(got.values()) == len(got) + 1
    wide = M.cross_sell({"order_items": items}).where("product_a = 5 AND product_b = 7").first()
    assert (wide["support"], wide["confidence"], wide["lift"]) == (D("0.666667"), D("1.000000"), D("1.500000"))


def test_summary_with_text_ids(spark):
    c = spark.createDataFrame([("s", 1, D(5))], "customer_segment string, total_orders long, total_revenue decimal(38,6)")
    p = spark.createDataFrame([("PROD-002", "b", 1, D(5)), ("PROD-001", "a", 1, D(5)), ("PROD-000", "z", 1, D(1))],
                              "product_id string, product_name string, total_quantity_sold long, total_revenue decimal(38,6)")
    m = spark.createDataFrame([(D(5), 1)], "total_revenue decimal(38,6), total_transactions long")
    assert M.summary_report(c, p, m).first()["top_selling_product"] == "a"


def test_referential_check(spark):
    one = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} int")
    t = {"customers": one("customer_id", [1, 2, 3]), "products": one("product_id", [1, 2]),
         "orders": spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, None)], "order_id int, customer_id int"),
         "order_items": spark.createDataFrame([(1, 1), (1, 5), (8, 1)], "order_id int, product_id int")}
    got = {r["check_name"]: r["orphan_count"] for r in Q.orphans(t).collect()}
    assert got == {"orders_without_customer": 2, "customers_without_orders": 2, "items_without_order": 1, "orders_without_items": 3,
                   "items_without_product": 1, "products_without_sales": 1}


def test_declared_rows_do_not_depend_on_the_columns_read(spark):
    path = S.scratch(spark, "declared")
    spark.createDataFrame([(x,) for x in ("a,b,c", "1,2,x", "2,bad,y", "3,4,z,EXTRA", "5,6,")], "value string").coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("c", T.StringType())])
    good, bad = IO.read_declared(spark, path, schema)
    assert [r["a"] for r in good.orderBy("a").collect()] == [1, 5]
    assert [r["a"] for r in good.select("a").orderBy("a").collect()] == [1, 5]
    assert (good.count(), bad.count()) == (2, 2)
    assert sorted(r[0] for r in bad.select("_corrupt_record").collect()) == ["2,bad,y", "3,4,z,EXTRA"]


def test_partitioned_write_splits_a_large_value(spark):
    path = S.scratch(spark, "skewed")
    df = spark.range(400_000).select(F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 5).alias("k"), F.md5(F.col("id").cast("string")).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        IO.write_table(df.repartition(8), path, partition_by=["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.parquet(path).select("k", F.input_file_name().alias("f")).distinct().groupBy("k").count()
    assert files.where("k = 1").first()["count"] > 3


def test_ingest_repeats_no_row_and_keeps_rejects(spark):
    root = S.scratch(spark, "ingest")
    schema = "order_id int, customer_id int, total_amount decimal(12,2)"
    rows = [(1, 1, D(5)), (2, None, D(5)), (3, 1, D(0))]
    want = spark.createDataFrame([], schema).schema
    assert S.read_sink(spark, f"{root}/out", want).collect() == []
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/in")
        for _ in range(2):  # started again with nothing new
            S.stream_ingest(S.file_stream(spark, f"{root}/in", want), f"{root}/out", f"{root}/ckpt", C.default_rules("orders")).awaitTermination()
    assert [r["order_id"] for r in S.read_sink(spark, f"{root}/out", want).collect()] == [1]
    bad = S.read_sink(spark, f"{root}/out-rejected", S.with_reasons(want)).collect()
    assert {r["order_id"]: r["violations"] for r in bad} == {2: ["null_customer_id"], 3: ["non_positive_amount"]}


def test_an_order_that_comes_twice_is_ingested_once(spark):
    """The second copy comes in another file, after a restart."""
    root, schema = S.scratch(spark, "twice"), "order_id int, customer_id int, total_amount decimal(12,2)"
    want = spark.createDataFrame([], schema).schema
    for part in ([(1, 1, D(5)), (1, 1, D(5)), (2, 1, D(6))], [(1, 1, D(5)), (3, 1, D(7))]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/in")
        S.stream_ingest(S.file_stream(spark, f"{root}/in", want), f"{root}/out", f"{root}/ckpt", C.default_rules("orders"), key=["order_id"]).awaitTermination()
    assert sorted(r["order_id"] for r in S.read_sink(spark, f"{root}/out", want).collect()) == [1, 2, 3]


def test_lifecycle_rules_are_a_table(spark):
    o = spark.createDataFrame([("b", a, 10, "clean", a) for a in (0, 4, 5, 9, 10, 400)] + [("b", 7, 10, "raw", 3), ("b", 8, 10, None, None)], "bucket string, key int, size bigint, layer string, age_days int")
    rules = ST.lifecycle_rules(spark, [("clean", 5, "transition", "COLD"), ("clean", 10, "expire", "EXPIRED")])
    got = {r["key"]: (r["target_tier"], r["action"]) for r in ST.lifecycle_tier(o, rules).collect()}
    none = ("STANDARD", "none")
    assert got == {0: none, 4: none, 5: ("COLD", "transition"), 9: ("COLD", "transition"), 10: ("EXPIRED", "expire"), 400: ("EXPIRED", "expire"), 7: none, 8: none}
    assert {(r["layer"], r["action"]): r["object_count"] for r in ST.lifecycle_summary(o, rules).collect()}["clean", "expire"] == 2


def test_late_samples_stay_out_of_closed_windows(spark):
    root, at = S.scratch(spark, "late"), lambda m, s=0: dt.datetime(2024, 1, 1, 0, m, s)
    schema = "namespace string, name string, value decimal(12,2), unit string, dimensions map<string,string>, timestamp timestamp_ntz"
    row = lambda t, v: ("n", "m", D(v), "Count", {"b": "2", "a": "1"}, t)
    for part in ([row(at(0), 1)], [row(at(10), 1)], [row(at(0, 30), 7), row(at(20), 1)], [row(at(30), 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{root}/in")
        stream = S.metric_windows(S.file_stream(spark, f"{root}/in", spark.createDataFrame([], schema).schema))
        S.append_to_parquet(stream, f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = {r["window_start"].minute: (r["samples"], r["dimensions"]) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got[0] == (1, "a=1,b=2") and got[10][0] == 1


def test_raw_files_to_marts(spark):
    """Mixed dates, an extra field and text ids, from CSV files to written marts."""
    from strata.plans.pipeline import run_pipeline
    from strata.sources.files import RAW_COLUMNS, FileTables

    base, out = S.scratch(spark, "raw"), S.scratch(spark, "marts")
    lines = {
        "customers": ["1,Taro,Tanaka, T@E.com ,,1-1,Tokyo,Tokyo,100-0001,Japan,2023-01-01,,vip,123-45-6789", "2,John,Smith,j@e.com,555,a,NYC,NY,10001,USA,2023-02-01,2024-01-01,Premium,1"],
        "orders": ["ORD-1,1,2024-01-09 10:00:00,完了,card,a,b,100.50,1,2,3,JPY", "ORD-2,2,01/09/2024 12:15,shipped,card,a,b,50,0,0,0,USD",
                   "ORD-3,1,Jan 14 2024 16:30,キャンセル,card,a,b,70,0,0,0,JPY", "ORD-4,x,2024-01-01 00:00:00,shipped,card,a,b,1,0,0,0,USD"],
        "order_items": ["I1,ORD-1,PROD-1,2,30,60,6,completed", "I2,ORD-1,PROD-2,1,40,40,0,completed", "I3,ORD-2,PROD-1,1,30,30,0,shipped", "I4,ORD-3,PROD-2,1,40,40,0,cancelled"],
        "products": ["PROD-1,Phone,Tech,Phone,B,30,20,0.1,1x1,red,S,glass,d,5,10,S1,2023-01-01", "PROD-2,Case,Tech,Case,B,40,10,0.1,1x1,red,S,glass,d,50,10,S1,2023-01-01",
                     "PROD-7,Bad,Tech,Case,B,40,10,0.1,1x1,red,S,glass,d,50,10,S1,2023-01-01,EXTRA"]}
    for name, rows in lines.items():
        head = ",".join(c for c, _ in RAW_COLUMNS[name])
        spark.createDataFrame([(x,) for x in [head, *rows]], "value string").coalesce(1).write.text(f"{base}/{name}.csv")
    t = FileTables(spark, base)
    assert {n: t.rejected(n).count() for n in lines} == {"customers": 0, "orders": 1, "order_items": 0, "products": 1}
    res = run_pipeline(spark, base, out, "a", tables=t)
    assert res.metrics["monthly_sales_row_count"] == 2 and res.metrics["product_analytics_row_count"] == 2
    months = {(r["order_year"], r["order_month"], r["currency"]): r["total_revenue"] for r in read_published(spark, out, "monthly_sales").collect()}
    assert months == {(2024, 1, "JPY"): D("100.50"), (2024, 1, "USD"): D("50.00")}
    assert run_pipeline(spark, base, S.scratch(spark, "marts-b"), "b", tables=t).success


def test_dates_of_no_known_format_are_rejected_by_name(spark):
    rows = [(1, "2024-01-05 10:00:00"), (2, "01/05/2024 10:00"), (3, "Jan 5 2024 10:00"), (4, "5. Januar"), (5, None), (6, ""), (7, "2024-01-05")]
    df = spark.createDataFrame(rows, "order_id int, order_date string")
    valid, rejected = C.split_by_rules(df, [C.date_rule()])
    assert sorted(r["order_id"] for r in valid.collect()) == [1, 2, 3]
    assert {r["order_id"]: r["violations"] for r in rejected.collect()} == {i: ["bad_order_date"] for i in (4, 5, 6, 7)}
    kept = C.parse_dates(df, "order_date")
    assert sorted(r["order_id"] for r in kept.where("order_date IS NOT NULL").collect()) == [1, 2, 3]
    typed = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (2, None)], "order_id int, order_date date")
    assert [r["order_id"] for r in C.split_by_rules(typed, [C.date_rule()])[0].collect()] == [1]


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(" Exchange " in line for line in plan.splitlines())


def test_lines_of_job_b_meet_their_orders_without_a_shuffle(spark):
    """Clean orders and lines lie in the same buckets, each line once."""
    from strata.plans import pipeline as P

    class Twice:
        def __init__(self, t):
            self.t, self.orders, self.priced_items = t, t.orders.unionByName(t.orders), t.priced_items.unionByName(t.priced_items)

        def __getattr__(self, name):
            return getattr(self.t, name)

    t, out, found = P.Tables(spark, SF_SMALL), S.scratch(spark, "buckets"), []

    def build(T):
        found.append(exchanges(T["order_items"].hint("merge").join(T["orders"], "order_id").select("order_id", "customer_id", "quantity")))
        return M.customer_profile(T)
    res = P.run_pipeline(spark, SF_SMALL, out, "b", tables=Twice(t), marts={**P.MARTS_B, "customer_analytics": (build, *P.MARTS_B["customer_analytics"][1:])})
    assert res.success and found == [0]
    plain = C.clean_all(t, "b")
    for name, mart in (("clean/order_items", plain["order_items"]), ("clean/orders", plain["orders"]), ("monthly_sales", M.monthly_category_sales(plain)),
                       ("customer_analytics", M.customer_profile(plain)), ("product_analytics", M.product_profile(plain))):
        rows = lambda df: sorted(map(str, df.select(*mart.columns).collect()))  # noqa: B023, E731
        got = read_published(spark, out, name)
        assert rows(got.select(*[F.col(c).cast(k) for c, k in mart.dtypes])) == rows(mart), name
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("strata_run_")]


def test_clean_orders_are_shuffled_once_for_a_join(spark):
    """Copies fall away in the partitioning that the join on the key needs."""
    rows = [(1, 5, "completed", D("2.00"))] * 3 + [(2, 5, "x", D("0.00")), (None, 6, "x", D("1.00")), (3, 6, "pending", D("1.00")), (3, 7, "pending", D("1.00"))]
    o = spark.createDataFrame(rows, "order_id int, customer_id int, order_status string, total_amount decimal(12,2)").withColumn(
        "order_date", F.lit("2024-01-05 10:00:00"))
    i = spark.createDataFrame([(1, 4), (1, 9), (3, 1), (8, 1)], "order_id int, q int")
    clean = C.clean_orders(o, "b")
    assert sorted((r["order_id"], r["customer_id"]) for r in clean.collect()) == [(1, 5), (3, 6), (3, 7)]
    joined = i.hint("merge").join(clean, "order_id").select("order_id", "customer_id", "q")
    assert exchanges(joined) == 2
    assert sorted(map(tuple, joined.collect())) == [(1, 5, 4), (1, 5, 9), (3, 6, 1), (3, 7, 1)]


def test_records_shuffle_the_text_once(spark, tmp_path):
    """The text of all lines is dealt out once, whatever the records look like."""
    from strata.sources.records import records
    path = str(tmp_path / "r.csv")
    with open(path, "w") as f:
        f.write('a,"x\ny",1\nb,z,2\nc,"torn\nd,w,3\n' + 'e,"p\n\nq",4\n')
    df = records(spark, path, max_lines=3)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.where("value != 'a'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    # Splits, odd lines, text and held lines' records: eight before, three of them with the text.
    assert sum(" Exchange " in line for line in plan.splitlines()) <= 4, plan
    assert sorted((r["value"], r["whole"]) for r in df.collect()) == sorted(
        [('a,"x\ny",1', True), ("b,z,2", True), ('c,"torn', False), ("d,w,3", True), ('e,"p', False), ("", True), ('q",4', True)])
