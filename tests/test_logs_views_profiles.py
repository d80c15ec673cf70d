"""Log records over splits, role views in SQL, profiles that add up."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from strata.operators import governance as G
from strata.operators import profiles as PR
from strata.sources import catalog as CAT
from strata.sources import logs as L
from strata.streaming.jobs import scratch


def _records(files: list[list[str]], max_lines: int) -> set:
    """What the lines of each file mean, one file after the other."""
    out = set()
    for lines in files:
        heads = [k for k, x in enumerate(lines) if re.match(L.RECORD_START, x)]
        for lo, hi in zip([-1, *heads], [*heads, len(lines)]):
            own = lines[max(lo, 0):hi]
            for part in range(0, len(own), max_lines):
                text = own[part:part + max_lines]
                m = re.match(L.RECORD_START, text[0]) if lo >= 0 and not part else None
                out.add((lo, part // max_lines, *(m.groups()[1:] if m else (None,) * 3), len(text), "\n".join(text)))
    return out


@pytest.mark.parametrize("split", ["64", "300", "128m"])
def test_log_records_over_splits(spark, split):
    r, files = random.Random(7), []
    for _ in range(3):
        lines = ["a line above", ""][:r.randrange(3)]
        for k in range(60):
            lines.append(f"2024-01-{k % 28 + 1:02d} 10:00:{k:02d},{k:03d} - job.{k % 3} - {r.choice(['INFO', 'ERROR'])} - message {k}")
            lines += [r.choice(["  at step", "", "ValueError: é", "2024-01-01 no record"]) for _ in range(r.choice([0, 0, 0, 2, 40]))]
        files.append(lines)
    path = scratch(spark, "logs")
    spark.createDataFrame([("\n".join(x),) for x in files] + [("",)], "value string").repartition(4).write.text(path)
    rows = spark.read.text(path, wholetext=True).collect()
    files = [x["value"].removesuffix("\n").split("\n") for x in rows if x["value"]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = L.log_records(spark, path, max_lines=15)
        assert got.select("file").distinct().count() >= 1
        got = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # A file of several texts is one file: its lines are numbered through.
    assert len(got) == sum(len(_records([x], 15)) for x in files)
    assert {(x["record"], x["part"], x["logger"], x["level"], x["message"], x["n_lines"], x["text"]) for x in got} == _records(files, 15)


def test_log_times(spark):
    path = scratch(spark, "logs")
    lines = ["2024-13-01 00:00:00 - a - INFO - no month", "2024-01-31T23:59:59.123456 - a - INFO - micro", "2024-01-31 23:59:59,5 - a - INFO - "]
    spark.createDataFrame([("\n".join(lines),)], "value string").write.text(path)
    got = {x["message"]: x["log_time"] for x in L.log_records(spark, path).collect()}
    assert got == {"no month": None, "micro": dt.datetime(2024, 1, 31, 23, 59, 59, 123456), "": dt.datetime(2024, 1, 31, 23, 59, 59, 500000)}
    empty = scratch(spark, "logs")
    spark.createDataFrame([], "value string").write.text(empty)
    assert L.log_records(spark, empty).count() == 0


def test_role_views_hold_the_policy(spark):
    base = scratch(spark, "views")
    rows = [(1, "Ann'a@x", "000-00-1234", "EU"), (2, "b@x", "12", "O'US"), (3, None, None, None)]
    spark.createDataFrame(rows, "id int, Email string, ssn string, region string").write.parquet(f"{base}/people")
    spark.createDataFrame([(1, "x")], "id int, note string").write.parquet(f"{base}/notes")
    tag = "gov_" + base.rsplit("-", 1)[-1]
    CAT.create_tables(spark, {t: {"location": f"{base}/{t}"} for t in ("people", "notes")}, tag)
    tables = {f"{tag}.people": "clean", f"{tag}.notes": "raw"}
    policy = {"all": {"layers": ["raw", "clean"]},
              "masked": {"layers": ["clean"], "mask": {"SSN": "last4"}, "hash": ["email"], "rows": {"region": ["O'US", "EU"]}},
              "few": {"layers": ["raw", "clean"], "drop": ["EMAIL", "ssn"], "rows": {"region": ["EU"]}}}
    report = {(r["role"], r["table_name"]): r["reason"] for r in G.role_views(spark, tables, tag, policy).collect()}
    assert [k for k, v in report.items() if v is None] == [("all", "people"), ("all", "notes"), ("masked", "people"), ("few", "people")]
    assert "region" in report["few", "notes"]  # no column to filter rows by: not shown
    masked = {r["id"]: r for r in spark.sql(f"SELECT * FROM {tag}_masked.people").collect()}
    assert sorted(masked) == [1, 2]
    assert masked[1]["ssn"] == "***-**-1234" and masked[2]["ssn"] == "**" and masked[1]["Email"] not in (None, "Ann'a@x")
    assert spark.table(f"{tag}_few.people").columns == ["id", "region"]
    assert spark.sql(f"SELECT count(*) FROM {tag}_masked.people WHERE Email = 'b@x'").first()[0] == 0
    # As apply_policy gives it.
    same = G.apply_policy(spark.table(f"{tag}.people"), "masked", {"masked": policy["masked"] | {"mask": {"ssn": "last4"}, "hash": ["Email"]}})
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, masked.values()))
    # A role that loses a layer loses the view.
    G.role_views(spark, tables, tag, policy | {"all": {"layers": ["raw"]}})
    assert [r["viewName"] for r in spark.sql(f"SHOW VIEWS IN {tag}_all").where("NOT isTemporary").collect()] == ["notes"]
    for db in [tag, *(f"{tag}_{r}" for r in policy)]:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def test_profiles_add_up(spark):
    r = random.Random(3)
    rows = [(None if k % 50 == 0 else f"d{k % 6}", r.randrange(4000), float("nan") if k % 9 == 0 else k / 7, None, f"v{r.randrange(30)}") for k in range(6000)]
    df = spark.createDataFrame(rows, "day string, n long, x double, nothing string, s string")
    path = scratch(spark, "profiles")
    PR.store_profiles(PR.partition_profiles(df.where("day <> 'd5' OR day IS NULL"), "day"), path)
    # One day is late, one is profiled again with all its rows after a part of them.
    PR.store_profiles(PR.partition_profiles(df.where("day = 'd0'").limit(10), "day"), path)
    PR.store_profiles(PR.partition_profiles(df.where("day IN ('d0', 'd5')"), "day"), path)
    stored = spark.read.parquet(path)
    assert stored.groupBy("partition_key").count().count() == 7
    got = {x["column_name"]: x for x in PR.merged_profile(stored).collect()}
    assert {x["total_rows"] for x in got.values()} == {6000}
    n = [x[1] for x in rows]
    assert (got["n"]["min_value"], got["n"]["max_value"]) == (str(min(n)), str(max(n)))
    assert abs(got["n"]["distinct_estimate"] - len(set(n))) <= 4 * 1.04 / 128 * len(set(n))
    below = sum(x < got["n"]["median"] for x in n) / len(n)
    assert abs(below - 0.5) < 0.03
    assert (got["nothing"]["null_count"], got["nothing"]["distinct_estimate"], got["nothing"]["median"], got["nothing"]["min_value"]) == (6000, 0, None, None)
    assert got["s"]["distinct_estimate"] == 30 and got["s"]["median"] is None and got["s"]["min_value"] == "v0"
    assert got["x"]["null_count"] == 0 and got["x"]["median"] == pytest.approx(429, rel=0.05)
    assert PR.merged_profile(PR.partition_profiles(df.where(F.lit(False)), "day")).count() == 0
