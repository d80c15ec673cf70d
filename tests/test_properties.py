"""Properties on the driver tables (sf0.001)."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strata.operators import clean as C
from strata.operators import costs as CO
from strata.operators import governance as G
from strata.operators import marts as M
from strata.sources import adapters as AD
from strata.sources.adapters import AS_OF, Tables


@pytest.fixture(scope="module")
def T(spark):
    return C.clean_all(Tables(spark, SF_SMALL), "a")


def test_monthly_total_equals_live_orders_with_items(spark, T):
    m3 = M.monthly_sales(T).agg(F.sum("total_revenue")).first()[0]
    live = (T["orders"].where(F.col("order_status") != "cancelled")
            .join(T["order_items"].select("order_id").distinct(), "order_id", "left_semi")
            .agg(F.sum("total_amount")).first()[0])
    assert m3 == live


def test_customer_mart_has_every_customer(spark, T):
    assert M.customer_analytics(T).count() == T["customers"].count()


def test_quarantine_partitions_input(spark):
    df = Tables(spark, SF_SMALL).orders
    valid, rejected = C.split_by_rules(df, C.default_rules("orders"))
    assert valid.count() + rejected.count() == df.count()


def test_masking_never_shows_raw_ssn(spark, T):
    raw = {r["customer_id"]: r["sensitive_ssn"] for r in T["customers"].collect()}
    for r in G.apply_policy(T["customers"], "analyst").collect():
        assert r["sensitive_ssn"] != raw[r["customer_id"]]
        assert r["sensitive_ssn"].endswith(raw[r["customer_id"]][-4:])
        assert r["sensitive_ssn"].startswith("***-**-")
    assert "sensitive_ssn" not in G.apply_policy(T["customers"], "viewer").columns


def test_access_denied_outside_layers(spark, T):
    with pytest.raises(G.AccessDenied):
        G.read_as("analyst", "raw", T["customers"])


def test_cost_by_service_sums_to_daily_trend(spark):
    costs = AD.cost_lines(spark, SF_SMALL)
    a = CO.cost_by_service(costs, "2024-01-24", AS_OF).agg(F.sum("total_cost")).first()[0]
    b = CO.cost_daily_trend(costs, AS_OF, 7).agg(F.sum("daily_cost")).first()[0]
    assert a == b


def test_registry_unknown_name_lists_known():
    from strata.plans import registry
    import strata.plans.pipeline  # noqa: F401  (registers the jobs)
    with pytest.raises(KeyError) as e:
        registry.get("nope")
    assert "ecommerce_analytics_a" in str(e.value)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.queries()) >= set(E.oracle_sql())


def test_tasks_grow_with_rows(spark, monkeypatch):
    """Pairs and the product mart: more rows get more tasks, and the same results."""
    from datetime import date
    from decimal import Decimal

    from strata.operators import joins as J
    from strata.operators import marts as M

    rows = [(o, (o * 7 + k * k) % 23, k + 1, Decimal(o + k), Decimal(k)) for o in range(90) for k in range(1 + o % 6)]
    rows += rows[:20] + [(None, 1, 1, Decimal(1), Decimal(0)), (5, None, 1, Decimal(1), Decimal(0))]
    items = spark.createDataFrame(rows, "order_id long, product_id long, quantity long, total_price decimal(12,2), discount_applied decimal(18,6)")
    orders = spark.createDataFrame([(o, o % 11, "cancelled" if o % 9 == 0 else "completed", date(2024, 1, 1)) for o in range(85)],
                                   "order_id long, customer_id long, order_status string, order_date date")
    products = spark.createDataFrame([(p, f"n{p}", "c", "s", "b", Decimal(p)) for p in range(22)],
                                     "product_id long, product_name string, category string, subcategory string, brand string, price decimal(10,2)")
    T = {"order_items": items.where("order_id IS NOT NULL AND product_id IS NOT NULL"), "orders": orders, "products": products}
    few = [sorted(map(tuple, f().collect())) for f in (lambda: J.basket_pairs(T["order_items"]), lambda: M.cross_sell(T), lambda: M.product_analytics(T))]
    monkeypatch.setattr(J, "ROWS_PER_TASK", 10)
    many = [sorted(map(tuple, f().collect())) for f in (lambda: J.basket_pairs(T["order_items"]), lambda: M.cross_sell(T), lambda: M.product_analytics(T))]
    assert few == many
    baskets = {}
    for o, p, *_ in rows:
        if o is not None and p is not None:
            baskets.setdefault(o, set()).add(p)
    want = {}
    for b in baskets.values():
        for x in b:
            for y in b:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    assert {(a, b): n for a, b, n in many[0]} == want
    n_pairs = sum(len(b) * (len(b) + 1) // 2 for b in baskets.values())
    assert J.basket_pairs(T["order_items"]).rdd.getNumPartitions() == -(-n_pairs // 10)
    assert J.basket(T["order_items"]).rdd.getNumPartitions() == -(-(len(rows) - 2) // 10)
