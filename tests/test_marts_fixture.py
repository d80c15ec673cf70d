"""Golden values on the hand-made fixtures (grain, status, fan-out, padding)."""

from decimal import Decimal as D

from fixtures import RawTables

from strata.operators import clean as C
from strata.operators import marts as M
from strata.operators import reports as R


def _a(spark):
    return C.clean_all(RawTables(spark), "a")


def test_status_canonicalised(spark):
    T = _a(spark)
    got = {r["order_status"]: r["n"] for r in T["orders"].groupBy("order_status").count()
           .withColumnRenamed("count", "n").collect()}
    assert got == {"completed": 4, "shipped": 1, "processing": 1, "cancelled": 1}


def test_mixed_dates_all_parse(spark):
    T = _a(spark)
    rows = {r["order_id"]: r["order_date"].isoformat() for r in T["orders"].collect()}
    assert rows["ORD-009"] == "2024-01-09"
    assert rows["ORD-014"] == "2024-01-14"
    assert all(v is not None for v in rows.values())


def test_customer_grain_order_vs_item(spark):
    T = _a(spark)
    by_order = {r["customer_id"]: r for r in M.customer_analytics(T, "order").collect()}
    by_item = {r["customer_id"]: r for r in M.customer_analytics(T, "item").collect()}
    # 1001: two orders 1580.50 + 2890.35; ORD-001 has two items (fan-out).
    assert by_order[1001]["total_orders"] == 2
    assert by_order[1001]["total_spent"] == D("4470.85")
    assert by_item[1001]["total_orders"] == 3
    assert by_item[1001]["total_spent"] == D("6051.35")
    # Customer without orders is kept and padded with 0.
    assert by_order[1099]["total_orders"] == 0
    assert by_order[1099]["total_spent"] == D("0.00")
    assert by_order[1099]["last_order_date"] is None
    assert len(by_order) == 5


def test_monthly_excludes_cancelled_and_keeps_currencies(spark):
    T = _a(spark)
    rows = {r["currency"]: r for r in M.monthly_sales(T).collect()}
    assert set(rows) == {"JPY", "USD", "CNY"}
    # JPY: ORD-001, ORD-002, ORD-009 (ORD-006 is cancelled).
    assert rows["JPY"]["total_orders"] == 3
    assert rows["JPY"]["total_revenue"] == D("5381.85")
    assert rows["JPY"]["net_revenue"] == rows["JPY"]["total_revenue"] - rows["JPY"]["total_discounts"]


def test_product_mart_and_top(spark):
    T = _a(spark)
    m2 = M.product_analytics(T)
    top = R.top_products(m2, 1).collect()[0]
    assert top["product_id"] == "PROD-003"
    assert top["total_revenue"] == D("17998.00")
    assert top["unique_customers"] == 1 and top["total_orders"] == 2
    assert "PROD-099" not in {r["product_id"] for r in m2.collect()}


def test_inventory_and_orphans(spark):
    from strata.operators import quality as Q
    T = _a(spark)
    inv = {r["product_id"]: r for r in M.inventory_status(T).collect()}
    assert inv["PROD-020"]["stock_status"] == "low" and inv["PROD-020"]["units_to_reorder"] == 15
    assert inv["PROD-001"]["stock_status"] == "ok" and inv["PROD-001"]["units_to_reorder"] == 0
    o = {r["check_name"]: r["orphan_count"] for r in Q.orphans(T).collect()}
    assert o["customers_without_orders"] == 1
    assert o["products_without_sales"] == 1
    assert o["items_without_product"] == 0  # quantity-0 orphan line was cleaned away


def test_cross_sell_pairs(spark):
    T = _a(spark)
    pairs = {(r["product_a"], r["product_b"]): r["pair_count"] for r in M.cross_sell(T, 1).collect()}
    assert pairs == {("PROD-001", "PROD-020"): 1}
