"""The four commerce tables from raw CSV files under a base path.

Each file is read against its declared columns; rows that do not fit are kept
apart with the raw line (``rejected``).  Cleaning and dates are the clean
layer's business: ``strata.plans.pipeline.run_pipeline`` takes an object of
this class as ``tables``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.io import read_declared, schema_from_json, write_table

_MONEY = "decimal(12,2)"

# The columns of the raw files, in their order.
RAW_COLUMNS = {
    "customers": [("customer_id", "bigint"), ("first_name", "string"), ("last_name", "string"), ("email", "string"), ("phone", "string"),
                  ("address", "string"), ("city", "string"), ("state", "string"), ("zip_code", "string"), ("country", "string"),
                  ("registration_date", "date"), ("last_login", "date"), ("customer_segment", "string"), ("sensitive_ssn", "string")],
    "orders": [("order_id", "string"), ("customer_id", "bigint"), ("order_date", "string"), ("order_status", "string"),
               ("payment_method", "string"), ("shipping_address", "string"), ("billing_address", "string"), ("total_amount", _MONEY),
               ("discount_amount", _MONEY), ("tax_amount", _MONEY), ("shipping_cost", _MONEY), ("currency", "string")],
    "order_items": [("order_item_id", "string"), ("order_id", "string"), ("product_id", "string"), ("quantity", "bigint"),
                    ("unit_price", _MONEY), ("total_price", _MONEY), ("discount_applied", "decimal(18,6)"), ("item_status", "string")],
    "products": [("product_id", "string"), ("product_name", "string"), ("category", "string"), ("subcategory", "string"),
                 ("brand", "string"), ("price", "decimal(10,2)"), ("cost", "decimal(10,2)"), ("weight_kg", "double"), ("dimensions_cm", "string"),
                 ("color", "string"), ("size", "string"), ("material", "string"), ("description", "string"), ("stock_quantity", "int"),
                 ("min_stock_level", "int"), ("supplier_id", "string"), ("launch_date", "date")],
}


class FileTables:
    """Raw tables of ``base``/customers.csv, orders.csv, order_items.csv and
    products.csv (files or folders), built lazily."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _split(self, name: str) -> tuple[DataFrame, DataFrame]:
        schema = schema_from_json([{"name": c, "type": t} for c, t in RAW_COLUMNS[name]])
        return read_declared(self.spark, f"{self.base}/{name}.csv", schema)

    def rejected(self, name: str) -> DataFrame:
        """The rows of a file that do not fit, with the raw line."""
        return self._split(name)[1]

    def write_rejected(self, out_dir: str) -> None:
        for name in RAW_COLUMNS:
            write_table(self.rejected(name), f"{out_dir}/{name}")

    @property
    def customers(self) -> DataFrame:
        full = F.concat_ws(" ", "first_name", "last_name")
        return self._split("customers")[0].withColumns({"customer_name": full, "region": F.col("state")})

    @property
    def orders(self) -> DataFrame:
        return self._split("orders")[0]

    @property
    def order_items(self) -> DataFrame:
        """With the share of the line's value that was taken off."""
        value = F.col("quantity") * F.col("unit_price")
        share = F.coalesce(F.try_divide("discount_applied", value), F.lit(0)).try_cast("decimal(5,4)")
        return self._split("order_items")[0].withColumn("discount", share)

    @property
    def priced_items(self) -> DataFrame:
        return self.order_items

    @property
    def products(self) -> DataFrame:
        return self._split("products")[0].withColumn("supplier", F.col("supplier_id"))
