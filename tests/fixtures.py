"""Small in-repo fixtures shaped like the raw commerce files.

Values follow the documented sample shapes: Japanese and English status
text, three currencies, an order with two items (fan-out), a cancelled
order of amount 0, a customer without orders, a product without sales, a
NULL phone, mixed date formats.
"""

from decimal import Decimal as D

from pyspark.sql import types as T

CUSTOMERS = [
    # customer_id, first_name, last_name, email, phone, country, region, customer_segment, sensitive_ssn
    (1001, "Taro", "Tanaka", " Tanaka.Taro@Email.com ", "03-1234-5678", "Japan", "ASIA", "vip", "123-45-6789"),
    (1002, "Hanako", "Sato", "sato.hanako@email.com", None, "Japan", "ASIA", "Premium", "234-56-7890"),
    (1006, "Jiro", "Kato", "kato@email", "03-0000-0000", "Japan", "ASIA", "Standard", "345-67-8901"),
    (1011, "John", "Smith", "john.smith@email.com", "555-0101", "USA", "AMERICA", "VIP", "456-78-9012"),
    (1099, "No", "Orders", "no.orders@email.com", None, "USA", "AMERICA", "Standard", "567-89-0123"),
]
CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customer_id", T.LongType()), T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("phone", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("region", T.StringType()), T.StructField("customer_segment", T.StringType()),
    T.StructField("sensitive_ssn", T.StringType())])

ORDERS = [
    # order_id, customer_id, order_date text, status, payment, total, discount, tax, shipping, currency
    ("ORD-001", 1001, "2024-01-01 10:30:00", "完了", "credit", D("1580.50"), D("50.00"), D("158.05"), D("15.00"), "JPY"),
    ("ORD-002", 1002, "2024-01-02 14:45:00", "完了", "online", D("2350.75"), D("100.00"), D("235.08"), D("20.00"), "JPY"),
    ("ORD-006", 1006, "2024-01-06 13:45:00", "キャンセル", "credit", D("0.00"), D("0.00"), D("0.00"), D("0.00"), "JPY"),
    ("ORD-009", 1002, "01/09/2024 12:15", "発送済み", "credit", D("1450.60"), D("40.00"), D("145.06"), D("16.00"), "JPY"),
    ("ORD-011", 1011, "2024-01-11 09:30:00", "completed", "paypal", D("1250.99"), D("30.00"), D("125.10"), D("15.00"), "USD"),
    ("ORD-014", 1011, "Jan 14 2024 16:30", "processing", "credit_card", D("3450.25"), D("100.00"), D("345.03"), D("25.00"), "USD"),
    ("ORD-016", 1001, "2024-01-16 13:00:00", "completed", "credit_card", D("2890.35"), D("90.00"), D("289.04"), D("24.00"), "CNY"),
]
ORDER_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()), T.StructField("customer_id", T.LongType()),
    T.StructField("order_date", T.StringType()), T.StructField("order_status", T.StringType()),
    T.StructField("payment_method", T.StringType()), T.StructField("total_amount", T.DecimalType(12, 2)),
    T.StructField("discount_amount", T.DecimalType(12, 2)), T.StructField("tax_amount", T.DecimalType(12, 2)),
    T.StructField("shipping_cost", T.DecimalType(12, 2)), T.StructField("currency", T.StringType())])

ITEMS = [
    # order_item_id, order_id, product_id, quantity, total_price, discount_applied, discount, item_status
    ("OI-001", "ORD-001", "PROD-001", 1, D("7999.00"), D("0.00"), D("0.0000"), "発送済み"),
    ("OI-002", "ORD-001", "PROD-020", 1, D("1899.00"), D("50.00"), D("0.0263"), "発送済み"),
    ("OI-003", "ORD-002", "PROD-003", 1, D("8999.00"), D("100.00"), D("0.0111"), "配送完了"),
    ("OI-004", "ORD-006", "PROD-005", 2, D("1798.00"), D("0.00"), D("0.0000"), "キャンセル"),
    ("OI-005", "ORD-009", "PROD-003", 1, D("8999.00"), D("90.00"), D("0.0100"), "処理中"),
    ("OI-006", "ORD-011", "PROD-005", 3, D("2697.00"), D("0.00"), D("0.0000"), "completed"),
    ("OI-007", "ORD-014", "PROD-020", 1, D("1899.00"), D("0.00"), D("0.0000"), "processing"),
    ("OI-008", "ORD-016", "PROD-001", 1, D("7999.00"), D("0.00"), D("0.0000"), "completed"),
    ("OI-009", "ORD-016", "PROD-404", 0, D("0.00"), D("0.00"), D("0.0000"), "completed"),
]
ITEM_SCHEMA = T.StructType([
    T.StructField("order_item_id", T.StringType()), T.StructField("order_id", T.StringType()),
    T.StructField("product_id", T.StringType()), T.StructField("quantity", T.LongType()),
    T.StructField("total_price", T.DecimalType(12, 2)), T.StructField("discount_applied", T.DecimalType(18, 6)),
    T.StructField("discount", T.DecimalType(5, 4)), T.StructField("item_status", T.StringType())])

PRODUCTS = [
    ("PROD-001", "Phone", " Electronics ", "Smartphone", "Apple", D("7999.00"), D("5999.00"), 150, 20),
    ("PROD-003", "Laptop", "Electronics", "Notebook", "Apple", D("8999.00"), D("6749.00"), 8, 10),
    ("PROD-005", "Shoes", "Fashion", "Shoes", "Nike", D("899.00"), D("449.00"), 300, 50),
    ("PROD-020", "Headphones", "Electronics", "Audio", "Sony", D("1899.00"), D("1299.00"), 5, 20),
    ("PROD-099", "Unsold", "Books", "Novel", "Pub", D("89.00"), D("44.00"), 120, 20),
]
PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()), T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("subcategory", T.StringType()),
    T.StructField("brand", T.StringType()), T.StructField("price", T.DecimalType(10, 2)),
    T.StructField("cost", T.DecimalType(10, 2)), T.StructField("stock_quantity", T.IntegerType()),
    T.StructField("min_stock_level", T.IntegerType())])


class RawTables:
    """Same interface as ``strata.sources.adapters.Tables`` over the fixtures."""

    def __init__(self, spark):
        from strata.functions.dates import parse_dates
        from pyspark.sql import functions as F
        self.customers = spark.createDataFrame(CUSTOMERS, CUSTOMER_SCHEMA).withColumn(
            "registration_date", F.lit("2023-01-15").cast("date"))
        o = spark.createDataFrame(ORDERS, ORDER_SCHEMA)
        self.orders = parse_dates(o, "order_date").withColumn("order_date", F.col("order_date").cast("date"))
        self.order_items = spark.createDataFrame(ITEMS, ITEM_SCHEMA)
        self.products = spark.createDataFrame(PRODUCTS, PRODUCT_SCHEMA)
        self.priced_items = self.order_items.join(
            self.products.select("product_id", F.col("price").alias("unit_price")), "product_id", "left")
