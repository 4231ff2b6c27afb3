"""Small tables with known defects, made by Spark expressions from the row number."""

from pyspark.sql import functions as F

# Goods, spellings of countries that the cleaning knows, ways to pay and to write a flag.
GOODS = ("teapot", "wool blanket", "garden shears", "oak shelf", "bicycle bell", "candle", "rain coat")
PLACES = ("Sweden", "uk", "Deutschland", "France", "SWEDEN", "UK", "Netherlands", "Germany", "france")
WAYS = ("cash", "card", "invoice")
FLAGS = ("0", "True", "1", "False")


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def sales(spark, n=500):
    """Raw sales, all text but the quantity. Rows whose number ends in 37 take the id of the row before; every
    ninth price has a sign; odd rows write the day first; every 21st discount is blank; every 150th quantity is negative."""
    i = F.col("id")
    day = F.date_add(F.lit("2023-03-01").cast("date"), (i * 11 % 300).cast("int"))
    price = F.format_string("%d.%02d", 2 + i * 17 % 240, i * 31 % 100)
    return spark.range(n).coalesce(1).select(
        F.concat(F.lit("sale-"), F.lpad(F.when(i % 100 == 37, i - 1).otherwise(i).cast("string"), 6, "0")).alias("transaction_id"),
        F.concat(F.lit("C"), (100 + i * 7 % 83).cast("string")).alias("customer_id"), _pick(GOODS, i * 5).alias("product_name"),
        F.when(i % 150 == 149, F.lit(-2)).otherwise(1 + i % 6).cast("long").alias("quantity"),
        F.when(i % 9 == 4, F.concat(F.lit("£"), price)).otherwise(price).alias("unit_price_gbp"),
        F.when(i % 2 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("transaction_date"),
        _pick(PLACES, i).alias("country"), _pick(WAYS, i * 2).alias("payment_method"),
        F.when(i % 21 == 20, F.lit("")).otherwise((i % 29).cast("string")).alias("discount_pct"), _pick(FLAGS, i * 3).alias("is_returned"))


def sample_rows():
    """Twenty clean sales rows."""
    return [dict(transaction_id=f"sale-{k:03d}", quantity=2 * k + 1, unit_price_gbp=f"£{3 * k + 1}.25", transaction_date=f"2023-06-{30 - k}",
                 discount_pct=k / 4, is_returned=("False", "True")[k % 2]) for k in range(20)]
