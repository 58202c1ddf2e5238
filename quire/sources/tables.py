"""The tables that queries read, and inputs derived from them by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def invoice_fields(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, fields)``: an invoice for each line item; every 11th order's total is off by one,
    every 13th lacks the tax, odd orders write decimals with a comma."""
    item = table(spark, folder, "lineitem")
    down = lambda c: F.floor(c * 100).cast("double") / 100
    net = down(F.col("l_extendedprice"))
    tax = down(net * F.col("l_tax"))
    total = net + tax + F.when(F.col("l_orderkey") % 11 == 0, 1.0).otherwise(0.0)
    comma = F.col("l_orderkey") % 2 == 1
    written = lambda c: F.when(comma, F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))).otherwise(F.format_string("%.2f", c))
    tva = F.when(F.col("l_orderkey") % 13 == 0, F.lit("")).otherwise(written(tax))
    fields = F.create_map(F.lit("total_ht"), written(net), F.lit("montant_tva"), tva, F.lit("total_ttc"), written(total))
    return item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), fields.alias("fields"))


#: The same in SQL.
INVOICES = """
base AS (SELECT l_orderkey, l_linenumber, l_tax, floor(l_extendedprice * 100) / 100 AS ht FROM lineitem),
inv AS (SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_orderkey, ht, floor(ht * l_tax * 100) / 100 AS tva,
          ht + floor(ht * l_tax * 100) / 100 + CASE WHEN l_orderkey % 11 = 0 THEN 1.0 ELSE 0.0 END AS ttc FROM base)
"""


def date_fields(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, fields)``: an issue date and one three years later, up to three days off; orders
    divisible by 17 have no issue date, those by 19 one that can't be read."""
    orders = table(spark, folder, "orders")
    issue = F.to_date("o_orderdate")
    end = F.date_add(F.add_months(issue, 36), (F.col("o_orderkey") % 7 - 3).cast("int"))
    written = F.when(F.col("o_orderkey") % 17 == 0, F.lit("")).when(F.col("o_orderkey") % 19 == 0, F.lit("2024-02-31")).otherwise(issue.cast("string"))
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.create_map(F.lit("issue"), written, F.lit("end"), end.cast("string")).alias("fields"))


DATES = """
dates AS (SELECT o_orderkey AS doc_id, o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 AS unread, CAST(o_orderdate AS DATE) AS issue,
            CAST(CAST(o_orderdate AS DATE) + INTERVAL 36 MONTH AS DATE) + CAST(o_orderkey % 7 - 3 AS INTEGER) AS ending,
            CAST(CAST(o_orderdate AS DATE) + INTERVAL 36 MONTH AS DATE) AS due
          FROM orders)
"""


def layout_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Per order, a label for each line item and a value below and to the right of it."""
    item = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    k = F.col("l_linenumber")
    x = k * 100.0
    line = lambda no, words, x0, y0: F.struct(no.alias("line_no"), words.alias("text"), x0.alias("x0"), y0.alias("y0"), (x0 + 80).alias("x1"), (y0 + 20).alias("y1"))
    rows = F.array(
        line(k * 3, F.concat(F.lit("label "), k.cast("string")), x, F.lit(100.0)),
        line(k * 3 + 1, F.concat(F.lit("below "), k.cast("string")), x + k, F.lit(130.0) + k),
        line(k * 3 + 2, F.concat(F.lit("right "), k.cast("string")), x + 85, F.lit(100.0) + k * 3),
    )
    each = item.select(F.col("l_orderkey").alias("doc_id"), F.explode(rows).alias("l"))
    return each.select("doc_id", "l.*", F.lit(0).alias("page_index"), F.lit(1000.0).alias("page_width"), F.lit(500.0).alias("page_height"), F.lit(None).cast("double").alias("confidence"))


LAYOUT = """
item AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS k FROM lineitem),
layout AS (
  SELECT doc_id, k * 3 AS line_no, 'label ' || k AS text, k * 100.0 AS x0, 100.0 AS y0, k * 100.0 + 80 AS x1 FROM item
  UNION ALL SELECT doc_id, k * 3 + 1, 'below ' || k, k * 100.0 + k, 130.0 + k, k * 100.0 + k + 80 FROM item
  UNION ALL SELECT doc_id, k * 3 + 2, 'right ' || k, k * 100.0 + 85, 100.0 + k * 3, k * 100.0 + 165 FROM item)
"""


def mrz_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer, a card's two-line zone, the birth check digit spoiled for every fifth, and a recto
    whose name differs for every seventh and is missing for every eleventh."""
    from quire.functions import mrz

    customer = table(spark, folder, "customer")
    key = F.col("c_custkey")
    number = F.format_string("%012d", key)
    birth = F.format_string("%02d%02d%02d", key % 100, key % 12 + 1, key % 28 + 1)
    first = F.rpad(F.concat(F.lit("IDFRA"), F.translate(F.upper("c_name"), "#0123456789", "XABCDEFGHIJ")), 36, "<")
    digit = F.when(key % 5 == 0, (mrz.check_digit(birth) + 1) % 10).otherwise(mrz.check_digit(birth))
    head = F.concat(number, mrz.check_digit(number).cast("string"), F.rpad(F.lit("ANNE<MARIE"), 14, "<"), birth, digit.cast("string"), F.when(key % 2 == 0, "F").otherwise("M"))
    second = F.concat(head, mrz.check_digit(F.concat(first, head)).cast("string"))
    name = F.translate(F.initcap("c_name"), "#0123456789", "xabcdefghij")
    nom = F.when(key % 11 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.concat(name, F.lit("X"))).otherwise(name)
    recto = F.create_map(F.lit("nom"), nom, F.lit("prenoms"), F.lit("Anne-Märie"))
    return customer.select(key.alias("doc_id"), F.array(first, second).alias("lines"), recto.alias("recto"))
