"""Product names, canonical rows, gathered rows and a bank of velocities."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import network, robust
from plumbline.session import shared_dir
from plumbline.sources import files

BASE = "products"


def product_index(spark, sf_dir):
    """The clock and position products of each order date."""
    days = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[files.product_path(BASE, F.col("day"), k).alias(n) for k, n in (("hr.tdp", "clock"), ("pos", "position"))])


def canonical_rows(spark, sf_dir):
    """Digests of nations as canonical JSON, a struct in each."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.struct(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("key")).alias("ids"), F.col("n_name").alias("a_name"))
    return files.canonical_json(n).select("json", F.sha2(F.col("json").cast("binary"), 256).alias("sha256"))


def row_gather(spark, sf_dir):
    """Customers' balances in the order that orders ask for them."""
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("row_id"))
    values = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("double").alias("value"))
    return files.gather(wanted, values).select("place", "value")


def velocity_bank(spark, sf_dir):
    """For each nation key, a velocity of the bank of that number of templates."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("template"))
    bank = network.velocity_bank(spark, 25, 100.0, 600.0)
    return n.join(bank, "template").select("template", *[F.round(c, 6).alias(c) for c in ("x", "y", "z")])


def csv_record(spark, sf_dir):
    """Nations written as one CSV file into the shared folder: the record of its bytes."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")
    made = files.write_csv(n.orderBy("n_nationkey").coalesce(1), f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}")
    return made.where("path LIKE '%.csv'").select("byte_count", "sha256")


def draw_quantiles(spark, sf_dir):
    """Quantiles over each order priority's draws (orders) of prices, nulls left out, for two statuses side by side."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", F.when(F.col("o_custkey") % 9 > 0, F.col("o_totalprice").cast("double")).alias("v"))
    out = robust.draw_quantiles(o, "o_orderpriority", "o_orderstatus", ["F", "O"], "v", [0.16, 0.5, 0.84])
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


PLANS = [product_index, canonical_rows, row_gather, velocity_bank, csv_record, draw_quantiles]

#: Digits of the numbers 1 to 25 in bases 2, 3 and 5, written out: five, three and three digits are enough below 27.
_UNIT = {2: range(5), 3: range(3), 5: range(3)}
_H = {b: " + ".join(f"((template + 1) // {b**d} % {b}) / {b ** (d + 1)}::DOUBLE" for d in ds) for b, ds in _UNIT.items()}

SQL = {
    "csv_record": """WITH t AS (SELECT 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10) AS t FROM nation)
 SELECT strlen(t)::BIGINT AS byte_count, sha256(t) AS sha256 FROM t""",
    "draw_quantiles": "WITH o AS (SELECT o_orderpriority, o_orderstatus AS s, CASE WHEN o_custkey % 9 > 0 THEN o_totalprice::DOUBLE END AS v FROM orders) SELECT o_orderpriority, "
    + ", ".join(f"round(quantile_cont(v, {q}) FILTER (s = '{s}'), 4) AS {s}_{int(q * 100)}" for s in "FO" for q in (0.16, 0.5, 0.84))
    + " FROM o GROUP BY 1",
    "product_index": "SELECT strftime(d, '%Y-%m-%d') AS day, 'products/' || year(d) || '/' || strftime(d, '%Y-%m-%d') || '_hr.tdp.gz' AS clock, 'products/' || year(d) || '/' || strftime(d, '%Y-%m-%d') || '.pos.gz' AS position FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders)",
    "canonical_rows": """WITH j AS (SELECT '{"a_name":"' || n_name || '","ids":{"key":' || n_nationkey || ',"region":' || n_regionkey || '}}' AS json FROM nation) SELECT json, sha256(json) AS sha256 FROM j""",
    "row_gather": "SELECT o_orderkey AS place, c_acctbal::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey",
    "velocity_bank": f"""WITH u AS (SELECT n_nationkey::BIGINT AS template, {_H[2]} AS a, {_H[3]} AS b, {_H[5]} AS c FROM nation),
 v AS (SELECT template, exp(ln(100.0::DOUBLE) + a * (ln(600.0::DOUBLE) - ln(100.0::DOUBLE))) AS speed, 2 * b - 1 AS up, 2 * pi() * c AS turn FROM u)
 SELECT template, round(speed * sqrt(greatest(0, 1 - up * up)) * cos(turn), 6) AS x, round(speed * sqrt(greatest(0, 1 - up * up)) * sin(turn), 6) AS y, round(speed * up, 6) AS z FROM v""",
}
