"""Raw leads derived from the orders table, one per order, with all the mess the cleaning has to handle."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from leadlane.operators.clean import as_unit

ORDER_LEADS_SQL = Path(__file__).with_name("order_leads.sql").read_text(encoding="utf-8")


def order_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw leads of ``orders.parquet``.

    Each narrow order becomes a wide row with much work to do, so the orders are dealt out by key first.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    orders = orders.repartition(tasks, "o_orderkey")
    leads = spark.sql(ORDER_LEADS_SQL.replace("FROM orders)", "FROM {orders})"), orders=orders)
    return as_unit(leads)
