"""Wide daily sales, calendar and weekly prices as CSV, to the canonical long table."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import joined_names
from . import files

IDS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
#: File names, the preferred sales file first.
SALES, CALENDAR, PRICES = ["sales_train_evaluation.csv", "sales_train_validation.csv"], "calendar.csv", "sell_prices.csv"

ADAPTER_VERSION = "retail-csv-1"


def discover(folder: str | Path) -> dict[str, str]:
    """Paths of the three files on any file system; all that are missing are named in one error."""
    at = {n: f"{str(folder).rstrip('/')}/{n}" for n in (*SALES, CALENDAR, PRICES)}
    there = {n: p for n, p in at.items() if files.exists(p)}
    sales = next((n for n in SALES if n in there), None)
    missing = [" or ".join(SALES)] * (sales is None) + [n for n in (CALENDAR, PRICES) if n not in there]
    if missing:
        raise FileNotFoundError(f"missing in {folder}: {', '.join(missing)}")
    return {"sales": there[sales], "calendar": there[CALENDAR], "prices": there[PRICES]}


def header(spark: SparkSession, path: str | Path) -> list[str]:
    return spark.read.option("header", True).csv(str(path)).columns


def day_columns(names: list[str]) -> list[str]:
    """d_1, d_2, ... in numeric order."""
    return sorted((n for n in names if n.startswith("d_") and n[2:].isdigit()), key=lambda n: int(n[2:]))


def read_sales(spark: SparkSession, path: str | Path) -> DataFrame:
    names = header(spark, path)
    kinds = [T.StructField(n, T.DoubleType() if n.startswith("d_") else T.StringType()) for n in names]
    return spark.read.schema(T.StructType(kinds)).option("header", True).csv(str(path))


def read_calendar(spark: SparkSession, path: str | Path, store_id: str) -> DataFrame:
    snap = f"snap_{store_id.split('_')[0]}"
    raw = spark.read.option("header", True).csv(str(path))
    return raw.select("d", F.to_date("date").alias("date"), F.col("wm_yr_wk").cast("int").alias("wm_yr_wk"), "event_name_1", "event_name_2", F.col(snap).cast("int").cast("boolean").alias("snap_eligible"))


def read_prices(spark: SparkSession, path: str | Path) -> DataFrame:
    return spark.read.schema("store_id string, item_id string, wm_yr_wk int, sell_price double").option("header", True).option("enforceSchema", False).csv(str(path))


def first_items(sales: DataFrame, store_id: str, limit: int) -> DataFrame:
    """The first ``limit`` item ids of a store by name."""
    return sales.where(F.col("store_id") == store_id).select("item_id").orderBy("item_id").limit(limit)


def unpivot(wide: DataFrame, ids: list[str], days: list[str]) -> DataFrame:
    return wide.unpivot(ids, days, "d", "quantity_sold")


def canonical(sales: DataFrame, calendar: DataFrame, prices: DataFrame, store_id: str, days: list[str], item_limit: int | None = None) -> DataFrame:
    """The canonical long table of a store; zero cells are kept."""
    wide = sales.where(F.col("store_id") == store_id)
    if item_limit is not None:
        wide = wide.join(first_items(sales, store_id, item_limit), "item_id", "left_semi")
    long = unpivot(wide.select("item_id", "dept_id", "cat_id", "store_id", *days), ["item_id", "dept_id", "cat_id", "store_id"], days)
    # The calendar has a row per day of the files: a few thousand at most.
    both = long.join(F.broadcast(calendar), "d", "left").join(prices, ["store_id", "item_id", "wm_yr_wk"], "left")
    null = lambda kind: F.lit(None).cast(kind)
    return both.select(
        "date", "store_id", F.col("item_id").alias("sku_id"), F.col("cat_id").alias("category"), F.col("dept_id").alias("subcategory"),
        F.col("quantity_sold").cast("double").alias("quantity_sold"), F.col("sell_price").alias("unit_price"), null("boolean").alias("promotion_flag"),
        (F.col("event_name_1").isNotNull() | F.col("event_name_2").isNotNull()).alias("event_flag"), joined_names("event_name_1", "event_name_2").alias("event_name"),
        "snap_eligible", null("double").alias("stock_on_hand"), null("boolean").alias("stockout_flag"), null("double").alias("unit_cost"),
        F.lit("retail_csv").alias("source"), F.lit(datetime.now(UTC)).cast("timestamp").alias("ingested_at"),
    )
