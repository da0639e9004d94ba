"""Daily sales and weather pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.plans.runner import apply_steps

# Fixed values below: columns, formulas, metrics and keys that the results must carry.

SALES_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("region", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("payment_method", T.StringType()),
    ]
)
# Money is summed as a decimal and rounded once: the result does not depend on the order of rows.
SALES_METRICS = {
    "total_revenue": "CAST(round(sum(CAST(revenue AS DECIMAL(38,10))), 2) AS DOUBLE)",
    "order_count": "count(order_id)",
    "avg_order_value": "CAST(round(sum(CAST(revenue AS DECIMAL(38,10))), 2) AS DOUBLE) / count(revenue)",
}
SALES_STEPS = [
    {"deduplicate": {"key": "order_id", "keep": "first"}},
    {"calculate_revenue": {"formula": "quantity * unit_price", "output_column": "revenue"}},
    {"aggregate_daily": {"group_by": ["region", "order_date"], "metrics": SALES_METRICS}},
]
SALES_INPUT_CHECKS = [
    {"row_count_gt": 0},
    {
        "required_fields_not_null": {
            "fields": ["order_id", "quantity", "unit_price", "region", "order_date"]
        }
    },
]
SALES_CHECKS = [
    {"row_count_gt": 0},
    {"required_fields_not_null": {"fields": ["region", "order_date", "total_revenue"]}},
]
SALES_UPSERT_KEY = ("region", "order_date")

WEATHER_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("city", T.StringType()),
        T.StructField("temp_f", T.DoubleType()),
        T.StructField("humidity", T.IntegerType()),
        T.StructField("wind_speed", T.IntegerType()),
    ]
)
WEATHER_STEPS = [
    {"convert_temperature": {"formula": "(temp_f - 32) * 5 / 9", "output_column": "temp_c"}},
    {"drop_incomplete": {"columns": ["date", "city", "temp_f"]}},
]
WEATHER_CHECKS = [{"row_count_gt": 0}, {"column_not_null": ["date", "city", "temp_c"]}]
WEATHER_COLUMNS = ("date", "city", "temp_c", "humidity", "wind_speed")


def daily_sales(sales: DataFrame) -> DataFrame:
    return apply_steps(sales, SALES_STEPS)


def weather(readings: DataFrame) -> DataFrame:
    steps = [*WEATHER_STEPS, {"select_columns": {"columns": list(WEATHER_COLUMNS)}}]
    return apply_steps(readings, steps)
