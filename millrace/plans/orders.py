"""Order pipelines: analytics, summary and the plain copy; and the customer pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.plans.runner import apply_steps

DATE_FORMAT = {"format": "%Y-%m-%d %H:%M:%S", "errors": "coerce"}
DOMAIN = "get(split(email, '@'), 1)"

# Fixed values below: columns, labels, defaults and limits that the results must carry.

ANALYTICS_STEPS = [
    {
        "cast_types": {
            "mappings": {
                "id": "int",
                "attempt_count": "int",
                "order_id": "str",
                "order_name": "str",
                "email": "str",
            }
        }
    },
    {
        "clean_strings": {
            "columns": ["email", "font_name", "variant_title", "source_name", "product_type"],
            "operations": ["strip", "lowercase"],
        }
    },
    {
        "parse_dates": {
            "columns": {
                "created_at": DATE_FORMAT,
                "process_at": DATE_FORMAT,
                "last_attempt_on": DATE_FORMAT,
            }
        }
    },
    {"derive_column": {"target_field": "email_domain", "expression": DOMAIN}},
    {
        "conditional_column": {
            "target_field": "email_provider",
            "conditions": [
                {"when": "email_domain = 'gmail.com'", "then": "Gmail"},
                {
                    "when": "email_domain IN ('outlook.com', 'hotmail.com', 'live.com')",
                    "then": "Microsoft",
                },
                {"when": "contains(email_domain, 'yahoo')", "then": "Yahoo"},
                {"default": "Corporate"},
            ],
        }
    },
    {
        "bucket_column": {
            "target_field": "attempt_bucket",
            "source_field": "attempt_count",
            "buckets": [
                {"range": [0, 0], "label": "no_attempts"},
                {"range": [1, 1], "label": "single"},
                {"range": [2, 3], "label": "moderate"},
                {"range": [4, None], "label": "high"},
            ],
        }
    },
    {
        "derive_column": {
            "target_field": "processing_lag_days",
            "expression": "(unix_micros(process_at) - unix_micros(created_at)) / 86400e6D",
        }
    },
    {
        "derive_column": {
            "target_field": "is_reprocessed_flag",
            "expression": "coalesce(is_reprocessed = 1, false) OR coalesce(attempt_count > 1, false)",
        }
    },
    {
        "fill_nulls": {
            "mappings": {
                "email": "unknown@unknown.com",
                "email_domain": "unknown",
                "email_provider": "Unknown",
                "font_name": "N/A",
                "variant_title": "N/A",
                "source_name": "N/A",
                "product_type": "N/A",
                "attempt_count": 0,
                "processing_lag_days": -1.0,
            }
        }
    },
    {
        "deduplicate": {
            "subset": ["order_id", "email"],
            "keep": "last",
            "sort_by": "created_at",
            "tiebreak": ["id"],
        }
    },
    {"exclude_value": {"column": "status", "value": "failed"}},
    {"drop_columns": {"columns": ["skuid", "eula_id", "is_reprocessed", "md5"]}},
    {
        "rename_columns": {
            "mappings": {
                "id": "order_record_id",
                "created_at": "order_created_at",
                "process_at": "order_processed_at",
                "order_id": "shopify_order_id",
                "order_name": "shopify_order_name",
                "attempt_count": "total_attempts",
                "last_attempt_on": "last_attempt_date",
                "process_at_date": "processed_date",
                "font_identifier": "font_id",
            }
        }
    },
    {
        "sort_rows": {
            "by": ["order_created_at", "shopify_order_id"],
            "ascending": [False, True],
            "tiebreak": ["order_record_id"],
        }
    },
    {
        "select_columns": {
            "columns": [
                "order_record_id",
                "order_created_at",
                "order_processed_at",
                "shopify_order_id",
                "shopify_order_name",
                "email",
                "email_domain",
                "email_provider",
                "variant_title",
                "font_name",
                "font_id",
                "source_name",
                "product_type",
                "status",
                "total_attempts",
                "attempt_bucket",
                "last_attempt_date",
                "is_reprocessed_flag",
                "processing_lag_days",
                "processed_date",
            ]
        }
    },
]
ANALYTICS_CHECKS = [
    {"row_count_gt": 0},
    {"required_fields_not_null": {"fields": ["order_record_id", "order_processed_at", "email"]}},
    {"column_not_null": ["order_record_id", "order_processed_at"]},
    {"unique_check": {"columns": ["order_record_id"]}},
    {"value_range": {"column": "total_attempts", "min": 0, "max": 100}},
    {
        "allowed_values": {
            "column": "email_provider",
            "values": ["Gmail", "Microsoft", "Yahoo", "Corporate", "Unknown"],
        }
    },
    {
        "allowed_values": {
            "column": "attempt_bucket",
            "values": ["no_attempts", "single", "moderate", "high"],
        }
    },
]
ANALYTICS_TABLE = """
    order_record_id BIGINT, order_created_at TIMESTAMP, order_processed_at TIMESTAMP,
    shopify_order_id STRING, shopify_order_name STRING, email STRING, email_domain STRING,
    email_provider STRING, variant_title STRING, font_name STRING, font_id STRING,
    source_name STRING, product_type STRING, status STRING, total_attempts INT,
    attempt_bucket STRING, last_attempt_date TIMESTAMP, is_reprocessed_flag BOOLEAN,
    processing_lag_days DECIMAL(10,2), processed_date TIMESTAMP
"""

SUMMARY_STEPS = [
    {"clean_strings": {"columns": ["email"], "operations": ["strip", "lowercase"]}},
    {
        "derive_domain": {
            "source_field": "email",
            "target_field": "email_domain",
            "default": "unknown",
        }
    },
    {"parse_dates": {"columns": {"created_at": DATE_FORMAT}}},
    {"derive_column": {"target_field": "order_year", "expression": "year(created_at)"}},
    {"derive_column": {"target_field": "order_month", "expression": "month(created_at)"}},
    {
        "conditional_column": {
            "target_field": "status_group",
            "conditions": [
                {"when": "status = 'success'", "then": "completed"},
                {"when": "status IN ('load', 'pending', 'processing')", "then": "in_progress"},
                {"default": "other"},
            ],
        }
    },
    {"drop_columns": {"columns": ["skuid", "eula_id", "md5", "font_identifier"]}},
    {
        "select_columns": {
            "columns": [
                "id",
                "created_at",
                "order_year",
                "order_month",
                "order_id",
                "order_name",
                "email",
                "email_domain",
                "font_name",
                "product_type",
                "status",
                "status_group",
                "attempt_count",
                "is_reprocessed",
            ]
        }
    },
]
SUMMARY_CHECKS = [
    {"row_count_gt": 0},
    {"required_fields_not_null": {"fields": ["id", "email", "status"]}},
    {"column_not_null": ["id"]},
    {
        "allowed_values": {
            "column": "status_group",
            "values": ["completed", "in_progress", "other"],
        }
    },
]

COPY_STEPS = [
    {"drop_columns": {"columns": ["skuid", "eula_id"]}},
    {"derive_domain": {"source_field": "email", "target_field": "domain"}},
    {
        "select_columns": {
            "columns": [
                "id",
                "created_at",
                "process_at",
                "order_id",
                "order_name",
                "email",
                "domain",
                "variant_title",
                "font_name",
                "md5",
                "source_name",
                "status",
                "attempt_count",
                "last_attempt_on",
                "is_reprocessed",
                "product_type",
                "font_identifier",
                "process_at_date",
            ]
        }
    },
]
COPY_CHECKS = [
    {"row_count_gt": 0},
    {"required_fields_not_null": {"fields": ["id", "process_at"]}},
    {"column_not_null": ["id", "process_at"]},
]

CUSTOMER_STEPS = [
    {"derive_domain": {"source_field": "email", "target_field": "domain"}},
    {"select_columns": {"columns": ["name", "email", "address", "orgName", "domain"]}},
]
CUSTOMER_CHECKS = [
    {"row_count_gt": 0},
    {"required_fields_not_null": {"fields": ["name", "email"]}},
    {"column_not_null": ["name", "email"]},
]


def order_analytics(orders: DataFrame) -> DataFrame:
    return apply_steps(orders, ANALYTICS_STEPS)


def order_summary(orders: DataFrame) -> DataFrame:
    return apply_steps(orders, SUMMARY_STEPS)


def order_copy(orders: DataFrame) -> DataFrame:
    return apply_steps(orders, COPY_STEPS)


def customer_details(customers: DataFrame) -> DataFrame:
    return apply_steps(customers, CUSTOMER_STEPS)
