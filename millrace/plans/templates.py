"""Ready-made step lists for common kinds of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The steps of a run that names none.
DEFAULT_STEPS = [
    {"type": "snake_case_columns", "config": {}},
    {"type": "drop_duplicates", "config": {}},
    {"type": "drop_missing", "config": {"threshold_pct": 80}},
    {"type": "fill_missing", "config": {"strategy": "median"}},
    {"type": "remove_outliers", "config": {"method": "iqr", "threshold": 1.5}},
]

# Cleaning of raw files that come in batches.
BATCH_STEPS = [
    {"type": "snake_case_columns", "config": {}},
    {"type": "drop_duplicates", "config": {}},
    {"type": "fill_by_type", "config": {}},
    {"type": "keep_low_null", "config": {"threshold": 0.8}},
]


def _steps(*named: tuple) -> list[dict]:
    """The two opening steps every template has, then its own."""
    opening = [("snake_case_columns", {}), ("drop_duplicates", {})]
    return [{"type": name, "config": config} for name, config in [*opening, *named]]


# What makes a sale high or medium.
_SALES_CATEGORY = {
    "name": "revenue_category",
    "expression": "CASE WHEN amount > 10000 THEN 'high' WHEN amount > 1000 THEN 'medium' ELSE 'low' END",
}

# Categories, tags, expected columns, and the steps with their settings.
TEMPLATES = {
    "hr_data": {
        "name": "Employee records",
        "description": "Salaries on one scale, gaps filled, extreme rows removed.",
        "category": "Human Resources",
        "tags": ["hr", "employees", "salary", "people"],
        "expected_columns": ["name", "salary", "department", "hire_date", "location"],
        "steps": _steps(
            ("drop_missing", {"threshold_pct": 70}), ("fill_missing", {"strategy": "mode"}), ("cast_types", {}),
            ("normalize", {"columns": ["salary", "years_exp", "age"]}),
            ("remove_outliers", {"method": "iqr", "threshold": 2.0})),
    },
    "sales_data": {
        "name": "Sales transactions",
        "description": "Orders with an amount, graded by its size.",
        "category": "Sales & Finance",
        "tags": ["sales", "revenue", "transactions", "orders"],
        "expected_columns": ["order_id", "amount", "product", "date", "customer"],
        "steps": _steps(
            ("fill_missing", {"strategy": "constant", "value": 0}),
            ("filter_rows", {"column": "amount", "operator": "gt", "value": 0}), ("cast_types", {}),
            ("remove_outliers", {"method": "iqr", "threshold": 2.5}), ("derive_column", _SALES_CATEGORY)),
    },
    "financial_audit": {
        "name": "Ledger audit",
        "description": "Bookings that move money, without far outliers, on one scale.",
        "category": "Sales & Finance",
        "tags": ["finance", "audit", "compliance", "accounting"],
        "expected_columns": ["transaction_id", "amount", "account", "date", "category"],
        "steps": _steps(
            ("cast_types", {}), ("filter_rows", {"column": "amount", "operator": "neq", "value": 0}),
            ("remove_outliers", {"method": "zscore", "threshold": 3.0}), ("normalize", {})),
    },
    "customer_data": {
        "name": "Customer list",
        "description": "Contacts once each, with gaps marked and sparse columns dropped.",
        "category": "CRM & Marketing",
        "tags": ["customers", "crm", "contacts", "pii"],
        "expected_columns": ["customer_id", "name", "email", "phone", "country"],
        "steps": _steps(
            ("fill_missing", {"strategy": "constant", "value": "Unknown"}), ("cast_types", {}),
            ("drop_missing", {"threshold_pct": 60})),
    },
    "product_catalog": {
        "name": "Product catalogue",
        "description": "Priced products, with price and stock on one scale.",
        "category": "E-Commerce",
        "tags": ["products", "catalog", "inventory", "ecommerce"],
        "expected_columns": ["product_id", "name", "price", "category", "stock"],
        "steps": _steps(
            ("fill_missing", {"strategy": "mode"}), ("filter_rows", {"column": "price", "operator": "gt", "value": 0}),
            ("normalize", {"columns": ["price", "stock_quantity"]}), ("cast_types", {})),
    },
    "log_analytics": {
        "name": "Log lines",
        "description": "Log entries without debug output.",
        "category": "Engineering",
        "tags": ["logs", "events", "analytics", "monitoring"],
        "expected_columns": ["timestamp", "level", "message", "service", "user_id"],
        "steps": _steps(
            ("cast_types", {}), ("drop_missing", {"threshold_pct": 80}),
            ("filter_rows", {"column": "level", "operator": "neq", "value": "DEBUG"})),
    },
    "ml_features": {
        "name": "Model features",
        "description": "Complete numeric columns without outliers, standardized and scaled.",
        "category": "Data Science",
        "tags": ["ml", "features", "modeling", "ai"],
        "expected_columns": ["label", "feature_1", "feature_2"],
        "steps": _steps(
            ("drop_missing", {"threshold_pct": 40}), ("fill_missing", {"strategy": "median"}),
            ("remove_outliers", {"method": "iqr", "threshold": 1.5}), ("standardize", {}), ("normalize", {})),
    },
    "survey_data": {
        "name": "Survey answers",
        "description": "Answers of each respondent, with gaps filled by the usual answer.",
        "category": "Research",
        "tags": ["survey", "research", "responses", "likert"],
        "expected_columns": ["respondent_id", "score", "response", "date"],
        "steps": _steps(
            ("drop_missing", {"threshold_pct": 50}), ("fill_missing", {"strategy": "mode"}), ("cast_types", {})),
    },
}


def catalogue(spark: SparkSession) -> DataFrame:
    """The templates as a table, for `search_catalogue`."""
    rows = [(k, t["name"], t["description"], t["category"], t["tags"], t["expected_columns"], len(t["steps"]))
            for k, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "id string, name string, description string, category string, tags array<string>, "
                                       "expected_columns array<string>, steps int")
