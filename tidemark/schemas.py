"""Declared row types of the registry tables and the columns that key them."""

from __future__ import annotations

from pyspark.sql import types as T

# Version numbers are exact 38-digit integers; they never pass through a double.
VERSION_TYPE = T.DecimalType(38, 0)

# (schema, application) names one registry of steps and one current version.
KEY = ["schema_name", "application_name"]

STEP = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("schema_name", T.StringType(), False),
        T.StructField("application_name", T.StringType(), False),
        T.StructField("version", VERSION_TYPE, False),
        T.StructField("upgrade", T.IntegerType(), False),
        T.StructField("sequence", T.IntegerType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("procedure_name", T.StringType(), False),
        T.StructField("completed", T.IntegerType(), False),
    ]
)

STEP_BATCH = T.StructType(
    [
        T.StructField("version", VERSION_TYPE, False),
        T.StructField("sequence", T.IntegerType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("procedure_name", T.StringType(), False),
    ]
)

VERSION = T.StructType(
    [
        T.StructField("schema_name", T.StringType(), False),
        T.StructField("application_name", T.StringType(), False),
        T.StructField("version", VERSION_TYPE, False),
    ]
)

AUDIT_EVENT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("session_id", T.IntegerType(), False),
        T.StructField("when", T.TimestampType(), False),
        T.StructField("user_login", T.StringType(), False),
        T.StructField("user_identity", T.StringType(), False),
        T.StructField("user_session", T.StringType(), False),
        T.StructField("from", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("batch_id", T.LongType(), False),
        T.StructField("description", T.StringType(), True),
    ]
)

# Declared defaults and longest texts of the registry columns.
STEP_DEFAULTS = {"upgrade": 1, "completed": 0}
STEP_LENGTHS = {
    "schema_name": 128,
    "application_name": 50,
    "description": 128,
    "procedure_name": 128,
}
AUDIT_LENGTHS = {
    "user_login": 128,
    "user_identity": 128,
    "user_session": 128,
    "from": 128,
    "message": 2048,
}
STEP_SEED = 1
AUDIT_SEED = 0


def require_columns(df, names, what: str) -> None:
    """Fail early, on the driver, when an input lacks a declared column."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks column(s) {', '.join(missing)}")
