"""Who may do what: grants by role, resolved per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import messages as M
from tidemark.operators.lookups import lookup

# The objects, and the privileges each role holds on them.
READ_FUNCTIONS = ("get_step", "get_version")
READ_ROUTINES = ("parse_version",)
WRITE_ROUTINES = (
    "register_upgrade_step",
    "register_downgrade_step",
    "invoke_step_procedure",
    "set_version",
    "invoke_version_change",
    "add_audit_event",
)
TABLES = ("step", "version", "audit_event")
READ = ("SELECT", "REFERENCES")
CHANGE = ("DELETE", "INSERT", "UPDATE")
ROLES = ("reader", "writer", "owner")


def grant_rows() -> list[tuple[str, str, str]]:
    """(role, object, privilege) for every grant; writer and owner hold the same."""
    rows = []
    for role in ROLES:
        for name in (*READ_FUNCTIONS, *TABLES):
            rows += [(role, name, privilege) for privilege in READ]
        rows += [(role, name, "EXECUTE") for name in READ_ROUTINES]
        if role != "reader":
            rows += [(role, name, "EXECUTE") for name in WRITE_ROUTINES]
            rows += [(role, name, privilege) for name in TABLES for privilege in CHANGE]
    return rows


def default_grants(spark: SparkSession) -> DataFrame:
    """The fixed matrix, a few dozen rows."""
    return spark.createDataFrame(grant_rows(), "role_name string, object_name string, privilege string")


def effective_permissions(members: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Union of the privileges of all roles of each user.

    The fixed matrix is broadcast; grants passed in are joined by their size.
    """
    # One row per (user, role) before the matrix multiplies them.
    roles = members.select("user_id", "role_name").distinct()
    matrix = F.broadcast(default_grants(members.sparkSession)) if grants is None else grants
    return lookup(roles, matrix, ["role_name"], "inner").select("user_id", "object_name", "privilege").distinct()


def check_permission(requests: DataFrame, members: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Adds `allowed` (0/1) and the denial `message` to (user, object, privilege) requests."""
    held = effective_permissions(members, grants).withColumn("_held", F.lit(1))
    joined = lookup(requests, held, ["user_id", "object_name", "privilege"])
    denied = F.col("_held").isNull()
    return (
        joined.withColumn("allowed", F.when(denied, 0).otherwise(1))
        .withColumn("message", F.when(denied, M.permission_denied(F.col("object_name"))))
        .drop("_held")
    )
