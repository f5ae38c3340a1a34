"""Message texts as column templates.

Fixed values: every text below is read by people and by `audit_runs`, so its
wording is part of the contract.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = "=" * 117
CHANGE_ROUTINE = "invoke_version_change"
STEP_ROUTINE = "invoke_step_procedure"
VERSION_ROUTINE = "set_version"
REGISTER_ROUTINE = {"up": "register_upgrade_step", "down": "register_downgrade_step"}

# Severity the server reports for a thrown or a conversion error.
SEVERITY = 16

BAD_NUMBER = "Error converting data type varchar to numeric."
TOO_LONG_NUMBER = "Arithmetic overflow error converting varchar to data type numeric."
TOO_LARGE_SUM = "Arithmetic overflow error converting expression to data type numeric."


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _str(value: Column) -> Column:
    return value.cast("string")


def null_argument(name: str) -> str:
    return f"null argument value at @{name} is not expected"


def missing_procedure(qualified: str) -> str:
    return f"specified procedure {qualified} does not exists in the schema"


def missing_procedure_of(qualified: Column) -> Column:
    return _text("specified procedure ", qualified, " does not exists in the schema")


def too_long(column: str, longest: int) -> str:
    return f"String or binary data would be truncated in column '{column}' of {longest} characters."


def register_error_of(direction: str, schema: Column, application: Column, message: Column) -> Column:
    """`register_error` with a key and a message per row."""
    word = "upgrade" if direction == "up" else "downgrade"
    empty = F.lit("")
    return _text(
        f"Error while registering {word} step in {REGISTER_ROUTINE[direction]} for \"", F.coalesce(application, empty),
        '" application within [', F.coalesce(schema, empty), f"] schema. Error (severity={SEVERITY}): ", message,
    )


def register_error(direction: str, schema: str | None, application: str | None, message: str) -> str:
    word = "upgrade" if direction == "up" else "downgrade"
    return (
        f"Error while registering {word} step in {REGISTER_ROUTINE[direction]} for "
        f'"{application or ""}" application within [{schema or ""}] schema. '
        f"Error (severity={SEVERITY}): {message}"
    )


def parse_error(text: Column, message: Column) -> Column:
    return _text(
        'Error while parsing version text "', F.coalesce(text, F.lit("")),
        f'". Error (severity={SEVERITY}): ', message,
    )


def begin(from_version: Column, to_version: Column, steps: Column) -> Column:
    return _text("BEGIN: Change version from ", _str(from_version), " to ", _str(to_version),
                 " via ", _str(steps), " steps.")


def warn_no_change(from_version: Column, to_version: Column) -> Column:
    return _text("WARN: There are no change(s) detected between ", _str(from_version),
                 " and ", _str(to_version))


def warn_no_steps(from_version: Column, to_version: Column) -> Column:
    return _text("WARN: There are no change steps registered between ", _str(from_version),
                 " and ", _str(to_version))


def _position(application: Column, version: Column, sequence: Column) -> Column:
    return _text(application, "(", _str(version), ")+", _str(sequence))


def start(up: Column, down: Column, application: Column, version: Column, sequence: Column,
          description: Column) -> Column:
    return _text("START: (Upgrade=", _str(up), "/Downgrade=", _str(down), ") step for ",
                 _position(application, version, sequence), ' via "', description, '".')


def step_base(step_id: Column, application: Column, version: Column, sequence: Column,
              schema: Column, procedure: Column) -> Column:
    return _text("step_id=", _str(step_id), ", ", _position(application, version, sequence),
                 " via ", schema, ".[", procedure, "]()")


def execute(base: Column) -> Column:
    return _text("EXEC: ", base)


def error(message: Column, base: Column, severity: Column | None = None) -> Column:
    number = F.lit(SEVERITY) if severity is None else severity
    return _text("ERROR: ", message, "(Severity=", _str(number), ") from ", base)


def success(step_id: Column) -> Column:
    return _text("SUCCESS: step_id=", _str(step_id), " completed = 1.")


def finish(application: Column, version: Column, sequence: Column) -> Column:
    return _text("FINISH: step procedure for ", _position(application, version, sequence))


def info(schema: Column, version: Column, application: Column) -> Column:
    return _text('INFO: Setting "', schema, "\" schema's version to \"", _str(version),
                 '" registered by application "', application, '".')


def cease(from_version: Column, to_version: Column) -> Column:
    return _text("CEASE: Change version from ", _str(from_version), " to ", _str(to_version))


def permission_denied(object_name: Column) -> Column:
    return _text("permission was denied on the object '", object_name, "'")
