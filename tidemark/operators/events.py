"""Extracting and naming recorded XML events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import row_numbers

# Fixed value: the event kind exported by default.
DEADLOCK_EVENT = "xml_deadlock_report"

# What a <data> element's <value> holds; a <text> element may follow the value.
_VALUE = r"(?s)<data\b[^>]*>\s*<value\b[^>]*>(.*?)</value>\s*(?:<text\b[^>]*>.*?</text>\s*|<text\s*/>\s*)?</data>"


def extract_events(
    df: DataFrame, event_name: str = DEADLOCK_EVENT, column: str = "event_data", name_column: str = "object_name"
) -> DataFrame:
    """Events of one kind with the XML under their values and their timestamp."""
    if not event_name.replace("_", "").isalnum():
        raise ValueError("an event name has letters, digits and underscores only")
    xml = F.col(column)
    stamp = F.xpath_string(xml, F.lit(f'/event[@name="{event_name}"]/@timestamp'))
    return (
        df.filter(F.col(name_column) == event_name)
        .withColumn("fragment", F.array_join(F.regexp_extract_all(xml, F.lit(_VALUE), F.lit(1)), ""))
        .withColumn("event_time", F.when(stamp != "", stamp).cast("timestamp"))
    )


def server_file_prefix(server: str) -> str:
    """The server name as file names use it: backslash to dash, no parentheses."""
    return server.replace("\\", "-").replace("(", "").replace(")", "")


def event_file_names(
    events: DataFrame, server: str, literal_clock: bool = False, with_id: bool = False
) -> DataFrame:
    """Adds `file_name`, one per event.

    Events of the same second get a number from the second one on, counted within
    `events`. `with_id` puts the event's id there instead: a name then follows from
    the event alone, so later exports never take the names of earlier ones. With
    `literal_clock` the hour runs to 12 and nothing is added, so a later event can
    take the name of an earlier one. An event without a time is named by its id.
    """
    if literal_clock and with_id:
        raise ValueError("names have either the literal clock or an id")
    stem = F.lit(f"{server_file_prefix(server)}-deadlock-")
    number = F.concat(F.lit("-"), F.coalesce(F.col("event_id").cast("string"), F.lit("none")))
    named = events
    if literal_clock:
        stamp = F.date_format("event_time", "yyyyMMdd-hhmmss")
    else:
        stamp = F.date_format("event_time", "yyyyMMdd-HHmmss")
        if with_id:
            stamp = F.concat(stamp, number)
        else:
            named = row_numbers(events.withColumn("_stamp", stamp), ["_stamp"], [F.col("event_id")], "_copy")
            copy = F.when(F.col("_copy") == 1, "").otherwise(F.concat(F.lit("-"), F.col("_copy").cast("string")))
            stamp = F.concat("_stamp", copy)
    name = F.concat(stem, F.coalesce(stamp, F.concat(F.lit("untimed"), number)), F.lit(".xdl"))
    return named.withColumn("file_name", name).drop("_stamp", "_copy")
