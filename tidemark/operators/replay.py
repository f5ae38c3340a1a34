"""Replaying a whole log of version requests without going key by key.

How it works. Number the slots of a key, its distinct (version, sequence), 1, 2, 3, ...
by version. A request that moves the version from a to b crosses exactly the numbers
between the positions of a and b, its levels. Slots, requests and starts are placed in
one cut: the number of a request is that of the last slot up to its version.

Which crossings run a step. Crossings of one version alternate between up and
down, starting with the direction given by the key's first version. At one
(version, sequence) let `lead` be the steps of the direction crossed first and
`follow` the others; a step runs when it is open, and a run re-opens the other
side. Hence

* a lead step runs on its first crossing if it starts open;
* a follow step runs on its first crossing if it starts open or any lead step
  ran before it;
* on later crossings either side runs iff both sides exist and some follow step
  ran the first time (an open one, or one re-opened by a lead step).

This holds for any starting flags, so no step-by-step state is needed.

Which rows are formed. A level is crossed first by a request that goes beyond all
places its key has been at, a record: with the highest and lowest level so far known
at every request, the records' ranges of new levels meet every level at most once.
That is all most levels need. Only levels where steps run again, or where a follow
step runs without any lead, are numbered a second time, and only their crossings meet
steps: a request goes to each block of these levels that it reaches, and is paired there
with the steps it crosses. So a registry without downgrade steps that starts below its
steps forms nothing but first crossings, however often its version swings, and rows on
the way to a join are requests and steps, not crossings.

How flags end. A level is crossed if the key's versions reach its other side, and an odd
number of times if the last of them stays there. That decides almost every flag; the
others need to know one crossing from three, and for these alone crossings are counted.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.names import fold_names, unfold_names
from tidemark.operators.lookups import lookup
from tidemark.operators.ordered import history, running_total
from tidemark.operators.versions import set_version
from tidemark.schemas import KEY, VERSION_TYPE
from tidemark.sources.scratch import materialize

WHEN = ["ts", "request_id"]
# The order of a key's requests; of two with one time and id the lower version comes first.
TURN = [*WHEN, "to_version"]
SLOT = [*KEY, "version", "sequence"]
# Facts about a slot, and what `plan_replay` adds to a step.
_SLOT_FACTS = ["has_lead", "lead_runs", "follow_runs", "crossed"]
_FACTS = ["level", "again_level", "leads", *_SLOT_FACTS]
# How often a level is crossed: never, an odd number of times, an even one.
_NEVER, _ODD, _EVEN = 0, 1, 2
# Levels of a block; a request is sent to each block that it reaches.
_BLOCK = 16
# Two counts in one running total.
_SHIFT = 1 << 31
# Versions up to here, with either sign, are worked on as 64-bit integers.
_WIDEST = 1 << 62
# Kinds of points; slots come before what reaches their version.
_IS_SLOT, _IS_START, _IS_REQUEST = 0, 1, 2


class ReplayPlan(NamedTuple):
    """Requests as moves between level numbers, and the steps placed on them."""

    moves: DataFrame  # key, ts, request_id, versions, levels and repeating levels from and to, lowest and highest before
    located: DataFrame  # steps of the requested keys with the facts that decide their runs
    untouched: DataFrame  # steps of all other keys
    compact: bool = False  # whether the versions above are 64-bit integers


def _compact(tables: list[tuple[DataFrame, str]]) -> bool:
    """Whether every version fits a 64-bit integer: the same number, quicker to compare, hash and move."""
    if any(df.schema[name].dataType != VERSION_TYPE for df, name in tables):
        return False
    whole = reduce(DataFrame.union, [df.select(F.col(name).alias("version")) for df, name in tables])
    least, greatest = whole.agg(F.min("version"), F.max("version")).first()
    return least is None or (least >= -_WIDEST and greatest <= _WIDEST)


def _exact(df: DataFrame, names: list[str], compact: bool) -> DataFrame:
    """Versions in the type they were given in."""
    return df.withColumns({n: F.col(n).cast(VERSION_TYPE) for n in names}) if compact else df


def _starts(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per requested key: the versions it starts from, ends at, and goes between."""
    start = F.coalesce("version", F.lit(0).cast(versions.schema["version"].dataType))
    asked = requests.groupBy(*KEY).agg(
        F.max_by("to_version", F.struct(*TURN)).alias("last"), F.min("to_version").alias("lowest"), F.max("to_version").alias("highest")
    )
    return lookup(asked, versions.select(*KEY, "version"), KEY, grows=True).select(
        *KEY, start.alias("version"), "last", F.least("lowest", start).alias("lowest"), F.greatest("highest", start).alias("highest")
    )


def _led(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """Steps of the requested keys, with the side of the start they are on and how often they are crossed."""
    key = starts.select(*KEY, F.col("version").alias("_start"), *[F.col(c).alias(f"_{c}") for c in ("last", "lowest", "highest")])
    begun = lookup(steps.select(*SLOT, "upgrade", "completed"), key, KEY, "inner", grows=True)
    version, above = F.col("version"), F.col("version") > F.col("_start")
    reached = F.when(above, F.col("_highest") >= version).otherwise(F.col("_lowest") < version)
    stays = above != (F.col("_last") < version)
    crossed = F.when(~reached, _NEVER).when(stays, _ODD).otherwise(_EVEN)
    return begun.select(*SLOT, "upgrade", "completed", above.alias("above"), crossed.alias("crossed"))


def _leads(above: str) -> Column:
    """Above the start a version is first crossed upwards."""
    return F.col("upgrade") == F.when(F.col(above), 1).otherwise(0)


def _slots(led: DataFrame) -> DataFrame:
    """The facts of each (version, sequence); where `follow_runs`, the first crossing is not all."""
    open_step = F.col("completed") == 0
    slots = led.withColumn("leads", _leads("above")).groupBy(*SLOT).agg(
        F.max("above").alias("above"),
        F.max("crossed").alias("crossed"),
        F.max(F.col("leads")).alias("has_lead"),
        F.max(~F.col("leads")).alias("_has_follow"),
        F.max(F.col("leads") & open_step).alias("lead_runs"),
        F.max(~F.col("leads") & open_step).alias("_follow_open"),
    )
    follow_runs = F.col("_has_follow") & (F.col("lead_runs") | F.col("_follow_open"))
    return slots.select(*SLOT, "above", "crossed", "has_lead", "lead_runs", follow_runs.alias("follow_runs"))


def _points(slots: DataFrame, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """Slots, starts and requests of the keys, each with the version it lies at."""
    asked = requests.withColumnRenamed("to_version", "version")
    kinds = [(slots, _IS_SLOT), (starts.select(*KEY, "version"), _IS_START), (asked, _IS_REQUEST)]
    marked = [df.withColumn("kind", F.lit(kind)) for df, kind in kinds]
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), marked)


def _placed(points: DataFrame) -> DataFrame:
    """Points with the number of slots, and of those that run again, up to each."""
    is_slot, again = F.col("kind") == _IS_SLOT, F.coalesce("follow_runs", F.lit(False))
    both = is_slot.cast("long") * _SHIFT + again.cast("long")
    counted = running_total(points, KEY, [F.col("version"), F.col("kind")], "_both", both)
    return counted.withColumns(
        {"level": F.call_function("div", F.col("_both"), F.lit(_SHIFT).cast("long")), "again_level": F.col("_both") % _SHIFT}
    ).drop("_both")


def plan_replay(steps: DataFrame, versions: DataFrame, requests: DataFrame) -> ReplayPlan:
    """Place every request and every step version on the level numbers of its key.

    A request for a NULL version is an error that changes nothing, so it is left
    out. One without a time or an id is applied like any other, before those that
    have one. Only keys with requests are worked on. Tables that are read more than
    once are written.
    """
    tables = [(steps, "version"), (versions, "version"), (requests, "to_version")]
    compact = _compact(tables)
    if compact:
        steps, versions, requests = (df.withColumn(name, F.col(name).cast("bigint")) for df, name in tables)
    asked = [F.col(c).isNotNull() for c in [*KEY, "to_version"]]
    requests = requests.filter(reduce(Column.__and__, asked)).select(*KEY, *TURN)
    first = _starts(versions, requests)
    # A step without a version or sequence meets no facts whatever its key.
    whole = F.col("version").isNotNull() & F.col("sequence").isNotNull()
    slots = _slots(_led(steps.filter(whole), first))
    placed = materialize(_placed(_points(slots, first, requests)), "levels")

    # One row per slot, so a step's own row moves only to meet its facts; a step that
    # meets none belongs to another key.
    facts = placed.filter(F.col("kind") == _IS_SLOT).select(*SLOT, "above", "level", "again_level", *_SLOT_FACTS)
    met = lookup(steps, facts, SLOT, grows=True).withColumn("leads", F.when(F.col("level").isNotNull(), _leads("above")))
    located = materialize(met.select(*steps.columns, *_FACTS), "located")
    untouched = located.filter(F.col("level").isNull() & whole).unionByName(
        lookup(located.filter(~whole), first.select(*KEY), KEY, "left_anti", grows=True)
    )

    timeline = placed.filter(F.col("kind") != _IS_SLOT).select(
        *KEY, *WHEN, (F.col("kind") == _IS_START).cast("int").alias("_is_start"),
        F.col("version").alias("to_version"), F.col("level").alias("to_level"), F.col("again_level").alias("to_again_level"),
    )
    order = [F.col("_is_start").desc(), *[F.col(c).asc_nulls_first() for c in TURN]]
    here = F.struct("to_version", "to_level", "to_again_level")
    chained = history(timeline, KEY, order, here, F.col("to_level"), "_from", "lowest", "highest")
    moves = chained.filter("_is_start = 0").select(
        *KEY,
        *WHEN,
        F.col("_from.to_version").alias("from_version"),
        "to_version",
        F.col("_from.to_level").alias("from_level"),
        "to_level",
        F.col("_from.to_again_level").alias("from_again"),
        F.col("to_again_level").alias("to_again"),
        "lowest",
        "highest",
    )
    return ReplayPlan(
        materialize(moves, "moves"),
        located.filter(F.col("level").isNotNull()),
        untouched.select(*steps.columns),
        compact,
    )


def records(moves: DataFrame) -> DataFrame:
    """One row per (request, level) that a key crosses for the first time."""
    higher = F.col("to_level") > F.col("highest")
    low = F.when(higher, F.col("highest")).otherwise(F.col("to_level"))
    high = F.when(higher, F.col("to_level")).otherwise(F.col("lowest"))
    return moves.filter(higher | (F.col("to_level") < F.col("lowest"))).select(
        *KEY, *WHEN, "from_version", "to_version", F.explode(F.sequence(low + 1, high)).alias("level")
    )


def _crossing(moves: DataFrame) -> DataFrame:
    """Requests that cross levels that run again: those after `low` up to `high`, by their own numbers."""
    return moves.filter("from_again <> to_again").select(
        *KEY,
        *WHEN,
        "from_version",
        "to_version",
        F.when(F.col("to_again") > F.col("from_again"), 1).otherwise(0).alias("upgrade"),
        F.least("from_again", "to_again").alias("low"),
        F.greatest("from_again", "to_again").alias("high"),
    )


def crossings(moves: DataFrame) -> DataFrame:
    """One row per (request, level crossed) of the levels that run again."""
    levels = F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("again_level")
    return _crossing(moves).withColumn("again_level", levels).drop("low", "high")


def _block(again_level: Column) -> Column:
    return F.call_function("div", again_level - 1, F.lit(_BLOCK).cast("long"))


def _crossed_by(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """`rows` of levels that run again, once per request that crosses them in their direction.

    A request is sent to the blocks it reaches, not to every level it crosses.
    """
    low, high = F.col("low"), F.col("high")
    sent = _crossing(moves).withColumn("_block", F.explode(F.sequence(_block(low + 1), _block(high))))
    met = lookup(rows.withColumn("_block", _block(F.col("again_level"))), sent, [*KEY, "_block", "upgrade"], "inner", grows=True)
    return met.filter((F.col("again_level") > low) & (F.col("again_level") <= high)).drop("_block", "low", "high")


def _run_first() -> Column:
    open_step = F.col("completed") == 0
    return F.when(F.col("leads"), open_step).otherwise(open_step | F.col("lead_runs"))


def _run_later() -> Column:
    return F.col("has_lead") & F.col("follow_runs")


def executed_steps(plan: ReplayPlan) -> DataFrame:
    """One row per step run, with the request that ran it.

    At levels that run once, lead steps meet their level's record one to one. Most of
    the others run at every crossing in their direction, some at the first or at all but it.
    """
    located = plan.located.withColumns({"run_first": _run_first(), "run_later": _run_later()})
    request = [*WHEN, "from_version", "to_version"]
    shown = [*KEY, "id", "version", "sequence", "upgrade", "description", "procedure_name"]
    single = located.filter("run_first and leads and not follow_runs").select(*shown, "level")
    once = lookup(single, records(plan.moves), [*KEY, "level"], "inner", grows=True).select(*shown, *request)

    several = located.filter("follow_runs")
    every = _crossed_by(several.filter("run_first and run_later").select(*shown, "again_level"), plan.moves).select(*shown, *request)
    # The others need their level's first crossing in their direction.
    place = [*KEY, "again_level", "upgrade"]
    some = several.filter("run_first <> run_later").select(*shown, "again_level", "run_first")
    turn = F.struct(*TURN)
    first = _crossed_by(some.select(*place).distinct(), plan.moves).groupBy(*place).agg(F.min(turn).alias("_first"))
    after = _crossed_by(lookup(some, first, place, "inner", grows=True), plan.moves)
    part = after.filter(F.when(F.col("run_first"), turn == F.col("_first")).otherwise(turn > F.col("_first"))).select(*shown, *request)
    ran = _exact(once.unionByName(every).unionByName(part), ["from_version", "to_version", "version"], plan.compact)
    return ran.select(
        "request_id", "ts", *KEY, "from_version", "to_version",
        F.col("id").alias("step_id"), F.col("version").alias("step_version"),
        F.col("sequence").alias("step_sequence"), F.col("description").alias("step_description"),
        F.col("procedure_name").alias("step_procedure"), "upgrade",
    )


def replay_changes(
    steps: DataFrame,
    versions: DataFrame,
    requests: DataFrame,
    case_sensitive: bool = True,
) -> DataFrame:
    """Runs a log of requests per key; one row per step run, with its request."""
    steps, versions, requests = (fold_names(df, KEY, case_sensitive) for df in (steps, versions, requests))
    return unfold_names(executed_steps(plan_replay(steps, versions, requests)), KEY, case_sensitive)


def _crossing_counts(moves: DataFrame, steps: DataFrame) -> DataFrame:
    """How often the levels of `steps` are crossed, from where moves start and end only."""
    moving = lookup(moves.filter("from_level <> to_level"), steps.select(*KEY).distinct(), KEY, "left_semi", grows=True)
    low, high = F.least("from_level", "to_level"), F.greatest("from_level", "to_level")
    # +1 where a move's range of levels opens, -1 after it closes; reduced to one
    # row per level before the running total.
    edges = moving.select(
        *KEY,
        F.explode(
            F.array(
                F.struct((low + 1).alias("level"), F.lit(1).alias("change")),
                F.struct((high + 1).alias("level"), F.lit(-1).alias("change")),
            )
        ).alias("edge"),
    ).select(*KEY, "edge.*")
    levels = steps.select(*KEY, "level", F.lit(0).alias("change"))
    changes = edges.unionByName(levels).groupBy(*KEY, "level").agg(F.sum("change").alias("change"))
    return running_total(changes, KEY, [F.col("level")], "times", F.col("change")).select(*KEY, "level", "times")


def final_steps(plan: ReplayPlan) -> DataFrame:
    """Every step with the flag it has after the whole log."""
    columns = plan.untouched.columns
    crossed = F.col("crossed")
    lead_flag = F.when(crossed == _ODD, 1).when(F.col("follow_runs"), 0).otherwise(1)
    # A follow step after an odd number of crossings: after one, and after more.
    after_one = F.when(F.col("lead_runs"), 0).otherwise(F.col("completed"))
    after_more = F.when(_run_later(), 0).otherwise(1)
    follow_flag = F.when(crossed == _ODD, after_one).otherwise(1)
    flag = F.when(crossed == _NEVER, F.col("completed")).when(F.col("leads"), lead_flag).otherwise(follow_flag)
    open_case = (crossed == _ODD) & ~F.coalesce("leads", F.lit(False)) & ~after_one.eqNullSafe(after_more)
    located = plan.located.withColumn("_open_case", open_case)
    told = located.filter("not _open_case").withColumn("completed", flag)
    others = located.filter("_open_case")
    counted = lookup(others, _crossing_counts(plan.moves, others), [*KEY, "level"], grows=True)
    more = counted.withColumn("completed", F.when(F.col("times") == 1, after_one).otherwise(after_more))
    steps = told.select(*columns).unionByName(more.select(*columns)).unionByName(plan.untouched)
    return _exact(steps, ["version"], plan.compact)


def final_versions(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """`versions` after the whole log: the last request of each key wins."""
    last = (
        requests.filter(F.col("to_version").isNotNull())
        .groupBy(*KEY)
        .agg(F.max_by("to_version", F.struct(*TURN)).alias("version"))
    )
    return set_version(versions, last)


class FinalState(NamedTuple):
    steps: DataFrame
    versions: DataFrame


def replay_final_state(
    steps: DataFrame,
    versions: DataFrame,
    requests: DataFrame,
    case_sensitive: bool = True,
) -> FinalState:
    """Registry and versions after a log of requests, from any starting flags."""
    steps, versions, requests = (fold_names(df, KEY, case_sensitive) for df in (steps, versions, requests))
    plan = plan_replay(steps, versions, requests)
    states = (final_steps(plan), final_versions(versions, requests))
    return FinalState(*[unfold_names(df, KEY, case_sensitive) for df in states])
