"""Every operator as a query over a data folder: name -> (spark, folder) -> DataFrame.

Version numbers are shown as BIGINT; inside the operators they stay exact
38-digit decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import (
    access, audit, batches, changes, events, integrity, reconcile as rec, registry, replay, reports, versions as ver,
)
from tidemark.functions.names import qualified_name as bracketed
from tidemark.plans.bucket_sync import keep_table, sync_table
from tidemark.plans.deploy import deploy_run as publish, version_change
from tidemark.plans.fixtures import Fixtures
from tidemark.schemas import KEY, VERSION_TYPE
from tidemark.sources.event_files import export_events as write_event_files, read_event_files
from tidemark.sources.scratch import materialize, new_path
from tidemark.sources.sinks import BatchLedger
from tidemark.sources.state import StateStore
from tidemark.operators.unit_sync import reconcile_units
from tidemark.sources.unit_data import UnitFile, read_unit_rows, write_manifest
from tidemark.sources.units import read_bundle, write_bundle
from tidemark.streaming.audit import stream_audit as start_audit
from tidemark.streaming.version_changes import KEYS as CHANGE_KEYS, stream_version_changes as start_changes

Query = Callable[[SparkSession, str], DataFrame]
_REGISTERED: dict[str, Query] = {}


def query(build: Callable[[Fixtures], DataFrame]) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return shown(build(Fixtures(spark, folder)))

    run.__name__ = build.__name__
    run.__doc__ = build.__doc__
    _REGISTERED[build.__name__] = run
    return run


def shown(df: DataFrame) -> DataFrame:
    """38-digit decimals as BIGINT, timestamps as the wall clock of the session's zone."""
    plain = {VERSION_TYPE: "bigint", T.TimestampType(): "timestamp_ntz"}
    casts = {f.name: F.col(f.name).cast(plain[f.dataType]) for f in df.schema.fields if f.dataType in plain}
    return df.withColumns(casts) if casts else df


def all_queries() -> dict[str, Query]:
    return dict(_REGISTERED)


# ---- version numbers ----


@query
def split_items(fx: Fixtures) -> DataFrame:
    return ver.split_items(fx.table("part").select("p_partkey", "p_name"), "p_name", " ").drop("p_name")


@query
def split_items_documents(fx: Fixtures) -> DataFrame:
    return ver.split_items(fx.table("documents").select("doc_id", "text"), "text", "\n").drop("text")


@query
def parse_version(fx: Fixtures) -> DataFrame:
    return ver.parse_version(fx.version_text(), "version_text")


@query
def parse_version_base1000(fx: Fixtures) -> DataFrame:
    return ver.parse_version(fx.version_text(), "version_text", weight_base=1000)


@query
def parse_version_checked(fx: Fixtures) -> DataFrame:
    """Good texts with every kind of bad one mixed in."""
    kind = F.col("id") % 11
    text = (
        F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, "1..2").when(kind == 2, "1.x.3")
        .when(kind == 3, " 7 .+2.-1").when(kind == 4, "1e3.1").when(kind == 5, "1234567890123456789.1")
        .when(kind == 6, "1.10000").otherwise(F.col("version_text"))
    )
    return ver.parse_version_checked(fx.version_text().withColumn("version_text", text), "version_text")


@query
def get_version(fx: Fixtures) -> DataFrame:
    return ver.get_version(fx.version(), fx.target().select(*KEY))


@query
def set_version(fx: Fixtures) -> DataFrame:
    updates = fx.target().filter("to_version is not null").select(*KEY, F.col("to_version").alias("version"))
    return ver.set_version(fx.version(), updates)


# ---- step registry ----


def _batch(fx: Fixtures, upgrade: int, some_schemas: bool) -> DataFrame:
    """An incoming batch: some steps vanish, all others get a new text, some are new."""
    own = fx.step().filter(F.col("upgrade") == upgrade)
    number = F.substring("schema_name", 2, 10).cast("int")
    if some_schemas:
        own = own.filter(number % 3 != 0)
    place = F.floor((F.col("id") - 1) / 2)
    columns = [*KEY, "version", "sequence", "description", "procedure_name"]
    kept = own.filter(place % 10 != 3).withColumn("description", F.concat("description", F.lit(" (new text)")))
    added = own.filter(place % 10 == 7).withColumn("sequence", F.col("sequence") + 100)
    return kept.select(*columns).unionByName(added.select(*columns))


@query
def missing_procedures(fx: Fixtures) -> DataFrame:
    key = F.col("o_orderkey")
    c = F.col("o_custkey")
    catalog = fx.table("orders").filter(key % 11 != 0).select(
        F.concat(F.lit("s"), ((c - c % 30) / 30).cast("int").cast("string")).alias("schema_name"),
        F.concat(F.lit("p_"), key.cast("string")).alias("procedure_name"),
    )
    return registry.missing_procedures(fx.step(), catalog).select("id", *KEY, "procedure_name")


@query
def register_upgrade_steps(fx: Fixtures) -> DataFrame:
    return registry.register_steps(fx.step(), _batch(fx, 1, True), "up").next_steps


@query
def register_downgrade_steps(fx: Fixtures) -> DataFrame:
    return registry.register_steps(fx.step(), _batch(fx, 0, True), "down").next_steps


@query
def register_upgrade_steps_all_keys(fx: Fixtures) -> DataFrame:
    """Deletes reach every key of the direction, mentioned in the batch or not."""
    return registry.register_steps(fx.step(), _batch(fx, 1, True), "up", delete_scope="all").next_steps


@query
def register_steps_report(fx: Fixtures) -> DataFrame:
    return registry.register_steps(fx.step(), _batch(fx, 1, False), "up").report


@query
def register_batch(fx: Fixtures) -> DataFrame:
    """A fleet's batch in which some keys break a rule each; keys asked for include some without steps."""
    batch = _batch(fx, 1, True)
    number = F.substring("schema_name", 2, 10).cast("int")
    procedure = F.substring("procedure_name", 3, 20).cast("long")
    broken = (
        batch.withColumn("description", F.when((number % 7 == 1) & (procedure % 17 == 0), F.repeat("description", F.lit(20))).otherwise(F.col("description")))
        .withColumn("version", F.when((number % 7 == 2) & (procedure % 13 == 0), F.lit(None)).otherwise(F.col("version")))
        .withColumn("application_name", F.when((number % 7 == 3) & (procedure % 19 == 0), F.lit(None)).otherwise(F.col("application_name")))
    )
    twice = batch.filter((number % 7 == 4) & (procedure % 23 == 0))
    catalog = fx.step().select("schema_name", "procedure_name").filter((number % 7 != 5) | (procedure % 29 != 0)).distinct()
    asked = fx.target().select(*KEY)
    made = registry.register_batch(fx.step(), broken.unionByName(twice), catalog, "up", asked)
    return made.outcomes


@query
def merge_source_duplicates(fx: Fixtures) -> DataFrame:
    lines = fx.table("lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return registry.merge_source_duplicates(lines.select(*keys), keys, lines.filter("l_returnflag = 'R'"))


@query
def assign_identity(fx: Fixtures) -> DataFrame:
    existing = fx.table("supplier").select(F.col("s_suppkey").alias("id"))
    new = fx.table("customer").select("c_custkey", "c_name")
    return registry.assign_identity(new, [F.col("c_name").desc(), "c_custkey"], existing=existing)


@query
def fill_defaults(fx: Fixtures) -> DataFrame:
    return registry.fill_defaults(fx.step().drop("upgrade", "completed"), registry.STEP_DEFAULTS)


# ---- choosing and applying a change ----


def _changes(fx: Fixtures) -> DataFrame:
    return changes.change_requests(fx.version(), fx.target())


def _ordered(fx: Fixtures) -> DataFrame:
    return changes.order_steps(changes.get_steps(fx.step(), _changes(fx)))


def _outcomes(fx: Fixtures) -> DataFrame:
    """Steps whose id divides by 97 fail."""
    return changes.cut_after_failure(_ordered(fx).withColumn("failed", F.col("step_id") % 97 == 0))


@query
def change_direction(fx: Fixtures) -> DataFrame:
    return changes.change_direction(_changes(fx))


@query
def get_steps(fx: Fixtures) -> DataFrame:
    return changes.get_steps(fx.step(), _changes(fx))


@query
def order_steps(fx: Fixtures) -> DataFrame:
    return _ordered(fx).withColumn("run_order", F.col("run_order").cast("int"))


@query
def change_summary(fx: Fixtures) -> DataFrame:
    asked = _changes(fx)
    return changes.change_summary(asked, changes.get_steps(fx.step(), asked))


@query
def apply_change(fx: Fixtures) -> DataFrame:
    return changes.apply_change(fx.step(), changes.get_steps(fx.step(), _changes(fx)))


@query
def cut_after_failure(fx: Fixtures) -> DataFrame:
    return _outcomes(fx).select(*KEY, "step_id", F.col("run_order").cast("int").alias("run_order"), "outcome")


@query
def advance_version(fx: Fixtures) -> DataFrame:
    return changes.advance_version(fx.version(), _changes(fx), _outcomes(fx))


# ---- replay ----


def _fresh(fx: Fixtures) -> DataFrame:
    return fx.step().withColumn("completed", F.lit(0))


@query
def replay_changes(fx: Fixtures) -> DataFrame:
    return replay.replay_changes(_fresh(fx), fx.version(), fx.request())


@query
def replay_changes_any_flags(fx: Fixtures) -> DataFrame:
    """From the flags the registry holds, not from fresh ones."""
    return replay.replay_changes(fx.step(), fx.version(), fx.request())


@query
def replay_final_state(fx: Fixtures) -> DataFrame:
    return replay.replay_final_state(_fresh(fx), fx.version(), fx.request()).steps.select("id", "upgrade", "completed")


@query
def replay_final_versions(fx: Fixtures) -> DataFrame:
    return replay.final_versions(fx.version(), fx.request())


@query
def deploy_run(fx: Fixtures) -> DataFrame:
    """Per key after a publish: its version and its completed steps by direction."""
    keys = fx.target().withColumn("n", F.substring("schema_name", 2, 10).cast("int"))
    down = keys.select(
        *KEY, F.when(F.col("n") % 13 == 0, "NULL").otherwise(F.concat_ws(".", (3 + F.col("n") % 3).cast("string"), F.lit("1"))).alias("version_text")
    )
    up = keys.select(
        *KEY, F.when(F.col("n") % 17 == 0, "NULL").otherwise(F.concat_ws(".", (7 + F.col("n") % 3).cast("string"), F.lit("9"))).alias("version_text")
    )
    result = publish(fx.step(), fx.version(), down, up, weight_base=10000, failed=F.col("step_id") % 97 == 0)
    flags = result.steps.groupBy(*KEY).agg(
        F.sum(F.col("upgrade") * F.col("completed")).alias("completed_up"),
        F.sum((1 - F.col("upgrade")) * F.col("completed")).alias("completed_down"),
    )
    return ver.get_version(result.versions, flags)


# ---- static data ----

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
_SUPPLIER = ["s_suppkey", "s_name", "s_nationkey"]


def _customers(fx: Fixtures) -> DataFrame:
    return fx.table("customer").select(*_CUSTOMER)


@query
def reconcile(fx: Fixtures) -> DataFrame:
    return rec.reconcile(_customers(fx), fx.static_src(), ["c_custkey"], _CUSTOMER)


@query
def change_report(fx: Fixtures) -> DataFrame:
    return rec.change_report(_customers(fx), fx.static_src(), ["c_custkey"], _CUSTOMER, "customer")


@query
def change_report_reference_deletes(fx: Fixtures) -> DataFrame:
    return rec.change_report(
        _customers(fx), fx.static_src(), ["c_custkey"], _CUSTOMER, "customer", delete_values=False
    )


@query
def reconcile_natural_key(fx: Fixtures) -> DataFrame:
    """Matched by name: the target keeps its own number, a new row takes the source's."""
    src = fx.static_src().withColumn("c_custkey", F.col("c_custkey") + 500000)
    return rec.reconcile(_customers(fx), src, ["c_name"], _CUSTOMER, insert_only=("c_custkey",))


@query
def reconcile_many(fx: Fixtures) -> DataFrame:
    supplier = fx.table("supplier").select(*_SUPPLIER)
    last = F.col("s_suppkey") % 10
    incoming = supplier.filter(last != 3).withColumn(
        "s_nationkey", F.when(last == 5, F.lit(None)).otherwise(F.col("s_nationkey"))
    )
    _, report = rec.reconcile_many(
        [
            rec.Unit("customer", _customers(fx), fx.static_src(), ["c_custkey"], _CUSTOMER),
            rec.Unit("supplier", supplier, incoming, ["s_suppkey"], _SUPPLIER),
        ]
    )
    return report


@query
def reconcile_unit_files(fx: Fixtures) -> DataFrame:
    """Unit files and their manifest are written, read back and applied; two units share a target."""
    supplier = fx.table("supplier").select(*_SUPPLIER)
    last, key = F.col("s_suppkey") % 10, F.col("c_custkey") % 10
    segments = fx.static_src().filter(key != 1).select(
        "c_custkey", F.when(key == 7, F.lit("THIRD")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    )
    contents = {
        UnitFile("010 customer.data.sql", "customer", ("c_custkey",), tuple(_CUSTOMER)): fx.static_src(),
        UnitFile("020+supplier.DATA.sql", "supplier", ("s_name",), tuple(_SUPPLIER), ("s_suppkey",)): supplier.filter(last != 3)
        .withColumn("s_nationkey", F.when(last == 5, F.lit(None)).otherwise(F.col("s_nationkey")))
        .withColumn("s_suppkey", F.col("s_suppkey") + 500000),
        UnitFile("030_segments.data.sql", "customer", ("c_custkey",), ("c_custkey", "c_mktsegment")): segments,
    }
    folder = new_path(fx.spark, "units")
    for unit, rows in contents.items():
        rows.select(F.to_json(F.struct(*rows.columns))).write.text(f"{folder}/{unit.file_name}")
    write_manifest(fx.spark, folder, list(contents))
    units, lines = read_unit_rows(fx.spark, folder)
    report = reconcile_units({"customer": _customers(fx), "supplier": supplier}, units, lines).report
    names = F.map_keys(F.coalesce("new", "previous"))
    return report.select(
        "unit_no", "file_name", "action", "table_name", F.array_join("row_key", ",").alias("row_key"),
        F.explode(names).alias("column_name"), "new", "previous",
    ).select(
        "unit_no", "file_name", "action", "table_name", "row_key", "column_name",
        F.col("new")[F.col("column_name")].alias("value"), F.col("previous")[F.col("column_name")].alias("previous_value"),
    )


@query
def reconcile_buckets(fx: Fixtures) -> DataFrame:
    """A kept table is brought in line twice; the second source changes few buckets."""
    store = StateStore(fx.spark, new_path(fx.spark, "kept"), buckets=64)
    keep_table(store, "customer", _customers(fx), ["c_custkey"])
    few = F.col("c_custkey") % 997 == 5
    reports = []
    for number, src in enumerate(
        (fx.static_src(), fx.static_src().withColumn("c_mktsegment", F.when(few, "FEW").otherwise(F.col("c_mktsegment")))), start=1
    ):
        synced = sync_table(store, "customer", src, new_path(fx.spark, "report"))
        reports.append(synced.report.withColumn("pass", F.lit(number)))
    return reports[0].unionByName(reports[1])


@query
def bundle_round_trip(fx: Fixtures) -> DataFrame:
    units = fx.table("documents").select(
        F.col("doc_id").alias("position"),
        F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".data.sql")).alias("file_name"),
        F.col("text").alias("content"),
    )
    path = new_path(fx.spark, "bundle")
    write_bundle(units, path)
    return read_bundle(fx.spark, path)


# ---- audit ----


@query
def append_audit(fx: Fixtures) -> DataFrame:
    rows = fx.table("events").select(
        F.col("event_type").alias("from"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), "props").alias("message")
    )
    path = new_path(fx.spark, "audit")
    audit.append_audit(rows, path, ["from", "message"], session_id=7)
    return fx.spark.read.parquet(path).select("id", "session_id", "from", "message")


@query
def audit_trace(fx: Fixtures) -> DataFrame:
    change = version_change(fx.step(), fx.version(), fx.target(), F.col("step_id") % 97 == 0)
    return audit.audit_trace(change.changes, change.outcomes)


@query
def audit_runs(fx: Fixtures) -> DataFrame:
    """Runs read back from a log: one session per schema, one second per line."""
    change = version_change(fx.step(), fx.version(), fx.target(), F.col("step_id") % 97 == 0)
    trace = audit.audit_trace(change.changes, change.outcomes)
    logged = trace.select(
        F.substring("schema_name", 2, 10).cast("int").alias("session_id"),
        (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("position"))).alias("when"),
        "application_name", "position", "from", "message",
    )
    # Ids only have to rise within a session: application, then position.
    place = F.ascii("application_name").cast("long") * 1_000_000_000 + F.col("position")
    runs = audit.audit_runs(logged.withColumn("id", place).drop("application_name", "position"))
    return runs.drop("run_no")


# ---- statistics and reports ----


def _elements(fx: Fixtures, scope: str) -> DataFrame:
    return fx.element().filter(F.col("query_scope") == scope)


@query
def summarize_user_defined(fx: Fixtures) -> DataFrame:
    return reports.summarize(_elements(fx, "UserDefined"), "object_type", "UserDefinedElements")


@query
def summarize_other(fx: Fixtures) -> DataFrame:
    return reports.summarize(_elements(fx, "Other"), "object_type", "OtherElements")


@query
def summarize_ranked(fx: Fixtures) -> DataFrame:
    return reports.summarize_sorted(_elements(fx, "UserDefined"), "object_type", "UserDefinedElements", "Value")


@query
def summarize_named(fx: Fixtures) -> DataFrame:
    return reports.summarize_sorted(_elements(fx, "UserDefined"), "object_type", "UserDefinedElements", "name")


@query
def survey_relationships(fx: Fixtures) -> DataFrame:
    return reports.survey_relationships(fx.relationship())


@query
def model_info(fx: Fixtures) -> DataFrame:
    options = fx.table("part").select(F.col("p_partkey").alias("option_no"), F.concat(F.lit("1033, "), "p_brand").alias("collation"))
    return reports.model_info(options, "Sql130", "option_no")


@query
def statistics_report(fx: Fixtures) -> DataFrame:
    stats = (
        reports.summarize(_elements(fx, "UserDefined"), "object_type", "UserDefinedElements")
        .unionByName(reports.summarize(_elements(fx, "Other"), "object_type", "Other Elements"))
        .unionByName(reports.survey_relationships(fx.relationship()))
    )
    return reports.statistics_report(stats)


def _full_plan(fx: Fixtures) -> DataFrame:
    """The plan with names, object kinds, scripts and the rarer step kinds."""
    number = F.col("step_no")
    kinds = F.array(*[F.lit(k) for k in (*batches.DYNAMIC_KINDS, "Table", "Index")])
    rare = F.when(F.col("step_type") != "SqlRenameStep", F.col("step_type")).when(
        number % 3 == 0, "SqlMoveSchemaStep"
    ).when(number % 3 == 1, "SqlTableMigrationStep").otherwise("SqlRenameStep")
    none = F.array().cast("array<string>")
    return fx.plan().select(
        "step_no",
        rare.alias("step_type"),
        F.when(number % 9 == 0, F.array(F.lit("srv"), F.lit("db"))).otherwise(none).alias("external_parts"),
        F.array("element_schema", "element_name").alias("name_parts"),
        F.element_at(kinds, (number % 10 + 1).cast("int")).alias("category"),
        F.col("element_name").alias("old_name"),
        F.concat("element_name", F.lit("_new")).alias("new_name"),
        F.concat("element_schema", F.lit("_new")).alias("new_schema"),
        F.when(number % 4 == 0, "").otherwise(F.concat(F.lit("batch of "), "element_name")).alias("script"),
        # Steps without a script have no batch.
        F.when(number % 4 == 0, 0).otherwise(F.col("batch_count")).alias("batch_count"),
    )


@query
def plan_report_summary(fx: Fixtures) -> DataFrame:
    return reports.plan_report(_full_plan(fx))


@query
def plan_report_details(fx: Fixtures) -> DataFrame:
    return reports.plan_report(_full_plan(fx), include_scripts=True)


@query
def qualified_name(fx: Fixtures) -> DataFrame:
    return _full_plan(fx).select("step_no", bracketed(F.col("external_parts"), F.col("name_parts")).alias("name"))


# ---- batches and plans ----


@query
def number_batches(fx: Fixtures) -> DataFrame:
    return batches.number_batches(_full_plan(fx))


@query
def total_batches(fx: Fixtures) -> DataFrame:
    return batches.total_batches(batches.number_batches(_full_plan(fx)))


def _numbered(fx: Fixtures) -> DataFrame:
    return materialize(batches.number_batches(_full_plan(fx)), "batches")


@query
def pending_batches(fx: Fixtures) -> DataFrame:
    numbered = _numbered(fx)
    ledger = numbered.filter("batch_id % 3 = 0").select("batch_id", "description")
    return batches.pending_batches(numbered, ledger)


@query
def record_batches(fx: Fixtures) -> DataFrame:
    """Two runs recorded in a ledger on storage; the second repeats some batches."""
    numbered = _numbered(fx)
    ledger = BatchLedger(fx.spark, new_path(fx.spark, "ledger"), "db", "run")
    ledger.record(numbered.filter("batch_id % 3 = 0"))
    ledger.record(numbered.filter("batch_id % 2 = 0"))
    return ledger.read()


@query
def steps_of_type(fx: Fixtures) -> DataFrame:
    return batches.steps_of_type(fx.plan(), "DropElementStep")


@query
def first_last_of_type(fx: Fixtures) -> DataFrame:
    return batches.first_last_of_type(
        fx.plan(), ["CreateElementStep", "AlterElementStep", "SqlRenameStep", "SqlBeginTransactionStep"]
    )


def _marked_plan(fx: Fixtures) -> DataFrame:
    return fx.plan().withColumn(
        "step_type", F.when(F.col("step_no") == 5, batches.END_PRE).otherwise(F.col("step_type"))
    )


@query
def plan_phases(fx: Fixtures) -> DataFrame:
    return batches.plan_phases(_marked_plan(fx))


@query
def plan_phases_plain(fx: Fixtures) -> DataFrame:
    """Without a transaction the markers are the anchors."""
    return batches.plan_phases(_marked_plan(fx), transactional=False)


# ---- integrity and access ----


@query
def unique_violations(fx: Fixtures) -> DataFrame:
    return integrity.unique_violations(fx.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query
def foreign_key_violations(fx: Fixtures) -> DataFrame:
    kept = fx.table("customer").filter("c_custkey % 10 <> 3")
    orders = fx.table("orders").select("o_orderkey", "o_custkey")
    return integrity.foreign_key_violations(orders, kept, ["o_custkey"], ["c_custkey"])


@query
def delete_guard(fx: Fixtures) -> DataFrame:
    report = rec.change_report(_customers(fx), fx.static_src(), ["c_custkey"], _CUSTOMER, "customer")
    return integrity.delete_guard(fx.table("orders").select("o_orderkey", "o_custkey"), report, "o_custkey", "c_custkey")


@query
def column_violations(fx: Fixtures) -> DataFrame:
    Rule = integrity.Rule
    return integrity.column_violations(
        fx.table("part"), [Rule("p_name"), Rule("p_name", 12), Rule("p_type"), Rule("p_brand", 7)]
    )


@query
def column_violations_documents(fx: Fixtures) -> DataFrame:
    Rule = integrity.Rule
    return integrity.column_violations(fx.table("documents"), [Rule("text"), Rule("text", 2048), Rule("lang", 2)])


@query
def effective_permissions(fx: Fixtures) -> DataFrame:
    return access.effective_permissions(fx.member())


@query
def check_permission(fx: Fixtures) -> DataFrame:
    kind = F.col("c_custkey") % 3
    asked = fx.table("customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(kind == 0, "invoke_version_change").when(kind == 1, "step").otherwise("get_version").alias("object_name"),
        F.when(kind == 0, "EXECUTE").when(kind == 1, "UPDATE").otherwise("SELECT").alias("privilege"),
    )
    return access.check_permission(asked, fx.member())


# ---- events ----


@query
def extract_events(fx: Fixtures) -> DataFrame:
    return events.extract_events(fx.event_xml()).select("event_id", "fragment", "event_time")


@query
def event_file_names(fx: Fixtures) -> DataFrame:
    return events.event_file_names(events.extract_events(fx.event_xml()), "(localdb)\\Projects").select("event_id", "file_name")


@query
def event_file_names_literal_clock(fx: Fixtures) -> DataFrame:
    named = events.event_file_names(events.extract_events(fx.event_xml()), "(localdb)\\Projects", literal_clock=True)
    return named.select("event_id", "file_name")


@query
def event_file_names_with_id(fx: Fixtures) -> DataFrame:
    named = events.event_file_names(events.extract_events(fx.event_xml()), "(localdb)\\Projects", with_id=True)
    return named.select("event_id", "file_name")


@query
def export_events(fx: Fixtures) -> DataFrame:
    """Written as files of their names, and read back by name."""
    named = events.event_file_names(events.extract_events(fx.event_xml()), "(localdb)\\Projects")
    folder = new_path(fx.spark, "events")
    write_event_files(named, folder)
    return read_event_files(fx.spark, folder)


# ---- streams ----


def _event_stream(fx: Fixtures) -> DataFrame:
    schema = fx.table("events").schema
    return fx.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(fx.folder)


@query
def stream_version_changes(fx: Fixtures) -> DataFrame:
    """The requests arrive in three parts, by time; the stream is stopped and started again between them."""
    events = fx.table("events")
    cuts = events.agg(F.percentile_approx("ts", [1 / 3, 2 / 3])).first()[0] or []
    part = sum([(F.col("ts") >= F.lit(cut)).cast("int") for cut in cuts], F.lit(0))
    store = StateStore(fx.spark, new_path(fx.spark, "store"), buckets=16)
    store.commit({"step": _fresh(fx), "version": fx.version()}, keys=CHANGE_KEYS)
    arrived, executed, checkpoint = (new_path(fx.spark, x) for x in ("arrived", "executed", "stream"))
    for number in range(len(cuts) + 1):
        late = F.col("ts").isNull() if number == 0 else F.lit(False)
        events.filter(F.coalesce(part == number, late)).write.mode("append").parquet(arrived)
        stream = fx.spark.readStream.schema(events.schema).parquet(arrived)
        start_changes(fx.request(stream), store, executed, checkpoint).awaitTermination()
    return fx.spark.read.option("recursiveFileLookup", "true").parquet(executed)


@query
def stream_audit(fx: Fixtures) -> DataFrame:
    rows = _event_stream(fx).select("event_id", F.col("ts").cast("timestamp").alias("when"), F.col("event_type").alias("message"))
    path, checkpoint = new_path(fx.spark, "stream-audit"), new_path(fx.spark, "stream")
    start_audit(rows, path, checkpoint, ["event_id"]).awaitTermination()
    return fx.spark.read.parquet(path).drop("log_day")
