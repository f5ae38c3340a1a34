"""The driver's tables shaped as registries, requests, plans and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import VERSION_TYPE


class Fixtures:
    """Views over one data folder; flags are 0/1 integers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One of the driver's tables; its footer is read once per folder."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @staticmethod
    def _schema_name(column: str, size: int):
        c = F.col(column)
        return F.concat(F.lit("s"), ((c - c % size) / size).cast("int").cast("string"))

    @staticmethod
    def _order_version():
        day = F.col("o_orderdate")
        return ((F.year(day) - 1990) * 10000 + F.month(day)).cast(VERSION_TYPE)

    def step(self) -> DataFrame:
        """A fleet of registries: 5 applications per schema, one schema per 30 customers."""
        both = F.when(F.col("o_orderkey") % 7 != 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1)))
        key = F.col("o_orderkey").cast("string")
        done = (F.col("upgrade") == 1) & (F.col("o_orderstatus") == "F")
        return self.table("orders").select("*", F.explode(both).alias("upgrade")).select(
            (2 * F.col("o_orderkey") + 2 - F.col("upgrade")).cast("long").alias("id"),
            self._schema_name("o_custkey", 30).alias("schema_name"),
            F.col("o_orderpriority").alias("application_name"),
            self._order_version().alias("version"),
            "upgrade",
            F.dayofmonth("o_orderdate").alias("sequence"),
            F.concat(F.lit("step "), key).alias("description"),
            F.concat(F.lit("p_"), key).alias("procedure_name"),
            F.when(done, 1).otherwise(0).alias("completed"),
        )

    def version(self) -> DataFrame:
        """Current version per key; keys without one start from 0."""
        return (
            self.table("orders")
            .filter(F.col("o_orderkey") % 40 == 0)
            .groupBy(self._schema_name("o_custkey", 30).alias("schema_name"), F.col("o_orderpriority").alias("application_name"))
            .agg(F.max(self._order_version()).alias("version"))
        )

    def target(self) -> DataFrame:
        """Requested version per key: up, down, equal and NULL."""
        c = F.col("o_custkey")
        number = ((c - c % 30) / 30).cast("int")
        wanted = F.when(number % 13 != 0, ((5 + number % 7) * 10000 + 6).cast(VERSION_TYPE))
        return self.table("orders").select(
            self._schema_name("o_custkey", 30).alias("schema_name"),
            F.col("o_orderpriority").alias("application_name"),
            wanted.alias("to_version"),
        ).distinct()

    def request(self, events: DataFrame | None = None) -> DataFrame:
        """A time-ordered request log, from the events table or a stream of it."""
        kind = F.col("event_type")
        application = (
            F.when(kind == "click", "1-URGENT").when(kind == "error", "2-HIGH").when(kind == "purchase", "3-MEDIUM")
            .when(kind == "signup", "4-NOT SPECIFIED").otherwise("5-LOW")
        )
        return (self.table("events") if events is None else events).select(
            F.col("event_id").alias("request_id"),
            "ts",
            self._schema_name("user_id", 3).alias("schema_name"),
            application.alias("application_name"),
            ((5 + F.col("event_id") % 7) * 10000 + F.col("user_id") % 12).cast(VERSION_TYPE).alias("to_version"),
        )

    def version_text(self) -> DataFrame:
        text = F.concat_ws(
            ".", F.col("user_id").cast("string"), (F.col("event_id") % 10000).cast("string"), (F.col("user_id") % 7).cast("string")
        )
        return self.table("events").select(F.col("event_id").alias("id"), text.alias("version_text"))

    def static_src(self) -> DataFrame:
        """Incoming customers: keys ending in 3 vanish, in 5 change, in 7 also arrive anew."""
        customer = self.table("customer")
        last = F.col("c_custkey") % 10
        kept = customer.filter(last != 3).select(
            "c_custkey", "c_name", "c_nationkey",
            F.when(last == 5, F.lit("UPDATED")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        )
        added = customer.filter(last == 7).select(
            (F.col("c_custkey") + 10000000).alias("c_custkey"), F.concat("c_name", F.lit("-new")).alias("c_name"),
            "c_nationkey", "c_mktsegment",
        )
        return kept.unionByName(added)

    def element(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("element_id"), F.col("p_type").alias("object_type"),
            F.when(F.col("p_size") <= 25, "UserDefined").otherwise("Other").alias("query_scope"),
        )

    def relationship(self) -> DataFrame:
        flag = F.col("l_returnflag")
        kind = (
            F.when(flag == "R", "Composing").when(flag == "A", "Hierarchical")
            .when(F.col("l_linestatus") == "O", "Peer").otherwise("Unclassified")
        )
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), kind.alias("relationship_type")
        )

    def plan(self) -> DataFrame:
        """Deployment plan steps; the largest order opens the post-deployment section."""
        orders = self.table("orders")
        last = orders.agg(F.max("o_orderkey")).scalar()
        priority = F.col("o_orderpriority")
        key, customer = F.col("o_orderkey"), F.col("o_custkey")
        kind = (
            F.when(key == 0, "BeginPreDeploymentScriptStep").when(key == last, "BeginPostDeploymentScriptStep")
            .when(priority == "1-URGENT", "CreateElementStep").when(priority == "2-HIGH", "AlterElementStep")
            .when(priority == "3-MEDIUM", "DropElementStep").when(priority == "4-NOT SPECIFIED", "SqlPrintStep")
            .otherwise("SqlRenameStep")
        )
        return orders.select(
            key.alias("step_no"),
            kind.alias("step_type"),
            F.concat(F.lit("s"), (customer % 50).cast("string")).alias("element_schema"),
            F.concat(F.lit("t"), key.cast("string")).alias("element_name"),
            (customer % 3 + 1).cast("int").alias("batch_count"),
        )

    def event_xml(self) -> DataFrame:
        """One XML event per row."""
        kind = F.when(F.col("event_type") == "error", "xml_deadlock_report").otherwise(F.col("event_type"))
        xml = F.concat(
            F.lit('<event name="'), kind, F.lit('" timestamp="'), F.col("ts").cast("string"),
            F.lit('"><data><value><deadlock><victim>p'), F.col("user_id").cast("string"),
            F.lit("</victim></deadlock></value></data></event>"),
        )
        return self.table("events").select("event_id", xml.alias("event_data"), kind.alias("object_name"))

    def member(self) -> DataFrame:
        """Users and their roles."""
        rank = F.col("c_custkey") % 4
        roles = F.array_compact(
            F.array(F.when(rank > 0, "reader"), F.when(rank > 1, "writer"), F.when(rank > 2, "owner"))
        )
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.explode(roles).alias("role_name"))
