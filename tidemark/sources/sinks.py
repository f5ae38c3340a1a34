"""Files written for people and tools: reports, event files, batch ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.batches import record_batches
from tidemark.operators.reports import plan_report
from tidemark.schemas import LEDGER
from tidemark.sources.files import delete, names_below, rename_if_absent


def write_statistics_xml(report: DataFrame, path: str) -> None:
    """Statistics as one XML document: an element per category, in it one per key with the value.

    Elements are named after category and key. The report has a row per kind of object,
    so one task writes it.
    """
    tag = F.col("xml_key")
    entry = F.concat(F.lit("    <"), tag, F.lit(">"), F.coalesce(F.col("value").cast("string"), F.lit("")), F.lit("</"), tag, F.lit(">"))
    name = F.col("xml_category")
    inside = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xml_key", entry.alias("line")))), lambda x: x["line"]), "\n")
    parts = report.groupBy("xml_category").agg(inside.alias("inside")).select(
        F.lit(1).alias("part"), name.alias("name"), F.concat(F.lit("  <"), name, F.lit(">\n"), "inside", F.lit("\n  </"), name, F.lit(">")).alias("line")
    )
    frame = report.sparkSession.createDataFrame(
        [(0, "", '<?xml version="1.0" encoding="utf-8"?>\n<ModelStatistics>'), (2, "", "</ModelStatistics>")], "part int, name string, line string"
    )
    whole = parts.unionByName(frame).repartition(1).sortWithinPartitions("part", "name")
    whole.select("line").write.mode("overwrite").text(path)


def write_plan_reports(plan: DataFrame, summary_path: str, details_path: str) -> None:
    """Summary and details of a plan as XML."""
    for path, scripts in ((summary_path, False), (details_path, True)):
        report = plan_report(plan, include_scripts=scripts)
        (
            report.select(
                F.col("step_no").alias("_StepNo"),
                F.col("step_type").alias("_Type"),
                F.col("name").alias("_Name"),
                F.col("category").alias("_Category"),
                F.col("original_name").alias("_OriginalName"),
                F.col("new_name").alias("_NewName"),
                F.col("new_schema").alias("_NewSchema"),
                F.col("script").alias("_VALUE"),
            )
            .write.format("xml")
            .option("rootTag", "DeploymentReport")
            .option("rowTag", "Operation")
            .mode("overwrite")
            .save(path)
        )


class BatchLedger:
    """Finished batches of one target and run, so a failed run can go on.

    Entries come in numbered parts. A part is renamed into place only if its number is
    free; a writer that lost the number looks again at what is held by then, so several
    writers record a batch once.
    """

    def __init__(self, spark: SparkSession, root: str, target: str, run_id: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/__completedBatches_{target}_{run_id}"

    def _parts(self) -> list[str]:
        return [n for n in names_below(self.spark, self.path) if n.startswith("part-")]

    def _held(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*[f"{self.path}/{n}" for n in parts])

    def read(self) -> DataFrame:
        return self._held(self._parts())

    def record(self, done: DataFrame) -> None:
        """Append finished batches the ledger does not hold yet."""
        while True:
            parts = self._parts()
            held = self._held(parts)
            added = record_batches(held.limit(0), done.join(held.select("batch_id"), "batch_id", "left_anti"))
            draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
            added.select(*LEDGER.fieldNames()).write.parquet(draft)
            if self.spark.read.schema(LEDGER).parquet(draft).isEmpty():
                delete(self.spark, draft)
                return
            if rename_if_absent(self.spark, draft, f"{self.path}/part-{len(parts):08d}"):
                return
            delete(self.spark, draft)

    def drop(self) -> None:
        """Remove this run's ledger once the run is over."""
        delete(self.spark, self.path)
