"""The upgrade/downgrade scenario and a step-by-step simulation of its rules."""

from decimal import Decimal

from tidemark.schemas import STEP

KEYED = "schema_name string, application_name string, version decimal(38,0)"
LEVELS = [(v, s) for v in (10000, 10001, 10002, 20000) for s in (0, 1, 2, 3, 10)] + [
    (20001, s) for s in (0, 1, 2, 3, 10, 11)
]


def scenario_steps(spark):
    """26 upgrade and 26 downgrade steps of one key, none completed."""
    data = []
    for upgrade in (1, 0):
        for version, sequence in LEVELS:
            name = f"{'up' if upgrade else 'down'}_{version}_{sequence}"
            data.append((len(data) + 1, "dbo", "test_app", Decimal(version), upgrade, sequence, name, name, 0))
    return spark.createDataFrame(data, STEP)


def versions_frame(spark, *given):
    return spark.createDataFrame([(s, a, Decimal(v)) for s, a, v in given], KEYED)


class Simulation:
    """One key, one request at a time, one step at a time."""

    def __init__(self, steps, version):
        self.steps = {s["id"]: dict(s) for s in steps}
        self.version = version

    def request(self, to):
        start, ran = self.version, []
        up = 1 if start < to else 0
        low, high = min(start, to), max(start, to)
        sign = 1 if up else -1
        chosen = [s for s in self.steps.values() if s["upgrade"] == up and not s["completed"] and low < s["version"] <= high]
        for step in sorted(chosen, key=lambda s: (sign * s["version"], sign * s["sequence"], s["id"])):
            for other in self.steps.values():
                if other["upgrade"] != up and (other["version"], other["sequence"]) == (step["version"], step["sequence"]):
                    other["completed"] = 0
            step["completed"] = 1
            ran.append(step["id"])
        self.version = to
        return ran
