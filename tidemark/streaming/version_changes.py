"""Version requests as a stream, applied in set-based micro-batches.

Each micro-batch is a short log: `executed_steps` and the final states of
`operators.replay` run it for all its keys at once, so a key with a large share
of the requests is split like in a batch job. Steps and versions are kept in buckets
by key, and a micro-batch reads and writes the buckets of its own keys only. The
store keeps a log of the requests it applied, in buckets by id and committed together
with the states they led to. A micro-batch that comes again after a failure, or from
a stream that starts over, finds its requests there; what is new is applied whatever
the number of the micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.replay import executed_steps, final_steps, final_versions, plan_replay
from tidemark.schemas import KEY
from tidemark.sources.state import StateConflict, StateStore

STEP_TABLE = "step"
VERSION_TABLE = "version"
REQUEST_LOG = "request"
KEYS = {STEP_TABLE: KEY, VERSION_TABLE: KEY}
# Times a micro-batch is computed anew because another writer was first.
ATTEMPTS = 10


def _new_requests(batch: DataFrame, store: StateStore) -> DataFrame:
    """The requests of `batch` that the log does not hold; only buckets of the batch's ids are read."""
    applied = store.read_log(REQUEST_LOG, store.buckets_of(batch, ["request_id"]))
    if applied is None:
        return batch
    known = applied.select("request_id").join(batch.select("request_id"), "request_id", "left_semi")
    return batch.join(known, "request_id", "left_anti").select(*batch.columns)


def apply_requests(batch: DataFrame, store: StateStore, executed_path: str) -> int | None:
    """Apply the requests of a batch that the store does not know; the run, None if all were known."""
    store.refresh()
    fresh = store.stage_log(REQUEST_LOG, _new_requests(batch, store), ["request_id"])
    if fresh.rows.isEmpty():
        store.drop_staged(fresh)
        return None
    touched = store.buckets_of(fresh.rows, KEY)
    steps, versions = (store.read(name, touched) for name in (STEP_TABLE, VERSION_TABLE))
    plan = plan_replay(steps, versions, fresh.rows)
    name = fresh.folder.rsplit("/", 1)[-1]
    ran = store.stage(executed_steps(plan), f"{executed_path.rstrip('/')}/batch={name}")
    states = {STEP_TABLE: final_steps(plan), VERSION_TABLE: final_versions(versions, fresh.rows)}
    try:
        return store.commit(states, keys=KEYS, touched=touched, staged=[fresh, ran], as_dealt={STEP_TABLE})
    except StateConflict:
        store.drop_staged(fresh, ran)
        raise


def stream_version_changes(
    requests: DataFrame,
    store: StateStore,
    executed_path: str,
    checkpoint_path: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start applying a stream of (request_id, ts, key, to_version) to the store.

    `store` must hold `step` and `version`. If they are not kept in buckets yet, they
    are once, before the stream starts. Steps run are added below `executed_path`, one
    folder per micro-batch. Requests are ordered inside a micro-batch; one that arrives
    after later ones were applied counts from then on. A request is known by its
    `request_id`: one without an id is applied each time it comes. If a publish or
    another stream changes the same keys meanwhile, the micro-batch is computed anew.
    """
    store.cut_into_buckets(KEYS)

    def apply(batch: DataFrame, _: int) -> None:
        for attempt in range(ATTEMPTS):
            try:
                apply_requests(batch, store, executed_path)
                return
            except StateConflict:
                if attempt + 1 == ATTEMPTS:
                    raise

    return (
        requests.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
