"""Reconcile of a kept table that moves only the buckets its source differs in."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.digests import BUCKET, bucket_digests, differing_buckets
from tidemark.operators.reconcile import change_report, reconcile
from tidemark.schemas import require_columns
from tidemark.sources.state import StateConflict, StateStore, hash_bucket

# Times a reconcile is computed anew because another writer was first.
ATTEMPTS = 10


class Synced(NamedTuple):
    run: int | None  # the commit; None if nothing differed
    touched: list[int]  # buckets that were read, joined and written
    report: DataFrame


def _digest_table(table: str) -> str:
    return f"{table}_digest"


def _kept_digests(store: StateStore, table: str, compared: list[str], key: list[str]) -> DataFrame:
    """Digests of the table's last commit; computed from its rows if these were changed without them."""
    runs = store.pointer()["tables"]
    digests = _digest_table(table)
    noted = store.pointer()["notes"].get(digests)
    if runs.get(digests) == runs[table] and noted == compared:
        return store.read(digests)
    return bucket_digests(store.read(table), hash_bucket(key, store.buckets), compared)


def keep_table(store: StateStore, table: str, rows: DataFrame, key: list[str], insert_only: tuple[str, ...] = ()) -> int:
    """Put `rows` into the store in buckets of their key, with the digests of these."""
    compared = [c for c in rows.columns if c not in insert_only]
    digests = bucket_digests(rows, hash_bucket(key, store.buckets), compared)
    return store.commit(
        {table: rows, _digest_table(table): digests}, notes={_digest_table(table): compared}, keys={table: key}
    )


def sync_table(
    store: StateStore,
    table: str,
    src: DataFrame,
    report_path: str,
    insert_only: tuple[str, ...] = (),
    delete_values: bool = True,
) -> Synced:
    """Bring `table` in line with `src`, as `reconcile` does, by its key and all its columns.

    The source is read once for digests; only rows of buckets that differ are joined, and
    only these buckets of the table are read and written. The change report becomes the
    folder `report_path` with the commit; nothing is written if nothing differs. Types of
    both sides must agree, since digests compare values as they are stored. Keys match
    exactly; a row with a NULL key matches none, so its bucket is written each time it
    differs only.
    """
    for attempt in range(ATTEMPTS):
        try:
            return _sync(store, table, src, report_path, insert_only, delete_values)
        except StateConflict:
            if attempt + 1 == ATTEMPTS:
                raise


def _sync(store, table, src, report_path, insert_only, delete_values) -> Synced:
    store.refresh()
    key = store.keys_of(table)
    if not key:
        raise ValueError(f"{table} is not kept in buckets")
    now = store.read(table, [])
    columns = now.columns
    require_columns(src, columns, "source")
    odd = [c for c in columns if src.schema[c].dataType != now.schema[c].dataType]
    if odd:
        raise TypeError(f"source and {table} differ in the type of {', '.join(odd)}")
    src = src.select(*columns)
    compared = [c for c in columns if c not in insert_only]
    bucket = hash_bucket(key, store.buckets)
    incoming = store.stage(bucket_digests(src, bucket, compared), f"{store.root}/{_digest_table(table)}/staged")
    try:
        differing = differing_buckets(_kept_digests(store, table, compared, key), incoming.rows)
        touched = sorted(r[BUCKET] for r in differing.collect())  # at most as many as there are buckets
        held = store.read(table, touched)
        arrived = src.filter(bucket.isin(touched))
        changes = change_report(held, arrived, key, columns, table, delete_values, insert_only)
        if not touched:
            return Synced(None, [], changes)
        report = store.stage(changes, report_path)
        try:
            # In the compared columns the next state is the source, so its digests are known.
            run = store.commit(
                {table: reconcile(held, arrived, key, columns, insert_only), _digest_table(table): incoming.rows},
                notes={_digest_table(table): compared}, touched=touched, staged=[report],
            )
        except StateConflict:
            store.drop_staged(report)
            raise
        return Synced(run, touched, store.spark.read.schema(changes.schema).parquet(report_path))
    finally:
        store.drop_staged(incoming)
