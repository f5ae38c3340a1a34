"""Even shards that keep linked documents together: balanced label propagation.

A label is a shard. Documents that share a link (a key, such as their text) are
neighbours of each other. They start dealt out evenly, and in each round documents
ask to move where most of their neighbours are. A move needs a place: for every two
shards as many documents go one way as come back the other, and the rest goes where
the shard still has room for linked documents. So no round breaks a shard's capacity.
Documents without neighbours cut no link wherever they are; they fill what is left,
so that the counts of any two shards differ by at most one.

All documents of one link and one shard are alike, so a round works on these cells
and their counts, never on edges, of which a link of n documents has n squared. A
link larger than a shard gets as many home shards as it needs. Running counts over
many rows are cut by a hash into windows of bounded share, and what comes before a
window is added from a summary; no link, shard or table passes through one task.

Only DataFrame functions are used. Tables that a later round reads are written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookups import lookup
from tidemark.sources.scratch import materialize

# Least number of windows that a running count is cut into; shuffle partitions if they are more.
CUTS = 1024
# Key of the documents that share no link; digests of links are longer.
ALONE = b""


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _cut(key: Column, spark: SparkSession) -> Column:
    cuts = max(CUTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return F.pmod(F.xxhash64(key), F.lit(cuts)).cast("long")


def _before(rows: DataFrame, keys: list[str], cut: Column, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `weight` over the rows of the same keys that come before.

    Rows are ordered by (cut, order). The summary has one row per key and cut.
    """
    cutted = rows.withColumn("__cut", cut).withColumn("__weight", weight)
    sums = cutted.groupBy(*keys, "__cut").agg(F.sum("__weight").alias("__sum"))
    earlier = W.partitionBy(*keys).orderBy("__cut").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "__cut", F.coalesce(F.sum("__sum").over(earlier), _long(0)).alias("__start"))
    inside = W.partitionBy(*keys, "__cut").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = cutted.withColumn("__local", F.coalesce(F.sum("__weight").over(inside), _long(0)))
    return (
        local.join(sums, [*keys, "__cut"])
        .withColumn(out, F.col("__local") + F.col("__start"))
        .drop("__cut", "__weight", "__local", "__start")
    )


def _capacity(shard: Column, total: Column, shards: int) -> Column:
    """Documents of a shard when `total` are dealt out as evenly as can be."""
    return _div(total, _long(shards)) + F.when(shard < total % shards, 1).otherwise(0)


def _all_shards(spark, shards: int) -> DataFrame:
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"))


def first_labels(links: DataFrame, shards: int) -> DataFrame:
    """(link, shard, n): the documents of `links(link, n)` dealt to the shards in turn."""
    placed = _before(links, [], _cut(F.col("link"), links.sparkSession), [F.col("link")], F.col("n"), "start")
    dealt = placed.select(
        "link",
        F.posexplode(F.sequence(F.col("start"), F.col("start") + F.least("n", _long(shards)) - 1)).alias("i", "place"),
        "n",
    )
    return dealt.select(
        "link",
        (F.col("place") % shards).cast("int").alias("shard"),
        _capacity(F.col("i").cast("long"), F.col("n"), shards).alias("n"),
    )


def _rooms(cells: DataFrame, total: Column, shards: int) -> DataFrame:
    """(shard, load, room): linked documents of each shard, and how many more it can take."""
    load = cells.groupBy("shard").agg(F.sum("n").alias("load"))
    joined = _all_shards(cells.sparkSession, shards).join(load, "shard", "left").withColumn(
        "load", F.coalesce("load", _long(0))
    )
    return joined.withColumn("room", _capacity(F.col("shard"), total, shards) - F.col("load"))


def _requests(cells: DataFrame, rooms: DataFrame, size: Column, with_large: bool) -> DataFrame:
    """(link, shard, n, target, gain): where cells ask to move.

    A link that fits into a shard has its largest cell for a home, and the other
    cells ask to go there. A larger one has as many homes as it needs, largest cells
    first and then those whose shards have most room; its other cells ask for them in
    turn, the smallest first. A link has at most one cell per shard.
    """
    of_link = W.partitionBy("link")
    by_place = of_link.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    by_size = of_link.orderBy(F.col("n").desc(), F.col("held").desc(), F.xxhash64("link", "shard"))
    large = F.col("whole") > size
    held = F.when(large, F.col("n") + F.col("room")).otherwise(F.col("n"))
    ranked = (
        cells.join(rooms.select("shard", "room"), "shard")
        .withColumn("whole", F.sum("n").over(of_link))
        .filter(F.lit(with_large) | ~large)
        .withColumn("held", held)
        .withColumn("place", F.row_number().over(by_size) - 1)
        .withColumn("ahead", F.coalesce(F.sum("held").over(by_place), _long(0)))
        .withColumn("is_home", F.when(large, F.col("ahead") < F.col("whole")).otherwise(F.col("place") == 0))
        .withColumn("homes", F.count_if("is_home").over(of_link))
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "shard", "n")).over(of_link)), lambda x: F.struct(x["shard"], x["n"])
    )
    turn = (F.col("place") - F.col("homes")) % F.col("homes")
    home = F.element_at(F.col("cells"), (F.col("homes") - turn).cast("int"))
    return (
        ranked.withColumn("cells", listed)
        .filter(~F.col("is_home"))
        .select("link", "shard", "n", home["shard"].alias("target"), home["n"].alias("gain"))
    )


def _granted(requests: DataFrame, rooms: DataFrame) -> DataFrame:
    """(link, shard, target, moved): swaps between two shards, and moves into free room."""
    asked = requests.groupBy("shard", "target").agg(F.sum("n").alias("asked"))
    back = asked.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("asked").alias("back"))
    room = rooms.select(F.col("shard").alias("target"), "room")
    swapped = F.least("asked", F.coalesce("back", _long(0)))
    more = F.col("asked") - F.col("swapped")
    earlier = F.coalesce(
        F.sum("more").over(W.partitionBy("target").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), _long(0)
    )
    # One row per two shards.
    quotas = (
        asked.join(back, ["shard", "target"], "left")
        .withColumn("swapped", swapped)
        .withColumn("more", more)
        .withColumn("earlier", earlier)
        .join(room, "target")
        .select(
            "shard",
            "target",
            (F.col("swapped") + F.greatest(_long(0), F.least(F.col("more"), F.col("room") - F.col("earlier")))).alias("quota"),
        )
    )
    # Links with many documents at the target go first.
    rank = F.lit(63) - F.floor(F.log2(F.col("gain").cast("double"))).cast("int")
    cut = rank.cast("long") * (1 << 32) + _cut(F.col("link"), requests.sparkSession)
    ordered = _before(requests, ["shard", "target"], cut, [F.col("link")], F.col("n"), "ahead")
    return (
        ordered.join(quotas, ["shard", "target"])
        .withColumn("moved", F.least(F.col("n"), F.col("quota") - F.col("ahead")))
        .filter("moved > 0")
        .select("link", "shard", "target", "moved")
    )


def propagate(links: DataFrame, total: Column, shards: int, rounds: int) -> DataFrame:
    """(link, shard, n) after at most `rounds` rounds, or when no cell asks or may move."""
    cells = materialize(first_labels(links, shards), "labels")
    size = _div(total, _long(shards)) + F.when(total % shards > 0, 1).otherwise(0)
    # Links larger than a shard wait for a round, until the others have settled.
    with_large = False
    for _ in range(rounds):
        rooms = _rooms(cells, total, shards)
        requests = materialize(_requests(cells, rooms, F.greatest(size, _long(1)), with_large), "requests")
        granted = materialize(_granted(requests, rooms), "moves")
        if with_large and granted.isEmpty():
            break
        with_large = True
        changes = (
            cells.select("link", "shard", "n")
            .unionByName(granted.select("link", "shard", (-F.col("moved")).alias("n")))
            .unionByName(granted.select("link", F.col("target").alias("shard"), F.col("moved").alias("n")))
        )
        cells = materialize(changes.groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "labels")
    return cells


def shard_documents(docs: DataFrame, link: Column, shards: int = 24, rounds: int = 8) -> DataFrame:
    """Columns of `docs` with (shard, slot) added; counts of two shards differ by at most one.

    Rows with an equal `link` that is not NULL are linked; links are compared by the
    SHA-256 of their text. Slots number a shard's documents from 0 without gaps. Every
    row is placed, repeated ones and rows without any value too; an empty table gives
    an empty result. Columns named `shard`, `slot` or beginning with `__` are refused.
    Which row gets which slot follows the files as they were read.
    """
    clash = [c for c in docs.columns if c.lower() in ("shard", "slot") or c.startswith("__")]
    if clash:
        raise ValueError(f"columns {clash} have names that sharding uses")
    spark = docs.sparkSession
    digest = F.unhex(F.sha2(link.cast("string").cast("binary"), 256))
    rows = materialize(docs.withColumn("__link", digest).withColumn("__row", F.monotonically_increasing_id()), "rows")
    counts = materialize(rows.groupBy(F.col("__link").alias("link")).agg(F.count(F.lit(1)).alias("n")), "links")
    total = _long(counts.agg(F.coalesce(F.sum("n"), _long(0))).first()[0])
    linked = counts.filter(F.col("link").isNotNull() & (F.col("n") > 1))
    cells = propagate(linked, total, shards, rounds)

    # Where a cell begins among its shard's linked documents, and where it ends among its link's.
    seats = _before(cells, ["shard"], _cut(F.col("link"), spark), [F.col("link")], F.col("n"), "seat")
    of_link = W.partitionBy("link").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    seated = (
        seats.withColumn("end", F.sum("n").over(of_link))
        .groupBy("link")
        .agg(F.array_sort(F.collect_list(F.struct("end", "n", "shard", "seat"))).alias("cells"))
        .withColumnRenamed("link", "__link")
    )
    met = lookup(rows, seated.withColumnRenamed("cells", "__cells"), ["__link"])
    alone = F.col("__cells").isNull()
    keyed = met.withColumn("__link", F.when(alone, F.lit(ALONE)).otherwise(F.col("__link")))
    placed = _before(keyed, ["__link"], _cut(F.col("__row"), spark), [F.col("__row")], _long(1), "__place")

    # Free places of the shards, as ranges of the documents that share no link.
    rooms = _rooms(cells, total, shards).select("shard", F.col("load").alias("seat"), F.col("room").alias("n"))
    rooms = rooms.withColumn("end", F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)))
    free = rooms.filter("n > 0").agg(F.array_sort(F.collect_list(F.struct("end", "n", "shard", "seat"))).alias("__rooms"))
    # One row, with an entry for each shard.
    seen = placed.join(F.broadcast(free.withColumn("__link", F.lit(ALONE))), "__link", "left")
    spot = F.filter(F.coalesce("__cells", "__rooms"), lambda x: x["end"] > F.col("__place"))[0]
    return seen.withColumn("__spot", spot).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("__spot.shard").alias("shard"),
        (F.col("__spot.seat") + F.col("__place") - (F.col("__spot.end") - F.col("__spot.n"))).alias("slot"),
    )
