"""Mixing sources to target weights.

Words are summed per source, targets follow from the weights, and every document
is emitted floor(rate) times plus once more with a probability equal to the rest
of the rate, decided by a hash of its id and a seed. A target stops at
`most_copies` times its source's words; what is left over is shared again by
weight among the others until none is above. In closed form: with the sources in
the order of (stop / weight), those up to some place stop, and the others share
the rest by weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.columns import set_aside
from tidemark.operators.lookups import lookup
from tidemark.operators.ordered import row_numbers, running_total
from tidemark.sources.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"

_HASH_BITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that follows from the seed, the id and the text, so that rows
    without an id, or texts that share one, throw coins of their own."""
    known = [F.coalesce(c, F.lit("")) for c in (doc_id.cast("string"), F.xxhash64(text).cast("string"))]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *known))
    digits = F.substring(digest, 1, _HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << _HASH_BITS))


def source_targets(sized: DataFrame, weights: list[int], most_copies: int) -> DataFrame:
    """(source, source_size, target) per source of `sized(source, size)`; a NULL source counts as one."""
    totals = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = row_numbers(totals, [], [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = placed.withColumn(
        "weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("stop", F.col("source_size") * most_copies)
    order = [(F.col("stop") / F.col("weight")).asc(), F.col("place").asc()]
    upto = running_total(weighed, [], order, "stops", weight=F.col("stop"))
    upto = materialize(running_total(upto, [], order, "weights", weight=F.col("weight")), "sources")
    words, every = upto.agg(F.sum("source_size"), F.sum("weight")).first()
    # A source stops when sharing what is left from it on by weight would pass its stop.
    left = F.lit(words).cast("long") - F.col("stops") + F.col("stop")
    share = left / (F.lit(every).cast("long") - F.col("weights") + F.col("weight"))
    stopped = share * F.col("weight") >= F.col("stop")
    taken, free = upto.agg(F.sum(F.when(stopped, F.col("stop"))), F.sum(F.when(~stopped, F.col("weight")))).first()
    rest = F.lit((words or 0) - (taken or 0)).cast("double")
    target = F.when(stopped, F.col("stop").cast("double")).otherwise(rest * F.col("weight") / F.lit(free).cast("long"))
    return upto.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: list[int] = (5, 2, 1), most_copies: int = 3, seed: str = "mix"
) -> DataFrame:
    """`docs` with size, source_size, target and copies: how often the mix takes each row.

    Weights go to the sources in code point order, NULL last, over and over. A NULL
    or empty text has size 0; a source of size 0 has target 0 and no copies. Rows equal
    in source, doc_id and text get equal copies. Columns named like the added ones are
    replaced (`mixed_documents` keeps them); an empty table gives an empty result.
    """
    added = ["size", "source_size", "target", "copies"]
    sized = docs.drop(*added).withColumn("size", word_count(F.col("text")))
    targets = source_targets(sized.select("source", "size"), list(weights), most_copies)
    key = [F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source")]
    left = sized.select("*", *key)
    right = targets.select(*key, "source_size", "target")
    rate = F.when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most_copies)))
    ).otherwise(0.0)
    joined = lookup(left, right, ["_none", "_source"], "inner").withColumn("_rate", rate)
    extra = (coin(F.col("doc_id"), F.col("text"), seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return joined.withColumn("copies", F.floor("_rate") + extra).drop("_none", "_source", "_rate")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of `mix_sources` as often as it is taken, without the added columns."""
    taken = mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.drop("_copy", "size", "source_size", "target", "copies")


def mixed_documents(
    docs: DataFrame, weights: list[int] = (5, 2, 1), most_copies: int = 3, seed: str = "mix"
) -> DataFrame:
    """Rows of `docs` as often as the mix takes them, with all columns, whatever these are called."""
    plain, back = set_aside(docs, ["doc_id", "text", "source"])
    mixed = emit_copies(mix_sources(plain, weights, most_copies, seed)).withColumnsRenamed(back)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])
