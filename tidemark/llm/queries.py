"""The operators and the pipeline as queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.chat import format_conversations, read_target, read_turns
from tidemark.llm.divergence import audit_sources
from tidemark.llm.exact_dedup import exact_groups
from tidemark.llm.langid import identify_languages, train_languages
from tidemark.llm.licenses import scan_licenses
from tidemark.llm.mixing import mix_sources
from tidemark.llm.oracles import ORACLES
from tidemark.llm.packing import pack_documents
from tidemark.llm.parity_join import jaccard_links
from tidemark.llm.sharding import shard_documents
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import score_toxicity, train
from tidemark.llm.turn_trie import encode_turns, number_turns, turn_trie, with_shared_heads
from tidemark.llm.url_filters import filter_urls, url_host, url_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES = dict(ORACLES)

TOKENIZER = "word_bpe_49k.json"


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[run.__name__] = run
    return run


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list drawn from the pages: every host is blocked once, hosts and first
    path parts are taken off or allowed again later. Days follow from the smallest page."""
    start = F.lit("2024-01-01").cast("date")
    first = F.min("page_id").alias("m")
    hosts = pages.groupBy(url_host(F.col("url")).alias("pattern")).agg(first)
    folder = F.concat(url_host(F.col("url")), F.lit("/"), F.split_part(url_path(F.col("url")), F.lit("/"), F.lit(2)))
    folders = pages.groupBy(folder.alias("pattern")).agg(first)

    def entry(df: DataFrame, day: Column, action: str) -> DataFrame:
        return df.select("pattern", F.date_add(start, day.cast("int")).alias("listed_on"), F.lit(action).alias("action"))

    m = F.col("m")
    return (
        entry(hosts, m * 7 % 200, "block")
        .union(entry(hosts, m * 7 % 200 + 60, "remove"))
        .union(entry(hosts, m * 7 % 200 + 90, "block"))
        .union(entry(folders, m * 11 % 365, "allow"))
    )


@query
def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 13 % 365).cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetched.alias("fetched_on"))
    return filter_urls(captures, list_entries(pages)).withColumnRenamed("capture_id", "page_id")


@query
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(read(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(control).alias("text"),
    )
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    examples = format_conversations(turns)
    whole = F.array_join(
        F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.when(F.col("target_place").isNotNull(), read_target(examples))
    read_back = examples.select(
        "conv_id",
        "n_turns",
        F.char_length("text").alias("chars"),
        F.struct("target_place", loss.alias("loss")).alias("target"),
        # The last example of a conversation holds all its turns.
        F.struct("n_turns", "text").alias("last"),
    )
    grouped = read_back.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max_by("last", "n_turns").alias("last"),
        F.array_sort(F.collect_list(F.when(F.col("target.target_place").isNotNull(), F.col("target")))).alias("targets"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    ).select("conv_id", "n_turns", F.col("last.text").alias("text"), "targets", "formatted_chars")
    losses = F.array_join(F.transform("targets", lambda t: t["loss"]), "")
    return grouped.select(
        "conv_id",
        "n_turns",
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(losses).cast("long").alias("loss_chars"),
        F.sha2(losses, 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(read(spark, folder, "documents"), weights=[5, 2, 1], most_copies=3)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = train_languages(docs.filter(fold(4) != 2))
    # Held-out rows differ in what was learned from, not in how they are predicted.
    return identify_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


@query
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    machine = train(docs.filter(fold(5) != 0), read(spark, folder, "labels").filter(fold(5) != 0))
    return score_toxicity(docs.select("doc_id", "text"), machine).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted"
    )


@query
def op9_parity_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_links(read(spark, folder, "documents"), width=4, percent=85)


@query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(read(spark, folder, "documents"))


@query
def op11_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(read(spark, folder, "documents"), least_docs=10, most_terms=10)


@query
def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("link"),
    )
    sharded = shard_documents(docs, F.col("link"), shards=24)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op13_turn_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = encode_turns(number_turns(read(spark, folder, "conversations")))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return turn_trie(with_shared_heads(turns, F.col("conv_id") - F.col("conv_id") % 5, head, most=8))


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
