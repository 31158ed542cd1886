"""Registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from verigauge.llm import twins
from verigauge.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op10_near_copies")
def op10(spark, sf_dir):
    from verigauge.llm.near_copies import near_copy_classes
    return near_copy_classes(table(spark, sf_dir, "documents"))


@query("op3_repeats", twins.REPEATS)
def op3(spark, sf_dir):
    from verigauge.llm.repeats import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


@query("op8_toxicity")
def op8(spark, sf_dir):
    from verigauge.llm.toxicity import toxicity
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_benchmark_tiles")
def op2(spark, sf_dir):
    from pyspark.sql import functions as F

    from verigauge.llm.tiles import contamination
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("long").alias("n_items"),
        F.array_max("matches.coverage").alias("best_coverage"), F.col("matches.item_id").alias("item_ids"))


@query("op7_mix")
def op7(spark, sf_dir):
    from pyspark.sql import functions as F

    from verigauge.llm.mixing import mix
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.size("_shards")).alias("taken"))


def public_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_files")
def op4(spark, sf_dir):
    from verigauge.llm.token_files import read_ids, write_ids
    return read_ids(write_ids(table(spark, sf_dir, "documents"), public_tokenizer()))


@query("op1_vector_copies", twins.VECTORS)
def op1(spark, sf_dir):
    from verigauge.llm.vectors import vector_classes
    return vector_classes(table(spark, sf_dir, "embeddings"))


@query("op6_language_model")
def op6(spark, sf_dir):
    from verigauge.llm.language_model import ORDER, score_texts
    return score_texts(table(spark, sf_dir, "documents"), order=ORDER)


@query("op5_warc", twins.WARC)
def op5(spark, sf_dir):
    from pyspark.sql import functions as F

    from verigauge.llm.warc import read_warc, write_warc
    folder, _ = write_warc(table(spark, sf_dir, "pages"))
    records = read_warc(spark, folder).where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        F.col("row_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", F.col("refers_to_row").alias("refers_to"))


@query("op9_secrets")
def op9(spark, sf_dir):
    from verigauge.llm.secret_scan import digests, find_secrets
    return digests(find_secrets(table(spark, sf_dir, "documents")))


@query("op11_merkle", twins.MERKLE)
def op11(spark, sf_dir):
    from verigauge.llm.merkle import manifest
    return manifest(table(spark, sf_dir, "documents"), with_proof=False)


@query("op13_repeated_lines", twins.LINES)
def op13(spark, sf_dir):
    from verigauge.llm.repeated_lines import without_repeated_lines
    return without_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


@query("op12_conversations", twins.CONVERSATIONS)
def op12(spark, sf_dir):
    from verigauge.llm.conversations import repair_damaged
    return repair_damaged(table(spark, sf_dir, "conversations"))
