"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import cascade, chat, langid, linededup, mixing, oracles, oracles_more, quality, repair, simhash, spelling, urlfilter, vectors
from locusframe.llm._common import written
from locusframe.llm.decontamination import find_contaminated
from locusframe.llm.sharding import shard_by_splitters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its site's boilerplate lines."""
    return linededup.drop_site_lines(table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the benchmark's windows of 13 words cover."""
    return find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, read back from the prefix tree."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    trap = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    tree = chat.build_tree(rows.union(trap))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    back = chat.read_leaves(tree).select(
        "leaf", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return chat.to_copies(tree.conversations.select("conv_id", "leaf"), back).drop("leaf")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal bytes; equal texts stay next to each other."""
    slim = written(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("text_key"),
        )
    )
    return shard_by_splitters(slim, "text_key", "size", ["doc_id"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by marginals of its words."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs)
    slim = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    return langid.predict_language(slim, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability, and whether it is sampled, by raked source, language and topic shares."""
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.tokens_of(F.col("text")).alias("tokens"),
        mixing.draw_key(F.col("doc_id"), F.col("text")).alias("draw"),
    )
    dims = {n: F.col(n) for n in ("source", "lang", "topic")}
    return mixing.mix_to_targets(written(slim), dims, F.col("tokens"), F.col("draw")).select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("weight", 9).alias("weight"),
        F.round("probability", 6).alias("probability"), "sampled",
    )


#: Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict, by rules or, where none fits, by boosted trees."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by marginals of its lines."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    slim = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    return quality.score_quality(slim, model).select("doc_id", "held_out", "score", "predicted")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among all embeddings of one label, and their components."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components of near-duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, each with its more frequent form one edit away."""
    words = written(spelling.counted_words(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelling.spelling_variants(words)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of every document that quality rules are made of, and whether a cascade of rules keeps it."""
    report = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = cascade.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), report=report)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *report, failed.alias("base_failed"), "kept")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations with planted faults, and the cheapest edits that repair each."""
    return repair.repair_conversations(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op5_language_id": op5_language_id,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_sharding": op4_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": oracles.LINE_DEDUP,
    "op2_benchmark_decontamination": oracles.DECONTAMINATION,
    "op3_chat_format": oracles.CHAT,
    "op6_mixing": oracles.mixing(25, 0.9, 0.01),
    "op9_embedding_near_dedup": oracles.VECTORS,
    "op11_spelling_variants": oracles_more.SPELLING,
    "op12_quality_rules": oracles_more.RULES,
    "op13_conversation_repair": oracles_more.REPAIR,
}
