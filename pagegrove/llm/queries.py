"""Registered queries of the training-data operators, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrove.llm import byte_cnn, chat_events, conversation_trie, divergence_rules, jaccard_tree, langid, line_blocks, minhash_tensor, packing, pair_maxscore, spaced_seeds, token_store, warc
from pagegrove.llm.common import crc_mod, stage, table
from pagegrove.llm.sql import ORACLES

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = byte_cnn.quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = stage(divergence_rules.rule_features(table(spark, sf_dir, "documents"), keep=["doc_id"]), "rules")
    judged = divergence_rules.judge(features, divergence_rules.references(features))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.archive(pages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_jaccard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_tree.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.detect(docs.select("doc_id", "text"), langid.train(docs), out="found")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_table(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = line_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    written = stage(chat_events.format_events(chat_events.events_of(turns.unionByName(more))), "chat")
    return chat_events.digests(written)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), length=packing.word_length())


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.document_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(conversation_trie.rebuild(conversation_trie.conversations(table(spark, sf_dir, "conversations"))))


def op12_pair_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_maxscore.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_tensor.near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85, den=100)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


QUERIES = {f.__name__: f for f in (op1_byte_cnn, op2_divergence_rules, op3_warc, op4_jaccard_tree, op5_langid, op6_token_store, op7_line_blocks,
                                   op8_chat_events, op9_best_fit, op10_spaced_seeds, op11_conversation_trie, op12_pair_maxscore, op13_minhash_tensor)}
REGISTRY = {name: (f, ORACLES.get(name)) for name, f in QUERIES.items()}
