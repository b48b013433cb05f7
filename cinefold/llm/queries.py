"""The registered queries of the operators, with SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm import blockmax, fastsketch, htmltext, middle, mixing, packing, pii, quality, simhash, tokencount, turntrie, urlfilter, vptree
from cinefold.llm.common import table


def op1_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document's pieces in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows for every hundredth vector, through the tree of every shard."""
    rows = table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.build(rows), rows.where("vec_id % 100 = 0"))


def op5_blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five highest integer inner products for every fiftieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return blockmax.top_k(rows, rows.where("vec_id % 50 = 0"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), narrow=True).select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op11_fast_sketch_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of word pairs, and its near-duplicate component."""
    found = fastsketch.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's fill-in-middle text, and of the text rebuilt from it."""
    made = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(middle.restored(), 256).alias("restored_sha256")
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each rebuilt with the head that its hundred shares."""
    return turntrie.prefix_trie(turntrie.with_shared_heads(turntrie.sequences(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_simhash_near_dups": op1_simhash_near_dups,
    "op2_quality": op2_quality,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_vptree_ann": op4_vptree_ann,
    "op5_blockmax_topk": op5_blockmax_topk,
    "op6_mix_sources": op6_mix_sources,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_main_text": op9_main_text,
    "op10_pii": op10_pii,
    "op11_fast_sketch_dups": op11_fast_sketch_dups,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_turn_trie": op13_turn_trie,
}

ORACLE_SQL = {
    "op4_vptree_ann": vptree.SQL,
    "op5_blockmax_topk": blockmax.SQL,
    "op6_mix_sources": mixing.SQL,
    "op8_url_filter": urlfilter.SQL,
    "op11_fast_sketch_dups": fastsketch.SQL,
    "op12_fill_in_middle": middle.SQL,
    "op13_turn_trie": turntrie.SQL,
}
