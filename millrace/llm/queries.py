"""One query per operator over its whole table, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontam, html_extract, oracles, quality, simhash, suffix_lm, token_count, toxicity, url_filter, warc
from millrace.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each passage of a document that matches a benchmark item."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.with_matches(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extracted(pages).select("page_id", "url", "text", "n_chars")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records against a replica in which some records are altered, some cut short, and some lost."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substr("html", F.lit(2)))).when(F.col("page_id") % 211 == 5, F.expr("substr(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    left = warc.leaves(pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), F.col("html")).alias("record")))
    right = warc.leaves(pages.select("page_id", warc.record(F.col("page_id"), F.col("url"), damaged).alias("record")).filter(F.col("page_id") % 307 != 50))
    return warc.damage(left, right).select("page_id", F.col("file").alias("file_id"), "seq", F.col("start").alias("start_offset"), F.col("length").alias("n_bytes"), F.col("hash").alias("leaf_hash"), F.col("other_hash").alias("replica_hash"), F.col("root").alias("root_hash"), F.col("other_root").alias("replica_root_hash"), "kind")


def op8_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.scored(read(spark, sf_dir, "documents").select("doc_id", "text"))


def url_list(hosts: DataFrame) -> DataFrame:
    """A dated list for (host): entries chosen by the first hex digit of a host's md5, and a few of parent domains."""
    digit = F.substr(F.md5("host"), F.lit(1), F.lit(1))
    day = lambda text: F.lit(text).cast("timestamp")
    entry = lambda name, action, key, at, added: F.struct(F.lit(name).alias("list"), F.lit(action).alias("action"), key.alias("key"), day(at).alias("at"), F.lit(added).alias("added"))
    host = F.col("host")
    made = F.when(digit.isin("0", "1", "2", "3"), F.array(entry("spam", "block", host, "2024-02-01", True), entry("spam", "block", host, "2024-05-01", False), entry("spam", "block", host, "2024-09-15", True)))
    made = made.when(digit.isin("4", "5", "6"), F.array(entry("malware", "block", host, "2024-03-10", True)))
    made = made.when(digit.isin("e", "f"), F.array(entry("trusted", "allow", host, "2024-01-15", True), entry("trusted", "allow", host, "2024-11-01", False)))
    own = hosts.filter(host.isNotNull()).distinct().select(F.explode(made).alias("e")).select("e.*")
    fixed = "VALUES ('parents', 'block', 'example.org', TIMESTAMP'2024-06-01', true), ('parents', 'block', 'example.org', TIMESTAMP'2024-07-01', false), ('spam', 'block', 'cheap-pills.example.com', TIMESTAMP'2024-01-20', true)"
    return own.unionByName(hosts.sparkSession.sql(f"SELECT * FROM {fixed} AS t(list, action, key, at, added)"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of hour page_id of 2024, against a dated list made from the hosts."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") % 8760 * 3600))
    found = url_filter.matched(captures, url_list(pages.select(url_filter.host_of(F.col("url")).alias("host"))))
    return found.select("page_id", "host", F.unix_seconds("fetched_at").alias("fetched_s"), "n_active", "blocked", "matched_key", "matched_list", F.unix_seconds("active_since").alias("since_s"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.with_round_trip(docs)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_decontaminate": op4_decontaminate,
    "op5_html_text": op5_html_text,
    "op6_token_counts": op6_token_counts,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_suffix_lm": op8_suffix_lm,
    "op9_url_filter": op9_url_filter,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = oracles.ORACLES
