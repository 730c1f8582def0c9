"""The registered queries of the corpus operators: thin wrappers that shape an operator's output into its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailknit.llm import bands, decontaminate, fingerprints, line_dedup, mixing, neardup, periodic, pii, pipeline, quality, secrets, span_dedup, suffix_dedup, toxicity
from trailknit.llm.common import read


def op1_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints_and_edits(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(~quality.training_fold(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source, rate, copy: documents repeated to the default target weights, shuffled."""
    out = mixing.replicate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.withColumn("rate", F.round("rate", 9))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, item_ids, similarity (the highest), kept."""
    found = decontaminate.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    leaked = F.size("item_ids") > 0
    return found.select("doc_id", leaked.alias("contaminated"), "item_ids", "similarity", (~leaked).alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the lines of repeated three-line windows, n_lines, n_removed."""
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("text", F.coalesce("text", F.lit("")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated spans of sentences, n_bytes before, n_removed bytes, n_spans removed."""
    return span_dedup.dedup_spans(read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(read(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(~toxicity.training_fold(), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic.periodic_runs(docs.select("doc_id", periodic.looped(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("text")))
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate("runs", F.get("runs", 0), lambda acc, r: F.when(more(r, acc), r).otherwise(acc))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.withColumns({"best": best, "runs_sha256": F.sha2(F.array_join(lines, ""), 256), "collapsed_sha256": F.sha2("collapsed", 256)})
    milli = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_iban, n_ssn (added spans), and risk, the highest score in percent (0 without spans)."""
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("entities", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(pii.written(F.filter("entities", lambda s: s["base"])), 256)
    risk = F.coalesce(F.array_max(F.transform("entities", lambda s: s["score"])), F.lit(0))
    return found.select("doc_id", *[of(k) for k in pii.KINDS], base.alias("base_sha256"), pii.written(F.col("entities")).alias("spans"), risk.alias("risk"))


def op13_price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bands.band_join(read(spark, sf_dir, "sale_lines"), read(spark, sf_dir, "items"))
    rows = found.select("item_id", "n_pairs", "gap_sum", "lines_crc", F.posexplode_outer("near").alias("at", "line"))
    return rows.select("item_id", (F.coalesce(F.col("at"), F.lit(-1)) + 1).alias("rank"), "line.gap", "line.u", "line.sale_id", "line.line_no", F.col("line.item").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


QUERIES = {
    "op1_merkle_fingerprints": op1_merkle_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_line_dedup": op7_line_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_price_bands": op13_price_bands,
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {
    "op5_poisson_mixing": mixing.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op12_personal_data": pii.ORACLE,
    "op13_price_bands": bands.ORACLE,
}
