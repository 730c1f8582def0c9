"""Line dedup by overlapping windows of three consecutive lines, in DataFrame functions only.

Every window of three lines is hashed (two 64-bit hashes); the first window of each hash stays, by (doc_id, text hash,
position); the lines that later windows cover are removed. Windows are judged on the input. Counting windows by hash
combines in the map tasks first, so a window that stands in a third of all documents is one row per task; the windows that
repeat are written to the shared folder, and joined back in a join of two plain shuffles, whose hot partitions Spark can split.

Edge cases: a null text is an empty text of one empty line; texts of fewer than three lines have no window and stay as
they are; rows with equal doc_id and text count as one document and get equal answers; rows without doc_id come last in
the order; an empty table gives an empty result. Extra columns of `documents` are kept by dedup_lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailknit.llm import common

LINES = 3


def _order(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}doc_id").isNull().alias("no_id"), F.col(f"{prefix}doc_id").alias("id"), F.col(f"{prefix}text_key").alias("tk")]


def covered_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """(doc_id, text_key, covered): the distinct positions of the lines that repeated windows cover, where there are any."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("text_key"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    lines = lines.where(F.size("lines") >= size)
    part = [lambda i, k=k: F.get("lines", i + k) for k in range(size)]
    window = F.transform(F.sequence(F.lit(0), F.size("lines") - size), lambda i: F.struct(F.xxhash64(*[p(i) for p in part]).alias("h1"), F.xxhash64(F.lit("other"), *[p(i) for p in part]).alias("h2")))
    windows = lines.select("doc_id", "text_key", F.posexplode(window).alias("pos", "w")).select("doc_id", "text_key", "pos", "w.h1", "w.h2")
    first = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct(*_order(), F.col("pos"))).alias("first")).where("n > 1")
    first = common.cut(first, "line-first")
    later = windows.join(first, ["h1", "h2"]).where(F.struct(*_order(), F.col("pos")) > F.col("first"))
    hit = F.flatten(F.collect_list(F.sequence(F.col("pos"), F.col("pos") + size - 1)))
    return later.groupBy("doc_id", "text_key").agg(F.array_distinct(hit).alias("covered"))


def dedup_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """docs with text without the covered lines, and with n_lines and n_removed."""
    gone = covered_lines(docs, size).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__tk"), F.col("covered").alias("__gone"))
    out = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (common.text_key() == F.col("__tk")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    new = {"text": text, "n_lines": F.size(lines), "n_removed": F.coalesce(F.size("__gone"), F.lit(0))}
    return out.select(*[new["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], new["n_lines"].alias("n_lines"), new["n_removed"].alias("n_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i - 1 AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k
      FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM later),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM d),
kept AS (SELECT a.doc_id, string_agg(line, chr(10) ORDER BY a.pos) AS text, count(*) AS n
         FROM lines a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY 1)
SELECT d.doc_id, coalesce(k.text, '') AS text, CAST(len(l) AS INTEGER) AS n_lines, CAST(len(l) - coalesce(k.n, 0) AS INTEGER) AS n_removed
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
