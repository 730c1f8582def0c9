"""Merkle fingerprints of documents over sections, paragraphs and pieces.

A text is cut into paragraphs at line ends, paragraphs into pieces (sentences; long ones are cut again at words chosen by
their own hash). Sections end at blank lines and after paragraphs chosen by their hash, so that an edit never moves the
boundaries elsewhere. A leaf is the 128-bit hash of a piece; an inner node is the hash of its children's hashes. Equal roots mean
equal texts; descending only into branches whose hashes differ locates edits, down to a piece.

A fingerprint is a string: root, '/', then leaves as hash.length, with ',' between pieces, ';' between paragraphs and '|'
between sections; inner nodes follow from the leaves. likeness() compares two fingerprints: branches with equal hashes
match whole, what differs is compared one level down, and the result is the share of the bytes that match (Dice).

pair_with_next() gives every document the next one by descending doc_id without a global sort in one task: documents are dealt
into ranges of doc_id by quantiles (those without one by the hash of their text), each range is sorted in its own
partition, and the first document of the following range is added to it. The text is shuffled once. Like the bounds of
Spark's own range partitioning, the quantiles are bounded by the number of partitions, not by the rows: there are as many ranges as
the texts' bytes ask for up to MOST_RANGES, and beyond that as many as spark.sql.shuffle.partitions says. A row finds its
range in two look-ups, of about the square root of their number.

Edge cases: a null text is empty; two empty texts are alike (1.0), an empty and another are not (0.0); a single row is
its own next; rows without doc_id come last; rows of equal doc_id are ordered by a hash of their text; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from trailknit.llm import common

PIECE = re.compile(rb"[^.!?]*(?:[.!?]+\s*|\Z)")
WORD = re.compile(rb"\S*\s*")
LONG_PIECE, PIECE_TURN, SECTION_TURN = 200, 8, 8
NODE_BYTES = 16
TASK_BYTES, MOST_RANGES = 16 << 20, 10_000


def _hash(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=NODE_BYTES, person=kind).digest()


@dataclass(frozen=True)
class Node:
    digest: bytes
    size: int
    children: tuple

    @staticmethod
    def over(kind: bytes, children: list) -> Node:
        return Node(_hash(kind, b"".join(c.digest for c in children)), sum(c.size for c in children), tuple(children))


def _pieces(paragraph: bytes) -> Iterator[bytes]:
    for piece in PIECE.findall(paragraph):
        if len(piece) <= LONG_PIECE:
            if piece:
                yield piece
            continue
        held = []
        for word in WORD.findall(piece):
            held.append(word)
            if word and zlib.crc32(word) % PIECE_TURN == 0:
                yield b"".join(held)
                held = []
        if any(held):
            yield b"".join(held)


def tree(text: str | None) -> Node:
    """The Merkle tree of a text: root, sections, paragraphs, pieces."""
    sections, held = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").splitlines(keepends=True) if text else ():
        paragraph = Node.over(b"paragraph", [Node(_hash(b"piece", p), len(p), ()) for p in _pieces(line)])
        held.append(paragraph)
        if not line.strip() or paragraph.digest[0] % SECTION_TURN == 0:
            sections.append(Node.over(b"section", held))
            held = []
    if held:
        sections.append(Node.over(b"section", held))
    return Node.over(b"root", sections)


def fingerprint(root: Node) -> str:
    return root.digest.hex() + "/" + "|".join(";".join(",".join(f"{leaf.digest.hex()}.{leaf.size:x}" for leaf in p.children) for p in s.children) for s in root.children)


def parse(text: str) -> Node:
    """The tree of a fingerprint; its root is checked."""
    root, _, rest = text.partition("/")
    leaf = lambda x: Node(bytes.fromhex(x.split(".")[0]), int(x.split(".")[1], 16), ())
    out = Node.over(b"root", [Node.over(b"section", [Node.over(b"paragraph", [leaf(x) for x in p.split(",")]) for p in s.split(";")]) for s in rest.split("|")] if rest else [])
    if out.digest.hex() != root:
        raise ValueError("the root doesn't match the leaves")
    return out


def _unmatched(a: list[Node], b: list[Node]) -> tuple[int, list[Node], list[Node]]:
    spare = Counter(x.digest for x in a) & Counter(x.digest for x in b)
    if not spare:
        return 0, a, b
    used, size, left, right = spare.copy(), 0, [], []
    for x in a:
        if used[x.digest] > 0:
            used[x.digest] -= 1
            size += x.size
        else:
            left.append(x)
    for x in b:
        if spare[x.digest] > 0:
            spare[x.digest] -= 1
        else:
            right.append(x)
    return size, left, right


def likeness(a: Node, b: Node) -> float:
    """Twice the bytes of the branches that match over the bytes of both; 0 to 1."""
    if a.digest == b.digest:
        return 1.0
    if not a.size or not b.size:
        return 0.0
    same, left, right = 0, [a], [b]
    for _ in range(3):
        size, left, right = _unmatched([c for x in left for c in x.children], [c for x in right for c in x.children])
        same += size
    return 2 * same / (a.size + b.size)


def edits(a: Node, b: Node) -> list[tuple[int, int, int]]:
    """(section, paragraph, piece) of the pieces of a in branches that b has not."""
    out = []
    sections = {x.digest for x in b.children}
    paragraphs = {p.digest for x in b.children for p in x.children}
    pieces = {q.digest for x in b.children for p in x.children for q in p.children}
    for i, s in enumerate(a.children):
        if s.digest not in sections:
            for j, p in enumerate(s.children):
                if p.digest not in paragraphs:
                    out += [(i, j, k) for k, q in enumerate(p.children) if q.digest not in pieces]
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of the other text's first ones, or all of them."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most the key: found by every step-th bound first, then within a step."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    # a text is one constant of the plan, where an array of numbers would be an expression for each
    constant = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")
    at = F.size(F.filter(constant(bounds[::step]), lambda b: b <= key))
    within = F.size(F.filter(F.slice(constant(bounds), (at - 1) * step + 1, step), lambda b: b <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * step + within)


def pair_with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) and, as extra rows with head, the first document of the range that follows; dealt by range and sorted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = common.partitions(spark, min(-(-size // TASK_BYTES), MOST_RANGES))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n))).first()[0] or []
    share = F.shiftright((F.shiftright(F.xxhash64("text"), 32) + (1 << 31)) * n, 32).cast("int")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1 - share).otherwise(_range_of(F.col("doc_id"), sorted(set(found)))))
    place = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.bitwise_not(F.xxhash64("text")).alias("tie"))
    tops = rows.groupBy("part").agg(F.max(place).alias("top"))
    # one row a range, and the first range follows the last
    order = W.orderBy(F.desc("part"))
    after = F.coalesce(F.lead(F.struct("part", "top")).over(order), F.first(F.struct("part", "top")).over(order))
    follow = tops.select("part", after.alias("after")).select("part", F.col("after.part").alias("source"), F.col("after.top").alias("top"))
    first = rows.withColumnRenamed("part", "source").join(F.broadcast(follow), "source").where(place == F.col("top"))
    heads = first.groupBy("part").agg(F.first("text").alias("text"))
    both = rows.select("part", "doc_id", "text", F.lit(False).alias("head")).union(heads.select("part", F.lit(None).cast("long"), "text", F.lit(True)))
    return both.repartition(n, "part").sortWithinPartitions(F.desc("part"), "head", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    out: list[tuple] = []
    held = None
    size = 0
    for batch in batches:
        for doc_id, x, head in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("head").to_pylist(), strict=True):
            text = x.as_py()
            own = tree(text)
            if held is not None:
                before, old, was = held
                new = edited(old, text)
                changed = tree(new)
                out.append((before, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(was), fingerprint(changed), likeness(was, changed), likeness(was, own)))
                size += len(out[-1][3]) + len(out[-1][4])
            held = None if head else (doc_id, text, own)
            if len(out) >= 2000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    return pair_with_next(docs).mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
