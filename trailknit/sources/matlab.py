"""Reader of level-5 .mat files: numeric matrices, texts and cells of texts, as rows.

Files come through Spark's own reader of whole files, so any store that Spark reads will do, and several files are read in
parallel. One file is parsed by one task, which holds it and the variable asked for (the format allows 2 GB for each); a variable
can't be read in parts, as it is one compressed stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: element types, their NumPy letters, and array classes.
LETTERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
UTF = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, CHAR = 1, 4
ROWS = 1 << 16


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the elements that stand one after another."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element has its size in the upper half, and its content at once
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _numbers(kind: int, content: memoryview, order: str) -> np.ndarray:
    if kind not in LETTERS:
        raise ValueError(f"element type {kind} holds no numbers")
    return np.frombuffer(content, order + LETTERS[kind])


def _array(content: memoryview, order: str) -> tuple[str, object]:
    """(name, value) of a matrix element: a NumPy matrix, a text, or a list of values for a cell."""
    parts = list(_elements(content, order))
    if not parts:
        return "", np.empty((0, 0))
    flags, shape, name = _numbers(*parts[0], order), _numbers(*parts[1], order), bytes(parts[2][1]).decode()
    sort = int(flags[0]) & 0xFF
    if sort == CELL:
        return name, [_array(c, order)[1] for k, c in parts[3:] if k == MATRIX]
    if sort == CHAR:
        kind, text = parts[3] if len(parts) > 3 else (1, memoryview(b""))
        codec = UTF.get(kind)
        chars = bytes(text).decode(f"{codec}-le" if codec and order == "<" and codec != "utf-8" else f"{codec}-be" if codec and codec != "utf-8" else codec) if codec else "".join(map(chr, _numbers(kind, text, order)))
        rows = np.array(list(chars)).reshape([int(x) for x in shape], order="F") if len(chars) == int(np.prod(shape)) else np.array([list(chars)])
        return name, "\n".join("".join(r) for r in rows)
    if len(parts) < 4 or parts[3][0] not in LETTERS:
        raise ValueError(f"{name or 'an array'}: only matrices of numbers, texts and cells can be read")
    return name, _numbers(*parts[3], order).reshape([int(x) for x in shape], order="F")


def variables(data: bytes) -> Iterator[tuple[str, object]]:
    """(name, value) of a file's variables."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 .mat file")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, content in _elements(memoryview(data)[128:], order):
        if kind == COMPRESSED:
            kind, content = next(_elements(memoryview(zlib.decompress(content)), order))
        if kind == MATRIX:
            yield _array(content, order)


def read_mat(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(file, row, values, text): the rows of a variable, counted from 0, in each file of the path that has it.

    A matrix gives values (array<double>), a text or a cell of texts or numbers gives a row for each item. No file with the variable
    is an error.
    """
    schema = "file string, row long, values array<double>, text string"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for found in (v for n, v in variables(content) if n == name):
                    items = found if isinstance(found, list) else [found] if isinstance(found, str) else None
                    n = len(found if items is None else items)
                    for at in range(0, n, ROWS):
                        ids = pa.array(np.arange(at, min(at + ROWS, n), dtype=np.int64))
                        part = np.asarray(found[at : at + ROWS], np.float64).reshape(len(ids), -1).tolist() if items is None else [None if isinstance(v, str) else np.ravel(v).astype(float).tolist() for v in items[at : at + ROWS]]
                        text = [None] * len(ids) if items is None else [v if isinstance(v, str) else None for v in items[at : at + ROWS]]
                        yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), ids, pa.array(part, pa.list_(pa.float64())), pa.array(text, pa.string())], ["file", "row", "values", "text"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, schema)
    if out.isEmpty():
        raise ValueError(f"{path} has no variable {name}")
    return out


def read_checkins(spark: SparkSession, path: str) -> DataFrame:
    """row, user_id (from 0), slot, venue, category of the four columns of `selected_checkins`."""
    c = read_mat(spark, path, "selected_checkins")
    value = lambda i: F.get("values", i).cast("long")
    return c.select("row", (value(0) - 1).alias("user_id"), value(1).alias("slot"), value(2).alias("venue"), value(3).alias("category"))


def read_friendships(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(u1, u2), from 0 and in ascending order, of a matrix of pairs; no self loops, each pair once."""
    f = read_mat(spark, path, name).select((F.get("values", 0).cast("long") - 1).alias("a"), (F.get("values", 1).cast("long") - 1).alias("b"))
    return f.where("a <> b").select(F.least("a", "b").alias("u1"), F.greatest("a", "b").alias("u2")).distinct()


def read_venue_ids(spark: SparkSession, path: str) -> DataFrame:
    """(poi_idx, venue_id) of the cell `selected_venue_IDs`, which has the distinct venues in ascending order."""
    return read_mat(spark, path, "selected_venue_IDs").select(F.col("row").alias("poi_idx"), F.coalesce("text", F.get("values", 0).cast("string")).alias("venue_id"))
