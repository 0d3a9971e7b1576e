"""Packing into training sequences by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.batches import text_steps, tidied
from paperloom.llm.bpe import Vocabulary


def pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full sequences first, then the binary digits of the rest, largest first."""
    out = [(s, most) for s in range(0, n - most + 1, most)]
    at, left = n - n % most, n % most
    while left:
        size = 1 << (left.bit_length() - 1)
        out.append((at, size))
        at, left = at + size, left - size
    return out


def pack(docs: DataFrame, vocabulary_path: str, *, most: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece of each document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids array<int>, if asked for).

    A document's tokens, then end_id, are cut into pieces whose lengths are powers of two, `most` (itself one) at most.
    Each piece is a sequence of its own, so no sequence crosses documents and none holds padding; sequences of equal
    length share a bucket (the length's logarithm), from which equal-shaped batches are drawn. Row by row, no shuffle.
    A null text is empty and gives the end_id alone. Repeated rows are packed as often as they occur; null ids stay null.
    sequence_id is unique in one result and the same on each attempt of a task, as it follows the order of the input.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, end = Vocabulary(vocabulary_path), np.array([end_id], np.uint32)
        for b in batches:
            rows: list[tuple] = []
            owners: list[int] = []

            def flush(b=b) -> pa.RecordBatch:
                columns = list(zip(*rows))
                arrays = [b.column(0).take(pa.array(owners, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4])] + ([pa.array(columns[4], pa.list_(pa.int32()))] if ids else [])
                rows.clear()
                owners.clear()
                return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * ids)

            for i, text in enumerate(t for _, _, texts in text_steps(b.column(1)) for t in texts):
                x = np.concatenate([v.encode(text), end])
                for start, size in pieces(len(x), most):
                    part = x[start : start + size]
                    rows.append((start, size, zlib.crc32(part.astype("<u4").tobytes()), len(x), *([part.astype(np.int32)] if ids else [])))
                    owners.append(i)
                if len(rows) >= (2_000 if ids else 20_000):
                    yield flush()
            if rows:
                yield flush()

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(tidied(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")}).withColumnRenamed("id", id_column)
