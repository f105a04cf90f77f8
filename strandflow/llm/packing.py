"""Operator 7, packing: concatenate and cut.

Pass one encodes each document once and stores its ids with the number of its task and the ids before it in that task.
The totals of the tasks, summed up in order, give every task's global offset; pass two adds the two and cuts each
document at the multiples of the window.  A window that two or more tasks share is made of the boundary records that
they store: no rows are moved or sorted to cut, and only the last window of all is not full.

The stored table fixes order: a task that is run again writes its rows again whole, before anything is cut.

Defined results: null and empty texts are a document of the end id alone; repeated rows are packed each; an empty table
gives no pieces; a text longer than a window is cut into as many pieces as needed; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import cut, id_and_text, per_batch, small_batches
from strandflow.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, before, doc_id, n, ids: every document's ids with the end id, and its place in its task."""

    def encode(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], enc.kind).tobytes()
        for b in small_batches(batches):
            ids = [enc.ids(t.decode("utf-8", "replace")) + end for t in b.column("text").to_pylist()]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // enc.kind.itemsize
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(before), b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    return cut(id_and_text(docs, id_col, text_col).mapInArrow(encode, "part long, before long, doc_id long, n long, ids binary"), "ids")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of ``window`` ids: ``PIECES``, with the ids as little-endian 32-bit integers."""
    stored = encode_table(docs, tokenizer, end_id, id_col, text_col)
    # One row for each task of pass one, never for each document.
    totals = {r.part: r.n for r in stored.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    parts = np.array(sorted(totals), np.int64)
    sums = np.cumsum([0, *(totals[p] for p in parts.tolist())])
    first = docs.sparkSession.sparkContext.broadcast((parts, sums[:-1]))
    kind = encoder(tokenizer).kind.str

    def cut_rows(b: pa.RecordBatch) -> pa.RecordBatch:
        keys, bases = first.value
        at = bases[np.searchsorted(keys, b.column("part").to_numpy())] + b.column("before").to_numpy()
        out: list[list] = [[] for _ in range(8)]
        for doc, g, n, raw in zip(b.column("doc_id").to_pylist(), at.tolist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
            ids, start = np.frombuffer(raw, kind).astype("<u4").tobytes(), 0
            while start < n:
                seq, off = divmod(g + start, window)
                length = min(n - start, window - off)
                piece = ids[4 * start : 4 * (start + length)]
                for column, value in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, off, piece), strict=True):
                    column.append(value)
                start += length
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.binary())], names)

    return stored.mapInArrow(per_batch(cut_rows), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_pieces, ids: whole windows from their pieces; a group has at most ``window`` pieces."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(rows["ids"], F.lit(b""), lambda a, x: F.concat(a, x))
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), joined.alias("ids"))
