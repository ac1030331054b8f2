"""Packing token sequences into windows by the sum-of-squares rule."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteBpe

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of documents in sequences of at most `window` tokens, one row each.

    A document is its ids by the tokenizer file `tokenizer`, then `end_id`. Whole windows are cut off its
    front; the rest is placed online into the fill level at which the sum of squared counts of partly
    filled windows grows least. Each task packs what it reads with a level array of its own. When a task
    ends, the emptiest windows are cut up to fill the fullest, so that one window a task at most is left
    short: padding doesn't grow with the documents. The rule keeps few windows open (about 200 after 40,000
    documents), whatever the number of documents.

    Columns: doc_id, start (the document's ids before the piece), length, ids (little-endian unsigned 32
    bits), doc_tokens, sequence_id (unique over tasks), offset (in the sequence). A null text is an empty
    one: just `end_id`. Rows are packed each for itself, whatever their ids.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocab = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        bpe, packer, end = ByteBpe(vocab.value), Packer(window, TaskContext.get().partitionId() << 33), np.array([end_id], "<u4").tobytes()
        for x in batches:
            for doc, text in zip(*(c.to_pylist() for c in x.columns), strict=True):
                packer.add(doc, bpe.encode(text or "") + end)
                if len(packer.done) >= 4096:
                    yield packer.take()
        packer.close()
        yield packer.take()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


class Packer:
    """A piece is [doc, start, ids as bytes, tokens of the document]; a window is its list of pieces."""

    def __init__(self, window: int, first_id: int = 0):
        self.window, self.next_id, self.done = window, first_id, []
        self.levels, self.open = np.zeros(window + 1, np.int64), defaultdict(list)

    def add(self, doc, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            self.finish([[doc, at, ids[4 * at : 4 * (at + self.window)], total]])
            at += self.window
        if at < total:
            self.place([doc, at, ids[4 * at :], total])

    def place(self, piece) -> None:
        size = len(piece[2]) // 4
        level = self.best(size)
        held = self.leave(level) if level else []
        held.append(piece)
        self.enter(held, level + size)

    def best(self, size: int) -> int:
        """The fill level (0: a new window) at which the sum of squares grows least; the fullest of equals."""
        n, w = self.levels, self.window
        grows = 2 * (n[size:] - n[: w - size + 1]) + 2
        grows[0] -= 1
        grows[-1] -= 1
        grows[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        return w - size - int(np.argmin(grows[::-1]))

    def enter(self, held, level: int) -> None:
        if level == self.window:
            self.finish(held)
        else:
            self.levels[level] += 1
            self.open[level].append(held)

    def leave(self, level: int):
        self.levels[level] -= 1
        return self.open[level].pop()

    def close(self) -> None:
        """Fill the fullest open windows with pieces, cut where needed, of the emptiest."""
        held = [(level, x) for level in sorted(self.open, reverse=True) for x in self.open[level]]
        self.levels[:] = 0
        self.open.clear()
        first, spare = 0, []
        while first < len(held):
            level, x = held[first]
            first += 1
            while level < self.window and (spare or first < len(held)):
                if not spare:
                    spare = held.pop()[1]
                piece, room = spare.pop(), self.window - level
                if len(piece[2]) // 4 > room:
                    doc, start, ids, total = piece
                    spare.append([doc, start, ids[: -4 * room], total])
                    piece = [doc, start + len(ids) // 4 - room, ids[-4 * room :], total]
                x.append(piece)
                level += len(piece[2]) // 4
            self.finish(x)
            if spare and first >= len(held):
                held.append((sum(len(p[2]) // 4 for p in spare), spare))
                spare = []

    def finish(self, held) -> None:
        offset = 0
        for doc, start, ids, total in held:
            self.done.append((doc, start, len(ids) // 4, ids, total, self.next_id, offset))
            offset += len(ids) // 4
        self.next_id += 1

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
