"""Greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary

#: Distinct words that a task remembers.
MOST = 500_000


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens): words, and pieces when each word is cut greedily, longest piece first.

    Words are runs without space and U+0009 to U+000D. A word is matched as bytes with a space in front, as
    the byte-level vocabulary of the file `tokenizer` marks the start of words; a word that can't be cut
    wholly is one (unknown) piece. A null or empty text has none. Rows are counted each for itself.
    """
    with open(tokenizer, encoding="utf-8") as f:
        automaton = docs.sparkSession.sparkContext.broadcast(build(vocabulary(f.read())))

    def run(batches):
        memo = _Counts(automaton.value)
        for x in batches:
            ids, texts = x.columns
            words = [(t or "").encode().split() for t in texts.to_pylist()]
            counts = []
            for w in words:
                if len(memo) > MOST:
                    memo.clear()
                counts.append(sum(map(memo.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, words)), pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def build(pieces) -> tuple[dict[int, int], list[int], list[int]]:
    """(step, fail, popped) of the pieces' trie.

    `step` has the child of node n by byte b at n * 256 + b. Where no child fits, matching goes on at
    `fail[n]` (-1: nowhere), and `popped[n]` pieces are known to end before it: one for a node that is
    itself a piece, else what its parent's failures pop until the byte fits again.
    """
    step: dict[int, int] = {}
    ends = [False]
    for piece in sorted(pieces, key=len):
        node = 0
        for b in piece:
            node = step.setdefault(node * 256 + b, len(ends))
            if node == len(ends):
                ends.append(False)
        ends[node] = node != 0
    children: dict[int, list[tuple[int, int]]] = {}
    for at, child in step.items():
        children.setdefault(at >> 8, []).append((at & 255, child))
    fail, popped = [-1] * len(ends), [0] * len(ends)
    level = [0]
    while level:
        below = []
        for node in level:
            for b, child in children.get(node, ()):
                below.append(child)
                if ends[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                z, n = fail[node], popped[node]
                while z >= 0 and z * 256 + b not in step:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[child], popped[child] = step[z * 256 + b], n
        level = below
    return step, fail, popped


def count_pieces(automaton, word: bytes) -> int:
    """Pieces of a word, each byte looked at once; 1 if it can't be cut wholly."""
    step, fail, popped = automaton
    node = n = 0
    for b in word:
        while (to := step.get(node * 256 + b)) is None:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        node = to
    while node > 0:
        n += popped[node]
        node = fail[node]
    return n if node == 0 else 1


class _Counts(dict):
    def __init__(self, automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = count_pieces(self.automaton, b" " + word)
        return n
