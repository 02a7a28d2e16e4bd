"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes. Each node has a failure link: the node for what is left of its
string once the greedy longest pieces at its front are popped, and the number of pieces so popped, both computed
once. Reading a word then never goes back: on a missing edge the count of popped pieces is added and the failure
link followed, so a word costs a number of steps linear in its length, whatever the pieces, and no piece is built.

Words are runs of bytes other than ASCII white space; a word that follows another byte of the text is read with one
space before it if `space` is set (byte-level vocabularies hold word beginnings that way). All 256 single bytes
count as pieces, so every word can be cut. Short words are looked up in a bounded cache of earlier results; long ones
run through the automaton every time.

Defined cases: a null or empty text has no words and no tokens; rows given twice are counted twice; null ids pass
through; other columns are not read. A text of any length is read word by word, and a word of any length byte by byte, in
time linear in it; a task holds one text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, CACHED_BYTES = 400_000, 64


class Automaton:
    """goto: 256 edges a node, -1 where missing; fail and popped: the node to go on from, and pieces popped on the way (fail -1: the string can't be cut, which no reachable node has)."""

    def __init__(self, pieces: Iterable[bytes]):
        pieces = {p for p in pieces if p} | {bytes([b]) for b in range(256)}
        children: list[dict[int, int]] = [{}]
        piece_at = [False]
        for p in pieces:
            node = 0
            for b in p:
                step = children[node].get(b)
                if step is None:
                    step = children[node][b] = len(children)
                    children.append({})
                    piece_at.append(False)
                node = step
            piece_at[node] = True
        n = len(children)
        self.fail, self.popped = [-1] * n, [0] * n
        level = [(0, -1, 0)]
        while level:  # breadth first: a failure link leads to a shorter string
            following = []
            for node, parent, b in level:
                if node:
                    if piece_at[node]:
                        self.fail[node], self.popped[node] = 0, 1
                    elif parent >= 0:
                        at, count = self.fail[parent], self.popped[parent]
                        while at >= 0 and b not in children[at]:
                            count, at = count + self.popped[at], self.fail[at]
                        if at >= 0:
                            self.fail[node], self.popped[node] = children[at][b], count
                following += [(child, node, c) for c, child in children[node].items()]
            level = following
        self.children = children

    def count(self, word: bytes) -> int:
        """The number of pieces of the greedy longest-match cut."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for b in word:
            step = children[node].get(b)
            while step is None:
                total += popped[node]
                node = fail[node]
                step = children[node].get(b)
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total


def pieces_of(path: str) -> list[bytes]:
    """The byte strings of a vocabulary in ranks form: base64 of the piece, a space, its number, one a line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


_automata: dict[str, Automaton] = {}


def _counted(path: str, space: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _automata:
            _automata[path] = Automaton(pieces_of(path))
        count = _automata[path].count
        cache: dict[bytes, int] = {}
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for i, value in enumerate(batch.column(1).cast(pa.large_binary())):
                text = value.as_py() or b""
                words = text.split()
                total = 0
                for k, word in enumerate(words):
                    # only the text's first byte has nothing before it
                    lead = space and (k > 0 or text[:1].isspace())
                    key = b" " + word if lead else word
                    n = cache.get(key)
                    if n is None:
                        n = count(key)
                        if len(word) <= CACHED_BYTES:
                            if len(cache) >= CACHE:
                                cache.clear()
                            cache[key] = n
                    total += n
                rows[i] = len(text), len(words), total
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, j]) for j in range(3))], names=["id", "n_bytes", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_bytes, n_words and n_tokens."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(_counted(vocabulary, space), f"id {kind}, n_bytes long, n_words long, n_tokens long").withColumnRenamed("id", id_col)
