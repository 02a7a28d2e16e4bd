"""Document fingerprints: a Merkle tree over sections, paragraphs and short runs of words.

A text is cut, without losing a byte, into sections (after a blank line, and after every SECTION paragraphs without
one), a section into paragraphs (after a line end), a paragraph into leaves: runs of words that end where a word's
checksum says so (every fourth word on average, LEAF_WORDS at most), so the same words make the same leaves wherever they
stand. In paragraphs of at most SHORT_WORDS words each word is a leaf, and words of more than 8 bytes are cut into pieces
of 4. A leaf's digest is that of its bytes, a node's that of its children's digests; the root is the fingerprint, so equal
roots mean equal texts.

The tree is emitted beside its root (`tree`: digests of sections and paragraphs, 4 bytes of each leaf's, and lengths, about
a quarter of the text), and likeness needs nothing else: from the root down, branches with equal digests count with all
their bytes and only differing ones are opened; the bytes in common, as multisets, are divided by those of the longer text.
Walking down the branches whose digests differ also finds the first edited section and paragraph.

Defined cases: a null text is empty; an empty text is a root without children; rows given twice follow each other;
equal ids rank by a hash of the text, null ids come last. A very long text is one row: a task holds it, its edited form and
their trees, and no more than two documents at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as w
from ._frames import dealt, partitions, text_bytes

SECTION, LEAF_WORDS, SHORT_WORDS, DIGEST = 8, 8, 16, 16
#: Bytes of text in a run of neighbouring documents.
RUN_BYTES = 16 << 20
#: Rows alike in id and text that one run takes at least.
HEAVY = 10_000
_PARAGRAPH = re.compile(rb"[^\n]*+\n|[^\n]++")
#: A word and the white space behind it.
_LEAF = re.compile(rb"\S++\s*+|\s++")


def _hash(data: bytes, blake2b=hashlib.blake2b) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def _leaves(paragraph: bytes) -> list[bytes]:
    words = _LEAF.findall(paragraph)
    if len(words) <= SHORT_WORDS:
        return [x for word in words for x in ([word] if len(word) <= 8 else [word[i : i + 4] for i in range(0, len(word), 4)])]
    out, begin = [], 0
    for i, word in enumerate(words, 1):
        if i - begin == LEAF_WORDS or not zlib.crc32(word) & 3:
            out.append(b"".join(words[begin:i]))
            begin = i
    return [*out, b"".join(words[begin:])] if begin < len(words) else out


def _node(paragraph: bytes) -> tuple:
    leaves = _leaves(paragraph)
    digests = list(map(_hash, leaves))
    marks = array("Q", [h << 32 | len(x) for (h,), x in zip(struct.iter_unpack("<I12x", b"".join(digests)), leaves, strict=True)])
    return _hash(b"p" + b"".join(digests)), len(paragraph), marks


class Tree:
    """root; size: bytes of the text; sections: (digest, bytes, paragraphs), a paragraph: (digest, bytes, leaves), a leaf: 4 bytes of its digest << 32 | its bytes."""

    __slots__ = ("nodes", "root", "sections", "size")

    def __init__(self, text: bytes, *known: dict[bytes, tuple]):
        """known: paragraphs of other trees (their `nodes`), which aren't hashed again."""
        self.size, self.sections, self.nodes = len(text), [], {}
        section: list[tuple] = []
        for paragraph in _PARAGRAPH.findall(text):
            node = self.nodes.get(paragraph)
            if node is None:
                node = next((k[paragraph] for k in known if paragraph in k), None) or _node(paragraph)
                self.nodes[paragraph] = node
            section.append(node)
            if len(section) == SECTION or not paragraph.strip():
                self._close(section)
                section = []
        if section:
            self._close(section)
        self.root = _hash(b"r" + b"".join(d for d, _, _ in self.sections))

    def _close(self, section: list[tuple]) -> None:
        self.sections.append((_hash(b"s" + b"".join(d for d, _, _ in section)), sum(n for _, n, _ in section), section))

    @property
    def leaves(self) -> int:
        return sum(len(marks) for _, _, paragraphs in self.sections for _, _, marks in paragraphs)

    def encoded(self) -> bytes:
        """The tree as bytes, from which `decoded` makes it again: all that likeness needs."""
        out = [self.root, struct.pack("<QI", self.size, len(self.sections))]
        for digest, _, paragraphs in self.sections:
            out.append(digest + struct.pack("<I", len(paragraphs)))
            for d, _, marks in paragraphs:
                lens = [m & 0xFFFFFFFF for m in marks]
                width = "B" if max(lens) < 256 else "I"
                out.append(d + struct.pack("<I?", len(marks), width == "I") + struct.pack(f"<{len(marks)}I", *(m >> 32 for m in marks)) + struct.pack(f"<{len(lens)}{width}", *lens))
        return b"".join(out)

    @classmethod
    def decoded(cls, data: bytes) -> Tree:
        self, at = cls.__new__(cls), DIGEST + 12
        self.root, self.sections, self.nodes = data[:DIGEST], [], {}
        self.size, count = struct.unpack_from("<QI", data, DIGEST)
        for _ in range(count):
            digest, (n,) = data[at : at + DIGEST], struct.unpack_from("<I", data, at + DIGEST)
            at, paragraphs = at + DIGEST + 4, []
            for _ in range(n):
                d, (k, wide) = data[at : at + DIGEST], struct.unpack_from("<I?", data, at + DIGEST)
                at += DIGEST + 5
                heads, lens = struct.unpack_from(f"<{k}I", data, at), struct.unpack_from(f"<{k}{'I' if wide else 'B'}", data, at + 4 * k)
                at += k * (8 if wide else 5)
                paragraphs.append((d, sum(lens), array("Q", (h << 32 | x for h, x in zip(heads, lens, strict=True)))))
            self.sections.append((digest, sum(x for _, x, _ in paragraphs), paragraphs))
        return self

    def likeness(self, other: Tree) -> float:
        """Bytes of equal branches, found from the root down, over those of the longer text."""
        if self.root == other.root:
            return 1.0
        common, a, b = 0, self.sections, other.sections
        for _ in range(2):  # sections, then the paragraphs of those that differ
            same, a, b = _paired(a, b)
            common, a, b = common + same, [x for _, _, inner in a for x in inner], [x for _, _, inner in b for x in inner]
        mine, theirs = Counter(a), Counter(b)
        small, large = sorted((mine, theirs), key=len)
        common += sum((m & 0xFFFFFFFF) * min(n, large[m]) for m, n in small.items() if m in large)
        return min(common / max(self.size, other.size, 1), 1.0 - 1e-9)

    def first_difference(self, other: Tree) -> tuple[int, int] | None:
        """(section, paragraph in it) where the trees part, or None for equal roots."""
        if self.root == other.root:
            return None
        digests = lambda nodes: [d for d, _, _ in nodes]
        for s in range(max(len(self.sections), len(other.sections))):
            if digests(self.sections[s : s + 1]) != digests(other.sections[s : s + 1]):
                ours, theirs = (digests(t.sections[s][2]) if s < len(t.sections) else [] for t in (self, other))
                return s, next((p for p in range(max(len(ours), len(theirs))) if ours[p : p + 1] != theirs[p : p + 1]), 0)
        return None


def _paired(a: list[tuple], b: list[tuple]) -> tuple[int, list[tuple], list[tuple]]:
    """Bytes of the nodes that two lists have in common, and the rest of each."""
    free, common, rest = Counter(d for d, _, _ in b), 0, []
    used: Counter = Counter()
    for node in a:
        if used[node[0]] < free[node[0]]:
            used[node[0]] += 1
            common += node[1]
        else:
            rest.append(node)
    left = []
    for node in b:
        if used[node[0]]:
            used[node[0]] -= 1
        else:
            left.append(node)
    return common, rest, left


def edited(text: str, following: str) -> str:
    """text, its last half (rounded down, in code points) replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("first_section", pa.int32()), ("first_paragraph", pa.int32()), ("n_sections", pa.int32()), ("n_leaves", pa.int64()), ("tree", pa.binary())])
_DDL = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_section int, first_paragraph int, n_sections int, n_leaves long, tree binary"


def _pair(key: int | None, text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    e = edited(text, following).encode()
    changed = Tree(e, tree.nodes, next_tree.nodes)
    at = tree.first_difference(changed) or (None, None)
    return key, len(text), hashlib.sha256(e).hexdigest(), tree.root.hex(), changed.root.hex(), tree.likeness(changed), tree.likeness(next_tree), *at, len(tree.sections), tree.leaves, tree.encoded()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_OUT)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


#: Kinds of rows in a run, in order: its documents, the first document of the next run, copies that follow one another.
_OWN, _NEXT, _COPY = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (run, kind, id, text) in order: a document's next is the row behind it, a copy's is a copy."""
    before = None
    for batch in batches:
        rows = []
        for kind, key, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            text = value.as_py()
            tree = Tree(text.encode())
            if kind == _COPY:
                rows.append(_pair(key, text, tree, text, tree))
                continue
            if before is not None:
                rows.append(_pair(*before, text, tree))
            before = (key, text, tree) if kind == _OWN else None
        yield _table(rows)


#: Runs at most: as many keys are known to every task.
MAX_RUNS = 20_000
_KEY = ["none", "down", "h"]
_KEYS = np.dtype([("none", "?"), ("down", "<i8"), ("h", "<i8")])


def _dealer(cuts: np.ndarray, heavy: np.ndarray, parts: np.ndarray):
    """(none, down, h, chance) -> run * 4 + kind: the run that a key falls into; copies of a heavy key but one part of them go to further runs."""

    def deal(none: pd.Series, down: pd.Series, h: pd.Series, chance: pd.Series) -> pd.Series:
        keys = np.empty(len(none), dtype=_KEYS)
        keys["none"], keys["down"], keys["h"] = none, down, h
        run = np.searchsorted(cuts, keys, side="right") - 1
        kind = np.full(len(keys), _OWN)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
            part = np.where(heavy[at] == keys, (chance.to_numpy() * parts[at]).astype(np.int64), 0)
            kind, run = np.where(part > 0, _COPY, kind), (run + part) % len(cuts)
        return pd.Series(run.astype(np.int64) * 4 + kind)

    return F.pandas_udf(deal, "long")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document in descending order of ids (after the last, the first).

    Keys alone are sorted into ranges first; the first key of each range is known to every task then (MAX_RUNS at most), and
    texts are dealt once, into the runs between these keys. The document with such a key is also sent to the run before.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.col("id").isNull().alias("none"), F.coalesce(F.bitwise_not("id"), F.lit(0)).cast("long").alias("down"), F.xxhash64("text").alias("h"), "id", "text")
    wanted = max(partitions(spark), min(-(-text_bytes(rows) // RUN_BYTES), MAX_RUNS))
    ranges = keyed.select(*_KEY).repartitionByRange(wanted, *_KEY).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*_KEY)).alias("first"), F.count(F.lit(1)).alias("n")).collect()
    cuts = np.array(sorted(tuple(r["first"]) for r in ranges), dtype=_KEYS)
    runs = max(1, len(cuts))
    # a key that alone is more than a run: fewer of them than runs
    large = max(HEAVY, sum(r["n"] for r in ranges) // runs)
    many = sorted((*(r[c] for c in _KEY), r["n"]) for r in keyed.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > large).collect())
    heavy, parts = np.array([m[:3] for m in many], dtype=_KEYS), np.array([-(-m[3] // large) for m in many], dtype=np.int64)
    to = _dealer(cuts, heavy, parts)
    mine = keyed.withColumn("to", to(*_KEY, F.rand(11)))
    firsts = spark.createDataFrame([(*(x.item() for x in c), (i - 1) % runs) for i, c in enumerate(cuts)], "none boolean, down long, h long, run long")
    after = keyed.join(F.broadcast(firsts), _KEY).groupBy("run").agg(F.first("text").alias("text"))
    own = mine.select(F.expr("to div 4").cast("int").alias("run"), (F.col("to") % 4).cast("int").alias("kind"), "id", "text", *_KEY)
    none = [F.lit(None).cast(t).alias(c) for c, t in zip(_KEY, ("boolean", "long", "long"), strict=True)]
    every = own.union(after.select(F.col("run").cast("int"), F.lit(_NEXT), F.lit(None).cast("long"), "text", *none))
    ordered = dealt(every, runs, "run").sortWithinPartitions("run", "kind", *_KEY)
    return ordered.select("run", "kind", "id", "text").mapInArrow(w.trimmed(_neighbours), _DDL).withColumnRenamed("id", id_col)
