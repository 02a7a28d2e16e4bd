"""Best-fit packing: token sequences of at most `capacity` ids, filled by patterns of document lengths.

1. Each text becomes token ids plus an end id; longer ones are cut into pieces of `capacity`. Only ids' lengths and
   checksums leave the task.
2. The histogram of lengths (at most `capacity` counts, whatever the corpus) goes to the driver. There, patterns of
   up to three length classes that fill a sequence are enumerated, their repeat counts are fitted to the histogram by
   non-negative least squares and rounded down, and what is left, together with the shortest pieces kept back for
   it, goes by best fit into the patterns' gaps and into new sequences: all on (length, count) pairs.
3. The result is a table of rank ranges, of bounded size too: the r-th piece of a length belongs to one range, which
   gives its sequence and offset. Ranks come from counts of hash buckets, so that no length is in one task.

Defined cases: a null text is empty; an empty text is the end id alone; rows given twice are packed twice; other
columns are not read. Sequence numbers run from 0 without gaps. Rows alike in everything are dealt to buckets by chance,
which is written with the pieces. A text of any length is tokenized word by word; a task holds the ids of one text.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _words as w
from ._frames import written

CAPACITY, END_ID = 4096, 1
#: Pieces of one length and hash bucket, and buckets of a length at most; entries of a worker's cache of words.
BUCKET_ROWS, BUCKETS, CACHE = 1_000, 1 << 16, 400_000
#: Length classes of the fit; pieces of at most this part of a sequence are kept back for gaps.
CLASSES, KEPT_BACK = 128, 1 / 40


class WordTokenizer:
    """Ids of a text, word by white-space-delimited word, each looked up in a cache.

    White space never is part of a token in this tokenizer, so the words' ids one after another are the text's.
    Words of plain Latin characters take the model's merges directly; others take the whole tokenizer.
    """

    #: The tokenizer's own split pattern.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Latin letters and then punctuation (no apostrophe): the two tokens of SPLIT in such a word.
    SIMPLE = re.compile(r"([a-zªµºß-öø-ɏ]+)([!-&(-/:-@\[-`{-~¡-©«¬®-±´¶-¸»¿×÷]*)")
    PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xac\xae-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known = self._splits_so(path)
        self.merges = self.whole.model.tokenize
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    @classmethod
    def _splits_so(cls, path: str) -> bool:
        """Whether a tokenizer's file says what this class does by itself: if not, the library takes whole texts."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        kind = lambda x: x.get("type") if isinstance(x, dict) else None
        normal, before = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        steps, splits = normal.get("normalizers", []), before.get("pretokenizers", [])
        return (
            list(map(kind, steps)) == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and list(map(kind, splits)) == ["Split", "ByteLevel"] and splits[0]["pattern"] == {"Regex": cls.SPLIT.pattern} and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
            and not splits[1]["add_prefix_space"] and not splits[1].get("use_regex", True) and kind(d.get("model")) == "BPE" and not d["model"].get("dropout")
            and all(x["content"].startswith("<|") and not x["lstrip"] and not x["rstrip"] for x in d.get("added_tokens", []))
        )

    def part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= CACHE // 2:
                self.parts.clear()
            word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = self.parts[part] = array("I", [t.id for t in self.merges(word)]).tobytes()
        return got

    def word(self, raw: bytes) -> bytes:
        text = raw.decode()
        if m := self.SIMPLE.fullmatch(text.lower()):
            got = self.part(m[1]) + self.part(m[2]) if m[2] else self.part(m[1])
        elif self.PLAIN.fullmatch(text) and "<|" not in text:
            got = b"".join(map(self.part, self.SPLIT.findall(text.lower())))
        else:
            got = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(raw) <= 64:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[raw] = got
        return got

    def __call__(self, text: bytes) -> bytes:
        """The ids as little-endian 32-bit values."""
        if not self.known:
            return np.array(self.whole.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        have, out = self.words.get, []
        for raw in text.split():
            got = have(raw)
            out.append(self.word(raw) if got is None else got)
        return b"".join(out)


def _pieces(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, names = WordTokenizer(path), ["doc_id", "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                ids = tokenize(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def non_negative_fit(patterns: np.ndarray, target: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that minimises the squared misfit of sum(x[p] * classes in pattern p) to target, by Lawson and Hanson's active set.

    patterns: (P, depth) class numbers, -1 for an empty place.
    """
    n, (count, depth) = len(target), patterns.shape
    x, active = np.zeros(count), []
    a = np.zeros((n + 1, 0))
    residual = np.append(target.astype(float), 0.0)
    tried = np.zeros(count, dtype=bool)
    for _ in range(rounds):
        gain = sum(residual[patterns[:, k]] for k in range(depth))
        gain[active] = -np.inf
        gain[tried] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, target.max(initial=0)):
            break
        col = np.zeros((n + 1, 1))
        for c in patterns[best]:
            col[c, 0] += 1
        col[n, 0] = 0
        active.append(best)
        a = np.hstack((a, col))
        while True:
            gram = a[:n].T @ a[:n]
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(gram)), a[:n].T @ target)
            if len(z) == 0 or z.min() > 0:
                break
            if z[-1] <= 0 and active[-1] == best and x[best] == 0:
                tried[best] = True
            now = x[active]
            low = z <= 0
            step = np.min(now[low] / np.maximum(now[low] - z[low], 1e-12))
            now = now + step * (z - now)
            keep = now > 1e-9
            keep[np.argmin(np.where(low, now, np.inf))] = False
            x[np.array(active)[~keep]] = 0
            x[np.array(active)[keep]] = now[keep]
            active = [p for p, k in zip(active, keep, strict=True) if k]
            a, z = a[:, keep], z[keep]
        x[active] = z
        residual[:n] = target - a[:n] @ z if active else target
    return x


def _patterns(classes: int) -> np.ndarray:
    """Every way to fill `classes` units by one, two or three lengths of whole units; class c stands for c + 1 units."""
    found = [(classes - 1, -1, -1)]
    found += [(a - 1, classes - a - 1, -1) for a in range((classes + 1) // 2, classes)]
    found += [(a - 1, b - 1, classes - a - b - 1) for a in range(1, classes - 1) for b in range(1, min(a, classes - a - 1) + 1) if 0 < classes - a - b <= b]
    return np.array(found)


class _Group:
    """`count` sequences with the same lengths: slots are (length, times); gap is what is free in each."""

    __slots__ = ("count", "gap", "slots")

    def __init__(self, count: int, slots: list[tuple[int, int]], gap: int):
        self.count, self.slots, self.gap = count, slots, gap


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[_Group]:
    """Groups of sequences that hold exactly the counted lengths (each at most `capacity`)."""
    left = dict(histogram)
    classes = min(CLASSES, capacity)
    unit = -(-capacity // classes)
    classes = capacity // unit
    class_of = lambda n: -(-n // unit) - 1
    short = int(capacity * KEPT_BACK)
    members: dict[int, list[int]] = {}
    for n in sorted(left, reverse=True):
        if n > short and class_of(n) < classes:
            members.setdefault(class_of(n), []).append(n)
    groups: list[_Group] = []
    if members:
        target = np.array([sum(left[n] for n in members.get(c, [])) for c in range(classes)], dtype=float)
        patterns = _patterns(classes)
        patterns = patterns[np.all((patterns < 0) | (np.append(target, 1)[patterns] > 0), axis=1)]
        fit = non_negative_fit(patterns, target) if len(patterns) else np.empty(0)
        for p in np.argsort(-fit, kind="stable"):
            repeat = int(fit[p] + 1e-6)
            if repeat < 1:
                break
            slots = [int(c) for c in patterns[p] if c >= 0]
            while repeat:
                # the longest of the first class, the shortest of the next, then whatever fills the rest best
                lengths: list[int] = []
                for i, c in enumerate(slots):
                    free = capacity - sum(lengths)
                    have = [n for n in members[c] if left[n] > lengths.count(n)]
                    if i and i == len(slots) - 1:
                        have = [n for d in (c, c + 1) for n in members.get(d, []) if n <= free and left[n] > lengths.count(n)]
                        have = [max(have)] if have else []
                    if not have:
                        break
                    lengths.append(have[0] if i == 0 else have[-1])
                if len(lengths) < len(slots):
                    break
                times = min(repeat, *(left[n] // lengths.count(n) for n in lengths))
                for n in lengths:
                    left[n] -= times
                groups.append(_Group(times, [(n, 1) for n in lengths], capacity - sum(lengths)))
                repeat -= times
    return _best_fit(left, groups, capacity)


def _best_fit(left: dict[int, int], groups: list[_Group], capacity: int) -> list[_Group]:
    """Lengths from the longest down, each into the fullest sequence that takes it, else into new ones."""
    by_gap: list[list[_Group]] = [[] for _ in range(capacity + 1)]
    for g in groups:
        by_gap[g.gap].append(g)
    filled = np.array([bool(x) for x in by_gap])
    out: list[_Group] = []
    for n in sorted((k for k, v in left.items() if v > 0), reverse=True):
        c = left[n]
        while c:
            at = n + int(np.argmax(filled[n:])) if filled[n:].any() else -1
            if at < 0:
                fit = capacity // n
                full, rest = divmod(c, fit)
                new = [_Group(k, [(n, t)], capacity - n * t) for k, t in ((full, fit), (1, rest)) if k and t]
                c = 0
            else:
                g = by_gap[at].pop()
                filled[at] = bool(by_gap[at])
                fit = at // n
                k, t = (min(g.count, c // fit), fit) if c >= fit else (1, c)
                new = [_Group(k, [*g.slots, (n, t)], at - n * t)]
                if g.count > k:
                    g.count -= k
                    by_gap[at].append(g)
                    filled[at] = True
                c -= k * t
            for g in new:
                by_gap[g.gap].append(g)
                filled[g.gap] = True
    for x in by_gap:
        out += x
    return out


def _ranges(groups: list[_Group]) -> tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray]:
    """First number of each length's pieces; and for ranges of numbers: start, first sequence, offset."""
    total: dict[int, int] = {}
    for g in groups:
        for n, t in g.slots:
            total[n] = total.get(n, 0) + g.count * t
    first, at = {}, 0
    for n in sorted(total):
        first[n], at = at, at + total[n]
    following, rows, sequence = dict(first), [], 0
    for g in groups:
        offset = 0
        for n, t in g.slots:
            for _ in range(t):
                rows.append((following[n], sequence, offset))
                following[n] += g.count
                offset += n
        sequence += g.count
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)
    return first, table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()


def _assign(first: np.ndarray, start: np.ndarray, sequence: np.ndarray, offset: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("rank", "length"))
            number = first[length] + rank
            at = np.searchsorted(start, number, side="right") - 1
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence[at] + number - start[at]), pa.array(offset[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """pieces with rank: 0.. within each length, in no task more than about BUCKET_ROWS of one length."""
    many = {n: min(-(-c // BUCKET_ROWS), BUCKETS) for n, c in histogram.items() if c > BUCKET_ROWS}
    splits = F.lit(1)
    if many:
        splits = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in many.items() for x in kv]), F.col("length").cast("int")), F.lit(1))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), splits))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    at = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt"))
    return dealt.withColumn("at", at).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("at") - 1)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pieces = written(narrow.mapInArrow(w.trimmed(_pieces(tokenizer, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long").withColumn("salt", F.rand(5)), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    first, start, sequence, offset = _ranges(plan(histogram, capacity))
    table = np.zeros(capacity + 1, dtype=np.int64)
    table[list(first)] = list(first.values())
    return ranked(pieces, histogram).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _assign(table, start, sequence, offset), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
