"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted over the whole corpus.

Three packed exchanges, no join and no row per window in the JVM:

1. each task hashes every window of its documents, keeps the first occurrence of each hash in its block
   (so a passage that fills a third of the corpus leaves a task once per block) and sends the hashes,
   packed by range of the hash, to buckets; occurrences that are later within the block are already known
   to repeat and are sent on as such;
2. each bucket finds, for each hash, the earliest window over all blocks, and sends the others' places,
   packed by document group;
3. each document group merges the places of its documents into maximal removal intervals and cuts them.

A window's key is a 64-bit Rabin-Karp hash plus 32 bits of a second one with another base over another hash of the words,
so words that collide in one lane don't in the other: 96 independent bits in all. Words are not compared again; among
10**13 windows two different ones agree in all 96 bits with a probability of about one in a thousand.

Defined cases: a null or empty text has no words and comes out as it went in. Rows with equal ids and equal
texts are one document; all of them get its result. Rows with an equal id, or without one, and other texts are told apart
and rank by a 64-bit hash of the text, and are spread over document groups by it. Rows whose id is null rank first. A text
longer than a block is hashed as a block of its own. Other columns pass through unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as w
from ._frames import dealt, partitions, release, text_bytes, written

WIDTH = 20
#: Bytes of text hashed at a time, and bytes of text whose windows one bucket holds on average.
BLOCK, BUCKET = 6 << 20, 16 << 20
NO_ID = -(1 << 62)

_PACKED = "bucket int, kind int, docs binary, ties binary, counts binary, keys binary, places binary"


def _planes(a: np.ndarray) -> bytes:
    """The bytes of 32-bit values, most significant bytes first: mostly zeros there, so shuffles compress them."""
    return np.ascontiguousarray(a.astype(">u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(">u4").ravel().astype(np.uint32)


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the hashes that tell apart texts under one."""
    return tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "tie"))


def _group_expr(key: Column, tie: Column, groups: int) -> Column:
    """The document group of an id and a text; `_spread` gives the same in numpy."""
    mixed = F.pmod(F.pmod(key, F.lit(2147483629)) + F.pmod(tie, F.lit(2147483587)), F.lit(2147483629))
    return F.pmod(F.shiftrightunsigned(mixed * 1140671485 + 12820163, 20), F.lit(groups)).cast("int")


def _spread(docs: np.ndarray, ties: np.ndarray, groups: int) -> np.ndarray:
    return (((docs % 2147483629 + ties % 2147483587) % 2147483629) * 1140671485 + 12820163 >> 20) % groups


def _runs(order_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    first = np.flatnonzero(np.concatenate(([True], order_keys[1:] != order_keys[:-1]))) if len(order_keys) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(order_keys)))


def _packed(docs: np.ndarray, ties: np.ndarray, doc: np.ndarray, place: np.ndarray, to: np.ndarray, kind: int, keys: np.ndarray | None) -> pa.RecordBatch:
    """One packed row for each target in `to`; entries come ordered by (to, doc)."""
    rows = []
    for a, n in zip(*_runs(to), strict=True):
        d = doc[a : a + n]
        at, counts = _runs(d)
        rows.append({
            "bucket": int(to[a]), "kind": kind, "docs": docs[d[at]].tobytes(), "ties": ties[d[at]].tobytes(), "counts": _planes(counts),
            "keys": b"" if keys is None else keys[a : a + n].tobytes(), "places": _planes(place[a : a + n]),
        })
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("docs", "ties", "counts", "keys", "places"))])
_KEY = np.dtype([("h", "<u8"), ("c", "<u4")])


def _for_documents(docs: np.ndarray, ties: np.ndarray, doc: np.ndarray, place: np.ndarray, groups: int) -> pa.RecordBatch:
    to = _spread(docs, ties, groups)[doc]
    order = np.lexsort((place, doc, to))
    return _packed(docs, ties, doc[order], place[order], to[order], 1, None)


def _later(h: np.ndarray, c: np.ndarray, doc_id: np.ndarray, tie: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks over the windows: those with an equal window earlier in the corpus, and those that stand for no others' sake again (the same place of the same document, given twice)."""
    sort = np.argsort(h)
    hs = h[sort]
    same = hs[1:] == hs[:-1]
    twice = np.zeros(len(hs), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = sort[twice]
    later, again = np.zeros(len(h), dtype=bool), np.zeros(len(h), dtype=bool)
    if len(some):
        some = some[np.lexsort((place[some], tie[doc[some]], doc_id[doc[some]], c[some], h[some]))]
        hh, cc, dd, tt, pp = h[some], c[some], doc_id[doc[some]], tie[doc[some]], place[some]
        lead = np.concatenate(([True], (hh[1:] != hh[:-1]) | (cc[1:] != cc[:-1])))
        first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
        late = (dd != dd[first]) | (tt != tt[first]) | (pp != pp[first])
        later[some], again[some] = late, ~late & ~lead
    return later, again


def _hash_windows(width: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every_tie = _keys(batch)
            for a, b, data, off in w.blocks(batch, "text", BLOCK):
                words = w.Words(data, off)
                if (at := w.window_starts(words.bounds, width)).size == 0:
                    continue
                hashes = words.hashes()
                h = w.rolling(hashes, width, w.BASE_WORDS)[at]
                del hashes
                c = (w.rolling(words.hashes(base=w.OTHER_BYTES, values=w.OTHER_VALUES), width, w.BASE_CHECK)[at] >> w.U64(32)).astype(np.uint32)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                place, docs, ties = at - words.bounds[doc], ids[a:b], every_tie[a:b]
                del words, at
                later, again = _later(h, c, docs, ties, doc, place)
                if later.any():
                    yield _for_documents(docs, ties, doc[later], place[later], groups)
                k = np.flatnonzero(~later & ~again)
                to = ((h[k] >> w.U64(32)) * w.U64(groups) >> w.U64(32)).astype(np.uint16 if groups < 1 << 16 else np.int64)
                order = np.argsort(to, kind="stable")
                k, to = k[order], to[order]
                keys = np.empty(len(k), dtype=_KEY)
                keys["h"], keys["c"] = h[k], c[k]
                yield _packed(docs, ties, doc[k], place[k], to, 0, keys)

    return run


class _Places:
    """Packed rows, gathered and laid out flat."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, row: dict) -> None:
        self.parts.append((np.frombuffer(row["docs"], np.int64), np.frombuffer(row["ties"], np.int64), _unplanes(row["counts"]).astype(np.int64), _unplanes(row["places"]), np.frombuffer(row["keys"] or b"", _KEY)))

    def flat(self) -> tuple[np.ndarray, ...]:
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, _KEY))
        return tuple(np.concatenate(x) for x in zip(*(self.parts or [empty]), strict=True))


def _find_repeats(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Places()
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if kind[i] == 1:
                    yield batch.slice(i, 1)
                else:
                    gathered.add(batch.slice(i, 1).to_pylist()[0])
        docs, ties, counts, place, keys = gathered.flat()
        gathered.parts = []
        doc = np.repeat(np.arange(len(docs)), counts)
        later, _ = _later(np.ascontiguousarray(keys["h"]), keys["c"], docs, ties, doc, place)
        if later.any():
            yield _for_documents(docs, ties, doc[later], place[later], groups)

    return run


def _intervals(places: np.ndarray, width: int) -> np.ndarray:
    """(start, end) of the words that windows at these places cover, merged where they meet."""
    if not len(places):
        return np.empty((0, 2), np.int64)
    places = np.unique(places).astype(np.int64)
    gap = np.flatnonzero(places[1:] - places[:-1] > width)
    return np.column_stack((places[np.concatenate(([0], gap + 1))], places[np.concatenate((gap, [len(places) - 1]))] + width))


def _kept_words(raw: bytes, words: w.Words, lo: int, hi: int, cuts: np.ndarray) -> bytes:
    parts, at = [], lo
    for s, e in [*(cuts + lo), (hi, hi)]:
        if s > at:
            parts.append(b" ".join(raw[words.starts[at] : words.ends[s - 1]].split()))
        at = e
    return b" ".join(parts)


def _kept_text(raw: bytes, words: w.Words, lo: int, hi: int, cuts: np.ndarray, begin: int, end: int) -> str:
    """The text without the cut words and the white space after each."""
    parts, at = [], begin
    for s, e in cuts + lo:
        parts.append(raw[at : words.starts[s]])
        at = words.starts[e] if e < hi else end
    return b"".join([*parts, raw[at:end]]).decode()


_RESULT = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.int64())), ("kept", pa.string()), ("kept_sha256", pa.string())]


def _cut(width: int, digest: bool, text_at: int):
    """Takes the rows of a document group: its packed places (kind 1), then its texts (kind 2; in the struct `row` at text_at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, index, flat = _Places(), None, np.empty(0, np.uint32)
        for batch in batches:
            kind = batch.column(1).to_numpy(zero_copy_only=False)
            packed = int(np.searchsorted(kind, 2))
            for i in range(packed):
                gathered.add(batch.slice(i, 1).to_pylist()[0])
            texts = batch.slice(packed)
            if not texts.num_rows:
                continue
            if index is None:
                docs, ties, counts, places, _ = gathered.flat()
                gathered.parts = []
                doc = np.repeat(np.arange(len(docs)), counts)
                order = np.lexsort((ties[doc], docs[doc]))
                flat, d, t = places[order], docs[doc][order], ties[doc][order]
                at = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))) if len(d) else np.empty(0, np.int64)
                index = {(int(d[i]), int(t[i])): (i, j) for i, j in zip(at, np.append(at[1:], len(d))[: len(at)], strict=True)}
                del docs, ties, counts, places, doc, order, d, t
            ids, every_tie = _keys(texts)
            row = texts.column(texts.schema.get_field_index("row"))
            for a, b, data, off in w.blocks(texts, text_at, BLOCK):
                words, tie, raw, rows = w.Words(data, off), every_tie[a:b], data.tobytes(), []
                for i in range(b - a):
                    lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                    span = index.get((int(ids[a + i]), int(tie[i])), (0, 0))
                    cuts = _intervals(flat[span[0] : span[1]], width)
                    removed = int((cuts[:, 1] - cuts[:, 0]).sum())
                    rows.append((
                        hi - lo, removed, cuts.ravel().tolist(),
                        _kept_text(raw, words, lo, hi, cuts, int(off[i]), int(off[i + 1])) if removed and not digest else None,
                        hashlib.sha256(_kept_words(raw, words, lo, hi, cuts)).hexdigest() if digest else None,
                    ))
                # the digest query has no use for the texts
                passed = pa.StructArray.from_arrays([pc.struct_field(row, [0]).slice(a, b - a)], names=["id"]) if digest else row.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([passed, *(pa.array([r[j] for r in rows], type=kind) for j, (_, kind) in enumerate(_RESULT))], names=["row", *(n for n, _ in _RESULT)])

    return run


def _spans(docs: DataFrame, row: Column, text_at: int, width: int, id_col: str, text_col: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    key, tie = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(text, F.lit("")))
    narrow = docs.select(key.alias("key"), tie.alias("tie"), text.alias("text"))
    groups = max(partitions(spark), -(-text_bytes(narrow) // BUCKET))
    found = written(dealt(narrow.mapInArrow(w.trimmed(_hash_windows(width, groups)), _PACKED), groups, "bucket").mapInArrow(w.trimmed(_find_repeats(groups)), _PACKED), "repeats")
    release(spark)
    texts = docs.select(_group_expr(key, tie, groups).alias("bucket"), F.lit(2).alias("kind"), key.alias("key"), tie.alias("tie"), row.alias("row"))
    both = found.unionByName(texts, allowMissingColumns=True)
    kind = f"struct<id:{docs.schema[id_col].dataType.simpleString()}>" if digest else both.schema["row"].dataType.simpleString()
    return dealt(both, groups, "bucket").sortWithinPartitions("kind").mapInArrow(w.trimmed(_cut(width, digest, text_at)), f"row {kind}, n_words long, n_removed long, intervals array<long>, kept string, kept_sha256 string")


def repeated_spans(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, n_words, n_removed, intervals (removed words as flat starts and ends) and kept_sha256 (the kept words, joined by one space)."""
    out = _spans(docs, F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), 1, width, id_col, text_col, True)
    return out.select(F.col("row.id").alias(id_col), "n_words", "n_removed", "intervals", "kept_sha256")


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, their repeated windows cut from the text; texts without any stay byte for byte. All columns are kept."""
    out = _spans(docs, F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))), docs.columns.index(text_col), width, id_col, text_col, False)
    cells = [F.col(f"row.c{i}") for i in range(len(docs.columns))]
    return out.select(*((F.coalesce("kept", x) if c == text_col else x).alias(c) for c, x in zip(docs.columns, cells, strict=True)))
