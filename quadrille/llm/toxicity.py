"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (bytes that are neither ASCII letters nor digits nor above 127 separate them; upper
case of ASCII and Latin-1 folded), its word pairs, and its pairs with one word between, each hashed to 2**BITS places; a text has a place or
hasn't. Each coordinate has its own learning rate, and L1 keeps most weights at zero, so what is broadcast is the
list of the others: its size is bounded by the sample, not by the corpus.

Learning takes at most SAMPLE labelled rows, those first by a seeded hash of their id; their features are made where they
lie, and one task goes through them in that order. Every text is scored.

Defined cases: a null or empty text has no features and gets the score of the intercept; a document labelled more
than once counts as toxic if its mean label is at least 0.5; null labels and labels without an id don't count; without any
labelled row every score is 0. Of texts that share an id the one with the least hash is learned from; each is scored. Rows
given twice are scored twice. A text longer than BLOCK is a block of its own; in the learning task a text takes at most
2**BITS places of 4 bytes, whatever its length. Other columns pass through unread, and never enter a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as w

BITS, SAMPLE, EPOCHS = 20, 12_000, 10
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
BLOCK = 4 << 20
_KINDS = (w.U64(0x9E3779B97F4A7C15), w.U64(0xC2B2AE3D27D4EB4F), w.U64(0x165667B19E3779F9))


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document index, place) of every feature occurrence in a block of texts."""
    words = w.Words(data, off, w.ASCII_NON_WORD, True)
    h, doc = words.hashes(), words.doc_of()
    shift, docs, places = w.U64(64 - bits), [doc], [w.splitmix(h ^ _KINDS[0]) >> w.U64(64 - bits)]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            places.append((w.splitmix(h[:-gap] * w.U64(3) + h[gap:] ^ kind) >> shift)[same])
    return np.concatenate(docs), np.concatenate(places).astype(np.int64)


def fit(places: np.ndarray, cut: np.ndarray, labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and weights that aren't zero, and the intercept; text i has the distinct places places[cut[i]:cut[i + 1]]."""
    size = 1 << bits
    z, n, root = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)  # root: of n

    def weights(zz: np.ndarray, rr: np.ndarray) -> np.ndarray:
        rate = (BETA + rr) / ALPHA + L2
        ww = (np.clip(zz, -L1, L1) - zz) / rate
        ww[-1] = -zz[-1] / rate[-1]  # the intercept, always last, is free
        return ww

    own = np.insert(places, cut[1:], size)  # each text's places and the intercept
    bounds = (cut + np.arange(len(cut))).tolist()
    for _ in range(epochs):
        for i, y in enumerate(labels.tolist()):
            at = own[bounds[i] : bounds[i + 1]]
            zz, rr = z[at], root[at]
            ww = weights(zz, rr)
            g = 1.0 / (1.0 + math.exp(-min(35.0, max(-35.0, float(ww.sum()))))) - y
            nn = n[at] + g * g
            now = np.sqrt(nn)
            n[at], root[at], z[at] = nn, now, zz + (g - (now - rr) / ALPHA * ww)
    ww = weights(z, root)
    kept = np.flatnonzero(ww[:size])
    return kept, ww[kept], float(ww[size])


def _distinct(bits: int):
    """(turn, id, label, places): the distinct places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in w.blocks(batch, "text", BLOCK):
                doc, place = features(data, off, bits)
                key = np.unique(doc << bits | place)
                cut = np.searchsorted(key, np.arange(b - a + 1) << bits).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(cut), pa.array((key & (1 << bits) - 1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in ("turn", "id", "label")), places], names=["turn", "id", "label", "places"])

    return run


def _learn(bits: int, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, lens, labels = [], [], []
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("places"))
            places.append(lists.flatten().to_numpy())
            lens.append(np.diff(lists.offsets.to_numpy()))
            labels += batch.column(batch.schema.get_field_index("label")).to_pylist()
        if labels:
            cut = np.concatenate(([0], np.cumsum(np.concatenate(lens))))
            at, ww, intercept = fit(np.concatenate(places), cut, np.array(labels, dtype=float), bits, epochs)
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(at, -1)), "weight": pa.array(np.append(ww, intercept))})

    return run


def learn(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, bits: int = BITS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights by place; -1 is the intercept. labelled: (id, label) rows to learn from."""
    label = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    chosen = label.withColumn("turn", F.xxhash64("id", F.lit(11))).orderBy("turn", "id").limit(sample)  # so many rows at most: small enough to broadcast
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = texts.join(F.broadcast(chosen), "id").groupBy("id", "turn", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    places = named.select("turn", "id", "label", "text").mapInArrow(w.trimmed(_distinct(bits)), "turn long, id long, label int, places array<int>")
    rows = places.repartition(1).sortWithinPartitions("turn", "id")  # at most `sample` rows, without their texts
    return {r["place"]: r["weight"] for r in rows.mapInArrow(w.trimmed(_learn(bits, epochs)), "place long, weight double").collect()}


def _score(at: np.ndarray, ww: np.ndarray, intercept: float, empty: bool, bits: int, text_at: int):
    """text_at: the text's place in the struct `row`, which passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=np.float64)
        table[at] = ww
        for batch in batches:
            total = np.full(batch.num_rows, intercept)
            for a, b, data, off in w.blocks(batch, text_at, BLOCK):
                doc, place = features(data, off, bits)
                hit = table[place] != 0
                key = np.unique(doc[hit] << bits | place[hit])
                np.add.at(total, a + (key >> bits), table[key & (1 << bits) - 1])
            score = np.zeros(len(total)) if empty else 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["row", "score"])

    return run


def scored(docs: DataFrame, weights: dict[int, float], text_col: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """Rows (row struct<c0, c1, ...>, score) with the columns of docs in `keep` (all), in order; the text is one of them."""
    keep = docs.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    source = docs.select(row.alias("row"))
    places = np.array([k for k in weights if k >= 0], dtype=np.int64)
    ww = np.array([weights[k] for k in places.tolist()], dtype=np.float64)
    kind = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(w.trimmed(_score(places, ww, weights.get(-1, 0.0), not weights, bits, keep.index(text_col))), f"row {kind}, score double")


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A row for each document: id, held_out, score, predicted. Held-out labels are never learned from."""
    weights = learn(labels.where(~held_out(F.col(id_col))), docs, id_col, text_col, label_col)
    out = scored(docs, weights, text_col, keep=[id_col, text_col])
    key = F.col("row.c0")
    return out.select(key.alias(id_col), held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """docs without those that score 0.5 or more; all columns are kept."""
    weights = learn(labels.where(~held_out(F.col(id_col))), docs, id_col, text_col, label_col)
    out = scored(docs, weights, text_col).where(F.col("score") < 0.5)
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
