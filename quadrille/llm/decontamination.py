"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words at six fixed positions of a short window; the positions between are ignored, so a
hit survives other words there. The four masks leave no gap: in any 14 words of which 2 were replaced, or 16 to 18
words of which 3 were, some mask at some offset meets only unchanged words. Around each hit the benchmark text is
laid over the document's words without gaps, and the stretch with the best score (+1 for an equal word, -3 for
another) is kept; where that doesn't count, every stretch of 12 to 23 words does as well (a longer one of so many equal
words holds one of these). A document is contaminated if such a stretch has at least MIN_WORDS words (or all words of a
shorter item) of which at least MIN_EQUAL are equal. Items of LEAST_WORDS to 7 words, too short for a mask, match where
all their words stand in a row.

Words: runs of ASCII letters, digits and bytes above 127, upper case of ASCII and Latin-1 folded.

Two ways to join the seeds, with the same results. A benchmark of at most BENCH_BYTES is indexed once and broadcast, and
nothing of the corpus is shuffled. A larger one is never collected: its seeds are a table, joined by a shuffle with the
documents' seeds (those that pass a bit table of FILTER_BITS bits), documents with a hit give the stretch of words under
each item, and the stretches are joined with the items and verified. No memory grows with either side then.

Items of equal words are one item, reported under the least of their ids with their number (null ids first); documents
of equal text are looked at once in the shuffled join. Candidates are verified in whole arrays, so a phrase that many items share
costs each document that has it time in proportion to their words.

Defined cases: null and empty texts never match, nor do items of fewer than LEAST_WORDS words; rows given twice are
reported (or removed) twice; null ids are carried as null; rows that share an id are decided by their own text; a text
longer than a block of BLOCK bytes is a block of its own. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as w
from ._frames import written

#: The positions that each mask keeps.
MASKS = ((0, 1, 3, 5, 6, 7), (0, 4, 6, 7, 8, 9), (0, 1, 2, 4, 6, 7), (0, 1, 3, 4, 6, 9))
MIN_WORDS, MIN_EQUAL, MISMATCH = 12, 0.8, 3
#: Words of the shortest item that is looked for: fewer are found everywhere.
LEAST_WORDS = 4
BENCH_BYTES, BLOCK = 8 << 20, 4 << 20
#: Bits of the table that documents' seeds must pass before they are shuffled; seed hits, and words, that one step handles.
FILTER_BITS, HITS, STRETCH = 1 << 27, 1 << 21, 1 << 22
#: Candidates of a document that travel in one row.
CHUNK = 1_000


def _seeds(hashes: np.ndarray, bounds: np.ndarray, mask: tuple[int, ...], which: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) of every window of a mask within one text."""
    span = mask[-1] + 1
    at = w.window_starts(bounds, span)
    if not len(at):
        return at, np.empty(0, dtype=np.uint64)
    total = np.full(len(hashes) - span + 1, which + 1, dtype=np.uint64)
    for k, step in enumerate(mask):
        total += hashes[step : step + len(total)] * w.U64(2 * k + 3 | 1 << (9 * k + 8))
    return at, w.splitmix(total[at])


def _short(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) of every run of `width` words within one text."""
    at = w.window_starts(bounds, width)
    if not len(at):
        return at, np.empty(0, dtype=np.uint64)
    total = np.full(len(hashes) - width + 1, 100 + width, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * w.U64(2 * k + 3 | 1 << (7 * k + 9))
    return at, w.splitmix(total[at])


def _all_seeds(hashes: np.ndarray, bounds: np.ndarray, widths) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) by every mask, and by runs of the given widths."""
    found = [_seeds(hashes, bounds, m, i) for i, m in enumerate(MASKS)] + [_short(hashes, bounds, n) for n in widths]
    return np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found])


def _item_seeds(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) of items: masks, or the whole of one too short for any."""
    lens = np.diff(bounds)
    at, seed = _all_seeds(hashes, bounds, ())
    for n in range(LEAST_WORDS, SHORTEST):
        a, x = _short(hashes, bounds, n)
        whole = lens[np.searchsorted(bounds, a, side="right") - 1] == n
        at, seed = np.concatenate((at, a[whole])), np.concatenate((seed, x[whole]))
    return at, seed


SHORTEST = min(m[-1] for m in MASKS) + 1
WIDTHS = tuple(range(LEAST_WORDS, SHORTEST))


def _expanded(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (lens[0] of them), starts[1], ..."""
    total = int(lens.sum())
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)


def _stretches(equal: np.ndarray, lens: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, words, equal words) of the stretch that counts in each alignment; 0 words where none does.

    equal: all alignments' flags one after another, lens of them each (none zero); least: the words a stretch must have.
    """
    k = len(lens)
    ends = np.cumsum(lens + 1)
    begins = ends - lens - 1  # in the prefix sums, which have one more place each
    steps, same = np.zeros(int(ends[-1]), dtype=np.int64), np.zeros(int(ends[-1]), dtype=np.int64)
    inner = _expanded(begins + 1, lens)
    steps[inner], same[inner] = np.where(equal, 1, -MISMATCH), equal
    # sums start anew with each alignment; each lies so far below the one before that running minima start anew too
    sums, count = np.cumsum(steps), np.cumsum(same)
    level = np.repeat(np.arange(k) * (4 * (int(lens.max()) * MISMATCH + 1)), lens + 1)
    sums = sums - np.repeat(sums[begins], lens + 1) - level
    low = np.minimum.accumulate(sums)
    where = np.maximum.accumulate(np.where(sums == low, np.arange(len(sums)), 0))
    gain = sums - low
    best = np.maximum.reduceat(gain, begins)
    hit = np.flatnonzero(gain == np.repeat(best, lens + 1))
    end = hit[np.searchsorted(hit, begins)]
    start = where[end]
    n, eq = end - start, count[end] - count[start]
    good = (best > 0) & (n >= least) & (eq >= MIN_EQUAL * n)
    first, n, eq = np.where(good, start - begins, 0), np.where(good, n, 0), np.where(good, eq, 0)
    todo = ~good & (lens >= MIN_WORDS) & (count[ends - 1] - count[begins] >= MIN_EQUAL * MIN_WORDS)
    if todo.any():
        owner = np.repeat(np.arange(k), lens + 1)
        open_ = todo[owner]
        for width in range(MIN_WORDS, 2 * MIN_WORDS):
            if len(count) <= width:
                break
            got = count[width:] - count[:-width]
            fits = open_[:-width] & (owner[width:] == owner[:-width]) & (got >= MIN_EQUAL * width)
            for i in np.flatnonzero(fits).tolist():
                o = owner[i]
                if got[i] > eq[o]:
                    first[o], n[o], eq[o] = i - begins[o], width, got[i]
    return first, n, eq


class Index:
    """The seeds of a benchmark's texts; items with equal words are one."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, type=pa.large_string())})
        data, off = w.column(batch, "text")
        words = w.Words(data, off, w.ASCII_NON_WORD, True)
        hashes, cut = words.hashes(), words.bounds.tolist()
        seen: dict[bytes, list[int | None]] = {}
        for i, key in enumerate(ids):
            seen.setdefault(hashes[cut[i] : cut[i + 1]].tobytes(), []).append(key)
        self.ids = [min(v, key=lambda x: (x is not None, x or 0)) for v in seen.values()]
        self.times = np.array([len(v) for v in seen.values()], dtype=np.int64)
        self.hashes = np.frombuffer(b"".join(seen), dtype=np.uint64) if seen else np.empty(0, dtype=np.uint64)
        self.bounds = np.concatenate(([0], np.cumsum([len(k) // 8 for k in seen]))).astype(np.int64)
        at, seeds = _item_seeds(self.hashes, self.bounds)
        self.widths = sorted(set(np.diff(self.bounds).tolist()) & set(WIDTHS))
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.at = seeds[order], at[order]
        bits = min(26, max(12, int(len(seeds)).bit_length() + 6))
        self.shift = w.U64(64 - bits)
        self.some = np.zeros(1 << bits, dtype=bool)
        self.some[self.seeds >> self.shift] = True

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Distinct (document, item, shift of the document's words against the item's) with a seed in common, a few documents at a time."""
        at, seed = _all_seeds(hashes, bounds, self.widths)
        hit = np.flatnonzero(self.some[seed >> self.shift]) if len(seed) else at
        at, seed = at[hit], seed[hit]
        lo = np.searchsorted(self.seeds, seed, side="left")
        many = np.searchsorted(self.seeds, seed, side="right") - lo
        at, lo, many = (x[many > 0] for x in (at, lo, many))
        if not len(at):
            return
        doc = np.searchsorted(bounds, at, side="right") - 1
        order = np.argsort(doc, kind="stable")
        at, lo, many, doc = (x[order] for x in (at, lo, many, doc))
        firsts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True])))
        total = np.concatenate(([0], np.cumsum(many)))
        begin = 0
        while begin < len(firsts) - 1:  # whole documents, about HITS hits together
            end = max(begin + 1, int(np.searchsorted(total[firsts], total[firsts[begin]] + HITS, side="right")) - 1)
            found, x = [], firsts[begin]
            while x < firsts[end]:  # and no more than about HITS at once of one document
                y = min(firsts[end], max(x + 1, int(np.searchsorted(total, total[x] + HITS, side="right")) - 1))
                place, other = np.repeat(at[x:y], many[x:y]), self.at[_expanded(lo[x:y], many[x:y])]
                d, item = np.repeat(doc[x:y], many[x:y]), np.searchsorted(self.bounds, other, side="right") - 1
                found.append(_distinct(d, item, (place - bounds[d]) - (other - self.bounds[item])))
                x = y
            yield found[0] if len(found) == 1 else _distinct(*(np.concatenate(c) for c in zip(*found, strict=True)))
            begin = end

    def contaminated(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Columns document, item, first word, words, equal words: the best overlap of each document and item."""
        words = w.Words(data, off, w.ASCII_NON_WORD, True)
        hashes, bounds = words.hashes(), words.bounds
        for doc, item, shift in self.candidates(hashes, bounds):
            length, room = np.diff(self.bounds)[item], np.diff(bounds)[doc]
            a, b = np.maximum(0, -shift), np.minimum(length, room - shift)
            lens, cut, out = b - a, 0, []
            total = np.concatenate(([0], np.cumsum(lens)))
            while cut < len(lens):
                end = max(cut + 1, int(np.searchsorted(total, total[cut] + STRETCH, side="right")) - 1)
                c = slice(cut, end)
                ours = self.hashes[_expanded(self.bounds[item[c]] + a[c], lens[c])]
                theirs = hashes[_expanded(bounds[doc[c]] + a[c] + shift[c], lens[c])]
                first, n, eq = _stretches(ours == theirs, lens[c], np.minimum(MIN_WORDS, length[c]))
                keep = n > 0
                out.append((doc[c][keep], item[c][keep], (first + a[c] + shift[c])[keep], n[keep], eq[keep]))
                cut = end
            doc, item, first, n, eq = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((first, -eq, item, doc))
            doc, item, first, n, eq = (x[order] for x in (doc, item, first, n, eq))
            best = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else np.empty(0, dtype=bool)
            yield tuple(x[best] for x in (doc, item, first, n, eq))


def _distinct(doc: np.ndarray, item: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((shift, item, doc))
    doc, item, shift = doc[order], item[order], shift[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])))
    return doc[new], item[new], shift[new]


_PAIRS = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("items", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("equal_words", pa.int64())]
_PAIRS_DDL = "doc_id long, item_id long, items long, first_word long, words long, equal_words long"


def _find(index, what: str, text: str | int = "text"):
    """Yields the overlaps (pairs), a row for each contaminated document (documents), or the rows without any (clean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for a, _, data, off in w.blocks(batch, text, BLOCK):
                for doc, item, first, n, eq in ix.contaminated(data, off):
                    clean[a + doc] = False
                    if what == "clean" or not len(doc):
                        continue
                    items = ix.times[item]
                    if what == "documents":  # the best item, and how many there are
                        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                        order = np.lexsort((item, -eq, doc))
                        items = np.add.reduceat(items, starts)
                        doc, item, first, n, eq = (x[order][starts] for x in (doc, item, first, n, eq))
                    cols = [batch.column(0).take(pa.array(a + doc)), pa.array([ix.ids[i] for i in item.tolist()], type=pa.int64()), *(pa.array(x) for x in (items, first, n, eq))]
                    yield pa.RecordBatch.from_arrays(cols, names=[c for c, _ in _PAIRS])
            if what == "clean":
                yield batch.filter(pa.array(clean))

    return run


def _benchmark(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _index(items: DataFrame):
    """The benchmark's broadcast index, or None if it is too large for one."""
    size = items.agg(F.sum(F.octet_length("text").cast("long") + 1).alias("n")).first()["n"] or 0
    if size > BENCH_BYTES:
        return None
    part = items.where("text is not null").orderBy("id", "text").collect()  # at most BENCH_BYTES
    return items.sparkSession.sparkContext.broadcast(Index([r["id"] for r in part], [r["text"] for r in part]))


# a benchmark too large to broadcast


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g")]


def _hash_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hashes of its words) of items."""
    for batch in batches:
        for a, b, data, off in w.blocks(batch, "text", BLOCK):
            words = w.Words(data, off, w.ASCII_NON_WORD, True)
            hashes, cut = words.hashes(), words.bounds.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([hashes[x:y].tobytes() for x, y in pairwise(cut)], type=pa.binary())], names=["id", "hashes"])


def _bench_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, item, word, words of the item) of rows (item, hashes)."""
    for batch in batches:
        rows = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(1).to_pylist()]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
        at, seed = _item_seeds(np.concatenate(rows) if rows else np.empty(0, dtype=np.uint64), bounds)
        own = np.searchsorted(bounds, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(pa.array(own)), pa.array(at - bounds[own]), pa.array(np.diff(bounds)[own])], names=["seed", "item", "word", "length"])


def _doc_seeds(table, widths: tuple[int, ...]):
    """(seed, h, g, word) of documents' seeds that pass the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: np.ndarray = table.value
        shift = w.U64(64 - (len(bits) * 8).bit_length() + 1)
        for batch in batches:
            for a, _, data, off in w.blocks(batch, "text", BLOCK):
                words = w.Words(data, off, w.ASCII_NON_WORD, True)
                at, seed = _all_seeds(words.hashes(), words.bounds, widths)
                place = seed >> shift
                ok = bits[place >> w.U64(3)] >> (place & w.U64(7)).astype(np.uint8) & 1 == 1
                at, seed = at[ok], seed[ok]
                own = np.searchsorted(words.bounds, at, side="right") - 1
                rows = pa.array(a + own)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at - words.bounds[own])], names=["seed", "h", "g", "word"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, item, begin, shift, hashes) of the words of each document (h, g, text, candidates) under its items."""
    for batch in batches:
        for i in range(batch.num_rows):
            data, off = w.column(batch.slice(i, 1), "text")
            words = w.Words(data, off, w.ASCII_NON_WORD, True)
            hashes, rows = words.hashes(), []
            for c in batch.column(3)[i].as_py():
                a, b = max(0, -c["shift"]), min(c["length"], len(hashes) - c["shift"])
                rows.append((c["item"], a, c["shift"], hashes[a + c["shift"] : b + c["shift"]].tobytes()))
            item, begin, shift, part = zip(*rows, strict=True)
            key = [pa.array([batch.column(k)[i].as_py()] * len(rows), type=pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*key, pa.array(item), pa.array(begin), pa.array(shift), pa.array(part, type=pa.binary())], names=["h", "g", "item", "begin", "shift", "part"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (h, g, item, id, times, begin, shift, part, hashes) with a stretch that counts."""
    for batch in batches:
        begin, shift = (batch.column(i).to_numpy() for i in (5, 6))
        theirs = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(7).to_pylist()]
        whole = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(8).to_pylist()]
        if not theirs:
            continue
        lens = np.array([len(x) for x in theirs], dtype=np.int64)
        ours = np.concatenate([x[a : a + n] for x, a, n in zip(whole, begin.tolist(), lens.tolist(), strict=True)])
        first, n, eq = _stretches(ours == np.concatenate(theirs), lens, np.minimum(MIN_WORDS, [len(x) for x in whole]))
        keep = pa.array(n > 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(first + begin + shift), pa.array(n), pa.array(eq)], names=["h", "g", "item", "item_id", "items", "first_word", "words", "equal_words"]).filter(keep)


def _shuffled(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(h, g, item_id, items, first_word, words, equal_words) of the texts of docs (text), each once."""
    spark = docs.sparkSession
    hashed = items.where("text is not null").mapInArrow(w.trimmed(_hash_items), "id long, hashes binary")
    hashed = written(hashed.groupBy("hashes").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id")).alias("m"), F.count(F.lit(1)).alias("times")).select(F.xxhash64("hashes").alias("item"), F.col("m.id").alias("id"), "times", "hashes"), "items")
    seeds = written(hashed.select("item", "hashes").mapInArrow(w.trimmed(_bench_seeds), "seed long, item long, word long, length long"), "seeds")
    # a bit for each seed, as words of 64: at most FILTER_BITS / 64 rows, whatever the benchmark's size
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS.bit_length() + 1)
    words = seeds.select(place.alias("place")).selectExpr("shiftrightunsigned(place, 6) as at", "shiftleft(1L, cast(place % 64 as int)) as bit")
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    bits = spark.sparkContext.broadcast(table.view(np.uint8))
    texts = docs.where("text is not null").select(*_text_key(F.col("text")), "text")
    mine = texts.mapInArrow(w.trimmed(_doc_seeds(bits, WIDTHS)), "seed long, h long, g long, word long").distinct()
    hits = mine.withColumnRenamed("word", "at").join(seeds, "seed").select("h", "g", "item", (F.col("at") - F.col("word")).alias("shift"), "length").distinct()
    hits = written(hits, "candidates")
    counts = hits.groupBy(F.col("h").alias("h1"), F.col("g").alias("g1")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("parts"))
    lists = hits.join(counts, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1"))).groupBy("h", "g", F.pmod(F.xxhash64("item"), "parts").alias("part")).agg(F.collect_list(F.struct("item", "shift", "length")).alias("candidates"))
    asked = hits.select("h", "g").distinct()
    once = texts.join(asked, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.first("text").alias("text"))
    parts = once.join(lists, ["h", "g"]).select("h", "g", "text", "candidates").mapInArrow(w.trimmed(_cut), "h long, g long, item long, begin long, shift long, part binary")
    checked = parts.join(hashed, "item").select("h", "g", "item", "id", "times", "begin", "shift", "part", "hashes").mapInArrow(w.trimmed(_verify), "h long, g long, item long, item_id long, items long, first_word long, words long, equal_words long")
    best = checked.groupBy("h", "g", "item", "item_id", "items").agg(F.max_by(F.struct("first_word", "words", "equal_words"), F.struct("equal_words", -F.col("first_word"))).alias("m"))
    return written(best.select("h", "g", "item", "item_id", "items", "m.*"), "overlaps")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, items (of equal words), first_word (in the document), words, equal_words."""
    narrow, items = _narrow(docs, id_col, text_col), _benchmark(benchmark, item_col, item_text_col)
    if (index := _index(items)) is not None:
        return narrow.mapInArrow(w.trimmed(_find(index, "pairs")), _PAIRS_DDL)
    keyed = narrow.select("doc_id", *_text_key(F.col("text")))
    return keyed.join(_shuffled(narrow, items), ["h", "g"]).select(*(c for c, _ in _PAIRS))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each contaminated document: as `overlaps` for its best item (most equal words), items being the number of all its items."""
    narrow, items = _narrow(docs, id_col, text_col), _benchmark(benchmark, item_col, item_text_col)
    if (index := _index(items)) is not None:
        return narrow.mapInArrow(w.trimmed(_find(index, "documents")), _PAIRS_DDL)
    rank = F.struct("equal_words", F.col("item_id").isNull(), -F.coalesce("item_id", F.lit(0)))
    best = _shuffled(narrow, items).groupBy("h", "g").agg(F.max_by(F.struct("item_id", "first_word", "words", "equal_words"), rank).alias("m"), F.sum("items").alias("items"))
    return narrow.select("doc_id", *_text_key(F.col("text"))).join(best.select("h", "g", "items", "m.*"), ["h", "g"]).select(*(c for c, _ in _PAIRS))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; all columns are kept."""
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    out, items = docs.select(row.alias("row")), _benchmark(benchmark, item_col, item_text_col)
    if (index := _index(items)) is not None:
        out = out.mapInArrow(w.trimmed(_find(index, "clean", docs.columns.index(text_col))), f"row {out.schema['row'].dataType.simpleString()}")
    else:
        text = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
        gone = _shuffled(text, items).select("h", "g").distinct()
        key = F.coalesce(F.col(f"row.c{docs.columns.index(text_col)}").cast("string"), F.lit(""))
        out = out.withColumns(dict(zip(("h", "g"), _text_key(key), strict=True))).join(gone, ["h", "g"], "left_anti")
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
