"""SimHash near-dedup by multi-index hashing.

A fingerprint is the majority vote over the bits of XXH64 (seed 42) of a text's word shingles. Two fingerprints
link if they differ in at most `distance` bits. Distinct fingerprints are cut into segments; by the pigeonhole
principle some segment of a linked pair differs in at most floor(distance / segments) bits, so each fingerprint
looks up the Hamming ball of that radius around each of its segments in the table of segments, and every match
is checked on all 64 bits. Equal fingerprints are one node; linked nodes form components.

Where one segment value is shared by many fingerprints (a large group of near copies), the value alone selects too
little: such values are looked up together with the pieces of the rest of the fingerprint, of which one at least
must be equal. Where even these are shared by more than CROWD fingerprints, components don't need all their links: each
fingerprint looks up the centres in the ball of half the distance (rounded up) around it, and every fingerprint there is
linked with the least of those that have the centre in the ball of half the distance rounded down. All of these are links,
two linked fingerprints always meet at a centre, and their number grows with the fingerprints, not with their pairs.

Defined cases: null, empty and all-space texts have fingerprint zero and link like any other; a text of fewer words
than a shingle is one shingle; component_id is the least id, of any row with a linked fingerprint, that isn't null, or
null if there is none. one_of_each decides by row: equal ids with texts that aren't near duplicates, and null ids, keep
their rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as w
from ._frames import written
from ._graph import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: A segment value with more distinct fingerprints than this is split further.
HOT = 64
#: A segment value and piece with more distinct fingerprints than this is linked through centres.
CROWD = 4_096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens) - 1
    starts = (ends - lens + 1).tolist()
    ends = ends[shingle - 1 :].tolist()
    n, votes = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        some = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=False)], dtype="<u8")
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])


def _fingerprints_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _fingerprints, of the last column, behind the others."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(w.trimmed(_fingerprints), "id long, fp long")


def _segments(distance: int) -> int:
    """So few segments that a ball of radius 1 in one of them is enough."""
    return max(1, (distance + 2) // 2)


def _layout(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    cut = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def _bits(fp: Column, low: int, width: int) -> Column:
    x = F.shiftrightunsigned(fp, low)
    return x if width == 64 else x.bitwiseAND(F.lit((1 << width) - 1))


def _ball(width: int, radius: int) -> list[int]:
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _pieces(low: int, width: int, count: int) -> list[tuple[int, int]]:
    """The bits outside a segment, cut into `count` pieces of consecutive bits."""
    rest = [(a, b) for a, b in ((0, low), (low + width, 64)) if b > a]
    total = sum(b - a for a, b in rest)
    out = []
    for a, b in rest:
        n = -(-count * (b - a) // total)
        cut = [a + (b - a) * i // n for i in range(n + 1)]
        out += [(x, y - x) for x, y in zip(cut, cut[1:], strict=False)]
    return out


def _through_centres(fps: DataFrame, distance: int) -> DataFrame:
    """(a, b), a < b: links between the fingerprints in fps (fp, distinct), enough to hold every component together."""
    near, far = distance // 2, distance - distance // 2
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in _ball(64, far)]))
    probes = fps.select("fp", mask.alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("centre"), (F.bit_count("m") <= near).alias("near"))
    heads = probes.where("near").groupBy("centre").agg(F.min("fp").alias("head"))
    return probes.join(heads.hint("merge"), "centre").where("fp != head").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()


def links(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT, crowd: int | None = None) -> DataFrame:
    """(a, b), a < b: the fingerprints in `nodes` (fp, distinct) that differ in at most `distance` bits.

    crowd: how many may share a key before their links are thinned out to those that hold the components together.
    Joins with probes are never broadcasts: the planner takes a fingerprint's many probes for one row, and the driver would
    hold them all.
    """
    found = None
    count = _segments(distance)
    for s, (low, width) in enumerate(_layout(count)):
        radius = distance // count
        value = _bits(F.col("fp"), low, width)
        keyed = nodes.select("fp", value.alias("v"))
        pieces = _pieces(low, width, distance + 1) if width < 64 else []
        crowded = written(keyed.groupBy("v").count().where(F.col("count") > (hot if pieces else 1)).select("v"), f"hot-{s}")
        ball = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
        probes = keyed.select("fp", "v", F.explode(ball).alias("m")).select("fp", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
        pair = lambda p, t, on: p.alias("p").join(t.alias("t").hint("merge"), on).where((F.col("p.fp") < F.col("t.fp")) & (F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= distance)).select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b"))
        plain = pair(probes, keyed.join(crowded, "v", "left_anti"), "v")
        if not pieces:  # the segment is the fingerprint: no value is shared
            found = plain if found is None else found.union(plain)
            continue
        piece = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _bits(F.col("fp"), a, n).alias("x")) for i, (a, n) in enumerate(pieces)]))
        split = lambda d: d.select("fp", "v", piece.alias("q")).select("fp", "v", F.col("q.i").alias("i"), F.col("q.x").alias("x"))
        key = ["v", "i", "x"]
        asking, there = split(probes.join(crowded, "v", "left_semi")), split(keyed.join(crowded, "v", "left_semi"))
        if crowd is None:
            both = plain.union(pair(asking, there, key))
        else:
            packed = written(there.groupBy(*key).count().where(F.col("count") > crowd).select(*key), f"crowd-{s}")
            both = plain.union(pair(asking, there.join(packed, key, "left_anti"), key))
            if not packed.isEmpty():
                both = both.union(_through_centres(written(asking.join(packed, key, "left_semi").select("fp").distinct(), f"crowd-{s}"), distance))
        found = both if found is None else found.union(both)
    return found.distinct()


def _clusters(rows: DataFrame, key: Column, distance: int) -> DataFrame:
    """(fp, best): the least `key` of all rows (which have fp) in a fingerprint's component; written, one row a fingerprint."""
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    linked = components(links(nodes.select("fp"), distance, crowd=CROWD)).withColumnRenamed("node", "fp")
    member = linked.join(nodes, "fp")
    smallest = member.groupBy("component").agg(F.min("least").alias("smallest"))
    joined = member.join(smallest, "component").select("fp", F.col("smallest").alias("s"))
    # written, so that a join with it has a shuffle on both sides and a fingerprint of very many rows can be split
    return written(nodes.join(joined, "fp", "left").select("fp", F.coalesce("s", "least").alias("best")), "components")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: its id, fp (signed long) and component_id."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    whole = _clusters(rows, F.col("id"), distance).select("fp", F.col("best").alias("component_id"))
    return rows.join(whole, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell rows apart: the id, and 128 bits of the text."""
    key, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [key.isNull().alias("_none"), F.coalesce(key, F.lit(0)).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.xxhash64(F.lit(1), text).alias("_g")]


def one_of_each(docs: DataFrame, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the least id (null ids last; equal ids by a hash of the text).

    Rows, not ids, are decided on: rows that share an id, or have none, and aren't near duplicates all stay. Of rows equal in
    id and text the one whose columns come first as JSON stays. All columns are kept. Joins with the rows that go, or come twice,
    are never broadcasts: of many copies their files are small, and the driver would hold them unpacked.
    """
    names = ["_none", "_id", "_h", "_g"]
    keyed = docs.select(*_row_key(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = written(keyed.mapInArrow(w.trimmed(_fingerprints_beside), "_none boolean, _id long, _h long, _g long, fp long"), "fingerprints")
    distinct = rows.groupBy(*names, "fp").agg(F.count(F.lit(1)).alias("times"))
    mine = F.struct(*names)
    judged = written(distinct.join(_clusters(rows, mine, distance), "fp").select(*names, "times", (mine == F.col("best")).alias("stays")), "judged")
    gone, again = judged.where("not stays").select(*names), judged.where("stays and times > 1").select(*names)
    tagged = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), *_row_key(id_col, text_col))
    kept = tagged.join(gone.hint("merge"), names, "left_anti")
    if not again.isEmpty():
        twice = kept.join(again.hint("merge"), names, "left_semi").groupBy(*names).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(again.hint("merge"), names, "left_anti").select("row").union(twice.select("row"))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
