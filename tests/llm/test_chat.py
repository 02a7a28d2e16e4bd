"""Reply trees against brute force: random forests with cycles, repeated ids, null and missing parents, and hot conversations."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quadrille.llm import chat
from quadrille.llm._frames import numbered

SCHEMA = "conv long, node long, parent long, role string, text string, score double, leaf string, rank string, c string"


def brute(rows):
    """{(conv, leaf): (rank, texts)}."""
    parent, said = {}, defaultdict(set)
    for conv, node, up, role, text, score, *_ in rows:
        had = parent.get((conv, node))
        parent[conv, node] = up if had is None else had if up is None else min(up, had)
        said[conv, node].add((role or "", text or "", score or 0.0))
    real = {k: p for k, p in parent.items() if p is not None and (k[0], p) in parent}
    inner = {(c, p) for (c, _), p in real.items()}
    paths = {}
    for conv, node in parent:
        if (conv, node) in inner:
            continue
        path, at = [(conv, node)], (conv, node)
        while at in real and len(path) <= len(parent):
            at = (conv, real[at])
            path.append(at)
        if at in real:
            continue
        paths[conv, node] = [m for x in reversed(path) for m in sorted(said[x], key=lambda m: (m[0], m[1]))]
    out, by = {}, defaultdict(list)
    for (conv, leaf), turns in paths.items():
        by[conv].append((-sum(t[2] for t in turns) / len(turns), leaf))
    for conv, found in by.items():
        for k, (_, leaf) in enumerate(sorted(found), 1):
            out[conv, leaf] = (k, [t[1] for t in paths[conv, leaf]])
    return out


def forest(r, conv, size):
    rows = []
    for node in range(size):
        up = r.choice([None, 999, r.randrange(size), r.randrange(max(1, node))] + [r.randrange(max(1, node))] * 4) if node else None
        rows.append((conv, node, up, r.choice(["user", "assistant", None]), f"{conv}:{node}", float(r.randrange(4)) / 2, "x", "y", "z"))
    return rows


def got(spark, rows, best=None):
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.conversations(df, best).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    assert len(out) == len({(x.conv, x.leaf) for x in out})
    return {(x.conv, x.leaf): (x.rank, [t.text for t in x.turns]) for x in out}


def test_random_forests(spark):
    r = random.Random(21)
    rows = [x for c in range(12) for x in forest(r, c, r.randrange(1, 25))] + forest(r, None, 9)
    rows += rows[:5]
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, 2) == {k: v for k, v in want.items() if v[0] <= 2}


def test_replies_to_a_cycle_have_no_path(spark):
    m = lambda node, up: (1, node, up, "user", f"t{node}", 0.0, "x", "y", "z")
    rows = [m(1, 2), m(2, 1), m(3, 2), m(4, 3), m(5, 5), m(6, 5), m(7, None)] + [m(100 + i, 99 + i if i else 7) for i in range(37)]
    assert got(spark, rows) == {(1, 136): (1, ["t7", *(f"t{100 + i}" for i in range(37))])}


def test_one_hot_conversation_is_numbered_in_ranges(spark):
    rows = [(1, i // 3, "a") for i in range(3000)] + [(None, 5, "b"), (2, None, "b"), (2, 1, "b")]
    out = numbered(spark.createDataFrame(rows, "conv long, turn long, role string"), ["conv"], ["turn", "role"], "node").collect()
    by = defaultdict(list)
    for x in out:
        by[x.conv].append((x.node, -1 if x.turn is None else x.turn))
    assert Counter(map(len, by.values())) == Counter([3000, 1, 2])
    for v in by.values():
        v.sort()
        assert [n for n, _ in v] == list(range(1, len(v) + 1)) and [t for _, t in v] == sorted(t for _, t in v)


def test_very_long_texts_and_other_columns(spark):
    long = "</s> word \\ " * 200_000
    rows = [(1, 1, None, "user", long, 0.0, "x", "y", "z"), (1, 2, 1, "assistant", long + "end", 1.0, "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.digests(chat.conversations(df)).collect()
    import hashlib

    assert out[0].loss_chars == len(long) + 3 and out[0].loss_sha256 == hashlib.sha256((long + "end").encode()).hexdigest()
