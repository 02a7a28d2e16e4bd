import random
import re

import pytest
import xxhash

from quadrille.llm import simhash
from quadrille.llm.simhash import fingerprint, links, near_duplicates, one_of_each

SCHEMA = "doc_id long, text string, fp string, component_id string"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def union_find(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def corpus():
    r = random.Random(3)
    word = lambda: r.choice("the of Und ÉTÉ a1 x y zz q7 ÄB".split())
    base = [[word() for _ in range(r.randrange(1, 300))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(r.randrange(1, 6)):
            c = list(b)
            for _ in range(r.randrange(3)):
                c[r.randrange(len(c))] = word()
            rows.append(r.choice([" ", "\n"]).join(c))
    rows += [None, "", " \t", "one", "ONE", "two words", "three word text"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_fingerprint():
    for _, t in corpus():
        assert fingerprint((t or "").encode()) == brute_fp(t)


def test_components_and_survivors(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "f", "c") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in near_duplicates(df).collect()}
    fps = [(d, brute_fp(t)) for d, t in rows]
    want = union_find(fps)
    assert {d: x for d, (x, _) in got.items()} == dict(fps)
    assert {d: c for d, (_, c) in got.items()} == want
    kept = one_of_each(df.union(df.limit(1))).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, c in want.items() if d == c})
    assert all(r.fp == "f" and r.component_id == "c" for r in kept)


def test_links_by_hot_and_plain_lookup(spark):
    r = random.Random(9)
    fps = set()
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(30):
            g = f
            for _ in range(r.randrange(5)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for distance in (1, 3):
        want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= distance}
        for hot in (2, 1000):
            assert {(x.a, x.b) for x in links(nodes, distance, hot).collect()} == want


def test_chain_reaches_the_least_id(spark):
    from quadrille.llm._graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(99, 98), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 98, 98: 98}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0 and one_of_each(df).count() == 0


def test_survivors_are_decided_by_row(spark):
    texts = [t for _, t in corpus()]
    r = random.Random(12)
    ids = [None, 1, 2, 3, 3, 3, 4, 5]
    rows = [(r.choice(ids), t, f"f{i % 2}", None) for i, t in enumerate(texts)] + [(5, "A " * 40, "x", "c"), (5, "B " * 40, "x", "c"), (1, "A " * 40, "x", "c"), (7, "C c1", "x", "c"), (7, "D d1", "x", "c")]
    rows += rows[:3] + [(*rows[4][:2], "other", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = [tuple(x) for x in one_of_each(df).collect()]
    fps = [brute_fp(t) for _, t, *_ in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    part[i] = part[j] = min(part[i], part[j])
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(part[i], []).append(row)
    assert len(kept) == len(groups)
    order = lambda d: (d is None, d or 0)
    for members in groups.values():
        mine = [k for k in kept if k in members]
        assert len(mine) == 1 and order(mine[0][0]) == min(order(m[0]) for m in members)
    assert {(5, "B " * 40, "x", "c"), (1, "A " * 40, "x", "c"), (7, "C c1", "x", "c"), (7, "D d1", "x", "c")} <= set(kept)
    assert sorted(kept, key=repr) == sorted(map(tuple, one_of_each(df.repartition(3)).collect()), key=repr)


def test_crowds_keep_their_components(spark):
    from quadrille.llm._graph import components
    from quadrille.llm.simhash import _through_centres

    r = random.Random(13)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = set()
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(60):
            g = f
            for _ in range(r.randrange(5)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
            f = g if r.random() < 0.1 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    rows = sorted(fps)
    for distance in (1, 2, 3):
        part = {f: f for f in rows}
        for _ in rows:
            moved = False
            for a in rows:
                for b in rows:
                    if (a ^ b).bit_count() <= distance and part[a] != part[b]:
                        part[a] = part[b] = min(part[a], part[b])
                        moved = True
            if not moved:
                break
        want = {}
        for f, p in part.items():
            want.setdefault(p, set()).add(signed(f))
        want = sorted(map(sorted, (v for v in want.values() if len(v) > 1)))

        def groups(edges):
            out = {}
            for x in components(edges).collect():
                out.setdefault(x.component, []).append(x.node)
            return sorted(map(sorted, out.values()))

        thin = _through_centres(nodes, distance)
        pairs = [(x.a, x.b) for x in thin.collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= distance and a < b for a, b in pairs)
        assert groups(thin) == want
        assert groups(links(nodes, distance, 2, 3)) == want


def test_many_copies_and_null_ids(spark):
    rows = [(None if i % 2 else i, "same words of one text") for i in range(3000)] + [(None, f"own text number {i} of its kind {i * 7919 % 1009}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(df).collect()
    assert len(found) == len(rows) and {x.component_id for x in found if x.fp == found[0].fp} <= {0, None}
    kept = one_of_each(df).collect()
    assert [x.doc_id for x in kept if x.text.startswith("same")] == [0]


@pytest.mark.parametrize("make", [lambda n: simhash.links(n, 3, crowd=8), lambda n: simhash._through_centres(n, 3)])
def test_probes_are_never_broadcast(spark, make):
    base = 0x0123456789ABCDEF
    nodes = simhash.written(spark.createDataFrame([(base ^ (1 << i) ^ (1 << j),) for i in range(12) for j in range(i)], "fp long"), "nodes")  # a file, whose small size the planner knows
    plan = make(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and not re.search(r"BroadcastHashJoin .*Inner", plan)


def test_rows_that_go_are_never_broadcast(spark):
    rows = [(i, f"text number {i % 9} of a few that come often {i % 9 * 7919}") for i in range(400)] + [(1, "text number 1 of a few that come often 7919")] * 3 + [(0, "text number 0 of a few that come often 0")]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin .*LeftAnti", plan) and not re.search(r"BroadcastHashJoin .*Left(Anti|Semi)", plan)
    least = {}
    for i, text in rows:
        least[text] = min(i, least.get(text, i))
    fps = {t: simhash.fingerprint(t.encode()) for t in least}
    assert all((fps[a] ^ fps[b]).bit_count() > 3 for a in least for b in least if a < b)  # of these texts only the copies are near
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == sorted((i, t) for t, i in least.items())
