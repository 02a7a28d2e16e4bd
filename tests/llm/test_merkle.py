"""Trees and likeness against a plain nested version, from the emitted form alone."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from quadrille.llm import merkle


def plain_tree(text):
    """Nested lists: sections of paragraphs of leaves."""
    paragraphs = [p for p in re.split(rb"(?<=\n)", text) if p]
    sections, section = [], []
    for p in paragraphs:
        words = re.findall(rb"\S+\s*|\s+", p)
        if len(words) <= 16:
            leaves = []
            for x in words:
                leaves += [x] if len(x) <= 8 else [x[i : i + 4] for i in range(0, len(x), 4)]
        else:
            leaves, run = [], []
            for x in words:
                run.append(x)
                if len(run) == 8 or zlib.crc32(x) % 4 == 0:
                    leaves.append(b"".join(run))
                    run = []
            leaves += [b"".join(run)] if run else []
        section.append(leaves)
        if len(section) == 8 or not p.strip():
            sections.append(section)
            section = []
    return sections + [section] if section else sections


def digest(kind, parts):
    return hashlib.blake2b(kind + b"".join(parts), digest_size=16).digest()


def plain_root(text):
    leaf = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    return digest(b"r", [digest(b"s", [digest(b"p", map(leaf, p)) for p in s]) for s in plain_tree(text)])


def plain_likeness(a, b):
    if a == b:
        return 1.0
    key = lambda x: repr(x)
    size = lambda x: len(x) if isinstance(x, bytes) else sum(map(size, x))
    x, y, common = plain_tree(a), plain_tree(b), 0
    for level in range(3):
        mine, theirs = Counter(map(key, x)), Counter(map(key, y))
        both = mine & theirs
        common += sum(size(next(n for n in x if key(n) == k)) * c for k, c in both.items())

        def rest(nodes, both=both):
            left, out = Counter(both), []
            for n in nodes:
                if left[key(n)]:
                    left[key(n)] -= 1
                else:
                    out.append(n)
            return out

        x, y = ([c for n in rest(z) for c in n] if level < 2 else [] for z in (x, y))
    return common / max(len(a), len(b), 1)


def texts():
    r = random.Random(41)
    some = ["the", "of", "a", "Internationalization", "日本", "x.", "\n", "\n\n", "end!", " ", "\t", "é"]
    out = ["", "a", "abcdefghijk", "\n", "\n\n\n"] + [" ".join(r.choice(some) for _ in range(r.choice([3, 10, 40, 300]))) for _ in range(60)]
    for t in list(out[20:50]):
        cut = r.randrange(len(t) + 1)
        out += [t[:cut] + "new words" + t[cut:], t[:cut]]
    return [t.encode() for t in out]


def test_trees_and_likeness_equal_a_plain_version():
    every = texts()
    trees = [merkle.Tree(t) for t in every]
    r = random.Random(42)
    for t, tree in zip(every, trees, strict=True):
        assert tree.root == plain_root(t) and tree.size == len(t)
        assert merkle.Tree.decoded(tree.encoded()).encoded() == tree.encoded()
    for _ in range(600):
        i, j = r.randrange(len(every)), r.randrange(len(every))
        got = merkle.Tree.decoded(trees[i].encoded()).likeness(merkle.Tree.decoded(trees[j].encoded()))
        assert got == pytest.approx(plain_likeness(every[i], every[j]), abs=1e-6) and (got == 1.0) == (every[i] == every[j])
        assert got == trees[i].likeness(trees[j]) == trees[j].likeness(trees[i])


def test_a_short_kept_half_is_found():
    for text in ("Hello there", "one two three four", "abcdefghijkl", "It was a dark and stormy night in the old town by the sea"):
        e = merkle.edited(text, "QQQQ ZZZZ " * 20)
        assert merkle.Tree(text.encode()).likeness(merkle.Tree(e.encode())) > 0.2


def test_emitted_trees_give_the_likeness_again(spark):
    r = random.Random(43)
    rows = [(None if i % 9 == 0 else i // 2, r.choice(texts()).decode(), "t", 5) for i in range(60)] + [(7, "same", "t", 1)] * 9 + [(50, "long words of a text " * 40_000, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tree string, run int")
    got = merkle.compared(df.repartition(5)).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    by = {t: merkle.Tree(t.encode()) for _, t, *_ in rows}
    roots = {v.root.hex(): v for v in by.values()}
    assert all(bytes(x.tree) == roots[x.fingerprint].encoded() and 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    assert sum(x.fingerprint == by["same"].root.hex() and x.near_next == 1.0 for x in got) >= 8


def test_neighbours_in_many_runs_and_of_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEAVY", 5)
    monkeypatch.setattr(merkle, "RUN_BYTES", 300)
    r = random.Random(44)
    rows = [(r.choice([None, i, i, -(1 << 63), (1 << 63) - 1]), f"text {r.randrange(40)} of {i % 7}") for i in range(150)] + [(3, "copies of one")] * 120 + [(None, None)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = merkle.compared(df).collect()
    import xxhash

    def h(t):
        v = xxhash.xxh64_intdigest(t.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), h(x[1])))
    want = Counter()
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        want[d, len(t), hashlib.sha256(merkle.edited(t, following).encode()).hexdigest(), merkle.Tree(t.encode()).likeness(merkle.Tree(following.encode()))] += 1
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256, x.near_next) for x in got) == want
