"""Seeds, stretches and both joins against a plain search for overlaps."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quadrille.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, items string, h string, row string"


def words(text):
    return [x.lower() for x in WORD.findall(text or "")]


def best_stretch(equal):
    best, at = 0, (0, 0)
    for i in range(len(equal)):
        score = 0
        for j in range(i, len(equal)):
            score += 1 if equal[j] else -3
            if score > best:
                best, at = score, (i, j + 1)
    return at


def counts(equal, item_words):
    i, j = best_stretch(equal)
    if j - i >= min(12, item_words) and j > i and sum(equal[i:j]) >= 0.8 * (j - i):
        return True
    return any(sum(equal[i : i + n]) >= 0.8 * n for n in range(12, 24) for i in range(len(equal) - n + 1))


def seeded(a, b, shift):
    """Whether some mask, or a short item as a whole, meets only equal words."""
    if len(a) < 8:
        return len(a) >= 4 and shift >= 0 and b[shift : shift + len(a)] == a
    same = {i for i in range(len(a)) if 0 <= i + shift < len(b) and a[i] == b[i + shift]}
    return any(all(o + x in same for x in m) for m in d.MASKS for o in range(len(a) - m[-1]) if o + m[-1] + shift < len(b) and o + shift >= 0)


def brute(docs, items):
    out = set()
    for k, text in docs:
        b = words(text)
        for item, passage in items:
            a = words(passage)
            for shift in range(-len(a) + 1, len(b)):
                if seeded(a, b, shift):
                    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
                    if counts([a[i] == b[i + shift] for i in range(lo, hi)], len(a)):
                        out.add((k, item))
                        break
    return out


def test_stretches_equal_brute_force():
    r = random.Random(31)
    flags = [[r.random() < r.choice([0.5, 0.8, 0.95]) for _ in range(r.randrange(1, 50))] for _ in range(400)]
    least = [r.choice([12, 12, len(f), 5]) for f in flags]
    least = [min(12, x) for x in least]
    first, n, eq = d._stretches(np.array([x for f in flags for x in f]), np.array(list(map(len, flags))), np.array(least))
    for f, m, a, k, e in zip(flags, least, first.tolist(), n.tolist(), eq.tolist(), strict=True):
        assert bool(k) == counts(f, m)
        if k:
            assert k >= m and sum(f[a : a + k]) == e >= 0.8 * k


def corpus():
    r = random.Random(32)
    vocabulary = [f"v{i}" for i in range(60)] + ["É", "ß", "日本"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    template = some(17)
    items = [(i, " ".join(some(r.randrange(4)) + template + some(9))) for i in range(30)]
    items += [(100 + i, " ".join(some(r.randrange(8, 40)))) for i in range(20)] + [(200 + i, " ".join(some(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 7))]
    items += [(300, items[35][1].upper()), (301, items[35][1]), (None, "a b c d e f"), (302, None), (303, "")]
    docs = []
    for k in range(90):
        text = some(r.randrange(60))
        if k % 3 == 0:
            p = words(r.choice(items[:57])[1])
            for _ in range(r.randrange(1 + len(p) // 6)):
                p[r.randrange(len(p))] = "other"
            at = r.randrange(len(text) + 1)
            text[at:at] = p[r.randrange(1 + len(p) // 8) :]
        docs.append((k, r.choice([" ", ", ", "\n"]).join(text)))
    docs += [(500, " ".join(some(3000) + words(items[40][1]))), (501, "x " + " ".join(template)), (501, "y z"), (None, items[2][1]), (None, "nothing of it"), (502, None), (503, ""), (504, "A. b! c d e f")]
    return docs + [docs[0], docs[0]], items


@pytest.mark.parametrize("large", [False, True])
def test_both_joins_equal_brute_force(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(d, "BENCH_BYTES", 100)
        monkeypatch.setattr(d, "CHUNK", 5)
        monkeypatch.setattr(d, "FILTER_BITS", 1 << 12)
    monkeypatch.setattr(d, "HITS", 50)
    monkeypatch.setattr(d, "STRETCH", 300)
    docs, items = corpus()
    rows = [(k, t, "x", "y", f"r{i}") for i, (k, t) in enumerate(docs)]
    df, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    rep = {}
    for i, t in items:
        rep.setdefault(" ".join(words(t)), []).append(i)
    least = {i: min(v, key=lambda x: (x is not None, x or 0)) for v in rep.values() for i in v}
    times = {least[v[0]]: len(v) for v in rep.values()}
    place = brute([(n, t) for n, (_, t) in enumerate(docs)], items)
    want = Counter((docs[n][0], i) for n, i in {(n, least[i]) for n, i in place})
    got = d.overlaps(df, bench).collect()
    assert Counter((x.doc_id, x.item_id) for x in got) == want
    assert all(x.items == times[x.item_id] and 0 < x.equal_words <= x.words for x in got)
    one = d.contaminated(df, bench).collect()
    bad = {n for n, _ in place}
    assert Counter(x.doc_id for x in one) == Counter(docs[n][0] for n in bad)
    assert sorted(x.items for x in one) == sorted(sum(times[j] for j in {least[i] for m, i in place if m == n}) for n in bad)
    kept = d.uncontaminated(df, bench).collect()
    assert {x.row for x in kept} == {f"r{n}" for n in range(len(docs)) if n not in bad} and len(kept) == len(docs) - len(bad)
    assert d.contaminated(df.limit(0), bench).count() == 0 and d.uncontaminated(df, bench.limit(0)).count() == len(docs)
