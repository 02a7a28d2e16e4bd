"""Plain versions of the rankings, the learning and the fit, and rows that share ids, have none, or are very many."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import packing, sharding, substring_dedup, toxicity
from quadrille.llm import _words as w

# sharding


def turn(d, crc, size, copy):
    """Spark's xxhash64 of four longs and the seed, an int: each value is hashed with the hash before it, nulls are skipped."""
    h = 42
    for v in (d, crc, size, copy):
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return xxhash.xxh64_intdigest((42).to_bytes(4, "little"), h)


def test_shards_equal_a_plain_ranking(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 5)
    r = random.Random(51)
    rows = [(r.choice([None, i, i, i, 5]), r.choice(["a", "bb", None, "日本", f"t{i}"]), r.choice(["x", "y", "y", None])) for i in range(150)] + [(None, "same", "x")] * 40
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)).collect()
    seen, plain = Counter(), []
    for d, t, s in rows:
        size, crc = len((t or "").encode()) + 1, zlib.crc32((t or "").encode())
        copy = seen[d, size, crc, s]
        seen[d, size, crc, s] += 1
        plain.append((turn(d, crc, size, copy), d, size, crc, s))
    of, rank, order = Counter(s for *_, s in plain), Counter(), []
    for _, d, size, crc, s in sorted(plain, key=lambda x: x[0] & (1 << 64) - 1):
        order.append(((2 * rank[s] + 1) / (2 * of[s]), "s" + s if s is not None else "", d, size, crc, s))
        rank[s] += 1
    order.sort(key=lambda x: x[:2])
    n, want = len(order), Counter()
    for p, (_, _, d, size, crc, s) in enumerate(order):
        shard = p * 8 // n
        want[d, size, crc, s, shard, p - -(-shard * n // 8)] += 1
    assert Counter((x.doc_id, x.size, x.text_crc32, x.source, x.shard, x.slot) for x in got) == want


# toxicity


def plain_fit(texts, labels, epochs):
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "intercept" else toxicity.L1
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for places, y in zip(texts, labels, strict=True):
            at = [*places, "intercept"]
            ww = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(ww.values()))))) - y
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * ww[i]
                n[i] += g * g
    return {i: weight(i) for i in list(z) if i != "intercept" and weight(i)}, weight("intercept")


def test_learning_equals_a_plain_version():
    r = random.Random(52)
    texts = [sorted(r.sample(range(40), r.randrange(12))) for _ in range(120)]
    labels = [float(any(i < 3 for i in t)) for t in texts]
    cut = np.concatenate(([0], np.cumsum(list(map(len, texts)))))
    at, ww, intercept = toxicity.fit(np.array([i for t in texts for i in t], dtype=np.int64), cut, np.array(labels), bits=6, epochs=7)
    want, base = plain_fit(texts, labels, 7)
    assert dict(zip(at.tolist(), ww.tolist(), strict=True)) == pytest.approx(want) and intercept == pytest.approx(base) and len(want) > 2


def test_features_equal_a_plain_version():
    texts = ["You're a FOOL, Émile", "", "one", "日本 x x x", "a b c d e f"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    doc, place = toxicity.features(data, off)
    for k, t in enumerate(texts):
        assert (doc == k).sum() == len(_grams(t))
    # equal features share a place, different ones do not (at these few)
    assert len(set(place.tolist())) == len({g for t in texts for g in _grams(t)})


def _grams(t):
    words = [x.lower() for x in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)]
    return [("1", x) for x in words] + [("2", *p) for p in zip(words, words[1:])] + [("3", a, b) for a, b in zip(words, words[2:])]


def test_texts_that_share_an_id_are_learned_from_alike(spark):
    r = random.Random(53)
    rows = [(i % 90 if i % 3 else None, " ".join(r.choice(["good", "fine", "vile", "scum", "tea"]) for _ in range(6))) for i in range(400)]
    labels = [(i, i % 2) for i in range(90)] + [(None, 1)] * 5
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one = sorted((str(x.doc_id), x.score) for x in toxicity.toxicity(df, lab).collect())
    assert one == sorted((str(x.doc_id), x.score) for x in toxicity.toxicity(df.repartition(7), lab).collect()) and len(one) == len(rows)


# packing


def brute_non_negative(a, b):
    """The least squares over every set of columns with a solution of none but positive numbers."""
    best = (float(b @ b), np.zeros(a.shape[1]))
    for mask in range(1, 1 << a.shape[1]):
        cols = [j for j in range(a.shape[1]) if mask >> j & 1]
        x, *_ = np.linalg.lstsq(a[:, cols], b, rcond=None)
        if (x > 0).all():
            miss = float(((a[:, cols] @ x - b) ** 2).sum())
            if miss < best[0] - 1e-9:
                full = np.zeros(a.shape[1])
                full[cols] = x
                best = (miss, full)
    return best


def test_the_fit_is_the_least_of_all():
    r = random.Random(54)
    for _ in range(30):
        patterns = packing._patterns(6)
        patterns = patterns[sorted(r.sample(range(len(patterns)), min(len(patterns), 6)))]
        target = np.array([r.randrange(50) for _ in range(6)], dtype=float)
        a = np.zeros((6, len(patterns)))
        for j, row in enumerate(patterns):
            for c in row:
                if c >= 0:
                    a[c, j] += 1
        x = packing.non_negative_fit(patterns, target)
        assert (x >= 0).all()
        assert float(((a @ x - target) ** 2).sum()) <= brute_non_negative(a, target)[0] + 1e-4 * max(1.0, float(target @ target))


def test_another_tokenizer_takes_the_library(tmp_path):
    import json

    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    assert packing.WordTokenizer(path).known
    d["normalizer"]["normalizers"] = d["normalizer"]["normalizers"][:2]  # no lower case
    (tmp_path / "t.json").write_text(json.dumps(d), encoding="utf-8")
    t = packing.WordTokenizer(str(tmp_path / "t.json"))
    text = "The CAT's Hat\n 12 日本"
    assert not t.known and np.frombuffer(t(text.encode()), "<u4").tolist() == t.whole.encode(text, add_special_tokens=False).ids


def test_alike_rows_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    df = spark.createDataFrame([(None, "same words here")] * 300 + [(4, None)] * 50, "doc_id long, text string")
    got = packing.pack(df, capacity=16).collect()
    assert len(got) == 350 and len({(x.sequence_id, x.offset) for x in got}) == 350


# substring dedup


def test_rows_without_ids_and_with_one_id_keep_their_own_places(spark):
    r = random.Random(55)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(9))
    shared = " ".join(word() for _ in range(25))
    texts = sorted({" ".join(word() for _ in range(r.randrange(30))) + (" " + shared if i % 4 == 0 else "") for i in range(300)})
    for key in (None, 7):
        df = spark.createDataFrame([(key, t) for t in texts], "doc_id long, text string").repartition(4)
        got = substring_dedup.without_repeats(df).collect()
        assert len(got) == len(texts)
        seen, want = set(), Counter()
        for t in sorted(texts, key=lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))):
            words, gone = t.split(), set()
            for i in range(len(words) - 19):
                if (window := tuple(words[i : i + 20])) in seen:
                    gone |= set(range(i, i + 20))
                seen.add(window)
            want[tuple(x for i, x in enumerate(words) if i not in gone)] += 1
        assert Counter(tuple(x.text.split()) for x in got) == want and len(seen) > 100


def test_groups_agree_with_the_columns(spark):
    r = random.Random(56)
    rows = [(r.randrange(-(1 << 62), 1 << 62), r.randrange(-(1 << 63), 1 << 63)) for _ in range(500)] + [(substring_dedup.NO_ID, -(1 << 63)), (0, (1 << 63) - 1)]
    df = spark.createDataFrame(rows, "k long, t long").select("k", "t", substring_dedup._group_expr(F.col("k"), F.col("t"), 13).alias("g")).collect()
    k, t = (np.array([x[i] for x in df], dtype=np.int64) for i in (0, 1))
    assert substring_dedup._spread(k, t, 13).tolist() == [x.g for x in df]


def test_the_second_hash_is_its_own():
    data = np.frombuffer(b"some words and some more words", dtype=np.uint8)
    words = w.Words(data, np.array([0, len(data)]))
    a, b = words.hashes(), words.hashes(base=w.OTHER_BYTES, values=w.OTHER_VALUES)
    assert a[0] == a[3] and b[0] == b[3] and not set(a.tolist()) & set(b.tolist()) and len(set((a ^ b).tolist())) == len(set(a.tolist()))
