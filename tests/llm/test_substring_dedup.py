import hashlib
import re

import pytest

from quadrille.llm.substring_dedup import repeated_spans, without_repeats

SCHEMA = "doc_id long, text string, kept string, key long"


def brute(rows, width):
    texts = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.setdefault((doc, text), words)
    seen, out = set(), {}
    for doc, text in sorted(texts, key=lambda x: x[0]):
        words = texts[doc, text]
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out[doc, text] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept.split())
    return out


def corpus():
    import random

    r = random.Random(5)
    word = lambda: r.choice(["a", "bé", "c日", "d", "ee", "f!"])
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = [(i, " ".join([word() for _ in range(r.randrange(40))]) + "\n" + r.choice([*shared, "", ""]) + "\t " + " ".join(word() for _ in range(r.randrange(9)))) for i in range(60)]
    rows += [(100 + i, shared[0]) for i in range(30)]
    rows += [(200, None), (201, ""), (202, "   "), (203, "one"), (204, "x " * 500), (0, rows[0][1]), (0, rows[0][1])]
    return rows


@pytest.mark.parametrize("width", [3, 5, 20])
def test_equals_brute_force(spark, width):
    rows = corpus()
    want = brute(rows, width)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    got = {}
    for r in repeated_spans(df, width).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, r.kept_sha256))
    assert sum(1 for _ in repeated_spans(df, width).collect()) == len(rows)
    assert got == {d: {v[:3]} for (d, _), v in want.items()}
    cut = without_repeats(df, width).collect()
    assert {r.doc_id: (r.text or "").split() for r in cut} == {d: v[3] for (d, _), v in want.items()}
    assert all(r.kept == "x" and r.key == 1 for r in cut)
    same = {d: t for (d, t), v in want.items() if v[1] == 0}
    assert all(r.text == same[r.doc_id] for r in cut if r.doc_id in same)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repeated_spans(df).count() == 0 and without_repeats(df).columns == df.columns


def test_null_id_ranks_first(spark):
    text = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(5, text), (None, text)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in repeated_spans(df).collect()} == {None: 0, 5: 25}
