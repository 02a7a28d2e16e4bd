"""Every stage of the pipeline on a small corpus against plain versions: nulls, empty and repeated rows, clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_decontamination import brute as brute_overlaps
from test_reference import plain_fit
from test_simhash import brute_fp

import corpus_pipeline
from quadrille.llm import toxicity
from quadrille.llm.packing import WordTokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, h long, fp string, key string"


def corpus():
    r = random.Random(61)
    vocabulary = [f"word{i}" for i in range(300)] + ["É", "日本"]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, item = some(45), some(25)
    rows, labels = [], []
    for i in range(110):
        text = some(r.randrange(30, 120))
        if i % 10 == 0:
            text += [r.choice(["scum", "vile"])] * 3
        if i % 9 == 1:
            text[10:10] = passage
        if i % 13 == 2:
            text[5:5] = item
        rows.append((i if i % 17 else None, " ".join(text)))
        labels.append((i, int(i % 10 == 0)))
    for i in range(12):  # near copies, also under an id that is taken
        words = rows[20 + i][1].split()
        words[r.randrange(len(words))] = "changed"
        rows.append((r.choice([500 + i, 20 + i + 1, None]), " ".join(words)))
    rows += [(700, None), (701, ""), (702, "  \n"), (None, None), (703, "one two"), *rows[:6], (704, "long text of many words " * 3000)]
    labels += [(3, None), (None, 1), (99999, 1)]
    return [(d, t, "en", None if i % 5 == 0 else "s", None if t is None else len(t), f"r{i}", None, i, "f", "k") for i, (d, t) in enumerate(rows)], labels, [(1, " ".join(item)), (2, None), (3, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("plain")
    rows, labels, bench = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(5).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return at


def key(x):
    return tuple(sorted(x.asDict().items(), key=lambda kv: kv[0]))


def plain_toxic(before, labels):
    """The rows that a plain learner keeps; places come from the operator's hashing."""
    def places(t):
        data = np.frombuffer((t or "").encode(), dtype=np.uint8)
        return sorted(set(toxicity.features(data, np.array([0, len(data)]))[1].tolist()))

    given = defaultdict(list)
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 5:
            given[d].append(y)
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    turn = lambda d: signed(xxhash.xxh64_intdigest((11).to_bytes(4, "little"), xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42)))
    text = {}
    for x in before:
        if x.doc_id in given:
            h = signed(xxhash.xxh64_intdigest((x.text or "").encode(), 42)) if x.text is not None else 42
            if x.doc_id not in text or h < text[x.doc_id][0]:
                text[x.doc_id] = (h, x.text)
    order = sorted(text, key=lambda d: (turn(d), d))
    weights, base = plain_fit([places(text[d][1]) for d in order], [float(sum(given[d]) / len(given[d]) >= 0.5) for d in order], toxicity.EPOCHS)
    return [x for x in before if base + sum(weights.get(p, 0.0) for p in places(x.text)) < 0]


def plain_near(before):
    rows = sorted(before, key=lambda x: (x.doc_id is None, x.doc_id or 0))
    fps = [brute_fp(x.text) for x in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    out = defaultdict(list)
    for i, x in enumerate(rows):
        out[find(i)].append(x)
    return list(out.values())


def test_stages_equal_plain_versions(spark, folder):
    sf, done = str(folder), []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(folder / f"stage{k}"))
        docs = spark.read.parquet(str(folder / f"stage{k}"))
        done.append((before, docs.collect()))
        assert k == 4 or docs.dtypes == columns
    before, after = done[0]
    assert Counter(map(key, after)) == Counter(map(key, plain_toxic(before, corpus()[1]))) and 5 <= len(before) - len(after) <= 20
    before, after = done[1]
    groups = plain_near(before)
    assert len(after) == len(groups) < len(before) - 6
    for members in groups:
        mine = [x for x in after if x in members]
        first = members[0].doc_id
        assert len(mine) == 1 and mine[0].doc_id == first
    before, after = done[2]
    seen, want = set(), {}
    import xxhash

    def tie(x):
        h = xxhash.xxh64_intdigest((x.text or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    for x in sorted(before, key=lambda x: (x.doc_id is not None, x.doc_id or 0, tie(x))):
        words, gone = re.findall(r"[^\x20\x09-\x0D]+", x.text or ""), set()
        for i in range(len(words) - 19):
            if (w := tuple(words[i : i + 20])) in seen:
                gone |= set(range(i, i + 20))
            seen.add(w)
        want[x.row] = (x.text, False) if not gone else ([w for i, w in enumerate(words) if i not in gone], True)
    assert len(after) == len(before) and sum(cut for _, cut in want.values()) > 5
    for x in after:
        text, cut = want[x.row]
        assert x.text.split() == text if cut else x.text == text
        assert x.n_chars == (None if x.text is None else len(x.text))
    before, after = done[3]
    bad = {n for n, _ in brute_overlaps([(n, x.text) for n, x in enumerate(before)], [(i, t) for i, t in corpus()[2] if t])}
    assert Counter(map(key, after)) == Counter(key(x) for n, x in enumerate(before) if n not in bad) and bad
    before, after = done[4]
    t, want = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for x in before:
        ids = t((x.text or "").encode()) + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[x.doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in after) == want
    used = defaultdict(list)
    for x in after:
        used[x.sequence_id].append((x.offset, x.length))
    for v in used.values():
        v.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(n for _, n in v) <= 4096


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_run_leaves_only_its_result(spark, folder, tmp_path, monkeypatch):
    from quadrille.llm import _frames

    # a folder of its own: others may write to the session's meanwhile
    monkeypatch.setattr(_frames, "shared_folder", lambda spark: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, str(folder)).count() > 50
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()] == ["pipeline-best-fit-packing"]
