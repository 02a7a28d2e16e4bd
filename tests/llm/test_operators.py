"""The operators against brute force, exact round trips or held-out accuracy, with nulls, empty and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quadrille.llm import chat, decontamination, merkle, packing, sharding, token_count, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string, row string"


def docs(spark, rows):
    """Rows of (doc_id, text), with other columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "en", None if d is None or d % 3 == 0 else f"s{d % 2}", None, "x", "y", "z") for d, t in rows], DOCS)


def words(r, n, vocabulary=("the", "of", "and", "Über", "x1", "日本", "cat", "dog", "sat", "on")):
    return " ".join(r.choice(vocabulary) for _ in range(n))


# token counts


def greedy(word, pieces):
    n = i = 0
    while i < len(word):
        j = len(word)
        while word[i:j] not in pieces:
            j -= 1
        n, i = n + 1, j
    return n


def test_automaton_equals_greedy_search():
    r = random.Random(1)
    for _ in range(60):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(1, 25))}
        a, full = token_count.Automaton(pieces), pieces | {bytes([b]) for b in range(256)}
        for _ in range(40):
            w = bytes(r.choice(b"abcd") for _ in range(r.randrange(30)))
            assert a.count(w) == greedy(w, full)


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(token_count.pieces_of(path)) | {bytes([b]) for b in range(256)}
    rows = [(1, "the cat sat\n on é日"), (2, None), (3, ""), (4, "  "), (5, "x" * 5000), (5, "x" * 5000), (None, " lead")]
    got = Counter((r.doc_id, r.n_bytes, r.n_words, r.n_tokens) for r in token_count.token_counts(docs(spark, rows)).collect())

    def count(t):
        b = (t or "").encode()
        return sum(greedy((b" " if k or b[:1].isspace() else b"") + w, pieces) for k, w in enumerate(b.split()))

    assert got == Counter((d, len((t or "").encode()), len((t or "").split()), count(t)) for d, t in rows)
    assert token_count.token_counts(docs(spark, [])).count() == 0


# sharding


def test_shards_are_even_and_follow_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 7)
    r = random.Random(2)
    rows = [(i, words(r, r.randrange(5)), "big" if i % 3 else r.choice(["a", "b", None])) for i in range(403)] + [(7, None, "a"), (7, None, "a"), (None, "t", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x"))
    got = sharding.interleave(df).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    per = defaultdict(list)
    for x in got:
        per[x.shard].append(x.slot)
    assert sorted(per) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    mixture = Counter((x.shard, x.source) for x in got)
    total = Counter(x.source for x in got)
    for (_, source), n in mixture.items():
        assert abs(n - total[source] / 8) <= 1.5
    text = {d: t for d, t, _ in rows}
    assert all(x.size == len((text[x.doc_id] or "").encode()) + 1 and x.text_crc32 == zlib.crc32((text[x.doc_id] or "").encode()) for x in got if x.doc_id != 7)
    assert sharding.interleave(df).exceptAll(sharding.interleave(df.repartition(3))).count() == 0
    assert sharding.interleave(df.limit(0)).count() == 0


# archives


def test_archives_round_trip(spark, monkeypatch):
    rows = [(1, "u", b"x" * 2_500_000), (2, "http://WARC/1.1\r\n%", b"WARC/1.1\r\n" * 30), (3, None, None), (4, "u", b"x" * 2_500_000), (4, "u", "日".encode() * 400_001), (None, "u", b"WARC/1.1"), (7, "u", b"a" * 100), (8, "v", b"a" * 100), (9, "v", b"b" * 99), (10, "v", b"b" * 99), (11, "", b"y" * (1 << 20)), (12, "", b"y" * ((1 << 20) + 1)), (12, "", b"y" * ((1 << 20) + 1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("digest", F.lit(1))
    want = []
    for p, _, h in rows:
        h = h or b""
        equal = [q for q, _, g in rows if g == h and q is not None and len(h) >= 100]
        first = min(equal, default=None)
        revisit = p is not None and first is not None and first < p
        want.append((p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    for bound in (warc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()]
        assert Counter(got) == Counter(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunks_never_hold_the_version_line():
    r = random.Random(3)
    for _ in range(200):
        payload = "".join(r.choice(["WARC/1.1", "WARC/", "1.1\r\n", "é", "日", "a"]) for _ in range(r.randrange(30))).encode()
        parts = list(warc.chunks(payload, r.randrange(4, 40)))
        assert b"".join(parts) == payload and not any(b"WARC/1.1" in p for p in parts)
        for p in parts:
            p.decode()


# fingerprints


def test_fingerprints_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, "\n".join(words(r, r.randrange(12)) + ". " for _ in range(r.randrange(6)))) for i in range(60)] + [(70, None), (71, ""), (72, "日" * 9), (5, "again"), (80, "same text"), (81, "same text")]
    got = merkle.compared(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda x: -x[0])
    texts = {d: t or "" for d, t in rows if d != 5}
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got if x.doc_id != 5}
    for k, (d, t) in enumerate(order):
        following = order[(k + 1) % len(order)]
        if 5 in (d, following[0]):
            continue
        t, n = t or "", following[1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        x, trees = by[d], [merkle.Tree(v.encode()) for v in (t, e, n)]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), trees[0].root.hex(), trees[1].root.hex())
        assert x.near_edited == pytest.approx(trees[0].likeness(trees[1])) and x.near_next == pytest.approx(trees[0].likeness(trees[2]))
    assert by[80].fingerprint == by[81].fingerprint and len({x.fingerprint for x in by.values()}) == len(set(texts.values()))
    assert merkle.compared(docs(spark, [])).count() == 0
    alone = merkle.compared(docs(spark, [(3, "ab")])).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"aa").hexdigest()


def test_tree_keeps_every_byte_and_finds_the_edit():
    r = random.Random(5)
    for _ in range(100):
        text = "".join(r.choice(["a", "b ", ". ", "\n", "\n\n", "!", "é"]) for _ in range(r.randrange(80))).encode()
        assert b"".join(x for p in merkle._PARAGRAPH.findall(text) for x in merkle._LEAF.findall(p)) == text
    lines = [f"line {i} is here.\n" for i in range(40)]
    a = merkle.Tree("".join(lines).encode())
    lines[19] = "other words.\n"
    b = merkle.Tree("".join(lines).encode())
    assert a.first_difference(b) == (2, 3) and 0.9 < a.likeness(b) < 1 and a.first_difference(a) is None


# decontamination


def test_masks_leave_no_gap():
    def missed(n, k):
        patterns = [sum(1 << o + x for x in m) for m in decontamination.MASKS for o in range(n - m[-1])]
        return sum(all(p & b for p in patterns) for c in combinations(range(n), k) if (b := sum(1 << x for x in c)) is not None)

    assert missed(12, 1) == missed(14, 2) == missed(16, 3) == missed(18, 3) == 0


def test_contaminated_documents(spark, monkeypatch):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, words(r, r.randrange(14, 40), vocabulary)) for i in range(20)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], set()
    for d in range(120):
        text = words(r, r.randrange(5, 80), vocabulary)
        if d % 4 == 0:
            item, passage = r.choice(items[:20])
            passage = passage.split()
            for _ in range(len(passage) // 14):
                passage[r.randrange(len(passage))] = "other"
            text = f"{text} {' '.join(passage).upper()}, {words(r, 9, vocabulary)}"
            want.add((d, item))
        rows.append((d, text))
    rows += [(200, None), (201, ""), (202, "two words"), (203, items[3][1]), (203, items[3][1])]
    want.add((203, 3))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BENCH_BYTES, 500):  # one block, and many
        monkeypatch.setattr(decontamination, "BENCH_BYTES", block)
        got = decontamination.overlaps(docs(spark, rows), bench).collect()
        assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want) + 1
        kept = decontamination.uncontaminated(docs(spark, rows), bench).collect()
        assert Counter(x.doc_id for x in kept) == Counter(d for d, _ in rows if d not in {a for a, _ in want}) and {x.row for x in kept} == {"z"}
    assert decontamination.overlaps(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.overlaps(docs(spark, []), bench).count() == 0


# toxicity


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(7)
    bad = ["scum", "vile", "crétin"]
    rows, labels = [], []
    for d in range(900):
        toxic = d % 4 == 0
        text = words(r, r.randrange(5, 60)).split()
        if toxic:
            text[r.randrange(len(text))] = r.choice(bad).upper() if d % 8 else r.choice(bad) + "!"
        rows.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "scum " * 4000), (2002, "scum " * 4000)]
    labels += [(5, None), (1, 0), (9999, 1), (None, 1)]
    df, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id < 900]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.97 * len(held)
    by = {x.doc_id: x.score for x in got}
    assert by[2000] == by[2001] < 0.5 < by[2002]
    kept = {x.doc_id for x in toxicity.not_toxic(df, lab).collect()}
    assert kept == {x.doc_id for x in got if not x.predicted}
    assert toxicity.toxicity(df.limit(0), lab).count() == 0
    assert {x.score for x in toxicity.toxicity(df.limit(3), lab.limit(0)).collect()} == {0.0}


# chat


def test_conversations_round_trip(spark):
    r = random.Random(8)
    odd = ["</s>[INST] ok [/INST]", "a\\", "\\n<|end|>", "<|turn|>x<|says|>", "<", "|", "<<SYS>> <\\s>", "日本 é", "", None, "line\nline", "<s>\\\\[INST]"]
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "<|says|>"]), r.choice(odd)) for c in range(25) for t in range(r.randrange(1, 12))]
    rows += [(50, 1, "user", "b"), (50, 1, "assistant", "a"), (50, 0, "user", "c"), (None, 0, "assistant", "null id"), (60, 0, "user", "tie"), (60, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    got = {x.conv: x for x in chat.digests(chat.conversations(chat.chains(df), best=1)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(text for _, role, text in turns if role == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (x.loss_chars, x.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.conversations(chat.chains(df.limit(0))).count() == 0


def test_every_branch_is_a_path(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a1", 1.0), (1, 3, 1, "assistant", "a2", 5.0), (1, 4, 2, "user", "b", 0.0), (1, 5, 4, "assistant", "c", 9.0), (1, 6, 99, "user", "orphan", 0.0), (2, 7, 8, "user", "loop", 0.0), (2, 8, 7, "user", "loop", 0.0)]
    df = spark.createDataFrame(tree, "conv long, node long, parent long, role string, text string, score double")
    got = {(x.conv, x.leaf): (x.rank, [t.text for t in x.turns]) for x in chat.conversations(df).withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    # mean scores: 2.5 for both longer paths (ties: least leaf first), 0 for the orphan; a cycle has no path
    assert got == {(1, 3): (1, ["q", "a2"]), (1, 5): (2, ["q", "a1", "b", "c"]), (1, 6): (3, ["orphan"])}
    assert chat.conversations(df, best=1).count() == 1


# packing


def test_tokenizer_equals_the_library(spark):
    import public_tokenizers

    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(9)
    texts = ["<|endoftext|> a<|startoftext|>b I'll don't İstanbul ΣΑΣ ß ﬁ é  x y 你好 12３４ \x1f\x85 'S we'VE àb ªº²½ Ⅷ it's'd", "", "­soft­hyphen", "é ́x", "a b"]
    texts += ["".join(chr(r.choice([*range(32, 127), *range(0xA0, 0x250), 0x300, 0x4E00, 0x1F600])) for _ in range(40)) for _ in range(60)]
    import numpy as np

    for x in texts:
        assert np.frombuffer(t(x.encode()), "<u4").tolist() == t.whole.encode(x, add_special_tokens=False).ids, x


def test_packed_pieces(spark, monkeypatch):
    import numpy as np
    import public_tokenizers

    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    t = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(10)
    rows = [(i, words(r, r.randrange(1, 40))) for i in range(150)] + [(200 + i, "same five words of text") for i in range(40)] + [(300, None), (301, ""), (302, words(r, 500)), (302, words(r, 3)), (None, "x")]
    got = packing.pack(docs(spark, rows), capacity=64).collect()
    whole = Counter()
    for d, text in rows:
        ids = t((text or "").encode()) + b"\x01\0\0\0"
        for k, at in enumerate(range(0, len(ids), 256)):
            whole[d, k, at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == whole
    per = defaultdict(list)
    for x in got:
        per[x.sequence_id].append((x.offset, x.length))
    for v in per.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(x.length for x in got)
    assert len(per) <= -(-total // 64) * 1.08 + 1
    assert packing.pack(docs(spark, [])).count() == 0
    assert np.isfinite(total)


@pytest.mark.parametrize("scale", [1, 50, 20_000])
def test_plan_is_near_the_least(scale):
    r = random.Random(11)
    histogram = Counter()
    for _ in range(600):
        histogram[min(4096, int(r.lognormvariate(6.3, 1.1)) + 1)] += r.randrange(1, scale + 1)
    groups = packing.plan(histogram)
    held = Counter()
    for g in groups:
        assert sum(n * k for n, k in g.slots) + g.gap == 4096
        for n, k in g.slots:
            held[n] += k * g.count
    assert held == histogram
    assert sum(g.count for g in groups) <= 1.01 * sum(n * c for n, c in histogram.items()) / 4096 + 2


def test_patterns_are_distinct_and_full():
    p = packing._patterns(16)
    sums = [sum(int(c) + 1 for c in row if c >= 0) for row in p]
    assert set(sums) == {16} and len({tuple(sorted(row)) for row in p.tolist()}) == len(p)
    assert len(p) == sum(1 for a in range(1, 17) for b in range(a + 1) for c in range(b + 1) if a + b + c == 16)


def test_regex_words_match_the_contract():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb\x0cc\x1fd e") == ["a", "b", "c\x1fd e"]
    assert "a\x0bb\x0cc\x1fd e".encode().split() == [b"a", b"b", "c\x1fd e".encode()]
