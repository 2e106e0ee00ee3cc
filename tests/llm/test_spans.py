import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from docloom.llm import spans
from docloom.llm.spans import anchors, prime_hashes, shared_share, shared_span_pairs, window_hashes

SPAN, K = 40, 20


def corpus(seed):
    rng = random.Random(seed)
    alphabet = "ab é\n" if seed % 2 else "abcdefgh ijklm"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [make(rng.randrange(30, 90)) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [make(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            c = rng.choice(common)
            a = rng.randrange(0, 20)
            parts += [c[a : rng.randrange(a + 1, len(c) + 1)], make(rng.randrange(0, 40))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "a" * 120, "a" * 150, None, "", "short"]
    return list(enumerate(texts))


def brute(rows):
    where, covered = defaultdict(set), {}
    for i, t in rows:
        for p in range(len(t or "") - SPAN + 1):
            where[t[p : p + SPAN]].add(i)
    pairs = {p for ids in where.values() for p in combinations(sorted(ids), 2)}
    for i, t in rows:
        hit = set()
        for p in range(len(t or "") - SPAN + 1):
            if len(where[t[p : p + SPAN]]) > 1:
                hit.update(range(p, p + SPAN))
        covered[i] = len(hit)
    return pairs, covered


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_and_shares_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, covered = brute(rows)
    assert {tuple(r) for r in shared_span_pairs(df, span=SPAN, k=K).collect()} == pairs
    got = {r["doc_id"]: r["shared_chars"] for r in shared_share(df, span=SPAN, k=K).collect()}
    assert got == covered


def test_anchor_guarantee():
    rng = random.Random(9)
    for _ in range(200):
        run = "".join(rng.choice("abcd") for _ in range(SPAN))
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 50))) + run + "".join(rng.choice("abcd") for _ in range(30)) for _ in range(2)]
        a, b = (set(anchors(t, K, SPAN)[1].tolist()) for t in texts)
        assert a & b


def test_window_hashes_depend_on_the_window_alone():
    codes = np.frombuffer(("xyz" + "hello world" + "q").encode("utf-32-le"), dtype=np.uint32)
    other = np.frombuffer("hello world".encode("utf-32-le"), dtype=np.uint32)
    assert window_hashes(codes, 11)[3] == window_hashes(other, 11)[0]
    assert len(window_hashes(other, 12)) == 0
    assert prime_hashes(codes, 11)[3] == prime_hashes(other, 11)[0] and len(prime_hashes(other, 12)) == 0
    assert len(set(prime_hashes(codes, 3).tolist())) == len(codes) - 2


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_anchors_are_spread(spark, seed, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 3)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in shared_span_pairs(df, span=SPAN, k=K).collect()} == brute(rows)[0]


def test_blocks_of_a_long_text(monkeypatch):
    text = "".join(random.Random(8).choice("abc") for _ in range(3000))
    whole = anchors(text, K, SPAN)
    monkeypatch.setattr(spans, "_POS_BITS", 8)
    parts = anchors(text, K, SPAN)
    # fewer bits of the hash decide in a block, so ties may fall otherwise; each run still has its anchor
    assert np.diff(parts[0]).max() <= SPAN - K + 1 and len(parts[0]) < len(whole[0]) * 1.5
    h = window_hashes(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), K)
    assert (h[parts[0]] == parts[1]).all()


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shared_span_pairs(empty).count() == 0 and shared_share(empty).count() == 0
    df = spark.createDataFrame([(1, "q" * 300, "z"), (2, "q" * 300, "z"), (None, "q" * 300, "z")], "doc_id long, text string, rep string")
    assert [tuple(r) for r in shared_span_pairs(df).collect()] == [(1, 2)]
    got = {r["doc_id"]: (r["copies"], r["shared_share"]) for r in shared_share(df).collect() if r["doc_id"]}
    assert got == {1: (1, 1.0), 2: (1, 1.0)}
