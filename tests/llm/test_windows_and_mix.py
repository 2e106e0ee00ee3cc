import os
import random
from collections import defaultdict

import numpy as np
import pytest

from docloom.llm.mixing import mix_report, mix_sources, sainte_lague, shard_seats
from docloom.llm.packing import fill_windows, pack, window_fill
from docloom.llm.tokens import VOCABULARY, encoder, token_ids, token_sizes

needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer file")


def test_pack_respects_capacity_and_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 900, 3000)
    bins = pack(sizes, 2048, 1.0)
    loads = np.bincount(bins, weights=sizes)
    assert loads.max() <= 2048
    assert loads.sum() / (len(loads) * 2048) > 0.985


def brute_quotients(weights, seats):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        out[max(sorted(weights), key=lambda n: weights[n] / (2 * out[n] + 1))] += 1
    return out


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 999])
def test_apportionment_equals_highest_quotients(seats):
    rng = random.Random(seats)
    weights = {c: rng.random() for c in "abcdefgh"}
    assert sainte_lague(weights, seats) == brute_quotients(weights, seats)


def test_apportionment_edges():
    assert sainte_lague({}, 5) == {} and sainte_lague({"a": 0.0}, 5) == {"a": 0}
    assert sainte_lague({"b": 1.0, "a": 1.0}, 1) == {"a": 1, "b": 0}


@needs_vocabulary
def test_long_texts_in_blocks_are_the_same_tokens():
    text = "Some words, numbers 12345 and  double  spaces.\n\nLines; é ü " * 60
    assert token_ids(text, block=200) == encoder().encode_ordinary(text)


@needs_vocabulary
@pytest.mark.parametrize("text", ["word" * 400 + "! " + "x1" * 900, "  \t  " * 300, "12345" * 300, "it's we'll 'tis" * 120, "naïve e\u0301te\u0301 " * 150, "a" * 2000, "日本語です。" * 200])
def test_blocks_of_any_text_are_the_same_tokens(text):
    assert token_ids(text, block=64) == encoder().encode_ordinary(text)


@pytest.mark.parametrize("seed", range(6))
def test_shard_seats_equal_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for source in ("a", "b"):
        held = {i: rng.choice([1, 7, 50, 100, 100, 5000]) + seed for i in range(rng.randrange(1, 40))}
        blocks = rng.choice([0, 1, 13, 400, 5000])
        rows += [(source, i, h, blocks) for i, h in held.items()]
        seats = dict.fromkeys(held, 0)
        for _ in range(blocks):
            seats[max(sorted(held), key=lambda n: held[n] / (2 * seats[n] + 1))] += 1
        want |= {(source, i): n for i, n in seats.items()}
    got = shard_seats(spark.createDataFrame(rows, "source string, shard int, held long, blocks long"))
    assert {(r["source"], r["shard"]): r["seats"] for r in got.collect()} == want


@needs_vocabulary
def test_windows_hold_every_token_once(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "a", "longer word"]) for _ in range(rng.randrange(0, 300))), "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "big " * 1500, "x"), (5, "twice", "x"), (None, "no key", "x"), (2**60 + 1, "a long key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, window string")
    got = fill_windows(df, capacity=256, shard_tokens=4096).collect()
    size, pieces, slots = defaultdict(int), defaultdict(list), defaultdict(list)
    for r in got:
        size[r["shard"], r["window"]] += r["n_tokens"]
        slots[r["shard"], r["window"]].append(r["slot"])
        pieces[r["doc_id"]].append((r["token_from"], r["n_tokens"]))
    assert max(size.values()) <= 256 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(size.values()) == sum(len(token_ids(t)) for _, t, _ in rows if t)
    for i, t, _ in rows:
        n = len(token_ids(t)) if t else 0
        if i != 5 and n:
            assert sorted(pieces[i]) == [(k, min(256, n - k)) for k in range(0, n, 256)]
    assert 100 not in pieces and 101 not in pieces
    assert window_fill(fill_windows(df, capacity=256, shard_tokens=4096), 256).count() == len({r["shard"] for r in got})
    assert fill_windows(df.limit(0)).count() == 0


TARGETS = [("big", 0.5, 1), ("small-one", 0.3, 3), ("other", 0.2, 2), ("absent", 0.1, 1), (None, 0.1, 1)]


@needs_vocabulary
def test_mixture_reaches_shares_within_caps(spark):
    rng = random.Random(8)
    source = ["big", "Small_One", " other", None, "unknown"]
    rows = [(i, "word " * rng.randrange(5, 80), rng.choices(source, [6, 1, 2, 1, 1])[0]) for i in range(900)] + [(1000, None, "big"), (1001, "", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture = mix_sources(df, targets, block_tokens=64, shard_tokens=4000).cache()
    assert all(r["uses"] <= {"big": 1, "small-one": 3, "other": 2}[r["source"]] for r in mixture.collect())
    report = {r["source"]: r for r in mix_report(mixture, targets).collect()}
    for s, share in (("big", 0.5), ("small-one", 0.3), ("other", 0.2)):
        assert abs(report[s]["actual_share"] - share) < 0.03
    assert report["absent"]["tokens"] == 0
    again = mix_sources(df, targets, block_tokens=64, shard_tokens=4000)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixture.collect()))
    assert mix_sources(df.limit(0), targets).count() == 0


@needs_vocabulary
def test_sizes(spark):
    df = spark.createDataFrame([(1, "one two", "s"), (2, None, "s"), (3, "", "s")], "doc_id long, text string, n_tokens string")
    assert {(r["doc_id"], r["n_tokens"]) for r in token_sizes(df).collect()} == {(1, 2), (2, 0), (3, 0)}
