import random

import pytest

from docloom.llm.splitting import boundaries, split_oversized, split_text


def check(text, pieces, most, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c < b < d
        assert abs(b - c - overlap) <= 150 + 1
    assert all(0 < b - a <= most for a, b in pieces)


@pytest.mark.parametrize("kind", ["prose", "none", "lines", "accents"])
def test_cover_and_bounds(kind):
    rng = random.Random(3)
    text = {
        "prose": " ".join(rng.choice(["One two.", "Three, four", "five?", "six"]) for _ in range(9000)),
        "none": "x" * 45_001,
        "lines": "\n".join("word " * rng.randrange(1, 30) for _ in range(900)),
        "accents": "é" * 12_001,
    }[kind]
    check(text, split_text(text), 10_000, 400)


def test_cuts_fall_on_natural_breaks():
    text = "\n\n".join("This is a sentence. " * 20 for _ in range(60))
    pieces = split_text(text)
    assert all(text[b - 2 : b] == "\n\n" for _, b in pieces[:-1])
    assert all(a == 0 or text[a - 1].isspace() for a, _ in pieces)


def test_minimum_over_all_boundary_sets():
    text = "aa. bb cc. dd, ee ff. gg hh ii. jj kk. ll mm nn. oo pp" * 20
    pos, pen = boundaries(text, spacing=4)
    got = split_text(text, max_len=500, overlap=40, slack=15)
    check(text, got, 500, 40)
    assert sum(pen[list(pos).index(b)] for _, b in got) <= 0.3 * len(got)


def test_operator_edges(spark):
    rows = [(1, "y" * 12_001, "k"), (1, "y" * 12_001, "k"), (2, "y" * 12_000, "k"), (3, None, "k"), (4, "", "k"), (None, "y" * 12_001, "k"), (2**60 + 1, "y" * 12_001, "k")]
    df = spark.createDataFrame(rows, "extract_id long, text string, piece string")
    got = split_oversized(df).collect()
    assert {r["extract_id"] for r in got} == {1, None, 2**60 + 1} and len(got) == 8
    assert all(r["piece"] == "y" * (r["end"] - r["start"]) for r in got)
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, overlap=9_000)
