import math
import random

from pyspark.sql import functions as F

from docloom.llm.scan_noise import CONFUSIONS, Decoder, Layout, channel, plain, repair, repair_scans, roman, strokes, strokes_of

WORDS = "pre and post the release should be migrated again before lunch without its container parser payload kernel database stapler envelope corridor thermostat".split()


def body(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_channel_and_key():
    pairs = [("5h0uld", "should"), ("dinic", "clinic"), ("rnodulc", "module"), ("bmdmg", "binding"), ("5+r011er", "stroller"), ("l1l1pu+1an", "lilliputian")]
    for seen, true in pairs:
        assert (channel(seen, true) is None) == (seen == "l1l1pu+1an") and (strokes(seen) == strokes(true) or channel(seen, true) is None)
    assert channel("should", "should") == 0.0 and channel("cat", "dog") is None and channel("", "") == 0.0
    assert all(strokes(seen) == strokes(true) for seen, true, _ in CONFUSIONS)


def test_key_of_a_column(spark):
    words = ["5h0uld", "dinic", "ﬁnal", "würde", "m", ""]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", strokes_of(F.col("w")).alias("k")).collect()
    assert all(r["k"] == strokes(r["w"]) for r in got)


def decoder(token, own, readings, pairs):
    found = {token: [(token, 0.0, own), *[(w, math.log(p), n) for w, p, n in readings]]}
    return Decoder(found, pairs, frozenset(), 5, 10_000)


def test_a_right_word_stays():
    pairs = {("the", "modem"): (50, 600), ("modem", "line"): (50, 50)}
    d = decoder("modem", 10, [("modern", 0.01, 200)], pairs)
    assert d.line(["the", "modem", "line"]) == ["the", "modem", "line"]
    assert repair("the modem line", d)[1] == []


def test_context_chooses_the_reading():
    pairs = {("our", "dean"): (1, 900), ("our", "clean"): (40, 900), ("clean", "room"): (60, 200)}
    assert decoder("clcan", 1, [("clean", 0.01, 200), ("dean", 0.01, 300)], pairs).line(["our", "clcan", "room"]) == ["our", "clean", "room"]


def test_headers_come_back():
    page = ["Annual Report of the Harbour Board", "the line goes on and then", "another one follows it here", "and a third one"]
    layout = Layout("\n".join(page * 5))
    assert [i for i, h in enumerate(layout.header) if h] == [0, 4, 8, 12, 16]
    long = "The " + "Very " * 60 + "Long Running Header"
    assert sum(Layout("\n".join([long, *page[1:]] * 3)).header) == 3
    assert not any(Layout("Annual Report of the Harbour Board\nOne sentence.\nAnother sentence.\nA third.\n").header)
    # titles next to each other, or between whole sentences, are none
    assert not any(Layout("Start.\nItem A\nItem A\nWe end.\nItem A\nDone.").header)


def test_roman_page_numbers():
    assert [roman(x) for x in ("xiv", "XC", "v1i", "civil", "mix", "", "Xi", "iiii")] == [14, 90, 7, 0, 1009, 0, 0, 0]
    text = "\n".join(line for n in ("xi", "xii", "xiii") for line in ("a line of the text that", "goes on here and on", "and on", n))
    assert [i for i, p in enumerate(Layout(text).page) if p] == [3, 7, 11]
    assert not any(Layout("mix\nthe two and stir.\nThen wait.").page)


def test_layout():
    text = "Harbour: Review (2019)\np. 7\nthe line goes on and\nanother one follows.\n\x0cHARBOUR: REVIEW (2O19)\np. 8\n1. Notes\nOn 18 Mar 2016\n404\n"
    layout = Layout(text)
    assert [i for i, h in enumerate(layout.header) if h] == [0, 4]
    assert [i for i, p in enumerate(layout.page) if p] == [1, 5]


def test_plain_keeps_offsets():
    text = "Mail A@b.org now İ " + "aBcDeFgH9x" * 5 + " " + "z" * 50 + " end"
    assert len(plain(text)) == len(text) and "@" not in plain(text) and plain(text).endswith("z end") and "9" not in plain(text)


def test_round_trip_of_damage(spark):
    rng = random.Random(7)
    clean = [(i, body(rng, 80) + ".") for i in range(150)]
    words = clean[0][1].split()
    words[5] = "conta1ner" if words[5] != "x" else words[5]
    lines = ["Harbour: Review (2019)   1", " ".join(words[:9]) + " data-", "base " + " ".join(words[9:20]), "HARBOUR: REVIEW (2019)   2", " ".join(words[20:30]) + " pre-", "and post", "end."]
    rows = clean + [(1000, "\n".join(lines)), (1001, None), (1002, ""), (1003, "   "), (1003, "a tidy line"), (None, "no key"), (2**60 + 1, "a long key")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "extract_id long, text string, noise string")
    got = {(r["extract_id"], r["repaired"]): r["noise"] for r in repair_scans(df).collect()}
    text, noise = next((t, n) for (k, t), n in got.items() if k == 1000)
    assert [(n["line_no"], n["noise"]) for n in noise] == [(1, "header"), (2, "chars"), (2, "hyphen"), (4, "header")]
    assert "database" in text and "container" in text and "HARBOUR" not in text and "pre- and post" in text and "\n" not in text
    assert all(got[(k, t)] == [] for k, t in clean[1:])
    assert got[(1001, None)] == [] and got[(1002, "")] == [] and got[(1003, "a tidy line")] == []
    assert got[(None, "no key")] == [] and got[(2**60 + 1, "a long key")] == []
    assert repair_scans(df.limit(0)).count() == 0
