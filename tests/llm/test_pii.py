import random

import pytest

from docloom.llm.pii import Lexicon, find_values, finder, learn_names, normalise, redact, redact_samples, redact_texts

NAMES = Lexicon(frozenset({"elena", "dana", "marcus"}), frozenset({"oak", "north", "wing", "harrow", "vale", "elm"}))


def values(text):
    return redact(text, finder(NAMES))[1]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Write to a.b+c@mail.example.org, please.", [("email", "a.b+c@mail.example.org")]),
        ("(dana at example dot org)", [("email", "dana at example dot org")]),
        ("x_y [at] office [dot] mail\n[dot] test", [("email", "x_y [at] office [dot] mail [dot] test")]),
        ("joe(at)example.com now", [("email", "joe(at)example.com")]),
        ("ask @desk about 5 @ 3.50", []),
        ("Call (312) 555-0140 ext. 517 soon", [("phone", "(312) 555-0140 ext. 517")]),
        ("+44 20 7946 0803 or 01 99 00 55 20", [("phone", "+44 20 7946 0803"), ("phone", "01 99 00 55 20")]),
        ("Order no. 009314472; batch 4471 0093 2218; ticket 20230-114; part 412-07-3391B", []),
        ("SSN: 000-40-5076\n5. Next", [("id_number", "000-40-5076")]),
        ("Steuer-ID 00 662 279 365 340 veces", [("id_number", "00 662 279 365")]),
        ("passport no. X0332189, DNI 00095198X", [("id_number", "X0332189"), ("id_number", "00095198X")]),
        ("She moved to 12 Oak Lane, Apt 3B, Elm City, OH 00123-4567 in May.", [("address", "12 Oak Lane, Apt 3B, Elm City, OH 00123-4567")]),
        ("Ulmenstraße 13, 00266 Norden | PO Box 77", [("address", "Ulmenstraße 13, 00266 Norden"), ("address", "PO Box 77")]),
        ("On 18 Mar 2016 the court had met. It has 12 Way points.", []),
        ("Dear Mrs. Oakley, the forms", [("name", "Oakley")]),
        ("Spoke with OAKLEY, Elena about it. Use the Clara setting.", [("name", "OAKLEY, Elena")]),
        ("Recipient: j. m. nobody", []),
        ("Recipient: elena van oakley; 3 boxes", [("name", "elena van oakley")]),
    ],
)
def test_values(text, expected):
    assert values(text) == expected


def test_placeholders_keep_the_rest():
    out, found = redact("Call 212-555-0100  after\tnine, Elena Oakley.", finder(NAMES))
    assert out == "Call [PHONE]  after\tnine, [NAME]." and len(found) == 2


def test_look_alikes_and_spelled_digits_map_back():
    text = "write tо jоe@ехample.com or call two one two five five five oh one zero zero now"
    out, found = redact(text, finder(NAMES))
    assert ("email", "jоe@ехample.com") in found
    assert ("phone", "two one two five five five oh one zero zero") in found
    assert out == "write tо [EMAIL] or call [PHONE] now"


def test_offsets_of_the_normalised_text():
    rng = random.Random(4)
    for _ in range(200):
        parts = [rng.choice(["plain words ", "a at b dot org ", "k [at] x [dot] test ", "one two three four five six seven eight "]) for _ in range(5)]
        text = "".join(parts)
        norm, back = normalise(text)
        spots = [back(i) for i in range(len(norm))]
        assert spots == sorted(spots) and all(0 <= s < len(text) for s in spots)
        assert all(norm[i] == text[s] for i, s in enumerate(spots) if norm[i] not in "@.0123456789" and norm[i].isalpha())


def test_operators(spark):
    rows = [(1, "mail a@b.org a@b.org", "x"), (1, "mail a@b.org", "x"), (2, None, "x"), (3, "", "x"), (4, "z" * 300_000, "x"), (None, "mail a@b.org", "x")]
    df = spark.createDataFrame(rows, "extract_id long, text string, found string")
    got = {(r["extract_id"], r["redacted"]) for r in redact_texts(df.where("extract_id < 4 OR extract_id IS NULL"), "extract_id", "text").collect()}
    assert got == {(1, "mail [EMAIL] [EMAIL]"), (1, "mail [EMAIL]"), (2, None), (3, ""), (None, "mail [EMAIL]")}
    found = [tuple(r) for r in find_values(df, "extract_id", "text").collect()]
    assert found == [("1", "email", "a@b.org")] * 2
    assert find_values(df.limit(0), "extract_id", "text").count() == 0


def test_samples(spark):
    kind = "doc_id string, priors map<string,struct<count:int,redacted_samples:array<string>>>"
    rows = [("a", {"email": (2, ["tel 212-555-0100", None, "x***@b.org"]), "dob": None}), ("b", None), ("c", {})]
    got = {r["doc_id"]: r["priors"] for r in redact_samples(spark.createDataFrame(rows, kind)).collect()}
    assert got["a"]["email"]["redacted_samples"] == ["tel [PHONE]", None, "x***@b.org"] and got["a"]["email"]["count"] == 2
    assert got["a"]["dob"] is None and got["b"] is None and got["c"] == {}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Our caretaker, Siobhan Gallagher, left on Monday.", [("name", "Siobhan Gallagher")]),
        ("Attn: Bartholomew Quigley", [("name", "Bartholomew Quigley")]),
        ("Please ask Ingeborg Thorvaldsen about the lease.", [("name", "Ingeborg Thorvaldsen")]),
        ("Please ask North Wing about it; our depot, Harrow Vale, is closed.", []),
        ("reach me: john dot smith at example dot com", [("email", "john dot smith at example dot com")]),
        ("jane {at} example.org, jane ( at ) example.org", [("email", "jane {at} example.org"), ("email", "jane ( at ) example.org")]),
        ("12 rue Victor Hugo, 75001 Paris", [("address", "12 rue Victor Hugo, 75001 Paris")]),
        ("Lindenweg\n5", [("address", "Lindenweg 5")]),
        ("call six six two six six two nine nine one two", [("phone", "six six two six six two nine nine one two")]),
        ("a" * 120 + "@example.org", [("email", "a" * 120 + "@example.org")]),
        ("They left.\nMarcus\nOakley | 212.555.0117", [("name", "Marcus Oakley"), ("phone", "212.555.0117")]),
        ("near Elm.\nA.\nOakley will pick up the box", [("name", "A. Oakley")]),
        ("Marcus-Hugo-Staff-Test Marcus Oakley | 212.555.0117", [("name", "Marcus Oakley"), ("phone", "212.555.0117")]),
    ],
)
def test_values_beyond_lists(text, expected):
    assert values(text) == expected


def test_names_are_learned(spark):
    people = ["Zyta Borkowska", "Zyta Ahlgren", "Zyta Quist", "Zyta Lund"]
    texts = [f"Dear {p}, the Quill Moor forms are here." for p in people] + ["The box went to Quill Moor with Zyta Vennerholm on Friday."] * 40 + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "extract_id long, text string")
    lexicon = learn_names(df)
    assert "zyta" not in lexicon.others and {"quill", "moor"} <= lexicon.others
    assert lexicon == learn_names(df, share=0.05)._replace(given=lexicon.given)
    lexicon = learn_names(df, share=0.05)
    assert lexicon.given == {"zyta"}
    assert redact("Later Zyta Vennerholm saw Quill Moor.", finder(lexicon))[0] == "Later [NAME] saw Quill Moor."
    assert learn_names(df.limit(0)) == Lexicon()
