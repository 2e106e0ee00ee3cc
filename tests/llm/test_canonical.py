import random
import string

import pytest

from docloom.llm.canonical import CanonicalMatcher, _Name, _plain, learn_aliases, map_to_canonical

PLAN = [(1, "staffing", "Staffing"), (2, "field-work", "Field work"), (3, "grant-claims", "Grant claims"), (4, "grants", "Grants"), (5, "risk-sheets", "Risk sheets"), (6, "systems", "Systems")]


@pytest.mark.parametrize(
    ("value", "plan_id"),
    [
        ("STAFFING", 1), (" staffing ", 1), ("Stsffing", 1), ("stffng", 1), ("staff.", 1), ("HR", 1), ("copy of staffing (old)", 1), ("1.2 Staffing", 1), ("5taff1ng", 1),
        ("field_work", 2), ("Fiedl Wok", 2), ("out in the field", 2), ("claims grant", 3), ("grant claims - final", 3), ("my grants", 4), ("risk.", 5), ("IT", 6), ("it was nice", 0),
        ("glaciers", 0), ("bokonli", 0), ("???", 0), ("misc", 0), ("new folder (2)", 0), ("x" * 5000, 0), ("🙂", 0),
    ],
)
def test_values(value, plan_id):
    assert CanonicalMatcher(PLAN, [(1, "HR"), (2, "out in the field"), (6, "IT")])(value) == plan_id


def test_longest_mention_wins():
    assert CanonicalMatcher(PLAN)("the grant claims folder") == 3


def test_cache_is_bounded():
    m = CanonicalMatcher(PLAN, remembered=3)
    for i in range(10):
        m(f"value {i}")
    assert len(m.cache) <= 3


def test_operator(spark):
    plan = spark.createDataFrame(PLAN, "plan_id int, plan_name string, title string")
    df = spark.createDataFrame([(1, "Stafing", "k"), (2, None, "k"), (3, "  ", "k"), (4, "volcanoes", "k"), (4, "volcanoes", "k")], "walk_id long, v string, plan_name string")
    got = sorted((r["walk_id"], r["plan_id"]) for r in map_to_canonical(df, "v", plan).collect() if r["plan_id"] is not None)
    assert got == [(1, 1), (4, 0), (4, 0)]
    assert map_to_canonical(df.limit(0), "v", plan).count() == 0


CITIES = [(1, "New York City", None), (2, "Los Angeles", None), (3, "Mexico City", None), (4, "Saint-Étienne", None), (5, "Zürich", None), (6, "Newcastle upon Tyne", None), (7, "York", None)]


@pytest.mark.parametrize(
    ("value", "plan_id"),
    [("York New city", 1), ("new  york ctiy", 1), ("Angeles, Los", 2), ("LOS ANGLES", 2), ("st etienne", 4), ("saint etiene", 4), ("ZURICH", 5), ("Zuerich", 5), ("New castle upon tyne", 6), ("Paris", 0), ("yrok", 7)],
)
def test_another_plan(value, plan_id):
    assert CanonicalMatcher([(a, b, c or b) for a, b, c in CITIES])(value) == plan_id


def _distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_bit_parallel_distance():
    r = random.Random(5)
    for _ in range(600):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert _Name(a).distance(b) == _distance(a, b), (a, b)


def test_index_finds_what_a_loop_finds():
    r = random.Random(6)
    names = ["".join(r.choice(string.ascii_lowercase[:9]) for _ in range(r.randint(4, 11))) for _ in range(60)]
    m = CanonicalMatcher([(i + 1, n, n) for i, n in enumerate(names)])
    for _ in range(400):
        value = list(r.choice(names))
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(value))
            value[k : k + r.randint(0, 1)] = r.choice(string.ascii_lowercase[:9])
        value = "".join(value)
        scores = sorted(((f.close(value), i) for f, i in zip(m.forms, m.ids)), reverse=True)
        want = scores[0][1] if scores[0][0] >= m.least and scores[0][0] > scores[1][0] else 0
        assert m.similar(_plain(value), False) in (want, m.skeletons.get(m._skeleton(value)), m.joined.get(value)), value


def test_learned_aliases(spark):
    plan = spark.createDataFrame(
        [(1, None, "money", "Money"), (2, None, "tools", "Tools"), (3, 1, "bills", "Bills"), (4, 3, "late-bills", "Late bills"), (5, 2, "saws", "Saws")], "plan_id int, parent_id int, plan_name string, title string"
    )
    rows = [(["Zaster", "bills"], "money")] * 4 + [(["money", "Factures", "late-bills"], None)] * 3 + [(["junk", None], "money"), (["junk"], "tools"), (["junk", "saws"], ""), (None, None), ([], "x")] * 3
    rows += [(["rare", "saws"], "tools")] * 2
    paths = spark.createDataFrame(rows, "home array<string>, main string")
    assert sorted(tuple(r) for r in learn_aliases(paths, plan).collect() if r["alias"] not in ("money", "tools", "bills")) == [(1, "zaster"), (3, "factures")]
    assert learn_aliases(paths.limit(0), plan).count() == 0
    assert map_to_canonical(spark.createDataFrame([("zaster (old)",), ("factures",)], "v string"), "v", plan, learn_aliases(paths, plan)).select("plan_id").collect() == [(1,), (3,)]
