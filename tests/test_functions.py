from pyspark.sql import functions as F

from docloom.functions import priors as P
from docloom.functions import terms as T
from docloom.functions import textops as X
from docloom.functions.modelio import capped_terms, closed_terms, parse_model_json


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def scan(spark, text):
    return one(spark, P.as_map(P.scan(F.col("t"))), t=text)


def test_formatted_number_is_masked(spark):
    found = scan(spark, "Employee SSN: 123-45-6789 on the leftover packet.")
    assert found["ssn"]["count"] == 1 and found["ssn"]["redacted_samples"] == ["***-**-6789"]


def test_card_needs_luhn(spark):
    assert scan(spark, "card 4111 1111 1111 1111")["credit_card"]["redacted_samples"] == ["****-****-****-1111"]
    assert "credit_card" not in scan(spark, "card 4111111111111112")


def test_email_phone_dob_address(spark):
    found = scan(spark, "x.y@example.com, (212) 555-0100, born 1/2/1980, 12 Oak Street, PO Box 7, TX 75201")
    assert found["email"]["redacted_samples"] == ["x***@example.com"]
    assert found["phone"]["redacted_samples"] == ["***-***-0100"]
    assert found["dob"]["count"] == 1
    assert found["address"]["redacted_samples"] == ["[street]", "[po-box]", "[st-zip]"]


def test_seven_digits_are_no_phone(spark):
    assert "phone" not in scan(spark, "call 555-0100")


def test_samples_are_first_five_distinct(spark):
    found = scan(spark, " ".join(f"a{i}@x{i}.org" for i in (1, 1, 2, 3, 4, 5, 6)))
    assert found["email"]["count"] == 7 and len(found["email"]["redacted_samples"]) == 5


def test_null_and_empty_text(spark):
    assert scan(spark, None) == {} and scan(spark, "") == {}


def test_letters_beyond_ascii_hold_no_border(spark):
    assert "ssn" not in scan(spark, "é123-45-6789")


def test_nine_digits_need_a_word_in_the_window(spark):
    near = one(spark, P.windowed_nine_digits(F.col("t")), t="social security number 123456789 is listed below")
    far = one(spark, P.windowed_nine_digits(F.col("t")), t="ssn " + "x " * 60 + "123456789")
    assert near == ["*****-6789"] and far == []


def test_filename_tags(spark):
    assert one(spark, P.filename_tags(F.col("t")), t="personal/2023-W2-john.pdf") == ["tax_financial", "personal_correspondence"]
    assert one(spark, P.filename_tags(F.col("t")), t="a/old_w2_x.pdf") == []


def test_severity(spark):
    assert [one(spark, P.severity(F.col("k")), k=k) for k in (["ssn"], ["email"], [])] == ["high", "medium", "low"]


def test_kebab_and_tokens(spark):
    assert one(spark, T.kebab(F.col("t")), t="  Field_Work & Co ") == "field-work-co"
    assert one(spark, T.content_tokens(F.col("t")), t="curriculum_administration") == ["admin", "curriculum"]
    assert one(spark, T.content_tokens(F.col("t")), t="the-form") == ["the-form"]
    assert one(spark, T.match_tokens(F.col("t")), t="the_form") == []


def test_heads(spark):
    assert one(spark, T.is_banned_head(F.col("t")), t="usenet-1993") is True
    assert one(spark, T.is_banned_head(F.col("t")), t="2019") is True
    assert one(spark, T.is_banned_head(F.col("t")), t="budget-2019") is False
    assert one(spark, T.is_vague(F.col("t")), t="misc") is True


def test_html_and_rtf(spark):
    page = "<html><script>a<b</script><p>One &amp; two</p>\n<style>p{}</style></html>"
    assert one(spark, X.strip_html(F.col("t")), t=page) == "One &amp; two"
    assert one(spark, X.strip_rtf(F.col("t")), t=r"{\rtf1\b0 Hi}").strip() == "Hi"


def test_paths_and_titles(spark):
    assert one(spark, X.bare_stem(F.col("t")), t="a/b (SECURED).pdf.docx") == "b"
    assert one(spark, X.collapse_spaced_title(F.col("t")), t="T I T L E here") == "TITLE here"
    assert one(spark, X.redact_snippet(F.col("t")), t="a 123-45-6789\n b@c.org") == "a ***-**-6789 b***@c.org"


def test_snippets(spark):
    got = one(spark, X.keyword_snippets(F.col("t"), "key", radius=3, most=2), t="aaaaakeybbbb key cc key")
    assert got == ["aaakeybbb", "bb key cc"]


def test_model_json_forms(spark):
    for text in ('{"a": 1}', '```json\n{"a": 1}\n```', 'Sure. {"a": 1,} Bye', '{"a": 1, // note\n}'):
        assert one(spark, F.try_variant_get(parse_model_json(F.col("t")), "$.a", "int"), t=text) == 1, text
    for text in ("[1]", "no", None, ""):
        assert one(spark, parse_model_json(F.col("t")).isNull(), t=text) is True


def test_term_coercion(spark):
    allowed = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    assert one(spark, closed_terms(F.col("v"), allowed), v=["x", "b", "b", "a", "c"]) == ["b", "a"]
    assert one(spark, closed_terms(F.col("v"), allowed), v=["x"]) == ["unmapped"]
    assert one(spark, capped_terms(F.col("v"), 2), v=[" A ", "a", None, "", "B", "C"]) == ["A", "B"]


def test_people_in_file_names_and_folios(spark):
    from docloom.functions.textops import names_in_filename
    from docloom.operators.search import people_in

    names = {
        "a/A Goodlake Travel 2025.pdf": ["A Goodlake"],
        "L. Munoz-Reyes Trip.docx": ["L. Munoz-Reyes"],
        "C.Sealy- certified.pdf": ["C.Sealy"],
        "Jeremy Spruce_Next.pdf": ["Jeremy Spruce"],
        "Best practices - JS.pdf": ["JS"],
        "Badge-Demarest.png": ["Demarest"],
        "Becker Mileage.xlsx": ["Becker"],
        "Spruce-Taxi-May.pdf": ["Spruce"],
        "agenda.pdf": [],
    }
    df = spark.createDataFrame([(k,) for k in names], "p string")
    got = {r["p"]: r["n"] for r in df.select("p", names_in_filename(F.col("p")).alias("n")).collect()}
    assert {k: v[: len(names[k])] for k, v in got.items()} == names and got["agenda.pdf"] == []
    texts = {"Recipient: Ada Moss and Recipient: ADA MOSS": ["Ada Moss"], "SPRUCE/J  room 4\nNAME": ["J. Spruce"], "SPRUCE/J" + " " * 60 + "NAME": [], "": []}
    df = spark.createDataFrame([(k,) for k in texts], "t string")
    assert {r["t"]: r["n"] for r in df.select("t", people_in(F.col("t")).alias("n")).collect()} == texts


def test_main_choices_and_labels(spark):
    from docloom.functions.coercion import age, bar, main_choice, ring_label, short_count

    long = "a text that is long enough to be filed somewhere"
    rows = [("Budget", None, long, ("budget", "")), ("unmapped", "no content here", long, ("unmapped", "no content here")), ("unmapped", "hm", long, ("", "")), ("budget", "x", "  ", ("", "extract missing")), ("other", "x", long, ("", "")), (None, None, long, ("", ""))]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, m string, r string, t string")
    got = {r["i"]: tuple(r["c"]) for r in df.select("i", main_choice(F.col("m"), F.col("r"), F.col("t"), ["budget"]).alias("c")).collect()}
    assert got == {i: r[3] for i, r in enumerate(rows)}
    labels = {"copy of the_FERPA-plan 2023": "FERPA Plan", "re: re: budget": "Budget", "a very long name of a folder that goes on": "Very Long Name Of A Folder"}
    df = spark.createDataFrame([(k,) for k in labels], "t string")
    assert {r["t"]: r["l"] for r in df.select("t", ring_label(F.col("t")).alias("l")).collect()} == labels
    n = spark.createDataFrame([(950,), (1234,), (3_400_000,), (0,)], "n long")
    assert [r[0] for r in n.select(short_count(F.col("n"))).collect()] == ["950", "1.2k", "3.4M", "0"]
    assert [r[0] for r in n.select(age(F.col("n"))).collect()] == ["15m", "20m", "39d", "0s"]
    assert n.select(bar(F.lit(5), F.lit(10), 4)).first()[0] == "##--"
