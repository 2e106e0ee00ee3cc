import hashlib

from docloom.plans import text_plans

CARD = "Paid with 4111 1111 1111 1111 at the desk."


def folder(tmp_path, name, df):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_a_card_alone_is_an_identifier(spark, tmp_path):
    rows = [(1, "a", "p/1", 1, CARD), (2, "b", "p/2", 1, CARD.replace("1111 at", "1112 at")), (3, "c", "p/3", 2, "a@example.com"), (4, "d", "p/4", 2, None), (5, "e", "p/5", 2, f"SSN 123-45-6789. {CARD} {CARD}")]
    d = folder(tmp_path, "extract_record", spark.createDataFrame(rows, "extract_id long, doc_id string, rel_path string, owner_id long, text string"))
    got = {r["extract_id"]: (r["severity"], r["has_identifier"]) for r in text_plans.prior_severity(spark, d).collect()}
    assert got == {1: ("high", True), 2: ("low", False), 3: ("medium", True), 4: ("low", False), 5: ("high", True)}
    owners = {(r["owner_id"], r["severity"]): r["texts"] for r in text_plans.prior_severity_by_owner(spark, d).collect()}
    assert owners == {(1, "high"): 1, (1, "low"): 1, (2, "medium"): 1, (2, "low"): 1, (2, "high"): 1}
    cards = {(r["extract_id"], r["n"], r["samples"]) for r in text_plans.prior_samples(spark, d).where("kind = 'credit_card'").collect()}
    assert cards == {(1, 1, "****-****-****-1111"), (5, 2, "****-****-****-1111")}
    assert {(r["extract_id"], r["kinds"]) for r in text_plans.pii_map(spark, d).collect()} == {(1, "credit_card"), (3, "email"), (5, "ssn, credit_card")}


def test_html_of_all_languages(spark, tmp_path):
    texts = {"a": ("en", "One  two."), "b": ("de", "Größe und\nMaß."), "c": ("fr", "L'été <b>chaud</b>."), "d": (None, "Sin idioma."), "e": ("EN", "Upper."), "f": ("eng", ""), "g": ("de", None)}
    d = folder(tmp_path, "documents", spark.createDataFrame([(k, *v) for k, v in texts.items()], "doc_id string, lang string, text string"))
    want = {"a": "One two.", "b": "Größe und Maß.", "c": "L'été chaud .", "d": "Sin idioma.", "e": "Upper.", "f": "", "g": None}
    got = {r["doc_id"]: (r["text_md5"], r["chars"]) for r in text_plans.html_text(spark, d).collect()}
    assert got == {k: (v if v is None else hashlib.md5(v.encode()).hexdigest(), v if v is None else len(v)) for k, v in want.items()}


def test_letters_beyond_ascii_stay_letters(spark, tmp_path):
    texts = ["write to josé@mail.org", "12 Rüden Lane", "é123-45-6789 and 123-45-6789é", "a@b.orgé", "éa.b@x.org", "SSN 123-45-6789, né en 1999é 2001", "Call 212-555-0100 – or (212) 555-0101…", "AB\u00a012345 ÅB 12345"]
    d = folder(tmp_path, "extract_record", spark.createDataFrame([(i, "a", "p", 1, t) for i, t in enumerate(texts)], "extract_id long, doc_id string, rel_path string, owner_id long, text string"))
    got = {(r["extract_id"], r["kind"], r["samples"]) for r in text_plans.prior_samples(spark, d).collect()}
    assert got == {(4, "email", ".***@x.org"), (5, "ssn", "***-**-6789"), (6, "phone", "***-***-0100 | ***-***-0101"), (7, "address", "[st-zip]")}
    duckdb = __import__("duckdb")
    sql = text_plans.oracle_sql()["prior_samples"].replace("FROM extract_record", f"FROM '{d}/extract_record.parquet/*.parquet'")
    assert {(r[0], r[1], r[3]) for r in duckdb.sql(sql).fetchall()} == got
