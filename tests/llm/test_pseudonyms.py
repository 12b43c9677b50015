import re
from datetime import date

from leadlake.llm import pseudonyms as ps

from . import tables

KEY = "key of these tests"
VALID = ["und.34@mail7.example.com", "+1 (017) 555-7713", "4845168114407329", "4845 1681 1440 7329", "97.51.17.173",
         "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "123-45-6789", "2024-02-29", "31.12.1999", "12/31/1999",
         "04dbebab91ab85687d33eeaaf9ac699e1188f962", "555-123-4567", "+44 20 7946 0958"]
INVALID = ["4845168114407328", "300.1.1.1", "DE88 3704 0044 0532 0130 00", "666-12-1234", "2023-02-29", "1234567", "3.14", "12:30", "no1"]


def shape(s):
    return re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", s))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d)) % 10 == 0


def replaced(spark, values, key=KEY):
    df = spark.createDataFrame([(k, f"«{v}», then {v} end") for k, v in enumerate(values)], "doc_id long, text string")
    return [r.text for r in ps.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_values_change_within_their_format_and_stay_linked(spark):
    for v, t in zip(VALID, replaced(spark, VALID)):
        a, b = re.match("«(.*)», then (.*) end$", t).groups()
        assert a == b != v, v
        if v != "97.51.17.173":
            assert len(a) == len(v)
            if "@" not in v and len(v) < 40:
                assert shape(a) == shape(v)
    new = dict(zip(VALID, (re.match("«(.*)»,", t).group(1) for t in replaced(spark, VALID))))
    assert luhn(new["4845168114407329"])
    assert new["4845 1681 1440 7329"].replace(" ", "") == new["4845168114407329"]
    for v in ("DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"):
        s = new[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    assert all(0 <= int(x) <= 255 for x in new["97.51.17.173"].split("."))
    date.fromisoformat(new["2024-02-29"])
    assert new["und.34@mail7.example.com"].endswith("@mail7.example.com")


def test_invalid_values_stay(spark):
    assert replaced(spark, INVALID) == [f"«{v}», then {v} end" for v in INVALID]


def test_values_beside_words_and_numbers(spark):
    cases = [("", "ES91 2100 0418 4502 0005 1332", " BIC CAIXESBB"), ("", "AT61 1904 3002 3457 3201", " EUR"), ("exp 2027 ", "4111 1111 1111 1111", ""),
             ("2025 2026 2027 ", "4111 1111 1111 1111", " \ue000\ue001\ue0010"), ("tel ", "+33 1 42 68 53 00", ""), ("tel ", "+61 2 9374 4000", " at 12")]
    df = spark.createDataFrame([(k, "".join(c)) for k, c in enumerate(cases)], "doc_id long, text string")
    for (a, v, b), r in zip(cases, ps.pseudonymise(df, KEY).orderBy("doc_id").collect(), strict=True):
        assert r.n_replaced == 1 and r.text.startswith(a) and r.text.endswith(b), r
        got = r.text[len(a):len(r.text) - len(b)]
        assert got != v and shape(got) == shape(v)


def test_another_key_gives_other_pseudonyms(spark):
    assert not set(replaced(spark, VALID, "a")) & set(replaced(spark, VALID, "b"))


def test_permutations_are_one_to_one(spark):
    dates = spark.range(36524).selectExpr("id AS doc_id", "CAST(date_add(date'1950-01-01', CAST(id AS INT)) AS STRING) AS text")
    assert ps.pseudonymise(dates, KEY).select("text").distinct().count() == 36524
    phones = spark.range(5000).selectExpr("id AS doc_id", "concat('555-123-', lpad(CAST(id AS STRING), 4, '0')) AS text")
    assert ps.pseudonymise(phones, KEY).select("text").distinct().count() == 5000
    ssn = spark.range(1, 5000).selectExpr("id AS doc_id", "concat('665-99-', lpad(CAST(id AS STRING), 4, '0')) AS text")
    rows = [r.text for r in ps.pseudonymise(ssn, KEY).collect()]
    assert len(set(rows)) == 4999 and not any(r.startswith(("000", "666", "9")) for r in rows)


def test_awkward_rows(spark):
    got = {r.doc_id: r for r in ps.pseudonymise(tables.awkward(spark), KEY).collect()}
    assert len(ps.pseudonymise(tables.awkward(spark), KEY).collect()) == len(tables.rows())
    assert got[4].text is None and got[5].text == "" and got[1].text == tables.STORY and got[18].n_replaced == 0
    assert tables.plain(ps.pseudonymise(tables.none(spark), KEY)) == []


def test_plan_is_native(spark, sf_small):
    plan = ps.op5_pseudonyms(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_runs_do_not_exhaust_the_stack(spark):
    n = 100_000
    texts = ["a@" + "b." * n + "com", "a@" + "bb." * n + "com end", "x" * n + "@" + "y-" * n, "1 " * n, "+1" + " 22" * n, "DE89 " + "3704 " * n, "1." * n, "a." * n + "@b.com"]
    df = spark.createDataFrame(list(enumerate(texts[:3] + texts[6:])), "doc_id long, text string")
    got = ps.pseudonymise(df, KEY).collect()
    assert len(got) == 5 and all(len(r.text) > n for r in got)


def test_every_document_against_plain_python(spark):
    """The registered query over whole texts, value by value; and values that stand beside one another."""
    from leadlake.llm.pseudonyms import op5_pseudonyms, pseudonymise

    from . import plain_pseudonyms
    key = "key of the test query"
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op5_pseudonyms(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_replaced for r in rows) > 50
    for r in rows:
        assert (r.text, r.n_replaced) == plain_pseudonyms.pseudonymised(texts[r.doc_id], key), r.doc_id
    beside = ["exp 2027 4111 1111 1111 1111, ES91 2100 0418 4502 0005 1332 BIC X", "10.0.0.256 10.0.0.25 999-12-3456 219-09-9999",
              "31/12/1999 12/31/1999 1.2.2003 31.02.2000 2024-02-29 2023-02-29 1899-12-31", "+33 1 42 68 53 00 or (212) 555-0100, a.b+c@x.example",
              "deadbeef00112233445566778899aabb DEADBEEF00112233445566778899AABB " + "a" * 32, "GB82 WEST 1234 5698 7654 32 4111111111111112"]
    df = spark.createDataFrame(list(enumerate(beside)), "doc_id long, text string")
    for r in pseudonymise(df, "k").collect():
        assert (r.text, r.n_replaced) == plain_pseudonyms.pseudonymised(beside[r.doc_id], "k"), beside[r.doc_id]
