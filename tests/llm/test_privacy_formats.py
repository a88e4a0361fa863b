"""Personal data in running text: whatever mark ends it, and telephone numbers in all their groupings."""

import datetime
import re

import pytest

from stratograph.llm import privacy

VALUES = {
    "email": ["bob@example.com", "und.34@mail7.example.co.uk"],
    "secret": ["04dbebab91ab85687d33eeaaf9ac699e1188f962"],
    "ip": ["97.51.17.173"],
    "ssn": ["123-45-6789"],
    "card": ["4111111111111111", "5500 0000 0000 0004", "3782 822463 10005", "3782-822463-10005"],
    "date": ["1984-02-29", "01.12.1999", "12/31/2050", "31/12/1999", "2024-1-5", "5.1.2024", "1/5/2024"],
    "phone": ["1-800-555-1234", "1 (800) 555-1234", "(555)123-4567", "(555) 123-4567", "555-123-4567", "555.123.4567", "1.800.555.1234", "+1 (017) 555-7713"]
    + ["+491701234567", "+49 170 1234567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+33.1.23.45.67.89", "+49 (0)170 1234567"],
}
ENDS = ["", ".", ". Then", "...", ",", ")", "]", ";", "?", " and"]


def replaced(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in privacy.pseudonymize(rows, "k").orderBy("doc_id").collect()]


@pytest.fixture(scope="module")
def new(spark):
    cases = [(v, e) for values in VALUES.values() for v in values for e in ENDS]
    return dict(zip(cases, replaced(spark, [f"see ({v}{e}" for v, e in cases])))


@pytest.mark.parametrize("kind", VALUES)
def test_any_mark_may_end_a_value(new, kind):
    for v in VALUES[kind]:
        alone = new[v, ""]
        assert v not in alone, v
        assert {new[v, e] for e in ENDS} == {alone + e for e in ENDS}, v


def test_telephone_numbers_keep_their_form(new):
    for v in VALUES["phone"]:
        assert re.sub(r"\d", "0", new[v, ""]) == re.sub(r"\d", "0", f"see ({v}")
    digits = lambda v: re.sub(r"\D", "", new[v, ""])
    assert digits("+491701234567") == digits("+49 170 1234567") and digits("+491701234567").startswith("49")
    assert digits("1-800-555-1234") == digits("1.800.555.1234") and digits("1-800-555-1234").startswith("1")
    assert digits("(555)123-4567") == digits("555.123.4567") == digits("555-123-4567")


def test_after_an_ellipsis_and_what_stays(spark):
    assert "bob@" not in replaced(spark, ["...bob@example.com."])[0]
    stays = ["+3.14159265", "1.800.555", "555.123.456", "12345-678-9012", "5551234567", "a@b", "bob@example.", "+12345", "version 2.0.", "v1.555.123.4567.8"]
    assert replaced(spark, stays) == stays


def test_dates_are_one_value_in_all_forms(spark):
    iso, short, time, dots, slash = replaced(spark, ["2024-01-05", "2024-1-5", "2024-01-05T10:00:00Z", "05.01.2024", "01/05/2024"])
    year, month, day = iso.split("-")
    assert iso != "2024-01-05" and time == iso + "T10:00:00Z" and short == f"{year}-{int(month)}-{int(day)}"
    assert dots == f"{day}.{month}.{year}" and slash == f"{month}/{day}/{year}"
    assert replaced(spark, ["99/99/1999", "2024-13-45", "31/02/1999", "0-1-5"]) == ["99/99/1999", "2024-13-45", "31/02/1999", "0-1-5"]


def test_dates_with_the_day_first_are_permuted_among_themselves(spark):
    days = spark.sql("SELECT id AS doc_id, date_format(date_add(date'1990-01-01', CAST(id AS INT)), 'dd/MM/yyyy') AS text FROM range(1500)")
    days = days.filter("CAST(left(text, 2) AS INT) > 12")
    new = [r["text"] for r in privacy.pseudonymize(days, "k").collect()]
    assert len(set(new)) == len(new) == days.count()
    for text in new:
        day, month, year = map(int, text.split("/"))
        assert datetime.date(year, month, day) and day > 12 and 1800 <= year < 2200


def test_the_key_stands_in_no_plan(spark, capsys):
    out = privacy.pseudonymize(spark.createDataFrame([(1, "1984-02-29")], "doc_id long, text string"), "a secret key")
    out.explain("extended")
    out.explain("formatted")
    assert "a secret key" not in capsys.readouterr().out and "a secret key" not in out._jdf.queryExecution().toString()
    assert out.columns == ["doc_id", "text"] and out.collect()[0]["text"] != "1984-02-29"
