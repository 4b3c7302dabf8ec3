import datetime as dt

import pytest
from pyspark.sql import functions as F

from annalist.functions import dates, ids, text


def one(spark, expr, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("written,number", [("Q42", 42), ("q042", 42), (" Q42\t", 42), ("wd:Q42", 42), ("item/Q42", 42), ("Q0", 0), ("P31", None), ("L7", None), ("Q", None), ("", None), ("novalue", None), ("Q4x", None), (None, None), ("Q" + "9" * 30, None)])
def test_item_number(spark, written, number):
    assert one(spark, ids.item_number("x"), x=written) == number


def test_property_and_rank(spark):
    assert one(spark, ids.property_number("x"), x="wdt:P0102") == 102
    assert one(spark, ids.rank_name("x"), x=" Preferred\n") == "preferred"
    assert one(spark, ids.rank_name("x"), x=None) == "normal"
    assert one(spark, ids.rank_name("x", None), x="  ") is None


DAYS = [
    ("+1998-00-00T00:00:00Z", "1998-01-01"), ("+2001-05-17T00:00:00Z", "2001-05-17"), (" 1999-12 ", "1999-12-01"), ("2001-5-3", "2001-01-01"), ("+2001-13-05", "2001-01-05"), ("+2001-05-32", "2001-05-01"), ("2001-05-17", "2001-05-17"),
    ("+2001-02-30", None), ("2001-02-30", None), ("+2001-04-31", None), ("-0044-03-15", None), ("0000-01-01", None), ("+12000-01-01", None), ("abc", None), ("", None), (None, None), ("99999999999999999999-01-01", None), ("0001-01-01", "0001-01-01"),
]


@pytest.mark.parametrize("written,day", DAYS)
def test_parse_day(spark, written, day):
    assert one(spark, dates.parse_day("x").cast("string"), x=written) == day


def test_day_lists(spark):
    listed = ["1957-03-25", "1950-01-01", "bad", "1950-01-01"]
    assert one(spark, dates.first_day("x"), x=listed) == dt.date(1950, 1, 1)
    assert one(spark, dates.last_day("x"), x=listed) == dt.date(1957, 3, 25)
    assert one(spark, dates.first_valid_day("x"), x=["bad", "2003-01-01", "1999-01-01"]) == dt.date(2003, 1, 1)
    assert one(spark, F.size(dates.days_of("x")), x=listed) == 2
    assert one(spark, F.size(dates.days_of("x")), x=[]) == 0
    assert [one(spark, dates.first_day(dates.list_of_json("x")), x=v) for v in ("[]", '{"a":1}', "oops", None)] == [None] * 4
    assert dates.anchor_days([2022])[1] == dt.date(2022, 4, 1)


CLEAN = {True: ["no value", "somevalue", "Angela Merkel", "O'Neil-Jones Jr.", "small ring", "unknowns"], False: ["A", "São Paulo", "AT&T", "Smith, John", "N/A", "unknown value", "unspecified", "Not known", "not  applicable", "Unknown artist", "NATION_0", "Customer#000000001", None, ""]}


@pytest.mark.parametrize("label,clean", [(x, k) for k, v in CLEAN.items() for x in v])
def test_clean_label(spark, label, clean):
    assert one(spark, text.is_clean_label("x"), x=label) is clean


@pytest.mark.parametrize("written,clean", [("Answer: Paris.\nBecause", "Paris"), ("It's the Louvre!", "the Louvre"), ("The answer is: 42", "42"), ("Final answer: X", "X"), (None, "")])
def test_clean_prediction(spark, written, clean):
    assert one(spark, text.clean_prediction("x"), x=written) == clean


def test_keys_and_candidates(spark):
    assert one(spark, text.normalize("x"), x="  “Héllo”\t World ") == '"héllo" world'
    assert one(spark, text.match_key("x"), x="U.S.A.") == "usa"
    assert one(spark, text.match_key("x"), x="Jean-Luc (actor)") == "jeanluc actor"
    assert one(spark, text.match_key("x"), x=None) == ""
    assert one(spark, text.candidates("x"), x='Answer: "Paris, France (capital)"') == ["Paris, France (capital", "Paris"]
    assert one(spark, text.candidates("x"), x="Paris (capital) of France") == ["Paris (capital) of France", "Paris of France"]
    assert one(spark, text.candidates("x"), x="") == []


@pytest.mark.parametrize("p,g,hit", [("Paris", "paris", True), ("New York City", "York", True), ("Rome / Paris", "Paris", True), ("Rome", "Paris", False), ("", "Paris", False), ("x", "", False)])
def test_relaxed(spark, p, g, hit):
    assert one(spark, text.match_relaxed("p", "g"), p=p, g=g) is hit
    assert one(spark, text.is_match("p", "g"), p=p, g=g) is hit


def test_quality(spark):
    good = lambda q, a, **k: one(spark, text.good_question("q", "a", **k), q=q, a=a)
    assert not good("Who was the head of X?", "5") and good("Who was the head of X?", "-1") and good("Who was the head of X?", "5", short_numbers=True)
    assert not good("Who is?", "Paris") and not good("Who was the head of X", "Paris")
    chain = lambda *qa: spark.createDataFrame([([{"question": q, "answer": a} for q, a in qa],)], "t array<struct<question:string,answer:string>>").select(text.good_chain("t")).first()[0]
    assert not chain(("Who leads the town A?", "Ann"), ("who leads the  town A?", "Bob"))
    assert not chain(*[(f"Who leads the town {i}?", "Ann") for i in "ABC"])
    assert chain(*[(f"Who leads the town {i}?", "Ann") for i in "AB"])
    assert all(one(spark, text.is_placeholder("x"), x=v) for v in ("", "N/A", "unknowns", "Nonesuch Palace")) and not one(spark, text.is_placeholder("x"), x="Paris")


def test_grams_overlap_plural(spark):
    assert one(spark, text.char_ngrams("x"), x="a bc d") == ["abc", "bcd"]
    assert one(spark, text.char_ngrams("x"), x="ab") == ["ab"] and one(spark, text.char_ngrams("x"), x="") == []
    assert one(spark, text.overlap(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "y", "y"]) == 2
    assert [one(spark, text.plural("x"), x=v) for v in ("country", "political party", "employer", "sports", "member of", "day")] == ["countries", "political parties", "employers", "sports", "member ofs", "days"]
