from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternfish.functions import text, urls
from lanternfish.operators.query import parse


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


STEMS = {
    "running": "run", "programming": "program", "classes": "class", "queries": "queri", "status": "status", "this": "this", "agreed": "agree", "feed": "feed",
    "searches": "searche", "conditional": "conditi", "documentation": "documentate", "next.js": "next.j", "falling": "fall", "hopefulness": "hopeful", "organizer": "organize",
    "relational": "relate", "c++": "c++", "was": "was", "bed": "bed",
}


def test_stem_on_driver_and_in_spark_agree(spark):
    df = text.with_stem(spark.createDataFrame([(w,) for w in STEMS], "w string"), "w", "s")
    assert {r["w"]: r["s"] for r in df.collect()} == STEMS == {w: text.stem(w) for w in STEMS}


def test_words_that_may_have_a_stem(spark):
    for w, s in STEMS.items():
        assert column(spark, [w], text.may_have_stem(F.col("v"), ["zzz", s])) == [True]
    assert column(spark, ["alphabet", ""], text.may_have_stem(F.col("v"), ["beta"])) == [False, False]


def test_runs(spark):
    rows = spark.createDataFrame([(["a", "a", "b", "c", "c"],), (["x"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(text.run_starts(F.col("w"))).collect()] == [[0, 2, 3], [0], []]


def test_tokens_keep_symbols_and_split_on_others(spark):
    found = column(spark, ["C++ Next.js, C# .NET TCP/IP café v1.0", "", None], text.tokens(F.col("v")))
    assert found == [["c++", "next.js", "c#", "net", "tcp", "ip", "caf", "v1.0"], [], []]


def test_word_count_is_unicode(spark):
    assert column(spark, ["é_1 à-b", "", None], text.word_count(F.col("v"))) == [3, 0, 0]


def test_nfkc(spark):
    assert column(spark, ["ﬁt", "plain", None], text.nfkc(F.col("v"))) == ["fit", "plain", None]


NORMAL = {
    "HTTP://Harbour.Test:80/ferries/Timetable/": "http://harbour.test/ferries/Timetable",
    "HTTPS://TIDES.test:443/moon.html": "https://tides.test/moon.html",
    "http://tides.test:8080/moon": "http://tides.test:8080/moon",
    "https://tides.test/moon?phase=new#rise": "https://tides.test/moon?phase=new",
    "https://shop.test/list?size=9&gclid=Zx&colour=sea+green&_ga=1.2": "https://shop.test/list?colour=sea+green&size=9",
    "https://tides.test": "https://tides.test/",
    "http://e.com//a///b//": "http://e.com/a/b",
    "http://e.com/?q=a%20b&empty=&x=1*~": "http://e.com/?q=a+b&x=1%2A~",
    "mailto:a@b.c": "mailto:a@b.c",
    "  http://e.com/a;p=1?REF=x ": "http://e.com/a",
}


def test_normalize_in_spark_and_python(spark):
    assert column(spark, NORMAL, urls.normalized(F.col("v"))) == list(NORMAL.values()) == [urls.normalize(u) for u in NORMAL]
    assert column(spark, [None], urls.normalized(F.col("v"))) == [""]


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"https?://[a-zA-Z.]{1,12}(:80|:443)?(/[a-z0-9.;]{0,4}){0,4}(\?([a-z]{1,3}=[a-z0-9]{0,3}&?){0,4})?(#x)?", fullmatch=True))
def test_normalize_twice_is_once(url):
    assert urls.normalize(urls.normalize(url)) == urls.normalize(url)


@pytest.mark.parametrize("url,safe", [
    ("http://example.com/", True), ("ftp://example.com/", False), ("http://localhost/", False), ("http://10.1.2.3/", False), ("http://8.8.8.8/", True),
    ("http://[::1]/", False), ("http://169.254.169.254/x", False), ("http:///x", False), (None, False),
])
def test_safety(url, safe):
    assert urls._safe(url) is safe


def test_parse_plain_phrase_filters_and_negation():
    assert parse("ferry harbour timetables").positive_terms == ("ferry", "harbour", "timetable")
    q = parse('winter "sailing boats" repairs')
    assert q.raw_exact_phrases == ("sailing boats",) and q.exact_phrases == (("sail", "boat"),) and {"winter", "repair"} <= set(q.positive_terms)
    q = parse("lighthouse -tower site:coast.test before:2024-06-30 after:whenever")
    assert q.negative_terms == ("tower",) and q.site == "coast.test" and q.before == datetime(2024, 6, 30) and q.after is None
    q = parse("F# Vue.js G++ 3.5")
    assert q.raw_positive_terms == ("f#", "vue.js", "g++", "3.5") and q.positive_terms == ("f#", "vue.j", "g++", "3.5")
    assert parse("a OR b").is_boolean_or and parse("a OR b").positive_terms == ("a", "b")
    assert parse("site:x -y").is_empty and parse(None).is_empty and parse('"open').positive_terms == ("open",)
