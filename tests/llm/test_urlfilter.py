import re
from itertools import product

import __spark_entry__
import duckdb
import numpy as np
import pytest
from refrain.llm import urlfilter as U


def glob(pattern: str, text: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None


def test_automaton_against_regular_expressions():
    globs = ["".join(p) for k in range(4) for p in product("ab*?", repeat=k)]
    texts = ["".join(p) for k in range(6) for p in product("abc", repeat=k)]
    got = U.Automaton(globs).run(texts)
    assert U.Automaton(globs).words > 1
    for j, g in enumerate(globs):
        assert [bool(x) for x in got[:, j]] == [glob(g, t) for t in texts], g


def test_rules_on_urls(spark):
    urls = ["http://WWW.cheap-pills.example.net:80/en/1/#top", "https://u:p@a.edu/x.zip?utm_source=f", "https://a.example.org/en/1.html?utm_medium=x&page=2", None, "", "x" * 50_000 + ".zip", "http://ü.example.net/é.JPG/"]
    df = spark.createDataFrame([(i, u, "other") for i, u in enumerate(urls)] + [(None, urls[0], "other")], "page_id long, url string, rules string")
    rows = sorted(U.match(df).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [r.canonical_url for r in rows[:3]] == ["www.cheap-pills.example.net/en/1", "a.edu/x.zip", "a.example.org/en/1.html?page=2"]
    assert [r.blocked for r in rows] == [True, False, False, False, False, True, True, True]
    assert rows[3].canonical_url is None and rows[3].rules == ""
    for r in rows:
        if r.canonical_url:
            assert r.rules == ",".join(sorted(n for n, _, g in U.RULES if glob(g, r.canonical_url)))


def test_empty_table(spark):
    assert U.match(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bits_over_word_borders():
    long = "a" * 200
    got = U.Automaton([long, long + "*", "b", "*" + long]).run([long, long[1:], "b" + long, long + "b"])
    assert np.array_equal(got, [[1, 1, 0, 1], [0, 0, 0, 0], [0, 0, 0, 1], [0, 1, 0, 0]])


def test_names_that_would_make_rules_ambiguous(spark):
    df = spark.createDataFrame([(1, "a")], "page_id long, url string")
    for rules in ((("a,b", "block", "*"),), (("a", "block", "*"), ("a", "allow", "*"))):
        with pytest.raises(ValueError):
            U.match(df, rules=rules)


def test_query_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from read_parquet('{sf}/pages.parquet')")
    got = __spark_entry__.queries()["op1_url_filters"](spark, sf).collect()
    columns = got[0].__fields__
    want = db.sql(f"select {', '.join(columns)} from ({__spark_entry__.oracle_sql()['op1_url_filters']}) x").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 50
