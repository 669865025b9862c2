"""Id functions against fixtures and small independent specifications."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.functions import ids

VALUES = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman(s):
    return sum(-VALUES[c] if any(True for n in s[i + 1 : i + 2] if VALUES[n] > VALUES[c]) else VALUES[c] for i, c in enumerate(s))


def normal(s):
    s = re.sub(r"\(([MDCLXVI]+)(\([^)]*\))?\)", lambda m: f"({roman(m[1])}{m[2] or ''})", s).lower()
    return re.sub(r"(\d+)([a-zA-Z])|([a-zA-Z])(\d+)", lambda m: f"{m[1] or ''}{m[3] or ''}({m[2] or ''}{m[4] or ''})", s).replace("@", "")


def run(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", f(F.col("s")).alias("v"))
    return [r.v for r in sorted(rows.collect(), key=lambda r: r.i)]


def test_fixtures(spark):
    given_ids = ["art(IV)ust(2)", "art(IV(2))", "ART(5A)", "@art(7)", "art5", None, "", "(IV(V))art(V)"]
    assert run(spark, given_ids, ids.normal_id) == ["art(4)ust(2)", "art(4(2))", "art(5(a))", "art(7)", "art(5)", None, "", "(4(v))art(5)"]
    assert run(spark, ["IV", "XCIX", "IIX", "MCMXCIV", "", None], ids.roman_to_int) == [4, 99, 10, 1994, 0, None]
    assert run(spark, ["art(1)ust(2)", "dz(I(2))art(1)", "abc", None], ids.root_id) == ["art(1)", "dz(I(2))", "abc", None]
    assert run(spark, ["art(1)ust(2)", "abc"], ids.prefixes) == [["art(1)", "art(1)ust(2)"], []]
    assert run(spark, ["art(5)ust(1)", "art(x)", None], ids.roman_first_bracket) == ["art(V)ust(1)", "art(x)", None]
    assert run(spark, ["a-b", "a", "a-b-c"], ids.range_ends) == [["a", "b"], ["a"], ["a", "b"]]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="IVXLCDM()a5@artUST-", max_size=14), min_size=40, max_size=80))
def test_normal_form(spark, texts):
    assert run(spark, texts, ids.normal_id) == [normal(t) for t in texts]
    found = run(spark, texts, ids.prefixes)
    for text, got in zip(texts, found):
        depth, expected = 0, []
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if c == ")" and depth == 0:
                expected.append(text[: i + 1])
        assert got == expected
