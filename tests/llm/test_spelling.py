"""Plain spelling: what changes, what is genuine, and idempotence."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.llm.spelling import STABLE, Speller, _tables, confusables, read_confusables, unplain, with_plain

@pytest.fixture(scope="module")
def plain(spark):
    return Speller(confusables(spark)).plain


CHANGED = {
    "Ꭺrt. 5": "Art. 5", "ꓐank": "Bank", "ⲟrgan": "organ", "հello": "hello", "ʟex": "lex", "ᗅct": "Act", "ҽlement": "element", "аrt. хор": "art. xop",
    "ａｒｔ． ５": "art. 5", "a‌rt. 1\xad ust. 2": "art. 1 ust. 2", "art. 6\xa0ust. 3": "art. 6 ust. 3", "аrt. 3 uѕt. 2 рkt 1": "art. 3 ust. 2 pkt 1",
    "Ζаłąсznіk nr 540": "Załącznik nr 540", "załącznik": "załącznik", "𝖺𝗋𝗍. 1": "art. 1", "Αrt. 2": "Art. 2", "pο zasięgnięciu": "po zasięgnięciu",
    "lit. а": "lit. a", "art‑5": "art-5", "żółć": "żółć", "﻿art": "art", "Ⅳ": "IV", "ﬁrma": "firma", "x y": "x\ny",
}
GENUINE = [
    "Produkty „Żółć” i „Gęś” № 18.", "Wzór: Δm = α · V² – ½ r, gdzie r ≤ 3.", "Temperatura: 24 °C ± 2 °C; § 24", "λ/12 oraz µ₀ – wartość stała.",
    "Dopuszcza się nazwę „міст” albo „паром”.", "art. 4¹ ust. 2", "1\tinformację\t11 %\n2", "", "…", "Ελλάδα", "Київ і Москва", "日本語",
    "Śpiewa хор miejski.", "שלום ס", "ᎠᏂᏴᏫᏯ", "օր", "مرحبا ه",
]


@pytest.mark.parametrize("text", CHANGED)
def test_changes(plain, text):
    assert plain(text) == CHANGED[text]


@pytest.mark.parametrize("text", GENUINE)
def test_genuine(plain, text):
    assert plain(text) == text


def test_null_and_long(plain):
    assert plain(None) is None
    assert plain("a" * 100_000 + "​" + "ｂ" * 1000) == "a" * 100_000 + "b" * 1000


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(max_codepoint=0x1FFFF, exclude_categories=["Cs", "Co", "Cn"]), max_size=30))
def test_idempotent_and_composed(plain, text):
    once = plain(text)
    assert plain(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_stable_class_holds_no_unstable_character():
    import re

    odd = _tables()[1]
    stable = re.compile(f"[{STABLE}]")
    bad = [hex(c) for c in range(0x30000) if stable.match(chr(c)) and odd.match(chr(c)) and not 0xD800 <= c < 0xE000]
    assert not bad


def test_frames(spark):
    rows = [(1, "аrt. 1", "p"), (2, "art. 1", "q"), (3, None, None), (4, "", "r"), (1, "аrt. 1", "p"), (5, "a\xa0\xa0b", "s")]
    df = spark.createDataFrame(rows, "id int, text string, plain string")
    got = {(r.id, r.p) for r in with_plain(df, "text", "p").collect()}
    assert got == {(1, "art. 1"), (2, "art. 1"), (3, None), (4, ""), (5, "a  b")}
    assert sorted(r.id for r in unplain(df, "text").collect()) == [1, 1, 5]  # runs of spaces are no matter, but their kind is
    assert with_plain(df.limit(0), "text", "p").count() == 0


def test_published_file(tmp_path):
    """The published form of the table; case decides among letters of one skeleton."""
    path = tmp_path / "confusables.txt"
    path.write_text("\ufeff# comment\n0049 ;\t006C ;\tMA\t# I\n0031 ; 006C ; MA\n0406 ; 006C ; MA # x\n13AA ;\t0041 ;\tMA\t#*\n0441 0442 ; 0061 ; MA\n\n", encoding="utf-8")
    letters = read_confusables(str(path))
    assert letters["Ꭺ"] == "A" and letters["І"] == "I" and "ꓐ" not in letters
    assert Speller(letters).plain("Ꭺrt") == "Art"


def test_every_published_letter_is_replaced_in_a_latin_word(spark, plain):
    letters = confusables(spark)
    assert len(letters) > 400
    bad = [c for c, to in letters.items() if not "Ͱ" <= c <= "Ͽ" and plain(f"abcd{c}ef") != unicodedata.normalize("NFC", f"abcd{to}ef")]
    assert not bad


def test_quick_check_is_the_class(spark):
    import re

    from statuta.llm.spelling import quick_check

    stable = re.compile(f"[{STABLE}]")
    chars = [chr(c) for c in [*range(1, 0x3000), 0x1D5BA, 0x1F600, 0xFEFF, 0xFF41]]
    rows = spark.createDataFrame([(c, f"ab {c} ć") for c in chars], "c string, t string").select("c", quick_check(F.col("t")).alias("odd")).collect()
    assert [r.c for r in rows if r.odd != (stable.match(r.c) is None)] == []
