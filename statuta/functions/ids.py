"""Element ids: Roman numerals, bracket repair, normal form, ranges and prefixes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Roman numerals.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
#: A bracket that opens with Roman digits, with an optional inner bracket (a fixed pattern).
NESTED_ROMAN = r"\(([MDCLXVI]+)(\([^)]*\))?\)"
#: A digit run before a letter, or a letter before a digit run (a fixed pattern).
BRACKET_ERROR = r"(\d+)([a-zA-Z])|([a-zA-Z])(\d+)"
WHOLE_ACT = "all()"


def roman_to_int(text: Column) -> Column:
    """Value of Roman digits, read from the right, a smaller digit before a larger one subtracting.

    Nothing is rejected (``IIX`` is 10). Null stays null, '' is 0; other characters count as nothing.
    """
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))

    def step(acc: Column, ch: Column) -> Column:
        v = F.coalesce(values[ch], F.lit(0))
        return F.struct(
            F.when(v < acc["last"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"), v.alias("last")
        )

    return F.aggregate(F.reverse(F.split(text, "")), start, step, lambda acc: acc["total"])


def roman_brackets_to_arabic(text: Column) -> Column:
    """``art(IV(2))`` to ``art(4(2))``: every bracket that opens with Roman digits."""
    between = F.split(text, NESTED_ROMAN)
    digits = F.regexp_extract_all(text, F.lit(NESTED_ROMAN), F.lit(1))
    inner = F.regexp_extract_all(text, F.lit(NESTED_ROMAN), F.lit(2))
    inside = F.zip_with(digits, inner, lambda d, i: F.concat(F.lit("("), roman_to_int(d).cast("string"), i, F.lit(")")))
    joined = F.zip_with(between, inside, lambda b, m: F.concat(b, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(NESTED_ROMAN), F.array_join(joined, "")).otherwise(text)


def repair_brackets(text: Column) -> Column:
    """``5a`` to ``5(a)`` and ``t5`` to ``t(5)``, one pass."""
    return F.regexp_replace(text, BRACKET_ERROR, "$1$3($2$4)")


def normal_id(text: Column) -> Column:
    """Normal form of an element id: Roman to Arabic, lower case, brackets repaired, no ``@``."""
    return F.replace(repair_brackets(F.lower(roman_brackets_to_arabic(text))), F.lit("@"), F.lit(""))


def is_range(text: Column) -> Column:
    return F.contains(text, F.lit("-"))


def range_ends(text: Column) -> Column:
    """The one or two ids that ``a`` or ``a-b`` names; further parts of ``a-b-c`` are ignored."""
    return F.slice(F.split(text, "-"), 1, 2)


def prefixes(text: Column) -> Column:
    """Prefixes of an id that end with a bracket closed at depth 0; an empty array if there is none."""
    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("seen"), F.array().cast("array<string>").alias("out")
    )

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        seen = F.concat(acc["seen"], ch)
        closed = (ch == ")") & (depth == 0)
        return F.struct(
            depth.alias("depth"), seen.alias("seen"),
            F.when(closed, F.array_append(acc["out"], seen)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.split(text, ""), start, step, lambda acc: acc["out"])


def root_id(text: Column) -> Column:
    """The first prefix of an id, its root; an id without brackets is its own root."""
    return F.coalesce(F.try_element_at(prefixes(text), F.lit(1)), text)


def roman_first_bracket(text: Column) -> Column:
    """``art(5)ust(1)`` to ``art(V)ust(1)``: a single digit right after the first bracket."""
    digits = F.regexp_extract(text, r"^[^(]*\(([1-9])", 1)
    romans = F.array(*[F.lit(x) for x in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")])
    swapped = F.concat(
        F.regexp_extract(text, r"^([^(]*\()", 1), F.try_element_at(romans, F.try_cast(digits, "int") if hasattr(F, "try_cast") else digits.try_cast("int")),
        F.regexp_extract(text, r"^[^(]*\([1-9](.*)$", 1),
    )
    return F.when(digits != "", swapped).otherwise(text)
