"""One plain spelling for texts that look the same but differ in their characters.

Method. Most text is already plain. A quick check in the JVM passes texts whose every character is
known to be stable; in the others, a pattern built from the Unicode properties (normalization quick
check, combining class, compatibility mapping, invisibility, look-alike) isolates the words that hold
an unstable character. Only those are normalized, whole words at a time so that base letters and the
marks that follow them stay together, and the plain words are spliced into the unchanged rest.

Which letters imitate Latin ones is taken from the published Unicode confusables, as the ICU library of the Spark
session has them or as their file says, completed by a few lower-case letters that those keep apart.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import ship

# Cyrillic, Greek, Armenian and other letters and the Latin letters they look like, beside the published table.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "ï", "ј": "j", "ѕ": "s",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l", "к": "k", "ь": "b", "г": "r", "ո": "n", "օ": "o", "ս": "u", "ց": "g",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "З": "3", "Ѵ": "V",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "α": "a", "γ": "y",
    "χ": "x", "τ": "t", "η": "n", "ϲ": "c", "ϳ": "j", "ѡ": "w", "ѐ": "è", "ё": "ë", "ӓ": "ä", "ӧ": "ö",
    "ı": "i", "ȷ": "j", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʏ": "y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s",
}
#: Lower-case letters that imitate a Latin letter well enough to stand for it in a word without any Latin letter.
_STRONG = set("аеорсухіјѕһԁԛԝӏАВЕЅІЈКМНОРСТУХ")
# Signs that only imitate a plain sign.
_SIGNS = {"‐": "-", "‑": "-", "․": ".", "ꓸ": ".", "ꞏ": ".", "՚": "'", "։": ":", "ꓽ": ":", "ǃ": "!", "⧸": "/"}
# Characters of category Cf or others that show nothing.
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0}
#: Kinds of compatibility mappings that only imitate their plain form; superscripts, fractions and the like are genuine.
_IMITATING = ("<font>", "<wide>", "<narrow>", "<noBreak>")
#: Letters, digits, signs and punctuation that are plain as they are, as Java and Python pattern classes.
_ASCII = "\\t\\n\\r -~"
STABLE = _ASCII + "¡-¬®-İĲ-ňŊ-ž‒-―‘-‟•…‰′″‹›⁰-ₜ€№™←-↔∀-∏∑-∿≈≠≤≥"
_LETTER = "[^\\W\\d_]"


def _folded(ch: str) -> str:
    """The plain form of one character by itself; '' if it shows nothing."""
    code = ord(ch)
    if ch in _SIGNS:
        return _SIGNS[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" and not 0x600 <= code <= 0x8FF or code in _INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    if kind == "Zs":
        return " "
    if kind == "Cc" and ch not in "\t\n\r\x0b\x0c\x85":
        return ""
    if kind in ("Zl", "Zp") or ch in "\x0b\x0c\x85":
        return "\n"
    mapping = unicodedata.decomposition(ch)
    if mapping.startswith(_IMITATING) or 0x2160 <= code <= 0x217F or 0xFB00 <= code <= 0xFB06:
        return "".join(_folded(c) if c != ch else c for c in unicodedata.normalize("NFKC", ch))
    return ch


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern[str], re.Pattern[str]]:
    """Folding table, pattern of unstable characters and pattern of imitating letters, from the properties."""
    fold: dict[int, str] = {}
    unstable: list[int] = []
    for code in range(0x80, 0x30000):
        if 0x3400 <= code <= 0x9FFF or 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF or 0x20000 <= code < 0x2F800:
            continue
        ch = chr(code)
        plain = _folded(ch)
        if plain != ch:
            fold[code] = plain
        if plain != ch or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch):
            unstable.append(code)
    for code in [*range(0x20), 0x7F, *range(0xE0000, 0xE0200)]:
        ch = chr(code)
        if (plain := _folded(ch)) != ch:
            fold[code] = plain
            unstable.append(code)
    unstable += [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    unstable += [ord(c) for c in LOOKALIKES]
    ranges: list[list[int]] = []
    for code in sorted(set(unstable)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    odd = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in ranges)
    imitating = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
    return fold, re.compile(f"[{odd}]"), imitating


def _usable(ch: str) -> bool:
    """Whether a published imitation is taken: letters beyond the Latin blocks; Greek ones are signs of formulas too."""
    code = ord(ch)
    return code > 0x24F and unicodedata.category(ch) in ("Lu", "Ll", "Lo", "Lt") and not 0x370 <= code <= 0x3FF and not 0x1F00 <= code <= 0x1FFF and code not in _tables()[0]


def _completed(published: dict[str, str]) -> dict[str, str]:
    """Letters and what they imitate: the published ones, small capitals, letters with marks, and the fixed values."""
    letters = {ch: plain for ch, plain in published.items() if _usable(ch) and plain.isascii() and plain.isalpha()}
    prefix = "LATIN LETTER SMALL CAPITAL "
    for code in range(0x250, 0x1D80):
        name = unicodedata.name(chr(code), "")
        if name.startswith(prefix) and len(name) == len(prefix) + 1:
            letters[chr(code)] = name[-1].lower()
    letters |= LOOKALIKES
    for code in range(0x250, 0x2000):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in letters and _usable(chr(code)):
            letters.setdefault(chr(code), unicodedata.normalize("NFC", letters[base] + "".join(marks)))
    return letters


def _as_shown(ch: str, skeleton: str, alike: dict[str, list[str]]) -> str:
    """Of the Latin letters and digits that share a skeleton (such as l, I and 1) the one of the same case."""
    if len(skeleton) != 1:
        return skeleton
    wanted = "Ll" if unicodedata.category(ch) == "Ll" else "Lu"
    return next((x for x in alike.get(skeleton, ()) if unicodedata.category(x) == wanted), skeleton)


def confusables(spark: SparkSession) -> dict[str, str]:
    """Imitating letters by the ICU library that Spark carries; the fixed values alone where the session has no JVM."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return _completed({})
    codes = [c for c in range(0x20, 0x20000) if not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xF8FF) and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cs")]
    chars = [chr(c) for c in codes]
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    table = dict(zip(chars, skeletons))
    alike: dict[str, list[str]] = {}
    for ch in filter(str.isascii, chars):
        alike.setdefault(table[ch], []).append(ch)
    return _completed({ch: _as_shown(ch, table[ch], alike) for ch in chars if not ch.isascii()})


def read_confusables(path: str) -> dict[str, str]:
    """Imitating letters from a file in the published form: ``source ; target ; kind # comment``, code points in hexadecimal."""
    table: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as lines:
        for line in lines:
            fields = [f.split() for f in line.split("#")[0].split(";")]
            if len(fields) >= 2 and len(fields[0]) == 1:
                table[chr(int(fields[0][0], 16))] = "".join(chr(int(x, 16)) for x in fields[1])
    alike: dict[str, list[str]] = {}
    for code in range(0x20, 0x7F):
        alike.setdefault(table.get(chr(code), chr(code)), []).append(chr(code))
    return _completed({ch: _as_shown(ch, plain, alike) for ch, plain in table.items() if not ch.isascii()})


_GAP = re.compile(r"[ \t\n\r]")


def _segments(text: str, odd: re.Pattern[str]) -> Iterator[tuple[int, int]]:
    """The stretches between ordinary spaces that hold an unstable character."""
    m = odd.search(text)
    while m:
        start = m.start()
        while start and text[start - 1] not in " \t\n\r":
            start -= 1
        gap = _GAP.search(text, m.end())
        end = gap.start() if gap else len(text)
        yield start, end
        m = odd.search(text, end)


_WORD = re.compile(f"{_LETTER}+")


def _script(ch: str) -> str:
    if ch <= "ɏ":
        return "L"
    if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
        return "G"
    return "C" if "Ѐ" <= ch <= "ԯ" else "O"


class Speller:
    """Plain spelling with a table of imitating letters."""

    def __init__(self, letters: dict[str, str]):
        self.letters = letters

    def __getstate__(self) -> dict:
        return {"letters": self.letters}

    def __getattr__(self, name: str):
        if name not in ("odd", "imitating"):
            raise AttributeError(name)
        # Worked out where they are used, and not sent there.
        one = "[" + "".join(map(re.escape, sorted(self.letters))) + "]"
        self.imitating, self.odd = re.compile(one), re.compile(_tables()[1].pattern[:-1] + one[1:])
        return self.__dict__[name]

    def _replaced(self, word: str) -> str:
        return "".join(self.letters.get(c, c) for c in word)

    def _word(self, word: str, foreign: bool, imitated: bool) -> str:
        """A run of letters with imitations replaced, unless it is truly of another script.

        ``foreign``: letters truly of another script are near; ``imitated``: another word of the text mixes scripts.
        """
        letters = self.letters
        scripts = {_script(c) for c in word}
        if scripts == {"L"}:
            return self._replaced(word)
        if "L" in scripts or len(scripts) > 1:
            if "L" not in scripts and not all(c in letters for c in word):
                return word
            latin = sum(_script(c) == "L" for c in word)
            if scripts <= {"L", "G"} and any(c not in letters for c in word if _script(c) == "G"):
                return word  # a formula such as a change of m
            if scripts <= {"L", "G"} and latin < 2 and len(word) < 3 and word[0].islower() and "ο" not in word:
                return word
            genuine = sum(_script(c) in "CO" and c not in letters for c in word)
            return word if genuine > latin else self._replaced(word)
        # A word without a Latin letter may be a true one, such as a choir in Cyrillic: it is replaced if it has one or
        # two letters, as prepositions and letters of lists have, or stands in a text that mixes scripts elsewhere.
        if scripts == {"C"} and not foreign and all(c in _STRONG for c in word) and (len(word) <= 2 or imitated):
            return self._replaced(word)
        if scripts == {"O"} and not foreign and all(c in letters for c in word) and (len(word) == 1 or imitated):
            return self._replaced(word)
        # Omicron is no sign of formulas; a run of capitals is a word, a single one may be a sign.
        if scripts == {"G"} and (word in "οΟ" or len(word) > 1 and all(c in letters and (c.isupper() or c == "ο") for c in word)):
            return self._replaced(word)
        return word

    def _foreign(self, text: str) -> bool:
        """Whether a letter stands there that is truly of another script; Greek ones may be signs."""
        return any(c > "ɏ" and _script(c) in "CO" and c.isalpha() and c not in self.letters for c in text)

    def _mixes(self, text: str) -> bool:
        words = (w[0] for w in _WORD.finditer(text))
        return any(any(c <= "ɏ" for c in w) and any(c in self.letters and _script(c) in "CO" for c in w) for w in words)

    def plain(self, text: str | None) -> str | None:
        """The plain spelling of one text: composed, ordinary spaces, nothing invisible, no imitations.

        Null stays null. Genuine signs (superscripts, fractions, §, №, dashes, quotes, formulas) and words
        truly written in another script stay. Applying it twice changes nothing more.
        """
        if text is None or text.isascii() and text.isprintable():
            return text
        fold = _tables()[0]
        imitated: bool | None = None
        out: list[str] = []
        done = 0
        for start, end in _segments(text, self.odd):
            out.append(text[done:start])
            done = end
            piece = unicodedata.normalize("NFC", text[start:end].translate(fold))
            if self.imitating.search(piece):
                near = (text[max(0, start - 24) : start] + text[end : end + 24]).translate(fold)
                quoted = piece[0] in "„“”\"'«‚" and len(piece) > 3
                foreign = quoted or self._foreign(piece) or self._foreign(near)
                if imitated is None:
                    imitated = self._mixes(text)
                piece = _WORD.sub(lambda w, f=foreign, i=imitated: self._word(w[0], f, i), piece)
                piece = unicodedata.normalize("NFC", piece)
            out.append(piece)
        out.append(text[done:])
        return "".join(out)


def _speller(letters: dict[str, str]):
    speller = Speller(letters)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(speller.plain, na_action="ignore")

    return run


def quick_check(text: Column) -> Column:
    """Whether a text may hold an unstable character; runs in the JVM, false for null.

    Only characters beyond ASCII, which few are, are looked at in the longer class.
    """
    return F.coalesce(text.rlike(f"[^{_ASCII}](?<![{STABLE}])"), F.lit(False))


def with_plain(df: DataFrame, text: str, out: str, letters: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the plain spelling of column ``text`` in ``out``; null for null, '' for ''.

    ``letters`` are the imitating letters, :func:`confusables` by default. Every row is kept, in no new order and
    without a shuffle; texts that pass the quick check stay in the JVM.
    """
    ship(df.sparkSession)
    column = F.col(f"`{text}`")
    spelled = _speller(confusables(df.sparkSession) if letters is None else letters)(F.when(quick_check(column), column))
    return df.withColumn(out, F.coalesce(spelled, column))


def _shown(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def unplain(df: DataFrame, text: str, out: str = "plain", letters: dict[str, str] | None = None) -> DataFrame:
    """The rows whose ``text`` changes, beyond case, runs of spaces and line breaks, when spelled plainly.

    Rows that pass the quick check never leave the JVM.
    """
    column = F.col(f"`{text}`")
    checked = with_plain(df.where(quick_check(column)), text, out, letters)
    return checked.where(_shown(F.col(f"`{out}`")) != _shown(column))
