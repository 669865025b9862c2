"""Defective prompt-response pairs: empty, truncated, refused, copied or in another language.

Method. The sentences of all responses are sorted by text over the whole cluster. What a response ends in
(its last sentence, unless that is known to end there) is compared with all sentences it begins, which
follow it in this order: one that goes on in mid-word or mid-clause shows that the response is a shortened
version. Where no sentence begins like that as a whole, the last three words are compared with all runs of words in the
same way. Lengths at which unfinished responses pile up against their neighbours' lengths betray a length
limit. Then come the rules for copies, refusals and languages. What no prefix and no limit tells is left
to the signs at the end of the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.llm.languages import Model, fit
from statuta.session import cut, hot_join, ship, small

# What stands in for an empty response, after lower-casing and dropping accents.
STAND_INS = {
    "", "brak", "brak odpowiedzi", "brak danych", "n/d", "nd", "n.d", "b/d", "b.d", "bd", "null", "none", "nan", "n/a", "na",
    "odpowiedz", "answer", "todo", "tbd", "undefined", "pusto", "empty", "no answer", "uzasadnienie", "brak uzasadnienia",
    "xxx", "do uzupelnienia", "w przygotowaniu", "tresc", "tekst", "lorem ipsum", "nil", "void", "placeholder",
}
# Who declines to answer when a third person does, lower-case and without accents.
_ANSWERER = r"(?:ekspert\w*|redakcja|konsultant\w*|doradca|asystent\w*|autor\w*|zespol|serwis|our experts?|the (?:expert|assistant|editors?|team|author)s?)"
# Phrases that decline to answer, lower-case and without accents; .{0,n} bridges other words.
REFUSALS = re.compile(
    r"pytanie nie (zostanie|bedzie|moze zostac) rozpatrzone|zamknieto bez odpowiedzi|bez udzielenia odpowiedzi|(pozostawiamy|pozostawiono) bez (rozpoznania|odpowiedzi|rozpatrzenia)|"
    r"\bnie (doradzamy|doradzam|udzielamy (porad|odpowiedzi|informacji)|udzielam|udzielimy|odpowiemy|odpowiadamy|odpowiem|komentujemy|pomozemy|opiniujemy|rozpatrujemy)\b|"
    r"\bnie (chcielibysmy|chcemy|bedziemy|zamierzamy|mozemy|moge|jestesmy w stanie|jestem w stanie|podejmiemy sie|podejmujemy sie|podejme sie|potrafimy|potrafie|wolno nam)\b.{0,40}?(wypowiad|wypowied|odpowiedz|odpowiadac na|doradz|porad|pomoc|stanowisk|ocen|koment|opini|interpret|wyjasni|ustosunk)|"
    rf"\b{_ANSWERER}\b.{{0,25}}\b(odmow|odmawia|nie udziel|nie odpowi|nie doradza|nie komentuje|unable|cannot|can not|can't|declin|refus|does not|do not|will not)|"
    r"\b(odmawiamy|odmowilismy|odmawiam)\b.{0,25}(odpowiedzi|porady|komentarza|stanowiska|opinii|pomocy)|"
    r"wstrzymujemy sie od|wstrzymuje sie od (komentowania|odpowiedzi|oceny|wypowiedzi)|brak mozliwosci (udzielenia|odpowiedzi|pomocy)|"
    r"wykracza poza (nasze|moje)|poza naszymi kompetencjami|nie lezy w naszych kompetencjach|"
    r"\b(i|we|i am|we are|i'm|we're|sorry|unfortunately)\b.{0,20}\b(unable|not able|cannot|can't|can not|won't|will not|refuse|decline|regret)\b.{0,30}\b(answer|advise|help|comment|assist|respond|opinion|reply)|"
    r"\b(ich|wir)\b.{0,20}\b(konnen|kann|mochten)\b.{0,60}\bnicht\b.{0,20}(beantworten|antworten|helfen|beraten)|\b(konnen|kann)\b.{0,20}\b(ich|wir)\b.{0,60}\bnicht\b.{0,20}(beantworten|antworten|helfen|beraten)|"
    r"nemuzeme.{0,40}(odpovedet|poradit)|не можемо.{0,40}(відповісти|допомогти)"
)
# How sentences begin that only surround a refusal, lower-case and without accents.
COURTESIES = re.compile(
    r"(dzien dobry|witam|szanown|uprzejmie informuj|informujemy, ze (pytanie|zapytanie|wiadomosc)|przepraszamy|przepraszam|przykro|niestety|dziekuj|prosimy|prosze|zachecamy|zapraszamy|polecamy|sprawe zamknieto|pytanie zamknieto|"
    r"z powazaniem|pozdraw|hello|dear|sorry|unfortunately|please|thank|we recommend|kind regards|guten tag|leider|bitte|danke|vielen dank|dobry den|bohuzel|prosim|dekuj|"
    r"добрий день|на жаль|будь ласка|дякуємо)"
)
# Abbreviations after which a sentence cannot end.
OPEN_ABBREVIATIONS = {"art", "ust", "pkt", "lit", "nr", "zw", "tzw", "np", "tj", "tzn", "por", "zob", "poz", "par", "rozdz", "zal", "wg", "ww", "ds", "abs", "nr", "vgl", "bzw", "cf", "e.g", "i.e", "č", "čl", "odst", "ст", "п"}
# Words after which a sentence cannot end, without accents.
OPEN_WORDS = set(
    "i oraz a albo lub ale lecz ze ktory ktora ktore ktorego ktorych gdy jesli jezeli poniewaz gdyz bo do od z w na o po przy dla przez za nad pod wobec zas czyli takze "
    "the of to and or a an in on at for by with if that which und oder der die das in mit von zu".split()
)
_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_TAGS = re.compile(r"<[^<>]{0,200}>|&nbsp;")
_WORDS = re.compile(r"[^\W_]+")
#: Short quoted stretches, which may be foreign terms.
_QUOTED = re.compile(r"[„“\"«][^„”“\"»]{1,40}[”“\"»]")
_CLOSERS = "\"'”’»)]}* "
_RESTATED = {"pytanie", "question", "frage", "otazka", "питання"}
#: A response without a closing sign is complete up to this many words and characters.
SHORT_WORDS, SHORT_CHARS = 4, 24
COPIED_SHARE = 0.6


class _Folding(dict):
    """Small letters without accents, worked out when first met; ``ł`` is ``l``."""

    def __missing__(self, code: int) -> str:
        plain = unicodedata.normalize("NFD", chr(code).lower()).replace("ł", "l")
        self[code] = plain = "".join(c for c in plain if not unicodedata.combining(c))
        return plain


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else text.translate(_FOLDING)


def visible(text: str) -> str:
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    return " ".join(_INVISIBLE.sub("", text).split())


def is_empty(text: str) -> bool:
    return _is_empty(fold(visible(text)))


def _is_empty(folded: str) -> bool:
    if len(folded) > 64 and folded.isprintable() and any(c.isalnum() for c in folded):
        return False  # longer than any stand-in
    seen = folded.strip(" .…-–—_*[](){}<>?!:;/\\|'\"„”")
    return seen in STAND_INS or not any(c.isalnum() for c in seen)


def is_copy(question: str, text: str) -> bool:
    """Whether a response only repeats the question, with slight changes at most.

    Compared are pairs of neighbouring words, so that an answer built from the question's words is
    none, nor one that follows a restated question.
    """
    return _is_copy(fold(visible(question)), fold(visible(text)))


def _is_copy(question: str, text: str) -> bool:
    q, t = _WORDS.findall(question), _WORDS.findall(text)
    if t and t[0] in _RESTATED:
        t = t[1:]
    if len(t) < 4 or len(q) < 3:
        return bool(t) and len(t) > 2 and t == q
    known = set(zip(q, q[1:])) | {(q[-1], q[0])}
    hit = [pair in known for pair in zip(t, t[1:])]
    share = sum(hit) / len(hit)
    if share < COPIED_SHARE:
        return False
    # Words after the last repeated pair, or a long foreign stretch, are an answer of its own.
    tail = len(t) - 2 - max(i for i, h in enumerate(hit) if h)
    run = longest = 0
    for h in hit:
        run = 0 if h else run + 1
        longest = max(longest, run)
    asks = text.rstrip(_CLOSERS).endswith("?")
    return longest < 8 and (tail == 0 or tail <= 2 and asks and t[-1] in set(q))


_SENTENCE = re.compile(r"(?<=[.?!…])\s+(?=[„\"(\[]?[^\W\d_])")


def sentences(text: str) -> list[str]:
    """Sentences of a visible text: cut after a closing sign where a capital letter follows."""
    out: list[str] = []
    for part in _SENTENCE.split(text):
        begins = part.lstrip("„\"([")[:1]
        if out and not begins.isupper():
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def is_refusal(text: str) -> bool:
    """Whether a response declines, with nothing but courtesies around it: every sentence is of either kind."""
    return _is_refusal(visible(text))


def _is_refusal(seen: str, folded: str | None = None) -> bool:
    if not REFUSALS.search(fold(seen) if folded is None else folded):
        return False
    return all(REFUSALS.search(part) or COURTESIES.match(part.lstrip("„\"([ ")) for part in map(fold, sentences(seen)))


def ending(text: str) -> str:
    """'done' if the last sentence ends, 'open' if it surely breaks off, 'bare' if it has no closing sign."""
    return _ending(visible(text))


def _ending(seen: str) -> str:
    if seen.endswith(("...", "…")):
        return "open"
    core = seen
    # A bracketed reference after a finished sentence belongs to it.
    while core.endswith(")") and "(" in core:
        before = core[: core.rindex("(")].rstrip()
        if not before or before[-1] not in ".?!":
            break
        core = before
    core = core.rstrip(_CLOSERS)
    if not core:
        return "done"
    if core[-1] in ".?!":
        words = core.rstrip(".?!").split()
        last = fold(words[-1]).lstrip("(„\"'") if words else ""
        return "open" if core[-1] == "." and (last in OPEN_ABBREVIATIONS) else "done"
    if core[-1] in ",;:–—-(/„“§":
        return "open"
    last = fold(core.split()[-1])
    return "open" if (last in OPEN_WORDS or last in OPEN_ABBREVIATIONS) and len(core.split()) > 1 else "bare"


def defect(
    question: str | None, text: str | None, absent_is_fine: bool, shortened: bool, at_limit: bool, model: Model | None = None
) -> tuple[str, str] | None:
    """The defect of one response and what tells it, or None. ``shortened``: a sentence goes on where it ends."""
    if text is None:
        return None if absent_is_fine else ("empty", "absent")
    seen = visible(text)
    folded = fold(seen)
    if _is_empty(folded):
        return "empty", "stand-in"
    if _is_refusal(seen, folded):
        return "refusal", "phrase"
    if question and _is_copy(fold(visible(question)), folded):
        return "copied", "words"
    if question and model is not None and model.differs(question, _QUOTED.sub(" ", seen)):
        return "language", "letters"
    if shortened:
        return "truncated", "prefix"
    end = _ending(seen)
    if end == "done":
        return None
    if at_limit:
        return "truncated", "limit"
    if end == "open" or len(seen) > SHORT_CHARS or len(seen.split()) > SHORT_WORDS:
        return "truncated", "ending"
    return None


def _defects(model: Model | None):
    kinds = T.StructType([T.StructField("defect", T.StringType()), T.StructField("evidence", T.StringType())])

    @F.pandas_udf(kinds)
    def run(q: pd.Series, t: pd.Series, absent: pd.Series, short: pd.Series, limit: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([defect(*row, model) or (None, None) for row in zip(q, t, absent, short, limit)], columns=["defect", "evidence"], dtype=object)

    return run


def _clean(text: Column) -> Column:
    """A text without markup and invisible signs, with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, _TAGS.pattern, " "), _INVISIBLE.pattern, "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _sentences(clean: Column) -> Column:
    return F.split(clean, r"(?<=[.?!…])\s+(?=[„\"(\[]?\p{Lu})")


def tail(clean: Column) -> Column:
    """The last sentence of a cleaned text, without what a cut may have left at its end: dots, commas, dashes."""
    last = F.element_at(_sentences(clean), -1)
    return F.regexp_replace(F.regexp_replace(last, r"(\.\.+|…)[\s.…]*$", ""), r"[\s…,;:–—(„-]+$", "")


def continues(a: str, b: str) -> bool:
    """Whether ``b`` goes on where ``a`` stops, in mid-word or mid-clause; not where a clause ends."""
    if not 0 < len(a) < len(b) or not b.startswith(a):
        return False
    if a[-1] in ".?!":
        # A closing sign that closes nothing, as after an abbreviation; a bracket may follow a finished sentence.
        after = b[len(a) + 1 : len(a) + 2]
        return b[len(a)] == " " and a.count(" ") >= 2 and after.isalnum() and not after.isupper()
    return b[len(a)].isalnum() or b[len(a)] == " " and a.count(" ") >= 2


def last_words(clean: Column, tail_: Column, n: int = 3) -> Column:
    """The last ``n`` words of a tail without a closing sign, of texts longer than a short answer; else null."""
    of_tail = F.split(tail_, " ")
    long = (F.size(F.split(clean, " ")) > SHORT_WORDS) & (F.size(of_tail) >= n) & ~tail_.rlike("[.?!]$")
    return F.when(long, F.array_join(F.slice(of_tail, F.greatest(F.size(of_tail) - n + 1, F.lit(1)), F.lit(n)), " "))


def _runs_of_words(sentences_: DataFrame, tails: DataFrame, n: int = 3) -> DataFrame:
    """``key``: runs of n + 1 words (n at the end) of the column ``key`` that begin with the first n - 1 words of a tail.

    The others are gone before a run is put together: the tails are those of unfinished texts only.
    """
    first = tails.select(F.xxhash64(F.slice(F.split("key", " "), 1, n - 1)).alias("h")).distinct()
    words = sentences_.select(F.split("key", " ").alias("w")).where(F.size("w") >= n)
    at = words.select("w", F.explode(F.expr(f"sequence(1, size(w) - {n - 1})")).alias("i")).withColumn("h", F.xxhash64(F.slice("w", F.col("i"), F.lit(n - 1))))
    return at.join(small(cut(first)), "h", "left_semi").select(F.array_join(F.slice("w", F.col("i"), F.lit(n + 1)), " ").alias("key"))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tails of sorted keys that a later key continues; those still waiting at the end come out as open."""
    waiting: list[str] = []
    for batch in batches:
        out: list[tuple[str, bool]] = []
        for key, is_tail in zip(batch["key"], batch["is_tail"]):
            while waiting and not key.startswith(waiting[-1]):
                waiting.pop()
            if waiting:
                found = [t for t in waiting if continues(t, key)]
                if found:
                    out += [(t, False) for t in found]
                    waiting = [t for t in waiting if not continues(t, key)]
            if is_tail:
                waiting.append(key)
        yield _rows(out)
    yield _rows([(t, True) for t in waiting])


def _rows(found: list[tuple[str, bool]]) -> pd.DataFrame:
    return pd.DataFrame({"key": pd.Series([t for t, _ in found], dtype=object), "open": pd.Series([o for _, o in found], dtype=bool)})


def _look_up(tails: list[str]):
    lengths, known = sorted({len(t) for t in tails}), set(tails)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = {t for key in batch["key"] for n in lengths if n < len(key) and (t := key[:n]) in known and continues(t, key)}
            yield pd.DataFrame({"key": pd.Series(sorted(hits), dtype=object)})

    return run


def shortened_keys(tails: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The distinct ``tails`` that one of the ``keys`` continues (column ``key``), by one global sort.

    Keys that begin with a tail follow it directly among the sorted distinct texts, so that a list of the tails
    that begin the present key is all that a pass over a range of them holds. What waits at the end of a range,
    tails nested in each other, is looked up among all keys again: a few texts a partition.
    """
    spark = tails.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = tails.select(F.col(key).alias("key"), F.lit(True).alias("is_tail")).unionByName(keys.select(F.col(key).alias("key"), F.lit(False).alias("is_tail")))
    distinct = cut(both.where("key IS NOT NULL AND key != ''").groupBy("key").agg(F.max("is_tail").alias("is_tail")))
    seen = cut(distinct.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(_scan, "key string, open boolean"))
    waiting = [r["key"] for r in seen.where("open").select("key").distinct().collect()]
    found = seen.where("NOT open").select("key")
    if waiting:
        found = found.unionByName(distinct.select("key").mapInPandas(_look_up(waiting), "key string"))
    return found.distinct()


def limit_lengths(responses: DataFrame, text: str = "text", times: float = 8.0) -> DataFrame:
    """Lengths (column ``length``) at which unfinished responses pile up: a length limit.

    Counted are distinct texts longer than a short answer. A spike holds as many more than the mean of the ten
    lengths around it as ``times`` the deviation by chance (the root of that mean, at least one).
    """
    unfinished = responses.where(~F.col(text).rlike(r"[.?!…][\"'”’»)\]\s]*$")).where(F.length(text) > SHORT_CHARS)
    counts = unfinished.groupBy(F.length(text).alias("length")).agg(F.count_distinct(F.xxhash64(text)).alias("n"))
    around = counts.select(F.explode(F.expr("sequence(length - 5, length + 5)")).alias("length"), F.col("n").alias("m"))
    mean = around.groupBy("length").agg(F.sum("m").alias("all"))
    expected = (F.col("all") - F.col("n")) / 10
    return counts.join(mean, "length").where(F.col("n") - expected >= times * F.sqrt(F.greatest(expected, F.lit(1.0)))).select("length")


def pair_defects(
    pairs: DataFrame, key: str, question: str, responses: dict[str, bool], labelled: DataFrame | None = None, evidence: bool = False
) -> DataFrame:
    """``key, field, defect``: one row per defective response, of at most one defect each.

    ``responses`` names the response columns and whether their absence is allowed. Defects are
    'empty' (null where not allowed, blank, or only a stand-in), 'refusal', 'copied', 'language' and
    'truncated', the first that holds in this order. A null question skips the rules that need one.
    ``labelled(text, lang)`` are texts with their languages, on a bounded sample of which the language rule
    is fitted; without them it is skipped. With ``evidence`` a column of that name says what told the defect:
    for 'truncated' a 'prefix', a 'limit', or the 'ending'. Repeated rows give repeated results; further
    columns are ignored.
    """
    ship(pairs.sparkSession)
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.lit(absent).alias("absent"), F.col(f"`{name}`").alias("text"))
        for name, absent in responses.items()
    ])
    long = pairs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{question}`").alias("question"), F.explode(fields).alias("r")).select(
        "id", "question", "r.field", "r.absent", "r.text"
    )
    keyed = long.withColumn("clean", _clean(F.col("text"))).withColumn("tail", tail(F.col("clean")))
    keyed = cut(keyed.withColumn("last", last_words(F.col("clean"), F.col("tail"))))
    texts = keyed.where("clean != ''").select("clean", "tail", "id").withColumn("s", _sentences(F.col("clean")))
    # A sentence that another one follows ends there, and so does a short answer that several questions have.
    known = texts.select(F.explode(F.expr("slice(s, 1, size(s) - 1)")).alias("key")).distinct()
    stock = texts.where((F.length("clean") <= SHORT_CHARS) & (F.size("s") == 1)).groupBy(F.col("tail").alias("key")).agg(
        F.min("id").alias("a"), F.max("id").alias("b")
    ).where("a < b").select("key")
    ends = texts.select(F.col("tail").alias("key")).distinct().join(known.unionByName(stock), "key", "left_anti")
    every = cut(texts.select(F.explode("s").alias("key")).distinct())
    lasts = cut(keyed.where("last IS NOT NULL").select(F.col("last").alias("key")).distinct())
    # Tails and last words are looked for apart: what begins a sentence may end a run of words.
    shortened = {"tail": shortened_keys(ends, every), "last": shortened_keys(lasts, _runs_of_words(every, lasts))}
    lengths = cut(limit_lengths(keyed).withColumnRenamed("length", "limit"))
    flagged = keyed
    for name, keys in shortened.items():
        # Many responses may be one text; equal hashes are compared.
        cuts = cut(keys.select(F.xxhash64("key").alias(f"{name}_hash"), F.col("key").alias(f"{name}_cut")).dropDuplicates([f"{name}_hash"]))
        flagged = hot_join(flagged.withColumn(f"{name}_hash", F.xxhash64(name)), cuts, [f"{name}_hash"], ["id", "field"])
    short = F.coalesce(F.col("tail_cut") == F.col("tail"), F.lit(False)) | F.coalesce(F.col("last_cut") == F.col("last"), F.lit(False))
    flagged = hot_join(flagged.withColumn("n", F.length("text")), lengths.withColumn("n", F.col("limit")), ["n"], ["id", "field"])
    model = None if labelled is None else fit(labelled)
    told = flagged.withColumn(
        "d", _defects(model)("question", "text", "absent", short, F.col("limit").isNotNull())
    )
    return told.where("d.defect IS NOT NULL").select(F.col("id").alias(key), "field", "d.defect", *(["d.evidence"] if evidence else []))
