"""Languages by character statistics, fitted on labelled texts.

A language is the frequencies of its runs of three letters, without case and accents, so that texts
written without their diacritics keep their language. How a language's own texts score under it is
measured too: a text that scores far below that is in another language, known or not.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts of each language, and languages, that are fitted; the texts are a share of their hashes, the languages the most frequent.
SAMPLE, LANGUAGES = 400, 32
#: A label with fewer texts than this is not fitted.
LEAST_TEXTS = 20
#: Letters of a text from which its language is judged.
LEAST_LETTERS = 24
#: A text is in another language if that one is so much likelier (in all, in nats), or if the mean falls so many
#: deviations below the usual, twice as many where no other language is likelier.
LEAD, DEVIATIONS = 8.0, 7.0
_SLOTS = 1 << 16
_PIECE = 80


def _letters() -> np.ndarray:
    """For every code point up to 0xFFFF the small base letter, or a space (32) for what is no letter."""
    out = np.full(0x10000, 32, np.uint32)
    for code in range(0x10000):
        ch = chr(code)
        if not 0xD800 <= code <= 0xF8FF and ch.isalpha():
            base = unicodedata.normalize("NFD", ch.lower())[0]
            out[code] = ord("l") if base == "ł" else ord(base) if ord(base) < 0x10000 else code
        elif unicodedata.combining(ch):
            out[code] = 0
    return out


_LETTERS = _letters()


def slots(text: str) -> np.ndarray:
    """The hashed runs of three letters of a text; a word ends in a space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _LETTERS[np.minimum(codes, 0xFFFF)]
    low = low[low != 0]
    if not len(low):
        return low
    low = np.concatenate([[np.uint32(32)], low[(low != 32) | np.concatenate([[True], low[:-1] != 32])], [np.uint32(32)]]).astype(np.uint32)
    if len(low) < 3:
        return low[:0]
    mixed = (low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(_SLOTS - 1)


class Model:
    """Log frequencies per language, with the usual mean and deviation of a language's own texts."""

    def __init__(self, texts: list[str], labels: list[str]):
        self._fit(texts, labels)
        labels = self._merged(texts, labels)
        self._fit(texts, labels)
        # A second round without the texts that the first one takes for another language: labels may be wrong.
        kept = [self.best(t) in (None, x) for t, x in zip(texts, labels)]
        self._fit([t for t, k in zip(texts, kept) if k], [x for x, k in zip(labels, kept) if k])

    def _merged(self, texts: list[str], labels: list[str]) -> list[str]:
        """The labels, with a rarer name of the same language replaced: one whose texts are usual under a more frequent label."""
        size = {n: labels.count(n) for n in self.names}
        names = sorted(self.names, key=lambda n: (-size[n], n))
        alias: dict[str, str] = {}
        for i, name in enumerate(names):
            own = np.array([self.scores(t)[0] for t, x in zip(texts, labels) if x == name])
            for other in names[:i]:
                k = self.names.index(other)
                if other not in alias and np.median((self.mean[k] - own[:, k]) / self.deviation[k]) < 2:
                    alias[name] = other
                    break
        return [alias.get(x, x) for x in labels]

    def _fit(self, texts: list[str], labels: list[str]) -> None:
        self.names = sorted({x for x in labels})
        counts = np.zeros((max(1, len(self.names)), _SLOTS))
        for text, label in zip(texts, labels):
            at = slots(text)
            counts[self.names.index(label)] += np.bincount(at, minlength=_SLOTS)
        smooth = counts + 0.1
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)
        own: dict[str, list[float]] = {}
        for text, label in zip(texts, labels):
            at = slots(text)
            for i in range(0, len(at) - _PIECE + 1, _PIECE):
                scores = self.table[:, at[i : i + _PIECE]].mean(axis=1)
                own.setdefault(label, []).append(float(scores[self.names.index(label)]))
        # The middle half, so that texts with a wrong label do not widen it.
        quarters = [np.quantile(own.get(n, [0.0]), [0.25, 0.5, 0.75]) for n in self.names]
        self.mean = np.array([q[1] for q in quarters])
        self.deviation = np.array([max((q[2] - q[0]) / 1.35, 0.05) for q in quarters])

    def scores(self, text: str) -> tuple[np.ndarray, int]:
        at = slots(text)
        return (self.table[:, at].mean(axis=1) if len(at) else np.zeros(len(self.table), np.float32)), len(at)

    def best(self, text: str) -> str | None:
        """The likeliest language, if the text is long enough and it leads clearly."""
        scores, n = self.scores(text)
        if n < LEAST_LETTERS or not self.names:
            return None
        order = np.argsort(-scores)
        if len(order) > 1 and (scores[order[0]] - scores[order[1]]) * n < LEAD:
            return None
        return self.names[order[0]]

    def differs(self, question: str, text: str) -> bool:
        """Whether a text is not in the language of the question."""
        wanted = self.best(question)
        if wanted is None:
            return False
        scores, n = self.scores(text)
        if n < LEAST_LETTERS:
            return False
        q, best = self.names.index(wanted), int(scores.argmax())
        below = (self.mean[q] - scores[q]) / (self.deviation[q] * max(0.5, (_PIECE / n) ** 0.5))
        if best != q:
            return below > DEVIATIONS or below > 2 and (scores[best] - scores[q]) * n > LEAD
        return below > 2 * DEVIATIONS


def fit(labelled: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model from about SAMPLE texts, and no more, of each of the LANGUAGES most frequent labels; labels are compared without case.

    Null and empty texts and labels are left out; without a usable label the model knows no language.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.lower(F.trim(F.col(f"`{label}`"))).alias("label")).where("length(text) > 0 AND length(label) > 0")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS).orderBy(F.desc("n"), "label").limit(LANGUAGES)
    # A fixed share of the hashes of each label, at most LANGUAGES rows, so that no texts are sorted or shuffled.
    share = sizes.select("label", (F.lit(float(SAMPLE)) / F.col("n") * (1 << 30)).cast("long").alias("upto"))
    taken = rows.join(F.broadcast(share), "label").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("upto"))
    # Copies of a text share its hash: one of them is enough, and all of them may be a third of the rows.
    taken = taken.groupBy("label", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))
    found: list[tuple[str, str]] = []
    for name, text_ in sorted((r["label"], r["text"]) for r in taken.select("label", "text").collect()):
        if sum(x == name for _, x in found[-SAMPLE:]) < SAMPLE:
            found.append((text_, name))
    return Model([t for t, _ in found], [x for _, x in found])
