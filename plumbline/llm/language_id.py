"""Language by cross-parsing: the language whose labelled text explains a text in the fewest phrases wins.

For each language a suffix automaton is built over a bounded sample of its labelled text. A word (with a blank on either side)
is read along the automaton as far as it goes: that is the longest match from there on and makes one phrase; the next begins
where it broke off. A text's cost is the number of phrases of its words for each letter; a phrase weighs the same in every language (log2 of the size of the largest sample would be its code's
length), so a label with a word or two of text explains little and wins nothing. Phrases end at words, so equal words cost the same and are parsed once per worker; a parse of whole texts, across blanks, takes a step in
each automaton for every letter of the corpus, about twice the CPU (README).

What is learned is bounded by parameters: every label counts, and for each whole texts until they have ``SAMPLE_CHARS`` characters (less where that would make more than ``ALL_CHARS``, but a text at least), those of ``LONG``
characters and more only where there are no others. Which texts are taken follows from their hashes, not from where they stand. A label whose texts have no letter is not learned.

Edge cases: text null or without a letter: ``und`` with score 0; no learned language: ``und``; one learned language: score 1; ties go to
the language first by code point; a null doc_id is neither learned from nor held out; very long texts are predicted from the whole; repeated rows each get a row; further columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_arrow

SAMPLE_CHARS = 45_000
LONG = 20_000
ALL_CHARS = 9_000_000
#: Texts of a label that are looked at where hashes choose among them.
ENOUGH = 200
TABLE_SIZE = 300_000
SPAN = 1 << 30


class SuffixAutomaton:
    """Transitions of the least automaton that accepts every substring of a text; state 0 is the start."""

    def __init__(self, text: str):
        self.size = len(text)
        self.next: list[dict[str, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def phrases(self, text: str) -> int:
        """Longest matches that make up the text, one after another; a letter that never occurs is a phrase of its own."""
        following, state, count = self.next, 0, 0
        for c in text:
            after = following[state].get(c)
            if after is None:
                count += state != 0
                after = following[0].get(c, 0)
                count += after == 0
            state = after
        return count + (state != 0)


def only_letters(word: str) -> str:
    return "".join([c for c in word if c.isalpha()]).lower()


@dataclass
class Model:
    languages: list[str]
    samples: list[str]

    def __post_init__(self) -> None:
        self.automata = [SuffixAutomaton(" " + " ".join(filter(None, map(only_letters, s.split()))) + " ") for s in self.samples]
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.costs: np.ndarray = np.zeros((1024, len(self.languages)))
        self.letters: np.ndarray = np.zeros(1024, np.int64)

    def _add(self, raw: bytes) -> int:
        word, place = only_letters(raw.decode("utf-8", "surrogatepass")), len(self.places)
        if place == len(self.letters):
            self.costs, self.letters = np.concatenate((self.costs, np.zeros_like(self.costs))), np.concatenate((self.letters, np.zeros_like(self.letters)))
        if word:
            self.costs[place] = [a.phrases(f" {word} ") for a in self.automata]
        self.letters[place] = len(word)
        self.places[raw] = place
        return place

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        if len(self.places) > TABLE_SIZE:
            self._clear()
        get, add = self.places.get, self._add
        at = [p if (p := get(w)) is not None else add(w) for w in text.encode("utf-8", "surrogatepass").split()]
        letters = int(self.letters[at].sum()) if at else 0
        if not letters:
            return "und", 0.0
        cost = self.costs[at].sum(axis=0) / letters
        best = int(np.argmin(cost))
        if len(cost) == 1:
            return self.languages[0], 1.0
        second = float(np.partition(cost, 1)[1])
        return self.languages[best], second / (second + float(cost[best]))


def is_held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> tuple[list[str], list[str]]:
    """Learned languages and their samples, from labelled documents that aren't held out.

    Labels are counted first; then each language's texts with the smallest hashes are taken, up to a threshold that leaves more than the bound asks for, and cut to the bound
    by whole texts. What comes to the driver is a sample of SAMPLE_CHARS characters and one text more for each label.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~is_held_out(F.col(key), folds))
    size, long = F.length(text), F.length(text) >= LONG
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), size.alias("n"), long.alias("long"), F.pmod(F.xxhash64(text), F.lit(SPAN)).alias("h"))
    counts = known.groupBy("lang", "long").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).collect()
    if not counts:
        return [], []
    bound = min(SAMPLE_CHARS, ALL_CHARS // len({r["lang"] for r in counts}))
    # texts of a language in reach: six times the bound as hashes fall, so that cutting by whole texts never runs short, and some hundred at least
    reach = {(r["lang"], r["long"]): min(SPAN, max(6 * SPAN * bound // r["chars"], ENOUGH * SPAN // r["rows"])) for r in counts}
    limits = [F.create_map(*(x for (k, own), n in reach.items() if own == kind for x in (F.lit(k), F.lit(n)))) if any(own == kind for _, own in reach) else F.create_map(F.lit(""), F.lit(0)) for kind in (False, True)]
    few = known.where(F.col("h") < F.coalesce(F.when(F.col("long"), limits[1][F.col("lang")]).otherwise(limits[0][F.col("lang")]), F.lit(0)))
    before = Window.partitionBy("lang").orderBy("long", "h", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = few.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("ahead") < max(1, bound)).select("lang", "ahead", "text").collect()
    samples: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["ahead"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return list(samples), [" ".join(x) for x in samples.values()]


_models: dict[str, Model] = {}


def predict(docs: DataFrame, languages: list[str], samples: list[str], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of each row with lang_pred and score. Only the text is looked at."""
    kinds = dict(docs.dtypes)
    name = hashlib.sha256(repr((languages, samples)).encode("utf-8", "surrogatepass")).hexdigest()
    sent = docs.sparkSession.sparkContext.broadcast((languages, samples))  # bounded by SAMPLE_CHARS and the number of labels

    def rows(batch: pa.RecordBatch) -> dict:
        if name not in _models:
            _models.clear()
            _models[name] = Model(*sent.value)
        found = [_models[name].predict(x) for x in batch.column(len(keep)).to_pylist()]
        return {k: batch.column(i) for i, k in enumerate(keep)} | {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    return map_arrow(docs.select(*keep, text), rows, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, lang_pred and score for each document."""
    out = predict(docs, *fit(docs, key), [key])
    return out.select(key, F.coalesce(is_held_out(F.col(key)), F.lit(False)).alias("held_out"), "lang_pred", "score")
