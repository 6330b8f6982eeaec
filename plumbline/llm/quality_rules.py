"""Quality by weak supervision: rules vote or abstain, EM finds how far to trust each, the posterior decides.

Every text is measured once (one pass, no shuffle). Each rule turns the measures into a vote: 1 good, -1 bad, 0 abstain. The
votes of a document are one of 3^8 patterns; only the patterns' counts (at most 6,561 rows, whatever the input) go to the driver,
where expectation-maximisation fits the share of good documents and how each rule votes on good and on bad ones, which is its accuracy. The
posteriors come back as a table of that bounded size.

Edge cases: a null text counts as empty (no words, base_failed); very long texts are measured whole; documents with one vote pattern tie with one posterior, so all or none of them stay; repeated rows each get their own row; an empty table gives an
empty result; further columns are carried through by ``keep_good`` and ignored by ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, map_arrow

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_letters", "n_shouts")
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", '"', ":", ";")
#: So many documents is what EM starts from worth; it only counts in small tables.
WEIGHT = 10


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds = len(seen)
    pair = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * kinds + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    covered[1:] |= twice[:-1]
    covered[2:] |= twice[:-2]
    return int(covered.sum())


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    octets = np.frombuffer(raw, np.uint8)
    upper = int(((octets >= 65) & (octets <= 90)).sum())
    lower = int(((octets >= 97) & (octets <= 122)).sum())
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        sum(x.rstrip(SPACE).endswith(ENDS) for x in lines),
        upper,
        upper + lower,
        text.count("!!"),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs with the measures of their texts as longs; the text itself goes only if the caller drops it."""
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", _plumb_{m} bigint" for m in MEASURES)

    def rows(batch: pa.RecordBatch) -> dict:
        found = [measures(x) for x in batch.column(names.index(text)).to_pylist()]
        return dict(zip(names, batch.columns, strict=True)) | {f"_plumb_{m}": [x[k] for x in found] for k, m in enumerate(MEASURES)}

    return map_arrow(docs, rows, schema)


def base_failed(m=lambda name: F.col(f"_plumb_{name}")) -> Column:
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def rules(m=lambda name: F.col(f"_plumb_{name}")) -> dict[str, Column]:
    """Each rule's vote. A ratio over nothing is null and so an abstention."""

    def vote(value: Column, good: Column, bad: Column) -> Column:
        return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)

    def ratio(a: str, b: str) -> Column:
        return m(a) / F.when(m(b) > 0, m(b))

    length, mean = m("n_words"), ratio("word_chars", "n_words")
    symbols, lines, repeats = ratio("n_symbols", "n_words"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words")
    ended, capitals, shouts = ratio("n_ended_lines", "n_lines"), ratio("n_upper", "n_letters"), ratio("n_shouts", "n_words")
    return {
        "length": vote(length, length >= 50, length < 30),
        "word_length": vote(mean, mean.between(3.5, 7), (mean < 2.5) | (mean > 12)),
        "symbols": vote(symbols, symbols < 0.03, symbols > 0.1),
        "lines": vote(lines, lines < 0.35, lines > 0.5),
        "repeats": vote(repeats, repeats < 0.3, repeats > 0.45),
        "ends": vote(ended, ended > 0.8, ended < 0.3),
        "capitals": vote(capitals, capitals < 0.15, capitals > 0.3),
        "shouts": vote(shouts, shouts < 0.01, shouts > 0.05),
    }


@dataclass(frozen=True)
class LabelModel:
    """prior: the share of good documents; shares[c][r][v + 1]: how often rule r votes v on bad (c = 0) and on good (c = 1) ones."""

    prior: float
    shares: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        log = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for r in range(votes.shape[1]):
            log += np.log(self.shares[1][r][votes[:, r] + 1] / self.shares[0][r][votes[:, r] + 1])
        return 1 / (1 + np.exp(-np.clip(log, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each rule is right where it doesn't abstain, on bad and on good documents."""
        right = np.stack((self.shares[0][:, 0], self.shares[1][:, 2]))
        return right / np.stack((self.shares[0][:, [0, 2]].sum(axis=1), self.shares[1][:, [0, 2]].sum(axis=1)))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the patterns without a vote against as good. A rule counts as better than chance: its votes against are held to
    be at least as frequent on bad documents as on good ones, and its votes for the other way round. Patterns are sorted first, so
    that the result doesn't hang on the order in which they arrive.
    """
    width = votes.shape[1]
    start = np.array([[0.4, 0.2, 0.4], [0.05, 0.2, 0.75]])
    model = LabelModel(0.8, np.repeat(start[:, None, :], width, axis=1))
    if not len(votes):
        return model
    order = np.lexsort(votes.T)
    votes, counts = votes[order], counts[order].astype(float)
    good = counts * np.where((votes == -1).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        shares = np.stack([[[(w @ (votes[:, r] == v) + WEIGHT * s[v + 1]) / (w.sum() + WEIGHT) for v in (-1, 0, 1)] for r in range(width)] for w, s in ((counts - good, start[0]), (good, start[1]))])
        for side, better in ((0, 0), (2, 1)):
            pooled = shares[:, :, side].mean(axis=0)
            wrong = shares[better, :, side] < shares[1 - better, :, side]
            shares[:, wrong, side] = pooled[wrong]
        shares /= shares.sum(axis=2, keepdims=True)
        new = LabelModel(float(np.clip((good.sum() + 0.8 * WEIGHT) / (counts.sum() + WEIGHT), 0.02, 0.98)), shares)
        still = np.abs(new.shares - model.shares).max() < tolerance
        model = new
        if still:
            break
        good = counts * model.posterior(votes)
    return model


def judge(measured: DataFrame) -> tuple[DataFrame, LabelModel]:
    """Adds _plumb_failed, _plumb_quality (the posterior) and _plumb_kept to measured rows, which should be a written table."""
    votes = rules()
    coded = F.lit(0)
    for v in votes.values():
        coded = coded * 3 + v + 1
    measured = measured.withColumn("_plumb_pattern", coded.cast("int"))
    open_ = F.sum(F.when(base_failed(), 0).otherwise(1)).alias("open")  # what fails the base is decided and teaches nothing about the rest
    found = measured.groupBy("_plumb_pattern").agg(open_).collect()  # 3^8 rows at most
    codes = np.array([r["_plumb_pattern"] for r in found], dtype=np.int64)
    table = codes[:, None] // 3 ** np.arange(len(votes))[::-1] % 3 - 1 if len(codes) else np.zeros((0, len(votes)), np.int64)
    model = fit(table, np.array([r["open"] for r in found], dtype=np.int64))
    rows = [(int(c), float(p)) for c, p in zip(codes, model.posterior(table), strict=True)]
    posteriors = measured.sparkSession.createDataFrame(rows, "_plumb_pattern int, _plumb_quality double")
    out = measured.join(F.broadcast(posteriors), "_plumb_pattern", "left").withColumn("_plumb_failed", base_failed())
    return out.withColumn("_plumb_kept", ~F.col("_plumb_failed") & (F.col("_plumb_quality") >= 0.5)), model


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their columns as they were.

    The rows are written once with their measures, so that texts aren't measured again after the rules are weighed.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    judged, _ = judge(scratch.write(measure(docs, text)))
    return judged.where("_plumb_kept").select(*docs.columns)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: key, the measures, base_failed, quality, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    judged, _ = judge(scratch.write(measure(docs.select(key, text), text).drop(text)))
    return judged.select(key, *(F.col(f"_plumb_{m}").alias(m) for m in MEASURES), *(F.col(f"_plumb_{a}").alias(b) for a, b in (("failed", "base_failed"), ("quality", "quality"), ("kept", "kept"))))
