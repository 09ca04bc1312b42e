"""Quality by weak supervision: rules vote or abstain, and what they are worth is learned without labels.

Every rule looks at one statistic of the whole text. It votes for good text below or
above one bound, against it beyond another, and abstains between the two. A document
is then a pattern of votes, of which there are at most 3 ** len(RULES), so the counts
of patterns over all documents are all that expectation-maximisation needs: they are
counted by Spark and the iterations run over that small table. The result is, for each
rule, how it votes on good and on bad text, the share of good text, and for
each pattern the posterior probability of good text. That probability decides, in
place of a rule that all tests must be passed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
SENTENCE_ENDS = tuple(".!?:;…\"'”»。！？")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Besides COUNTS: distinct words, words with a letter, lines with a word, those that end a sentence, capitals, digits.
MORE = ("n_distinct", "n_letter_words", "n_lines", "n_ended_lines", "n_capitals", "n_digits")

GOOD, BAD, ABSTAIN = 1, 0, 2
MIN_WORDS, MAX_REPEAT = 50, 50
ROUNDS, SETTLED = 500, 1e-9
#: Chances of a vote against, for and an abstention on bad and on good text before anything is seen, worth STRENGTH
#: documents. They say which class is the good one: a rule seldom votes against good text.
PRIOR, PRIOR_GOOD, STRENGTH = ((0.3, 0.5, 0.2), (0.02, 0.78, 0.2)), 0.8, 10.0
KEEP = 0.5

#: (name, statistic over a base, good from .. to, bad below, bad above); a base of 0 gives no vote.
RULES = (
    ("length", "n_words", None, (100, 100_000), 50, 200_000),
    ("word_length", "word_chars", "n_words", (3.5, 7.0), 3.0, 10.0),
    ("symbols", "n_symbols", "n_words", (0.0, 0.02), None, 0.1),
    ("repeated_lines", "n_dup_lines", "n_lines", (0.0, 0.1), None, 0.3),
    ("repeated_words", "n_repeat_words", "n_words", (0.0, 0.1), None, 0.3),
    ("distinct_words", "n_distinct", "n_words", (0.3, 1.0), 0.15, None),
    ("letters", "n_letter_words", "n_words", (0.85, 1.0), 0.7, None),
    ("sentences", "n_ended_lines", "n_lines", (0.6, 1.0), 0.1, None),
    ("capitals", "n_capitals", "word_chars", (0.0, 0.1), None, 0.3),
    ("digits", "n_digits", "word_chars", (0.0, 0.1), None, 0.25),
)


def text_counts(text: str, ids: dict[str, int] | None = None) -> tuple[int, ...]:
    """COUNTS and MORE of a text. ``ids`` may be shared by texts; it only saves work."""
    words = WORD.findall(text)
    if not words:
        return (0,) * (len(COUNTS) + len(MORE))
    known = {} if ids is None else ids
    places = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = 0
    if len(words) >= 3:
        # Words numbered within the text: three numbers fit one key for up to 2 ** 21 distinct words.
        distinct, own = np.unique(places, return_inverse=True)
        pairs = np.unique(own[:-2] * len(distinct) + own[1:-1], return_inverse=True)[1]
        windows = pairs * len(distinct) + own[2:]
        _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(len(words), bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        repeated = int(covered.sum())
    else:
        distinct = np.unique(places)
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated,
        len(distinct), sum(w.isalpha() or any(map(str.isalpha, w)) for w in words), len(lines),
        sum(line.rstrip().endswith(SENTENCE_ENDS) for line in lines), sum(map(str.isupper, text)), sum(map(str.isdigit, text)),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: dict[str, int] = {}
    for batch in batches:
        if len(ids) > 500_000:
            ids.clear()
        found = [text_counts(t or "", ids) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [
            pa.array([], pa.int64()) for _ in COUNTS + MORE
        ]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *COUNTS, *MORE])


def vote(rule: tuple) -> Column:
    """GOOD, BAD or ABSTAIN."""
    _, statistic, base, (low, high), below, above = rule
    value = F.col(statistic).cast("double")
    value = value if base is None else F.try_divide(value, F.col(base).cast("double"))
    bad = F.lit(False)
    if below is not None:
        bad = bad | (value < below)
    if above is not None:
        bad = bad | (value > above)
    voted = F.when(bad, BAD).when(value.between(low, high), GOOD).otherwise(ABSTAIN)
    return F.when(value.isNull(), ABSTAIN).otherwise(voted)


def pattern(rules: tuple = RULES) -> Column:
    """The votes as digits of a number to base 3, the first rule's first."""
    found = F.lit(0)
    for rule in rules:
        found = found * 3 + vote(rule)
    return found.cast("int")


@dataclass(frozen=True)
class LabelModel:
    """``chances[y][j][v]``: how often rule j votes v (BAD, GOOD, ABSTAIN) on text of class y (BAD, GOOD)."""

    good: float
    chances: np.ndarray

    def weights(self) -> np.ndarray:
        """Per rule and vote, what the vote adds to the log odds of good text."""
        return np.log(self.chances[GOOD]) - np.log(self.chances[BAD])

    def start(self) -> float:
        return float(np.log(self.good) - np.log1p(-self.good))


def votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(rules - 1, -1, -1) % 3


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int) -> LabelModel:
    """Expectation-maximisation over counted patterns, from and with the prior."""
    votes, counts = votes_of(patterns, rules), counts.astype(float)
    prior = np.repeat(np.array(PRIOR)[:, None, :], rules, axis=1)
    model = LabelModel(PRIOR_GOOD, prior)
    for _ in range(ROUNDS):
        odds = model.start() + model.weights()[np.arange(rules), votes].sum(1)
        posterior = 0.5 + 0.5 * np.tanh(odds / 2)
        found = np.stack([
            np.stack([((1 - posterior) * counts) @ (votes == v) for v in (BAD, GOOD, ABSTAIN)], axis=1),
            np.stack([(posterior * counts) @ (votes == v) for v in (BAD, GOOD, ABSTAIN)], axis=1),
        ]) + STRENGTH * prior
        share = float((counts @ posterior + STRENGTH * PRIOR_GOOD) / (counts.sum() + STRENGTH))
        settled = abs(share - model.good) < SETTLED
        model = LabelModel(share, found / found.sum(2, keepdims=True))
        if settled:
            break
    return model


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: float = KEEP, rules: tuple = RULES) -> DataFrame:
    """One row per document: key, COUNTS, base_failed, votes, p_good, kept.

    ``base_failed``: fewer than MIN_WORDS words, or more than MAX_REPEAT per cent of
    them in repeated windows; such a document is not kept and does not teach the
    chances. A null or empty text has no words and fails. Repeated rows are judged
    alike, a null key is a value like others, other columns are not read; no rows in,
    none out. ``votes`` has a digit per rule: 1 for, 0 against, 2 abstained.
    """
    narrow = docs.select(F.col(key).alias("row"), F.col(text).alias("text"))
    kind = narrow.schema["row"].dataType.simpleString()
    counted = narrow.mapInArrow(_count, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS + MORE))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    counted = cut(counted.select("row", *COUNTS, failed.alias("base_failed"), pattern(rules).alias("pattern")))
    # At most 3 ** len(rules) rows. What has failed is decided: the rest is to be told apart.
    table = counted.filter("not base_failed").groupBy("pattern").count().toPandas().sort_values("pattern")
    model = fit(table["pattern"].to_numpy(np.int64), table["count"].to_numpy(), len(rules))
    return _judged(counted, model, len(rules), keep).withColumnRenamed("row", key)


def _judged(counted: DataFrame, model: LabelModel, rules: int, keep: float) -> DataFrame:
    """The posterior as a column expression over the digits of the pattern."""
    odds, digits = F.lit(model.start()), []
    for j, weights in enumerate(model.weights().tolist()):
        digit = F.floor(F.col("pattern") / 3 ** (rules - 1 - j)).cast("int") % 3
        digits.append(digit.cast("string"))
        odds = odds + F.element_at(F.array(*(F.lit(w) for w in weights)), digit + 1)
    p_good = 1 / (1 + F.exp(-odds))
    return counted.select(
        "row", *COUNTS, "base_failed", F.concat(*digits).alias("votes"), p_good.alias("p_good")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))
