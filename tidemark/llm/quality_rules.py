"""Weak supervision over quality rules, in DataFrame functions only.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains (0).
Expectation maximisation over the table of vote patterns estimates the share of good texts and
each rule's accuracy on good and on bad ones (of one or, where votes show it, several kinds); the posterior probability of "good" replaces a filter that asks every rule to pass. The pattern table has at most ``3 ** len(rules)`` rows whatever
the corpus, so only that table reaches the driver.

Null text counts as the empty text: all counts 0, every ratio rule abstains. An empty
table gives no rows (the prior accuracies stand in for estimates). Repeated rows are
judged alike, one output row each. A very long text is counted as a whole in its row. A
column of ``keep`` that clashes with an output column is replaced by it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, materialize, unclashed, words_of

SYMBOLS = "#*$%&|<>"
#: Columns that :func:`signals` adds.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stops")


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are conditions on the columns of :func:`signals`."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part), F.col(whole))


def default_rules() -> list[Rule]:
    return [
        Rule("length", lambda: F.col("n_words") >= 60, lambda: F.col("n_words") < 20),
        Rule("symbols", lambda: _share("n_symbols", "n_words") <= 0.05, lambda: _share("n_symbols", "n_words") > 0.25),
        Rule("repetition", lambda: (_share("n_repeat_words", "n_words") <= 0.2) & (_share("n_dup_lines", "n_lines") <= 0.3), lambda: (_share("n_repeat_words", "n_words") > 0.35) | (_share("n_dup_lines", "n_lines") > 0.5)),
        Rule("word_length", lambda: _share("word_chars", "n_words").between(3.0, 9.0), lambda: (_share("word_chars", "n_words") < 2) | (_share("word_chars", "n_words") > 14)),
        Rule("capitals", lambda: _share("n_upper", "word_chars") <= 0.15, lambda: _share("n_upper", "word_chars") > 0.4),
        Rule("stops", lambda: _share("n_stops", "n_words").between(0.02, 0.5), lambda: F.col("n_stops") == 0),
    ]


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def signals(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts of each whole text, without a shuffle.

    ``n_repeat_words`` packs a hash of every 3-word window with the window's place into one
    long, so that one primitive sort brings equal windows together. Places that share a hash
    are compared word by word; a text where a hash lied is counted again on the words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], t.alias("t"))
    df = df.withColumns({"w": words_of(F.col("t")), "lines": F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({"n": F.size("w"), "m": F.greatest(F.size("w") - 2, F.lit(0)), "b": F.length(F.bin(F.size("w").cast("long")))})
    right = lambda x: F.call_function("shiftright", x, F.col("b"))
    # the packed value keeps the hash above the b bits of the place
    packed = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.call_function("shiftleft", F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)), F.col("b")).bitwiseOR(i.cast("long")))
    df = df.withColumn("s", F.when(F.col("m") > 1, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")))
    same = lambda e, i: F.coalesce(right(F.get("s", i)) == right(e), F.lit(False))
    df = df.withColumn("d", F.filter("s", lambda e, i: F.when(i > 0, same(e, i - 1)).otherwise(False) | same(e, i + 1)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b")) - 1).cast("int")
    df = df.withColumn("p", F.transform("d", place))
    window_is = lambda a, c: (F.get("w", a) == F.get("w", c)) & (F.get("w", a + 1) == F.get("w", c + 1)) & (F.get("w", a + 2) == F.get("w", c + 2))
    lied = F.exists(
        F.sequence(F.lit(1), F.size("d") - 1),
        lambda i: (right(F.get("d", i)) == right(F.get("d", i - 1))) & ~window_is(F.get("p", i), F.get("p", i - 1)),
    )
    df = df.withColumn("lied", F.when(F.size("d") > 1, lied).otherwise(False))
    exact = F.array_sort(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.struct(F.concat_ws(" ", F.slice("w", i + 1, 3)).alias("x"), i.alias("i"))))
    df = df.withColumn("e", F.when(F.col("lied"), exact))
    again = F.transform(
        F.filter("e", lambda x, i: F.when(i > 0, F.get("e", i - 1)["x"] == x["x"]).otherwise(False) | F.coalesce(F.get("e", i + 1)["x"] == x["x"], F.lit(False))),
        lambda x: x["i"],
    )
    df = df.withColumn("q", F.when(F.col("lied"), again).otherwise(F.col("p")))
    covered = F.array_distinct(F.concat("q", F.transform("q", lambda x: x + 1), F.transform("q", lambda x: x + 2)))
    long = lambda c: c.cast("long")
    return df.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        long(F.col("n")).alias("n_words"),
        long(F.length(F.regexp_replace("t", BLANKS, ""))).alias("word_chars"),
        long(F.length("t") - _length_without(F.col("t"), SYMBOLS)).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(covered)).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.length("t") - _length_without(F.col("t"), UPPER)).alias("n_upper"),
        long(F.length("t") - _length_without(F.col("t"), ".?")).alias("n_stops"),
    )


def vote(rule: Rule) -> Column:
    return F.when(F.coalesce(rule.bad(), F.lit(False)), -1).when(F.coalesce(rule.good(), F.lit(False)), 1).otherwise(0)


@dataclass(frozen=True)
class LabelModel:
    """Shares of the kinds of texts, good ones first, then one or more kinds of bad ones; how often each rule that votes votes bad on each kind; and how much its vote counts."""

    shares: tuple[float, ...]
    rates: tuple[tuple[float, ...], ...]
    power: tuple[float, ...]

    @property
    def prior(self) -> float:
        return self.shares[0]

    def rate(self, rule: int, good: bool) -> float:
        """How often a rule's vote is bad on good texts, or on all bad ones."""
        own = range(1) if good else range(1, len(self.shares))
        return sum(self.shares[k] * self.rates[k][rule] for k in own) / sum(self.shares[k] for k in own)

    def weight(self, rule: int, cast: int) -> float:
        """What a vote that stands alone adds to the log odds of "good"."""
        g, b = self.rate(rule, True), self.rate(rule, False)
        return self.power[rule] * (math.log((1 - g) / (1 - b)) if cast > 0 else math.log(g / b) if cast < 0 else 0.0)


#: What is held before any vote, worth a few texts and votes, so that it fades as the corpus grows: the share of good texts, how often a rule blames them, how often it catches bad ones.
GOOD_SHARE, HELD_TEXTS = 0.8, 10.0
BLAMES, CATCHES, HELD_VOTES = 0.05, 0.5, 4.0
#: Share of two rules' greatest possible covariance, beyond what two classes explain, from which on they count as one; correlation of
#: two rules' bad votes among good texts that tells of another kind of bad ones; and texts in which both must at least be seen beyond chance.
COPIES, TOGETHER, LEAST_TEXTS = 0.7, 0.2, 20.0


def _em(cast: np.ndarray, bad: np.ndarray, counts: np.ndarray, power: np.ndarray, held: np.ndarray, shares: np.ndarray, rates: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of the kinds, the rules' rates on each, and each pattern's posterior."""
    held_shares = np.array([GOOD_SHARE, *[(1 - GOOD_SHARE) / (len(held) - 1)] * (len(held) - 1)])
    while True:
        logs = np.log(shares) + (bad * power) @ np.log(rates).T + ((cast - bad) * power) @ np.log1p(-rates).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        q, before = p * counts[:, None], np.concatenate([shares, rates.ravel()])
        shares = (q.sum(axis=0) + HELD_TEXTS * held_shares) / (counts.sum() + HELD_TEXTS)
        rates = (q.T @ bad + HELD_VOTES * held) / (q.T @ cast + HELD_VOTES)
        rounds -= 1
        if not rounds or np.abs(np.concatenate([shares, rates.ravel()]) - before).max() < 1e-9:
            return shares, rates, p


def _covariances(cast: np.ndarray, bad: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rules' bad votes, pair by pair over the texts on which both vote: number of these texts, covariance, and its greatest possible value."""
    both = (cast * weights[:, None]).T @ cast
    first = (bad * weights[:, None]).T @ cast / np.maximum(both, 1e-9)  # bad votes of i where j votes too
    spread = np.maximum(first * (1 - first), 1e-12)
    return both, (bad * weights[:, None]).T @ bad / np.maximum(both, 1e-9) - first * first.T, np.sqrt(spread * spread.T)


def _groups(cast: np.ndarray, bad: np.ndarray, counts: np.ndarray) -> list[int]:
    """Rules that nearly copy each other, by the same number.

    If rules vote apart within two classes, the covariance of i and j is that of i and k times that of j and l
    over that of k and l, for any other two. Where a pair's covariance exceeds the median of
    these by ``COPIES`` of its greatest possible value, the two count as one.
    """
    n = cast.shape[1]
    both, cov, most = _covariances(cast, bad, counts)
    group = list(range(n))
    for i in range(n):
        for j in range(i):
            others = [k for k in range(n) if k not in (i, j)]
            told = [cov[i, k] * cov[j, x] / cov[k, x] for k in others for x in others if k != x and cov[k, x] > 0.02 * most[k, x]]
            if told and cov[i, j] * both[i, j] >= LEAST_TEXTS and (cov[i, j] - np.median(told)) / most[i, j] >= COPIES:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def fit(patterns: Sequence[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 3000) -> LabelModel:
    """EM over (votes, count) with free rates of every rule on good and on bad texts; votes that abstain say nothing.

    Rules vote apart within a kind of texts. Pairs may show otherwise: rules that nearly copy each other
    count as one, each for its share. And where two rules' bad votes still go together among the
    texts found good, another kind of bad texts is added, on which these rules vote bad, and all is estimated again.
    """
    votes = np.array([v for v, _ in patterns], float).reshape(len(patterns), n_rules)
    counts = np.array([c for _, c in patterns], float)
    cast, bad = (votes != 0).astype(float), (votes < 0).astype(float)
    group = _groups(cast, bad, counts)
    power = np.array([1 / group.count(g) for g in group])
    held = np.repeat([[BLAMES], [CATCHES]], n_rules, 1)
    shares, rates = np.array([GOOD_SHARE, 1 - GOOD_SHARE]), held
    while True:
        shares, rates, p = _em(cast, bad, counts, power, held, shares, rates, rounds)
        both, cov, most = _covariances(cast, bad, p[:, 0] * counts)
        more = [j for j in range(n_rules) if any(group[i] != group[j] and cov[i, j] * both[i, j] >= LEAST_TEXTS and cov[i, j] >= TOGETHER * most[i, j] for i in range(n_rules))]
        if not more or len(shares) > n_rules:
            return LabelModel(tuple(shares.tolist()), tuple(map(tuple, rates.tolist())), tuple(power.tolist()))
        held = np.vstack([held, np.where(np.isin(np.arange(n_rules), more), CATCHES, BLAMES)])
        shares, rates = np.append(shares * 0.95, 0.05), np.vstack([rates, held[-1]])


def posterior(votes: Sequence[Column], model: LabelModel) -> Column:
    def likelihood(kind: int) -> Column:
        log = F.lit(math.log(model.shares[kind]))
        for v, rate, power in zip(votes, model.rates[kind], model.power):
            log = log + F.when(v > 0, power * math.log1p(-rate)).when(v < 0, power * math.log(rate)).otherwise(0.0)
        return F.exp(log)

    good = likelihood(0)
    return good / sum([likelihood(k) for k in range(1, len(model.shares))], good)


def apply(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts, one ``vote_<rule>`` a rule, ``quality`` (posterior) and ``accepted`` (quality >= threshold)."""
    rules = list(rules or default_rules())
    names = [f"vote_{r.name}" for r in rules]
    own = unclashed(keep, *COUNTS, *names, "quality", "accepted")
    seen = materialize(signals(docs, text, own), "quality-signals")
    voted = seen.withColumns({n: vote(r) for n, r in zip(names, rules)})
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    model = fit(patterns, len(rules))
    return voted.withColumn("quality", posterior([F.col(n) for n in names], model)).withColumn("accepted", F.col("quality") >= threshold)
