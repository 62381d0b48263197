"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at the text's statistics and votes good (1), bad (-1) or abstains (0); most only ever accuse. No rule is
trusted as such: expectation-maximisation over the counts of vote patterns (at most 3 ** 7 rows, however many documents)
estimates how often each rule votes good, bad or not at all on good and on bad documents, and the share of good documents. What a rule
does as often on either is so found to say nothing. The posterior probability of a document is then a logistic function of its votes, each
weighed by its log likelihood ratio; it takes the place of a filter that all rules must pass. Priors are imagined votes and documents,
not bounds. Labels play no part.

Defined results: null is the empty text, which has no words and fails the base rules; repeated rows each
keep a row; a null id has a row; without documents the rates stay as assumed; extra columns are
ignored, or carried in a struct whatever they are called. Word windows are compared by their 64-bit hashes within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, carried, cut, words_of
from .spotsigs import COMMON

SYMBOLS = "#*$%&|<>"
#: How often a rule is assumed to vote right, to abstain and to vote wrong, and the imagined documents of each kind that stand for it; the like of good documents.
ASSUMED, VOTES = (0.45, 0.45, 0.1), 10.0
SHARE, DOCUMENTS = 0.8, 10.0
#: Estimation ends when no rate moves by more, or after so many rounds.
STILL, ROUNDS = 1e-9, 500


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows (carried, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_common, n_repeat_words), one for each row of docs; carried: the columns of `keep` in a struct."""
    text = F.col("__text")
    one = docs.select(carried(keep), F.coalesce(text_col, F.lit("")).alias("__text")).withColumn("__words", words_of(text))
    one = one.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    n = F.size("__words")
    word = lambda k: F.get("__words", k)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda k: F.xxhash64(word(k), word(k + 1), word(k + 2)))).otherwise(F.array().cast("array<bigint>"))
    two = one.select(
        "carried",
        n.cast("long").alias("n_words"),
        (F.length(text) - _without(text, SPACES)).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        F.size(F.filter("__words", lambda x: F.lower(x).isin(COMMON.split()))).cast("long").alias("n_common"),
        hashes.alias("__windows"),
    )
    # Only texts with a repeated window have their windows sorted by hash; equal ones are then neighbours.
    placed = F.sort_array(F.transform("__windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    empty = F.array().cast("array<struct<h:bigint,k:int>>")
    three = two.withColumn("__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed).otherwise(empty)).drop("__windows")
    same = lambda x, k: F.coalesce(F.get("__sorted", k)["h"] == x["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("__sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["k"]))
    four = three.withColumn("__again", again).drop("__sorted")
    # A repeated window covers three words, or those up to the next one's start.
    covered = F.transform("__again", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__again", k + 1) - x, F.lit(3))))
    return four.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).drop("__again")


def _vote(bad: Column, good: Column | None = None) -> Column:
    voted = F.when(bad, -1)
    return (voted if good is None else voted.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the columns of statistics()."""
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    symbols, copied, repeated, mean, upper, common = F.col("n_symbols") / words, F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words, F.col("word_chars") / words, F.col("n_upper") / chars, F.col("n_common") / words
    return {
        "symbols": _vote(symbols > 0.1),
        "copied_lines": _vote(copied > 0.3),
        "repeats": _vote(repeated > 0.2),
        # Running text has words of four to six letters, and one word in ten at least that holds sentences together.
        "word_length": _vote((mean < 3) | (mean > 10), mean.between(4.4, 6.5)),
        "common_words": _vote(common < 0.03, common >= 0.1),
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 100),
        "upper": _vote(upper > 0.5),
    }


#: Of a rule, for good and for bad documents: how often it votes bad, abstains, votes good.
Rates = list[tuple[tuple[float, ...], tuple[float, ...]]]
PRIOR = (ASSUMED[::-1], ASSUMED)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, Rates]:
    """(share of good documents, rates of each rule) by expectation-maximisation over (votes, documents)."""
    share, rates = SHARE, [PRIOR] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, seen = 0.0, [([VOTES * x for x in PRIOR[0]], [VOTES * x for x in PRIOR[1]]) for _ in rates]
        for votes, n in patterns:
            p = posterior(votes, share, rates)
            good += n * p
            for (on_good, on_bad), v in zip(seen, votes, strict=True):
                on_good[v + 1] += n * p
                on_bad[v + 1] += n * (1 - p)
        before = [share, *(x for r in rates for kind in r for x in kind)]
        share = (good + DOCUMENTS * SHARE) / (total + DOCUMENTS)
        rates = [tuple(tuple(x / sum(kind) for x in kind) for kind in r) for r in seen]
        if max(abs(a - b) for a, b in zip(before, [share, *(x for r in rates for kind in r for x in kind)], strict=True)) < STILL:
            break
    return share, rates


def weights(rates: Rates) -> list[tuple[float, ...]]:
    """Log likelihood ratios of each rule's bad vote, abstaining and good vote."""
    return [tuple(math.log(g / b) for g, b in zip(on_good, on_bad, strict=True)) for on_good, on_bad in rates]


def posterior(votes: tuple[int, ...], share: float, rates: Rates) -> float:
    x = math.log(share / (1 - share)) + sum(w[v + 1] for v, w in zip(votes, weights(rates), strict=True))
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def judge(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """statistics() with base_failed, the votes as v_<rule>, posterior (of good quality) and kept."""
    voted = cut(statistics(docs, keep, text_col).withColumns({f"v_{k}": v for k, v in rules().items()}))
    names = [f"v_{k}" for k in rules()]
    counted = voted.groupBy(*names).agg(F.count("*").alias("n")).collect()  # a row for each pattern of votes: 2187 at most
    share, rates = estimate(sorted((tuple(r[c] for c in names), r["n"]) for r in counted), len(names))
    told = [F.when(F.col(c) < 0, bad).when(F.col(c) == 0, none).otherwise(good) for c, (bad, none, good) in zip(names, weights(rates), strict=True)]
    x = sum(told, F.lit(math.log(share / (1 - share))))
    judged = voted.withColumn("posterior", 1 / (1 + F.exp(-x)))
    judged = judged.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
