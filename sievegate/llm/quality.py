"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, a posterior."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import map_batches, without
from sievegate.session import shared_dir

WORDS = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
LETTERS = re.compile(r"[^\W\d_]")
SPACES = " \t\n\x0b\x0c\r"
FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "n_lines long, n_upper long, n_distinct long, n_plain long, n_stutter long, n_window_words long, n_window_distinct long")
#: Words of a window in which different words are counted.
WINDOW = 100


def window_vocabulary(words: list[str]) -> tuple[int, int]:
    """Words and different words, summed over windows of `WINDOW` words.

    The share of different words falls with the length of any text; within windows of one length it
    does not. The last window ends with the text and takes words of the one before to be full.
    """
    starts = range(0, len(words), WINDOW)
    windows = [words[low:low + WINDOW] for low in (min(at, max(0, len(words) - WINDOW)) for at in starts)]
    return sum(map(len, windows)), sum(len(set(w)) for w in windows)


def text_features(text: str) -> tuple[int, ...]:
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        marked = bytearray(len(words))
        for i, window in enumerate(windows):
            if counts[window] > 1:
                marked[i:i + 5] = b"\x01\x01\x01\x01\x01"
        repeated = sum(marked)
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated, len(lines),
        sum(w.isupper() and len(w) > 1 for w in words), len(set(words)),
        sum(w.strip(".,;:!?\"'()").isalpha() for w in words),
        sum(a.strip(".,;:!?").lower() == b.strip(".,;:!?").lower() for a, b in zip(words, words[1:])),
        *window_vocabulary(words),
    )


def vote(bad: Column, good: Column) -> Column:
    """-1 where a rule finds fault, 1 where it finds the text sound, 0 where it abstains."""
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """One vote per rule; a rule abstains where its figure says little."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    part = lambda c: F.col(c) / words
    length = F.col("word_chars") / words
    return {
        "length": vote(F.col("n_words") < 10, F.lit(False)),
        "word_length": vote((length < 2.5) | (length > 14), F.lit(False)),
        "symbols": vote(part("n_symbols") > 0.1, part("n_symbols") < 0.01),
        "lines": vote(F.col("n_dup_lines") > 0.3 * F.col("n_lines"), F.lit(False)),
        "repeats": vote(part("n_repeat_words") > 0.2, part("n_repeat_words") < 0.02),
        "capitals": vote(part("n_upper") > 0.3, part("n_upper") < 0.05),
        "vocabulary": vote(F.col("n_window_distinct") < 0.4 * F.col("n_window_words"), F.lit(False)),
        "stutter": vote(part("n_stutter") > 0.2, part("n_stutter") < 0.05),
        "plain_words": vote(part("n_plain") < 0.75, part("n_plain") > 0.9),
        "density": vote(F.col("n_symbols") > 0.05 * F.col("word_chars"), F.col("n_symbols") < 0.002 * F.col("word_chars")),
    }


def estimate(
    votes: np.ndarray, weight: np.ndarray, rounds: int = 200, slips: float = 0.01,
) -> tuple[float, np.ndarray]:
    """Share of good texts and P(vote | class) of each rule, by expectation-maximisation.

    `votes` has one row per pattern of votes and `weight` its documents. Starts from the majority
    of each pattern. A rule that would say the opposite of its votes counts as knowing nothing, and
    each is taken to blame a share of `slips` of the texts besides, so that no single vote decides
    against all others. An abstention is no evidence. Returns probabilities as [class, rule, vote + 1], class 1 being good.
    """
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    good = np.where((votes < 0).any(axis=1), 0.1, 0.95)
    table = np.full((2, votes.shape[1], 3), 1 / 3)
    prior = 0.5
    for _ in range(rounds):
        parts = np.stack([(1 - good) * weight, good * weight])
        prior = float((parts[1].sum() + 1) / (weight.sum() + 2))
        counts = np.einsum("cp,prv->crv", parts, hot) + 0.5
        counts[:, :, 0] += slips * weight.sum()
        table = counts / counts.sum(axis=2, keepdims=True)
        turned = table[0, :, 0] < table[1, :, 0]
        table[:, turned] = (counts.sum(axis=0) / counts.sum(axis=(0, 2))[:, None])[turned]
        new = posterior(prior, table, hot)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return prior, table


def posterior(prior: float, table: np.ndarray, hot: np.ndarray) -> np.ndarray:
    said = np.einsum("prv,crv->cp", hot[:, :, ::2], np.log(table[:, :, ::2]))
    return 1 / (1 + np.exp(np.clip(said[0] - said[1] + np.log1p(-prior) - np.log(prior), -700, 700)))


def judge_quality(docs: DataFrame, threshold: float = 0.5, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the features, votes, quality, base_failed and kept to every document.

    Votes are counted over all documents by pattern (at most 3 to the power of the rules, whatever
    the number of documents), the rules' accuracies are estimated from these counts, and a
    document's quality is the posterior probability that it is good. It is kept if quality is
    `threshold` or more and the base rules hold (10 words or more, at most 20 % of them in repeated
    5-word windows). Null and empty texts have no words and fail. Columns of the added names are
    replaced; repeated rows are judged each; an empty table stays empty.
    Without the text in the result, the narrow rows are checkpointed and texts are read once.
    """
    rules = rule_votes()
    featured = map_batches(
        docs, [F.coalesce(F.col("text").cast("string"), F.lit(""))], FEATURES,
        lambda: lambda texts: list(zip(*map(text_features, texts.to_pylist()))), drop)
    voted = without(featured, ["votes"]).withColumn("votes", F.array(*[c.cast("int") for c in rules.values()]))
    if "text" in drop:
        shared_dir(docs.sparkSession)
        voted = voted.checkpoint()
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    votes = np.array([p["votes"] for p in patterns], dtype=int).reshape(-1, len(rules))
    prior, table = estimate(votes, np.array([p["n"] for p in patterns], dtype=float))
    odds = F.lit(float(np.log(prior) - np.log1p(-prior)))
    for i in range(len(rules)):
        steps = [float(np.log(table[1, i, v] / table[0, i, v])) if v != 1 else 0.0 for v in range(3)]
        odds = odds + F.element_at(F.array(*map(F.lit, steps)), F.col("votes")[i] + 2)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return without(voted, ["quality", "base_failed", "kept"]).withColumns({
        "quality": 1 / (1 + F.exp(-odds)), "base_failed": failed,
    }).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
