"""Toxicity by compression distance to two zstandard dictionaries, one per kind of text."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import apart, as_bytes, hashed_sample, map_batches

WORD = re.compile(rb"[a-z\x80-\xff]+")
#: Closes every window. Both dictionaries end with it, so that each window compresses at all and a
#: few bytes saved on the word before it are not lost to a stored block.
GUARD = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
LEVEL = 13
ORDINARY_BYTES = 32768
#: Thresholds of a window: bytes saved, and the share saved of what the window costs by itself.
STEPS = (2, 3, 4, 6)
SHARES = (0.3, 0.4, 0.5, 0.6)
MEMO = 300_000
FOLDS = 4
#: Lengths of the windows of several words.
PHRASE_WORDS = (2, 3)
STEM = 6


def windows(text: bytes | None) -> list[bytes]:
    """Windows of a text: its words, A-Z lower-cased; null has none."""
    return WORD.findall(text.lower()) if text else []


def several(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(n)))]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Bytes that a window saves with the toxic dictionary against the ordinary one.

    The toxic dictionary is the ordinary one and then its own part, next to the window; where that
    part is, the ordinary one has bytes that no window has. So ordinary words are as far away, and
    cost the same, with both.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, phrases: list[bytes] = ()):
        self.phrases = frozenset(phrases)
        # Phrases have a part of their own, so that the ordinary words in them stay ordinary.
        several = b" " + b" ".join(phrases) + b" "
        pair = lambda own: [self.compressor(ordinary + bytes(len(own))), self.compressor(ordinary + own)]
        self.compressors, self.for_phrases = pair(toxic), pair(several) if phrases else None
        self.memo: dict[bytes, tuple[int, float]] = {}
        self.empty = len(self.compressors[0].compress(b" " + GUARD))

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        data = zstandard.ZstdCompressionDict(content + GUARD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(compression_params=settings, dict_data=data)

    def saved(self, window: bytes) -> tuple[int, float]:
        known = self.memo.get(window)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ordinary, toxic = (len(c.compress(b" " + window + b" " + GUARD)) for c in (
                self.for_phrases if b" " in window else self.compressors))
            saved = ordinary - toxic
            known = self.memo[window] = (saved, saved / max(1, ordinary - self.empty))
        return known

    def known(self, words: list[bytes]) -> list[bytes]:
        """Windows of several words: those that were learned. Others save no more than their words do."""
        return [p for n in PHRASE_WORDS for p in several(words, n) if p in self.phrases] if self.phrases else []

    def features(self, text: bytes | None) -> np.ndarray:
        """Share and number of the windows above each threshold: the words, and the phrases learned."""
        words = windows(text)
        found = [f for f in map(self.saved, [*words, *self.known(words)]) if f[0] > 0]
        counts = np.array([sum(n >= s for n, _ in found) for s in STEPS]
                          + [sum(r >= s for _, r in found) for s in SHARES], dtype=float)
        share = counts / max(1, len(words))
        return np.concatenate([np.log1p(200 * share), np.log1p(counts), np.minimum(counts, 1)])


def logistic(rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last is the constant."""
    rows = np.hstack([rows, np.ones((len(rows), 1))])
    w = np.zeros(rows.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (weight * (p - labels)) + penalty * w
        curve = (rows * (weight * p * (1 - p) + 1e-9)[:, None]).T @ rows + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Dictionaries and calibrated thresholds; picklable, some 32 KB and the toxic vocabulary."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes], odds: float = 1.0):
        """`odds`: toxic to ordinary texts, as the calibration is to take them."""
        self.weights = None
        rows, labels = [], []
        for fold in range(FOLDS):
            # A text is never compressed with a dictionary that was trained on it.
            apart = [(t[fold::FOLDS], [x for i, x in enumerate(t) if i % FOLDS != fold]) for t in (ordinary, toxic)]
            distance = self.train(apart[1][1], apart[0][1])
            if distance is None:
                return
            for label, (held, _) in enumerate(apart):
                rows += [distance.features(t) for t in held]
                labels += [float(label)] * len(held)
        self.train(toxic, ordinary)
        labels = np.array(labels)
        weight = np.where(labels == 1, odds * len(ordinary) / len(toxic), 1.0)
        self.weights = logistic(np.array(rows), labels, weight)

    def train(self, toxic: list[bytes], ordinary: list[bytes]) -> Distance | None:
        """Both dictionaries; None if no word tells the texts apart."""
        words, phrases = self.contrast(toxic, ordinary)
        if not (words or phrases) or not ordinary:
            return None
        self.ordinary = dictionary([b" " + b" ".join(windows(t)) + b" " for t in ordinary], ORDINARY_BYTES)
        self.toxic = b" " + b" ".join(words) + b" "
        self.phrases = phrases
        return Distance(self.ordinary, self.toxic, self.phrases)

    @staticmethod
    def contrast(
        toxic: list[bytes], ordinary: list[bytes], least: int = 3, lift: float = 20,
    ) -> tuple[list[bytes], list[bytes]]:
        """Words and phrases of toxic texts that ordinary texts hardly have, the most frequent last.

        A word teaches if it, or its first STEM bytes, are in at least `least` toxic texts and `lift`
        times as frequent there as in ordinary ones, a phrase if it is so itself and no word in it is.
        The toxic dictionary holds each of them once, so its size is that of its vocabulary.
        """
        def lifted(units):
            in_toxic, in_ordinary = (Counter(u for t in texts for u in units(t)) for texts in (split[1], split[0]))
            return {
                u: n for u, n in in_toxic.items()
                if n >= least and n * len(ordinary) >= lift * len(toxic) * (in_ordinary[u] + 0.5)}

        split = [[windows(t) for t in texts] for texts in (ordinary, toxic)]
        found = lifted(lambda t: {x for w in t for x in (w, w[:STEM])})
        # A stem teaches through the words that it begins.
        words = Counter(w for t in split[1] for w in set(t) if w in found or w[:STEM] in found)
        phrases = {p: k for n in PHRASE_WORDS for p, k in lifted(lambda t: set(several(t, n))).items()
                   if not any(w in words for w in p.split(b" "))}
        ordered = lambda units: sorted(units, key=lambda u: (units[u], u))
        return ordered(words), ordered(phrases)

    def scorer(self):
        """Score of one text; 0 for all where there was nothing to learn from."""
        if self.weights is None:
            return lambda text: 0.0
        distance, weights = Distance(self.ordinary, self.toxic, self.phrases), self.weights

        def score(text: bytes | None) -> float:
            total = float(distance.features(text) @ weights[:-1] + weights[-1])
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, per_class: int = 2_000, longest: int = 50_000,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows that are not held out.

    The sample is, of each class, the `per_class` labelled ids whose hash comes first, with texts
    of up to `longest` bytes: 200 MB at most with the defaults. Of rows with one id the text that sorts
    first teaches. Null labels, ids and texts teach nothing; an id with both labels is toxic. The classes' weights are their counts over all labels.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    drawn = [hashed_sample(known.where(F.col("toxic") == kind), "doc_id", per_class) for kind in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    found = docs.where(F.octet_length("text") <= longest).select("doc_id", as_bytes().alias("text")).join(
        F.broadcast(sample), "doc_id")
    # Rows of one id are brought down to one before the shuffle: 2 * per_class rows reach the driver.
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    texts = {0: [], 1: []}
    for _, text, toxic in sorted((r["doc_id"], bytes(r["text"]), r["toxic"]) for r in rows):
        texts[toxic].append(text)
    return ToxicityModel(texts[1], texts[0], counts.get(1, 0) / max(1, counts.get(0, 0)))


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add score and predicted (1 if score is at least `threshold`, else 0) to every document.

    Every word of the whole text is a window. Null texts and texts without words save nothing and
    get the score of that. Equal texts get equal scores. Columns in `drop` are left out; columns of
    the added names are replaced; an empty table stays empty.
    """

    def start():
        score = model.scorer()

        def work(texts):
            scores = [score(t) for t in texts.to_pylist()]
            return scores, [int(s >= threshold) for s in scores]

        return work

    return map_batches(docs, [as_bytes()], "score double, predicted int", start, drop)


def remove_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents that are not predicted toxic, columns as given."""
    renamed, back = apart(docs)
    return back(score_toxicity(renamed, model).where(F.col("predicted") == 0))
