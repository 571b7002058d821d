"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import map_batches
from sievegate.session import shared_dir

ORDER = 4
DISCOUNT = 0.75
NO_LANGUAGE = "und"
#: Multipliers that turn a run of code points into one number, the last character first.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
SPACE = np.uint32(32)
PLACES = 1 << 20


def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters_only(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased words, one space before and after each; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    marks = letters[points]
    if not marks.any():
        return np.zeros(0, dtype=np.uint32)
    points = np.where(marks, points, SPACE)
    keep = marks | np.concatenate([[False], marks[:-1]])
    return np.concatenate([[SPACE], points[keep], [SPACE]]) if marks[-1] else np.concatenate([[SPACE], points[keep]])


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Number of the `order` characters that end at each place from `order` - 1 on."""
    total = np.zeros(max(0, len(points) - order + 1), dtype=np.uint64)
    wide = points.astype(np.uint64)
    for back in range(order):
        part = wide[order - 1 - back:len(wide) - back if back else len(wide)]
        total += (part + np.uint64(1)) * MIX[back]
    return total ^ (total >> np.uint64(29))


def count_grams(docs: DataFrame, order: int, chunk: int = 1_000_000, flush: int = 1_000_000) -> DataFrame:
    """(lang, gram, place, n): how often each run of `order` characters occurs over all given texts.

    Tasks count some `chunk` characters of a language at a time, add the counts up, and hand them on
    before the shuffle whenever they hold more than `flush` different runs. `place` is that of the
    run, see `places`.
    """

    def run(batches):
        letters = letter_table()
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        held: dict[str, tuple] = {}

        def take_in(lang):
            found = distinct(waiting.pop(lang), order)
            held[lang] = add_counts(held[lang], found) if lang in held else found

        def out():
            for lang in list(held):
                _, numbers, runs = held.pop(lang)
                grams_ = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(4 * order), len(numbers), [None, pa.py_buffer(runs.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(numbers)), grams_.cast(pa.binary()),
                     pa.array(places(runs[:, -3], runs[:, -2])), pa.array(numbers)],
                    names=["lang", "gram", "place", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                points = letters_only(text, letters)
                if not len(points):
                    continue
                waiting.setdefault(lang, []).append(padded(points, order))
                sizes[lang] = sizes.get(lang, 0) + len(points)
                if sizes[lang] >= chunk:
                    take_in(lang)
                    sizes[lang] = 0
            if sum(len(h[1]) for h in held.values()) > flush:
                yield from out()
        for lang in list(waiting):
            take_in(lang)
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram binary, place int, n long").groupBy(
        "lang", "gram", "place").agg(F.sum("n").alias("n"))


def places(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Place, below PLACES, of a run by the two characters before its last.

    All runs after one context, and all that end with the same three characters, are in one place:
    the counts of the two highest orders need no other.
    """
    return (grams_of(np.stack([one, two], axis=1)) % np.uint64(PLACES)).astype(np.int32)


def distinct(texts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different runs of `order` characters, never across texts: number, how often, characters."""
    points = np.concatenate(texts)
    ends = np.cumsum([len(t) for t in texts])
    codes = grams(points, order)
    whole = np.ones(len(codes), dtype=bool)
    for end in ends[:-1]:
        whole[max(0, end - order + 1):end] = False
    at = np.nonzero(whole)[0]
    unique, first, numbers = np.unique(codes[at], return_index=True, return_counts=True)
    return unique, numbers.astype(np.int64), points[at[first][:, None] + np.arange(order)].astype("<u4")


def add_counts(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, first, place = np.unique(np.concatenate([one[0], two[0]]), return_index=True, return_inverse=True)
    numbers = np.bincount(place, np.concatenate([one[1], two[1]])).astype(np.int64)
    return codes, numbers, np.concatenate([one[2], two[2]])[first]


class Models:
    """Log probabilities of all languages, per order: sorted gram numbers and one row of values each.

    A row of the highest order holds the interpolated probability of the gram's last character
    after its context in every language. For a gram that no language has, the next lower order
    applies, with the weight that each language leaves to unseen characters after that context.
    The runs are those of part `part` of `parts` by place; `pairs` has the continuation counts of all
    runs of two characters, over all parts, from which the two lowest orders and the alphabet come.
    """

    def __init__(
        self, counts: dict[str, tuple[np.ndarray, np.ndarray]], pairs: dict[str, tuple[np.ndarray, np.ndarray]],
        order: int, part: int = 0, parts: int = 1,
    ):
        self.order, self.langs, self.part, self.parts = order, sorted(counts), part, parts
        width = len(self.langs)
        alphabet = np.unique(np.concatenate([g[:, -1] for g, _ in pairs.values()]))
        self.floor = 1.0 / (len(alphabet) + 1)
        self.keys, self.probabilities, self.contexts, self.left = [None] * (order + 1), {}, {}, {}
        tables = {}
        for n in range(1, order + 1):
            per = []
            for lang in self.langs:
                runs, numbers = counts[lang] if n > 2 else pairs[lang]
                if n == 1:
                    runs, numbers = np.unique(runs[:, 1:], axis=0, return_counts=True)
                elif 2 < n < order:
                    # Kneser-Ney: a shorter run counts once for each character that stands before it.
                    longer = np.unique(runs[:, order - n - 1:], axis=0)
                    runs, numbers = np.unique(longer[:, 1:], axis=0, return_counts=True)
                per.append((grams_of(runs), grams_of(runs[:, :-1]), numbers.astype(float), runs))
            tables[n] = per
        for n in range(1, order + 1):
            keys, first = np.unique(np.concatenate([p[0] for p in tables[n]]), return_index=True)
            runs = np.concatenate([p[3] for p in tables[n]])[first]
            context_of = grams_of(runs[:, :-1])
            contexts = np.unique(np.concatenate([p[1] for p in tables[n]]))
            totals = np.zeros((len(contexts), width))
            kinds = np.zeros((len(contexts), width))
            own = np.zeros((len(keys), width))
            for k, (codes, context, numbers, _) in enumerate(tables[n]):
                at = np.searchsorted(contexts, context)
                np.add.at(totals[:, k], at, numbers)
                np.add.at(kinds[:, k], at, 1.0)
                own[np.searchsorted(keys, codes), k] = numbers
            safe = np.maximum(totals, 1e-12)
            left = np.where(totals > 0, DISCOUNT * kinds / safe, 1.0)
            at = np.searchsorted(contexts, context_of)
            lower = self.floor if n == 1 else np.exp(self.lookup(runs[:, 1:], n - 1))
            value = np.maximum(own - DISCOUNT, 0) / safe[at] + left[at] * lower
            self.keys[n], self.probabilities[n] = keys, np.log(value).astype(np.float32)
            self.contexts[n], self.left[n] = contexts, np.log(left).astype(np.float32)

    def lookup(self, runs: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the last characters of runs of n characters, all languages."""
        return self.score(grams_of(runs), lambda size, rows: grams_of(runs[rows][:, n - size:]),
                          lambda size, rows: grams_of(runs[rows][:, n - size:-1]), n)

    def score(self, codes: np.ndarray, ending, context, n: int) -> np.ndarray:
        at, hit = find(self.keys[n], codes)
        out = np.zeros((len(codes), len(self.langs)), dtype=np.float32)
        out[hit] = self.probabilities[n][at[hit]]
        missing = np.nonzero(~hit)[0]
        if len(missing):
            size = n
            while len(missing):
                # After a context that no language has, all weight goes to the lower order.
                c, known = find(self.contexts[size], context(size, missing))
                out[missing[known]] += self.left[size][c[known]]
                size -= 1
                if not size:
                    out[missing] += np.float32(np.log(self.floor))
                    break
                at, hit = find(self.keys[size], ending(size, missing))
                out[missing[hit]] += self.probabilities[size][at[hit]]
                missing = missing[~hit]
        return out

    def bits(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text's runs in this part under each language; the texts lie end to end."""
        n = self.order
        at = np.arange(len(points) - n + 1)
        if self.parts > 1:
            at = at[places(points[at + n - 3], points[at + n - 2]) % self.parts == self.part]

        def ending(size, rows):
            return grams_of(points[at[rows][:, None] + np.arange(n - size, n)])

        def context(size, rows):
            return grams_of(points[at[rows][:, None] + np.arange(n - size, n - 1)])

        logs = self.score(grams(points, n)[at], ending, context, n)
        sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])
        ends = np.append(starts[1:], len(points)) - n + 1
        return -(sums[np.searchsorted(at, ends)] - sums[np.searchsorted(at, starts)]) / np.log(2)


def find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each code in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes), dtype=bool)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return at, keys[at] == codes


class Parts:
    """The models of all languages, a part of bounded size at a time; all counts stay in Spark."""

    def __init__(self, counted: DataFrame, pairs: dict[str, tuple[np.ndarray, np.ndarray]], order: int, parts: int):
        self.counted, self.pairs, self.order, self.parts = counted, pairs, order, parts

    def part(self, number: int) -> Models:
        rows = self.counted.where(F.col("place") % self.parts == number).select("lang", "gram", "n").toArrow()
        by = {}
        for lang in self.pairs:
            own = rows.filter(pc.equal(rows.column("lang"), lang))
            by[lang] = (code_points(own.column("gram"), self.order), own.column("n").to_numpy())
        return Models(by, self.pairs, self.order, number, self.parts)

    def lookup(self, runs: np.ndarray, n: int) -> np.ndarray:
        """Log probabilities of the last characters of runs of n >= 3 characters, all languages."""
        of = places(runs[:, -3], runs[:, -2]) % self.parts
        out = np.zeros((len(runs), len(self.pairs)), dtype=np.float32)
        for number in np.unique(of).tolist():
            out[of == number] = self.part(number).lookup(runs[of == number], n)
        return out


def code_points(runs: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(runs.to_pylist()), dtype="<u4").reshape(-1, width)


def grams_of(runs: np.ndarray) -> np.ndarray:
    """Number of each row of code points; a row without characters is 0."""
    total = np.zeros(len(runs), dtype=np.uint64)
    width = runs.shape[1]
    for back in range(width):
        total += (runs[:, width - 1 - back].astype(np.uint64) + np.uint64(1)) * MIX[back]
    return total ^ (total >> np.uint64(29))


def padded(points: np.ndarray, order: int) -> np.ndarray:
    return np.concatenate([np.full(order - 2, SPACE), points]).astype(np.uint32)


def train(docs: DataFrame, order: int = ORDER, most: int = 1_000_000) -> Parts | None:
    """Models from all texts with a language; null languages and texts teach nothing.

    Counts are over all documents and all of them are in the models. The runs of `order` (3 or more)
    characters are cut by place into as many parts as keep each part of each language near `most`
    runs; the driver and the tasks hold one part at a time, and the runs of two characters.
    """
    shared_dir(docs.sparkSession)
    counted = count_grams(
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), order).checkpoint()
    ending = lambda n: F.expr(f"substring(gram, length(gram) - {4 * n - 1}, {4 * n})")
    triples = counted.groupBy("lang", ending(3).alias("gram")).agg(F.count("*").alias("longer"))
    rows = triples.groupBy("lang", ending(2).alias("gram")).agg(
        F.count("*").alias("n"), F.sum("longer").alias("longer")).orderBy("lang", "gram").toArrow()
    pairs, largest = {}, 0
    for lang in sorted(pc.unique(rows.column("lang")).to_pylist()):
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        pairs[lang] = (code_points(own.column("gram"), 2), own.column("n").to_numpy())
        largest = max(largest, pc.sum(own.column("longer")).as_py())
    return Parts(counted, pairs, order, -(-largest // most)) if pairs else None


def identify(
    docs: DataFrame, model: Parts | None, block: int = 1_000_000, drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add lang_pred, score, cross_entropy and rejected to every document.

    The language with the lowest cross-entropy per character over the whole text; ties go to the
    first name. The score, between 0 and 1, is the language's posterior if the text's entropies
    held over 50 characters, or over its own length if that is less. A text without a letter is rejected; `reject` adds
    those above their language's limit. Null texts and texts without letters are `und` with score 0.
    Texts are scored some `block` characters at a time. A model of more parts takes a pass over the texts for each: the
    bits of a text's runs in the parts before are carried in a column, written between passes.
    Columns in `drop` are left out; columns of the added names are replaced.
    """
    parts = model.parts if model else 1
    order, langs = (model.order, sorted(model.pairs)) if model else (ORDER, [])
    added = "lang_pred string, score double, cross_entropy double, rejected boolean"
    text, carried = F.col("text").cast("string"), F.lit(None).cast("array<double>")

    def judged(bits, length):
        entropy = bits / length
        best = int(np.argmin(entropy))
        weights = np.exp2(-(entropy - entropy[best]) * min(length, 50))
        lang, value = langs[best], float(entropy[best])
        return lang, float(1 / weights.sum()), value, False

    def starter(shared, last):
        def start():
            letters, models = letter_table(), shared.value

            def some(texts, at, before, out):
                starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
                for i, t, bits in zip(at, texts, models.bits(np.concatenate(texts), starts)):
                    if before[i] is not None:
                        bits = bits + before[i]
                    out[i] = judged(bits, len(t) - order + 1) if last else bits.tolist()

            def work(texts, before):
                before = before.to_pylist()
                out = [(NO_LANGUAGE, 0.0, None, True) if last else None] * len(texts)
                waiting, at, size = [], [], 0
                for i, text in enumerate(texts.to_pylist()):
                    points = letters_only(text, letters) if text and models else ()
                    if len(points):
                        waiting.append(padded(points, order))
                        at.append(i)
                        size += len(points)
                    if size >= block:
                        some(waiting, at, before, out)
                        waiting, at, size = [], [], 0
                if waiting:
                    some(waiting, at, before, out)
                return list(zip(*out)) if last else (out,)

            return work

        return start

    for number in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(model.part(number) if model else None)
        if number == parts - 1:
            return map_batches(docs, [text, carried], added, starter(shared, True), (*drop, "_bits"))
        docs = map_batches(docs, [text, carried], "_bits array<double>", starter(shared, False)).checkpoint()
        carried = F.col("_bits")
        shared.unpersist()


def rejection_limits(scored: DataFrame, quantile: float = 0.999, margin: float = 0.5) -> dict[str, float]:
    """Highest cross-entropy that a text of each language may have: a quantile and a margin in bits.

    Over all right predictions among `scored` (lang, lang_pred and cross_entropy), by a sketch that
    is off by a hundred-thousandth of a language's rows at most. A language of which no text is
    predicted right has no limit.
    """
    rows = scored.where("lang_pred = lang").groupBy("lang").agg(
        F.percentile_approx("cross_entropy", quantile, 100_000).alias("limit"))
    return {r["lang"]: r["limit"] + margin for r in rows.collect()}


def reject(scored: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Reject also what lies above the limit of its language."""
    known = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]) if limits else F.create_map().cast("map<string,double>")
    above = F.coalesce(F.col("cross_entropy") > F.try_element_at(known, F.col("lang_pred")), F.lit(False))
    return scored.withColumn("rejected", F.col("rejected") | above)


def training_rows(column: str, parts: int, held: int) -> Column:
    """Whether a document teaches: the checksum of its id, by the number of parts, is not `held`."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(parts)) != held, F.lit(True))
