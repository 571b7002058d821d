"""Spelling variants: words one edit apart by a bit-sliced position index, and each word's frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import as_bytes
from sievegate.session import shared_dir

#: Distinct words that a counting task holds before it hands them on.
HELD = 500_000
#: Words of one block of the index; larger blocks are split.
BLOCK = 4096


def planted_slip(doc_id: int | None, run: bytes, every: int) -> bytes:
    """The run as it counts: if `every` divides the CRC-32 of id and run, one code point is missing.

    Runs are Latin-1, one byte a code point; the checksum is of UTF-8.
    """
    data = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(b"%s:%s" % (b"" if doc_id is None else b"%d" % doc_id, data))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(least: int, every: int) -> Callable:
    """Counts of the words of a task's texts, handed on whenever `HELD` words are known."""
    # Letters are single bytes in Latin-1; all other characters become one that is no letter. Runs shorter
    # than `least` cannot become words.
    letters = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least)

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([w.decode("latin-1") for w in counts]), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or b"").decode("utf-8", "replace").encode("latin-1", "replace").lower()
                for word, n in Counter(letters.findall(data)).items():
                    word = planted_slip(doc_id, word, every)
                    if len(word) >= least:
                        counts[word] += n
                if len(counts) >= HELD:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return run


def vocabulary(docs: DataFrame, least: int = 7, at_least: int = 2, every: int = 31) -> DataFrame:
    """Words of at least `least` code points and `at_least` occurrences, with their count n.

    Words are maximal runs of `[A-Za-z\\u00C0-\\u00FF]`, A-Z lower-cased, with the planted slip of every
    `every`-th checksum of document and run. Null texts have none; a null doc_id is an empty one.
    """
    read = docs.select(F.col("doc_id").cast("long"), as_bytes("text"))
    counted = read.mapInArrow(count_words(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def keyed_words(words: DataFrame) -> DataFrame:
    """Each word under the halves that it shares with any word one edit away.

    Of two words one edit apart, m being the length of the shorter, the first difference lies in the
    first half of m or behind it: the words agree in their last characters or in their first ones. A row
    says: words of length m, or one more, whose first difference is at `low` or behind it and before `high`;
    they agree in the `low` characters before and the m - high after.
    """
    length = F.length("word")
    both = words.withColumn("m", F.explode(F.array(length - 1, length)))
    half = F.ceil(F.col("m") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit(0).alias("low"), half.alias("high")),
        F.struct(half.alias("low"), F.col("m").alias("high")))
    return with_key(both.withColumn("side", F.explode(sides)).select("word", "n", "m", "side.low", "side.high").where(F.col("low") < F.col("high")))


def with_key(rows: DataFrame) -> DataFrame:
    shared = F.concat_ws(
        "\u0000", F.expr("left(word, low)"), F.expr("right(word, m - high)"), "m", "low", "high")
    return rows.withColumn("key", shared)


def split_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Split blocks of more than `block` words by the next half of the place of the difference, until none is larger.

    Words of a block whose place is down to one position differ in one character, or one has one more
    there: it has no more words than there are letters, which ends the splitting after log2(length) rounds.
    """
    done = None
    while True:
        rows = rows.checkpoint()
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(
            (F.col("size") > block)).select("key", F.lit(True).alias("large"))
        marked = rows.join(large, "key", "left")
        open_ = F.coalesce("large", F.lit(False)) & (F.col("high") > F.col("low") + 1)
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        marked = marked.checkpoint()
        ready = marked.where(~open_).drop("large")
        done = ready if done is None else done.unionByName(ready)
        half = F.expr("low + CAST(ceil((high - low) / 2) AS INT)")
        sides = F.array(
            F.struct(F.col("low").alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high").alias("high")))
        rows = with_key(marked.where(open_).withColumn("side", F.explode(sides)).select(
            "word", "n", "m", "side.low", "side.high"))


class PositionIndex:
    """Bitsets over the words of one block: a bit per word, a set per (position, letter)."""

    def __init__(self, words: list[str]):
        self.words = words
        self.all = (1 << len(words)) - 1
        self.sets: list[dict[str, int]] = [defaultdict(int) for _ in range(max(map(len, words), default=0))]
        self.lengths: dict[int, int] = defaultdict(int)
        for i, word in enumerate(words):
            bit = 1 << i
            self.lengths[len(word)] |= bit
            for at, letter in enumerate(word):
                self.sets[at][letter] |= bit

    def one_edit(self, query: str) -> int:
        """Words that a replaced or an added letter makes of `query`, as a bitset.

        Letter by letter, for all words at once: `same` has the words that agree so far, `replaced`
        those with one other letter so far, `longer` those that agree after one letter more, whose
        positions are shifted by one. Shorter words find `query` as the longer one.
        """
        sets, same, replaced, longer = self.sets, self.all, 0, 0
        for at, letter in enumerate(query):
            here = sets[at].get(letter, 0) if at < len(sets) else 0
            later = sets[at + 1].get(letter, 0) if at + 1 < len(sets) else 0
            # A letter more before this one: the word goes on one position later.
            longer = (longer | same) & later
            replaced = (replaced & here) | (same & ~here)
            same &= here
            if not (same or replaced or longer):
                return 0
        longer |= same  # the letter more at the end
        n = len(query)
        return (replaced & self.lengths.get(n, 0)) | (longer & self.lengths.get(n + 1, 0))


def first_difference(one: str, other: str) -> int:
    for at, (a, b) in enumerate(zip(one, other)):
        if a != b:
            return at
    return min(len(one), len(other))


class Near:
    """What is known of one word within a block: near words, and the best of them."""

    __slots__ = ("count", "n", "form")

    def __init__(self) -> None:
        self.count, self.n, self.form = 0, 0, ""

    def add(self, word: str, n: int) -> None:
        self.count += 1
        if not self.form or (-n, word) < (-self.n, self.form):
            self.n, self.form = n, word


def near_in_block(words: list[tuple[str, int]], m: int, low: int, high: int) -> dict[str, Near]:
    """Near words of a block, each pair counted in the one block that has its first difference."""
    # The block's words agree outside the middle: only it is indexed.
    found: dict[str, Near] = defaultdict(Near)
    index = PositionIndex([w[low:len(w) - (m - high)] for w, _ in words])
    for word, n in words:
        if len(word) != m:
            continue
        hits = index.one_edit(word[low:high])
        while hits:
            bit = hits & -hits
            hits ^= bit
            other, other_n = words[bit.bit_length() - 1]
            at = first_difference(word, other)
            if low <= at < high or at == high == m:
                found[word].add(other, other_n)
                if len(other) > m:  # of one length, each finds the other itself
                    found[other].add(word, n)
    return found


def near_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream blocks, which lie sorted by key, and give each word's near words in its block, added up."""

    def rows(part: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form_n", "form"])

    key, place, words, part = None, None, {}, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for k, word, n, *here in zip(*columns):
            if k != key:
                if len(words) > 1:
                    part += [(w, x.count, x.n, x.form) for w, x in near_in_block(list(words.items()), *place).items()]
                    if len(part) >= 50_000:
                        yield rows(part)
                        part = []
                key, place, words = k, here, {}
            words[word] = n
    if len(words) > 1:
        part += [(w, x.count, x.n, x.form) for w, x in near_in_block(list(words.items()), *place).items()]
    if part:
        yield rows(part)


def one_edit_away(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per word that has near words: n_near, and the near word of largest n (form, form_n), ties by code points."""
    blocks = split_blocks(keyed_words(words), block)
    sorted_ = blocks.repartition("key").sortWithinPartitions("key").select("key", "word", "n", "m", "low", "high")
    found = sorted_.mapInArrow(near_words, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def follow(forms: DataFrame) -> DataFrame:
    """The last form of each word that has one, by doubling: each round follows twice as many forms."""
    roots = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = roots.join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        roots = joined.drop("moved")
        if not joined.where("moved").limit(1).count():
            return roots


def group_variants(words: DataFrame, times: int = 10, block: int = BLOCK) -> DataFrame:
    """Form, root, n, n_near and form_n of every row of `words` (word, n).

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A word's
    form is its near word of largest n (ties: the smallest in code-point order) if that n is at least `times` the
    word's own, else null. Its root is where its forms lead, itself if it has none. n_near is 0 for a
    word without near words; form_n is null without a form.

    Words are dealt into blocks that share one half; within a block a bitset per position and letter
    goes over all words at once. Blocks of more than `block` words are split by a finer place of the
    difference, so no block grows with the vocabulary, and no pair is left out or counted twice. Pairs stay
    in their task: a row per word and block leaves it. n grows along forms, so they end.

    Words of any length from 1 work. An empty table gives an empty one. Null words are left out, equal
    words are added up, columns but word and n are not read.
    """
    shared_dir(words.sparkSession)
    known = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).checkpoint()
    near = one_edit_away(known, block)
    rows = known.join(near, "word", "left")
    enough: Column = F.col("form_n") >= times * F.col("n")
    judged = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")).checkpoint()
    roots = follow(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
