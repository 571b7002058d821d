"""Benchmark decontamination: suffix arrays over shards of the corpus, searched by every test suffix."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import apart, as_bytes, lower_words, map_batches, word_hashes

WINDOW = 10
ADDED = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
         "matches array<struct<item_id:string,start:long,words:long>>")


class TestSet:
    """Words of one block of benchmark items: every suffix, with the window it must match."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = [(item, w) for item, text in items if (w := lower_words(text))]
        vocabulary = sorted({word for _, w in texts for word in w})
        #: Words of the benchmark by hash; a word of the corpus that is in none is number 0.
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], dtype=np.uint64)
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.numbers = (np.arange(len(vocabulary)) + 1)[order].astype(np.int64)
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        rows, lengths, items_of, places = [], [], [], []
        for item, w in texts:
            ids = [number[x] for x in w]
            size = min(window, len(ids))
            for at in range(len(ids) - size + 1):
                rows.append(ids[at:at + size] + [0] * (window - size))
                lengths.append(size)
                items_of.append(item)
                places.append(at)
        self.windows = np.array(rows, dtype=np.int64).reshape(len(rows), window)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.items, self.places = items_of, places
        self.shortest = int(self.lengths.min()) if len(rows) else window
        base = len(vocabulary) + 1
        head = self.windows[:, 0] * base + (self.windows[:, 1] if self.shortest > 1 else 0)
        self.base, self.heads = base, np.unique(head)

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Benchmark number of each word of the corpus."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.numbers[at], 0)


def suffix_array(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in the order of their suffixes' first `depth` words, by prefix doubling.

    Only suffixes that can begin a match are in the array; ranks of the other places are not
    needed beyond the word itself, because each round ranks all places.
    """
    rank = text.copy()
    length = 1
    while length < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-length] = rank[length:] if length < len(rank) else 0
        key = rank * (int(after.max(initial=0)) + 1) + after
        _, rank = np.unique(key, return_inverse=True)
        length *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def search(text: np.ndarray, array: np.ndarray, tests: TestSet, upper: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: where their window's matches begin or end."""
    low = np.zeros(len(tests.windows), dtype=np.int64)
    high = np.full(len(tests.windows), len(array), dtype=np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        rows = np.nonzero(open_)[0]
        middle = (low[rows] + high[rows]) // 2
        place, want = array[middle], tests.windows[rows]
        order = np.zeros(len(rows), dtype=np.int64)
        for k in range(want.shape[1]):
            here = text[np.minimum(place + k, len(text) - 1)]
            step = np.sign(here - want[:, k])
            order = np.where((order == 0) & (k < tests.lengths[rows]), step, order)
        goes_up = order <= 0 if upper else order < 0
        low[rows] = np.where(goes_up, middle + 1, low[rows])
        high[rows] = np.where(goes_up, high[rows], middle)


def find_windows(hashes: list[np.ndarray], tests: TestSet):
    """Document, place and window of every occurrence in a shard of documents.

    Words outside the benchmark end every match, so only places whose first words stand together
    in the benchmark enter the suffix array, each with the words that follow it.
    """
    window = tests.windows.shape[1]
    gap = np.zeros(1, dtype=np.int64)
    numbers = tests.word_numbers(np.concatenate(hashes))
    offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    spread = np.arange(len(numbers)) + np.repeat(np.arange(len(hashes)), np.diff(offsets))
    text = np.zeros(len(numbers) + len(hashes) + window, dtype=np.int64)  # a gap after each document
    text[spread] = numbers
    head = text[:-1] * tests.base + (text[1:] if tests.shortest > 1 else 0)
    starts = np.nonzero(text[:-1])[0]
    at = np.minimum(np.searchsorted(tests.heads, head[starts]), len(tests.heads) - 1)
    starts = starts[tests.heads[at] == head[starts]]
    inside = np.concatenate([gap, np.cumsum(text > 0)])
    starts = starts[inside[starts + tests.shortest] - inside[starts] == tests.shortest]
    packed, where = pack(text, starts, window)
    array = suffix_array(packed, np.nonzero(where >= 0)[0], window)
    first = search(packed, array, tests, upper=False)
    counts = search(packed, array, tests, upper=True) - first
    hits = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    places = where[array[hits]]
    begins = offsets + np.arange(len(offsets))
    documents = np.searchsorted(begins, places, side="right") - 1
    return documents, places - begins[documents], np.repeat(np.arange(len(counts)), counts)


def pack(text: np.ndarray, starts: np.ndarray, window: int):
    """The words from each start to a window's end, and for each place its start in `text`, or -1."""
    edges = np.zeros(len(text) + window + 1, dtype=np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    inside = np.nonzero(np.cumsum(edges)[:len(text)])[0]
    new = np.arange(len(inside)) + np.cumsum(np.diff(inside, prepend=inside[:1]) > 1)
    packed = np.zeros((int(new[-1]) + 1 if len(new) else 0) + window, dtype=np.int64)
    packed[new] = text[inside]
    where = np.full(len(packed), -1, dtype=np.int64)
    is_start = np.zeros(len(text), dtype=bool)
    is_start[starts] = True
    where[new] = np.where(is_start[inside], inside, -1)
    return packed, where


def summarize(found: list[tuple[int, int]], tests: TestSet):
    """Matches of one document: maximal runs of windows along a diagonal, longest match first."""
    diagonals: dict[tuple[str, int], list[int]] = {}
    for place, window in found:
        diagonals.setdefault((tests.items[window], place - tests.places[window]), []).append(
            (place, int(tests.lengths[window])))
    matches = []
    for (item, _), places in diagonals.items():
        begin = end = None
        for place, length in sorted(places):
            if begin is not None and place <= last + 1:
                end, last = max(end, place + length), place
                continue
            if begin is not None:
                matches.append((item, begin, end - begin))
            begin, end, last = place, place + length, place
        matches.append((item, begin, end - begin))
    return sorted(matches, key=lambda m: (-m[2], m[1], m[0]))


def mark_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_items: int = 20_000,
    shard_words: int = 500_000, drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add n_words, n_hit, n_items, items_sha256, contaminated and matches to every document.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one
    window. Words of a document inside any occurrence of a window are hit. Every
    `shard_words` words or more of whole documents are a shard with a suffix array of its own, and
    every test suffix is binary-searched in every shard, so no text is shuffled. The benchmark goes to the tasks in
    blocks of `block_items` items, all blocks in one pass over the documents' rows.
    `matches` has the maximal verbatim matches of a window or more (item, first word, words), the
    longest first. Null texts have no words; items with a null id or no words are left out, repeated
    items count once; an empty benchmark marks nothing. Columns in `drop` are left out; columns of the added names are replaced.
    """
    blocks, block = [], []
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), as_bytes().alias("text")).distinct()
    for row in rows.toLocalIterator():
        block.append((row["item_id"], bytes(row["text"])))
        if len(block) == block_items:
            blocks.append(block)
            block = []
    blocks = docs.sparkSession.sparkContext.broadcast([*blocks, block] if block else blocks)

    def start():
        sets = [t for b in blocks.value if len((t := TestSet(b, window)).windows)]

        def shard(texts, first, hit, matches):
            filled = [i for i, t in enumerate(texts) if len(t)]
            if not filled:
                return
            for tests in sets:
                found = [[] for _ in texts]
                windows = find_windows([texts[i] for i in filled], tests)
                for document, place, w in zip(*(x.tolist() for x in windows)):
                    found[filled[document]].append((place, w))
                for i, f in enumerate(found):
                    for place, w in f:
                        hit[first + i][place:place + int(tests.lengths[w])] = True
                    if f:
                        matches[first + i] += summarize(f, tests)

        def work(column):
            hit, matches, waiting, first, held = [], [], [], 0, 0
            for i, text in enumerate(column.to_pylist()):
                waiting.append(word_hashes(text))
                hit.append(np.zeros(len(waiting[-1]), dtype=bool))
                matches.append([])
                held += len(waiting[-1])
                if held >= shard_words:
                    shard(waiting, first, hit, matches)
                    waiting, first, held = [], i + 1, 0
            shard(waiting, first, hit, matches)
            items = [sorted({m[0] for m in ms}) for ms in matches]
            n_hit = [int(h.sum()) for h in hit]
            return (
                [len(h) for h in hit], n_hit, [len(x) for x in items],
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                [n > 0 for n in n_hit],
                [[{"item_id": m[0], "start": m[1], "words": m[2]} for m in
                  sorted(ms, key=lambda m: (-m[2], m[1], m[0]))] for ms in matches],
            )

        return work

    return map_batches(docs, [as_bytes()], ADDED, start, drop)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any benchmark window, columns as given."""
    renamed, back = apart(docs)
    return back(mark_benchmark(renamed, benchmark, window)
                .where(~F.col("contaminated")))
