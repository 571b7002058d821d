"""Repeated lines: hashes sorted in ranges, first occurrences streamed, a keep bitmap per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import as_bytes, given_back, map_batches, renamed
from sievegate.session import shared_dir

STRIPPED = b" \t\n\x0b\x0c\r"
#: Rows without an id count as one document after all others.
LAST_ID = (1 << 63) - 1
#: Line rows that the mapper holds at once.
ROWS = 200_000
LINES = "h1 long, h2 long, doc long, version long, at long"
FOUND = "h1 long, h2 long, doc long, version long, at long, kind int"
#: Kinds of streamed rows: a line to drop, one whose first occurrence may lie in an earlier range, the end of a range.
DROP, OPEN, EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at both ends, A-Z lower-cased (bytes.lower touches nothing else)."""
    return line.strip(STRIPPED).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points; a code point has one to four bytes."""
    return len(key) >= 4 * least or (len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least))


def line_rows(least: int) -> Callable:
    """One row per line whose key is long enough: 128-bit hash, document, and position with a salt below it."""

    def rows(part: list[tuple]) -> pa.RecordBatch:
        digests, docs, versions, places = zip(*part)
        hashes = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        columns = [hashes[:, 0], hashes[:, 1], *(np.array(c, dtype=np.int64) for c in (docs, versions, places))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "doc", "version", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = [], 0
        for batch in batches:
            docs, versions = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, version, text in zip(docs, versions, batch.column(2)):
                seen += 1
                for position, line in enumerate((text.as_py() or b"").split(b"\n")):
                    key = line_key(line)
                    if long_enough(key, least):
                        # The salt lets a range bound fall between repeated rows; the position stays above it.
                        part.append((xxhash.xxh3_128_digest(key), doc, version, position << 16 | seen & 0xFFFF))
                if len(part) >= ROWS:
                    yield rows(part)
                    part = []
        if part:
            yield rows(part)

    return run


def first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a sorted range: the first document of each hash keeps its lines, later ones lose theirs.

    What stands before the range is not known here. Lines of the first document of the range's first
    hash go out as open, and the last hash goes out as the range's edge, for the ranges that follow.
    """
    first: tuple[int, int, int] | None = None
    head = True

    def rows(h1, h2, doc, version, at, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*(pa.array(np.asarray(c, dtype=np.int64)) for c in (h1, h2, doc, version, at)),
             pa.array(np.asarray(kind, dtype=np.int32))], names=["h1", "h2", "doc", "version", "at", "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc, version, at = (batch.column(i).to_numpy() for i in range(5))
        starts = np.concatenate(([first is None or first[:2] != (h1[0], h2[0])], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        place = np.maximum.accumulate(np.where(starts, np.arange(len(h1)), -1))
        firsts = doc[np.maximum(place, 0)]
        if first is not None:
            firsts = np.where(place < 0, first[2], firsts)
        drops = doc != firsts
        # The first hash of the range goes up to the second start that the range has.
        begun = np.flatnonzero(starts)[1:] if first is None else np.flatnonzero(starts)
        ends = (int(begun[0]) if len(begun) else len(h1)) if head else 0
        opens = ~drops & (np.arange(len(h1)) < ends)
        chosen = drops | opens
        if chosen.any():
            yield rows(h1[chosen], h2[chosen], doc[chosen], version[chosen], at[chosen],
                       np.where(opens[chosen], OPEN, DROP))
        head = head and not len(begun)
        first = int(h1[-1]), int(h2[-1]), int(firsts[-1])
    if first is not None and not head:
        yield rows([first[0]], [first[1]], [first[2]], [0], [0], [EDGE])


def repeated_lines(keyed: DataFrame, least: int, parts: int) -> DataFrame:
    """Positions of the lines to drop, as a sorted array per document: columns doc, version, positions."""
    lines = keyed.select("_doc", "_version", as_bytes("text")).mapInArrow(line_rows(least), LINES)
    order = ["h1", "h2", "doc", "version", "at"]
    ranged = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Kept as written: its ranges must be the same for the edges and for the lines.
    found = ranged.mapInArrow(first_occurrences, FOUND).checkpoint()
    # At most two rows a range: the first document of its first and of its last hash.
    edges = found.where(F.col("kind") > DROP).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    opened = found.where(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"])
    late = opened.where(F.col("doc") > F.col("first")).select("doc", "version", "at")
    dropped = found.where(F.col("kind") == DROP).select("doc", "version", "at").unionByName(late)
    position = F.shiftright("at", 16).cast("int")
    return dropped.groupBy("doc", "version").agg(F.sort_array(F.collect_set(position)).alias("positions"))


def pack(n_lines: int, dropped: list[int]) -> bytes:
    """A bit per line, set where the line stays, packed and compressed."""
    bits = np.ones(n_lines, dtype=bool)
    bits[dropped] = False
    return zlib.compress(np.packbits(bits).tobytes())


def kept_text(text: bytes, keep: bytes | None) -> bytes:
    """The lines whose bit is set, joined by \\n; no bitmap keeps all."""
    if keep is None:
        return text
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=len(lines))
    return b"\n".join([line for line, bit in zip(lines, bits) if bit])


def mark_lines(docs: DataFrame, least: int = 10, drop=(), parts: int | None = None) -> DataFrame:
    """Add n_lines, n_dropped, keep (compressed bitmap) and kept_sha256 to every document.

    Lines are cut at \\n. A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z
    lower-cased. Keys of at least `least` code points that stand in two documents or more lose their
    lines, except for all lines of the smallest doc_id that has them. `keep` has a bit per line, set
    where the line stays; it is null if all lines stay. `kept_sha256` is of the kept lines joined by \\n.

    Line hashes, not texts, are sorted: ranges go by hash, document and position, so a line that a third of
    all documents have fills several ranges; each range is streamed once, and what its first hash
    owes to earlier ranges comes from a table of two rows a range. Texts move once, to their bitmaps.

    Null and empty texts have one empty line. Rows without doc_id count as one document after all
    others. Rows of one doc_id are one document, each with a bitmap of its own; repeated rows come out
    as often as they came in. An empty table gives an empty one. A very long text is cut into rows by
    line, and only its own positions come together. Other columns stay; those of the added names are
    replaced, those in `drop` are left out.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    base, names = renamed(docs)
    keyed = base.withColumns({
        "_doc": F.coalesce(F.col(names["doc_id"]).cast("long"), F.lit(LAST_ID)), "_version": F.xxhash64("text")})
    drops = repeated_lines(keyed, least, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    joined = keyed.join(
        drops.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "positions"),
        ["_doc", "_version"], "left")

    def start() -> Callable:
        def work(texts: pa.Array, positions: pa.Array) -> list:
            lines, dropped, keeps, digests = [], [], [], []
            for value, places in zip(texts, positions):
                text, places = value.as_py() or b"", places.as_py() or []
                lines.append(text.count(b"\n") + 1)
                dropped.append(len(places))
                keeps.append(pack(lines[-1], places) if places else None)
                digests.append(hashlib.sha256(kept_text(text, keeps[-1])).hexdigest())
            return [lines, dropped, keeps, digests]

        return work

    added = "n_lines long, n_dropped long, keep binary, kept_sha256 string"
    marked = map_batches(joined, [as_bytes("text"), F.col("positions")], added, start, drop=("_doc", "_version", "positions"))
    return given_back(marked, names, ["n_lines", "n_dropped", "keep", "kept_sha256"], drop)


def drop_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """Documents with the lines that `mark_lines` keeps as their text; columns as before.

    A null text stays null. A document that keeps no line has an empty text. Nulls, repeated rows, empty
    tables and long texts are as in `mark_lines`; columns whose names it adds are not touched.
    """
    base, names = renamed(docs)
    marked = mark_lines(base.withColumnRenamed(names["doc_id"], "doc_id"), least)

    def start() -> Callable:
        def work(texts: pa.Array, keeps: pa.Array) -> list:
            return [[None if t.as_py() is None else kept_text(t.as_py(), k.as_py()).decode("utf-8", "replace")
                     for t, k in zip(texts, keeps)]]

        return work

    out = map_batches(marked, [as_bytes("text"), F.col("keep")], "_kept string", start, drop=("text",))
    return given_back(
        out.withColumnsRenamed({"_kept": "text", "doc_id": names["doc_id"]}), names, [])
