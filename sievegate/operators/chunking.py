"""Documents to chunks, one narrow stage per document row.

A document row carries its own text: it is cut by array expressions, and packed and merged by one walk
over its sentences in an Arrow batch, in time proportional to its length. No shuffle happens between the scan
and the chunk rows, whatever the size of the corpus.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import text as tx
from sievegate.operators.common import unnest

BLANKS = tx.WHITESPACE  # used in Python workers, which get no other module


@dataclass(frozen=True)
class ChunkSettings:
    max_tokens: int = fixed.CHUNK_MAX_TOKENS
    overlap_tokens: int = fixed.CHUNK_OVERLAP_TOKENS
    min_tokens: int = fixed.CHUNK_MIN_TOKENS
    heading_mode: str = "compat"
    mode: str = "legacy"


# ---- sections -----------------------------------------------------------------

def with_sections(docs: DataFrame, text_col: str = "text", mode: str = "compat") -> DataFrame:
    """Add `sections`: array of (heading, body) with a non-empty body, in order."""
    lines = docs.withColumn("_lines", F.split(tx.strip(text_col), "\n"))
    marked = lines.withColumn(
        "_heads",
        F.filter(
            F.sequence(F.lit(1), F.size("_lines")),
            lambda i: tx.let(tx.strip(F.element_at("_lines", i)),
                             lambda line: tx.is_heading(line, mode, stripped=True)),
        ),
    )

    def section(k: Column) -> Column:
        head = F.when(k > 0, F.element_at("_heads", F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
        until = F.when(
            k < F.size("_heads"), F.element_at("_heads", F.least(k + 1, F.size("_heads")))
        ).otherwise(F.size("_lines") + 1)
        body = F.array_join(F.slice("_lines", head + 1, until - head - 1), "\n")
        return F.struct(
            F.when(head > 0, tx.strip(F.element_at("_lines", F.greatest(head, F.lit(1)))))
            .alias("heading"),
            tx.strip(body).alias("body"),
        )

    # A text without headings needs no index arithmetic.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"),
                             tx.strip(F.col(text_col)).alias("body")))
    split = F.filter(
        F.transform(F.sequence(F.lit(0), F.size("_heads")), section), lambda s: s["body"] != ""
    )
    return (
        marked.withColumn("sections", F.when(F.size("_heads") == 0, whole).otherwise(split))
        .withColumn("sections", F.when(F.size("sections") == 0, whole).otherwise(F.col("sections")))
        .drop("_lines", "_heads")
    )


def sections(docs: DataFrame, key: str = "doc_id", mode: str = "compat") -> DataFrame:
    """One row per section: key, section_index, heading, body."""
    rows = unnest(with_sections(docs, mode=mode), [key], "sections", "s", "section_index")
    return rows.select(key, "section_index", F.coalesce("s.heading", F.lit("")).alias("heading"), "s.body")


# ---- packing ------------------------------------------------------------------

def sentence_spans(section_of: list[int], prefix: list[int], max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing: (first, last) sentences of each piece; last = -1 marks a sentence longer than a piece.

    `prefix` holds the tokens before each sentence, so the tail that the next piece takes over is found by
    binary search, and the work grows with the sentences.
    """
    out, start, used, n = [], 0, 0, len(section_of)
    for i in range(n):
        size = prefix[i + 1] - prefix[i]
        if i and section_of[i] != section_of[i - 1]:
            # A new section closes the open piece and carries nothing over.
            if start < i:
                out.append((start, i - 1))
            start, used = i, 0
        if size > max_tokens:
            if start < i:
                out.append((start, i - 1))
            out.append((i, -1))
            start, used = i + 1, 0
        elif start < i and used + size > max_tokens:
            out.append((start, i - 1))
            start = bisect_left(prefix, prefix[i] - overlap, start, i)
            used = prefix[i + 1] - prefix[start]
        else:
            used += size
    if start < n:
        out.append((start, n - 1))
    return out


def packed_pieces(sections, texts, counts, hard, settings: ChunkSettings) -> list[tuple[int, str, int]]:
    """(section, text, tokens) of the pieces of one document; long sentences come cut in `hard`."""
    prefix = [0, *accumulate(counts)]
    pieces = []
    for first, last in sentence_spans(sections, prefix, settings.max_tokens, settings.overlap_tokens):
        if last < 0:
            pieces += [(sections[first], p["text"], p["tokens"]) for p in hard[first]]
        else:
            pieces.append((sections[first], " ".join(texts[first:last + 1]), prefix[last + 1] - prefix[first]))
    return pieces


CHUNK_FIELDS = [
    ("chunk_index", pa.int32()), ("chunk_text", pa.string()), ("token_count", pa.int32()), ("chunk_hash", pa.string()),
    ("section_index", pa.int32()), ("section_heading", pa.string()), ("local_chunk_index", pa.int32()),
    ("page_start", pa.int32()), ("page_end", pa.int32())]
CHUNK_SCHEMA = ("chunk_index int, chunk_text string, token_count int, chunk_hash string, section_index int, "
                "section_heading string, local_chunk_index int, page_start int, page_end int")


def merged_chunks(pieces: list[tuple[int, str, int]], headings: list, min_tokens: int) -> list[tuple]:
    """Chunks in the order of `CHUNK_FIELDS`, without pages: a piece under the minimum joins the chunk before it."""
    chunks, members, begun = [], [], {}

    def close() -> None:
        at, (section, text, _) = members[0]
        chunks.append((
            len(chunks), "\n\n".join(p[1] for _, p in members), sum(p[2] for _, p in members),
            hashlib.sha256(text.encode()).hexdigest(), section, headings[section] or "", at - begun[section]))

    for at, piece in enumerate(pieces):
        begun.setdefault(piece[0], at)
        if members and piece[2] >= min_tokens:
            close()
            members = []
        members.append((at, piece))
    if members:
        close()
    return chunks


def chunk_batches(settings: ChunkSettings):
    """Chunk rows of documents, a batch at a time: key, sections, sentences, headings, pages, number of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, values = batch.column(2).offsets.to_pylist(), batch.column(2).values
            sections, texts, counts, hard = (values.field(n).to_pylist() for n in ("section", "text", "tokens", "hard"))
            heads, pages, totals = (batch.column(i).to_pylist() for i in (3, 4, 5))
            places, rows = [], []
            for i in range(batch.num_rows):
                part = slice(ends[i], ends[i + 1])
                pieces = packed_pieces(sections[part], texts[part], counts[part], hard[part], settings)
                chunks = merged_chunks(pieces, heads[i], settings.min_tokens)
                spans = [(1, totals[i])] * len(chunks) if pages[i] is None else located(
                    [chunk_probe(c[1]) for c in chunks], pages[i], totals[i])
                rows += [(*chunk, *span) for chunk, span in zip(chunks, spans)]
                places += [i] * len(chunks)
            taken = batch.select([0, 1]).take(pa.array(places, pa.int64()))
            columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(CHUNK_FIELDS)]
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *columns], names=[*taken.schema.names, *(n for n, _ in CHUNK_FIELDS)])

    return run


def sentence_rows(max_tokens: int, overlap: int) -> Column:
    """The sentences of `sections` with section number, tokens, and the parts of a sentence longer than a piece."""
    flat = F.flatten(F.transform("sections", lambda s, k: F.transform(
        tx.sentences(s["body"]), lambda t: F.struct(k.alias("section"), t.alias("text"), tx.word_count(t).alias("tokens")))))
    parts = lambda t: F.transform(
        tx.hard_split(t, max_tokens, overlap), lambda p: F.struct(p.alias("text"), tx.word_count(p).alias("tokens")))
    return F.transform(flat, lambda s: F.struct(
        s["section"].alias("section"), s["text"].alias("text"), s["tokens"].alias("tokens"),
        F.when(s["tokens"] > max_tokens, parts(s["text"])).alias("hard")))


def chunk_documents(
    docs: DataFrame, settings: ChunkSettings = ChunkSettings(), key: str = "doc_id",
    text_col: str = "text", total_pages: Column | int = 1, pages_col: str | None = None,
) -> DataFrame:
    """Sentence-packed chunks of every document.

    Pieces under the minimum join the chunk before them, also across sections;
    such a chunk keeps the hash of its first piece. With `pages_col`, an array of (page_no, text) on the
    document's row, each chunk gets the pages it lies on, found before the chunks become rows.
    """
    pages = total_pages if isinstance(total_pages, Column) else F.lit(total_pages)
    more = [F.col(pages_col).alias("_page_list")] if pages_col else []
    cleaned = docs.select(
        key,
        tx.strip(tx.strip_page_header_lines(tx.strip(text_col))).alias("text"),
        pages.alias("_pages"), *more,
    )
    split = with_sections(cleaned, mode=settings.heading_mode)
    found = page_texts("_page_list") if more else F.lit(None).cast("array<struct<page_no:int,text:string>>")
    total = F.greatest(F.lit(1), F.size("_page_list")) if more else F.greatest(F.lit(1), F.col("_pages"))
    ready = split.select(
        key, F.greatest(F.size("sections"), F.lit(1)).alias("_n"),
        sentence_rows(settings.max_tokens, settings.overlap_tokens).alias("_sentences"),
        F.transform("sections", lambda s: s["heading"]).alias("_headings"), found.alias("_found"),
        total.cast("int").alias("_total"))
    kept = f"{ready.schema[key].name} {ready.schema[key].dataType.simpleString()}, _n int"
    rows = ready.mapInArrow(chunk_batches(settings), f"{kept}, {CHUNK_SCHEMA}")
    return rows.select(
        key,
        F.concat_ws("-", F.col(key).cast("string"), F.col("chunk_index").cast("string"))
        .alias("chunk_id"),
        "chunk_index", "chunk_text",
        F.when(F.col("section_heading") != "", F.concat_ws("\n\n", "section_heading", "chunk_text"))
        .otherwise(F.col("chunk_text")).alias("embed_text"),
        "page_start", "page_end", "token_count", "chunk_hash", "section_index", "section_heading",
        F.bround(F.col("section_index") / F.col("_n"), 4).alias("position_ratio"),
        "local_chunk_index",
        F.lit(settings.mode).alias("chunker_mode"),
    )


# ---- pages ----------------------------------------------------------------------

def strip_repeated_page_lines(pages: DataFrame, key: str = "doc_id", threshold: int = 3) -> DataFrame:
    """Drop lines that stand in the first or last three of many pages of a document.

    `pages`: key, page_no, text. Edge lines are counted per document with a
    map-side partial count; page text only meets the few repeated lines.
    """
    edge = 3
    lined = pages.withColumn("_all", F.split("text", "\n")).withColumn(
        "_full", F.filter(F.transform("_all", tx.strip), lambda x: x != "")
    )

    def edges(side: str, part: Column) -> DataFrame:
        return lined.select(key, F.lit(side).alias("side"), F.explode(part).alias("line"))

    top = edges("top", F.slice("_full", 1, edge))
    bottom = edges("bottom", F.slice(F.reverse("_full"), 1, edge))
    repeated = (
        top.unionByName(bottom).where(F.length("line") > 5)
        .groupBy(key, "side", "line").count().where(F.col("count") >= threshold)
        .groupBy(key).agg(F.collect_set("line").alias("_noise"))
    )
    page_counts = pages.groupBy(key).agg(F.count("*").alias("_pages"))
    noise = repeated.join(page_counts.where("_pages >= 2"), key).select(key, "_noise")
    kept = F.array_join(
        F.filter("_all", lambda x: ~F.array_contains("_noise", tx.strip(x))), "\n"
    )
    return lined.join(noise, key, "left").select(
        key, "page_no",
        F.when(F.col("_noise").isNull(), F.col("text")).otherwise(tx.strip(kept)).alias("text"),
    )


def page_texts(pages: str) -> Column:
    """Stripped pages (page_no, text) in order; blank ones take no space."""
    stripped = F.transform(pages, lambda p: F.struct(p["page_no"].alias("page_no"), tx.strip(p["text"]).alias("text")))
    return F.array_sort(F.filter(stripped, lambda p: p["text"] != ""))


def chunk_probe(text: str) -> tuple[str | None, str | None, int]:
    """What a chunk is looked up by: the start of its first long line, else its own start; and its length."""
    lines = (line.strip(BLANKS) for line in text.split("\n"))
    line, start = next((x for x in lines if len(x) > 15), "")[:80], text[:80].strip(BLANKS)
    return line if len(line) > 10 else None, start if len(start) > 10 else None, len(text)


def first_places(text: str, probes: set[str]) -> dict[str, int]:
    """First place of each probe in the text: all are looked for in one walk over it."""
    if len(probes) < 8:
        return {p: at for p in probes if (at := text.find(p)) >= 0}
    machine = ahocorasick.Automaton()
    for probe in probes:
        machine.add_word(probe, probe)
    machine.make_automaton()
    found: dict[str, int] = {}
    for end, probe in machine.iter(text):
        if probe not in found:
            found[probe] = end + 1 - len(probe)
    return found


def located(probes: list[tuple], pages: list[dict], total: int) -> list[tuple[int, int]]:
    """First and last page of each chunk of a document; one that is not found has all pages.

    Pages lie one after the other, two characters apart; a chunk goes from its place on for its own
    length, and its pages are found by binary search.
    """
    starts = [0, *accumulate(len(p["text"]) + 2 for p in pages)]
    text = "".join(p["text"] + "\n\n" for p in pages)
    places = first_places(text, {q for p in probes for q in p[:2] if q})
    out = []
    for line, start, chars in probes:
        at = places.get(line, places.get(start))
        # Page i has the places from starts[i] up to starts[i + 1].
        first = -1 if at is None else bisect_right(starts, at) - 1
        last = -2 if at is None else bisect_left(starts, at + chars, 0, len(pages)) - 1
        out.append((pages[first]["page_no"], pages[last]["page_no"]) if first <= last else (1, total))
    return out


def range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page ranges of chunks gathered by document: key, chunks (chunk_index, chunk_text), pages, number of pages."""
    for batch in batches:
        places, index, spans = [], [], []
        chunks, pages, totals = (batch.column(i).to_pylist() for i in (1, 2, 3))
        for i in range(batch.num_rows):
            spans += located([chunk_probe(c["chunk_text"]) for c in chunks[i]], pages[i] or [], totals[i])
            index += [c["chunk_index"] for c in chunks[i]]
            places += [i] * len(chunks[i])
        key = batch.select([0]).take(pa.array(places, pa.int64()))
        columns = [pa.array(v, pa.int32()) for v in (index, [s[0] for s in spans], [s[1] for s in spans])]
        yield pa.RecordBatch.from_arrays(
            [key.column(0), *columns], names=[*key.schema.names, "chunk_index", "page_start", "page_end"])


def locate_pages(chunks: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Page range of each chunk (key, chunk_index, chunk_text) by the pages of a table (key, page_no, text).

    Chunks and pages come together once per document, and only ranges go back to the chunk rows. Where the pages stand on the document's row, `chunk_documents` moves nothing.
    """
    listed = pages.groupBy(key).agg(F.collect_list(F.struct(F.col("page_no").cast("int").alias("page_no"), "text")).alias("_l"))
    gathered = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("_c"))
    met = gathered.join(listed, key, "left").select(
        key, "_c", page_texts("_l").alias("_p"), F.greatest(F.lit(1), F.coalesce(F.size("_l"), F.lit(1))).alias("_t"))
    schema = f"{key} {met.schema[key].dataType.simpleString()}, chunk_index int, page_start int, page_end int"
    ranges = met.mapInArrow(range_batches, schema)
    kept = [c for c in chunks.columns if c not in ("page_start", "page_end")]
    return chunks.select(kept).join(ranges, [key, "chunk_index"], "left").select(*kept, "page_start", "page_end")


# ---- chunks made elsewhere ---------------------------------------------------------

def merge_same_section(raw: DataFrame, max_tokens: int, key: str = "doc_id") -> DataFrame:
    """Join neighbouring raw chunks of one section path while they stay small.

    `raw`: key, raw_index, text, section_path, page_numbers. The fold is
    sequential inside a document and carries positions, not text.
    """
    clean = raw.withColumn("text", tx.normalize_light("text")).where("text <> ''")
    items = clean.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("raw_index", "text", "section_path",
                         F.coalesce("page_numbers", F.array().cast("array<int>")).alias("pages"))
            )
        ).alias("_items")
    )
    out_type = "array<struct<first:int,last:int>>"

    def fold(acc: Column, i: Column) -> Column:
        item = F.element_at("_items", i)
        before = F.element_at("_items", F.greatest(i - 1, F.lit(1)))
        chars = acc["chars"] + 2 + F.length(item["text"])
        joins = (
            (i > 1) & (item["section_path"] != "") & (item["section_path"] == before["section_path"])
            & (F.floor((chars + 3) / 4) <= max_tokens)
        )
        closed = F.when(
            i > 1,
            F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"),
                                                  (i - 1).cast("int").alias("last")))),
        ).otherwise(acc["out"])
        return F.when(
            joins,
            F.struct(acc["first"].alias("first"), chars.cast("int").alias("chars"),
                     acc["out"].alias("out")),
        ).otherwise(
            F.struct(i.cast("int").alias("first"), F.length(item["text"]).alias("chars"),
                     closed.alias("out"))
        )

    def close(acc: Column) -> Column:
        return F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"),
                                                     F.size("_items").alias("last"))))

    start = F.struct(F.lit(1).alias("first"), F.lit(0).alias("chars"),
                     F.array().cast(out_type).alias("out"))
    merged = items.withColumn(
        "_spans", F.aggregate(F.sequence(F.lit(1), F.size("_items")), start, fold, close)
    )
    merged = unnest(merged, [key, "_items", F.size("_spans").alias("_n")], "_spans", "s", "chunk_index")
    members = F.slice("_items", F.col("s.first"), F.col("s.last") - F.col("s.first") + 1)
    joined = merged.select(
        key, "chunk_index", "_n",
        F.array_join(F.transform(members, lambda m: m["text"]), "\n\n").alias("chunk_text"),
        F.element_at("_items", F.col("s.first"))["section_path"].alias("section_heading"),
        F.flatten(F.transform(members, lambda m: m["pages"])).alias("_pages"),
    )
    return joined.select(
        key, "chunk_index", "chunk_text",
        F.when(F.col("section_heading") != "", F.concat_ws("\n\n", "section_heading", "chunk_text"))
        .otherwise(F.col("chunk_text")).alias("embed_text"),
        F.coalesce(F.array_min("_pages"), F.lit(1)).alias("page_start"),
        F.array_max("_pages").alias("page_end"),
        tx.estimated_tokens("chunk_text").alias("token_count"),
        F.sha2("chunk_text", 256).alias("chunk_hash"), "section_heading",
        F.bround(F.col("chunk_index") / F.greatest(F.lit(1), F.col("_n")), 4).alias("position_ratio"),
    )


def probe_metadata(raw: DataFrame, meta_col: str = "meta") -> DataFrame:
    """Section path and page numbers from open JSON metadata, first usable key wins."""
    def section(key: str) -> Column:
        whole = F.get_json_object(meta_col, f"$.{key}")
        listed = F.filter(
            F.transform(F.from_json(whole, "array<string>"), tx.strip), lambda p: p != ""
        )
        is_list, is_object = whole.startswith("["), whole.startswith("{")
        text = F.when(~is_list & ~is_object & (tx.strip(whole) != ""), tx.strip(whole))
        return F.when(is_list, F.when(F.size(listed) > 0, F.array_join(listed, " > "))).otherwise(text)

    def pages(key: str) -> Column:
        whole = F.get_json_object(meta_col, f"$.{key}")
        one = F.array(F.when(whole.rlike(r"^-?\d+$"), whole.try_cast("int")))
        many = F.from_json(whole, "array<int>")
        return F.when(whole.startswith("["), many).otherwise(one)

    numbers = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.flatten(F.array(*[
                    F.coalesce(pages(k), F.array().cast("array<int>")) for k in fixed.PAGE_KEYS
                ]))
            )
        )
    )
    return raw.withColumn(
        "section_path", F.coalesce(*[section(k) for k in fixed.SECTION_PATH_KEYS], F.lit(""))
    ).withColumn("page_numbers", numbers)


_CHUNK_LIST = "array<struct<section_heading:string,chunk_text:string,sensitivity:string>>"


def parse_chunk_lists(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Parse chunk lists written by an outside model, with three repairs.

    Code fences are cut, then whole text, first object and inner array are tried
    in turn. Rows that give no chunk get an empty `items`.
    """
    body = tx.strip(raw_col)
    body = F.regexp_replace(body, r"^```(?:json)?\s*", "")
    body = tx.strip(F.regexp_replace(body, r"\s*```\z", ""))
    cut = raw.withColumn("_body", body)
    inner = F.regexp_extract("_body", r'(?s)\{.*?"chunks"\s*:\s*(\[.*\])\s*\}', 1)
    head = F.regexp_extract("_body", r"(?s)^\{.*\}", 0)

    def chunks_of(text: Column) -> Column:
        return F.from_json(F.get_json_object(text, "$.chunks"), _CHUNK_LIST)

    bare = F.when(F.col("_body").startswith("["), F.from_json("_body", _CHUNK_LIST))
    items = F.coalesce(
        bare, chunks_of(F.col("_body")), chunks_of(head),
        F.when(inner != "", F.from_json(inner, _CHUNK_LIST)),
        F.array().cast(_CHUNK_LIST),
    )
    return cut.withColumn("items", F.filter(items, lambda i: i.isNotNull())).drop("_body")


def external_chunks(
    parsed: DataFrame, settings: ChunkSettings, key: str = "doc_id",
    sensitivity_col: str = "sensitivity",
) -> DataFrame:
    """Chunk rows from parsed lists: label within one level of the document,
    texts over twice the maximum cut into windows."""
    top, lap = settings.max_tokens, settings.overlap_tokens
    items = unnest(
        parsed, [key, sensitivity_col, F.size("items").alias("_n")], "items", "_it", "_i"
    ).select(
        key, "_n", "_i", tx.strip(F.coalesce("_it.chunk_text", F.lit(""))).alias("_text"),
        tx.strip(F.coalesce("_it.section_heading", F.lit(""))).alias("section_heading"),
        F.col(sensitivity_col).alias("_doc"),
        F.coalesce(F.nullif(F.col("_it.sensitivity").try_cast("int"), F.lit(0)),
                   F.col(sensitivity_col)).alias("_raw"),
    ).where("_text <> ''")
    pieces = items.withColumn(
        "_parts",
        F.when(tx.estimated_tokens("_text") > 2 * top, tx.hard_split(F.col("_text"), top, lap))
        .otherwise(F.array("_text")),
    )
    pieces = unnest(pieces, ["*"], "_parts", "chunk_text", "_j")
    order = Window.partitionBy(key).orderBy("_i", "_j")
    return pieces.select(
        key, (F.row_number().over(order) - 1).alias("chunk_index"), "chunk_text",
        F.when(F.col("section_heading") != "", F.concat_ws("\n\n", "section_heading", "chunk_text"))
        .otherwise(F.col("chunk_text")).alias("embed_text"),
        tx.estimated_tokens("chunk_text").alias("token_count"),
        F.sha2("chunk_text", 256).alias("chunk_hash"), "section_heading", "_n",
        clamp_chunk_label(F.col("_raw"), F.col("_doc")).alias("chunk_sensitivity"),
    ).withColumn(
        "position_ratio", F.bround(F.col("chunk_index") / F.greatest(F.lit(1), F.col("_n")), 4)
    ).drop("_n").withColumn("chunker_mode", F.lit("llm_structured"))


def clamp_chunk_label(label: Column, document_level: Column) -> Column:
    near = F.greatest(document_level - 1, F.least(document_level + 1, label))
    return F.greatest(F.lit(fixed.MIN_LEVEL), F.least(F.lit(fixed.MAX_LEVEL), near))


def chunk_by_mode(
    docs: DataFrame, external: DataFrame, settings: ChunkSettings, key: str = "doc_id"
) -> DataFrame:
    """Send each document to its mode; those whose outside list is missing or
    empty fall back to sentence packing with a larger minimum."""
    columns = [key, "chunk_index", "chunk_text", "embed_text", "token_count", "chunk_hash",
               "section_heading", "position_ratio", "chunker_mode"]
    legacy = chunk_documents(docs.where("mode = 'legacy'"), settings, key)
    wanted = docs.where("mode <> 'legacy'")
    outside = external_chunks(
        parse_chunk_lists(external).join(wanted.select(key), key, "left_semi"), settings, key
    )
    missing = wanted.join(outside.select(key).distinct(), key, "left_anti")
    backup = chunk_documents(
        missing,
        ChunkSettings(settings.max_tokens, settings.overlap_tokens, fixed.FALLBACK_MIN_TOKENS,
                      settings.heading_mode),
        key,
    )
    return (
        legacy.select(columns).unionByName(outside.select(columns)).unionByName(backup.select(columns))
    )


def chunk_config(configs: DataFrame, json_col: str = "config") -> DataFrame:
    """Typed settings from JSON with defaults; out-of-range rows are marked."""
    parsed = F.from_json(
        F.coalesce(F.col(json_col), F.lit("{}")),
        "mode string, max_tokens int, overlap_tokens int, ocr boolean",
    )
    low, high = fixed.CONFIG_MAX_RANGE
    lap_low, lap_high = fixed.CONFIG_OVERLAP_RANGE
    out = configs.withColumn("_c", parsed)
    typed = out.select(
        *configs.columns,
        F.coalesce("_c.mode", F.lit(fixed.CONFIG_DEFAULT_MODE)).alias("mode"),
        F.coalesce("_c.max_tokens", F.lit(fixed.CONFIG_MAX_TOKENS)).alias("max_tokens"),
        F.coalesce("_c.overlap_tokens", F.lit(fixed.CONFIG_OVERLAP_TOKENS)).alias("overlap_tokens"),
        F.coalesce("_c.ocr", F.lit(False)).alias("ocr"),
    )
    return typed.withColumn(
        "valid",
        F.col("mode").isin(fixed.CONFIG_MODES) & F.col("max_tokens").between(low, high)
        & F.col("overlap_tokens").between(lap_low, lap_high),
    )


# ---- tables -------------------------------------------------------------------------

def table_to_markdown(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown for tables given as cells: key, row_no, col_no, cell.

    Empty columns go; a column and its right neighbour merge when no row has two
    different values in them. Only per-column facts and one row at a time are
    held together.
    """
    clean = cells.withColumn(
        "cell", F.replace(tx.strip(F.coalesce("cell", F.lit(""))), F.lit("\n"), F.lit(" "))
    )
    full = clean.groupBy(key, "col_no").agg(F.max(F.length("cell")).alias("_w")).where("_w > 0")
    dense = full.withColumn(
        "_c", F.row_number().over(Window.partitionBy(key).orderBy("col_no"))
    ).select(key, "col_no", "_c")
    kept = clean.where("cell <> ''").join(dense, [key, "col_no"]).select(key, "row_no", "_c", "cell")

    right = kept.select(key, "row_no", (F.col("_c") - 1).alias("_c"), F.col("cell").alias("_next"))
    clash = (
        kept.join(right, [key, "row_no", "_c"]).where("cell <> _next")
        .select(key, "_c").distinct().withColumn("_clash", F.lit(True))
    )
    facts = dense.join(clash, [key, "_c"], "left").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_c", F.coalesce("_clash", F.lit(False)).alias("clash"))))
        .alias("_cols")
    )

    def group(acc: Column, c: Column) -> Column:
        # (out: output column per input column, free: previous may take this one)
        joins = acc["free"]
        number = F.when(joins, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(
            F.concat(acc["out"], F.array(number)).alias("out"), number.alias("n"),
            (~joins & ~c["clash"]).alias("free"),
        )

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("n"),
                     F.lit(False).alias("free"))
    mapping = unnest(
        facts.withColumn("_g", F.aggregate("_cols", start, group)),
        [key, F.col("_g.n").alias("_ncols")], "_g.out", "_o", "_p",
    ).select(key, "_ncols", (F.col("_p") + 1).alias("_c"), "_o")

    rows = clean.select(key, "row_no").distinct()
    widths = mapping.select(key, "_ncols").distinct()
    filled = (
        kept.join(mapping, [key, "_c"]).groupBy(key, "row_no", "_o")
        .agg(F.min_by("cell", "_c").alias("cell"))
        .groupBy(key, "row_no")
        .agg(F.map_from_entries(F.collect_list(F.struct("_o", "cell"))).alias("_m"))
    )
    lines = rows.join(widths, key).join(filled, [key, "row_no"], "left").select(
        key, "row_no", "_ncols",
        F.concat(
            F.lit("| "),
            F.array_join(
                F.transform(
                    F.sequence(F.lit(1), F.col("_ncols")),
                    lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit("")),
                ),
                " | ",
            ),
            F.lit(" |"),
        ).alias("line"),
    )
    return lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("_l"),
        F.first("_ncols").alias("_n"),
    ).select(
        key,
        F.array_join(
            F.flatten(F.array(
                F.transform(F.slice("_l", 1, 1), lambda x: x["line"]),
                F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("_n")), " | "), F.lit(" |"))),
                F.transform(F.slice("_l", 2, F.size("_l")), lambda x: x["line"]),
            )),
            "\n",
        ).alias("markdown"),
    )
