"""Column functions over text. All run inside the JVM except the Unicode
compatibility folding, which only sees rows that can need it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievegate.functions import fixed_values as fixed

# Every character that Python's str.strip() removes.
WHITESPACE = "".join(chr(n) for n in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                      *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def words(c: Column | str) -> Column:
    """Whitespace separated words; an empty array for blank text."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Name a value inside an expression, so it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- tokens -----------------------------------------------------------------

def search_tokens(c: Column | str) -> Column:
    """Lower-cased words longer than one character, repeats kept."""
    return F.filter(words(F.lower(col(c))), lambda w: F.length(w) > 1)


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def estimated_tokens(c: Column | str) -> Column:
    n = F.length(col(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4).cast("int")))


def drop_stopwords(tokens: Column) -> Column:
    """Tokens that are not stopwords; all of them if nothing would be left."""
    stop = F.array(*[F.lit(w) for w in fixed.STOPWORDS])
    kept = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def longest_token(tokens: Column) -> Column:
    """First of the longest tokens."""
    return F.aggregate(
        tokens, F.lit(""),
        lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best),
    )


def _accent_map() -> tuple[str, str]:
    ranges = [(0xC0, 0x250), (0x1E00, 0x1F00)]
    source, target = ["đ", "Đ"], ["d", "D"]
    for low, high in ranges:
        for code in range(low, high):
            char = chr(code)
            base = "".join(
                x for x in unicodedata.normalize("NFD", char) if unicodedata.category(x) != "Mn"
            )
            if base != char and len(base) == 1:
                source.append(char)
                target.append(base)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_map()


def strip_accents(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(col(c), _ACCENTED, _PLAIN), r"\p{Mn}", "")


# ---- normalisation ------------------------------------------------------------

# All but the letters that compatibility folding never changes unless a combining mark follows. Ranges of what to find:
# Java takes about ten times as long to search for a negated union of them.
_MAY_FOLD = (
    r"[\x80-\u00BF\u0132\u0133\u013F\u0140\u0149\u017F-\u019F"
    r"\u01A2-\u01AE\u01B1-\u1E9F\u1EFA-\x{10FFFF}]"
)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatibility_fold(c: Column | str) -> Column:
    c = col(c)
    # Texts of one byte a letter, as most are, are known by their lengths.
    wide = F.octet_length(c) != F.length(c)
    return F.coalesce(_nfkc(F.when(wide & c.rlike(_MAY_FOLD), c)), c)


def unix_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalize_text(c: Column | str, fold: bool = True) -> Column:
    """Full clean-up: width folding, newlines, zero-width marks, hyphen breaks,
    bullets, blanks, blank lines."""
    t = unix_newlines(compatibility_fold(c) if fold else col(c))
    t = F.regexp_replace(t, "[\\u200B-\\u200D\\uFEFF]", "")
    t = F.regexp_replace(t, r"(?U)(?<=\w)-\n(?=\w)", "")
    t = F.regexp_replace(
        t, r"(?md)^[ \t]*[-\u2022\u00B7\u2219][ \t]+|^[ \t]*\*(?!\*)[ \t]+", ""
    )
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n"), strip), "\n")
    t = F.regexp_replace(t, r"\n{2,}", "\n\n")
    return F.coalesce(strip(t), F.lit(""))


def normalize_light(c: Column | str) -> Column:
    t = unix_newlines(col(c))
    t = F.regexp_replace(t, r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def html_to_text(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), r"(?isu)<(style|script)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, char in [
        ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        ("&quot;", '"'), ("&#39;", "'"),
    ]:
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.coalesce(strip(t), F.lit(""))


def strip_page_header_lines(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "(?imuUd)" + fixed.PAGE_HEADER_LINE, "")


def clean_noise(c: Column | str) -> Column:
    """Keep the meaningful words of lines that have at least two of them."""
    def core(token: Column) -> Column:
        return F.regexp_replace(token, r"(?U)^[^\w]+|[^\w]+$", "")

    def meaningful(token: Column) -> Column:
        letters = F.regexp_count(token, F.lit(r"\p{L}"))
        return (F.length(token) >= 2) & (letters >= 2) & (letters / F.length(token) >= 0.5)

    kept = F.transform(
        F.split(col(c), "\n"),
        lambda line: F.filter(F.transform(words(line), core), meaningful),
    )
    good = F.filter(kept, lambda ws: F.size(ws) >= 2)
    return F.array_join(F.transform(good, lambda ws: F.array_join(ws, " ")), "\n")


def join_as_flow(lines: Column) -> Column:
    """Join short, uniform labels with arrows, other lines with line breaks."""
    counts = F.transform(lines, word_count)
    n = F.size(lines)
    avg = F.aggregate(counts, F.lit(0), lambda a, x: a + x) / n
    uniform = (avg <= 5) & (F.array_max(counts) <= F.greatest(avg * 2, F.lit(6.0)))
    return F.when((n >= 3) & uniform, F.array_join(lines, " → ")).otherwise(
        F.array_join(lines, "\n")
    )


# ---- headings and sentences ---------------------------------------------------

def is_heading(line: Column, mode: str = "compat", stripped: bool = False) -> Column:
    """Heading test for one line.

    `compat` ignores letter case in every rule; `strict` asks for real capitals
    in the numbered and all-capitals rules.
    """
    caps = fixed.HEADING_CAPITALS
    named = (
        r"^\s*(?:chương|phần|mục|section|chapter)\s+[\dIVXivx]+[\.:]\s*.+"
        r"|^\s*(?:Điều|điều)\s+\d+[\.\:]\s*.+"
    )
    capital = (
        rf"^\s*\d+[\.\)]\s+[{caps}].{{3,80}}$|^\s*[{caps}]{{4,}}(?:\s+[{caps}]+)*\s*$"
    )
    line = line if stripped else strip(line)
    bare = F.regexp_replace(line, r"^\*{1,3}(.*?)\*{1,3}$", "$1")
    # The head word and the closing words decide cheaply before the long patterns run.
    closing = "(?:" + "|".join(fixed.HEADING_NOT_ENDING) + r")\z"
    return (
        (line != "")
        & (F.length(line) <= fixed.HEADING_MAX_CHARS)
        & ~line.rlike("(?iuU)" + fixed.PAGE_HEADER_WORDS)
        & ~bare.rlike(closing)
        & (
            bare.rlike("(?iuU)" + named)
            | bare.rlike(("(?iuU)" if mode == "compat" else "(?U)") + capital)
        )
    )


def sentences(c: Column | str) -> Column:
    parts = F.split(strip(c), r"(?U)(?<=[.!?。！？])\s+|\n+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def hard_split(c: Column, max_tokens: int, overlap: int) -> Column:
    """Fixed windows of words, each starting `overlap` words before the last end."""
    step = max(1, max_tokens - overlap)

    def windows(ws: Column) -> Column:
        n = F.size(ws)
        last = F.greatest(F.lit(0), F.ceil((n - max_tokens) / step).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(ws, i * step + 1, F.lit(max_tokens)), " "),
        )

    return F.filter(let(words(c), windows), lambda p: p != "")


# ---- small text rules -----------------------------------------------------------

def is_no_answer(c: Column | str) -> Column:
    t = strip(F.lower(col(c)))
    hit = F.lit(False)
    for phrase in fixed.NO_ANSWER_PHRASES:
        hit = hit | t.contains(phrase)
    return F.when(col(c).isNull() | (col(c) == ""), True).otherwise(hit)


def drop_think_blocks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)<think>.*?</think>", "")


def cited_numbers(c: Column | str) -> Column:
    """Sorted distinct numbers of `[n]` markers."""
    found = F.regexp_extract_all(col(c), F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("long"))))


def renumber_citations(c: Column | str, cited: Column) -> Column:
    """Replace every cited number by its 1-based position in `cited`.

    Two passes keep new numbers from being replaced again.
    """
    marked = F.aggregate(
        cited, col(c),
        lambda t, n: F.replace(
            t, F.concat(F.lit("["), n.cast("string"), F.lit("]")),
            F.concat(F.lit("[\u0001"), F.array_position(cited, n).cast("string"), F.lit("]")),
        ),
    )
    return F.replace(marked, F.lit("[\u0001"), F.lit("["))


def markdown_wrap(c: Column | str, mark: Column) -> Column:
    """Put `mark` around the text, keeping outer blanks outside."""
    c = col(c)
    inner = strip(c)
    lead = F.regexp_extract(c, r"(?U)^\s*", 0)
    tail = F.regexp_extract(c, r"(?U)\s*\z", 0)
    return F.when(inner == "", c).otherwise(F.concat(lead, mark, inner, mark, tail))


def file_extension(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), r"\.([^.]*)$", 1))


def first_json_object(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
