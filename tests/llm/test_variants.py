"""Spelling variants, repeated lines and the prefix trie against brute force, on odd rows and hot groups."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sievegate.llm import queries
from sievegate.llm.lines import drop_lines, kept_text, mark_lines
from sievegate.llm.tries import conversation_trie
from sievegate.llm.variants import BLOCK, group_variants, keyed_words, split_blocks, vocabulary

FOLDER = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def variants_by_hand(counts, times=10):
    """All near pairs through the words with one letter left out, then forms and roots."""
    cut = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            cut[w[:i] + w[i + 1:]].add((w, i))
    near = defaultdict(set)
    for rest, pairs in cut.items():
        if rest in counts:
            for w, _ in pairs:
                near[w].add(rest)
                near[rest].add(w)
        for w, i in pairs:
            near[w] |= {v for v, j in pairs if i == j and v != w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None)
    return out


def as_map(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = variants_by_hand(words_by_hand(rows))
    got = queries.QUERIES["op11_spelling_variants"](spark, FOLDER).collect()
    assert len(got) == len(want) and as_map(queries.QUERIES["op11_spelling_variants"](spark, FOLDER)) == want
    assert any(f for f, *_ in want.values())


@pytest.mark.parametrize("block", [2, 5, 64, BLOCK])
def test_every_block_size_finds_the_same(spark, block):
    """Words over few letters, with runs of one letter, where edits have several places."""
    rng = np.random.default_rng(3)
    counts = {}
    for _ in range(900):
        word = "".join(rng.choice(list("abé"), int(rng.integers(1, 9))))
        counts[word] = int(rng.integers(1, 2000))
    counts |= {"a" * k: 10 ** (k % 4) for k in range(1, 12)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = variants_by_hand(counts)
    assert as_map(group_variants(frame, block=block)) == want
    assert any(f and f != r for f, r, *_ in want.values())


def test_a_hot_block_is_split(spark):
    """A third of the vocabulary shares its last five letters: no block keeps more than the bound and an alphabet."""
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abcdefghij"), 5)) + "zzzzz" for _ in range(4000)}
    words |= {"".join(rng.choice(list("klmnopqrst"), 10)) for _ in range(6000)}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    from sievegate.session import shared_dir
    shared_dir(spark)
    sizes = [r["count"] for r in split_blocks(keyed_words(frame), 100).groupBy("key").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) < 12 * len(words)


def test_vocabulary_of_odd_rows(spark):
    rows = [(None, "Lettering lettering LETTERING"), (1, None), (2, ""), (3, "Éléphants éléphants ÉLÉPHANTS"),
            (4, "漢字lettering İstanbul×÷abcdefg ſlettering"), (4, "漢字lettering İstanbul×÷abcdefg ſlettering"), (5, "spelling " * 40_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    want = words_by_hand(rows)
    assert {r["word"]: r["n"] for r in vocabulary(frame).collect()} == want
    assert as_map(group_variants(vocabulary(frame))) == variants_by_hand(want)
    assert not group_variants(vocabulary(frame.limit(0))).collect()
    odd = spark.createDataFrame([("abcdefg", 1), ("abcdefg", 2), (None, 5)], "word string, n long")
    assert as_map(group_variants(odd)) == {"abcdefg": (None, "abcdefg", 3, 0, None)}


def lines_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)
    order = lambda i: (i is None, i)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)], key=order) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


HOT = "This very line is in every document"
LINES = [
    (1, f"{HOT}\nown line one\nshort\nshort"), (2, f"  {HOT.upper()}\t\r\nown line two\n{HOT}"), (2, f"  {HOT.upper()}\t\r\nown line two\n{HOT}"),
    (3, None), (4, ""), (None, f"{HOT}\nnobody's own line"), (None, f"another of nobody\n{HOT}"), (5, "own line one\n\n\n"),
    (6, "ÉTÉ été ÉTÉ\nÉTÉ ÉTÉ ÉTÉ"), (7, "ÉTÉ été ÉTÉ\nété été été"), (8, "漢字漢字漢字漢字漢\n漢字漢字漢字漢字漢字"), (9, "漢字漢字漢字漢字漢\n漢字漢字漢字漢字漢字"),
    (10, "\n".join(f"line {i % 3000} of a long text" for i in range(30_000))), (11, "line 7 of a long text\nline 2 of a long text"),
    (2, f"another text of number two\n{HOT}"),
]


@pytest.fixture(scope="module")
def lined(spark):
    return spark.createDataFrame(
        [(*r, "x", 1, b"y") for r in LINES], "doc_id long, text string, _doc string, positions int, keep binary")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_lines_against_brute_force(lined, parts):
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in mark_lines(lined, parts=parts).collect()), key=str)
    assert got == lines_by_hand(LINES)


def test_a_line_in_all_documents_over_many_ranges(spark):
    rows = [(i, f"{HOT}\nline {i} of its own\n{HOT}" if i % 3 else HOT) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in mark_lines(frame, parts=50).collect()), key=str)
    assert got == lines_by_hand(rows)


def test_bitmaps_rebuild_texts(spark, lined):
    marked = mark_lines(lined).collect()
    assert [c for c in ("doc_id", "text", "_doc", "positions", "n_lines", "n_dropped", "keep", "kept_sha256")] == list(
        marked[0].asDict())
    for r in marked:
        assert hashlib.sha256(kept_text((r["text"] or "").encode(), r["keep"])).hexdigest() == r["kept_sha256"]
        assert (r["keep"] is None) == (r["n_dropped"] == 0)
    out = drop_lines(lined)
    assert out.columns == lined.columns and out.count() == len(LINES)
    texts = [r["text"] for r in out.where("doc_id = 2").collect()]
    assert sorted(texts) == ["another text of number two", "own line two", "own line two"]
    assert not mark_lines(lined.limit(0)).collect() and not drop_lines(lined.limit(0)).collect()


def trie_by_hand(rows):
    """Every prefix of every rebuilt conversation, spelled out."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = tuple(said.get(base, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[s[:d]].add(c)
    size = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    out = []
    for s, ids in members.items():
        under = [t for t in members if t[:len(s)] == s]
        children = [t for t in under if len(t) == len(s) + 1]
        leaves = [t for t in under if not any(len(u) == len(t) + 1 and u[:len(t)] == t for u in under)]
        ends = ",".join(str(c) for c in sorted(ids) if built[c] == s)
        out.append((min(ids), len(s), min(members[s[:-1]]) if s else None, len(ids), len(children), len(leaves),
                    sum((len(members[t]) - 1) * size(t) for t in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for c in [*range(-25, 130), 401, 10_003, 123_456_789_012]:
        if c % 20 == 0 and c % 60 == 0 and c:
            continue  # absent bases
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t if rng.random() < 0.9 else None, str(rng.choice(["user", "bot"])) if rng.random() < 0.9 else None,
                         str(rng.choice(["a b", "c", "", "d e f\n g"])) if rng.random() < 0.9 else None))
    rows += [(None, 1, "user", "nobody's"), (7, 0, "user", "a b"), (7, 0, "user", "a b"), (8, 5, "user", "word " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, depth string, x1 int")
    out = conversation_trie(frame)
    assert out.columns == TRIE
    assert sorted((tuple(r) for r in out.collect()), key=str) == trie_by_hand(rows)
    assert not conversation_trie(frame.limit(0)).collect()


def test_trie_of_a_very_long_and_of_many_equal_conversations(spark):
    """Blocks of turns and pieces of ids meet: 1,500 turns in one, and 9,000 equal conversations."""
    rows = [(20, t, "user", f"turn {t}") for t in range(1500)]
    rows += [(c, 0, "user", "the very same") for c in range(100_000, 109_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in conversation_trie(frame).collect()), key=str)
    said = defaultdict(list)
    for c, _, role, text in rows:
        said[c].append((role, text))
    built = {c: tuple(said.get(c - c % 20, [])[:zlib.crc32(str(c).encode()) % 4] + own[zlib.crc32(str(c).encode()) % 4:])
             for c, own in said.items()}
    ids = defaultdict(set)
    for c, s in built.items():
        for d in range(len(s) + 1):
            ids[s[:d]].add(c)
    # One chain of 1,500 turns, the equal ones, and the root.
    assert len(got) == len(ids) and {(r[0], r[1], r[3]) for r in got} == {(min(v), len(s), len(v)) for s, v in ids.items()}
    root = next(r for r in got if r[1] == 0)
    one = (("user", "the very same"),)
    same = ",".join(str(c) for c in sorted(c for c, s in built.items() if s == one))
    assert root[3:7] == (9001, 2, 2, (len(ids[one]) - 1) * 3)
    assert next(r for r in got if r[1] == 1 and r[0] != 20)[7] == hashlib.sha256(same.encode()).hexdigest()
