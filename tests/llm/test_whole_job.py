"""What the operators once left out: order of training, runs and texts beyond a bound."""

from collections import defaultdict

import corpus_pipeline
import numpy as np

from sievegate.llm import queries
from sievegate.llm.language import identify, reject, rejection_limits, train
from sievegate.llm.mixing import mix_documents, ordered_mix
from sievegate.llm.sharding import with_place
from sievegate.llm.toxicity import ToxicityModel

FOLDER = "/root/testdata/sf0.001"


def test_op9_comes_in_training_order(spark):
    first = {r["doc_id"]: min(r["positions"], default=2.0) for r in mix_documents(
        spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    got = [r["doc_id"] for r in queries.QUERIES["op9_curriculum_mix"](spark, FOLDER).collect()]
    assert len(got) == len(first) and [first[i] for i in got] == sorted(first.values())


def test_ranks_are_those_of_the_ordered_mix(spark):
    want = [(k + 1, r["doc_id"], r["position"]) for k, r in enumerate(
        ordered_mix(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect())]
    rows = queries.QUERIES["op9_curriculum_order"](spark, FOLDER).collect()
    assert sorted((r["rank"], r["doc_id"], r["position"]) for r in rows) == want


def test_slots_follow_the_training_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = corpus_pipeline.mix(spark, docs, FOLDER)
    order = [r["doc_id"] for r in mixed.collect()]
    mixed.write.parquet(f"{tmp_path}/mix")
    read = spark.read.parquet(f"{tmp_path}/mix")
    assert [r["doc_id"] for r in with_place(read, "p").orderBy("p").collect()] == order
    slots, want = defaultdict(list), defaultdict(list)
    rows = corpus_pipeline.shards(spark, read, FOLDER).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    for r in sorted(rows, key=lambda r: r["slot"]):
        slots[r["shard"]].append(r["doc_id"])
    for i in order:
        want[shard[i]].append(i)
    assert slots == want


def test_language_parts_lose_no_run(spark):
    """A bound far below the runs of each language changes how many parts there are, and nothing else."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").limit(60)
    whole, cut = train(frame), train(frame, most=1500)
    assert whole.parts == 1 and 1 < cut.parts < 20
    one, two = ({r["doc_id"]: r for r in identify(frame, m).collect()} for m in (whole, cut))
    for i, r in one.items():
        assert r["lang_pred"] == two[i]["lang_pred"]
        assert abs(r["cross_entropy"] - two[i]["cross_entropy"]) < 1e-4
    runs = np.array([[32, 97, b, c] for b in range(97, 123) for c in range(97, 123)], dtype=np.uint32)
    assert np.allclose(whole.lookup(runs, 4), cut.lookup(runs, 4), atol=1e-4)


def test_rejection_limits_are_from_all_rows(spark):
    """A language in 3 of 40,003 rows has a limit of its own, and null ids are no one row."""
    common = spark.range(40_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'en' AS lang", "id / 10000D AS cross_entropy")
    rare = spark.range(3).selectExpr("id AS doc_id", "'xx' AS lang", "id + 1D AS cross_entropy")
    rows = common.unionByName(rare).selectExpr("*", "lang AS lang_pred", "false AS rejected")
    limits = rejection_limits(rows)
    assert abs(limits["en"] - 4.496) < 1e-3 and limits["xx"] == 3.5
    odd = spark.createDataFrame([("xx", 3.6), ("xx", 3.4), ("en", 4.4), ("zz", 9.0), ("und", None)], "lang_pred string, cross_entropy double")
    assert [r["rejected"] for r in reject(odd.selectExpr("*", "false AS rejected"), limits).collect()] == [True, False, False, False, False]
    assert not reject(odd.selectExpr("*", "false AS rejected"), {}).where("rejected").count()


def test_rare_short_and_several_toxic_words_count():
    """Terms in 1 % of the toxic texts: a short word, a phrase of ordinary words, and a large vocabulary."""
    rng = np.random.default_rng(2)
    common, vile = (["".join(rng.choice(list(letters), 8)) for _ in range(n)] for letters, n in (
        ("abcdefghijklm", 150), ("nopqrstuvwxyz", 98)))
    common += ["go", "back", "home", "now"]
    terms = [*vile, "zog", "go back home"]
    text = lambda *more: " ".join([*rng.choice(common, 30), *more, *rng.choice(common, 30)]).encode()
    toxic = [text(terms[i % 100]) for i in range(2000)]
    ordinary = [text() for _ in range(2000)]
    model = ToxicityModel(toxic, ordinary)
    words, phrases = model.contrast(toxic, ordinary)
    assert set(words) == {t.encode() for t in terms[:99]} and b"go back home" in phrases
    score = model.scorer()
    assert all(score(text(t)) >= 0.5 for t in terms)
    assert sum(score(text()) >= 0.5 for _ in range(300)) < 6


def test_few_different_words_count_at_every_length(spark):
    """Texts of 52 different words, without repeated windows: 399 words, 400, and far more get the same vote."""
    from sievegate.llm.quality import WINDOW, judge_quality, text_features

    rng = np.random.default_rng(8)
    few, many = ([f"{c}{''.join(rng.choice(list('aeiou'), 4))}{i}" for i, c in enumerate(rng.choice(list("bcdfg"), n))] for n in (24, 4000))
    text = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(n, text(few, n)) for n in (300, 399, 400, 800, 1600, 6400)] + [(-n, text(many, n)) for n in (300, 399, 400, 800, 1600, 6400)]
    rows += [(100_000 + k, r[1] + " " + r[1]) for k, r in enumerate(rows[6:8])]
    votes = {r["doc_id"]: r["votes"][6] for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, v in votes.items() if v == -1} == {n for n, _ in rows if 0 < n < 100_000}
    for n in (1, WINDOW - 1, WINDOW, WINDOW + 1, 5 * WINDOW + 3):
        words = text(many, n).split()
        windows = [words[-WINDOW:] if at + WINDOW > n else words[at:at + WINDOW] for at in range(0, n, WINDOW)]
        assert text_features(" ".join(words))[-2:] == (sum(map(len, windows)), sum(len(set(w)) for w in windows))
    assert text_features("")[-2:] == (0, 0)


def test_expectation_maximisation_against_every_class_of_every_text():
    """Accuracies and posteriors, spelled out text by text with plain probabilities."""
    from sievegate.llm.quality import estimate, posterior

    rng = np.random.default_rng(2)
    good = rng.random(4000) < 0.8
    votes = np.zeros((4000, 4), dtype=int)
    for rule, (right, says) in enumerate([(0.95, 0.9), (0.9, 0.7), (0.8, 0.5), (0.85, 0.3)]):
        spoken, true = rng.random(4000) < says, rng.random(4000) < right
        votes[:, rule] = np.where(spoken, np.where(true == good, 1, -1), 0)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    prior, table = estimate(patterns, weight.astype(float))
    one_prior, one_table = estimate(votes, np.ones(4000))
    assert abs(prior - one_prior) < 1e-6 and np.abs(table - one_table).max() < 1e-6
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    found = posterior(prior, table, hot)
    for row, p in list(zip(votes, found))[:200]:
        chances = [(1 - prior) if c == 0 else prior for c in (0, 1)]
        for rule, v in enumerate(row):
            if v:
                chances = [x * table[c, rule, v + 1] for c, x in enumerate(chances)]
        assert abs(chances[1] / sum(chances) - p) < 1e-9
    assert abs(prior - good.mean()) < 0.05 and ((found >= 0.5) == good).mean() > 0.93


def test_altered_notices_are_found(spark):
    """Any three words outside the required phrases replaced: every notice with enough words in place is found."""
    from itertools import combinations

    from sievegate.llm.licenses import TEMPLATES, find_notices, has_phrase, inverse_frequency, postings, scan_licenses

    rng = np.random.default_rng(5)
    texts, want = [], []
    for t, template in enumerate(TEMPLATES):
        fixed = {i for p in template.required for i in range(len(template.words) - len(p) + 1)
                 if template.words[i:i + len(p)] == p for i in range(i, i + len(p))}
        free = [i for i in range(len(template.words)) if i not in fixed]
        for out in list(combinations(free, min(3, len(free))))[::97]:
            if 4 * (len(template.words) - len(out)) < 3 * len(template.words):
                continue
            words = [b"xyzzy" if i in out else w for i, w in enumerate(template.words)]
            before = [f"some{i} text{i}" for i in range(int(rng.integers(0, 9)))]
            texts.append(" ".join([*before, *(w.decode() for w in words), "and more the of 2 to"]))
            want.append((t, 2 * len(before)))
    rows = scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        t, start = want[r["doc_id"]]
        assert (TEMPLATES[t].label, start) in {(m["label"], m["start"]) for m in r["matches"]}, texts[r["doc_id"]]
    mit = next(t for t in TEMPLATES if t.words[:2] == [b"permission", b"is"])
    altered = [b"x" if w in (b"obtaining", b"associated", b"deal") else w for w in mit.words]
    idf = inverse_frequency({}, 10)
    assert (TEMPLATES.index(mit), 0) in {(t, at) for t, at, _ in find_notices(altered, postings(), idf)}
    # Every place that the verification would accept, against proposals from every word.
    for text in texts[::7]:
        words = text.encode().split()
        found = {t for t, *_ in find_notices(words, postings(), idf)}
        for t, template in enumerate(TEMPLATES):
            size, slack = len(template.words), template.slack
            there = any(
                all(has_phrase(words, p, s - slack, s + size + slack - len(p)) for p in template.required)
                and 4 * sum(w in words[max(0, s + i - slack):max(0, s + i + slack + 1)] for i, w in enumerate(template.words)) >= 3 * size
                for s in range(-slack, len(words))) if not template.exact else any(
                words[s:s + size] == template.words for s in range(len(words)))
            assert (t in found) == there, (text, template.label)
