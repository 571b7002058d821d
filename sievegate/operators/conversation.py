"""Messages, memory, citations and traces.

Messages: message_id, conv_id, role, content, status, parent_message_id, created_s.
Long conversations are first cut to the rows the feature reads (top-k per
conversation, cut before the shuffle), so no group grows without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegate.functions import fixed_values as fixed
from sievegate.functions import scoring as sc
from sievegate.functions import text as tx
from sievegate.operators.common import top_k, unnest

TIME = ("created_s", "message_id")


def first_messages(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """The first `limit` messages of every conversation, or all, with their position."""
    order = [F.col(c).asc() for c in TIME]
    if limit is None:
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
        return messages.withColumn("position", place - 1)
    return top_k(messages, ["conv_id"], order, limit, "position")


def finished(rows: DataFrame) -> DataFrame:
    """Assistant rows in a final state with content."""
    return rows.where(
        (F.col("role") == "assistant") & F.col("status").isin(fixed.DONE_STATUSES)
        & F.col("content").isNotNull() & (F.col("content") != ""))


def qa_pairs(messages: DataFrame, limit: int | None = None) -> DataFrame:
    """conv_id, pair_no, question, answer with ids: a user row directly followed by a usable reply."""
    rows = first_messages(messages, limit)
    order = Window.partitionBy("conv_id").orderBy("position")
    nxt = {c: F.lead(c).over(order) for c in ("role", "status", "content", "message_id")}
    seen = rows.select(
        "conv_id", "position", "role", "content", "message_id", "created_s",
        *[v.alias("next_" + k) for k, v in nxt.items()])
    usable = F.col("next_status").isin(fixed.DONE_STATUSES) | (
        (F.col("next_status") == "streaming") & (F.length(tx.strip("next_content")) > 10))
    pairs = seen.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & usable)
    return pairs.select(
        "conv_id", (F.row_number().over(order) - 1).alias("pair_no"),
        F.col("message_id").alias("user_message_id"), F.col("next_message_id").alias("reply_id"),
        F.coalesce("content", F.lit("")).alias("question"),
        F.coalesce("next_content", F.lit("")).alias("answer"),
    )


def split_pairs(pairs: DataFrame, recent: int = fixed.RECENT_PAIRS) -> DataFrame:
    """Add `is_recent` for the last pairs of a conversation."""
    back = Window.partitionBy("conv_id").orderBy(F.col("pair_no").desc())
    return pairs.withColumn("is_recent", F.row_number().over(back) <= recent)


def relevant_pairs(
    pairs: DataFrame, asked: DataFrame, k: int = fixed.RELEVANT_PAIRS
) -> DataFrame:
    """Older pairs that share most words with the asked text: asked has conv_id, query."""
    def bag(c: str) -> Column:
        return F.array_distinct(tx.words(F.lower(F.col(c))))

    older = split_pairs(pairs).where("NOT is_recent").join(asked, "conv_id")
    scored = older.withColumn(
        "overlap", F.size(F.array_intersect(bag("query"), bag("question")))
    ).where("overlap > 0")
    return top_k(scored, ["conv_id"], [F.col("overlap").desc(), F.col("pair_no").asc()], k)


def relevant_by_vector(
    pairs: DataFrame, asked: DataFrame, asked_vectors: DataFrame, question_vectors: DataFrame,
    k: int = fixed.RELEVANT_PAIRS,
) -> DataFrame:
    """Older pairs nearest to the asked text by cosine; by shared words where it has no vector.

    `asked`: conv_id, query; `asked_vectors`: conv_id, embedding; `question_vectors`: message_id,
    embedding. A question without a vector has similarity 0. Ties go to the earlier pair.
    """
    wanted = asked_vectors.select("conv_id", F.col("embedding").alias("_asked"))
    older = split_pairs(pairs).where("NOT is_recent").join(wanted, "conv_id")
    own = question_vectors.select(F.col("message_id").alias("user_message_id"), F.col("embedding").alias("_own"))
    similarity = F.coalesce(F.round(sc.cosine("_asked", "_own"), 9), F.lit(0.0))
    near = top_k(
        older.join(own, "user_message_id", "left").withColumn("relevance", similarity),
        ["conv_id"], [F.col("relevance").desc(), F.col("pair_no").asc()], k)
    without = asked.join(wanted, "conv_id", "left_anti")
    words = relevant_pairs(pairs, without, k).withColumn("relevance", F.col("overlap").cast("double"))
    columns = ["conv_id", "pair_no", "question", "answer", "relevance", "rank"]
    return near.select(*columns, F.lit("vector").alias("by")).unionByName(
        words.select(*columns, F.lit("words").alias("by")))


def history(pairs: DataFrame, asked: DataFrame, summaries: DataFrame) -> DataFrame:
    """conv_id, turn_no, role, content: summary, relevant older pairs, recent pairs.

    `summaries`: conv_id, summary.
    """
    recent = split_pairs(pairs).where("is_recent").select(
        "conv_id", F.lit(2).alias("part"), F.col("pair_no").alias("_o"), "question", "answer")
    older = relevant_pairs(pairs, asked).select(
        "conv_id", F.lit(1).alias("part"), F.col("rank").alias("_o"), "question", "answer")
    turns = unnest(
        recent.unionByName(older).withColumn("_t", F.array(
            F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
            F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))),
        ["conv_id", "part", "_o"], "_t", "t", "_i",
    ).select("conv_id", "part", "_o", "_i", "t.role", "t.content")
    heads = summaries.where(tx.strip("summary") != "").join(
        pairs.select("conv_id").distinct(), "conv_id", "left_semi"
    ).select(
        "conv_id", F.lit(0).alias("part"), F.lit(0).alias("_o"), F.lit(0).alias("_i"),
        F.lit("system").alias("role"),
        F.concat(F.lit(fixed.SUMMARY_HEADER), tx.strip("summary")).alias("content"))
    order = Window.partitionBy("conv_id").orderBy("part", "_o", "_i")
    return turns.unionByName(heads).select(
        "conv_id", (F.row_number().over(order) - 1).alias("turn_no"), "role", "content")


def summaries_due(pairs: DataFrame) -> DataFrame:
    """Conversations long enough for a new summary, with the text to be summed up."""
    marked = split_pairs(pairs)
    counts = pairs.groupBy("conv_id").agg(F.count("*").alias("n_pairs")).where(
        F.col("n_pairs") >= fixed.RECENT_PAIRS + fixed.SUMMARY_EVERY)
    line = F.concat(F.lit("User: "), F.col("question"), F.lit("\nAssistant: "), F.col("answer"))
    texts = marked.where("NOT is_recent").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("pair_no", line.alias("line")))).alias("_l"))
    return counts.join(texts, "conv_id").select(
        "conv_id", "n_pairs", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("older_text"))


def context_text(turns: DataFrame) -> DataFrame:
    """Last turns of a history as labelled, shortened lines for query rewriting."""
    spoken = turns.where(F.col("role").isin("user", "assistant"))
    last = top_k(spoken, ["conv_id"], [F.col("turn_no").desc()], fixed.CONTEXT_TURNS)
    label = F.when(F.col("role") == "user", fixed.TURN_LABELS["user"]).otherwise(fixed.TURN_LABELS["assistant"])
    line = F.concat(label, F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, fixed.CONTEXT_TURN_CHARS))
    return last.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))).alias("_l")
    ).select("conv_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("context"))


def recent_turns(messages: DataFrame, k: int = 3) -> DataFrame:
    """Last k finished replies with the question each answers, oldest first."""
    last = top_k(finished(messages), ["conv_id"], [F.col(c).desc() for c in TIME], k)
    parents = messages.select(
        F.col("message_id").alias("parent_message_id"), F.col("content").alias("question"))
    return last.join(parents, "parent_message_id", "left").select(
        "conv_id", (k - 1 - F.col("rank")).alias("turn_no"), "message_id",
        F.coalesce("question", F.lit("")).alias("question"), F.col("content").alias("answer"))


def flat_messages(messages: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """User messages with their last finished reply and its sources.

    `sources`: message_id, source_no, document_id.
    """
    asked = first_messages(messages.where("role = 'user'"), limit).withColumnRenamed("position", "rank")
    replies = finished(messages).where("parent_message_id IS NOT NULL").groupBy(
        F.col("parent_message_id").alias("message_id")
    ).agg(F.max_by(F.struct("message_id", "content", "status"), F.struct(*TIME)).alias("r"))
    listed = sources.groupBy("message_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("source_no", "document_id"))),
            lambda s: s["document_id"].cast("string")), ",").alias("source_documents"))
    return (
        asked.select("conv_id", "message_id", "content").join(replies, "message_id", "left")
        .select("conv_id", "message_id", "content",
                F.col("r.message_id").alias("reply_id"), F.col("r.content").alias("reply"),
                F.col("r.status").alias("reply_status"))
        .join(listed.withColumnRenamed("message_id", "reply_id"), "reply_id", "left")
        .withColumn("source_documents", F.coalesce("source_documents", F.lit("")))
    )


def normalize_citations(answers: DataFrame) -> DataFrame:
    """Renumber citations and keep the cited sources.

    `answers`: answer_id, answer, sources: array of (document_id, restricted, ...).
    Without citations the restricted documents are named once each, in rank order.
    """
    found = answers.withColumn("_cited", tx.cited_numbers("answer"))
    any_cited = F.size("_cited") > 0
    valid = F.filter("_cited", lambda n: (n >= 1) & (n <= F.size("sources")))
    cited = F.transform(valid, lambda n: F.element_at("sources", n.cast("int")))
    restricted = F.filter("sources", lambda s: s["restricted"])
    once = F.filter(
        restricted,
        lambda s, i: (i == 0) | ~F.exists(
            F.slice(restricted, 1, i), lambda p: p["document_id"].eqNullSafe(s["document_id"])))
    none = F.filter("sources", lambda s: F.lit(False))
    return found.withColumn(
        "answer", F.when(any_cited, tx.renumber_citations("answer", F.col("_cited"))).otherwise(F.col("answer"))
    ).withColumn(
        "kept_sources",
        F.when(F.coalesce("answer", F.lit("")) == "", none).when(any_cited, cited).otherwise(once),
    ).drop("_cited")


def source_rows(normalized: DataFrame) -> DataFrame:
    """One row per kept source of an answer, for appending."""
    return unnest(normalized, ["answer_id"], "kept_sources", "s", "source_no").select(
        "answer_id", "source_no", "s.*")


def first_per_client_id(messages: DataFrame) -> DataFrame:
    """Drop repeats of a client message id inside a conversation; rows without one stay."""
    named = messages.where("client_message_id IS NOT NULL")
    first = top_k(named, ["conv_id", "client_message_id"], [F.col(c).asc() for c in TIME], 1).drop("rank")
    return first.unionByName(messages.where("client_message_id IS NULL"))


def answer_status(blocked: Column, all_restricted: Column, configured: Column, failed: Column, answer: Column) -> Column:
    """Final state of an assistant message; an empty answer falls back to excerpts."""
    empty = F.coalesce(tx.strip(answer), F.lit("")) == ""
    return (
        F.when(blocked, "blocked").when(all_restricted, "success")
        .when(failed | ~configured | empty, "fallback")
        .when(tx.is_no_answer(answer), "no_answer").otherwise("success")
    )


def excerpt_answers(retrieved: DataFrame, k: int = 5) -> DataFrame:
    """Fallback answer per query: best texts under each other."""
    best = retrieved.where(F.col("rank") < k)
    joined = best.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "document_text"))).alias("_r")
    ).withColumn("answer", F.array_join(F.filter(
        F.transform("_r", lambda x: x["document_text"]), lambda t: t != ""), "\n\n"))
    return joined.select(
        "query_id", F.when(F.col("answer") == "", fixed.NO_CONTENT_ANSWER).otherwise(F.col("answer")).alias("answer"),
        F.size("_r").alias("n_sources"))


def prompt_contexts(retrieved: DataFrame) -> DataFrame:
    """Numbered context blocks per query, input of batch answer generation."""
    header = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("[Context "), F.col("rank") + 1, F.lit("]")),
        F.concat(F.lit("chunk_id="), F.col("chunk_id")),
        F.concat(F.lit("score="), F.col("score")),
        F.concat(F.lit("page="), F.col("page")))), " | ")
    blocks = retrieved.where(tx.strip("document_text") != "").select(
        "query_id", "rank", F.concat(header, F.lit("\n"), tx.strip("document_text")).alias("block"))
    return blocks.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("_b")
    ).select("query_id", F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n---\n\n").alias("context"))


def prompt_rows(queries: DataFrame, contexts: DataFrame, histories: DataFrame) -> DataFrame:
    """query_id, prompt parts joined: question, contexts, last history lines."""
    last = top_k(histories, ["query_id"], [F.col("turn_no").desc()], fixed.CONTEXT_TURNS)
    lines = last.where(tx.strip("content") != "").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "turn_no", F.concat(F.col("role"), F.lit(": "), tx.strip("content")).alias("line")))).alias("_l")
    ).select("query_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("history"))
    return queries.join(contexts, "query_id", "left").join(lines, "query_id", "left").select(
        "query_id", tx.strip("text").alias("question"), F.coalesce("context", F.lit("")).alias("context"),
        F.coalesce("history", F.lit("")).alias("history"))


def prompt_texts(rows: DataFrame, rules: str, notes: str = "") -> DataFrame:
    """query_id, prompt: the parts of `prompt_rows` under their headings, the caller's rules and notes."""
    def part(name: str, missing: str) -> Column:
        return F.when(F.col(name) == "", missing).otherwise(F.col(name))

    sections = [
        (fixed.PROMPT_QUESTION, F.col("question")), (fixed.PROMPT_CONTEXT, part("context", fixed.PROMPT_NO_CONTEXT)),
        (fixed.PROMPT_HISTORY, part("history", fixed.PROMPT_NO_HISTORY)), (fixed.PROMPT_RULES, F.lit(rules.strip()))]
    if notes.strip():
        sections.append((fixed.PROMPT_NOTES, F.lit(notes.strip())))
    texts = [F.concat(F.lit(head + "\n"), body) for head, body in sections]
    return rows.select("query_id", F.array_join(F.array(*texts), "\n\n").alias("prompt"))


def source_entry(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the entry that a client is shown of a result: `rows` has document_id, title, version_id,
    section, score, relevance, document_text, excerpt, doc_restricted; any may be null.
    """
    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return rows.select(
        *keep, F.struct(
            "document_id", F.coalesce(filled("title"), F.col("document_id").cast("string")).alias("document_title"),
            "version_id", F.col("section").alias("section_path"),
            F.coalesce("score", "relevance").alias("relevance"),
            F.coalesce(filled("document_text"), "excerpt").alias("excerpt"),
            F.coalesce("doc_restricted", F.lit(False)).alias("doc_restricted")).alias("entry"))


def conversation_titles(first_texts: DataFrame) -> DataFrame:
    """conv_id, title: the model's title (`proposed`) without blanks and quotes around it, else the head of `text`."""
    quoted = tx.strip("proposed")
    for mark in ('"', "'"):
        quoted = F.btrim(quoted, F.lit(mark))
    return first_texts.select("conv_id", F.coalesce(
        F.nullif(quoted, F.lit("")), F.substring("text", 1, fixed.TITLE_CHARS)).alias("title"))


def latest(rows: DataFrame, order: list[Column], limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Newest rows of a log."""
    return rows.orderBy(*order).limit(limit)
