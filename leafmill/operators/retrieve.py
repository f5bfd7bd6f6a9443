"""Hybrid retrieval and extractive answers for many questions at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions.text import contains_any, first_sentence, lexical_tokens, strip, token_count, words
from leafmill.operators.embed import similarity, with_embedding


def lexical_score(question_words: Column, chunk_words: Column) -> Column:
    """Share of the question's distinct words that the chunk has, whose words may repeat; 0 without words."""
    return F.when(F.size(question_words) > 0, F.size(F.array_intersect(question_words, chunk_words)) / F.size(question_words)).otherwise(0.0)


def number_words(question_words: Column) -> Column:
    """The words with a digit."""
    return F.filter(question_words, lambda w: w.rlike(r"\d"))


def number_bonus(numbers: Column, text: Column) -> Column:
    """0.2 if one of the question's words with a digit occurs anywhere in the text."""
    return F.when(F.exists(numbers, lambda w: F.lower(text).contains(w)), fixed.NUMBER_BONUS).otherwise(0.0)


def scored(questions: DataFrame, chunks: DataFrame, dense: bool = False) -> DataFrame:
    """(question_id, doc_id, question) joined with the chunks of their document, with a score rounded to 4 digits.

    Lexical words are made once a question and once a chunk, below the join on doc_id.  With vectors a chunk's words are made above it, where
    question and chunk have met, and so are the vectors: one is 1.5 KB, many times its text, so that none is shuffled.
    """
    box = ["bbox"] if "bbox" in chunks.columns else []
    q = questions.select("question_id", "doc_id", "question", (words(F.coalesce("question", F.lit(""))) if dense else lexical_tokens(F.col("question"))).alias("q_words"))
    q = q.withColumn("q_distinct", F.array_distinct("q_words") if dense else F.col("q_words")).withColumn("q_numbers", number_words(F.col("q_distinct")))
    c = chunks.select("doc_id", "chunk_id", "chunk_idx", "page_number", "text", *box)
    c_words = words(F.coalesce("text", F.lit(""))) if dense else lexical_tokens(F.col("text"))
    both = q.join(c, "doc_id").withColumn("c_words", c_words) if dense else q.join(c.withColumn("c_words", c_words), "doc_id")
    score = F.lit(fixed.LEXICAL_SHARE) * lexical_score(F.col("q_distinct"), F.col("c_words")) + number_bonus(F.col("q_numbers"), F.col("text"))
    if dense:
        near = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), similarity(F.col("q_words"), F.col("c_words"))))
        score = score + F.lit(fixed.DENSE_SHARE) * F.greatest(F.lit(0.0), (near + 1) / 2)
    return both.select("question_id", "doc_id", "question", "chunk_id", "chunk_idx", "page_number", "text", *box, F.round(score, 4).alias("score"))


def top_k(rows: DataFrame, k: int = 4) -> DataFrame:
    """The k best chunks of each question; equal scores keep the chunks' order.  Adds rank, from 1."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_idx")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def citations(top: DataFrame) -> DataFrame:
    """(question_id, doc_id, question, retrieval_count, top_score, citations) from ranked chunks."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "page_number", "text", "score", *(["bbox"] if "bbox" in top.columns else []))))
    return top.groupBy("question_id", "doc_id", "question").agg(F.count(F.lit(1)).alias("retrieval_count"), F.max("score").alias("top_score"), listed.alias("citations"))


def _first_line(cites: Column, shows: list[str], pattern: str | None = None) -> Column:
    """The first line, in citation order, that has one of the words and the pattern: a struct of page and line, or null."""
    lines = F.flatten(F.transform(cites, lambda c: F.transform(F.split(c["text"], "\n"), lambda t: F.struct(c["page_number"].alias("page"), t.alias("line")))))
    good = F.filter(lines, lambda x: contains_any(F.lower(x["line"]), shows) & (x["line"].rlike(pattern) if pattern else F.lit(True)))
    return F.try_element_at(good, F.lit(1))


def said(template: str, text: Column, page: Column | None = None) -> Column:
    """A template with {text} and {page} filled in."""
    parts = re.split(r"(\{text\}|\{page\})", template)
    return F.concat(*(text if p == "{text}" else page.cast("string") if p == "{page}" else F.lit(p) for p in parts if p))


def answers(cited: DataFrame) -> DataFrame:
    """question_id, answer, confidence_score, intent and citations (page, text, score and, if chunks have one, box): the first intent whose evidence is found, in fixed order."""
    q, cites, top = F.lower(strip(F.col("question"))), F.col("citations"), F.col("top_score")
    cited = cited.select("*", _first_line(cites, fixed.SHOWS_AMOUNT, fixed.AMOUNT).alias("amount"), _first_line(cites, fixed.SHOWS_DATE, fixed.DATE).alias("date"), _first_line(cites, fixed.SHOWS_NUMBER).alias("number"))
    labelled = lambda c: contains_any(c["text"], fixed.SHOWS_PARTY)
    parties = F.filter(cites, lambda c: labelled(c) | (strip(c["text"]) != ""))
    cited = cited.withColumn("party", F.try_element_at(parties, F.lit(1)))
    lines = F.filter(F.transform(F.split("party.text", "\n"), strip), lambda x: x != "")
    points = F.filter(F.transform(F.slice(cites, 1, 3), lambda c: F.struct(c["page_number"].alias("page"), first_sentence(c["text"]).alias("text"))), lambda p: p["text"] != "")
    bullets = F.transform(points, lambda p: said(fixed.SAYS_POINT, p["text"], p["page"]))

    def result(intent: str, text: Column, confidence: Column) -> Column:
        return F.struct(F.lit(intent).alias("intent"), text.alias("answer"), F.round(confidence, 3).alias("confidence_score"))

    def quoted(template: str, name: str) -> Column:
        return said(template, strip(F.col(f"{name}.line")), F.col(f"{name}.page"))

    party_page = F.col("party.page_number")
    best = cites[0]
    rules = [
        (contains_any(q, fixed.ASKS_AMOUNT) & F.col("amount").isNotNull(), result("amount", quoted(fixed.SAYS_AMOUNT, "amount"), F.least(F.lit(0.98), top + 0.1))),
        (contains_any(q, fixed.ASKS_DATE) & F.col("date").isNotNull(), result("date", quoted(fixed.SAYS_DATE, "date"), F.least(F.lit(0.96), top + 0.1))),
        (contains_any(q, fixed.ASKS_NUMBER) & F.col("number").isNotNull(), result("number", quoted(fixed.SAYS_NUMBER, "number"), F.least(F.lit(0.95), top + 0.1))),
        (contains_any(q, fixed.ASKS_PARTY) & labelled(F.col("party")), result("party", said(fixed.SAYS_ISSUER, strip(F.col("party.text")), party_page), F.lit(0.95))),
        (contains_any(q, fixed.ASKS_PARTY) & F.col("party").isNotNull(), result("party", said(fixed.SAYS_PARTY, lines[0], party_page), F.least(F.lit(0.92), top))),
        (contains_any(q, fixed.ASKS_SUMMARY) & (F.size(points) > 0), result("summary", said(fixed.SAYS_SUMMARY, F.array_join(bullets, "\n")), top)),
    ]
    chosen = result("default", said(fixed.SAYS_PASSAGE, strip(best["text"]), best["page_number"]), F.least(F.lit(0.95), F.greatest(F.lit(0.40), top)))
    for condition, value in reversed(rules):
        chosen = F.when(condition, value).otherwise(chosen)
    return cited.withColumn("_r", chosen).select("question_id", "doc_id", "_r.intent", "_r.answer", "_r.confidence_score", "retrieval_count", F.transform("citations", lambda c: c.dropFields("rank")).alias("citations"))


def query(questions: DataFrame, chunks: DataFrame, k: int = 4, dense: bool = True) -> DataFrame:
    """Answers of all questions, with their citations; a question whose document has no chunks gets a message, confidence 0 and no citation."""
    found = answers(citations(top_k(scored(questions, chunks, dense), k)))
    message = said(fixed.SAYS_NOTHING, F.col("doc_id").cast("string"))
    out = questions.select("question_id", "doc_id").join(found.drop("doc_id"), "question_id", "left")
    none = F.array().cast(found.schema["citations"].dataType)
    return out.select(
        "question_id", "doc_id", F.coalesce("intent", F.lit("none")).alias("intent"), F.coalesce("answer", message).alias("answer"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"),
        F.coalesce("retrieval_count", F.lit(0)).alias("retrieval_count"), F.coalesce("citations", none).alias("citations"),
    )


def last_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to the latest user text of each conversation, null without one."""
    return messages.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))


def target_document(requests: DataFrame, last_document: Column) -> DataFrame:
    """The document of a completion request (request_id, doc_id, system_text): its own, the system message's tag, or the last one ingested; an empty id is none."""
    tag = F.nullif(F.regexp_extract("system_text", fixed.DOCUMENT_TAG, 1), F.lit(""))
    return requests.select("request_id", F.coalesce(F.nullif("doc_id", F.lit("")), tag, last_document).alias("doc_id"))


def completions(messages: DataFrame, requests: DataFrame, chunks: DataFrame, indexed: DataFrame, k: int = 3, dense: bool = True) -> DataFrame:
    """Chat completions: conv_id, doc_id, answer, confidence_score, citations, prompt_tokens, completion_tokens, total_tokens.

    messages: conv_id, turn, role, text.  requests: conv_id and doc_id (text, null if none is named).  indexed: doc_id and
    indexed_at of all documents, of which the latest serves requests that name none.  A conversation without
    a user's text is asked for one; without any document the answer says so.
    """
    tagged = F.when((F.col("role") == "system") & F.col("text").rlike(fixed.DOCUMENT_TAG), F.struct("turn", "text"))
    by = messages.groupBy("conv_id").agg(F.min(tagged).alias("system"), F.sum(token_count(F.col("text"))).alias("prompt_tokens"))
    by = by.join(last_user_message(messages), "conv_id")
    latest = indexed.agg(F.max_by(F.col("doc_id").cast("string"), F.struct("indexed_at", "doc_id"))).first()[0]
    named = by.join(requests, "conv_id", "left").select("conv_id", "question", "prompt_tokens", F.col("doc_id").cast("string").alias("own"), F.col("system.text").alias("system_text"))
    targets = target_document(named.select(F.struct("conv_id", "question", "prompt_tokens").alias("request_id"), F.col("own").alias("doc_id"), "system_text"), F.lit(latest).cast("string"))
    asked = targets.select("request_id.*", "doc_id")
    questions = asked.where("doc_id is not null and question <> ''").select(F.col("conv_id").alias("question_id"), "doc_id", "question")
    found = query(questions, chunks.withColumn("doc_id", F.col("doc_id").cast("string")), k, dense).withColumnRenamed("question_id", "conv_id").drop("doc_id")
    out = asked.join(found, "conv_id", "left")
    blank = F.coalesce(F.col("question"), F.lit("")) == ""
    answer = F.when(blank, fixed.SAYS_ASK).when(F.col("doc_id").isNull(), said(fixed.SAYS_UNLOADED, F.col("question"))).otherwise(F.col("answer"))
    none = F.array().cast(found.schema["citations"].dataType)
    out = out.select("conv_id", "doc_id", answer.alias("answer"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("citations", none).alias("citations"), "prompt_tokens", token_count(answer).alias("completion_tokens"))
    return out.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def embedded_inputs(requests: DataFrame) -> DataFrame:
    """Embedding requests (request_id, inputs) to a row for each input: request_id, index, embedding, and the request's prompt_tokens."""
    tokens = F.aggregate(F.transform("inputs", token_count), F.lit(0).cast("bigint"), lambda s, n: s + n)
    each = requests.select("request_id", tokens.alias("prompt_tokens"), F.posexplode("inputs").alias("index", "text"))
    return with_embedding(each, "text", "embedding").select("request_id", "index", "embedding", "prompt_tokens")
