"""Queries of text functions, chunking, embedding, retrieval and chat, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions import text as X
from leafmill.operators import chunk, embed, retrieve, similar, stored
from leafmill.plans import synthetic as S
from leafmill.sources import spread
from leafmill.sources.shared import shared_folder

STRIP = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '[\s\p{{Z}}]+'), lambda w: w <> '')"


def _docs(spark, d):
    return spread(S.read(spark, d, "documents").select("doc_id", "text"))


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.clean_text(F.col("text")).cast("binary")).alias("digest"))


def numeric_repair(spark, d):
    return S.invoice_lines(spark, d).select("doc_id", "line_number", X.repair_digits(F.col("text")).alias("repaired"))


def parse_amount(spark, d):
    return S.invoice_lines(spark, d).select("doc_id", "line_number", X.parse_amount(F.col("text")).alias("amount"))


def standardize_date(spark, d):
    o = S.read(spark, d, "orders")
    texts = o.select("o_orderkey", F.posexplode(F.array(*(F.expr(e) for e in DATES))).alias("k", "text"))
    return texts.select("o_orderkey", "k", X.standardize_date(F.col("text")).alias("date"))


_D = "substr(CAST(o_orderdate AS STRING), 1, 10)"
DATES = [f"' ' || {_D} || ' '", f"replace({_D}, '-', '/')", f"substr({_D}, 9, 2) || '.' || substr({_D}, 6, 2) || '.' || substr({_D}, 1, 4)", f"'March ' || CAST(CAST(substr({_D}, 9, 2) AS INT) AS STRING) || ', ' || substr({_D}, 1, 4)", f"'x' || {_D}"]
_MARCH = f"substr({_D}, 1, 4) || '-03-' || substr({_D}, 9, 2)"


def lexical_tokens(spark, d):
    t = X.lexical_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n"), F.md5(F.array_join(F.array_sort(t), " ").cast("binary")).alias("digest"))


def ngram_tokens(spark, d):
    t = X.subword_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("bigint").alias("n"), F.aggregate(t, F.lit(0).cast("bigint"), lambda s, w: s + F.char_length(w)).alias("chars"))


def token_hash(spark, d):
    words = _docs(spark, d).select(F.explode(X.lexical_tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).select("token", "docs", X.token_hash(F.col("token")).alias("hash"))


def token_usage(spark, d):
    c = S.read(spark, d, "conversations")
    return c.groupBy("role").agg(F.sum(X.token_count(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("turns"))


def paragraph_chunks(spark, d):
    return chunk.paragraph_chunks(_docs(spark, d)).select("doc_id", "chunk_id", "chunk_idx", "text")


def doc_index_stats(spark, d):
    return chunk.index_stats(chunk.paragraph_chunks(_docs(spark, d)))


def _document_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return lines.select("doc_id", F.lit(1).alias("page_number"), F.col("n").alias("line_number"), "text")


def line_window_chunks(spark, d):
    return chunk.line_windows(_document_lines(spark, d)).select("doc_id", "window", "text", "line_count")


def hash_histogram(spark, d):
    return embed.hash_histogram(_docs(spark, d), "doc_id").withColumn("dim", F.col("dim").cast("bigint"))


def dense_embedding(spark, d):
    return embed.with_embedding(chunk.paragraph_chunks(_docs(spark, d)).select("chunk_id", "text"), "text", "embedding").drop("text")


def cosine_topk(spark, d):
    """For every vector whose id is divisible by 50, the five most similar others."""
    v = S.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return similar.most_similar(v.where("vec_id % 50 = 0"), v)


def _questions(spark, d):
    """A question for each document: the whole benchmark item that its id points at."""
    docs, items = _docs(spark, d), S.read(spark, d, "benchmark")
    pointed = docs.select("doc_id").withColumn("item_id", F.col("doc_id") % F.lit(items.count()))
    return pointed.join(items, "item_id").select(F.col("doc_id").alias("question_id"), "doc_id", F.col("text").alias("question"))


def lexical_retrieval(spark, d):
    chunks = chunk.paragraph_chunks(_docs(spark, d))
    return retrieve.top_k(retrieve.scored(_questions(spark, d), chunks)).select("question_id", "chunk_id", "score", "rank")


def whole_question_retrieval(spark, d):
    """The name that lexical_retrieval had for whole questions."""
    return lexical_retrieval(spark, d)


def hybrid_retrieval(spark, d):
    """The best chunks for the questions by the full score, over stored chunks."""
    name = f"stored_chunks_{uuid.uuid4().hex}"
    store = stored.StoredChunks(spark, name, f"{shared_folder(spark)}/{name}")
    store.add(chunk.paragraph_chunks(_docs(spark, d)))
    return store.best(_questions(spark, d)).select("question_id", "chunk_id", "score", "rank")


def hybrid_answers(spark, d):
    """Answers by the operator's full score."""
    out = retrieve.query(S.invoice_questions(spark, d), S.line_chunks(S.invoice_lines(spark, d)), dense=True)
    return out.select("question_id", "intent", "answer", "confidence_score", F.col("retrieval_count").cast("bigint").alias("retrieval_count"))


def answers(spark, d):
    """Answers by the lexical part of the score, which SQL can give too."""
    chunks = S.line_chunks(S.invoice_lines(spark, d))
    out = retrieve.query(S.invoice_questions(spark, d), chunks, dense=False)
    return out.select("question_id", "intent", "answer", "confidence_score", F.col("retrieval_count").cast("bigint").alias("retrieval_count"))


def query_citations(spark, d):
    """The passages that the answers cite, in order."""
    out = retrieve.query(S.invoice_questions(spark, d), S.line_chunks(S.invoice_lines(spark, d)), dense=False)
    return out.select("question_id", F.posexplode("citations").alias("position", "c")).select("question_id", "position", "c.page_number", "c.text", "c.score")


def chat_completion(spark, d):
    """Answers to the conversations by the lexical score: two in three name a document, the others get the tagged or the latest one."""
    docs = _docs(spark, d)
    messages = S.read(spark, d, "conversations")
    requests = messages.select("conv_id").distinct().withColumn("doc_id", F.when(F.col("conv_id") % 3 != 0, F.col("conv_id").cast("string")))
    indexed = docs.select("doc_id", F.col("doc_id").alias("indexed_at"))
    out = retrieve.completions(messages, requests, chunk.paragraph_chunks(docs), indexed, dense=False)
    return out.select("conv_id", "doc_id", "answer", "confidence_score", F.size("citations").cast("bigint").alias("citations"), "prompt_tokens", "completion_tokens", "total_tokens")


def embedding_inputs(spark, d):
    """The user's texts of a conversation as one embedding request."""
    c = S.read(spark, d, "conversations").where("role = 'user'").withColumn("text", F.coalesce("text", F.lit("")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"])
    out = retrieve.embedded_inputs(c.groupBy(F.col("conv_id").alias("request_id")).agg(texts.alias("inputs")))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    return out.select("request_id", "index", F.size("embedding").alias("dimension"), F.round(length, 3).alias("length"), "prompt_tokens")


def chat_last_user(spark, d):
    return retrieve.last_user_message(S.read(spark, d, "conversations"))


def chat_target_doc(spark, d):
    first = F.min(F.struct("turn", "text")).alias("first")
    c = S.read(spark, d, "conversations").groupBy("conv_id").agg(first).select("conv_id", "first.text")
    tagged = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Use doc_id: D"), F.col("conv_id").cast("string"), F.lit(" only")))
    r = c.select(F.col("conv_id").alias("request_id"), F.when(F.col("conv_id") % 5 == 0, F.lit("own")).alias("doc_id"), F.coalesce(tagged, F.col("text")).alias("system_text"))
    return retrieve.target_document(r, F.lit("last"))


def chunks_sql(source: str = "documents", key: str | None = None) -> str:
    """CTEs up to ``chunks`` of a relation with doc_id and text; key: a further column that tells its rows apart."""
    also = f", {key}" if key else ""
    return f"""
pars AS (SELECT doc_id{also}, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format(x="x")}), lambda x: x <> '') AS l FROM {source}),
cut AS (SELECT doc_id{also}, flatten(list_transform(l, lambda p: CASE WHEN length(p) <= {fixed.PARAGRAPH_CHARS} THEN [p] ELSE
  list_filter(list_transform(range(0, len(regexp_split_to_array(p, '[\\s\\p{{Z}}]+')), {fixed.STEP_WORDS}),
    lambda i: array_to_string(list_slice(regexp_split_to_array(p, '[\\s\\p{{Z}}]+'), i + 1, i + {fixed.WINDOW_WORDS}), ' ')), lambda c: length(c) > {fixed.LEAST_CHARS}) END)) AS l FROM pars),
chunks AS (SELECT doc_id{also}, doc_id || '_p1_c' || (i - 1) AS chunk_id, i - 1 AS chunk_idx, 1 AS page_number, l[i] AS text FROM (SELECT doc_id{also}, l, unnest(range(1, len(l) + 1)) AS i FROM cut))
"""


_CHUNKS = chunks_sql()


def _scored(k: int = 4) -> str:
    return f"""
q AS (SELECT question_id, doc_id, question, list_distinct({TOKENS.format(x="question")}) AS qw FROM questions),
c AS (SELECT *, list_distinct({TOKENS.format(x="text")}) AS cw FROM chunks),
s AS (SELECT question_id, q.doc_id, question, chunk_id, chunk_idx, page_number, text, round(
    0.35::DOUBLE * CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, cw))::DOUBLE / len(qw) ELSE 0::DOUBLE END
    + CASE WHEN len(list_filter(qw, lambda w: regexp_matches(w, '\\d') AND contains(lower(text), w))) > 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END, 4) AS score
  FROM q JOIN c ON q.doc_id = c.doc_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_idx) AS rank FROM s) WHERE rank <= {k})
"""


_SCORED = _scored()


def _any(x: str, listed: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in listed) + ")"


def _first(shows: list[str], pattern: str | None = None) -> str:
    """The first citation (each is one line here) that has a word and the pattern."""
    rule = _any("lower(text)", shows) + (f" AND regexp_matches(text, '{pattern}')" if pattern else "")
    return f"arg_min({{'page': page_number, 'line': text}}, CASE WHEN {rule} THEN rank END)"


_LINE_CHUNKS = f"{S.LINES_SQL}, {S.QUESTIONS_SQL}, chunks AS (SELECT doc_id, doc_id || '_' || line_number AS chunk_id, line_number AS chunk_idx, page_number, text FROM lines)"
_ANSWERED = f"""
a AS (SELECT question_id, any_value(lower(question)) AS q, count(*) AS retrieval_count, max(score) AS t,
  {_first(fixed.SHOWS_AMOUNT, fixed.AMOUNT)} AS amount, {_first(fixed.SHOWS_DATE, fixed.DATE)} AS date, {_first(fixed.SHOWS_NUMBER)} AS number,
  arg_min({{'page': page_number, 'line': text}}, rank) AS best,
  string_agg(CASE WHEN rank <= 3 AND {STRIP.format(x="split_part(text, '.', 1)")} <> '' THEN '• **(Page ' || page_number || ')**: ' || {STRIP.format(x="split_part(text, '.', 1)")} END, chr(10) ORDER BY rank) AS points FROM top GROUP BY 1),
r AS (SELECT question_id, retrieval_count, CASE
  WHEN {_any("q", fixed.ASKS_AMOUNT)} AND amount IS NOT NULL THEN {{'i': 'amount', 'a': 'Based on page ' || amount.page || ', the relevant figure found is **' || amount.line || '**.', 'c': least(0.98::DOUBLE, t + 0.1::DOUBLE)}}
  WHEN {_any("q", fixed.ASKS_DATE)} AND date IS NOT NULL THEN {{'i': 'date', 'a': 'According to page ' || date.page || ', the date specified is **' || date.line || '**.', 'c': least(0.96::DOUBLE, t + 0.1::DOUBLE)}}
  WHEN {_any("q", fixed.ASKS_NUMBER)} AND number IS NOT NULL THEN {{'i': 'number', 'a': 'From page ' || number.page || ', the document specifies: **' || number.line || '**.', 'c': least(0.95::DOUBLE, t + 0.1::DOUBLE)}}
  WHEN {_any("q", fixed.ASKS_PARTY)} AND {_any("best.line", fixed.SHOWS_PARTY)} THEN {{'i': 'party', 'a': 'The issuer identified on page ' || best.page || ' is **' || best.line || '**.', 'c': 0.95::DOUBLE}}
  WHEN {_any("q", fixed.ASKS_PARTY)} THEN {{'i': 'party', 'a': 'Based on page ' || best.page || ', the relevant organization is **' || best.line || '**.', 'c': least(0.92::DOUBLE, t)}}
  WHEN {_any("q", fixed.ASKS_SUMMARY)} AND points <> '' THEN {{'i': 'summary', 'a': 'Document Summary & Key Findings:' || chr(10) || points, 'c': t}}
  ELSE {{'i': 'default', 'a': 'Based on the document context (Page ' || best.page || '):' || chr(10) || chr(10) || '"' || best.line || '"', 'c': least(0.95::DOUBLE, greatest(0.4::DOUBLE, t))}} END AS r FROM a)
"""
_WORDS = r"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '[\s\p{{Z}}]+'), lambda w: w <> ''))"
_CHAT = f"""WITH {_CHUNKS},
by_conv AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'system' AND regexp_matches(text, '{fixed.DOCUMENT_TAG}')) AS system_text, CAST(sum({_WORDS.format(x="text")}) AS BIGINT) AS prompt_tokens FROM conversations GROUP BY 1),
asked AS (SELECT conv_id, question, prompt_tokens, coalesce(CASE WHEN conv_id % 3 <> 0 THEN CAST(conv_id AS VARCHAR) END, nullif(regexp_extract(system_text, '{fixed.DOCUMENT_TAG}', 1), ''), (SELECT CAST(max(doc_id) AS VARCHAR) FROM documents)) AS doc_id FROM by_conv),
questions AS (SELECT conv_id AS question_id, TRY_CAST(doc_id AS BIGINT) AS doc_id, question FROM asked WHERE question <> ''), {_scored(3)}, {_ANSWERED},
out AS (SELECT conv_id, doc_id, prompt_tokens, coalesce(round(r.c, 3), 0) AS confidence_score, coalesce(retrieval_count, 0) AS citations,
  CASE WHEN coalesce(question, '') = '' THEN '{fixed.SAYS_ASK}' ELSE coalesce(r.a, replace('{fixed.SAYS_NOTHING.replace("'", "''")}', '{{text}}', doc_id)) END AS answer FROM asked LEFT JOIN r ON conv_id = question_id)
SELECT conv_id, doc_id, answer, confidence_score, citations, prompt_tokens, {_WORDS.format(x="answer")} AS completion_tokens, prompt_tokens + {_WORDS.format(x="answer")} AS total_tokens FROM out"""

QUERIES = {f.__name__: f for f in (clean_text, numeric_repair, parse_amount, standardize_date, lexical_tokens, ngram_tokens, token_hash, token_usage, paragraph_chunks, doc_index_stats, line_window_chunks, hash_histogram, dense_embedding, cosine_topk, lexical_retrieval, whole_question_retrieval, hybrid_retrieval, query_citations, chat_completion, embedding_inputs, hybrid_answers, answers, chat_last_user, chat_target_doc)}

_SUB = r"flatten(list_transform({t}, lambda w: list_concat([w], list_concat(CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [] END, CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END))))".format(t=TOKENS.format(x="text"))
_RETRIEVED = f"WITH {_CHUNKS}, questions AS (SELECT doc_id AS question_id, doc_id, b.text AS question FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)), {_SCORED} SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM top"
ORACLES = {
    "clean_text": rf"SELECT doc_id, md5({STRIP.format(x="regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS digest FROM documents".replace("\\\\", "\\"),
    "numeric_repair": rf"WITH {S.LINES_SQL} SELECT doc_id, line_number, CASE WHEN regexp_matches(text, '\d') THEN translate(text, 'OoIlSsB', '0011558') ELSE text END AS repaired FROM lines",
    "parse_amount": f"WITH {S.LINES_SQL} SELECT doc_id, line_number, TRY_CAST(nullif(regexp_replace(text, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS amount FROM lines",
    "standardize_date": f"SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS k, l[i] AS date FROM (SELECT o_orderkey, [{_D}, {_D}, {_D}, {_MARCH}, 'x' || {_D}] AS l FROM orders), range(1, 6) AS t(i)",
    "lexical_tokens": f"SELECT doc_id, len(t) AS n, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, list_distinct({TOKENS.format(x='text')}) AS t FROM documents)",
    "ngram_tokens": f"SELECT doc_id, len(t) AS n, CAST(coalesce(list_sum(list_transform(t, lambda w: length(w))), 0) AS BIGINT) AS chars FROM (SELECT doc_id, {_SUB} AS t FROM documents)",
    "token_hash": f"SELECT token, count(*) AS docs, ('0x' || substr(md5(token), 1, 8))::BIGINT AS hash FROM (SELECT unnest(list_distinct({TOKENS.format(x='text')})) AS token FROM documents) GROUP BY 1",
    "token_usage": r"SELECT role, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}]+'), lambda w: w <> ''))) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY 1",
    "paragraph_chunks": f"WITH {_CHUNKS} SELECT doc_id, chunk_id, chunk_idx, text FROM chunks",
    "doc_index_stats": f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY 1",
    "line_window_chunks": f"WITH {_CHUNKS.split('cut AS')[0].rstrip().rstrip(',')} SELECT doc_id, CAST(w AS INTEGER) AS window, array_to_string(list_slice(l, 2 * w + 1, 2 * w + 3), ' ') AS text, CASE WHEN len(l) >= 2 * w + 3 THEN 3 END AS line_count FROM (SELECT doc_id, l, unnest(range(0, (len(l) + 1) // 2)) AS w FROM pars)",
    "hash_histogram": f"SELECT doc_id, h % {fixed.DIMENSION} AS dim, round(sum(CASE WHEN (h >> 16) % 2 = 0 THEN 1 ELSE -1 END * CASE WHEN length(token) > 3 THEN ln(3::DOUBLE) ELSE ln(2.5::DOUBLE) END * n), 6) + 0.0::DOUBLE AS h FROM (SELECT doc_id, token, count(*) AS n, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h FROM (SELECT doc_id, unnest({_SUB}) AS token FROM documents) GROUP BY 1, 2) GROUP BY 1, 2",
    "cosine_topk": "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.v, c.v) / q.n / c.n, 6) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 5",
    "lexical_retrieval": _RETRIEVED,
    "whole_question_retrieval": _RETRIEVED,
    "answers": f"WITH {_LINE_CHUNKS}, {_SCORED}, {_ANSWERED} SELECT question_id, r.i AS intent, r.a AS answer, round(r.c, 3) AS confidence_score, retrieval_count FROM r",
    "query_citations": f"WITH {_LINE_CHUNKS}, {_SCORED} SELECT question_id, CAST(rank - 1 AS INTEGER) AS position, page_number, text, score FROM top",
    "chat_completion": _CHAT,
    "embedding_inputs": f"WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user') SELECT conv_id AS request_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS index, CAST(384 AS INTEGER) AS dimension, 1.0::DOUBLE AS length, CAST(sum({_WORDS.format(x='text')}) OVER (PARTITION BY conv_id) AS BIGINT) AS prompt_tokens FROM c",
    "chat_last_user": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS question FROM conversations GROUP BY 1",
    "chat_target_doc": r"SELECT conv_id AS request_id, coalesce(CASE WHEN conv_id % 5 = 0 THEN 'own' END, nullif(regexp_extract(coalesce(CASE WHEN conv_id % 3 = 0 THEN 'Use doc_id: D' || conv_id || ' only' END, text), 'doc_id:\s*(\S+)', 1), ''), 'last') AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS k FROM conversations) WHERE k = 1",
}
