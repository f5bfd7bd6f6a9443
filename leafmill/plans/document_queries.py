"""Queries of extraction, layout, pages, keys and files, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.operators import chunk, extract, images, keys, layout, pages
from leafmill.plans import synthetic as S
from leafmill.plans.text_queries import STRIP, _any
from leafmill.sources import files


def extract_fields(spark, d):
    return extract.rule_fields(S.invoice_lines(spark, d))


def extract_field(field, spark, d):
    """One field: only its patterns are evaluated."""
    return extract.rule_fields(S.invoice_lines(spark, d), [field]).drop("field")


def line_key_values(spark, d):
    return extract.line_key_values(S.invoice_lines(spark, d))


def _numbered(kv):
    return kv.withColumn("position", F.col("line_number"))


def merge_fields(spark, d):
    fields = extract_fields(spark, d).where(~F.col("field").isin("customer_name", "phone", "total_amount"))
    return extract.merge_fields(fields, _numbered(line_key_values(spark, d)))


def _texts(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "text"))), lambda s: s["text"]), "\n")
    return S.invoice_lines(spark, d).groupBy("doc_id").agg(text.alias("text"))


def document_type(spark, d):
    return S.read(spark, d, "documents").select("doc_id", extract.document_type(F.col("text")).alias("document_type"))


def extraction_summary(spark, d):
    types = _texts(spark, d).select("doc_id", extract.document_type(F.col("text")).alias("document_type"))
    return extract.summaries(extract_fields(spark, d), types)


def summary_chunks(spark, d):
    order = F.array_position(F.array(*(F.lit(f) for f in ["vendor_name", *fixed.PATTERNS])), F.col("field"))
    return chunk.summary_chunks(extract_fields(spark, d).withColumn("position", order)).select("doc_id", "chunk_id", "text")


def extraction_result(spark, d):
    """The whole extraction: fields of the rules and of key/values of lines and words together, with type, summary, mean confidence and tables."""
    out = extract.extraction_results(S.invoice_lines(spark, d), S.order_words(spark, d), tables=_tables(spark, d))
    names = lambda c, k: F.array_join(F.transform(c, lambda f: f[k]), "|")
    rows = F.array_join(F.flatten(F.transform("tables", lambda t: F.transform(t["rows"], lambda r: F.array_join(r, " | ")))), "\n")
    return out.select(
        "doc_id", "document_type", "summary", "overall_confidence", names("fields", "field").alias("fields"), names("fields", "value").alias("field_values"), names("fields", "method").alias("methods"),
        names("key_values", "key").alias("keys"), names("key_values", "value").alias("key_values"), F.coalesce(rows, F.lit("")).alias("table_rows"),
    )


def ocr_index(spark, d):
    """Chunks of recognised documents: summary, table rows and line windows of an order."""
    order = F.array_position(F.array(*(F.lit(f) for f in ["vendor_name", *fixed.PATTERNS])), F.col("field"))
    tables = _tables(spark, d).select("doc_id", "page_number", F.lit(0).alias("table_idx"), "rows")
    out = chunk.ocr_chunks(S.invoice_lines(spark, d), extract_fields(spark, d).withColumn("position", order), tables)
    return out.select("doc_id", "chunk_id", "chunk_idx", "page_number", "text", "type", "line_count")


def export_rows(spark, d):
    return extract.export_rows(extract_fields(spark, d), line_key_values(spark, d))


def doc_details(spark, d):
    meta = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    # these lines are the words put together: a page has a line with any text where it has such a word, so its texts are not made
    results = pages.document_results(pages.page_means(pages.clean_words(S.order_words(spark, d))))
    return files.document_details(meta, results, extract.field_counts(S.invoice_lines(spark, d)))


def _boxes(spark, d):
    return S.order_words(spark, d).select("doc_id", "page_number", F.col("word_idx").alias("box_idx"), "x", "y", "width", "height")


def reading_order(spark, d):
    out = layout.reading_order(_boxes(spark, d))
    return out.select("doc_id", "box_idx", "line", "position")


def normalized_boxes(spark, d):
    out = layout.normalised(_boxes(spark, d).withColumns({"image_width": F.lit(600), "image_height": F.lit(400)}))
    return out.select("doc_id", "box_idx", "x_norm", "y_norm", "w_norm", "h_norm")


def cell_rows(spark, d):
    return layout.cell_rows(S.order_cells(spark, d)).select("doc_id", "cell_idx", "row_idx", "col_idx")


def cell_word_join(spark, d):
    return layout.cell_words(S.order_cells(spark, d), S.order_words(spark, d)).select("doc_id", "cell_idx", "text", "confidence")


def _tables(spark, d):
    cells = layout.cell_rows(S.order_cells(spark, d))
    return layout.assemble_tables(layout.cell_words(cells, S.order_words(spark, d)))


def table_reconstruct(spark, d):
    t = _tables(spark, d)
    return t.select("doc_id", "num_rows", "num_cols", F.array_join("headers", " | ").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n").alias("rows"))


def table_row_chunks(spark, d):
    return chunk.table_row_chunks(_tables(spark, d).select("doc_id", F.lit(0).alias("table_idx"), "rows"))


def line_assembly(spark, d):
    return layout.assemble_lines(S.order_words(spark, d))


def spatial_kv(spark, d):
    return layout.neighbours(S.order_words(spark, d)).select("doc_id", "word_idx", "key", "value", "confidence")


def _pages(spark, d):
    lines = S.order_words(spark, d).groupBy("doc_id", "page_number", (F.col("word_idx") / 4).cast("int").alias("line_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda s: s["text"]), " ").alias("text"))
    return pages.page_results(lines, pages.clean_words(S.order_words(spark, d)))


def page_confidence(spark, d):
    return _pages(spark, d).select("doc_id", "page_number", "full_text", "average_confidence", "words")


def document_confidence(spark, d):
    return pages.document_results(_pages(spark, d))


def key_usage(spark, d):
    return keys.key_usage(S.requests(spark, d), S.api_keys(spark, d))


def authorized_requests(spark, d):
    return keys.authorised(S.requests(spark, d), S.api_keys(spark, d)).select("event_id", "endpoint")


def masked_keys(spark, d):
    return keys.listed(S.api_keys(spark, d).withColumn("created_at", F.lit(None).cast("timestamp"))).select("key_id", "api_key")


def upload_validation(spark, d):
    return files.validated(S.uploads(spark, d)).select("path", "extension", "name", "detected_type", "rejected")


def skew_angles(spark, d):
    seg = S.order_words(spark, d).select("doc_id", "page_number", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("width")).alias("x2"), (F.col("y") + F.col("word_idx") % 3 - 1).alias("y2"))
    return images.skew_angle(seg).select("doc_id", F.round("skew_angle", 6).alias("skew_angle"))


def detected_boxes(spark, d):
    boxes = _boxes(spark, d).withColumns({"image_width": F.lit(300), "image_height": F.lit(200)})
    return images.detected_boxes(boxes).select("doc_id", "box_idx", "x", "y", "width", "height")


def glyph_confidence(spark, d):
    heights = S.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.col("l_quantity") + 10).alias("h"))
    return heights.select("doc_id", images.glyph_confidence(F.col("h")).alias("confidence"))


def ctc_decode(spark, d):
    steps = S.read(spark, d, "part").select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("p_partkey") * (i / 3).cast("int") + (i / 2).cast("int")) % 4).alias("s"))
    return steps.select("p_partkey", images.ctc_text(F.col("s"), "abc").alias("text"))


QUERIES = {f.__name__: f for f in (
    extract_fields, line_key_values, merge_fields, document_type, extraction_summary, extraction_result, summary_chunks, ocr_index, export_rows, doc_details, reading_order, normalized_boxes, cell_rows, cell_word_join,
    table_reconstruct, table_row_chunks, line_assembly, spatial_kv, page_confidence, document_confidence, key_usage, authorized_requests, masked_keys, upload_validation, skew_angles, detected_boxes,
    glyph_confidence, ctc_decode)}
QUERIES |= {f"extract_{f}": partial(extract_field, f) for f in ["vendor_name", *fixed.PATTERNS]}


def _line_value(field: str) -> str:
    tries = []
    for p in fixed.PATTERNS[field]:
        raw = STRIP.format(x=f"nullif(regexp_extract(t, '{p}', 1), '')")
        amount = f"TRY_CAST(nullif(regexp_replace({raw}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
        listed = lambda x: ", ".join(f"'{w}'" for w in x)
        if field == "invoice_number":
            tries.append(f"CASE WHEN lower({raw}) NOT IN ({listed(fixed.NOT_A_NUMBER)}) THEN {raw} END")
        elif field == "invoice_date":
            tries.append(f"CASE WHEN regexp_matches({raw}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}$') THEN strftime(strptime({raw}, '%d/%m/%Y'), '%Y-%m-%d') ELSE {raw} END")
        elif field in extract.AMOUNTS:
            tries.append(f"CASE WHEN {amount} {'> 0' if field == 'balance_amount' else 'IS NOT NULL'} THEN {raw} END")
        elif field == "customer_name":
            tries.append(f"CASE WHEN length({raw}) >= 3 AND lower({raw}) NOT IN ({listed(fixed.NOT_A_CUSTOMER)}) THEN {raw} END")
        elif field == "bank_name":
            tries.append(f"CASE WHEN length({raw}) >= 3 THEN {raw} END")
        else:
            tries.append(raw)
    return f"coalesce({', '.join(tries)})"


_NAMES = ["vendor_name", *fixed.PATTERNS]


def _fields_sql(names: list[str]) -> str:
    """CTEs up to ``fields`` for some fields, independent of the operator: ranked candidates, not aggregates."""
    parts = []
    for f in names:
        if f == "vendor_name":
            v = "regexp_replace(t, '^[^A-Za-z0-9]+', '')"
            parts.append(f"SELECT doc_id, '{f}' AS field, {v} AS value, page_number, line_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number DESC, line_number) AS k FROM l WHERE place <= 10 AND {_any('lower(t)', fixed.VENDOR_WORDS)} AND length({v}) >= 4")
        else:
            parts.append(f"SELECT doc_id, '{f}' AS field, v AS value, page_number, line_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, line_number) AS k FROM (SELECT *, {_line_value(f)} AS v FROM l) WHERE v IS NOT NULL")
    conf = "CASE field " + " ".join(f"WHEN '{f}' THEN {c}::DOUBLE" for f, c in fixed.CONFIDENCE.items()) + " END"
    fallback = ""
    if "total_amount" in names:
        v = f"nullif(regexp_extract(w, '{fixed.TOTAL_FALLBACK}', 1), '')"
        fallback = f""" UNION ALL SELECT doc_id, 'total_amount', v, 1, NULL, {fixed.CONFIDENCE['total_fallback']}::DOUBLE FROM (SELECT doc_id, {v} AS v FROM (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_number, line_number) AS w FROM lines GROUP BY 1))
          WHERE v IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM found WHERE field = 'total_amount')"""
    return f"""{S.LINES_SQL}, l AS (SELECT *, {STRIP.format(x='text')} AS t, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_number) AS place FROM lines),
found AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE k = 1),
long AS (SELECT doc_id, field, value, page_number, line_number, {conf} AS confidence FROM found{fallback}),
fields AS (SELECT doc_id, field, value, CASE WHEN field IN ('total_amount', 'balance_amount', 'subtotal', 'tax_amount') THEN TRY_CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) END AS value_num, page_number, line_number, confidence FROM long)"""


_NAMED = "CASE field " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, n in fixed.FIELD_NAMES.items()) + " END"
_KV = f"""kv AS (SELECT doc_id, page_number, line_number, key, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, lower(key) ORDER BY line_number) AS k FROM (
  SELECT doc_id, page_number, line_number,
    {STRIP.format(x="regexp_replace(" + STRIP.format(x="regexp_extract(t, '(?s)^(.*?)(?:[:=]| - )', 1)") + ", '^[^A-Za-z0-9]+|[^A-Za-z0-9\\s.]+$', '', 'g')")} AS key,
    {STRIP.format(x="regexp_replace(" + STRIP.format(x="regexp_extract(t, '(?s)^.*?(?:[:=]| - )(.*)$', 1)") + ", '^[^A-Za-z0-9]+|[^A-Za-z0-9\\s.,]+$', '', 'g')")} AS value
  FROM l WHERE regexp_matches(t, '[:=]| - ')) WHERE length(key) BETWEEN 2 AND 35 AND length(value) > 0) WHERE k = 1)"""
_TYPE = "CASE " + " ".join(f"WHEN {_any('lower({x})', w)} THEN '{k}'" for k, w in fixed.TYPE_WORDS.items()) + " ELSE 'generic' END"
_ORDERED = "line_idx AS (SELECT doc_id, CAST(word_idx // 4 AS INTEGER) AS line_number, string_agg(text, ' ' ORDER BY word_idx, text) AS text FROM words GROUP BY 1, 2)"
_REPAIR = "CASE WHEN regexp_matches(text, '\\d') THEN translate(text, 'OoIlSsB', '0011558') ELSE text END"
_PAGES = f"""{S.WORDS_SQL}, {_ORDERED}, pg AS (SELECT doc_id, string_agg({STRIP.format(x="regexp_replace(text, '[ ]+', ' ', 'g')")}, chr(10) ORDER BY line_number) AS full_text FROM line_idx GROUP BY 1),
wc AS (SELECT doc_id, round(avg(confidence), 3) AS average_confidence, count(*) AS words FROM words WHERE {STRIP.format(x=_REPAIR)} <> '' GROUP BY 1)"""
_ROWS = f"""{S.CELLS_SQL}, flagged AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 12 THEN 1 ELSE 0 END AS n FROM cells WINDOW w AS (PARTITION BY doc_id ORDER BY y, cell_idx)),
rowed AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY y, cell_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_idx FROM flagged),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, row_idx ORDER BY x, y, cell_idx) - 1 AS INTEGER) AS col_idx FROM rowed)"""
_INSIDE = "c.doc_id = w.doc_id AND w.x + w.width / 2.0 BETWEEN c.x AND c.x + c.width AND w.y + w.height / 2.0 BETWEEN c.y AND c.y + c.height"
_TABLE = f"""WITH {_ROWS}, {S.WORDS_SQL},
txt AS (SELECT c.doc_id, c.cell_idx, c.row_idx, c.col_idx, coalesce(string_agg(w.text, ' ' ORDER BY w.word_idx, w.text), '') AS text FROM placed c LEFT JOIN words w ON {_INSIDE} GROUP BY 1, 2, 3, 4),
tr AS (SELECT doc_id, row_idx, string_agg(text, ' | ' ORDER BY col_idx) AS r, count(*) AS n FROM txt GROUP BY 1, 2),
tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) AS k, count(*) OVER (PARTITION BY doc_id) AS rows_ FROM tr)"""

_SUMMARY = f"""SELECT doc_id, doc_id || '_summary' AS chunk_id, 'Structured Document Entities:' || chr(10) || string_agg(array_to_string(list_transform(string_split(field, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ': ' || value, chr(10) ORDER BY list_position([{", ".join(f"'{f}'" for f in _NAMES)}], field)) AS text FROM fields GROUP BY 1"""
_TABLE_ROWS = "tc AS (SELECT doc_id, doc_id || '_t0_r' || i AS chunk_id, 'Table 1 Row ' || (i + 1) || ': ' || r AS text FROM (SELECT *, k - CASE WHEN rows_ > 1 THEN 2 ELSE 1 END AS i FROM tn WHERE k > 1 OR rows_ = 1))"



def _merged_sql(pairs: str, removed: tuple[str, ...] = ()) -> str:
    """CTEs up to ``added`` (doc_id, n, field, value, method, key): the merge, one pair of a document at a time.

    pairs: a relation p(doc_id, n, key, value), n counting from 1 in a document.
    """
    fits = "list_filter([" + ", ".join(f"CASE WHEN {_any('lower(key)', w)} THEN '{f}' END" for f, w in fixed.KEY_WORDS.items()) + "], lambda f: f IS NOT NULL)"
    name = f"regexp_replace(regexp_replace({STRIP.format(x='lower(key)')}, '[^a-zA-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"
    date = "CASE WHEN regexp_matches(v, '^\\d{2}/\\d{2}/\\d{4}$') THEN strftime(strptime(v, '%d/%m/%Y'), '%Y-%m-%d') ELSE v END"
    gone = f"WHERE field NOT IN ({', '.join(f"'{f}'" for f in removed)})" if removed else ""
    return f"""
pairs AS (SELECT doc_id, n, key, {STRIP.format(x='value')} AS v, {fits} AS fits, {name} AS name, coalesce(TRY_CAST(nullif(regexp_replace(value, '[^0-9.]', '', 'g'), '') AS DOUBLE) > 0, false) AS amount FROM ({pairs})),
have AS (SELECT doc_id, list(field) AS taken FROM fields {gone} GROUP BY 1),
fold AS (
  SELECT doc_id, 0::BIGINT AS n, coalesce(taken, []::VARCHAR[]) AS taken, NULL::VARCHAR AS field, NULL::VARCHAR AS value, NULL::VARCHAR AS method, NULL::VARCHAR AS key FROM (SELECT DISTINCT doc_id FROM pairs) LEFT JOIN have USING (doc_id)
  UNION ALL SELECT doc_id, n, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, pick, CASE WHEN f IS NULL THEN v WHEN f = 'invoice_date' THEN {date} ELSE v END, CASE WHEN f IS NULL THEN 'form_field' ELSE 'spatial_kv' END, key FROM (
    SELECT *, CASE WHEN f IS NULL THEN CASE WHEN length(name) BETWEEN 1 AND 30 AND NOT list_contains(taken, name) THEN name END WHEN f <> 'total_amount' OR amount THEN f END AS pick FROM (
      SELECT p.*, fold.taken, list_filter(p.fits, lambda f: NOT list_contains(fold.taken, f))[1] AS f FROM fold JOIN pairs p ON p.doc_id = fold.doc_id AND p.n = fold.n + 1))),
added AS (SELECT * FROM fold WHERE field IS NOT NULL)"""


_RESULT_SQL = f"""WITH RECURSIVE {_fields_sql(_NAMES)}, {_KV}, {{table}}, sk AS ({{spatial}}),
both_kv AS (SELECT doc_id, page_number, 0 AS kind, line_number AS place, key, value, 0.9::DOUBLE AS confidence FROM kv
  UNION ALL SELECT doc_id, 1, 1, word_idx, key, value, confidence FROM sk WHERE NOT EXISTS (SELECT 1 FROM kv WHERE kv.doc_id = sk.doc_id AND kv.page_number = 1 AND lower(kv.key) = lower(sk.key))),
allkv AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, kind, place, key, value) AS n FROM both_kv),
{_merged_sql('SELECT doc_id, n, key, value FROM allkv')},
one AS (SELECT doc_id, field, value, value_num, confidence, CASE WHEN field = 'vendor_name' THEN 'rule_based' ELSE 'regex' END AS method, CASE WHEN line_number IS NULL THEN 1 ELSE 0 END AS late, page_number AS p, CASE WHEN field = 'vendor_name' THEN 0 ELSE line_number END AS line,
    list_position([{", ".join(f"'{f}'" for f in _NAMES)}], field) AS rule FROM fields
  UNION ALL SELECT a.doc_id, a.field, a.value, CASE WHEN a.field = 'total_amount' AND method = 'spatial_kv' THEN TRY_CAST(nullif(regexp_replace(a.value, '[^0-9.]', '', 'g'), '') AS DOUBLE) END, k.confidence, method, 2, 0, 0, a.n FROM added a JOIN allkv k ON k.doc_id = a.doc_id AND k.n = a.n),
fl AS (SELECT doc_id, string_agg(field, '|' ORDER BY late, p, line, rule) AS fields, string_agg(value, '|' ORDER BY late, p, line, rule) AS field_values, string_agg(method, '|' ORDER BY late, p, line, rule) AS methods, avg(round(confidence * 100)) / 100 AS m,
  max(CASE WHEN field = 'invoice_number' THEN value END) AS num, max(CASE WHEN field = 'customer_name' THEN value END) AS cust, max(CASE WHEN field = 'invoice_date' THEN value END) AS day, max(CASE WHEN field = 'total_amount' THEN value_num END) AS tot FROM one GROUP BY 1),
kl AS (SELECT doc_id, string_agg(key, '|' ORDER BY n) AS keys, string_agg(value, '|' ORDER BY n) AS key_values FROM allkv GROUP BY 1),
ty AS (SELECT doc_id, {_TYPE.format(x="string_agg(text, chr(10) ORDER BY line_number)")} AS document_type FROM lines GROUP BY 1),
tt AS (SELECT doc_id, string_agg(r, chr(10) ORDER BY k) AS table_rows FROM tn GROUP BY 1)
SELECT ty.doc_id, document_type, concat_ws(' ', 'Classified as ' || upper(document_type) || '.', 'Number: ' || num || '.', 'Name: ' || cust || '.', 'Date: ' || day || '.', 'Total: ' || CAST(tot AS VARCHAR) || '.') AS summary, coalesce(round(m, 3), 0.85::DOUBLE) AS overall_confidence,
  fields, field_values, methods, keys, key_values, coalesce(table_rows, '') AS table_rows FROM ty LEFT JOIN fl USING (doc_id) LEFT JOIN kl USING (doc_id) LEFT JOIN tt USING (doc_id)"""

_LINES_BY_MEAN = f"""WITH RECURSIVE {S.WORDS_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, word_idx, height, width, text) AS n, y + height / 2.0::DOUBLE AS c FROM words),
f AS (
  SELECT doc_id, n, 1 AS line, c AS centres, height::DOUBLE AS heights, 1 AS k FROM o WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN centres ELSE 0 END + c, CASE WHEN j THEN heights ELSE 0 END + height, CASE WHEN j THEN k ELSE 0 END + 1 FROM (
    SELECT o.doc_id, o.n, o.c, o.height::DOUBLE AS height, line, centres, heights, k, abs(o.c - centres / k) <= heights / k * 0.65::DOUBLE AS j FROM f JOIN o ON o.doc_id = f.doc_id AND o.n = f.n + 1)),
w AS (SELECT o.*, f.line FROM o JOIN f ON o.doc_id = f.doc_id AND o.n = f.n)
SELECT doc_id, 1 AS page_number, line AS line_number, string_agg(text, ' ' ORDER BY w.x, w.y, word_idx, text) AS text, round(avg(confidence), 3) AS confidence, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM w WHERE text <> '' GROUP BY 1, 3"""

ORACLES = {
    "merge_fields": f"WITH RECURSIVE {_fields_sql(_NAMES)}, {_KV}, {_merged_sql('SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS n, key, value FROM kv', ('customer_name', 'phone', 'total_amount'))} SELECT a.doc_id, a.field, a.value, a.method, k.line_number AS position FROM added a JOIN (SELECT doc_id, line_number, row_number() OVER (PARTITION BY doc_id ORDER BY line_number) AS n FROM kv) k ON k.doc_id = a.doc_id AND k.n = a.n",
    "line_assembly": _LINES_BY_MEAN,
    "extract_fields": f"WITH {_fields_sql(_NAMES)} SELECT * FROM fields",
    **{f"extract_{f}": f"WITH {_fields_sql([f])} SELECT doc_id, value, value_num, page_number, line_number, confidence FROM fields" for f in _NAMES},
    "line_key_values": f"WITH {S.LINES_SQL}, l AS (SELECT *, {STRIP.format(x='text')} AS t FROM lines), {_KV} SELECT * FROM kv",
    "document_type": f"SELECT doc_id, {_TYPE.format(x='text')} AS document_type FROM documents",
    "extraction_summary": f"""WITH {_fields_sql(_NAMES)}, ty AS (SELECT doc_id, {_TYPE.format(x="string_agg(text, chr(10) ORDER BY line_number)")} AS document_type FROM lines GROUP BY 1),
f AS (SELECT doc_id, max(CASE WHEN field = 'invoice_number' THEN value END) AS n, max(CASE WHEN field = 'customer_name' THEN value END) AS c, max(CASE WHEN field = 'invoice_date' THEN value END) AS d, max(CASE WHEN field = 'total_amount' THEN value_num END) AS t, avg(round(confidence * 100)) / 100 AS m FROM fields GROUP BY 1)
SELECT ty.doc_id, document_type, concat_ws(' ', 'Classified as ' || upper(document_type) || '.', 'Number: ' || n || '.', 'Name: ' || c || '.', 'Date: ' || d || '.', 'Total: ' || CAST(t AS VARCHAR) || '.') AS summary, coalesce(round(m, 3), 0.85::DOUBLE) AS overall_confidence FROM ty LEFT JOIN f ON ty.doc_id = f.doc_id""",
    "summary_chunks": f"WITH {_fields_sql(_NAMES)} {_SUMMARY}",
    "ocr_index": f"""WITH {_fields_sql(_NAMES)}, {_TABLE.removeprefix('WITH ')}, sm AS ({_SUMMARY}), {_TABLE_ROWS},
ln AS (SELECT doc_id, page_number, list(t ORDER BY line_number) AS l FROM l WHERE t <> '' GROUP BY 1, 2),
lw AS (SELECT doc_id, page_number, l, unnest(range(0, (len(l) + 1) // 2)) AS w FROM ln),
u AS (SELECT doc_id, 0 AS kind, 1 AS page_number, 0 AS place, chunk_id, text, 'structured_summary' AS type, NULL::INTEGER AS line_count FROM sm
  UNION ALL SELECT doc_id, 1, 1, i, chunk_id, text, 'table_row', NULL FROM (SELECT b.*, t.chunk_id, t.text FROM (SELECT *, k - CASE WHEN rows_ > 1 THEN 2 ELSE 1 END AS i FROM tn WHERE k > 1 OR rows_ = 1) b JOIN tc t ON t.chunk_id = b.doc_id || '_t0_r' || b.i)
  UNION ALL SELECT doc_id, 2, page_number, w, NULL, array_to_string(list_slice(l, 2 * w + 1, 2 * w + 3), ' '), 'ocr_text', CASE WHEN len(l) >= 2 * w + 3 THEN 3 END FROM lw),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, CASE WHEN kind = 2 THEN page_number END, place) - 1 AS chunk_idx FROM u)
SELECT doc_id, coalesce(chunk_id, doc_id || '_p' || page_number || '_' || chunk_idx) AS chunk_id, chunk_idx, page_number, text, type, line_count FROM n""",
    "spatial_kv": f"""WITH {S.WORDS_SQL},
k AS (SELECT doc_id, word_idx AS key_idx, left(text, length(text) - 1) AS key, x AS kx, y AS ky, width AS kw, greatest(20, CAST(floor(height * 1.6) AS INTEGER)) AS dy FROM words WHERE text LIKE '%:' AND length(text) > 1),
c AS (SELECT k.*, w.word_idx AS wi, w.x AS wx, w.width AS ww, w.text AS wt, abs(w.y - ky) < dy AND w.x > kx AS beside, abs(w.x - kx) < greatest(50, kw) AND w.y - ky > 0 AND w.y - ky < dy * 3 AS under FROM k JOIN words w ON k.doc_id = w.doc_id AND w.word_idx > key_idx),
r AS (SELECT *, CASE WHEN wx - lag(wx + ww) OVER o >= greatest(50, lag(ww) OVER o * 1.5) THEN 1 ELSE 0 END AS gap FROM c WHERE beside WINDOW o AS (PARTITION BY doc_id, key_idx, key ORDER BY wi, wx, ww, wt)),
s AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id, key_idx, key ORDER BY wi, wx, ww, wt ROWS UNBOUNDED PRECEDING) AS gaps FROM r),
rv AS (SELECT doc_id, key_idx, key, string_agg(wt, ' ' ORDER BY wi, wx, ww, wt) AS v FROM s WHERE gaps = 0 GROUP BY 1, 2, 3),
bv AS (SELECT doc_id, key_idx, key, arg_min(wt, wi) AS v FROM c WHERE under GROUP BY 1, 2, 3),
f AS (SELECT k.doc_id, k.key_idx AS word_idx, k.key, coalesce(rv.v, bv.v) AS value, CASE WHEN rv.v IS NOT NULL THEN 0.87::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM (SELECT DISTINCT doc_id, key_idx, key FROM k) k
  LEFT JOIN rv ON k.doc_id = rv.doc_id AND k.key_idx = rv.key_idx AND k.key = rv.key LEFT JOIN bv ON k.doc_id = bv.doc_id AND k.key_idx = bv.key_idx AND k.key = bv.key)
SELECT doc_id, word_idx, key, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(key) ORDER BY word_idx) AS n FROM f WHERE value <> '') WHERE n = 1""",
    "export_rows": f"WITH {_fields_sql(_NAMES)}, {_KV} SELECT doc_id, 'Primary Field' AS category, {_NAMED} AS name, value, confidence, CASE WHEN field = 'vendor_name' THEN 'rule_based' ELSE 'regex' END AS method FROM fields UNION ALL SELECT doc_id, 'Key-Value Pair', key, value, 0.9::DOUBLE, 'spatial_kv' FROM kv",
    "doc_details": f"WITH {_fields_sql(_NAMES)}, {_PAGES}, n AS (SELECT doc_id, count(*) AS fields FROM fields GROUP BY 1) SELECT o_orderkey AS doc_id, o_orderstatus AS status, CASE WHEN wc.doc_id IS NOT NULL THEN 1 END::BIGINT AS total_pages, words AS total_words, average_confidence AS overall_confidence, fields FROM orders LEFT JOIN wc ON o_orderkey = wc.doc_id LEFT JOIN n ON o_orderkey = n.doc_id",
    "reading_order": f"""WITH {S.WORDS_SQL}, f AS (SELECT *, CASE WHEN abs(y - lag(y) OVER w) > 15 AND abs(y + height - lag(y + height) OVER w) > 15 THEN 1 ELSE 0 END AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY y, word_idx)),
g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY y, word_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM f) SELECT doc_id, word_idx AS box_idx, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line, x, y, word_idx) AS INTEGER) AS position FROM g""",
    "normalized_boxes": f"WITH {S.WORDS_SQL} SELECT doc_id, word_idx AS box_idx, round(x / 600::DOUBLE, 4) AS x_norm, round(y / 400::DOUBLE, 4) AS y_norm, round(width / 600::DOUBLE, 4) AS w_norm, round(height / 400::DOUBLE, 4) AS h_norm FROM words",
    "cell_rows": f"WITH {_ROWS} SELECT doc_id, cell_idx, row_idx, col_idx FROM placed",
    "cell_word_join": f"WITH {S.CELLS_SQL}, {S.WORDS_SQL}, t AS (SELECT c.doc_id, c.cell_idx, c.y, coalesce(string_agg(w.text, ' ' ORDER BY w.word_idx, w.text), '') AS text FROM cells c LEFT JOIN words w ON {_INSIDE} GROUP BY 1, 2, 3) SELECT doc_id, cell_idx, text, CASE WHEN text <> '' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM t",
    "table_reconstruct": f"{_TABLE} SELECT doc_id, CAST(any_value(rows_) AS INTEGER) AS num_rows, CAST(max(n) AS INTEGER) AS num_cols, coalesce(max(CASE WHEN k = 1 AND rows_ > 1 THEN r END), '') AS headers, string_agg(CASE WHEN k > 1 OR rows_ = 1 THEN r END, chr(10) ORDER BY k) AS rows FROM tn GROUP BY 1",
    "table_row_chunks": f"{_TABLE}, {_TABLE_ROWS} SELECT * FROM tc",
    "page_confidence": f"WITH {_PAGES} SELECT pg.doc_id, 1 AS page_number, full_text, coalesce(average_confidence, 0) AS average_confidence, coalesce(words, 0) AS words FROM pg LEFT JOIN wc ON pg.doc_id = wc.doc_id",
    "document_confidence": f"WITH {_PAGES} SELECT doc_id, 1::BIGINT AS total_pages, words AS total_words, average_confidence AS overall_confidence FROM wc",
    "key_usage": f"WITH {S.KEYS_SQL}, {S.REQUESTS_SQL} SELECT key_id, is_active, count(ts) AS request_count, max(ts) AS last_used_at FROM keys k LEFT JOIN requests r ON k.api_key = r.api_key AND is_active GROUP BY 1, 2",
    "authorized_requests": f"WITH {S.KEYS_SQL}, {S.REQUESTS_SQL} SELECT event_id, endpoint FROM requests WHERE api_key IN (SELECT api_key FROM keys WHERE is_active)",
    "masked_keys": f"WITH {S.KEYS_SQL} SELECT key_id, CASE WHEN length(api_key) > 16 THEN left(api_key, 12) || '...' || right(api_key, 4) ELSE api_key END AS api_key FROM keys",
    "upload_validation": f"""WITH u AS (SELECT {S.PATH} AS path, {S.LENGTH} AS length, {S.HEADER} AS h FROM part), e AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS extension FROM u)
SELECT path, extension, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[^a-zA-Z0-9_.-]', '_', 'g') AS name, CASE WHEN h LIKE '25504446%' THEN 'pdf' WHEN h LIKE '89504E47%' THEN 'png' WHEN h LIKE '52494646%' THEN 'webp' END AS detected_type,
  CASE WHEN extension NOT IN ({", ".join(f"'{x}'" for x in fixed.EXTENSIONS)}) THEN 'extension' WHEN length > {fixed.MAX_BYTES} THEN 'size' WHEN length = 0 THEN 'empty' END AS rejected FROM e""",
    "skew_angles": f"WITH {S.WORDS_SQL}, a AS (SELECT doc_id, median(degrees(atan2((word_idx % 3 - 1)::DOUBLE, width::DOUBLE))) AS m FROM words GROUP BY 1) SELECT doc_id, round(CASE WHEN abs(m) > 0.3 THEN m ELSE 0 END, 6) + 0.0::DOUBLE AS skew_angle FROM a",
    "detected_boxes": f"WITH {S.WORDS_SQL} SELECT doc_id, word_idx AS box_idx, greatest(0, x - CAST(floor(width * 0.02) AS INTEGER)) AS x, greatest(0, y - CAST(floor(height * 0.04) AS INTEGER)) AS y, least(300 - greatest(0, x - CAST(floor(width * 0.02) AS INTEGER)), width + 2 * CAST(floor(width * 0.02) AS INTEGER)) AS width, least(200 - greatest(0, y - CAST(floor(height * 0.04) AS INTEGER)), height + 2 * CAST(floor(height * 0.04) AS INTEGER)) AS height FROM words WHERE width * height >= 40 AND width * height <= 0.95 * 60000 AND width >= 8 AND height >= 8",
    "glyph_confidence": "SELECT l_orderkey AS doc_id, round(least(0.95::DOUBLE, greatest(0.5::DOUBLE, 1 - var_pop(l_quantity + 10) / pow(median(l_quantity + 10), 2))), 3) AS confidence FROM lineitem GROUP BY 1",
    "ctc_decode": "WITH s AS (SELECT p_partkey, list_transform(range(0, 12), lambda i: (p_partkey * (i // 3) + i // 2) % 4) AS s FROM part) SELECT p_partkey, array_to_string(list_transform(list_filter(range(1, 13), lambda i: s[i] <> 0 AND (i = 1 OR s[i] <> s[i - 1])), lambda i: substr('abc', s[i], 1)), '') AS text FROM s",
}
ORACLES["extraction_result"] = _RESULT_SQL.replace("{spatial}", ORACLES["spatial_kv"].replace(S.WORDS_SQL + ",", "", 1).replace("SELECT doc_id, word_idx, key, value, confidence FROM (", "SELECT * EXCLUDE (n) FROM (")).replace("{table}", _TABLE.removeprefix("WITH "))
