"""Field and key/value extraction from the lines of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import fixed
from leafmill.functions.text import bound, contains_any, field_key, first_group, parse_amount, standardize_date, strip
from leafmill.operators.layout import neighbours, new_keys

AMOUNTS = ("total_amount", "balance_amount", "subtotal", "tax_amount")


def line_value(field: str, line: Column, low: Column | None = None) -> Column:
    """What a line says of a field as text (a date as it stands), or null: the first pattern whose match is acceptable.

    A pattern is tried once, and only on lines that have what all matches of the field have: one of its words, a date's separator or month, a
    phone's ten digits.  low: the line in lower case, if it is at hand.
    """
    low = F.lower(line) if low is None else low

    def acceptable(raw: Column) -> Column:
        if field == "invoice_number":
            return F.when(~F.lower(raw).isin(fixed.NOT_A_NUMBER), raw)
        if field in AMOUNTS:
            return F.when(parse_amount(raw) > 0 if field == "balance_amount" else parse_amount(raw).isNotNull(), raw)
        if field == "customer_name":
            return F.when((F.char_length(raw) >= 3) & ~F.lower(raw).isin(fixed.NOT_A_CUSTOMER), raw)
        if field == "bank_name":
            return F.when(F.char_length(raw) >= 3, raw)
        return raw

    tries = [bound(F.regexp_extract(line, pattern, 1), lambda raw: acceptable(strip(F.when(raw != "", raw)))) for pattern in fixed.PATTERNS[field]]
    found = F.coalesce(*tries)
    if field == "invoice_date":
        return F.when(line.rlike(r"\d[-/.]\d") | contains_any(line, fixed.MONTHS), found)
    if field == "phone":
        return F.when(line.rlike(r"(?:\d\D*+){10}"), found)
    return F.when(contains_any(low, fixed.HINTS[field]), found) if field in fixed.HINTS else found


def _found(lines: DataFrame, names: list[str]) -> DataFrame:
    """doc_id and, for each field, a struct of page_number, line_number and value of the line that says it, or null; ``fallback`` is a total found across lines.

    A line's values are found before lines are gathered, so one aggregation by document serves all, and what is shuffled is one
    row for each part of a document; the vendor, whose rule counts lines, is folded in the document's row.
    """
    # a generator, so that the stripped line is computed once and not put into each expression again
    rows = lines.select("doc_id", "page_number", "line_number", "text", F.explode(F.array(strip(F.col("text")))).alias("line"))
    rows = rows.select("*", F.explode(F.array(F.lower("line"))).alias("low"))
    line, low = F.col("line"), F.col("low")
    vendor = F.regexp_replace(line, "^[^A-Za-z0-9]+", "")
    is_vendor = contains_any(low, fixed.VENDOR_WORDS) & (F.char_length(vendor) >= 4)
    said = lambda v: F.struct("page_number", "line_number", v.alias("value"))
    values = {f: line_value(f, line, low) for f in names if f != "vendor_name"}
    rows = rows.select("doc_id", "page_number", "line_number", "text", F.when(is_vendor, vendor).alias("vendor_name"), *(v.alias(f) for f, v in values.items()))
    found = [F.min(F.when(F.col(f).isNotNull(), said(F.col(f)))).alias(f) for f in values]
    whole = "vendor_name" in names or "total_amount" in names
    listed = [F.array_sort(F.collect_list(F.struct("page_number", "line_number", "text", "vendor_name"))).alias("lines")] if whole else []
    docs = rows.groupBy("doc_id").agg(*found, *listed)

    def vendor_of(a: Column, x: Column) -> Column:
        """One step: the line's place on its page, and the first line of the last page whose first ten lines have one."""
        place = F.when(a["page"].eqNullSafe(x["page_number"]), a["place"] + 1).otherwise(1)
        later = a["best"].isNull() | ~a["best"]["page_number"].eqNullSafe(x["page_number"])
        take = x["vendor_name"].isNotNull() & (place <= 10) & later
        return F.struct(x["page_number"].alias("page"), place.alias("place"), F.when(take, F.struct(x["page_number"].alias("page_number"), x["line_number"].alias("line_number"), x["vendor_name"].alias("value"))).otherwise(a["best"]).alias("best"))

    columns = {f: F.col(f) for f in values}
    if "vendor_name" in names:
        kinds = {c: lines.schema[c].dataType for c in ("page_number", "line_number")}
        none = F.lit(None).cast(f"struct<page_number:{kinds['page_number'].simpleString()},line_number:{kinds['line_number'].simpleString()},value:string>")
        start = F.struct(F.lit(None).cast(kinds["page_number"]).alias("page"), F.lit(0).alias("place"), none.alias("best"))
        some = F.exists("lines", lambda x: x["vendor_name"].isNotNull())
        columns["vendor_name"] = F.when(some, F.aggregate("lines", start, vendor_of, lambda a: a["best"]))
    if "total_amount" in names:
        across = first_group(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), fixed.TOTAL_FALLBACK)
        columns["fallback"] = F.when(F.col("total_amount").isNull(), bound(across, lambda v: F.when(parse_amount(v) > 0, v)))
    return docs.select("doc_id", *(c.alias(f) for f, c in columns.items()))


def field_counts(lines: DataFrame) -> DataFrame:
    """doc_id and the number of fields that rule_fields finds, for documents with any."""
    names = ["vendor_name", *fixed.PATTERNS]
    found = sum((F.col(f).isNotNull().cast("bigint") for f in [*names, "fallback"]), F.lit(0).cast("bigint"))
    return _found(lines, names).select("doc_id", found.alias("fields")).where("fields > 0")


def rule_fields(lines: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(doc_id, page_number, line_number, text) to a long table: doc_id, field, value, value_num, page_number, line_number, confidence.

    One aggregation by document finds, for every field at once, the first line that has it; only the
    vendor's rule differs (first ten lines of a page, the last page that has one).  Dates are brought into
    one format when the line is found.  only: the fields to look for, all if not given.
    """
    names = only or ["vendor_name", *fixed.PATTERNS]

    def entry(f: str) -> Column:
        own = F.struct(
            F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.page_number").cast("int").alias("page_number"),
            F.col(f"{f}.line_number").cast("int").alias("line_number"), F.lit(fixed.CONFIDENCE[f]).alias("confidence"),
        )
        if f != "total_amount":
            return own
        other = F.struct(F.lit(f).alias("field"), F.col("fallback").alias("value"), F.lit(1).alias("page_number"), F.lit(None).cast("int").alias("line_number"), F.lit(fixed.CONFIDENCE["total_fallback"]).alias("confidence"))
        return F.when(F.col("total_amount").isNull(), other).otherwise(own)

    long = _found(lines, names).select("doc_id", F.explode(F.array(*(entry(f) for f in names))).alias("f")).select("doc_id", "f.*").where("value is not null")
    amount = F.when(F.col("field").isin(*AMOUNTS), parse_amount(F.col("value")))
    value = F.when(F.col("field") == "invoice_date", standardize_date(F.col("value"))).otherwise(F.col("value"))
    return long.select("doc_id", "field", value.alias("value"), amount.alias("value_num"), "page_number", "line_number", "confidence")


def line_key_values(lines: DataFrame) -> DataFrame:
    """Key and value around the first delimiter of a line: doc_id, page_number, line_number, key, value; a key counts once a page."""
    line = strip(F.col("text"))
    parts = F.split(F.col("text"), r"[:=]| - ", 2)
    head, tail = parts[0], parts[1]
    key = strip(F.regexp_replace(strip(head), r"^[^A-Za-z0-9]+|[^A-Za-z0-9\s.]+$", ""))
    value = strip(F.regexp_replace(strip(tail), r"^[^A-Za-z0-9]+|[^A-Za-z0-9\s.,]+$", ""))
    found = lines.where(line.rlike(r"[:=]| - ")).select("doc_id", "page_number", "line_number", key.alias("key"), value.alias("value"))
    found = found.where(F.char_length("key").between(2, 35) & (F.char_length("value") > 0))
    first = F.row_number().over(Window.partitionBy("doc_id", "page_number", F.lower("key")).orderBy("line_number"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def merge_fields(fields: DataFrame, key_values: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Fill fields that are missing from key/values, in order, and promote other keys to fields of their own.

    fields: doc_id, field.  key_values: doc_id, position, key, value.  Returns the added ones: doc_id,
    field, value, method, position, and further columns of their key/value (extra; positions then count from 1).  Whether a key fills a field depends on what is there by then, so a
    document's pairs are folded in order, the accumulator being the names that are taken and what was added.
    """
    taken = fields.groupBy("doc_id").agg(F.collect_set("field").alias("taken"))
    # what does not depend on the order is made before the fold: the fields that a key fits, and its own name
    low, value = F.lower("key"), strip(F.col("value"))
    fits = F.filter(F.array(*(F.when(contains_any(low, listed), F.lit(field)) for field, listed in fixed.KEY_WORDS.items())), lambda f: f.isNotNull())
    each = key_values.select("doc_id", *extra, F.col("position").cast("int").alias("position"), value.alias("value"), fits.alias("fits"), field_key(F.col("key")).alias("name"))
    date = F.when(F.array_contains("fits", "invoice_date"), standardize_date(F.col("value")))
    amount = F.array_contains("fits", "total_amount") & F.coalesce(parse_amount(F.col("value")) > 0, F.lit(False))
    usable = F.when(F.char_length("name").between(1, 30), F.col("name"))
    each = each.select("doc_id", F.struct("position", "value", date.alias("date"), amount.alias("amount"), "fits", usable.alias("name"), *extra).alias("kv"))
    pairs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("kv")).alias("pairs"))
    added_type = "array<struct<field:string,value:string,method:string,position:int>>"

    def step(acc: Column, kv: Column) -> Column:
        field = F.try_element_at(F.filter(kv["fits"], lambda f: ~F.array_contains(acc["taken"], f)), F.lit(1))

        def choose(f: Column) -> Column:
            plain = F.struct(kv["name"].alias("field"), kv["value"].alias("value"), F.lit("form_field").alias("method"), kv["position"].alias("position"))
            filled = F.struct(f.alias("field"), F.when(f == "invoice_date", kv["date"]).otherwise(kv["value"]).alias("value"), F.lit("spatial_kv").alias("method"), kv["position"].alias("position"))
            own = F.when(kv["name"].isNotNull() & ~F.array_contains(acc["taken"], kv["name"]), plain)
            return F.when(f.isNull(), own).when((f != "total_amount") | kv["amount"], filled)

        def add(c: Column) -> Column:
            return F.when(c.isNull(), acc).otherwise(F.struct(F.concat(acc["taken"], F.array(c["field"])).alias("taken"), F.concat(acc["added"], F.array(c)).alias("added")))

        # a one-element array binds a value that is used more than once
        return F.transform(F.transform(F.array(field), choose), add)[0]

    start = F.struct(F.coalesce("taken", F.array().cast("array<string>")).alias("taken"), F.array().cast(added_type).alias("added"))
    folded = pairs.join(taken, "doc_id", "left").select("doc_id", "pairs", F.aggregate("pairs", start, step).alias("acc"))
    more = [F.element_at("pairs", F.col("a.position"))[c].alias(c) for c in extra]
    return folded.select("doc_id", "pairs", F.explode("acc.added").alias("a")).select("doc_id", "a.field", "a.value", "a.method", "a.position", *more)


def key_values(lines: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """All key/values of documents: doc_id, position (from 1), page_number, key, value, confidence; a page's lines come before its words."""
    pair = lambda kind, place, confidence: F.struct("page_number", F.lit(kind).alias("kind"), F.col(place).cast("bigint").alias("place"), "key", "value", confidence.alias("confidence"))
    of_lines = line_key_values(lines)
    # arrays by document are joined, since what is united here would have to be dealt out by document again
    both = of_lines.groupBy("doc_id").agg(F.collect_list(pair(0, "line_number", F.lit(fixed.LINE_PAIR))).alias("pairs"))
    if words is not None:
        spatial = new_keys(neighbours(words), of_lines).groupBy("doc_id").agg(F.collect_list(pair(1, "word_idx", F.col("confidence"))).alias("more"))
        none = F.array().cast(both.schema["pairs"].dataType)
        both = both.join(spatial, "doc_id", "full").select("doc_id", F.concat(F.coalesce("pairs", none), F.coalesce("more", none)).alias("pairs"))
    each = both.select("doc_id", F.posexplode(F.array_sort("pairs")).alias("position", "p"))
    return each.select("doc_id", (F.col("position") + 1).alias("position"), "p.page_number", "p.key", "p.value", "p.confidence")


def all_fields(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Fields of the rules and fields that key/values fill or add: doc_id, field, name, value, value_num, page_number, confidence, method, place (order in which they were found)."""
    rules = rule_fields(lines)
    known = F.create_map(*(F.lit(x) for f, n in fixed.FIELD_NAMES.items() for x in (f, n)))
    order = F.array_position(F.array(*(F.lit(f) for f in ["vendor_name", *fixed.PATTERNS])), F.col("field")).cast("int")
    # the total that was looked for in the whole text has no line and comes last
    place = F.struct(F.when(F.col("line_number").isNull(), 1).otherwise(0).alias("late"), "page_number", F.when(F.col("field") == "vendor_name", 0).otherwise(F.col("line_number")).alias("line"), order.alias("rule"))
    of_rules = rules.select("doc_id", "field", known[F.col("field")].alias("name"), "value", "value_num", "page_number", "confidence", F.when(F.col("field") == "vendor_name", "rule_based").otherwise("regex").alias("method"), place.alias("place"))
    added = merge_fields(rules, pairs, ("key", "page_number", "confidence"))
    late = F.struct(F.lit(2).alias("late"), F.lit(0).alias("page_number"), F.lit(0).alias("line"), F.col("position").alias("rule"))
    name = F.when(F.col("method") == "spatial_kv", known[F.col("field")]).otherwise(strip(F.col("key")))
    amount = F.when((F.col("field") == "total_amount") & (F.col("method") == "spatial_kv"), parse_amount(F.col("value")))
    of_pairs = added.select("doc_id", "field", name.alias("name"), "value", amount.alias("value_num"), "page_number", "confidence", "method", late.alias("place"))
    listed = lambda df: df.groupBy("doc_id").agg(F.collect_list(F.struct(*df.columns[1:])).alias("f"))
    both = listed(of_rules).join(listed(of_pairs).withColumnRenamed("f", "g"), "doc_id", "full")
    none = F.array().cast(both.schema["f"].dataType)
    return both.select("doc_id", F.explode(F.concat(F.coalesce("f", none), F.coalesce("g", none))).alias("f")).select("doc_id", "f.*")


def extraction_results(lines: DataFrame, words: DataFrame | None = None, hints: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """One row for each document: doc_id, document_type, summary, overall_confidence, fields, key_values and, if given, tables.

    Rules first, then key/values of lines and words, then what these add to the fields; type, summary and mean
    are of the merged fields.  hints: doc_id and document_type where it is known.  tables: doc_id, page_number, table_id,
    headers and rows; a document's tables follow in the order of its pages, the header being the first row.
    """
    pairs = key_values(lines, words)
    fields = all_fields(lines, pairs)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_number", "text"))), lambda s: s["text"])
    texts = lines.groupBy("doc_id").agg(F.array_join(whole, "\n").alias("text"))
    if hints is not None:
        texts = texts.join(hints.select("doc_id", F.col("document_type").alias("hint")), "doc_id", "left")
    types = texts.select("doc_id", document_type(F.col("text"), F.col("hint") if hints is not None else None).alias("document_type"))
    listed = F.array_sort(F.collect_list(F.struct("place", "field", "name", "value", "confidence", "page_number", "method")))
    by = fields.groupBy("doc_id").agg(F.transform(listed, lambda s: s.dropFields("place")).alias("fields"))
    kv = pairs.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "page_number", "key", "value", "confidence"))), lambda s: s.dropFields("position")).alias("key_values"))
    out = summaries(fields, types).join(by, "doc_id", "left").join(kv, "doc_id", "left")
    if tables is None:
        return out
    rows = F.when(F.size("headers") > 0, F.concat(F.array("headers"), F.col("rows"))).otherwise(F.col("rows"))
    listed = tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "table_id", rows.alias("rows")))).alias("tables"))
    return out.join(listed, "doc_id", "left")


def document_type(text: Column, hint: Column | None = None) -> Column:
    low = F.lower(text)
    found = F.lit("generic")
    for kind, listed in reversed(fixed.TYPE_WORDS.items()):
        found = F.when(contains_any(low, listed), kind).otherwise(found)
    return F.coalesce(hint, found) if hint is not None else found


def summaries(fields: DataFrame, types: DataFrame) -> DataFrame:
    """doc_id, document_type, summary and overall_confidence (mean, 0.85 without fields).

    Confidences have two digits; their hundredths are summed, so the mean does not depend on the order of rows.
    """
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    by = fields.groupBy("doc_id").agg(value("invoice_number").alias("n"), value("customer_name").alias("c"), value("invoice_date").alias("d"), F.max(F.when(F.col("field") == "total_amount", F.col("value_num"))).alias("t"), (F.avg(F.round(F.col("confidence") * 100)) / 100).alias("mean"))
    part = lambda lead, c: F.concat(F.lit(lead), c, F.lit("."))
    text = F.concat_ws(" ", part("Classified as ", F.upper("document_type")), part("Number: ", F.col("n")), part("Name: ", F.col("c")), part("Date: ", F.col("d")), part("Total: ", F.col("t").cast("string")))
    return types.join(by, "doc_id", "left").select("doc_id", "document_type", text.alias("summary"), F.coalesce(F.round("mean", 3), F.lit(0.85)).alias("overall_confidence"))


def export_rows(fields: DataFrame, key_values: DataFrame) -> DataFrame:
    """The five export columns: fields first, by the name they go by and the way they were found, then key/values."""
    known = F.create_map(*(F.lit(x) for f, n in fixed.FIELD_NAMES.items() for x in (f, n)))
    name = F.col("name") if "name" in fields.columns else F.coalesce(known[F.col("field")], F.col("field"))
    method = F.col("method") if "method" in fields.columns else F.when(F.col("field") == "vendor_name", "rule_based").otherwise("regex")
    a = fields.select("doc_id", F.lit("Primary Field").alias("category"), name.alias("name"), "value", "confidence", method.alias("method"))
    b = key_values.select("doc_id", F.lit("Key-Value Pair").alias("category"), F.col("key").alias("name"), "value", F.col("confidence") if "confidence" in key_values.columns else F.lit(fixed.LINE_PAIR).alias("confidence"), F.lit("spatial_kv").alias("method"))
    return a.unionByName(b)
