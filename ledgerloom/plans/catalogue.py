"""The queries of the library over the driver's tables, and the SQL that says what each returns.

The tables stand in for case documents: conversations are documents of pages, documents are page texts, benchmark the phrases and
quotes, labels the reviews, events the run log, orders and lineitem reasons and their evidence, customer the roster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.functions.codes import FREQUENCY, PII, PLACEHOLDERS, SCHEMAS
from ledgerloom.operators import cases, pages, pii, replies, reports, reviews, rules

QUERIES: dict = {}
ORACLES: dict = {}
RUN_KINDS = ["long_digit_run"]
STATUS = {"view": "in_progress", "click": "in_progress", "purchase": "passed", "error": "failed"}
# The scenario for dual readings: a variant of each text that differs for every seventh document, and a verdict for every third.
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def without_emails(text):
    return pii.redact_kind(text, "email", "email")


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")


@query("SELECT conv_id, turn + 1 AS page, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR) AS n FROM conversations")
def chunk_roundtrip(spark, sf):
    """Marks each conversation as one text, splits it again and numbers the chunks."""
    split = pages.split_documents(pages.mark_documents(turns(spark, sf), "conv_id", "page", "text"), "conv_id", "marked_text")
    got = pages.number_chunks(split.withColumn("case", F.col("conv_id")), "case", "pos", "conv_id", "page", "text")
    return got.select(F.col("document_id").alias("conv_id"), F.col("page_start").alias("page"), "text", F.regexp_extract("chunk_id", r"\d+", 0).alias("n"))


@query("""
WITH p AS (SELECT conv_id, turn AS pos, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 1 ELSE turn + 1 END AS page FROM conversations),
u AS (SELECT conv_id, page > lag(page, 1, 0) OVER (PARTITION BY conv_id ORDER BY pos) AS up FROM p)
SELECT conv_id, count(*) AS n_pages, bool_and(up) AS valid FROM u GROUP BY conv_id
""")
def page_order_gate(spark, sf):
    """Conversations, some with a page that falls back, by whether their pages strictly rise."""
    page = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 2), 1).otherwise(F.col("turn") + 1)
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), page.alias("page"))
    return pages.pages_in_order(rows, "conv_id", "pos", "page")


@query("SELECT CASE WHEN conv_id % 7 = 0 THEN 'excluded' ELSE 'chunks' END AS part, count(DISTINCT conv_id) AS n_documents, count(*) AS n_pages FROM conversations GROUP BY 1")
def chunk_coverage(spark, sf):
    """Chunked and excluded documents cover the case, and no document is both."""
    rows = turns(spark, sf)
    out = rows.filter(F.col("conv_id") % 7 == 0).select("conv_id").distinct()
    chunks = rows.join(out, "conv_id", "left_anti").withColumn("part", F.lit("chunks"))
    excluded = rows.join(out, "conv_id", "left_semi").withColumn("part", F.lit("excluded"))
    return chunks.union(excluded).groupBy("part").agg(F.count_distinct("conv_id").alias("n_documents"), F.count("*").alias("n_pages"))


@query("SELECT doc_id, unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: length(d) >= 11)) AS sample FROM documents")
def pii_digit_runs(spark, sf):
    return pii.scan(table(spark, sf, "documents"), "doc_id", "text", RUN_KINDS).select("doc_id", "sample")


@query(rf"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS email FROM documents")
def pii_email(spark, sf):
    return pii.scan(table(spark, sf, "documents"), "doc_id", "text", ["email"]).select("doc_id", F.col("sample").alias("email"))


@query(r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^0-9])\(?[0-9]{2,3}\)?[-.\s]+[0-9]{3,4}[-.\s]+[0-9]{4}([^0-9]|$)')")
def pii_phone_presence(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(pii.leaks(F.col("text"), ["phone_number_separated"])).select("doc_id")


@query()
def pii_scan_all_kinds(spark, sf):
    """Every match of every kind, with a planted value of each kind in every fiftieth document."""
    plant = " 900101-1234567 / 02-123-4567 / 01012345678 / 123-45-67890 / a@b.co / 12가 3456 / 123456789012345"
    docs = table(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(plant))).otherwise(F.col("text")))
    return pii.scan(docs, "doc_id", "text")


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g')) AS digest FROM documents")
def redact_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(without_emails(F.col("text")), 256).alias("digest"))


def redacted(spark, sf) -> DataFrame:
    """Documents with the spans that a pattern scan lists, redacted by the span fold."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    own = {"phone_number_separated": "phone_number", "phone_number_contiguous": "phone_number", "account_number_dashed": "account_number", "long_digit_run": "account_number"}
    each = [pii.named_spans(F.col("text"), k, "category", own.get(k, k), "text") for k in PII]
    return pii.redact_spans(docs.withColumn("items", F.concat(*each)), "text", "items")


@query()
def redact_spans_full(spark, sf):
    r = F.col("redaction")
    total = F.aggregate(r["applied"], F.lit(0), lambda n, a: n + a["count"])
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(r["applied"], lambda a: a["category"]))), ",")
    return redacted(spark, sf).select("doc_id", total.alias("items_redacted"), kinds.alias("categories"), F.size(r["unmatched"]).alias("n_unmatched"), F.size(r["ambiguous"]).alias("n_ambiguous"), F.sha2(r["text"], 256).alias("digest"))


@query("SELECT doc_id, doc_id % 3 <> 0 AND (doc_id % 3 <> 1 OR length(trim(text)) < 2) AS from_source FROM documents")
def built_from_source(spark, sf):
    """Redacted texts; every third has words of its own at the end, and of another third the whole comes twice."""
    own, red = F.col("doc_id") % 3, F.col("redaction.text")
    said = F.when(own == 0, F.concat(red, F.lit(" [EMAIL] words of nobody"))).when((own == 1) & (F.length(F.trim("text")) >= 2), F.concat(red, F.lit(" [EMAIL] "), F.col("text"))).otherwise(red)
    return redacted(spark, sf).select("doc_id", pii.built_from_source(F.col("text"), said).alias("from_source"))


@query(rf"""
WITH r AS (SELECT lang, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS t FROM documents)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE regexp_matches(t, '[0-9]{{11,}}')) AS n_leaking FROM r GROUP BY lang
""")
def residual_leak_gate(spark, sf):
    docs = table(spark, sf, "documents").withColumn("text", without_emails(F.col("text")))
    clean, leaking = pii.gate(docs, "text", [*RUN_KINDS, "email"])
    both = clean.select("lang", F.lit(0).alias("leak")).union(leaking.select("lang", F.lit(1)))
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.sum("leak").alias("n_leaking"))


@query("""
SELECT lang, 'CHUNK_' || row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS chunk_id, doc_id AS document_id, CASE WHEN regexp_matches(text, '[0-9]|@') THEN 0 ELSE length(text) END AS n_chars FROM documents
""")
def flagship_redact_gate_chunk(spark, sf):
    """Redact, drop documents that still leak (none does), number the rest as chunks of their language; n_chars where nothing can be redacted, else 0."""
    n = F.when(F.col("text").rlike("[0-9]|@"), 0).otherwise(F.length("redaction.text")).cast("long")
    docs = redacted(spark, sf).select("doc_id", "lang", F.col("redaction.text").alias("text"), n.alias("n_chars"))
    clean, _ = pii.gate(docs, "text")
    rows = clean.select("lang", "doc_id", "n_chars").withColumns({"pos": F.col("doc_id"), "page": F.lit(1)})  # texts are not numbered along
    chunks = pages.number_chunks(rows, "lang", "pos", "doc_id", "page", "n_chars")
    return chunks.select("lang", "chunk_id", "document_id", F.col("text").alias("n_chars"))


@query("""
WITH p AS (SELECT conv_id, turn + 1 AS page, text || ' a' || conv_id || '.' || turn || '@b.co, a' || conv_id || '.' || turn || '@b.co' AS t, conv_id % 13 = 0 AND turn = 1 AS leak FROM conversations)
SELECT conv_id, CASE WHEN conv_id % 17 = 0 THEN 'status' WHEN bool_or(leak) THEN 'leak' ELSE 'ok' END AS outcome,
  CASE WHEN conv_id % 17 <> 0 AND bool_or(leak) THEN '2' END AS pages, CASE WHEN conv_id % 17 <> 0 AND NOT bool_or(leak) THEN 2 * count(*) ELSE 0 END AS items_redacted,
  CASE WHEN conv_id % 17 <> 0 AND NOT bool_or(leak) THEN sha256(string_agg('<<<PAGE page=' || page || '>>>' || chr(10) || regexp_replace(t, 'a[0-9.]+@b.co', '[EMAIL]', 'g'), chr(10) ORDER BY page) || chr(10)) END AS digest
FROM p GROUP BY conv_id
""")
def redact_documents(spark, sf):
    """Pages with an address twice; of every thirteenth conversation one page's address is not listed, and all of its pages are refused."""
    address = F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("."), (F.col("page") - 1).cast("string"), F.lit("@b.co"))
    rows = turns(spark, sf).withColumn("text", F.concat_ws("", "text", F.lit(" "), address, F.lit(", "), address))
    item = F.array(F.struct(address.alias("text"), F.lit("email").alias("category")))
    rows = rows.withColumn("items", F.when((F.col("conv_id") % 13 == 0) & (F.col("page") == 2), F.slice(item, 1, 0)).otherwise(item))
    state = F.when(F.col("conv_id") % 17 == 0, "disagreed_pending_review").when(F.col("conv_id") % 2 == 0, "agreed").otherwise("disagreed_resolved")
    docs = rows.select("conv_id").distinct().withColumn("cross_validation_status", state)
    good, refused = pii.redact_documents(rows, docs, "conv_id", "page", "text", "items")
    none = lambda kind: F.lit(None).cast(kind)
    fit = good.select("conv_id", F.lit("ok").alias("outcome"), none("string").alias("pages"), "items_redacted", F.sha2("redacted_text", 256).alias("digest"))
    return fit.union(refused.select("conv_id", "error", F.array_join("pages", ","), F.lit(0).cast("long"), none("string")))


@query(r"""
WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' "' || name || '" ' WHEN 1 THEN '“' || name || '”' WHEN 2 THEN name || chr(10) || '  ' || name ELSE '０１２３４５６７８９－．' || name END AS v
  FROM (SELECT doc_id, source || ' ' || lang AS name FROM documents))
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trim(v, ' "') WHEN 1 THEN trim(v, '“”') WHEN 2 THEN regexp_replace(v, '\s+', ' ', 'g') ELSE translate(v, '０１２３４５６７８９－．', '0123456789-.') END AS normal FROM s
""")
def width_fold_normalize(spark, sf):
    name = F.concat_ws(" ", "source", "lang")
    kind = F.col("doc_id") % 4
    v = F.when(kind == 0, F.concat(F.lit(' "'), name, F.lit('" '))).when(kind == 1, F.concat(F.lit("“"), name, F.lit("”"))).when(kind == 2, F.concat(name, F.lit("\n  "), name)).otherwise(F.concat(F.lit("０１２３４５６７８９－．"), name))
    return table(spark, sf, "documents").select("doc_id", tx.normal_phrase(tx.fold_widths(v)).alias("normal"))


def readings(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    b = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).when(F.col("doc_id") % 7 == 1, F.concat(F.lit("  "), F.col("text"))).otherwise(F.col("text"))
    verdict = F.when(F.col("doc_id") % 3 == 0, "AGREE").when(F.col("doc_id") % 3 == 1, "I DISAGREE, not AGREE").otherwise("unsure")
    got = docs.select((F.floor(F.col("doc_id") / 5)).cast("long").alias("document_id"), (F.col("doc_id") % 5 + 1).alias("page"), "doc_id", F.col("text").alias("reading_a"), b.alias("reading_b"), verdict.alias("verdict"))
    return got.withColumn("agreement", pages.compare_readings(F.col("reading_a"), F.col("reading_b"), F.col("verdict")))


DUAL = """
WITH r AS (SELECT doc_id // 5 AS document_id, doc_id % 5 + 1 AS page, doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'disagreed' ELSE 'agreed' END AS agreement, text FROM documents)
"""


@query(DUAL + """
SELECT document_id, count(*) AS pages, count(*) FILTER (WHERE agreement = 'disagreed') AS n_disagreed,
  coalesce(string_agg(CASE WHEN agreement = 'disagreed' THEN page END::VARCHAR, ',' ORDER BY page), '') AS disagreed_pages,
  CASE WHEN bool_or(agreement = 'disagreed') THEN 'failed' ELSE 'completed' END AS ocr_status FROM r GROUP BY document_id
""")
def dual_read_agreement(spark, sf):
    got = pages.ocr_rollup(readings(spark, sf), "document_id", "page", "agreement")
    return got.select("document_id", "pages", "n_disagreed", F.array_join("disagreed_pages", ",").alias("disagreed_pages"), "ocr_status")


VERDICTS = ["AGREE", "agree.", "DISAGREE", "They DISAGREE; not AGREE", "unclear", "", "no AGREEMENT", "MISAGREE", "AGREED", "AGREES", "they agree: DISAGREEMENT is nowhere"]


@query("SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'agreed' WHEN 1 THEN 'agreed' WHEN 10 THEN 'agreed' ELSE 'disagreed' END AS verdict, CASE WHEN doc_id % 3 = 1 THEN 'clear' ELSE 'flagged' END AS scan FROM documents")
def verdict_parse(spark, sf):
    said = F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("doc_id") % 11 + 1).cast("int"))
    scan = F.element_at(F.array(*map(F.lit, ["CLEAR but FLAGGED", "clear", "???"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", pages.parse_verdict(said).alias("verdict"), pages.parse_content_scan(scan).alias("scan"))


@query(DUAL + """
SELECT document_id, count(*) FILTER (WHERE agreement = 'disagreed' AND page = 5) AS n_open,
  CAST(sum(length(CASE WHEN agreement = 'agreed' OR page IN (1, 2) THEN text WHEN page IN (3, 4) THEN text || ' x' END)) AS BIGINT) AS n_chars FROM r GROUP BY document_id
""")
def resolve_disagreement(spark, sf):
    """Pages 1 and 2 are decided for the first reading, 3 and 4 for the second, page 5 stays open."""
    rows = readings(spark, sf)
    decided = rows.filter((F.col("agreement") == "disagreed") & (F.col("page") < 5)).select("document_id", "page", F.when(F.col("page") < 3, "reading_a").otherwise("reading_b").alias("chosen_reading"))
    got = pages.resolve(rows, decided, ["document_id", "page"])
    return got.groupBy("document_id").agg(F.count_if("unresolved").alias("n_open"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""
WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))) AS ls FROM documents),
p AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM benchmark)
SELECT doc_id, item_id, CAST(coalesce(list_position(list_transform(ls, lambda l: contains(l, s)), true), 0) AS BIGINT) AS line FROM n JOIN p ON contains(t, s)
""")
def forbidden_phrase_hits(spark, sf):
    return reports.phrase_hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "text", "item_id", "text").withColumn("line", F.coalesce("line", F.lit(0).cast("long")))


@query("""
WITH c AS (SELECT conv_id, list(DISTINCT turn + 1) AS ts FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, list(DISTINCT turn + 2) AS ss FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id)
SELECT c.conv_id, CAST(len(list_filter(ts, lambda x: NOT list_contains(coalesce(ss, []), x))) AS INTEGER) AS n_orphaned, CAST(len(list_filter(coalesce(ss, []), lambda x: NOT list_contains(ts, x))) AS INTEGER) AS n_unused
FROM c LEFT JOIN s USING (conv_id)
""")
def evidence_tags(spark, sf):
    """Reports whose tags are one off their sidecars; every third has none."""
    rows = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"))
    text = rows.groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("see [E"), F.col("n").cast("string"), F.lit("]")))).alias("text"))
    side = rows.filter(F.col("conv_id") % 3 != 0).groupBy("conv_id").agg(F.collect_set(F.col("n") + 1).alias("cited"))
    got = text.join(side, "conv_id", "left").withColumn("check", reports.tag_check(F.col("text"), F.col("cited")))
    return got.select("conv_id", F.size("check.orphaned").alias("n_orphaned"), F.size("check.unused").alias("n_unused"))


@query("""
SELECT conv_id, string_agg('## ' || role || chr(10) || 'first [E' || (2 * turn + 1) || '], then [E' || (2 * turn + 2) || '].', chr(10) ORDER BY turn) AS report FROM conversations GROUP BY conv_id
""")
def render_citations(spark, sf):
    """Each turn is a section with two citations; numbers run on over the sections."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\nfirst {{E}}, then {{E}}.")).alias("content"))
    need = reports.placeholders(F.col("content"))
    upto = F.sum(need).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = rows.withColumn("first", upto - need + 1).withColumn("content", reports.fill_citations(F.col("content"), F.col("first")))
    parts = F.array_sort(F.collect_list(F.struct("turn", "content")))
    return filled.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("report"))


@query("SELECT conv_id, count(*) = 3 AND conv_id % 4 <> 0 AS exact, count(*) >= 3 AND conv_id % 4 <> 0 AS subsequence FROM conversations GROUP BY conv_id")
def template_conformance(spark, sf):
    """Headings 1., 2., 3. ... of each conversation against a template of three; every fourth starts wrongly."""
    head = F.concat(F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), "x").otherwise((F.col("turn") + 1).cast("string")), F.lit(". part"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", head.alias("head"))
    got = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "head"))), lambda x: x["head"]).alias("heads"))
    want = [r"^1\.", r"^2\.", r"^3\."]
    return got.select("conv_id", reports.conforms(F.col("heads"), want).alias("exact"), reports.conforms(F.col("heads"), want, extra=True).alias("subsequence"))


@query("SELECT conv_id, turn + 1 AS section, role AS heading, CAST(2 AS BIGINT) AS n_lines, 'line one' || chr(10) || 'line two' AS body FROM conversations")
def markdown_sections(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("## "), F.col("role"), F.lit("\nline one\n\nline two")).alias("t"))
    text = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return reports.sections(text.withColumn("text", F.concat(F.lit("preface\n"), F.col("text"))), "conv_id", "text").select("conv_id", "section", "heading", "n_lines", "body")


@query("""
WITH f AS (SELECT page_id, regexp_extract(url, '([^/?#]*)([?#].*)?$', 1) AS name, url FROM pages)
SELECT page_id, CASE WHEN url LIKE '%casino%' OR name LIKE '%7' THEN 'ground_truth' ELSE 'raw' END AS classification,
  CASE lower(regexp_extract(name, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'text' ELSE 'other' END AS file_format FROM f
""".replace("\\\\", "\\"))
def classify_files(spark, sf):
    name = F.regexp_extract("url", r"([^/?#]*)([?#].*)?$", 1)
    files = table(spark, sf, "pages").select("page_id", F.concat(F.when(F.contains("url", F.lit("casino")), "casino ").otherwise(""), name).alias("name"))
    return cases.classify_files(files, "name", ["*casino*", "*7"]).select("page_id", "classification", "file_format")


@query("""
SELECT url, CASE WHEN page_id % 5 = 0 THEN 'GT_' ELSE 'DOC_' END || lpad(CAST(row_number() OVER (PARTITION BY page_id % 10, page_id % 5 = 0 ORDER BY url, page_id) AS VARCHAR), 3, '0') AS document_id FROM pages
""")
def doc_id_assignment(spark, sf):
    """Ten cases of pages; ids follow the file names."""
    files = table(spark, sf, "pages").select("url", (F.col("page_id") % 10).alias("case_id"), F.when(F.col("page_id") % 5 == 0, "ground_truth").otherwise("raw").alias("classification"), F.struct("url", "page_id").alias("name"))
    return cases.assign_ids(files, "case_id", "name").select("url", "document_id")


@query("""
WITH p AS (SELECT conv_id, turn + 1 AS page FROM conversations)
SELECT CASE WHEN page BETWEEN 1 AND 2 THEN 'raw' WHEN page BETWEEN 4 AND 5 THEN 'ground_truth' ELSE 'uncovered' END AS tier, count(*) AS n FROM p GROUP BY 1
""")
def split_ranges(spark, sf):
    specs = spark.createDataFrame([("a.pdf:1-2=raw",), ("a.pdf:4-5=ground_truth",), ("a.pdf:9-8=raw",), ("a.pdf",)], "spec string")
    ranges = specs.select(cases.parse_split(F.col("spec")).alias("s")).select("s.*").filter("error IS NULL").select("start", "end", "tier")
    inside, outside = cases.split_pages(turns(spark, sf), ranges, "page")
    return inside.select("tier").union(outside.select(F.lit("uncovered"))).groupBy("tier").agg(F.count("*").alias("n"))


REVIEW = "CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'approved' ELSE 'rejected' END"


def ledger(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    status = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("quality") == 1, "approved").otherwise("rejected")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("status", status)


@query(f"""
SELECT source, count(*) AS n, count(*) FILTER (WHERE {REVIEW} = 'pending') AS n_pending, count(*) FILTER (WHERE {REVIEW} = 'rejected') AS n_rejected, bool_and({REVIEW} = 'approved') AS clear
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
""")
def ledger_clear(spark, sf):
    rows = ledger(spark, sf)
    got = cases.ledger_gate(rows, rows.select("source"), "source", "doc_id", "status", "approved", absent_clear=False)
    return got.select("source", "n", F.col("pending").alias("n_pending"), F.col("rejected").alias("n_rejected"), "clear")


@query(f"SELECT source, doc_id, {REVIEW} AS why FROM documents d LEFT JOIN labels l USING (doc_id) WHERE {REVIEW} <> 'approved'")
def ledger_waits(spark, sf):
    return cases.held_up_by(ledger(spark, sf), "source", "doc_id", "status")


@query("SELECT lang, bool_and(doc_id % 2 = 0) AND bool_or(doc_id % 2 = 0) IS TRUE AS clear FROM (SELECT DISTINCT lang FROM documents) x LEFT JOIN (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE lang <> 'en') y USING (lang) GROUP BY lang HAVING lang <> 'en' UNION ALL SELECT 'en', true")
def conflicts_clear(spark, sf):
    """Conflicts of languages: one without any is clear."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id").filter("lang <> 'en'").withColumn("verdict", F.when(F.col("doc_id") % 2 == 0, "resolved").otherwise("pending"))
    return cases.ledger_gate(rows, docs, "lang", "doc_id", "verdict", "resolved", absent_clear=True).select("lang", "clear")


@query("""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'class differs' END AS problem FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NULL OR (l.quality = 1) <> (d.doc_id % 2 = 0)
""")
def ledger_drift(spark, sf):
    plan = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "raw").otherwise("ground_truth").alias("classification"))
    known = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "raw").otherwise("ground_truth").alias("classification"))
    return cases.ledger_drift(plan, known, "doc_id")


@query("SELECT l_orderkey AS topic, count(DISTINCT l_returnflag) AS n_values, count(DISTINCT l_suppkey) AS n_sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def conflicts_by_topic(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("topic"), "l_suppkey", "l_returnflag")
    return reports.conflicts(rows, ["topic"], "l_suppkey", "l_returnflag")


def codes(spark) -> DataFrame:
    return spark.createDataFrame(sorted(FREQUENCY.items()), "code string, frequency string")


@query("WITH f(code, frequency) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(FREQUENCY.items())) + """)
SELECT frequency, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events JOIN f ON code = 'R' || lpad(CAST(CASE WHEN user_id % 23 = 22 THEN 99 ELSE user_id % 23 END AS VARCHAR), 2, '0') GROUP BY frequency
""")
def taxonomy_rollup(spark, sf):
    n = F.when(F.col("user_id") % 23 == 22, 99).otherwise(F.col("user_id") % 23)
    rows = table(spark, sf, "events").select(F.concat(F.lit("R"), F.lpad(n.cast("string"), 2, "0")).alias("code"), "value")
    return rows.join(codes(spark), "code").groupBy("frequency").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def log(spark, sf) -> DataFrame:
    status = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("event_type"))
    return table(spark, sf, "events").select("user_id", (F.col("event_id") % 3).alias("stage"), status.alias("status"), "event_id", "event_type").filter("status IS NOT NULL OR event_type = 'signup'")


LOG = "WITH e AS (SELECT user_id, event_id % 3 AS stage, event_id, event_type, CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'passed' WHEN 'error' THEN 'failed' END AS status FROM events)\n"
FOLD = """SELECT user_id, stage, arg_max(status, event_id) AS status, count(*) FILTER (WHERE status = 'in_progress') AS attempt_count,
  min(CASE WHEN status = 'in_progress' THEN event_id END) AS started_at, max(CASE WHEN status IN ('passed', 'failed') THEN event_id END) AS completed_at
FROM e WHERE status IS NOT NULL GROUP BY user_id, stage"""


@query(LOG + FOLD)
def run_state_fold(spark, sf):
    return cases.fold_run_state(log(spark, sf).filter("status IS NOT NULL"), ["user_id", "stage"], "status", "event_id")


@query(LOG + "SELECT user_id, arg_max(stage, event_id) AS last_passed, max(event_id) AS at FROM e WHERE status = 'passed' GROUP BY user_id")
def last_passed_stage(spark, sf):
    return cases.last_passed(log(spark, sf), "user_id", "stage", "status", "event_id")


@query(LOG + """, w AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e WHERE event_type IN ('signup', 'purchase'))
SELECT r.user_id, r.event_id, max(o.event_id) AS waited_at FROM w r JOIN w o ON o.user_id = r.user_id AND o.event_type = 'signup' AND o.event_id < r.event_id AND o.s = r.s + 1 WHERE r.event_type = 'purchase' GROUP BY 1, 2""")
def human_wait_pairing(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return cases.pair_waits(rows, ["user_id"], "event_type", "event_id", "signup", "purchase").select("user_id", "event_id", "waited_at")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def lock_first_writer(spark, sf):
    return cases.first_writer(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query(LOG + ", f AS (" + FOLD + """), r AS (SELECT d.doc_id AS user_id, d.lang, count(*) FILTER (WHERE l.quality = 0) AS rejected, count(*) FILTER (WHERE l.quality IS NULL AND d.lang = 'de') AS pending FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2),
b AS (SELECT conv_id AS user_id, count(*) FILTER (WHERE turn >= 6) AS blocked FROM conversations GROUP BY 1),
c AS (SELECT o_custkey AS user_id, count(*) AS conflicts FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '1%' GROUP BY 1),
x AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'signup' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM e WHERE event_type IN ('signup', 'purchase')),
w AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') - count(*) FILTER (WHERE m) AS waits FROM (SELECT *, event_type = 'purchase' AND EXISTS (SELECT 1 FROM x o WHERE o.user_id = x.user_id AND o.event_type = 'signup' AND o.event_id < x.event_id AND o.s = x.s + 1) AS m FROM x) GROUP BY 1),
h AS (SELECT f.*, CASE WHEN rejected > 0 OR pending > 0 THEN 'D2' WHEN blocked > 0 THEN 'P8' WHEN conflicts > 0 THEN 'P6' WHEN waits > 8 THEN 'P7' WHEN f.status = 'failed' AND attempt_count >= 3 THEN 'P9' END AS rule FROM f LEFT JOIN r USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN w USING (user_id))
SELECT user_id, stage, CASE WHEN rule IS NULL THEN status WHEN rule = 'P9' THEN 'halted' ELSE 'paused' END AS status, rule FROM h
""")
def stage_status_ladder(spark, sf):
    """Stages of users, held up by the review of the document of their number, disagreeing pages, open conflicts, and people's inputs beyond eight that are waited for."""
    state = cases.fold_run_state(log(spark, sf).filter("status IS NOT NULL"), ["user_id", "stage"], "status", "event_id")
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    review = docs.groupBy(F.col("doc_id").alias("user_id")).agg(F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("quality").isNull() & (F.col("lang") == "de")).alias("pending"))
    blocked = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.count_if(F.col("turn") >= 6).alias("blocked"))
    conflicts = table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_orderpriority LIKE '1%'").groupBy(F.col("o_custkey").cast("long").alias("user_id")).agg(F.count("*").alias("conflicts"))
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    received = cases.pair_waits(rows, ["user_id"], "event_type", "event_id", "signup", "purchase").groupBy("user_id").agg(F.count("*").alias("n"))
    asked = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("asked"))
    waits = asked.join(received, "user_id", "left").select("user_id", (F.col("asked") - F.coalesce("n", F.lit(0)) - 8).alias("waits"))
    for other in (review, blocked, conflicts, waits):
        state = state.join(other, "user_id", "left")
    return state.select("user_id", "stage", cases.stage_status("status", "attempt_count", "rejected", "pending", "blocked", "conflicts", "waits").alias("x")).select("user_id", "stage", "x.status", "x.rule")


@query("SELECT lang, count(*) AS compared, CAST(sum(CASE WHEN (n_chars > 800) = (quality = 1) THEN 1 ELSE 0 END) AS BIGINT) AS matched, round(avg(CASE WHEN (n_chars > 800) = (quality = 1) THEN 1 ELSE 0 END), 2) AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def field_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    predicted = docs.select("doc_id", (F.col("n_chars") > 800).cast("int").alias("predicted"))
    actual = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("actual")).join(docs.select("doc_id", "lang"), "doc_id")
    return reports.field_accuracy(predicted, actual, ["doc_id"], ["lang"])


@query("SELECT source, round(avg(quality), 6) AS mean, count(quality) AS n, count(*) - count(quality) AS na_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def rate_stats(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(*reports.rate_stat(F.col("quality")))


@query("SELECT lang, count(*) FILTER (WHERE r = 0) AS poor, count(*) FILTER (WHERE r = 1) AS fair, count(*) FILTER (WHERE r = 2) AS good, count(*) FILTER (WHERE r = 3) AS excellent FROM (SELECT lang, 2 * quality + 1 - toxic AS r FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def rating_distribution(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    rating = F.element_at(F.array(*map(F.lit, ("poor", "fair", "good", "excellent"))), F.col("quality") * 2 + 2 - F.col("toxic"))
    return rows.groupBy("lang").agg(*reports.rating_counts(rating))


@query("""
WITH c AS (SELECT user_id, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, code) AS k FROM c)
SELECT user_id, coalesce(max(CASE WHEN code = 'purchase' AND k <= 3 THEN k END), 0) AS matched_rank FROM r GROUP BY user_id
""")
def top3_inclusion(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    top = reports.top_candidates(rows, ["user_id"], "code", "n")
    return top.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("code") == "purchase", F.col("rank").cast("long"))), F.lit(0).cast("long")).alias("matched_rank"))


@query("""
SELECT o_orderpriority, count(*) AS n_refs, count(l_orderkey) AS n_matched, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1 WHERE o_orderstatus IN ('F', 'P') GROUP BY 1
""")
def policy_clause_left_join(spark, sf):
    """Reasons with a reference to a clause by document and number; a reference may find nothing."""
    refs = table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", (F.col("o_custkey") % 7 + 1).alias("clause"), "o_orderpriority")
    clauses = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    got = refs.join(clauses, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("clause") == F.col("l_linenumber")), "left")
    return got.groupBy("o_orderpriority").agg(F.count("*").alias("n_refs"), F.count("l_orderkey").alias("n_matched"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""
WITH q AS (SELECT item_id, text AS quote FROM benchmark), h AS (SELECT doc_id, item_id, instr(text, quote) - 1 AS a, length(quote) AS n FROM documents JOIN q ON contains(text, quote))
SELECT doc_id, item_id, CAST(a AS BIGINT) AS start, CAST(a + n AS BIGINT) AS stop, a < 200 AND 100 < a + n AS review FROM h
""")
def quote_in_page(spark, sf):
    """Quotes by their place in a page, and whether they touch its uncertain region of characters 100 to 200."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    got = reports.containing(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", quotes, "quote")
    a = F.call_function("instr", F.col("text"), F.col("quote")).cast("long") - 1
    got = got.select("doc_id", "item_id", a.alias("start"), (a + F.length("quote")).alias("stop"))
    return got.withColumn("review", (F.col("start") < 200) & (F.col("stop") > 100))


SCHEMA = {
    "type": "object", "required": ["k", "kind", "items"],
    "properties": {
        "k": {"type": "integer", "minimum": 10, "maximum": 89}, "kind": {"enum": ["view", "click", "purchase", "signup"]},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^E[0-9]+$"}}}},
    },
    "if": {"properties": {"kind": {"const": "signup"}}}, "then": {"required": ["note"]},
}


def contracts(spark, sf) -> DataFrame:
    e = F.col("event_id")
    items = F.when(e % 11 == 0, "[]").when(e % 7 == 0, F.concat(F.lit('[{"id":"E'), e.cast("string"), F.lit('"},{"id":"x"}]'))).otherwise(F.concat(F.lit('[{"id":"E'), e.cast("string"), F.lit('"}]')))
    note = F.when(e % 2 == 0, ',"note":null').otherwise("")
    body = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"kind":"'), F.col("event_type"), F.lit('","items":'), items, note, F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.when(e % 101 == 0, F.lit("{broken")).otherwise(body).alias("json"))


CHECKED = """
WITH b AS (SELECT event_id, event_id % 101 = 0 AS broken, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events), c AS (
SELECT event_id, CASE WHEN broken THEN ['$: json'] ELSE list_sort(list_filter([
  CASE WHEN event_id % 11 = 0 THEN '$.items: minItems' END, CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN '$.items[1].id: pattern' END,
  CASE WHEN k > 89 THEN '$.k: maximum' END, CASE WHEN k < 10 THEN '$.k: minimum' END, CASE WHEN event_type = 'error' THEN '$.kind: enum' END,
  CASE WHEN event_type = 'signup' AND event_id % 2 <> 0 THEN '$: required note' END], lambda x: x IS NOT NULL)) END AS errors FROM b)
"""


@query(CHECKED + "SELECT event_id, array_to_string(errors, '; ') AS errors FROM c WHERE len(errors) > 0")
def schema_errors(spark, sf):
    got = contracts(spark, sf).select("event_id", rules.errors(F.try_parse_json("json"), SCHEMA).alias("errors"))
    return got.filter(F.size("errors") > 0).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query(CHECKED + "SELECT CASE WHEN event_id % 13 = 0 THEN 'SKIP' WHEN len(errors) > 0 THEN 'FAIL' ELSE 'PASS' END AS result, count(*) AS n FROM c GROUP BY 1")
def schema_result_counts(spark, sf):
    """Every thirteenth contract has a name without a schema."""
    found = rules.errors(F.try_parse_json("json"), SCHEMA)
    result = F.when(F.col("event_id") % 13 == 0, "SKIP").when(F.size(found) > 0, "FAIL").otherwise("PASS")
    return contracts(spark, sf).groupBy(result.alias("result")).agg(F.count("*").alias("n"))


FILES = [("critic_result_v2.json", "critic_result"), ("draft_report_v1.evidence.json", "evidence_sidecar"), ("normalized_policy_clause_DOC_004.json", "normalized_policy_clause"), ("_run_state.json", "run_state"), ("evaluation_result_CASE_021_v1.json", "evaluation_result"), ("unknown.json", None)]


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{s}.schema.json'" for i, (_, s) in enumerate(FILES) if s) + " END AS schema_name FROM events")
def schema_name_for(spark, sf):
    name = F.element_at(F.array(*(F.lit(f) for f, _ in FILES)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", tx.schema_name(name, SCHEMAS).alias("schema_name"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 'agreed' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS c_acctbal, c_name FROM customer")
def manifest_patch(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_name")
    patches = rows.filter(F.col("c_custkey") % 10 == 3).select("c_custkey", F.lit("agreed").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return cases.patch(rows, patches, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'deferred_poc' ELSE c_mktsegment END AS mode FROM customer")
def backfill_default(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("mode"))
    return cases.backfill(rows, {"mode": "deferred_poc"})


@query("SELECT 'CASE_' || lpad(CAST(max(c_custkey) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(max(c_custkey) + 1 AS VARCHAR))) AS INTEGER), '0') AS case_id FROM customer")
def next_case_id(spark, sf):
    ids = table(spark, sf, "customer").select(F.concat(F.lit("CASE_"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("id"))
    return cases.next_case(ids.union(spark.createDataFrame([("CASE_x",)], "id string")), "id")


@query("SELECT o_orderkey, 'CASE_9' AS case_id FROM orders WHERE o_custkey = 7")
def fork_case(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("CASE_"), F.col("o_custkey").cast("string")).alias("case_id"))
    return cases.fork(rows, "CASE_7", "CASE_9")


@query(DUAL + """
SELECT s AS scenario, count(*) AS n_pages, count(*) FILTER (WHERE s = 'unresolved') AS n_open, CAST(coalesce(sum(CASE s WHEN 'reading_a' THEN length(text) WHEN 'reading_b' THEN length(text) + 2 END), 0) AS BIGINT) AS n_chars
FROM r, (VALUES ('reading_a'), ('reading_b'), ('unresolved')) v(s) WHERE agreement = 'disagreed' GROUP BY s
""")
def scenario_matrix(spark, sf):
    blocked = cases.scenarios(readings(spark, sf).filter("agreement = 'disagreed'"))
    text = F.when(F.col("scenario") == "reading_a", F.col("reading_a")).when(F.col("scenario") == "reading_b", F.col("reading_b"))
    return blocked.groupBy("scenario").agg(F.count("*").alias("n_pages"), F.count_if(text.isNull()).alias("n_open"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))


@query(f"""
WITH g AS (SELECT source, bool_and({REVIEW} <> 'rejected') AS clear FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT d.lang, count(*) AS n_documents, count(DISTINCT d.source) AS n_sources, CAST(sum(d.n_chars) AS BIGINT) AS n_chars, count(l.doc_id) AS n_reviewed, CAST(coalesce(sum(l.toxic), 0) AS BIGINT) AS n_toxic, count(*) FILTER (WHERE g.clear) AS n_clear
FROM documents d LEFT JOIN labels l USING (doc_id) JOIN g ON g.source = d.source GROUP BY d.lang
""")
def screening_report(spark, sf):
    """A summary of each language over documents, reviews and the gate of their source."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf, "labels")
    rows = docs.join(labels.withColumn("reviewed", F.lit(1)), "doc_id", "left")
    gate = rows.groupBy("source").agg(F.every(F.coalesce(F.col("quality") == 1, F.lit(True))).alias("clear"))
    return rows.join(gate, "source").groupBy("lang").agg(
        F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_sources"), F.sum("n_chars").alias("n_chars"), F.count("reviewed").alias("n_reviewed"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"), F.count_if("clear").alias("n_clear")
    )


@query("SELECT run, count(*) AS n FROM (SELECT CASE WHEN event_id % 6 = 0 THEN 'not_started' WHEN event_id % 6 = 1 THEN 'finished' WHEN event_id % 6 = 2 THEN 'crashed' WHEN event_id % 6 = 3 THEN 'stalled' WHEN event_id % 6 = 4 THEN 'running' ELSE 'ended_unknown' END AS run FROM events) GROUP BY run")
def run_status(spark, sf):
    k = F.col("event_id") % 6
    status = cases.run_status(k > 0, F.when(k == 1, 0).when(k == 2, 3), k.isin(3, 4), F.when(k == 3, 500).otherwise(5))
    return table(spark, sf, "events").groupBy(status.alias("run")).agg(F.count("*").alias("n"))


@query("SELECT category, placeholder, 1 AS n FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PLACEHOLDERS.items()) + ", ('strange', '[OTHER_PII]')) v(category, placeholder)")
def category_placeholders(spark, sf):
    rows = spark.createDataFrame([(c,) for c in [*PLACEHOLDERS, "strange"]], "category string")
    return rows.select("category", pii.placeholder(F.col("category")).alias("placeholder"), F.lit(1).alias("n"))


@query("""
WITH d AS (SELECT user_id AS f, event_id, ts, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'pending' END AS status, event_id % 3 <> 0 AS signed FROM events),
g AS (SELECT f, arg_max(CASE WHEN status = 'rejected' THEN 'rejected:why' ELSE status END, (ts, event_id)) AS s FROM d WHERE status = 'pending' OR signed GROUP BY f)
SELECT CAST(c_custkey AS BIGINT) AS file, coalesce(split_part(s, ':', 1), 'pending') AS review_status, nullif(split_part(s, ':', 2), '') AS rejection_reason FROM customer LEFT JOIN g ON f = c_custkey
""")
def ledger_decisions(spark, sf):
    """The review log of the files on the roster: unsigned approvals and rejections without a reason change nothing."""
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("pending")
    signed = F.col("event_id") % 3 != 0
    log = table(spark, sf, "events").select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("at"), status.alias("status"), F.when(signed, "kim").alias("reviewer"), F.when(signed, "why").alias("reason"))
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("file"))
    return reviews.decide_ledger(entries, log, ["file"], "at")[0].select("file", "review_status", "rejection_reason")


@query("""
WITH c AS (SELECT l_orderkey AS topic, l_orderkey % 50 AS case_id FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2),
n AS (SELECT case_id, topic, 'CONFLICT_' || row_number() OVER (PARTITION BY case_id ORDER BY topic) AS conflict_id FROM c),
v AS (SELECT *, CASE WHEN topic % 3 = 0 THEN 'resolved' WHEN topic % 3 = 1 AND topic % 2 = 0 THEN 'false_positive' ELSE 'pending' END AS verdict FROM n)
SELECT case_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'pending') AS n_pending, min(CASE WHEN verdict = 'pending' THEN conflict_id END) AS first_pending FROM v GROUP BY case_id
""")
def conflict_verdicts(spark, sf):
    """Conflicts of fifty cases, numbered, and the verdicts on them; one without a note leaves its conflict pending."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("topic")).agg(F.collect_list("l_linenumber").alias("sources")).withColumn("case_id", F.col("topic") % 50)
    got, _ = reviews.raise_conflicts(rows, "case_id", ["topic"], "sources")
    made = got.select("case_id", "topic", "conflict_id", "verdict")
    said = F.when(F.col("topic") % 3 == 0, "resolved").otherwise("false_positive")
    note = F.when((F.col("topic") % 3 == 0) | (F.col("topic") % 2 == 0), "seen")
    verdicts = made.filter("topic % 3 <> 2").select("case_id", "conflict_id", F.lit(1).alias("at"), said.alias("verdict"), note.alias("note"))
    settled, _ = reviews.settle_conflicts(made, verdicts, ["case_id", "conflict_id"], "at")
    waits = F.col("verdict") == "pending"
    return settled.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(waits).alias("n_pending"), F.min(F.when(waits, F.col("conflict_id"))).alias("first_pending"))


@query("""
SELECT event_id, CASE WHEN event_type <> 'view' THEN 'denied: stage' WHEN l.doc_id IS NULL OR quality = 0 THEN 'denied: review' ELSE 'allowed' END AS access
FROM events LEFT JOIN labels l ON l.doc_id = user_id
""")
def truth_access(spark, sf):
    """Requests for the answer key: only the evaluation gets it, and only where a valid review is complete."""
    found = table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.lit("v1").alias("version"), F.when(F.col("quality") == 0, F.array(F.lit("$: json"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    flags, _ = reviews.complete_reviews(found.select("case_id", "version"), found, "errors")
    asked = table(spark, sf, "events").select("event_id", F.col("user_id").alias("case_id"), F.lit("v1").alias("version"), F.when(F.col("event_type") == "view", "evaluation").otherwise(F.col("event_type")).alias("caller_stage"))
    return reviews.truth_access(asked, flags).select("event_id", "access")


@query("""
SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'expert_review_only' WHEN l.doc_id IS NULL THEN 'not_extracted' ELSE 'ok' END AS access, CASE WHEN l.toxic = 0 THEN length(d.text) ELSE 0 END AS n
FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def document_text_access(spark, sf):
    """Texts are read where they are redacted, and never from documents kept for experts."""
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    listed = docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "expert_review_only").alias("downstream_disposition"))
    got = reviews.document_texts(listed, docs.join(labels, "doc_id", "left_semi"), ["doc_id"], "text")
    return got.select("doc_id", "access", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"))


@query("""
WITH p AS (SELECT conv_id, count(*) AS pages, count(CASE WHEN conv_id % 5 = 0 THEN text END) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, pages, CASE WHEN conv_id % 4 = 0 THEN 'role' WHEN conv_id % 3 = 0 THEN 'signature' WHEN conv_id % 7 = 0 THEN 'status' WHEN texts > 0 THEN 'text' WHEN conv_id % 11 = 0 THEN 'contracts' ELSE 'ok' END AS outcome
FROM p
""")
def non_text_resolution(spark, sf):
    """People declare every conversation an image without text; the first rule that a declaration breaks refuses it."""
    c = F.col("conv_id")
    rows = turns(spark, sf).select("conv_id", F.when(c % 5 == 0, F.col("text")).alias("text_path"))
    ids = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    docs = ids.select("conv_id", F.when(c % 7 == 0, "agreed").otherwise("disagreed_pending_review").alias("cross_validation_status"))
    said = ids.select("conv_id", F.lit("kim").alias("verified_by"), F.when(c % 3 == 0, " ").otherwise("a photo").alias("note"), F.when(c % 4 == 0, "clerk").otherwise("의사").alias("reviewer_role"))
    good, refused = reviews.resolve_non_text(docs, rows, said, ids.filter(c % 11 == 0), "conv_id")
    outcome = good.select("conv_id", F.lit("ok").alias("outcome")).union(refused.select("conv_id", "error"))
    return outcome.join(ids, "conv_id").select("conv_id", F.col("n").alias("pages"), "outcome")


@query("""
SELECT conv_id, count(*) FILTER (WHERE contains(text, ' ')) AS items_redacted, string_agg(DISTINCT role, ',' ORDER BY role) AS categories, bool_or(turn = 5) AS review_required,
  string_agg('<<<PAGE page=' || (turn + 1) || '>>>' || chr(10) || text, chr(10) ORDER BY turn) || chr(10) AS redacted_text FROM conversations GROUP BY conv_id
""")
def redaction_rollup(spark, sf):
    """Pages of redacted text as a document, with what was redacted and whether a page warns."""
    warn = F.when(F.col("turn") == 5, F.array(F.lit("glued"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn") + 1, "text", F.contains("text", F.lit(" ")).cast("long").alias("items"), F.array("role").alias("categories"), warn.alias("warnings"))
    got = reviews.redaction_rollup(rows.toDF("conv_id", "page", "text", "items", "categories", "warnings"), "conv_id", "page", "text", "items", "categories", "warnings")
    return got.withColumn("categories", F.array_join("categories", ","))


@query("""
WITH s AS (SELECT user_id AS case_id, event_type, bool_or(event_id % 4 = 0) AS saved FROM events GROUP BY 1, 2)
SELECT case_id, count(*) FILTER (WHERE saved) + 1 AS step FROM s GROUP BY case_id
""")
def snapshot_steps(spark, sf):
    """The number of each user's next snapshot, by the stages that have one."""
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("case_id"), "event_type").agg(F.max(F.when(F.col("event_id") % 4 == 0, "path")).alias("path"))
    return reviews.next_snapshot(rows, "case_id", "path")


REASON_VERDICTS = "supported not_supported partially_supported insufficient_evidence".split()


@query("""
WITH v AS (SELECT o_orderkey, o_custkey % 4 AS k FROM orders WHERE o_custkey % 9 <> 0), p AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
o AS (SELECT * FROM v WHERE k IN (1, 2))
SELECT CASE k WHEN 1 THEN 'not_supported' ELSE 'partially_supported' END AS verdict, count(*) AS n, count(quantity) AS n_answered, CAST(round(sum(quantity), 2) AS DOUBLE) AS quantity FROM o LEFT JOIN p USING (o_orderkey) GROUP BY k
UNION ALL SELECT 'stray', count(*), 0, CAST(round(sum(quantity), 2) AS DOUBLE) FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
""")
def rebuttal_join(spark, sf):
    """Reasons, verdicts on them and answers: only reasons that do not hold are answered, other answers are strays."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    verdict = F.element_at(F.array(*map(F.lit, REASON_VERDICTS)), (F.col("o_custkey") % 4 + 1).cast("int"))
    judged = orders.filter(F.col("o_custkey") % 9 != 0).select("o_orderkey", verdict.alias("verdict"))
    points = table(spark, sf, "lineitem").filter(F.col("l_orderkey") % 5 != 0).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    got, stray = reviews.rebuttable(orders, judged, points, ["o_orderkey"])
    total = F.round(F.sum("quantity"), 2).alias("quantity")
    return got.groupBy("verdict").agg(F.count("*").alias("n"), F.count("quantity").alias("n_answered"), total).union(stray.agg(F.lit("stray"), F.count("*"), F.lit(0).cast("long"), total))


@query("""
SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'no conflict' WHEN event_id % 2 = 1 AND event_id % 3 <> 0 THEN 'stray conflict' WHEN event_id % 3 = 2 AND user_id % 4 = 0 THEN 'unknown conflict' END AS error FROM events
""")
def conflict_link_check(spark, sf):
    """Consistency checks against the conflict ledger of their case; every fourth case lacks its second conflict."""
    e, rows = F.col("event_id"), table(spark, sf, "events")
    checks = rows.select("event_id", F.col("user_id").alias("case_id"), F.when(e % 2 == 0, "inconsistent").otherwise("consistent").alias("result"), F.when(e % 3 != 0, F.concat(F.lit("CONFLICT_"), (e % 3).cast("string"))).alias("conflict_id"))
    ids = rows.select(F.col("user_id").alias("case_id")).distinct()
    ledger_rows = ids.select("case_id", F.explode(F.array(F.lit("CONFLICT_1"), F.lit("CONFLICT_2"))).alias("conflict_id")).filter("NOT (case_id % 4 = 0 AND conflict_id = 'CONFLICT_2')")
    return reviews.conflict_links(checks, ledger_rows, "case_id").select("event_id", "error")


@query("""
SELECT conv_id, CAST(sum(turn % 3) AS BIGINT) AS uncertain_region_count, avg(CASE WHEN turn % 2 = 0 THEN turn / 8 END) AS document_mean_confidence FROM conversations GROUP BY conv_id
""")
def uncertain_regions(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.when(F.col("turn") % 3 > 0, F.array_repeat(F.lit("x"), (F.col("turn") % 3).cast("int"))).alias("regions"), F.when(F.col("turn") % 2 == 0, F.col("turn") / 8).alias("confidence"))
    return reviews.uncertain_rollup(rows, "conv_id", "regions", "confidence")


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'shape' WHEN 3 THEN 'shape' END AS error,
  CASE event_id % 6 WHEN 4 THEN 'user ' || user_id || '=email;7=other_pii' WHEN 5 THEN '' END AS items FROM events
""")
def pii_reply_parse(spark, sf):
    """Replies of six kinds: bare text, broken JSON, two wrong shapes, spans after another brace, and an empty list."""
    kinds = [F.lit("none found"), F.lit('{"pii_items": [broken'), F.lit('{"pii_items": 3}'), F.lit('{"pii_items": [{"text": 5}]}')]
    spans = F.concat(F.lit('{see} {"pii_items": [{"text": "user '), F.col("user_id").cast("string"), F.lit('", "category": "email"}, {"text": "7", "category": "strange"}]} as {asked}'))
    reply = F.element_at(F.array(*kinds, spans, F.lit('{"pii_items": []}')), (F.col("event_id") % 6 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", reply.alias("reply")).select("event_id", replies.pii_items(F.col("reply")).alias("got"))
    items = F.array_join(F.transform("got.items", lambda i: F.concat_ws("=", i["text"], i["category"])), ";")
    return rows.select("event_id", F.col("got.error").alias("error"), items.alias("items"))


@query("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'invalid JSON' WHEN 2 THEN 'unknown type' END AS error, CASE event_id % 5 WHEN 3 THEN 'receipt' WHEN 4 THEN 'other' END AS predicted_document_type,
  CASE event_id % 5 WHEN 3 THEN 0.25 WHEN 4 THEN 0.5 END::DOUBLE AS confidence, CASE event_id % 5 WHEN 3 THEN 'sum' WHEN 4 THEN '' END AS quote FROM events
""")
def classification_reply_parse(spark, sf):
    kinds = ["a receipt", 'x {"a": 1} and {"b": 2}', '{"predicted_document_type": "poem"}', 'It is {"predicted_document_type": "receipt", "confidence": 0.25, "quote": "sum"}.', '{"predicted_document_type": "other"}']
    reply = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", reply.alias("reply")).select("event_id", replies.classification(F.col("reply")).alias("got"))
    return rows.select("event_id", "got.error", "got.predicted_document_type", "got.confidence", "got.quote")


@query("""
SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'open' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS disposition FROM documents LEFT JOIN labels l USING (doc_id)) GROUP BY 1
""")
def finding_dispositions(spark, sf):
    said = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("disposition"))
    return reviews.dispositions(table(spark, sf, "documents").select("doc_id"), said, ["doc_id"]).groupBy("disposition").agg(F.count("*").alias("n"))


@query(DUAL + """
SELECT doc_id, CASE WHEN agreement = 'agreed' THEN 'page_' || page || '.md' END AS text_path, CASE WHEN agreement = 'agreed' THEN 'high' ELSE 'low' END AS ocr_quality, CASE WHEN doc_id % 5 = 0 THEN 'embedded_text' ELSE 'dual_read' END AS extraction_method,
  CASE WHEN agreement = 'disagreed' THEN 'readings differ on page ' || page END AS review_reason FROM r
""")
def assembled_pages(spark, sf):
    rows = readings(spark, sf).withColumn("extraction_method", F.when(F.col("doc_id") % 5 == 0, "embedded_text"))
    got = pages.assembled(rows, "document_id", "page", "agreement", F.concat(F.lit("page_"), F.col("page").cast("string"), F.lit(".md")))
    return got.select("doc_id", "text_path", "ocr_quality", "extraction_method", "review_reason")


@query(DUAL + "SELECT document_id, min(page) AS page FROM r WHERE agreement = 'disagreed' GROUP BY document_id")
def first_disagreed_page(spark, sf):
    return pages.first_disagreed(readings(spark, sf), "document_id", "page", "agreement")


@query(DUAL + """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE 3 END AS a, CASE WHEN doc_id % 2 = 0 THEN length(text) + 2 ELSE 3 END AS b FROM r WHERE agreement = 'disagreed'
""")
def open_page_readings(spark, sf):
    """Pages in disagreement with both readings; of odd ones these are lost, and the stored text stands for them."""
    rows = readings(spark, sf)
    raw = rows.filter("doc_id % 2 = 0").select("document_id", "page", "reading_a", "reading_b")
    waits = rows.filter("agreement = 'disagreed'").select("doc_id", "document_id", "page", F.lit("old").alias("text"))
    got = pages.open_readings(waits, raw, ["document_id", "page"])
    return got.select("doc_id", F.length("reading_a").cast("long").alias("a"), F.length("reading_b").cast("long").alias("b"))


@query(DUAL + "SELECT count(*) AS blocked_pages, count(DISTINCT document_id) AS blocked_documents FROM r WHERE agreement = 'disagreed'")
def blocked_pages(spark, sf):
    """Blocked pages over all documents."""
    got = pages.ocr_rollup(readings(spark, sf), "document_id", "page", "agreement").filter("n_disagreed > 0")
    return got.agg(F.coalesce(F.sum(F.size("disagreed_pages")), F.lit(0)).alias("blocked_pages"), F.count("*").alias("blocked_documents"))


@query("""
SELECT CAST(conv_id AS VARCHAR) AS document, CASE WHEN conv_id % 7 = 0 THEN 'both' ELSE 'twice' END AS error FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 = 0 OR conv_id % 11 = 0
""")
def chunk_contradictions(spark, sf):
    """Of chunked documents some are excluded as well, and some exclusions come twice; a case with neither is an error of its own (tested)."""
    ids = turns(spark, sf).select(F.col("conv_id").cast("string").alias("document"), "conv_id").distinct()
    chunks = ids.filter("conv_id % 7 = 0 OR conv_id % 11 <> 0")
    excluded = ids.filter("conv_id % 7 = 0").union(ids.filter("conv_id % 11 = 0 AND conv_id % 7 <> 0")).union(ids.filter("conv_id % 11 = 0 AND conv_id % 7 <> 0"))
    return pages.covered(chunks, excluded, "document")


@query("SELECT conv_id, turn + 1 AS tag, CASE WHEN turn % 2 = 0 THEN role END AS quote FROM conversations")
def tagged_citations(spark, sf):
    """Each tag of a report with its citation; every second citation is missing."""
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    text = rows.groupBy("conv_id").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit("[E"), (F.col("turn") + 1).cast("string"), F.lit("]")))).alias("text"))
    known = rows.filter("turn % 2 = 0").select("conv_id", (F.col("turn") + 1).alias("tag"), F.col("role").alias("quote"))
    return reports.tagged(text, "conv_id", "text", known)


@query("SELECT conv_id, turn AS section, turn + 1 AS first FROM conversations")
def numbered_citations(spark, sf):
    """The first tag of each section, by the window that numbers references."""
    refs = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("section"), F.lit(0).alias("ref"))
    got = reports.number_citations(refs, "conv_id", ["section", "ref"])
    return got.select("conv_id", "section", F.regexp_extract("tag", r"\d+", 0).cast("long").alias("first"))


@query("SELECT conv_id, count(*) AS section_count, 2 * count(*) AS evidence_tag_count FROM conversations GROUP BY conv_id")
def draft_metadata(spark, sf):
    """Sections and tags of rendered reports."""
    got = render_citations(spark, sf)
    counted = reports.sections(got.withColumnRenamed("report", "text"), "conv_id", "text").groupBy("conv_id").agg(F.count("*").alias("section_count"))
    return counted.join(got.select("conv_id", F.size(reports.tags(F.col("report"))).cast("long").alias("evidence_tag_count")), "conv_id")


@query("""
SELECT p_partkey, s_suppkey, p_brand FROM part JOIN supplier ON s_nationkey = p_size WHERE p_size < 25
""")
def coverage_requirements(spark, sf):
    """Coverages and requirements of one standardised name."""
    coverages = table(spark, sf, "part").filter("p_size < 25").select("p_partkey", "p_brand", F.col("p_size").alias("name"))
    requirements = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("name"))
    return reports.by_name(coverages, requirements, "name").select("p_partkey", "s_suppkey", "p_brand")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT doc_id FROM labels)")
def requests_on_ledger(spark, sf):
    """Requests for files that the ledger has."""
    asked = table(spark, sf, "events").select("event_id", F.col("user_id").alias("file"))
    return cases.listed(asked, table(spark, sf, "labels").select(F.col("doc_id").alias("file")), "file").select("event_id")


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, sf):
    return cases.repeated(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("SELECT doc_id, length(left(text, 3000)) AS head, length(right(text, 400)) AS tail, sha256(right(text, 400)) AS tail_digest FROM documents")
def text_limits(spark, sf):
    """The head that a classifier reads and the tail that a log view shows."""
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(tx.head(text)).cast("long").alias("head"), F.length(tx.tail(text, 400)).cast("long").alias("tail"), F.sha2(tx.tail(text, 400), 256).alias("tail_digest"))


@query("SELECT event_id, event_type IN ('view', 'click') AS accepted FROM events")
def accepted_stage_names(spark, sf):
    """Stage names as written by others, against a stage's name and its aliases."""
    odd = F.concat(F.upper(F.substring("event_type", 1, 2)), F.lit("-_ "), F.substring("event_type", 3, 99))
    return table(spark, sf, "events").select("event_id", reviews.accepts(odd, "View", ["c-l-i-c-k"]).alias("accepted"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'claude-cli' WHEN 1 THEN 'unknown-provider:m' ELSE 'p:unknown-model' END AS label, CASE WHEN event_id >= 60 THEN (event_id // 60) || 'm ' || (event_id % 60) || 's' ELSE event_id || 's' END AS elapsed FROM events
""")
def run_labels(spark, sf):
    """Labels of readers and of elapsed seconds."""
    k = F.col("event_id") % 3
    label = tx.provider_label(k != 0, F.when(k == 2, "p"), F.when(k == 1, "m"))
    return table(spark, sf, "events").select("event_id", label.alias("label"), tx.elapsed(F.col("event_id")).alias("elapsed"))


@query("SELECT doc_id, doc_id % 3 = 0 AS safe FROM documents")
def safe_ids(spark, sf):
    name = F.concat(F.lit("CASE_"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(""), F.lit("/.."), F.lit("\n")), (F.col("doc_id") % 3 + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", cases.safe_id(name).alias("safe"))


@query("SELECT o_orderkey, 'CASE_9' AS case_id FROM orders WHERE o_custkey = 7 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'X')")
def fork_case_unlocked(spark, sf):
    """A fork looks at the locks first: another case's does not matter."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("CASE_"), F.col("o_custkey").cast("string")).alias("case_id"))
    return cases.fork(rows.drop("o_orderstatus"), "CASE_7", "CASE_9", rows.filter("case_id <> 'CASE_7'"))


@query("""
SELECT spec, error FROM (VALUES ('a.pdf:9-8=raw', 'range'), ('a.pdf', 'form'), ('b.pdf:3-4=raw', 'overlap')) v(spec, error)
UNION ALL SELECT file || ':' || a || '-' || b || '=raw', name FROM (VALUES ('a.pdf', 1, 2, 'a__p001-002.pdf'), ('x:y.pdf', 4, 13, 'x:y__p004-013.pdf')) w(file, a, b, name)
""")
def split_specs(spark, sf):
    """Page ranges to carve: refused ones with the reason, good ones with the name of the new file."""
    given = ["a.pdf:1-2=raw", "a.pdf:9-8=raw", "a.pdf", "b.pdf:1-3=raw", "b.pdf:3-4=raw", "x:y.pdf:4-13=raw"]
    good, refused = cases.parse_splits(spark.createDataFrame([(g,) for g in given], "spec string"), "spec")
    name = cases.split_name(F.regexp_replace("file", r"\.pdf$", ""), F.col("start"), F.col("end"))
    spec = F.concat("file", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("="), "tier")
    return refused.union(good.select(spec.alias("spec"), name.alias("error")))


@query("""
SELECT url, 'DOC_' || lpad(CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id % 4 = 0, url, page_id) AS VARCHAR), 3, '0') AS document_id FROM pages
""")
def split_id_sequence(spark, sf):
    """Carved parts are numbered after the whole files of their case."""
    files = table(spark, sf, "pages").select("url", (F.col("page_id") % 10).alias("case_id"), F.lit("raw").alias("classification"), F.struct("url", "page_id").alias("name"), (F.col("page_id") % 4 == 0).alias("is_split"))
    return cases.assign_ids(files, "case_id", "name").select("url", "document_id")
