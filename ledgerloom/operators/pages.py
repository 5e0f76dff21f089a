"""Pages: marked texts, chunks, dual readings and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.codes import READABLE, REVIEWER_ROLES
from ledgerloom.functions.text import marked, split_marked, strip


def mark_documents(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, marked_text): each document's pages as one marked text."""
    rows = F.collect_list(F.struct(F.col(page).cast("long").alias("page"), F.col(text).alias("text")))
    return pages.groupBy(doc).agg(marked(rows).alias("marked_text"))


def split_documents(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, page, text): the pages of marked texts, in text order."""
    return docs.select(doc, F.posexplode(split_marked(F.col(text))).alias("pos", "p")).select(doc, "pos", "p.page", "p.text")


def pages_in_order(pages: DataFrame, doc: str, pos: str, page: str) -> DataFrame:
    """(doc, n_pages, valid): pages start at 1 or later and strictly rise; gaps are allowed."""
    before = F.lag(page, 1, 0).over(Window.partitionBy(doc).orderBy(pos))
    return pages.select(doc, (F.col(page) > before).alias("up")).groupBy(doc).agg(F.count("*").alias("n_pages"), F.every("up").alias("valid"))


def number_chunks(pages: DataFrame, case: str, doc_pos: str, doc: str, page: str, text: str) -> DataFrame:
    """A chunk for each page, numbered within its case by document order and page, those without one last."""
    n = F.row_number().over(Window.partitionBy(case).orderBy(F.col(doc_pos).asc_nulls_last(), F.col(page).asc_nulls_last()))
    return pages.select(case, F.concat(F.lit("CHUNK_"), n.cast("string")).alias("chunk_id"), F.col(doc).alias("document_id"), F.col(page).alias("page_start"), F.col(page).alias("page_end"), F.col(text).alias("text"))


def compare_readings(a: Column, b: Column, verdict: Column) -> Column:
    """agreed or disagreed: texts that are equal but for white space at their ends agree; else the verdict decides."""
    return F.when(strip(a) == strip(b), "agreed").otherwise(parse_verdict(verdict))


def parse_verdict(verdict: Column) -> Column:
    """Only the whole word AGREE, without the whole word DISAGREE, is agreement; anything else is disagreement, so doubt never passes."""
    v = F.upper(F.coalesce(verdict, F.lit("")))
    return F.when(v.rlike(r"(?U)\bDISAGREE\b"), "disagreed").when(v.rlike(r"(?U)\bAGREE\b"), "agreed").otherwise("disagreed")


def parse_content_scan(verdict: Column) -> Column:
    v = F.upper(F.coalesce(verdict, F.lit("")))
    return F.when(v.rlike(r"(?U)\bFLAGGED\b"), "flagged").when(v.rlike(r"(?U)\bCLEAR\b"), "clear").otherwise("flagged")


def ocr_rollup(pages: DataFrame, doc: str, page: str, agreement: str) -> DataFrame:
    """A row for each document: status, quality, review flag and its pages in disagreement."""
    off = F.col(agreement) == "disagreed"
    got = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.count_if(off).alias("n_disagreed"), F.array_sort(F.collect_list(F.when(off, F.col(page)))).alias("disagreed_pages"))
    bad = F.col("n_disagreed") > 0
    return got.select(
        doc, "pages", "n_disagreed", "disagreed_pages",
        F.when(bad, "failed").otherwise("completed").alias("ocr_status"), F.when(bad, "disagreed_unresolved").otherwise("agreed").alias("cross_validation_status"),
        F.when(bad, "low").otherwise("high").alias("ocr_quality"), bad.alias("review_required"),
    )


def assembled(pages: DataFrame, doc: str, page: str, agreement: str, text_path: Column) -> DataFrame:
    """pages with what follows from their agreement: only an agreed page has a text path; a page that disagrees asks for a reviewer.

    Without values of their own, extraction_method is dual_read and cross_validation_mode the weak one of two readers of a kind.
    """
    off = F.col(agreement) == "disagreed"
    have = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in pages.columns else F.lit(default)
    return pages.withColumns({
        "text_path": F.when(~off, text_path), "ocr_quality": F.when(off, "low").otherwise("high"), "extraction_method": have("extraction_method", "dual_read"),
        "cross_validation_mode": have("cross_validation_mode", "single_technology_weak_p8_poc"), "review_required": off,
        "reviewer_role": F.when(off, REVIEWER_ROLES[0]), "review_reason": F.when(off, F.concat(F.lit("readings differ on page "), F.col(page).cast("string"))),
    })


def first_disagreed(pages: DataFrame, doc: str, page: str, agreement: str) -> DataFrame:
    """(doc, page) of the first page in disagreement of each document that has one."""
    return pages.filter(F.col(agreement) == "disagreed").groupBy(doc).agg(F.min(page).alias(page))


def open_readings(open_pages: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """open_pages (keys, text, ...) with both raw readings; a page that raw lacks shows its stored text as either."""
    got = open_pages.join(raw.select(*keys, "reading_a", "reading_b"), keys, "left")
    return got.withColumns({c: F.coalesce(c, "text") for c in ("reading_a", "reading_b")})


def readable(documents: DataFrame, status: str = "cross_validation_status") -> Column:
    """Whether a document's readings are settled, so that its text may be redacted."""
    return F.coalesce(documents[status].isin(READABLE), F.lit(False))


def covered(chunks: DataFrame, excluded: DataFrame, doc: str) -> DataFrame:
    """(doc, error) where chunked and excluded documents contradict: `both`, or `twice` in the exclusions; (null, empty) if there are neither."""
    one = excluded.groupBy(doc).agg(F.count("*").alias("n")).join(chunks.select(doc).distinct().withColumn("has", F.lit(True)), doc, "left")
    wrong = one.select(doc, F.when(F.col("has"), "both").when(F.col("n") > 1, "twice").alias("error")).filter("error IS NOT NULL")
    none = chunks.select(doc).union(excluded.select(doc)).limit(1).agg(F.count("*").alias("n")).filter("n = 0")
    return wrong.union(none.select(F.lit(None).cast(excluded.schema[doc].dataType), F.lit("empty")))


def resolve(pages: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (reading_a, reading_b, agreement) with decisions (chosen_reading) joined in: final text, and whether a page is still open."""
    got = pages.join(decisions, keys, "left")
    agreed = F.col("agreement") == "agreed"
    text = F.when(agreed | (F.col("chosen_reading") == "reading_a"), F.col("reading_a")).when(F.col("chosen_reading") == "reading_b", F.col("reading_b"))
    return got.withColumn("text", text).withColumn("unresolved", ~agreed & F.col("chosen_reading").isNull())
