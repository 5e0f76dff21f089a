"""People's decisions and what they open: ledgers, conflicts, reviews, access to texts, joins of findings.

A decision that breaks its rule changes nothing and comes back as a refused row with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.codes import REVIEWER_ROLES
from ledgerloom.functions.text import marked


def _filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column))) > 0, F.lit(False))


def _last(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """(keys, the fields of the last row by `order`); a partial aggregate, so no key's rows meet in one place."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_last")).select(*keys, "_last.*")


def _refused(entries: DataFrame, decisions: DataFrame, keys: list[str], problem: Column) -> tuple[DataFrame, DataFrame]:
    """(decisions that hold, refused ones with `error`): `not found` where entries have no such key."""
    known = entries.select(*keys).distinct().withColumn("_known", F.lit(True))
    got = decisions.join(known, keys, "left").withColumn("error", F.coalesce(problem, F.when(F.col("_known").isNull(), "not found"))).drop("_known")
    return got.filter("error IS NULL").drop("error"), got.filter("error IS NOT NULL")


def decide_ledger(entries: DataFrame, decisions: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(entries with review_status, reviewed_by, reviewed_at and rejection_reason; refused decisions).

    decisions are (keys, order, status, reviewer, reason). Approval needs a reviewer, rejection a reason; the last that holds counts,
    and only a rejection keeps a reason. Entries nobody decided on are pending.
    """
    problem = F.when((F.col("status") == "approved") & ~_filled("reviewer"), "reviewer").when((F.col("status") == "rejected") & ~_filled("reason"), "reason")
    good, refused = _refused(entries, decisions, keys, F.coalesce(problem, F.when(~F.coalesce(F.col("status").isin("pending", "approved", "rejected"), F.lit(False)), "status")))
    kept = F.when(F.col("status") == "rejected", F.col("reason"))
    last = _last(good, keys, order, [F.col("status").alias("review_status"), F.col("reviewer").alias("reviewed_by"), F.col(order).alias("reviewed_at"), kept.alias("rejection_reason")])
    return entries.join(last, keys, "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending"))), refused


def raise_conflicts(raised: DataFrame, case: str, order: list[str], sources: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts with conflict_id and verdict pending, refused rows): CONFLICT_n runs on within a case; two sources at least."""
    enough = F.coalesce(F.size(sources) >= 2, F.lit(False))
    n = F.row_number().over(Window.partitionBy(case).orderBy(*order))
    good = raised.filter(enough).withColumn("conflict_id", F.concat(F.lit("CONFLICT_"), n.cast("string"))).withColumn("verdict", F.lit("pending"))
    return good, raised.filter(~enough).withColumn("error", F.lit("sources"))


def settle_conflicts(conflicts: DataFrame, verdicts: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(conflicts with verdict, resolution_note and resolved_at; refused verdicts).

    verdicts are (keys, order, verdict, note); resolved and false_positive need a note, the last that holds counts.
    """
    problem = F.when(~F.coalesce(F.col("verdict").isin("pending", "resolved", "false_positive"), F.lit(False)), "verdict").when((F.col("verdict") != "pending") & ~_filled("note"), "note")
    good, refused = _refused(conflicts, verdicts, keys, problem)
    last = _last(good, keys, order, [F.col("verdict"), F.col("note").alias("resolution_note"), F.col(order).alias("resolved_at")])
    return conflicts.drop("verdict").join(last, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("pending"))), refused


def complete_reviews(marks: DataFrame, reviews: DataFrame, errors: str) -> tuple[DataFrame, DataFrame]:
    """(flags, blocked marks): a mark (case_id, version, ...) holds if a review of that case and version is there without errors."""
    valid = reviews.filter(F.size(errors) == 0).select("case_id", "version").distinct()
    keys = ["case_id", "version"]
    return marks.join(valid, keys, "left_semi"), marks.join(valid, keys, "left_anti")


def truth_access(requests: DataFrame, flags: DataFrame) -> DataFrame:
    """requests (case_id, version, caller_stage, ...) with access: only the evaluation may read, once its version's review is complete."""
    known = flags.select("case_id", "version").distinct().withColumn("_flag", F.lit(True))
    access = F.when(~F.col("caller_stage").eqNullSafe("evaluation"), "denied: stage").when(F.col("_flag").isNull(), "denied: review").otherwise("allowed")
    return requests.join(known, ["case_id", "version"], "left").withColumn("access", access).drop("_flag")


def document_texts(documents: DataFrame, redacted: DataFrame, keys: list[str], text: str) -> DataFrame:
    """documents (keys, downstream_disposition, ...) with access and the redacted text, which a document for experts only never shows."""
    got = documents.join(redacted.select(*keys, F.col(text).alias("_text")), keys, "left")
    access = F.when(F.col("downstream_disposition").eqNullSafe("expert_review_only"), "expert_review_only").when(F.col("_text").isNull(), "not_extracted").otherwise("ok")
    return got.withColumn("access", access).withColumn(text, F.when(F.col("access") == "ok", F.col("_text"))).drop("_text")


def reset_blocked(documents: DataFrame, blocked: str, n_pages: str, status: str) -> DataFrame:
    """documents whose readings are blocked lose all that reading them had set, and say failed; others stay."""
    owned = ["ocr_text_path", "ocr_quality", "uncertain_region_count", "redacted_text_path", "document_type", "classification_confidence", "extraction_method", "downstream_disposition", "non_text_verification"]
    new = {c: F.lit(None) for c in owned} | {"ocr_status": F.lit("failed"), "pages": F.col(n_pages), "cross_validation_status": F.col(status)}
    hit = F.coalesce(F.col(blocked), F.lit(False))
    return documents.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items() if c in documents.columns})


def resolve_non_text(documents: DataFrame, pages: DataFrame, decisions: DataFrame, contracts: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(documents verified as images without text, refused decisions with `error`).

    decisions are (doc, verified_by, note, reviewer_role), documents have cross_validation_status, pages text_path; contracts lists the
    documents (doc) that already have a classification or redaction. Checked in this order: role, signature, document, status, pages,
    text, contracts.
    """
    read = pages.groupBy(doc).agg(F.count("*").alias("_pages"), F.count("text_path").alias("_texts"))
    later = contracts.select(doc).distinct().withColumn("_later", F.lit(True))
    state = documents.select(doc, F.col("cross_validation_status").alias("_status"), F.lit(True).alias("_known"))
    got = decisions.join(state, doc, "left").join(read, doc, "left").join(later, doc, "left")
    error = F.when(~F.coalesce(F.col("reviewer_role").isin(REVIEWER_ROLES), F.lit(False)), "role").when(~_filled("verified_by") | ~_filled("note"), "signature")
    error = error.when(F.col("_known").isNull(), "document").when(~F.col("_status").eqNullSafe("disagreed_pending_review"), "status")
    error = error.when(F.col("_pages").isNull(), "pages").when(F.col("_texts") > 0, "text").when(F.col("_later"), "contracts")
    got = got.withColumn("error", error)
    good = got.filter("error IS NULL").select(
        *decisions.columns, F.col("_pages").alias("pages"), F.lit("not_applicable").alias("ocr_status"), F.lit("non_text_verified").alias("cross_validation_status"), F.lit("non_text_image").alias("extraction_method"),
        F.lit(0).cast("long").alias("uncertain_region_count"), F.lit("other").alias("document_type"), F.lit("expert_review_only").alias("downstream_disposition"), F.lit(True).alias("review_required"),
    )
    return good, got.filter("error IS NOT NULL").select(*decisions.columns, "error")


def redaction_rollup(pages: DataFrame, doc: str, page: str, text: str, items: str, categories: str, warnings: str) -> DataFrame:
    """A row for each document: redacted_text with page marks, items_redacted, sorted categories, review_required if any page warns."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(categories))))
    warned = F.coalesce(F.size(warnings) > 0, F.lit(False))
    rows = F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text")))
    return pages.groupBy(doc).agg(marked(rows).alias("redacted_text"), F.sum(items).alias("items_redacted"), names.alias("categories"), F.bool_or(warned).alias("review_required"))


def uncertain_rollup(pages: DataFrame, doc: str, regions: str, confidence: str) -> DataFrame:
    """(doc, uncertain_region_count, document_mean_confidence): the mean over pages that have a confidence, null if none has."""
    n = F.sum(F.when(F.col(regions).isNull(), 0).otherwise(F.size(regions)))
    return pages.groupBy(doc).agg(n.cast("long").alias("uncertain_region_count"), F.avg(confidence).alias("document_mean_confidence"))


def next_snapshot(stages: DataFrame, case: str, backup: str) -> DataFrame:
    """(case, step): the number of the next snapshot. A stage that is saved again keeps its row, so a number can come twice."""
    return stages.groupBy(case).agg((F.count(backup) + 1).alias("step"))


def fork_source(snapshots: DataFrame, requests: DataFrame, step: str) -> DataFrame:
    """requests (case_id, step, ...) with the one snapshot of that step, or the error `none` or `ambiguous`."""
    found = snapshots.groupBy("case_id", step).agg(F.count("*").alias("_n"), F.min("path").alias("_path"))
    got = requests.join(found, ["case_id", step], "left")
    return got.withColumn("path", F.when(F.col("_n") == 1, F.col("_path"))).withColumn("error", F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous")).drop("_n", "_path")


def rebuttable(reasons: DataFrame, validations: DataFrame, points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(reasons with verdict and rebuttal_argument, points that answer a reason which is supported, open or not there).

    Only a reason that is not_supported or partially_supported is answered.
    """
    judged = reasons.join(validations.select(*keys, "verdict"), keys)
    open_ = judged.filter(F.col("verdict").isin("not_supported", "partially_supported"))
    answers = points.select(*keys, *(c for c in points.columns if c not in keys and c not in judged.columns))
    return open_.join(answers, keys, "left"), points.join(open_.select(*keys).distinct(), keys, "left_anti")


def conflict_links(checks: DataFrame, conflicts: DataFrame, case: str) -> DataFrame:
    """checks with `error`: an inconsistent one without conflict_id, a consistent one with it, or one whose conflict is not in the ledger."""
    known = conflicts.select(case, "conflict_id").distinct().withColumn("_known", F.lit(True))
    error = F.when((F.col("result") == "inconsistent") & F.col("conflict_id").isNull(), "no conflict").when((F.col("result") == "consistent") & F.col("conflict_id").isNotNull(), "stray conflict")
    got = checks.join(known, [case, "conflict_id"], "left")
    return got.withColumn("error", error.when(F.col("conflict_id").isNotNull() & F.col("_known").isNull(), "unknown conflict")).drop("_known")


def dispositions(findings: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """findings with the disposition a person gave to each; `open` where there is none."""
    return findings.join(reviews.select(*keys, "disposition"), keys, "left").withColumn("disposition", F.coalesce("disposition", F.lit("open")))


def codebook_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two code lists has, with the `side` that has them; empty if the lists are the same."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def accepts(name: Column, key: str, aliases: list[str]) -> Column:
    """Whether a stage name is a stage's own or one of its aliases."""
    return F.array_contains(F.array(*(stage_key(F.lit(n)) for n in [key, *aliases])), stage_key(name))


def stage_key(name: Column) -> Column:
    """Stage names are the same whatever their case, hyphens, underscores and spaces."""
    return F.lower(F.regexp_replace(name, r"[-_\s]", ""))
