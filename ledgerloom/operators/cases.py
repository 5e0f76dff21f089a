"""Cases: intake, ledgers and gates, run state, branching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.codes import FORMATS, IGNORED_FILES, TRUTH_PATTERNS
from ledgerloom.functions.text import file_format, glob_regex


def classify_files(files: DataFrame, name: str, patterns: list[str] = TRUTH_PATTERNS, ignored: list[str] = IGNORED_FILES) -> DataFrame:
    """files without ignored names, with classification (ground_truth if any pattern fits the name, else raw) and file_format."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col(name).rlike(glob_regex(p))
    kept = files.filter(~F.col(name).isin(ignored))
    return kept.withColumn("classification", F.when(fits, "ground_truth").otherwise("raw")).withColumn("file_format", file_format(F.col(name), FORMATS))


def assign_ids(files: DataFrame, case: str, name: str) -> DataFrame:
    """files with document_id: DOC_nnn or GT_nnn in the order of names within a case and class; carved parts (is_split) go on after whole files."""
    order = [F.col("is_split").asc(), F.col(name)] if "is_split" in files.columns else [F.col(name)]
    n = F.row_number().over(Window.partitionBy(case, "classification").orderBy(*order))
    return files.withColumn("document_id", F.format_string("%s_%03d", F.when(F.col("classification") == "ground_truth", "GT").otherwise("DOC"), n))


def parse_split(spec: Column) -> Column:
    """file:a-b=tier as a struct; null fields and an error if it is not one."""
    part = lambda i: F.regexp_extract(spec, r"(?s)^(.+):(\d+)-(\d+)=(raw|ground_truth)$", i)
    a, b = F.nullif(part(2), F.lit("")).cast("long"), F.nullif(part(3), F.lit("")).cast("long")
    bad = F.when(a.isNull(), "form").when((a < 1) | (b < a), "range")
    return F.struct(F.nullif(part(1), F.lit("")).alias("file"), a.alias("start"), b.alias("end"), F.nullif(part(4), F.lit("")).alias("tier"), bad.alias("error"))


def parse_splits(specs: DataFrame, spec: str) -> tuple[DataFrame, DataFrame]:
    """(file, start, end, tier) of good specs, and refused specs with `error`: form, range, or overlap with an earlier range of the file."""
    got = specs.select(spec, parse_split(F.col(spec)).alias("_s")).select(spec, "_s.*")
    good = got.filter("error IS NULL")
    bad = overlapping(good, "file", "start", "end").withColumn("error", F.lit("overlap"))
    refused = got.filter("error IS NOT NULL").unionByName(bad)
    return good.join(bad.select("file").distinct(), "file", "left_anti").select("file", "start", "end", "tier"), refused.select(spec, "error")


def split_name(stem: Column, start: Column, end: Column) -> Column:
    """File name of a carved page range."""
    return F.format_string("%s__p%03d-%03d.pdf", stem, start, end)


def safe_id(name: Column) -> Column:
    """Whether a name is safe as an id or part of a path: letters, digits and underscores alone."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_]+\z"), F.lit(False))


def listed(asked: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """The asked rows whose file the ledger has."""
    return asked.join(ledger, key, "left_semi")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of ids that come more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def overlapping(ranges: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Ranges that begin before an earlier one of their key has ended."""
    before = F.max(end).over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn("before", before).filter(F.col(start) <= F.col("before")).drop("before")


def split_pages(pages: DataFrame, ranges: DataFrame, page: str) -> tuple[DataFrame, DataFrame]:
    """(pages in a range, with its columns; pages in none). ranges is a short list (start, end, ...)."""
    inside = (F.col(page) >= F.col("start")) & (F.col(page) <= F.col("end"))
    return pages.join(ranges, inside), pages.join(ranges, inside, "left_anti")


def ledger_gate(ledger: DataFrame, cases: DataFrame, case: str, item: str, status: str, approved: str, absent_clear: bool) -> DataFrame:
    """(case, n, pending, rejected, clear): clear if all are approved; pending and rejected are numbers. A case without a ledger is clear or not as absent_clear says."""
    is_pending = F.coalesce(F.col(status), F.lit("pending")) == "pending"
    got = ledger.groupBy(case).agg(F.count("*").alias("n"), F.count_if(is_pending).alias("pending"), F.count_if(F.col(status) == "rejected").alias("rejected"), F.every(F.coalesce(F.col(status) == approved, F.lit(False))).alias("ok"))
    none = F.lit(0).cast("long")
    return cases.select(case).distinct().join(got, case, "left").select(case, *(F.coalesce(c, none).alias(c) for c in ("n", "pending", "rejected")), F.coalesce("ok", F.lit(absent_clear)).alias("clear"))


def held_up_by(ledger: DataFrame, case: str, item: str, status: str) -> DataFrame:
    """(case, item, why) of the entries that keep a gate shut: pending ones and rejected ones, a row each."""
    why = F.coalesce(F.col(status), F.lit("pending"))
    return ledger.select(case, item, why.alias("why")).filter(F.col("why").isin("pending", "rejected"))


def ledger_drift(plan: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """(key, problem) for planned files that the ledger lacks or classes otherwise."""
    got = plan.join(ledger.select(key, F.col("classification").alias("known")), key, "left")
    problem = F.when(F.col("known").isNull(), "missing").when(~F.col("known").eqNullSafe(F.col("classification")), "class differs")
    return got.select(key, problem.alias("problem")).filter("problem IS NOT NULL")


def fold_run_state(events: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """The state of each stage after all events: last status, attempts, first start and last completion."""
    went, ended = F.col(status) == "in_progress", F.col(status).isin("passed", "failed")
    return events.groupBy(*keys).agg(
        F.max_by(status, order).alias("status"), F.count_if(went).alias("attempt_count"), F.min(F.when(went, F.col(order))).alias("started_at"), F.max(F.when(ended, F.col(order))).alias("completed_at")
    )


def last_passed(events: DataFrame, case: str, stage: str, status: str, order: str) -> DataFrame:
    return events.filter(F.col(status) == "passed").groupBy(case).agg(F.max_by(stage, order).alias("last_passed"), F.max(order).alias("at"))


def pair_waits(events: DataFrame, keys: list[str], kind: str, order: str, waiting: str, received: str) -> DataFrame:
    """Each `received` event with the latest `waiting` one before it that is still open (`waited_at`); one without any is left out.

    Waiting events raise a level and received ones lower it; those that cross one level take turns, so the event before a received
    one on its level is the waiting one that it closes.
    """
    rows = events.filter(F.col(kind).isin(waiting, received))
    up = F.col(kind) == waiting
    level = F.sum(F.when(up, 1).otherwise(-1)).over(Window.partitionBy(*keys).orderBy(order)) + F.when(up, 0).otherwise(1)
    w = Window.partitionBy(*keys, "level").orderBy(order)
    rows = rows.withColumn("level", level).withColumns({"before": F.lag(kind).over(w), "waited_at": F.lag(order).over(w)})
    return rows.filter(~up & (F.col("before") == waiting)).drop("before", "level")


def first_writer(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The event that got the lock of its key."""
    return events.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("n = 1").drop("n")


def stage_status(base: str, attempts: str, rejected: str, pending: str, blocked: str, conflicts: str, waits: str) -> Column:
    """The ladder of what holds a stage up, first match first: (status, rule)."""
    hit = lambda c, s, r: (F.col(c) > 0, F.struct(F.lit(s).alias("status"), F.lit(r).alias("rule")))
    out = F
    for cond, value in (hit(rejected, "paused", "D2"), hit(pending, "paused", "D2"), hit(blocked, "paused", "P8"), hit(conflicts, "paused", "P6"), hit(waits, "paused", "P7")):
        out = out.when(cond, value)
    halted = (F.col(base) == "failed") & (F.coalesce(F.col(attempts), F.lit(0)) >= 3)
    return out.when(halted, F.struct(F.lit("halted").alias("status"), F.lit("P9").alias("rule"))).otherwise(F.struct(F.coalesce(F.col(base), F.lit("pending")).alias("status"), F.lit(None).cast("string").alias("rule")))


def run_status(started: Column, exit_code: Column, seen: Column, silent_s: Column) -> Column:
    """not_started, running, stalled (silent over 120 s), finished, crashed or ended_unknown."""
    return F.when(~started, "not_started").when(exit_code == 0, "finished").when(exit_code != 0, "crashed").when(seen & (silent_s > 120), "stalled").when(seen, "running").otherwise("ended_unknown")


def next_case(ids: DataFrame, column: str, width: int = 3) -> DataFrame:
    """The next free CASE_ id over all ids with digits."""
    top = F.coalesce(F.max(F.nullif(F.regexp_extract(column, r"^CASE_(\d+)$", 1), F.lit("")).cast("long")), F.lit(0)) + 1
    return ids.agg(F.concat(F.lit("CASE_"), F.lpad(top.cast("string"), F.greatest(F.lit(width), F.length(top.cast("string"))), F.lit("0"))).alias("case_id"))


def fork(contracts: DataFrame, source: str, target: str, locks: DataFrame | None = None) -> DataFrame:
    """The rows of one case again under another id; ids inside texts stay as they are. A case with a lock (case_id) has none."""
    got = contracts.filter(F.col("case_id") == source)
    if locks is not None:
        got = got.join(locks.select("case_id").distinct(), "case_id", "left_anti").select(contracts.columns)
    return got.withColumn("case_id", F.lit(target))


def scenarios(pages: DataFrame) -> DataFrame:
    """Blocked pages under each way to resolve them: by either reading, or not at all."""
    return pages.withColumn("scenario", F.explode(F.array(*map(F.lit, ("reading_a", "reading_b", "unresolved")))))


def backfill(df: DataFrame, defaults: dict) -> DataFrame:
    """Defaults where a value is missing; never over one that is there."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def patch(df: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """df with the fields of patches (keys, fields, each named as in df) in the rows that they name; other rows and fields stay."""
    fields = [c for c in patches.columns if c not in keys]
    new = patches.select(*keys, F.lit(True).alias("_patched"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    got = df.join(new, keys, "left")
    return got.select(*(F.when(F.col("_patched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns))
