"""Mixing sources to target weights: iterative proportional fitting, in DataFrame functions alone.

Documents are summed to cells by the levels of their margins (source, language, topic). A cell's expected tokens start at the
budget's share of its tokens and are raked: each margin in turn is scaled so that its levels have their targets, while no cell goes
beyond the tokens that it has, until all margins hold within a tolerance. A level that has fewer tokens than its target is kept
whole, and the others of its margin share the rest of the budget as their targets stand to each other. The ratio of a cell's
expected tokens to its tokens is the probability of its documents, at most 1; a document is drawn if a hash of its id falls below
it, so any run draws the same documents, and no shuffle of texts is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import discard, fresh, materialise

NONE = "\x00none"  # the level of a null
SWEEPS, CELLS_OF_TASK = 3, 1_000_000


def topic(text) -> Column:
    """A coarse topic of the whole text by its form: license, contact, code or prose; null text: prose."""
    t = F.coalesce(text, F.lit(""))
    has = lambda column, *words: reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])
    license_ = has(F.lower(t), "license", "licence", "copyright", "all rights reserved")
    contact = has(t, "@") & t.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]")
    code = has(t, *"{}<>=;") | has(t, "(") & t.rlike(r"\w\(")
    return F.when(license_, "license").when(contact, "contact").when(code, "code").otherwise("prose")


def tokens(text) -> Column:
    """Words of the text, by ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(cells: DataFrame, margin: str, power: float, targets: dict[str, float] | None) -> DataFrame:
    """(margin, target, n): given weights, or else the margin's tokens to the power, as shares of those levels that have tokens; n are these.

    Levels without a given weight get 0. If no level has one, all are as they are.
    """
    levels = cells.groupBy(margin).agg(F.sum("n").alias("n")).filter("n > 0")
    if targets is None:
        raw = F.pow("n", F.lit(power))
    else:
        pairs = [F.lit(x) for k, v in targets.items() for x in (k, float(v))]
        raw = F.coalesce(F.element_at(F.create_map(*pairs), F.col(margin)), F.lit(0.0)) if pairs else F.lit(0.0)
    levels = levels.withColumn("raw", raw)
    total = levels.agg(F.sum("raw").alias("all"), F.sum("n").alias("tokens")).first()
    share = F.col("raw") / F.lit(float(total["all"])) if (total["all"] or 0) > 0 else F.col("n") / F.lit(float(total["tokens"] or 1))
    return levels.select(margin, share.alias("target"), "n")


def reachable(levels: DataFrame, margin: str, budget: float) -> DataFrame:
    """(margin, goal, whole): tokens of each level of (margin, target, n) by its target share of the budget, but no more than it has, and whether it is kept whole; the others make up for those."""
    scale, full = budget, None
    while True:  # levels at their limit only become more: ends after at most as many steps as there are levels
        at_limit = F.col("target") * F.lit(scale) >= F.col("n")
        got = levels.agg(F.sum(F.when(at_limit, F.col("n")).otherwise(0)), F.sum(F.when(at_limit, 0.0).otherwise(F.col("target"))), F.count_if(at_limit)).first()
        if got[2] == full or not got[1]:
            break
        full, scale = got[2], max(scale, (budget - float(got[0])) / got[1])
    goal = F.col("target") * F.lit(scale)
    return levels.select(margin, F.least(goal, F.col("n")).alias("goal"), (goal >= F.col("n")).alias("whole"))


def rake(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], budget: float, sweeps: int = 60, tolerance: float = 1e-5) -> DataFrame:
    """cells (margins, n) with column x: expected tokens, at most n, whose sums meet each margin's goals out of `budget` tokens.

    targets are as shares makes them. Cells of a level that is kept whole keep their tokens; the rest is raked around them. Stops when no margin was off by more than the tolerance (of the budget) in a sweep, or after
    `sweeps`. Some sweeps are one job over the cells: up to CELLS_OF_TASK of them lie in one partition, which needs no shuffle; more
    are dealt by level. Either way a level's cells may spill.
    """
    fixed = cells.filter("n > 0")
    for i, m in enumerate(margins):
        goal = reachable(targets[m], m, budget).withColumnsRenamed({"goal": f"goal_{i}", "whole": f"whole_{i}"})
        fixed = fixed.join(goal, m)
    whole = reduce(lambda a, b: a | b, [F.col(f"whole_{i}") for i in range(len(margins))])
    fixed = fixed.withColumn("whole", whole).drop(*(f"whole_{i}" for i in range(len(margins))))
    total = fixed.agg(F.sum("n").alias("tokens"), F.count("*").alias("cells")).first()
    now = fixed.withColumn("x", F.when(F.col("whole"), F.col("n")).otherwise(F.col("n") * F.lit(min(1.0, budget / float(total["tokens"] or 1)))))
    now = materialise(now.withColumn("off", F.lit(0.0)), "cells")
    for _ in range(0, sweeps, SWEEPS):
        step = now.coalesce(1) if total["cells"] <= CELLS_OF_TASK else now
        for i, m in list(enumerate(margins)) * SWEEPS:
            level, goal, held = Window.partitionBy(m), F.col(f"goal_{i}"), F.col("whole") | (F.col("x") >= F.col("n"))
            part = lambda c: F.sum(F.when(c, F.col("x")).otherwise(0.0)).over(level)
            step = step.withColumns({"of level": F.sum("x").over(level), "of held": part(held), "of whole": part(F.col("whole"))})
            free, loose = (F.col("of level") - F.col(c) for c in ("of held", "of whole"))
            up = F.when(held | (free <= 0), F.col("x")).otherwise(F.least("n", F.col("x") * (goal - F.col("of held")) / free))
            down = F.when(F.col("whole") | (loose <= 0), F.col("x")).otherwise(F.col("x") * F.greatest(F.lit(0.0), goal - F.col("of whole")) / loose)
            off = F.abs(F.col("of level") - goal)
            step = step.withColumns({"x": F.when(goal <= F.col("of level"), down).otherwise(up), "off": off if i == 0 else F.greatest("off", off)}).drop("of level", "of held", "of whole")
        seen = Observation()
        old, now = now, materialise(step.observe(seen, F.max("off").alias("off")), "cells")
        discard(old)
        if (seen.get["off"] or 0.0) <= tolerance * budget:
            break
    return now.drop("off", "whole", *(f"goal_{i}" for i in range(len(margins))))


def unit(key: Column, seed: int) -> Column:
    """A number of [0, 1) by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def mix(docs: DataFrame, margins: dict[str, Column], size: Column, key: Column, budget: float = 0.5, power: float = 0.7, targets: dict[str, dict[str, float]] | None = None, seed: int = 42) -> tuple[DataFrame, list[str], str, str, str]:
    """docs with a column for each margin's level, for tokens, probability and kept; these names are returned in that order.

    Target shares are targets[margin] where given, else the levels' tokens to `power`; `budget` is the part of all tokens to draw. A
    null level is a level of its own. Documents without tokens weigh nothing and are kept; those of a level that given targets leave
    out are not. The draw depends on `key` alone: repeated rows are drawn alike; a null key is hashed like a value.
    """
    names = []
    got = docs
    for m, level in margins.items():
        names.append(fresh(got, f"mix_{m}"))
        got = got.withColumn(names[-1], F.coalesce(level.cast("string"), F.lit(NONE)))
    n, p, kept = (fresh(got, f"mix_{x}") for x in ("tokens", "probability", "kept"))
    got = got.withColumn(n, size)
    cells = materialise(got.groupBy(*names).agg(F.sum(n).alias("n")), "cells")
    goal = {c: shares(cells, c, power, (targets or {}).get(m)) for c, m in zip(names, margins)}
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    raked = rake(cells, names, goal, budget * total).select(*names, (F.col("x") / F.col("n")).alias(p))
    out = got.join(raked, names, "left").withColumn(p, F.when(F.col(n) == 0, 1.0).otherwise(F.coalesce(p, F.lit(0.0))))
    return out.withColumn(kept, unit(key, seed) < F.col(p)), names, n, p, kept


def op2_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = materialise(docs.select("doc_id", "source", "lang", topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("tokens")), "sizes")
    got, _, n, p, kept = mix(rows, {m: F.col(m) for m in ("source", "lang", "topic")}, F.col("tokens"), F.col("doc_id"))
    return got.select("doc_id", "source", "lang", "topic", "tokens", F.round(p, 6).alias("probability"), F.col(kept).alias("kept"))
