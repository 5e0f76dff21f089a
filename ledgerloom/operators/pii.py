"""Personal data: scan, redaction of named spans, and the gate that lets no leak through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.codes import INSTITUTIONS, NAME_CATEGORIES, PII, PLACEHOLDERS
from ledgerloom.functions.text import fold_spaces, fold_widths, strip
from ledgerloom.operators.pages import readable
from ledgerloom.operators.reviews import redaction_rollup

OFTEN = 20


def may_hold(text: Column, kind: str) -> Column:
    """A cheap condition that every match of the kind meets: an @, or two digits running; it keeps the patterns off most texts."""
    return F.contains(text, F.lit("@")) if kind == "email" else text.rlike(r"[0-9０-９]{2}|(?U)[\d&&[^\x00-\x7f]]")


def found(text: Column, kind: str) -> Column:
    matches = F.regexp_extract_all(fold_widths(text), F.lit(f"(?U){PII[kind]}"), F.lit(0))
    return F.when(may_hold(text, kind), matches).otherwise(F.array().cast("array<string>"))


def named_spans(text: Column, kind: str, label: str, value: str, sample: str) -> Column:
    """Array of a struct (label: value, sample: match) for each match of the kind."""
    return F.transform(found(text, kind), lambda s: F.struct(F.lit(value).alias(label), s.alias(sample)))


def scan(df: DataFrame, key: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """(key, kind, sample): a row for each match of each kind; one value may be of several kinds."""
    each = [named_spans(F.col(text), k, "kind", k, "sample") for k in kinds or PII]
    return df.select(key, F.explode(F.concat(*each)).alias("hit")).select(key, "hit.*")


def leaks(text: Column, kinds: list[str] | None = None) -> Column:
    out = F.lit(False)
    for k in kinds or PII:
        out = out | (may_hold(text, k) & fold_widths(text).rlike(f"(?U){PII[k]}"))
    return out


def placeholder(category: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv))
    return F.coalesce(F.element_at(table, category), F.lit(PLACEHOLDERS["other_pii"]))


def _literal(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\](){}*+?^$|\-&~#])", r"\\$1")


def redact_spans(df: DataFrame, text: str, items: str) -> DataFrame:
    """df with `redaction`: the fold of `items` (array of (text, category)) over the text, longest first.

    Fields: text; applied, unmatched and ambiguous (arrays of (text, category, count)). An item of one character or less, or one that is
    there more than OFTEN times, is ambiguous; one that the source never has is unmatched; one that longer items have covered is
    silent. A name before an institution's ending is left and ambiguous.
    """
    spaced = F.filter(F.col(items), lambda i: F.length(strip(F.coalesce(i["text"], F.lit("")))) > 0)
    ordered = F.array_sort(F.transform(spaced, lambda i, n: F.struct((-F.length(i["text"])).alias("l"), i["text"].alias("text"), n.alias("n"), F.coalesce(i["category"], F.lit("other_pii")).alias("category"))))
    # Sorted, equal texts are neighbours: the first of each is the one seen first.
    first = F.filter(ordered, lambda i, n: F.when(n == 0, True).otherwise(F.get(ordered, n - 1)["text"] != i["text"]))
    by_length = F.array_sort(F.transform(first, lambda i: F.struct(i["l"], i["n"], i["text"], i["category"])))
    row = "array<struct<text:string,category:string,count:int>>"
    none = F.array().cast(row)
    init = F.struct(F.col(text).alias("text"), none.alias("applied"), none.alias("unmatched"), none.alias("ambiguous"))
    # Fixed value: a name before up to ten letters and an institution's ending is part of the institution's name.
    ending = "(?![가-힣]{0,10}(?:" + "|".join(INSTITUTIONS) + "))"

    def step(acc, i):
        plain = _literal(i["text"])
        name = i["category"].isin(NAME_CATEGORIES)
        here = F.regexp_count(acc["text"], plain)
        pattern = F.when(name, F.concat(plain, F.lit(ending))).otherwise(plain)
        hits = F.regexp_count(acc["text"], pattern)
        cell = lambda n: F.array(F.struct(i["text"].alias("text"), i["category"].alias("category"), n.cast("int").alias("count"))).cast(row)
        state = lambda t, a, u, m: F.struct(t.alias("text"), a.alias("applied"), u.alias("unmatched"), m.alias("ambiguous"))
        same = state(acc["text"], acc["applied"], acc["unmatched"], acc["ambiguous"])
        doubt = state(acc["text"], acc["applied"], acc["unmatched"], F.concat(acc["ambiguous"], cell(here)))
        miss = state(acc["text"], acc["applied"], F.concat(acc["unmatched"], cell(here)), acc["ambiguous"])
        done = state(
            F.regexp_replace(acc["text"], pattern, placeholder(i["category"])),
            F.when(hits > 0, F.concat(acc["applied"], cell(hits))).otherwise(acc["applied"]),
            acc["unmatched"],
            F.when(here > hits, F.concat(acc["ambiguous"], cell(here - hits))).otherwise(acc["ambiguous"]),
        )
        return F.when(F.length(strip(i["text"])) <= 1, doubt).when(~F.contains(F.col(text), i["text"]), miss).when(here == 0, same).when(here > OFTEN, doubt).otherwise(done)

    return df.withColumn("redaction", F.aggregate(by_length, init, step))


def built_from_source(source: Column, redacted: Column) -> Column:
    """True if what stands between placeholders is there in the source, in order, white space folded."""
    marks = "|".join(f"\\[{p[1:-1]}\\]" for p in PLACEHOLDERS.values())
    parts = F.filter(F.transform(F.split(redacted, marks), fold_spaces), lambda p: F.length(p) > 0)
    hay = fold_spaces(source)
    init = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(acc, p):
        place = F.call_function("locate", p, hay, acc["at"])
        return F.struct(F.when(place > 0, place + F.length(p)).otherwise(acc["at"]).alias("at"), (acc["ok"] & (place > 0)).alias("ok"))

    return F.aggregate(parts, init, step)["ok"]


def redact_kind(text: Column, kind: str, category: str) -> Column:
    """Every match of the kind replaced by the category's placeholder; a text that cannot hold one is left alone."""
    return F.when(may_hold(text, kind), F.regexp_replace(text, f"(?U){PII[kind]}", PLACEHOLDERS[category].replace("$", "\\$"))).otherwise(text)


def redact_pages(pages: DataFrame, text: str, items: str) -> DataFrame:
    """pages with redaction (see redact_spans), leak and warns.

    A page leaks if a scan still finds something, if an item to redact is not in its text, or if what is left is not the source's own
    words in order. A page warns if an item was left for being ambiguous.
    """
    got = redact_spans(pages, text, items)
    r = F.col("redaction")
    leak = leaks(r["text"]) | (F.size(r["unmatched"]) > 0) | ~built_from_source(F.col(text), r["text"])
    return got.withColumns({"leak": F.coalesce(leak, F.lit(True)), "warns": F.size(r["ambiguous"]) > 0})


def redact_documents(pages: DataFrame, documents: DataFrame, doc: str, page: str, text: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(doc, redacted_text, items_redacted, categories, review_required) of documents that are fit, and (doc, error, pages) of the others.

    A document whose readings are not settled (`status`), without a page (`pages`), or with any page that leaks (`leak`, with these
    pages' numbers) is refused whole: no page of it comes out.
    """
    rows = pages.join(documents.filter(readable(documents)).select(doc), doc, "left_semi")
    done = redact_pages(rows, text, items)
    applied = F.col("redaction.applied")
    done = done.select(
        doc, page, F.col("redaction.text").alias("text"), F.aggregate(applied, F.lit(0).cast("long"), lambda n, a: n + a["count"]).alias("items"),
        F.transform(applied, lambda a: a["category"]).alias("categories"), F.transform("redaction.ambiguous", lambda a: a["text"]).alias("warnings"), "leak",
    )
    state = done.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("leak"), F.col(page)))).alias("pages"))
    fit = state.filter(F.size("pages") == 0).select(doc)
    got = redaction_rollup(done.join(fit, doc, "left_semi"), doc, page, "text", "items", "categories", "warnings")
    error = F.when(~readable(documents), "status").when(F.col("pages").isNull(), "pages").when(F.size("pages") > 0, "leak")
    refused = documents.join(state, doc, "left").select(doc, error.alias("error"), F.when(F.size("pages") > 0, F.col("pages")).alias("pages"))
    return got, refused.filter("error IS NOT NULL")


def gate(df: DataFrame, text: str, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, leaking) rows by what a scan still finds."""
    leak = F.coalesce(leaks(F.col(text), kinds), F.lit(False))
    return df.filter(~leak), df.filter(leak)
