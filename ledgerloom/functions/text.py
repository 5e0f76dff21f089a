"""Text functions on columns. White space is Unicode's, as (?U) gives it, unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = r"(?dm)^<<<PAGE page=(\d+)>>>\n?"


def fold_widths(text: Column) -> Column:
    """Full-width digits, hyphen and full stop to ASCII (fixed values)."""
    return F.translate(text, "０１２３４５６７８９－．", "0123456789-.")


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def fold_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_phrase(text: Column) -> Column:
    """Curly quotes straight, white space folded, one layer of quotes around it gone."""
    folded = fold_spaces(F.translate(text, "“”", '""'))
    quoted = (F.length(folded) >= 2) & folded.startswith('"') & folded.endswith('"')
    return F.when(quoted, strip(F.substring(folded, F.lit(2), F.length(folded) - 2))).otherwise(folded)


def page_text(page: Column, text: Column) -> Column:
    return F.concat(F.lit("<<<PAGE page="), page.cast("string"), F.lit(">>>\n"), text)


def marked(pages: Column) -> Column:
    """One text of an array of (page, text), in page order."""
    sorted_pages = F.array_sort(pages)
    return F.concat(F.array_join(F.transform(sorted_pages, lambda p: page_text(p["page"], p["text"])), "\n"), F.lit("\n"))


def split_marked(text: Column) -> Column:
    """Array of (page, text) by the markers at line starts, in text order; what stands before the first is dropped. Only line feeds are stripped."""
    numbers = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    parts = F.slice(F.split(text, MARKER), 2, F.greatest(F.size(numbers), F.lit(1)))
    row = lambda n, t: F.struct(n.cast("long").alias("page"), F.regexp_replace(t, r"^\n+|\n+\z", "").alias("text"))
    return F.zip_with(numbers, parts, row)


def glob_regex(pattern: str) -> str:
    """A file name pattern (*, ?, [...]) as a regular expression for rlike."""
    import fnmatch

    return fnmatch.translate(pattern).replace("\\Z", "\\z").replace("(?s:", "(?s)(?:")


def file_format(name: Column, formats: dict[str, str]) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in formats.items() for x in kv)), F.nullif(ext, F.lit(""))), F.lit("other"))


def schema_name(file: Column, known: list[str]) -> Column:
    """Schema of a contract file by its name: without leading underscores, version, case and document; null if there is none."""
    stem = F.regexp_replace(F.regexp_replace(file, r"\.json$", ""), r"^_+", "")
    for tail in (r"_v\d+$", r"_CASE_\d+$", r"_DOC_\d+$"):
        stem = F.regexp_replace(stem, tail, "")
    stem = F.when(file.endswith(".evidence.json"), F.lit("evidence_sidecar")).otherwise(stem)
    return F.when(stem.isin(known), F.concat(stem, F.lit(".schema.json")))


def first_object(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def head(text: Column, n: int = 3000) -> Column:
    """The first characters, as a classifier is given them."""
    return F.substring(text, 1, n)


def tail(text: Column, n: int = 4000) -> Column:
    """The last characters, as a log view shows them."""
    return F.right(text, F.lit(n))


def provider_label(known: Column, provider: Column, model: Column) -> Column:
    """provider:model with a stand-in for what is missing; the default reader's name if nothing is known."""
    own = F.concat(F.coalesce(provider, F.lit("unknown-provider")), F.lit(":"), F.coalesce(model, F.lit("unknown-model")))
    return F.when(known, own).otherwise(F.lit("claude-cli"))  # fixed value


def elapsed(seconds: Column) -> Column:
    """Seconds as 12m 5s, or 5s below a minute; never below 0."""
    s = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    m, rest = F.floor(s / 60).cast("string"), (s % 60).cast("string")
    return F.when(s >= 60, F.concat(m, F.lit("m "), rest, F.lit("s"))).otherwise(F.concat(rest, F.lit("s")))
