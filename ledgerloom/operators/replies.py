"""Model replies: spans and types read out of free text, with the error where they are not what was asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.codes import DOCUMENT_TYPES, PLACEHOLDERS
from ledgerloom.functions.text import first_object


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once: it is the variable of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).like(kind), F.lit(False))


def _string(value: Column, path: str) -> Column:
    """The string at a path; null if there is none or it is of another type."""
    inner = F.try_variant_get(value, path, "variant")
    return F.when(_is(inner, "STRING"), F.try_variant_get(value, path, "string"))


def _first_value(text: Column) -> Column:
    """The value that begins at the first brace where one can be read, what follows it left aside; null if there is none.

    A fold over the braces: no later one is tried once a value is found.
    """
    parts = F.split(text, r"\{", -1)
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(state, part):
        at = state["at"] + F.length(part) + 1
        return F.struct(at.alias("at"), F.coalesce(state["found"], F.try_parse_json(F.substr(text, at))).alias("found"))

    return F.aggregate(before, F.struct(F.lit(0).alias("at"), F.lit(None).cast("variant").alias("found")), step, lambda state: state["found"])


def pii_items(reply: Column) -> Column:
    """(items: array of (text, category), error) of a reply that should hold {"pii_items": [{"text", "category"}]}.

    A category that is not listed becomes other_pii. error is null, `not JSON` (no brace), `invalid JSON` or `shape` (no array, or an
    entry without a string as text); items are null beside an error. A null reply is not JSON.
    """
    brace = F.coalesce(F.contains(reply, F.lit("{")), F.lit(False))

    def item(entry):
        listed = lambda c: F.when(c.isin(*PLACEHOLDERS), c).otherwise("other_pii")
        return F.struct(_string(entry, "$.text").alias("text"), _bound(_string(entry, "$.category"), listed).alias("category"))

    def checked(items, value):
        shaped = F.coalesce(~F.exists(items, lambda i: i["text"].isNull()), F.lit(False))
        error = F.when(~brace, "not JSON").when(value.isNull(), "invalid JSON").when(~shaped, "shape")
        return F.struct(F.when(error.isNull(), items).alias("items"), error.alias("error"))

    def read(value):
        entries = F.when(_is(value, "OBJECT<%"), F.try_variant_get(value, "$.pii_items", "array<variant>"))
        return _bound(F.transform(entries, item), lambda items: checked(items, value))

    return _bound(F.when(brace, _first_value(reply)), read)


def classification(reply: Column) -> Column:
    """(predicted_document_type, document_type_label, confidence, quote, error) of a reply.

    All from the first { to the last } must be one JSON object, and its type a listed one; else the error is `not JSON`, `invalid JSON`
    or `unknown type` and the fields are null. Without them, confidence is 0.5, label and quote are empty.
    """
    body = first_object(reply)
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1

    def read(value):
        return _bound(_string(value, "$.predicted_document_type"), lambda kind: typed(value, kind))

    def typed(value, kind):
        error = F.when(body.isNull(), "not JSON").when(value.isNull(), "invalid JSON").when(~F.coalesce(kind.isin(DOCUMENT_TYPES), F.lit(False)), "unknown type")
        good = lambda c: F.when(error.isNull(), c)
        return F.struct(
            good(kind).alias("predicted_document_type"),
            good(F.coalesce(_string(value, "$.document_type_label"), F.lit(""))).alias("document_type_label"),
            good(F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.5))).alias("confidence"),
            good(F.coalesce(_string(value, "$.quote"), F.lit(""))).alias("quote"),
            error.alias("error"),
        )

    return _bound(F.when(whole, F.try_parse_json(body)), read)


def reader_independence(provider_a: Column, model_a: Column, provider_b: Column, model_b: Column) -> Column:
    """(mode, same_reader) of two readers: no pair is of two technologies yet, so the mode is always the weak one."""
    label = lambda p, m: F.concat(p, F.lit(" "), F.coalesce(m, F.lit("n/a")))
    return F.struct(F.lit("single_technology_weak_p8_poc").alias("mode"), (label(provider_a, model_a) == label(provider_b, model_b)).alias("same_reader"))
