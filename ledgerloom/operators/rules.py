"""Contract validation: a JSON Schema (draft 2020-12, the keywords that contracts use) compiled to one column of error codes.

The instance is a VARIANT column, so absent and null stay apart and unknown members are let through. References are resolved when
compiling; nothing is looked up at run time.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"string": "STRING%", "boolean": "BOOLEAN%", "object": "OBJECT<%", "array": "ARRAY<%", "null": "VOID%", "integer": "BIGINT%"}


class Node:
    """An instance and the name of its type, each worked out once: both are variables of a lambda that the node is bound to."""

    def __init__(self, v: Column, of: Column):
        self.v, self.of = v, of

    @staticmethod
    def bind(v: Column, check) -> Column:
        """check(node) for v, an array of errors; none if v is absent."""
        held = F.filter(F.array(F.struct(v.alias("v"), F.schema_of_variant(v).alias("of"))), lambda x: x["v"].isNotNull())
        return F.flatten(F.transform(held, lambda x: check(Node(x["v"], x["of"]))))

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.v, path, kind)


def _is(n: Node, kind: str) -> Column:
    if kind == "number":
        return n.of.like("BIGINT%") | n.of.like("DOUBLE%") | n.of.like("DECIMAL%") | n.of.like("FLOAT%")
    if kind == "integer":  # 1.0 is an integer
        x = n.get("$", "double")
        return _is(n, "number") & F.coalesce(x == F.floor(x), F.lit(False))
    return n.of.like(TYPES[kind])


def _text(n: Node) -> Column:
    return F.when(_is(n, "string"), n.get("$", "string"))


def _number(n: Node) -> Column:
    return F.when(_is(n, "number"), n.get("$", "double"))


def _error(bad: Column, path: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat_ws(": ", path, F.lit(code)))).otherwise(F.array().cast("array<string>"))


def _same(n: Node, values: list) -> Column:
    return F.to_json(n.v).isin([json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in values])


def errors(v: Column, schema, registry: dict[str, dict] | None = None) -> Column:
    """Sorted "path: keyword" strings, empty if the instance is valid; a null instance (no JSON) has the one error "$: json"."""
    found = F.array_sort(F.array_distinct(Node.bind(v, lambda n: _compile(n, schema, schema, registry or {}, F.lit("$")))))
    return F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(found)


KEYWORDS = set("$ref type enum const minimum maximum minLength pattern format required properties additionalProperties minItems maxItems items allOf anyOf not if then else".split())
ANNOTATIONS = set("$schema $id $defs $comment comment title description default examples definitions".split())  # these check nothing
CHECKED_FORMATS = ("date", "date-time")


def _compile(n: Node, s, root, registry: dict, path: Column) -> Column:
    none = F.array().cast("array<string>")
    if s is True:
        return none
    if s is False:
        return F.array(F.concat_ws(": ", path, F.lit("false")))
    if unknown := {k for k in set(s) - KEYWORDS - ANNOTATIONS if not k.startswith("x-")}:
        raise ValueError(f"no rule is known for {', '.join(sorted(unknown))}")
    if s.get("format", "date") not in CHECKED_FORMATS:
        raise ValueError(f"no rule is known for the format {s['format']}")
    out: list[Column] = []
    here = lambda part: _compile(n, part, root, registry, path)
    child = lambda x, part, at: Node.bind(x, lambda c: _compile(c, part, root, registry, at))
    ok = lambda part: F.size(here(part)) == 0
    if "$ref" in s:
        file, _, place = s["$ref"].partition("#")
        top = registry[file] if file else root
        part = top
        for key in filter(None, place.split("/")):
            part = part[key]
        out.append(_compile(n, part, top, registry, path))
    if "type" in s:
        kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
        fits = _is(n, kinds[0])
        for k in kinds[1:]:
            fits = fits | _is(n, k)
        out.append(_error(~fits, path, "type"))
    if "enum" in s:
        out.append(_error(~_same(n, s["enum"]), path, "enum"))
    if "const" in s:
        out.append(_error(~_same(n, [s["const"]]), path, "const"))
    for key, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b)):
        if key in s:
            out.append(_error(bad(_number(n), s[key]), path, key))
    if "minLength" in s:
        out.append(_error(F.length(_text(n)) < s["minLength"], path, "minLength"))
    if "pattern" in s:
        out.append(_error(~_text(n).rlike(s["pattern"]), path, "pattern"))
    if s.get("format") == "date":
        text = _text(n)
        out.append(_error(text.isNotNull() & (F.try_to_date(text, "yyyy-MM-dd").isNull() | ~text.rlike(r"^\d{4}-\d\d-\d\d$")), path, "format"))
    elif s.get("format") == "date-time":
        text = _text(n)
        out.append(_error(text.isNotNull() & (F.try_to_timestamp(text).isNull() | ~text.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")), path, "format"))
    member = lambda key: n.get(f"$['{key}']", "variant")
    for key in s.get("required", []):
        out.append(_error(_is(n, "object") & member(key).isNull(), path, f"required {key}"))
    for key, part in s.get("properties", {}).items():
        out.append(child(F.when(_is(n, "object"), member(key)), part, F.concat(path, F.lit(f".{key}"))))
    if s.get("additionalProperties", True) is not True:
        known = list(s.get("properties", {}))
        rest = F.map_entries(F.map_filter(n.get("$", "map<string,variant>"), lambda k, _: ~k.isin(known) if known else F.lit(True)))
        each = F.flatten(F.transform(rest, lambda e: child(e["value"], s["additionalProperties"], F.concat(path, F.lit("."), e["key"]))))
        out.append(F.when(_is(n, "object"), F.coalesce(each, none)).otherwise(none))
    list_of = F.when(_is(n, "array"), n.get("$", "array<variant>"))
    if "minItems" in s:
        out.append(_error(F.size(list_of) < s["minItems"], path, "minItems") if s["minItems"] else none)
    if "maxItems" in s:
        out.append(_error(F.size(list_of) > s["maxItems"], path, "maxItems"))
    if "items" in s:
        each = F.flatten(F.transform(list_of, lambda x, i: child(x, s["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        out.append(F.coalesce(each, none))
    out += [here(part) for part in s.get("allOf", [])]
    if "anyOf" in s:
        any_ok = F.lit(False)
        for part in s["anyOf"]:
            any_ok = any_ok | ok(part)
        out.append(_error(~any_ok, path, "anyOf"))
    if "not" in s:
        out.append(_error(ok(s["not"]), path, "not"))
    if "if" in s:
        out.append(F.when(ok(s["if"]), here(s.get("then", True))).otherwise(here(s.get("else", True))))
    return F.concat(*out) if out else none
