"""Operators on small tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.functions.codes import SCHEMAS
from ledgerloom.operators import cases, pages, pii, replies, reports, reviews, rules
from ledgerloom.sources import files
from ledgerloom.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


LEAKS = [("900101-1234567", "resident_registration_number"), ("900101 -\n1234567", "resident_registration_number"), ("02-123-4567", "phone_number_separated"), ("(02) 123 4567", "phone_number_separated"), ("010-1234-\n5678", "phone_number_separated"), ("０１０－１２３４－５６７８", "phone_number_separated"), ("0212345678", "phone_number_contiguous"),
         ("123-45-67890", "account_number_dashed"), ("홍hong@example.co.kr", "email"), ("경기77나1203", "vehicle_number"), ("12가 3456", "vehicle_number"), ("12345678901", "long_digit_run")]
CLEAN = ["2024-01-31", "1,234,567원", "I67.8", "제3조 제2항", "12개 1234", "1234567890", "2025.02.03 - 2025.02.28", "a @ b"]


@pytest.mark.parametrize("text,kind", LEAKS)
def test_pii_is_found(spark, text, kind):
    got = pii.scan(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").collect()
    assert kind in {r.kind for r in got}


def test_clean_text_has_no_pii(spark):
    got = pii.scan(spark.createDataFrame([(t,) for t in CLEAN], "t string"), "t", "t").collect()
    assert got == []


def redact(spark, text, *items):
    df = spark.createDataFrame([(text, [(t, c) for t, c in items])], "t string, items array<struct<text:string,category:string>>")
    return pii.redact_spans(df, "t", "items").select("redaction.*").first()


def test_spans_longest_first_and_accounted(spark):
    r = redact(spark, "홍길동 홍길동병원 hong@x.kr a+b (c)", ("홍", "person_name"), ("홍길동", "person_name"), ("hong@x.kr", "email"), ("x.kr", "email"), ("nobody", "person_name"), ("a+b (c)", "strange"), ("홍길동", "email"), (" ", "email"))
    assert r.text == "[PERSON_NAME] 홍길동병원 [EMAIL] [OTHER_PII]"
    assert [(a.text, a["count"]) for a in r.applied] == [("hong@x.kr", 1), ("a+b (c)", 1), ("홍길동", 1)]
    assert [u.text for u in r.unmatched] == ["nobody"] and {a.text for a in r.ambiguous} == {"홍길동", "홍"}


def test_frequent_spans_are_left(spark):
    r = redact(spark, "ab " * 21, ("ab", "email"))
    assert r.text == "ab " * 21 and r.ambiguous[0]["count"] == 21


def test_redaction_is_built_from_source(spark):
    df = spark.createDataFrame([("a b c", "a [EMAIL] c", True), ("a b c", "c [EMAIL] a", False), ("a\nb", "a b", True), ("x", "[EMAIL]", True)], "s string, r string, ok boolean")
    assert df.filter(pii.built_from_source(F.col("s"), F.col("r")) != F.col("ok")).count() == 0


@pytest.mark.parametrize("raw,want", [('  "a  b" ', "a b"), ("“a”", "a"), ('""a""', '"a"'), ('"', '"'), ("a　\n b", "a b"), ("", "")])
def test_normal_phrase(spark, raw, want):
    assert one(spark, tx.normal_phrase(F.lit(raw))) == want


@pytest.mark.parametrize("text,want", [("<<<PAGE page=1>>>\na\n\n<<<PAGE page=3>>>\nb\n", [(1, "a"), (3, "b")]), ("pre\n<<<PAGE page=2>>>\nx <<<PAGE page=9>>> y", [(2, "x <<<PAGE page=9>>> y")]), ("none", []), ("<<<PAGE page=1>>>\n\n a\r\n", [(1, " a\r")])])
def test_marker_split(spark, text, want):
    got = one(spark, tx.split_marked(F.lit(text)))
    assert [(p.page, p.text) for p in got] == want


def test_page_order(spark):
    rows = [(d, i, p) for d, ps in {"ok": [1, 2, 5], "down": [1, 3, 2], "twice": [1, 1], "zero": [0, 1]}.items() for i, p in enumerate(ps)]
    got = pages.pages_in_order(spark.createDataFrame(rows, "d string, pos int, page int"), "d", "pos", "page").collect()
    assert {r.d: r.valid for r in got} == {"ok": True, "down": False, "twice": False, "zero": False}


@pytest.mark.parametrize("said,want", [("AGREE", "agreed"), ("DISAGREE", "disagreed"), ("AGREE... no, DISAGREE", "disagreed"), ("?", "disagreed"), (None, "disagreed"), ("AGREE입니다", "disagreed")])
def test_verdicts(spark, said, want):
    assert one(spark, pages.parse_verdict(F.lit(said).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("critic_result_v2.json", "critic_result"), ("_source_ledger.json", "source_ledger"), ("draft_report_v1.evidence.json", "evidence_sidecar"), ("normalized_policy_clause_DOC_004.json", "normalized_policy_clause"), ("what.json", None)])
def test_schema_names(spark, name, want):
    assert one(spark, tx.schema_name(F.lit(name), SCHEMAS)) == (want and f"{want}.schema.json")


@pytest.mark.parametrize("spec,want", [("a:b.pdf:1-13=raw", ("a:b.pdf", 1, 13, "raw", None)), ("a.pdf:3-2=raw", ("a.pdf", 3, 2, "raw", "range")), ("a.pdf:0-2=raw", ("a.pdf", 0, 2, "raw", "range")), ("a.pdf:1-2=other", (None, None, None, None, "form")), ("a.pdf", (None, None, None, None, "form"))])
def test_split_specs(spark, spec, want):
    assert tuple(one(spark, cases.parse_split(F.lit(spec)))) == want


def test_gates_differ_on_absent_ledgers(spark):
    ledger = spark.createDataFrame([("a", "f", "approved"), ("b", "f", "approved"), ("b", "g", None)], "case string, file string, status string")
    every = spark.createDataFrame([("a",), ("b",), ("c",)], "case string")
    for absent in (True, False):
        got = cases.ledger_gate(ledger, every, "case", "file", "status", "approved", absent).collect()
        assert {r.case: r.clear for r in got} == {"a": True, "b": False, "c": absent}


def test_files_are_classed_and_numbered(spark):
    df = spark.createDataFrame([("c", n) for n in ("b.PDF", "a.txt", ".DS_Store", "x 지급내역 1.xlsx", "z")], "case string, name string")
    got = cases.assign_ids(cases.classify_files(df, "name"), "case", "name").collect()
    assert {(r.name, r.document_id, r.file_format) for r in got} == {("a.txt", "DOC_001", "text"), ("b.PDF", "DOC_002", "pdf"), ("z", "DOC_003", "other"), ("x 지급내역 1.xlsx", "GT_001", "spreadsheet")}


def test_ids_past_999_are_not_cut(spark):
    df = spark.range(1012).select(F.lit("c").alias("case"), F.format_string("f%05d", "id").alias("name"), F.lit("raw").alias("classification"), (F.col("id") < 2).alias("is_split"))
    whole = {r.name: r.document_id for r in cases.assign_ids(df.drop("is_split"), "case", "name").collect()}
    parts = {r.name: r.document_id for r in cases.assign_ids(df, "case", "name").collect()}
    assert len(set(whole.values())) == len(set(parts.values())) == 1012
    assert (whole["f00000"], whole["f00998"], whole["f00999"], parts["f00002"], parts["f00001"]) == ("DOC_001", "DOC_999", "DOC_1000", "DOC_001", "DOC_1012")


def test_citations(spark):
    assert one(spark, reports.fill_citations(F.lit("a {{E}} b {{E}}"), F.lit(3))) == "a [E3] b [E4]"
    got = one(spark, reports.tag_check(F.lit("[E1] [E2] [E2]"), F.array(F.lit(2), F.lit(5)).cast("array<bigint>")))
    assert (got.orphaned, got.unused) == ([1], [5])


def test_phrases_over_soft_wraps(spark):
    docs = spark.createDataFrame([(1, "x\nsay  the word now"), (2, "say the\nword"), (3, "say word")], "id int, t string")
    got = reports.phrase_hits(docs, spark.createDataFrame([(9, "“the word”")], "p int, s string"), "id", "t", "p", "s").collect()
    assert {(r.id, r.line) for r in got} == {(1, 2), (2, None)}


SCHEMA = {
    "$defs": {"code": {"type": "string", "pattern": "^R[0-9]+$"}}, "type": "object", "required": ["a"], "additionalProperties": {"type": "number"},
    "properties": {"a": {"$ref": "#/$defs/code"}, "b": {"type": ["string", "null"], "minLength": 2}, "c": {"type": "array", "maxItems": 2, "items": {"anyOf": [{"const": 1}, {"type": "string", "format": "date"}]}}, "d": {"$ref": "other.json#/$defs/x"}, "e": {"not": {"const": 5}}},
    "allOf": [{"if": {"properties": {"b": {"const": "yes"}}, "required": ["b"]}, "then": {"required": ["c"]}}],
}
OTHER = {"other.json": {"$defs": {"x": {"type": "integer", "minimum": 3, "maximum": 4}}}}
INSTANCES = [('{"a":"R1"}', []), ('{"a":"x"}', ["$.a: pattern"]), ("{}", ["$: required a"]), ('{"a":null}', ["$.a: type"]), ("[]", ["$: type"]), ("nonsense", ["$: json"]), ('{"a":"R1","b":null,"z":1.5}', []), ('{"a":"R1","b":"x","z":"s"}', ["$.b: minLength", "$.z: type"]),
             ('{"a":"R1","b":"yes"}', ["$: required c"]), ('{"a":"R1","c":[1,"2025-02-28","2025-02-30"]}', ["$.c: maxItems", "$.c[2]: anyOf"]), ('{"a":"R1","d":2}', ["$.d: minimum"]), ('{"a":"R1","d":4.0}', []), ('{"a":"R1","d":3.5}', ["$.d: type"]), ('{"a":"R1","e":5}', ["$.e: not"])]


def test_validator(spark):
    df = spark.createDataFrame(INSTANCES, "j string, want array<string>")
    got = df.select("j", "want", rules.errors(F.try_parse_json("j"), SCHEMA, OTHER).alias("got")).collect()
    assert [(r.j, r.got) for r in got] == [(r.j, r.want) for r in got]


def test_sources_and_sinks(spark, tmp_path):
    at = tmp_path / "case"
    at.mkdir()
    (at / "a.json").write_text('{\n"a": "R1"}')
    (at / "b.json").write_text("{broken")
    (at / "k.txt").write_bytes("보험금 청구".encode("cp949"))
    (at / "page_007.md").write_text("seven")
    assert {r.name for r in files.list_files(spark, str(at)).collect()} == {"a.json", "b.json", "k.txt", "page_007.md"}
    contracts = files.read_contracts(spark, str(at))
    assert {r.name: r.bad for r in contracts.select("name", F.col("data").isNull().alias("bad")).collect()} == {"a.json": False, "b.json": True}
    valid, rejected = files.quarantine(contracts.select("name", "json"), "json", SCHEMA, str(tmp_path / "out"), OTHER)
    assert [spark.read.parquet(p).first().name for p in (valid, rejected)] == ["a.json", "b.json"]
    raw = spark.read.format("binaryFile").load(str(at / "k.txt")).select("content")
    assert files.decode_korean(raw, "content").select("text", "encoding").first() == ("보험금 청구", "cp949")
    assert [(r.page, r.text) for r in files.read_page_texts(spark, str(at)).collect()] == [(7, "seven")]
    (at / "p.md").write_text("x\n| a | b |\n| --- | --- |\n| \"one\" | y |\n|  | z |\n")
    assert [r.phrase for r in files.read_phrases(spark, str(at / "p.md")).collect()] == ["one"]


def test_stream_fold_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.when(F.col("event_type") == "error", "failed").otherwise("in_progress").alias("status"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = state.start_fold(state.read_events(spark, str(tmp_path / "in"), events.schema), ["user_id"], "status", "event_id", "folded", str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = cases.fold_run_state(events, ["user_id"], "status", "event_id")
    assert spark.table("folded").exceptAll(batch).count() == 0 and spark.table("folded").count() == batch.count()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
    assert json.dumps(sorted(e.queries()))


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_ledger_decisions_need_a_name_or_a_reason(spark):
    entries = rows(spark, "file string", ("a",), ("b",), ("c",), ("d",))
    log = rows(
        spark, "file string, at int, status string, reviewer string, reason string", ("a", 1, "approved", "kim", "ok"), ("a", 2, "approved", " ", None), ("b", 1, "rejected", None, "blank"), ("b", 2, "pending", None, None), ("c", 1, "rejected", "kim", None), ("x", 1, "approved", "kim", None), ("c", 2, None, "kim", None), ("d", 5, "rejected", None, "old")
    )
    got, refused = reviews.decide_ledger(entries, log, ["file"], "at")
    assert sorted((r.file, r.review_status, r.reviewed_by, r.rejection_reason) for r in got.collect()) == [("a", "approved", "kim", None), ("b", "pending", None, None), ("c", "pending", None, None), ("d", "rejected", None, "old")]
    assert sorted((r.file, r.at, r.error) for r in refused.collect()) == [("a", 2, "reviewer"), ("c", 1, "reason"), ("c", 2, "status"), ("x", 1, "not found")]


def test_conflicts_need_two_sources_and_verdicts_a_note(spark):
    raised = rows(spark, "case_id string, at int, sources array<string>", ("p", 1, ["a", "b"]), ("p", 2, ["a"]), ("p", 3, ["a", "c"]), ("q", 1, ["a", "b"]), ("q", 2, None))
    made, refused = reviews.raise_conflicts(raised, "case_id", ["at"], "sources")
    assert sorted((r.case_id, r.at, r.conflict_id) for r in made.collect()) == [("p", 1, "CONFLICT_1"), ("p", 3, "CONFLICT_2"), ("q", 1, "CONFLICT_1")] and refused.count() == 2
    said = rows(spark, "case_id string, conflict_id string, at int, verdict string, note string", ("p", "CONFLICT_1", 1, "resolved", "a is right"), ("p", "CONFLICT_2", 1, "false_positive", ""), ("p", "CONFLICT_9", 1, "resolved", "x"), ("q", "CONFLICT_1", 1, "resolved", "x"), ("q", "CONFLICT_1", 2, "pending", None))
    got, bad = reviews.settle_conflicts(made.select("case_id", "conflict_id", "verdict"), said, ["case_id", "conflict_id"], "at")
    assert sorted((r.case_id, r.conflict_id, r.verdict) for r in got.collect()) == [("p", "CONFLICT_1", "resolved"), ("p", "CONFLICT_2", "pending"), ("q", "CONFLICT_1", "pending")]
    assert sorted(r.error for r in bad.collect()) == ["not found", "note"]


def test_answer_key_opens_after_a_valid_review(spark):
    found = rows(spark, "case_id string, version string, errors array<string>", ("p", "v1", []), ("p", "v2", ["$: json"]))
    flags, blocked = reviews.complete_reviews(rows(spark, "case_id string, version string", ("p", "v1"), ("p", "v2"), ("q", "v1")), found, "errors")
    assert blocked.count() == 2
    asked = rows(spark, "case_id string, version string, caller_stage string", ("p", "v1", "evaluation"), ("p", "v2", "evaluation"), ("p", "v1", "draft"), ("p", "v1", None))
    assert sorted(r.access for r in reviews.truth_access(asked, flags).collect()) == ["allowed", "denied: review", "denied: stage", "denied: stage"]


def test_documents_for_experts_show_no_text(spark):
    docs = rows(spark, "doc string, downstream_disposition string", ("a", None), ("b", "expert_review_only"), ("c", None))
    got = reviews.document_texts(docs, rows(spark, "doc string, text string", ("a", "A"), ("b", "B")), ["doc"], "text")
    assert sorted((r.doc, r.access, r.text) for r in got.collect()) == [("a", "ok", "A"), ("b", "expert_review_only", None), ("c", "not_extracted", None)]


def test_blocked_documents_lose_what_reading_set(spark):
    docs = rows(spark, "doc string, ocr_status string, document_type string, note string, pages int, bad boolean, n int, state string", ("a", "done", "receipt", "x", 1, True, 4, "disagreed"), ("b", "done", "receipt", "y", 1, None, 4, "disagreed"))
    got = {r.doc: r for r in reviews.reset_blocked(docs, "bad", "n", "state").collect()}
    assert (got["a"].ocr_status, got["a"].document_type, got["a"].note, got["a"].pages) == ("failed", None, "x", 4)
    assert (got["b"].ocr_status, got["b"].document_type, got["b"].pages) == ("done", "receipt", 1)


def test_fork_sources_are_one_snapshot(spark):
    kept = rows(spark, "case_id string, step int, path string", ("p", 1, "p1"), ("p", 2, "p2"), ("p", 2, "p2b"))
    got = reviews.fork_source(kept, rows(spark, "case_id string, step int", ("p", 1), ("p", 2), ("p", 3)), "step")
    assert sorted((r.step, r.path, r.error) for r in got.collect()) == [(1, "p1", None), (2, None, "ambiguous"), (3, None, "none")]


def test_uncertain_regions_without_confidence(spark):
    got = reviews.uncertain_rollup(rows(spark, "doc int, regions array<string>, c double", (1, ["x"], 0.5), (1, None, None), (2, [], None)), "doc", "regions", "c")
    assert sorted((r.doc, r.uncertain_region_count, r.document_mean_confidence) for r in got.collect()) == [(1, 1, 0.5), (2, 0, None)]


def test_code_lists_are_compared_both_ways(spark):
    got = reviews.codebook_drift(rows(spark, "code string", ("a",), ("b",)), rows(spark, "code string", ("b",), ("c",)))
    assert sorted((r.code, r.side) for r in got.collect()) == [("a", "left"), ("c", "right")]
    assert one(spark, reviews.stage_key(F.lit("Draft-Report_v 1"))) == "draftreportv1"


REPLIES = [
    (None, None, "not JSON"), ("", None, "not JSON"), ("{", None, "invalid JSON"), ("{]{", None, "invalid JSON"), ("[1]", None, "not JSON"), ('{"pii_items": {}}', None, "shape"), ('{"a": 1} {"pii_items": []}', None, "shape"),
    ('{"pii_items": [1]}', None, "shape"), ('{"pii_items": [{"text": null}]}', None, "shape"), ('{"pii_items": [null]}', None, "shape"), ('{{"pii_items": [{"text": "a{b"}]}} done', [("a{b", "other_pii")], None),
    ('ok {x} {"pii_items": [{"text": "홍", "category": "person_name"}, {"text": "", "category": 3}]} {', [("홍", "person_name"), ("", "other_pii")], None),
]


def test_spans_of_replies(spark):
    df = rows(spark, "n int, reply string", *((n, r) for n, (r, _, _) in enumerate(REPLIES)))
    got = {r.n: (r.got.items if r.got["items"] is None else [tuple(i) for i in r.got["items"]], r.got.error) for r in df.select("n", replies.pii_items(F.col("reply")).alias("got")).collect()}
    assert [(v[0] if isinstance(v[0], list) else None, v[1]) for _, v in sorted(got.items())] == [(i, e) for _, i, e in REPLIES]


def test_types_of_replies(spark):
    cases_ = [(None, "not JSON"), ("none", "not JSON"), ("{a}", "invalid JSON"), ('{"predicted_document_type": "receipt"} {}', "invalid JSON"), ('{"predicted_document_type": 3}', "unknown type"), ("{}", "unknown type"), ('so {"predicted_document_type": "receipt"}', None)]
    df = rows(spark, "n int, reply string", *((n, r) for n, (r, _) in enumerate(cases_)))
    got = [r.got for r in df.select("n", replies.classification(F.col("reply")).alias("got")).orderBy("n").collect()]
    assert [g.error for g in got] == [e for _, e in cases_]
    assert (got[-1].predicted_document_type, got[-1].confidence, got[-1].document_type_label) == ("receipt", 0.5, "")


def test_readers_of_one_kind(spark):
    got = one(spark, replies.reader_independence(F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit("n/a")))
    assert (got.mode, got.same_reader) == ("single_technology_weak_p8_poc", True)


def test_writes_are_whole_or_nothing(spark, tmp_path):
    at, log = str(tmp_path / "c" / "t"), str(tmp_path / "log")
    good, bad = '{"k": 1}', '{"k": "x"}'
    schema = {"type": "object", "properties": {"k": {"type": "integer"}}}
    make = lambda *json: rows(spark, "name string, json string", *((str(i), j) for i, j in enumerate(json)))
    assert files.write_checked(make(good, good), "json", schema, at).count() == 0 and spark.read.parquet(at).count() == 2
    refused = files.write_stage(make(good, bad, good), "json", schema, at, log, {"case_id": "A", "stage": "s", "at": 1})
    assert [r.name for r in refused.collect()] == ["1"] and spark.read.parquet(at).count() == 2 and not files.there(spark, log)
    assert files.write_stage(make(good), "json", schema, at, log, {"case_id": "A", "stage": "s", "at": 2}).isEmpty()
    assert spark.read.parquet(at).count() == 1 and spark.read.parquet(log).first().status == "passed"
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["t"]  # nothing staged is left


def test_pages_are_partitioned_and_read_one_by_one(spark, tmp_path):
    at = str(tmp_path / "pages")
    files.write_pages(rows(spark, "case_id string, document_id string, page long, text string", ("A", "D1", 1, "x"), ("A", "D1", 2, "y"), ("B", "D1", 1, "z")), at)
    assert sorted(p.name for p in (tmp_path / "pages").iterdir() if "=" in p.name) == ["case_id=A", "case_id=B"]
    pages_ = files.read_or_empty(spark, at, "case_id string, document_id string, page long, text string")
    assert [r.text for r in files.read_page(pages_, "A", "D1", 2).collect()] == ["y"] and files.read_page(pages_, "A", "D2", 1).isEmpty()
    with pytest.raises(ValueError):
        files.read_page(pages_, "A", "D1", 0)
    assert files.read_or_empty(spark, str(tmp_path / "none"), "a long").count() == 0
    files.write_text(rows(spark, "name string, text string, more int", ("draft", "t", 1)), str(tmp_path / "texts"))
    assert spark.read.parquet(str(tmp_path / "texts")).columns == ["name", "text"]


def test_directories_of_contracts_are_validated(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "c").mkdir()
    (tmp_path / "s" / "base.schema.json").write_text('{"$defs": {"id": {"type": "string", "pattern": "^[A-Z]+$"}}}')
    (tmp_path / "s" / "critic_result.schema.json").write_text('{"type": "object", "required": ["id"], "properties": {"id": {"$ref": "base.schema.json#/$defs/id"}}}')
    for name, body in (("critic_result_v2.json", '{"id": "A"}'), ("critic_result_v1.json", '{"id": "a"}'), ("other.json", "{}"), ("critic_result.json", "{broken")):
        (tmp_path / "c" / name).write_text(body)
    known = files.read_schemas(spark, str(tmp_path / "s"))
    got = files.validated(files.read_contracts(spark, str(tmp_path / "c")), known)
    assert {r.name: (r.result, r.errors) for r in got.collect()} == {"critic_result_v2.json": ("PASS", []), "critic_result_v1.json": ("FAIL", ["$.id: pattern"]), "other.json": ("SKIP", []), "critic_result.json": ("FAIL", ["$: json"])}
    assert files.exit_code(got) == 1 and files.exit_code(got.filter("result <> 'FAIL'")) == 0 and files.exit_code(got.filter("result = 'SKIP'")) == 2
    with pytest.raises(ValueError):
        files.exit_code(got.limit(0))
    listed = files.list_files(spark, str(tmp_path / "c"))
    assert [r.name for r in files.chosen(listed, ["other*", "*_v1.json"]).collect()] == ["critic_result_v1.json", "other.json"]
    with pytest.raises(ValueError):
        files.chosen(listed, ["*.pdf"])


def test_unknown_schema_keywords_are_refused():
    from ledgerloom.operators import rules

    for schema in ({"minProperties": 1}, {"properties": {"a": {"format": "uri"}}}, {"items": {"uniqueItems": True}}):
        with pytest.raises(ValueError):
            rules.errors(F.lit(None).cast("variant"), schema)


def test_waits_close_the_latest_open_one(spark):
    kinds = "w w r r r w r"
    events = rows(spark, "case_id string, kind string, at int", *(("a", k, i) for i, k in enumerate(kinds.split())), ("b", "r", 0), ("b", "w", 1))
    got = cases.pair_waits(events, ["case_id"], "kind", "at", "w", "r")
    assert sorted((r.at, r.waited_at) for r in got.collect()) == [(2, 1), (3, 0), (6, 5)]


def test_an_empty_phrase_list_is_an_error(spark):
    docs = rows(spark, "doc string, text string", ("a", "some text"))
    for phrases in ([], [("p", " ")]):
        with pytest.raises(ValueError):
            reports.phrase_hits(docs, spark.createDataFrame(phrases, "id string, phrase string"), "doc", "text", "id", "phrase")


def test_phrases_of_every_length_are_found(spark):
    docs = rows(spark, "doc string, text string", ("a", "one two three four five"), ("b", "xone two three fourx"), ("c", "nothing\nhere"), ("d", None))
    phrases = rows(spark, "id string, phrase string", ("long", "one two three four"), ("short", "three"), ("lines", "nothing here"))
    got = reports.phrase_hits(docs, phrases, "doc", "text", "id", "phrase")
    assert sorted((r.doc, r.id, r.line) for r in got.collect() if r.id != "lines") == [("a", "long", 1), ("a", "short", 1), ("b", "long", 1), ("b", "short", 1)]
    assert [(r.doc, r.line) for r in got.collect() if r.id == "lines"] == [("c", None)]


def test_a_case_without_chunks_and_exclusions_is_an_error(spark):
    none = spark.createDataFrame([], "document string")
    assert [(r.document, r.error) for r in pages.covered(none, none, "document").collect()] == [(None, "empty")]


def test_one_leaking_page_refuses_its_document(spark):
    items = "array<struct<text:string,category:string>>"
    listed = rows(spark, f"doc string, page int, text string, items {items}", ("a", 1, "call a@b.co", [("a@b.co", "email")]), ("a", 2, "and c@d.co", []), ("b", 1, "x a@b.co", [("a@b.co", "email"), ("nobody", "person_name")]), ("c", 1, "fine a@b.co", [("a@b.co", "email")]), ("d", 1, "fine", []))
    docs = rows(spark, "doc string, cross_validation_status string", *((d, "agreed") for d in "abc"), ("d", None), ("e", "disagreed_resolved"))
    good, refused = pii.redact_documents(listed, docs, "doc", "page", "text", "items")
    assert [(r.doc, r.redacted_text, r.items_redacted, r.categories) for r in good.collect()] == [("c", "<<<PAGE page=1>>>\nfine [EMAIL]\n", 1, ["email"])]
    assert {r.doc: (r.error, r.pages) for r in refused.collect()} == {"a": ("leak", [2]), "b": ("leak", [1]), "d": ("status", None), "e": ("pages", None)}
