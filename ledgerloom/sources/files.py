"""Sources and sinks: case files, JSON contracts, texts in old charsets, and writes that keep bad rows apart."""

from __future__ import annotations

import uuid
from functools import reduce
from json import loads

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import glob_regex, schema_name
from ledgerloom.operators.rules import errors


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, length) of every file below root whose name fits the glob; contents are not read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return got.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def read_contracts(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, json, data): every .json file below root, whole, with its value as VARIANT; null data where it is no JSON."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.input_file_name()
    return got.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("value").alias("json"), F.try_parse_json("value").alias("data"))


def read_page_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, page, text) of page_NNN.md files."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.md").text(root, wholetext=True)
    return got.select(F.input_file_name().alias("path"), F.regexp_extract(F.input_file_name(), r"page_(\d+)\.md$", 1).cast("long").alias("page"), F.col("value").alias("text"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(pos, phrase): first column of a Markdown table, without its header, its rule and empty cells."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    cell = F.regexp_replace(F.trim(F.split("line", r"\|").getItem(1)), r'^["“]|["”]$', "")
    rows = rows.filter(F.col("line").rlike(r"^\s*\|")).select("pos", cell.alias("phrase"))
    rule = rows.filter(F.col("phrase").rlike(r"^[-: ]+$")).agg(F.min("pos").alias("rule"))
    return rows.join(rule, F.col("pos") > F.col("rule")).filter("phrase <> '' AND NOT phrase RLIKE '^[-: ]+$'").select("pos", "phrase")


def decode_korean(files: DataFrame, content: str) -> DataFrame:
    """files with text and encoding: utf-8-sig, cp949 and euc-kr are tried in order; nulls if none fits or the text is blank."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, names = [], []
            for raw in b.column(content).to_pylist():
                text = name = None
                for e in ("utf-8-sig", "cp949", "euc-kr") if raw is not None else ():
                    try:
                        text, name = raw.decode(e), e
                        break
                    except UnicodeDecodeError:
                        continue
                blank = text is None or not text.strip()
                texts.append(None if blank else text)
                names.append(None if blank else name)
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string()), pa.array(names, pa.string())], [*b.schema.names, "text", "encoding"])

    return files.mapInArrow(run, ", ".join([*kept, "text string", "encoding string"]))


def chosen(files: DataFrame, patterns: list[str]) -> DataFrame:
    """files whose name fits any of the patterns, by path; ValueError if none does."""
    fits = reduce(lambda a, b: a | b, [F.col("name").rlike(glob_regex(p)) for p in patterns], F.lit(False))
    got = files.filter(fits)
    if got.isEmpty():
        raise ValueError(f"no file fits {', '.join(patterns)}")
    return got.orderBy("path")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def there(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, or one without rows where there is none."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def read_page(pages: DataFrame, case: str, document: str, page: int) -> DataFrame:
    """The one page of pages (case_id, document_id, page, ...), or no row; a page below 1 is refused with ValueError."""
    if page < 1:
        raise ValueError(f"page must be >= 1 (got {page})")
    return pages.filter((F.col("case_id") == case) & (F.col("document_id") == document) & (F.col("page") == page))


def write_whole(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes df beside the path and then renames it into place: readers see the old table or the whole new one."""
    spark = df.sparkSession
    fs, at = _path(spark, path)
    staged, old = (_path(spark, f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}")[1] for kind in ("new", "old"))
    try:
        df.write.partitionBy(*(by or [])).parquet(str(staged))
        if fs.exists(at):
            fs.rename(at, old)
        elif at.getParent() is not None:
            fs.mkdirs(at.getParent())
        if not fs.rename(staged, at):
            if fs.exists(old):
                fs.rename(old, at)
            raise OSError(f"{path} could not be put in place")
    finally:
        for left in (staged, old):
            if fs.exists(at) and fs.exists(left):
                fs.delete(left, True)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page or redacted texts (case_id, document_id, ...) as a table partitioned by both."""
    write_whole(pages, path, ["case_id", "document_id"])


def write_text(texts: DataFrame, path: str) -> None:
    """Free texts (name, text), such as a draft or its reviewed version, whole or not at all."""
    write_whole(texts.select("name", "text"), path)


def read_schemas(spark: SparkSession, root: str) -> dict[str, dict]:
    """File name to schema of every .schema.json below root: a short list, which the validator resolves references in."""
    got = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.schema.json").text(root, wholetext=True)
    rows = got.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return {r.name: loads(r.value) for r in rows}


def validated(contracts: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """contracts (path, name, data, ...) with schema, errors and result: PASS, FAIL, or SKIP where no schema is known for the name."""
    got = contracts.withColumn("schema", schema_name(F.col("name"), sorted(n.removesuffix(".schema.json") for n in registry)))
    parts = [got.filter(F.col("schema") == n).withColumn("errors", errors(F.col("data"), s, registry)) for n, s in sorted(registry.items())]
    parts.append(got.filter("schema IS NULL").withColumn("errors", F.array().cast("array<string>")))
    result = F.when(F.col("schema").isNull(), "SKIP").when(F.size("errors") > 0, "FAIL").otherwise("PASS")
    return reduce(DataFrame.unionByName, parts).withColumn("result", result)


def exit_code(results: DataFrame) -> int:
    """Of a validation: 1 if anything fails, 2 if all was skipped, else 0; ValueError if there was nothing to validate."""
    n = results.agg(*(F.count_if(F.col("result") == r).alias(r) for r in ("PASS", "FAIL", "SKIP"))).first()
    if not sum(n):
        raise ValueError("nothing to validate")
    return 1 if n.FAIL else 2 if not n.PASS else 0


def write_checked(rows: DataFrame, json: str, schema: dict, path: str, registry: dict | None = None) -> DataFrame:
    """Writes rows whole if every JSON value is valid, else nothing. Returns the invalid rows with their errors: none if written."""
    got = rows.withColumn("errors", errors(F.try_parse_json(json), schema, registry))
    bad = got.filter(F.size("errors") > 0)
    if bad.isEmpty():
        write_whole(rows, path)
    return bad


def write_stage(rows: DataFrame, json: str, schema: dict, path: str, log: str, event: dict, registry: dict | None = None) -> DataFrame:
    """write_checked; where that wrote, the event (case_id, stage, at, ...) goes to the run log as passed."""
    bad = write_checked(rows, json, schema, path, registry)
    if bad.isEmpty():
        rows.sparkSession.createDataFrame([event | {"status": "passed"}]).write.mode("append").parquet(log)
    return bad


def quarantine(rows: DataFrame, json: str, schema: dict, path: str, registry: dict | None = None) -> tuple[str, str]:
    """Writes valid rows to path/valid and the others, with their errors, to path/rejected."""
    got = rows.withColumn("errors", errors(F.try_parse_json(json), schema, registry))
    valid, rejected = f"{path}/valid", f"{path}/rejected"
    write_whole(got.filter(F.size("errors") == 0).drop("errors"), valid)
    write_whole(got.filter(F.size("errors") > 0), rejected)
    return valid, rejected


def missing_pages(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that a resumed run still has to read."""
    return wanted.join(done, keys, "left_anti")
