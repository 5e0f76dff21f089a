"""A corpus from raw documents to packed sequences: language ID, near-dedup, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import langid, mixing, packing, secrets, similar
from ledgerloom.llm.common import discard, fresh, materialise


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letters, or none of the learned languages codes them in about 8 bits a byte or fewer.

    A null lang becomes the language found, where one was learned; others stay as given. Rows are judged one by one.
    """
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    found = F.col(fresh(docs, "lang_pred"))
    got = langid.identify(docs, model, reject=True)
    return got.withColumn("lang", F.coalesce("lang", F.nullif(found, F.lit(langid.UNKNOWN)))).select(docs.columns)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more (Jaccard of their five-word shingles) the row with the smallest doc_id stays, rows without one last.

    SimHash links with Golay-code keys and bands of minima find the pairs, whole sets of shingles decide.
    Ties go by a hash of the text, then of the row; equal rows are one. Rows without words are copies of each other only if they have an id.
    """
    text, name, digest, whole = F.col("text"), *(fresh(docs, c) for c in ("no_id", "digest_of_text", "digest_of_row"))
    rows = docs.withColumns({name: F.col("doc_id").isNull(), digest: F.xxhash64(text), whole: F.xxhash64(*docs.columns)})
    bare = F.col(name) & ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))
    order = ["doc_id", digest, whole]
    first = similar.firsts(rows.filter(~bare).select(*order, "text"), "text", order).select(*(F.col(f"first.{c}").alias(c) for c in order))
    # Joined by the hashes alone, which are never null: rows so dealt are deduplicated where they are, and texts are shuffled once.
    same = [F.col(f"r.{c}") == F.col(f"f.{c}") for c in (digest, whole)]
    same.append(F.coalesce(F.col("r.doc_id") == F.col("f.doc_id"), F.col("r.doc_id").isNull() & F.col("f.doc_id").isNull()))
    kept = rows.filter(~bare).alias("r").join(first.alias("f"), same, "left_semi").dropDuplicates([name, *order])
    return kept.select(docs.columns).union(docs.filter(F.col("doc_id").isNull() & ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark; n_chars follows. Every document stays."""
    columns, same = docs.columns, fresh(docs, "before")
    got = secrets.redact(docs.withColumn(same, F.col("text")))
    return got.withColumn("n_chars", F.when(F.col("text") == F.col(same), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the tokens of sources, languages and topics follow their shares to the power 0.7, at 3/4 of all tokens.

    Null sources and languages are levels of their own; rows of one id, also a null one, are drawn alike; a text without words stays.
    """
    topic, tokens = fresh(docs, "topic_of_text"), fresh(docs, "tokens_of_text")
    sized = materialise(docs.withColumns({topic: mixing.topic(F.col("text")), tokens: mixing.tokens(F.col("text"))}), "sized")
    part = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.col(topic)}
    got, _, _, _, kept = mixing.mix(sized, part, F.col(tokens), F.col("doc_id"), budget=0.75)
    return got.filter(F.col(kept)).select(docs.columns)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in sequences of at most 2048 tokens, a row for each piece. A null text or id is packed like any other, repeated rows each."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("secret scans", redact_secrets), ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES[:-1]):
        made = materialise(stage(spark, docs, sf_dir), "stage")
        if place:
            discard(docs)  # the next stage's table is whole
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
