"""SimHash near-duplicate groups by Golay-code fuzzy hashing of 64-bit fingerprints.

A fingerprint has four 16-bit segments. Two fingerprints at 3 or fewer differing bits agree on one segment; of the other
48 bits, one half of 24 differs in at most one bit. 23 bits of that half are decoded with the perfect (23,12) Golay code:
the indices of all codewords within 4 bits (1 or 6 of them) are keys, and words at 2 or fewer differing bits share one.
So each fingerprint has 8 families of keys (segment, half), and linked fingerprints meet in a bucket of one of them.
Buckets verify the true distance. A bucket returns a spanning forest of its links, never all pairs; one with more than
BLOCK fingerprints is cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SMALL_ROWS, TEXT_ROWS, as_bytes, batches, by_bytes, components, mapped, materialise

BITS, SEED, SHINGLE, BLOCK = 3, 42, 3, 4096
GENERATOR = 0xC75  # of the cyclic (23,12) Golay code


def simhash(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint of the word shingles, as an unsigned integer; zero if there are no words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def golay_patterns() -> np.ndarray:
    """Row s: the error patterns of weight 4 or less with syndrome s, filled up with -1; one, or six where the coset leader has weight 3."""
    table = np.full((2048, 6), -1, np.int32)
    filled = np.zeros(2048, np.int8)
    for weight in range(5):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            s = golay_syndrome(np.array([word]))[0]
            if weight < 4 or filled[s] and bin(table[s, 0]).count("1") == 3:
                table[s, filled[s]] = word
                filled[s] += 1
    return table


def golay_syndrome(words: np.ndarray) -> np.ndarray:
    """The 11-bit remainder of each 23-bit word by the generator."""
    rest = words.astype(np.int32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def bucket_keys(prints: np.ndarray, patterns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, place in prints) of each family. A key has the family, the exact segment and the codeword's 12 information bits."""
    segments = [(prints >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    for i in range(4):
        a, b, c = (segments[j] for j in range(4) if j != i)
        for half, word in enumerate((a | (b & 0x7F) << 16, (b >> 8) | (c & 0x7FFF) << 8)):
            errors = patterns[golay_syndrome(word)]
            at, k = np.nonzero(errors >= 0)
            yield (2 * i + half) << 28 | segments[i][at] << 12 | (word[at] ^ errors[at, k]) >> 11, at


def spanning(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a forest that connects what links of `bits` or fewer differing bits connect: search over what is not reached yet."""
    left, out, todo = prints, [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.bitwise_count(left ^ at) <= bits
        if near.any():
            found = left[near]
            out += [(at, x) for x in found]
            todo += list(found)
            left = left[~near]
        elif not len(left):
            break
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; a null text counts as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "text"):
            fp = np.array([simhash(x) for x in as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fp long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) over distinct fingerprints fp: links that connect all that are connected by distances of `bits` (3 at most) or less."""
    if bits > 3:
        raise ValueError("the keys find all links of 3 or fewer differing bits")
    patterns = golay_patterns()
    spark = prints.sparkSession

    def keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 8192):
            signed = batch.column("fp").slice(at, 8192).to_numpy()
            for key, place in bucket_keys(signed.view(np.uint64), patterns):
                yield pa.record_batch([pa.array(key), pa.array(signed[place])], ["key", "fp"])

    keyed = mapped(prints.select("fp"), keys, "key long, fp long").withColumn("sub", F.lit(0).cast("long"))

    # A bucket can only be large where its exact segment is frequent: that is counted first, on 4 short rows a fingerprint.
    segment = F.explode(F.array(*(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) + (i << 16) for i in range(4))))
    often = prints.select(segment.alias("cell")).groupBy("cell").count().filter(F.col("count") > BLOCK).select("cell")
    if often.head(1):
        cell = F.shiftright("key", 12).bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(F.shiftright("key", 29), 16)
        large = keyed.withColumn("cell", cell).join(often, "cell", "left_semi").groupBy("key").count().filter(F.col("count") > BLOCK)
        large = materialise(large.select("key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "large")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(j, F.col("own")) * F.col("blocks") + F.greatest(j, F.col("own")))
        split = keyed.drop("sub").join(large, "key").withColumn("own", own).select("key", "fp", F.explode(pairs).alias("sub"))
        keyed = keyed.join(large, "key", "left_anti").select("key", "fp", "sub").unionByName(split)

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)
        for b in parts:
            rows = np.concatenate([rest, np.column_stack([b.column(c).to_numpy() for c in ("key", "sub", "fp")])])
            new = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            yield from found(rows[:last], new[:-1])
            rest = rows[last:]
        yield from found(rest, np.empty(0, np.int64))

    def found(rows: np.ndarray, inner: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], inner]).astype(np.int64)
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        fp = rows[:, 2].view(np.uint64) if len(rows) else np.empty(0, np.uint64)
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= bits]
        pairs = [np.column_stack([fp[two], fp[two + 1]])]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            if made := spanning(np.unique(fp[at : at + n]), bits):
                pairs.append(np.array(made, np.uint64))
        made = np.concatenate(pairs).view(np.int64).reshape(-1, 2)
        made = made[made[:, 0] != made[:, 1]]
        if len(made):
            yield pa.record_batch([pa.array(np.ascontiguousarray(made[:, 0])), pa.array(np.ascontiguousarray(made[:, 1]))], ["a", "b"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = keyed.repartition(n, "key", "sub").sortWithinPartitions("key", "sub")
    return met.mapInArrow(verify, "a long, b long").distinct()


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, itself included. Null text counts as empty (fingerprint zero, linked
    like any other); a null doc_id is never the smallest unless all are null; repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    with batches(spark, TEXT_ROWS):
        made = materialise(fingerprints(docs), "fingerprints")
    with batches(spark, SMALL_ROWS):
        prints = materialise(made.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "prints")
        linked = materialise(links(prints, bits), "links")
    tree = components(linked)
    root = F.coalesce("root", "fp")
    # Of the fingerprints, only those with links or several rows need a join; the rest are their own component.
    rooted = prints.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", root.alias("root"), F.col("root").isNotNull().alias("moved"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("members"))
    known = rooted.join(lows, "root").filter("n > 1 or members > 1").select("fp", "component_id")
    known = materialise(known, "known")
    return made.join(known, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    got = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")
