"""Near copies by the Jaccard similarity of whole word-shingle sets: SimHash links and MinHash bands find candidates, the sets themselves decide.

The closest copies are met by the links of their SimHash fingerprints (Golay-code keys, 3 bits, as in simhash). At a similarity of
0.8 fingerprints differ by more bits than such keys reach, so minima of the same shingles, in bands, find the rest.
Two sets of similarity s agree on a band of ROWS minima with probability s^ROWS, so that at 0.8 all BANDS bands differ with a
probability below 3e-11. Members of a bucket are first held against its smallest. Where these links leave a bucket in several
groups, its members are held against each other by a byte of each of their minima: sets that agree on fewer than AGREE of them are
not similar, but for a probability below 3e-11 at 0.8 (of a binomial draw). What is left falls into families, connected by such agreement; the whole sets
of a family meet and decide. Both steps return forests, never pairs, and cut large groups into blocks that meet two by two.
Texts with the same set of shingles are one set from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.common import SMALL_ROWS, TEXT_ROWS, as_bytes, batches, by_bytes, components, discard, mapped, materialise

WIDTH, NUMERATOR, DENOMINATOR, ROWS, BANDS, SEED = 5, 4, 5, 6, 80, 42
AGREE = 320  # of ROWS * BANDS minima; sets of similarity 0.8 agree on 384 in the mean
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 16 << 20, 4096


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    import xxhash

    words = [w.encode() for w in text.decode("utf-8", "replace").lower().split()]
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(words) - width + 1)))


def hashing() -> tuple[np.ndarray, np.ndarray]:
    """Factors and shifts of the ROWS * BANDS functions whose minima are taken."""
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(0, 1 << 32, ROWS * BANDS, np.uint32) for _ in range(2))
    return factors | np.uint32(1), shifts


def minima(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    low = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    s = s.astype(np.uint32)  # its lower half is a hash too
    for at in range(0, len(s), 128):
        np.minimum(low, (s[at : at + 128, None] * factors + shifts).min(0), out=low)
    return low


def bands(s: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """A key for each band: the hash of its minima. No shingles: no keys."""
    import xxhash

    if not len(s):
        return np.empty(0, np.int64)
    low = minima(s, factors, shifts).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low)], np.uint64).view(np.int64)


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a forest that connects what near connects: it says which of some places are linked to one."""
    left, out, todo = np.arange(n), [], []
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
        at = todo.pop()
        if (linked := near(at, left)).any():
            out += [(at, int(x)) for x in left[linked]]
            todo += left[linked].tolist()
            left = left[~linked]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common."""
    out = np.zeros((len(sets), len(sets)))
    element, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), df[element] > 1
    column, owner = (np.cumsum(df > 1) - 1)[element[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        held = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - low)), np.float32)
        held[owner[part], column[part] - low] = 1
        out += held @ held.T
    return out


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of shingle hashes; no shingles: zero."""
    ones = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) if len(s) else np.zeros(64, np.int64)
    return int(np.packbits(2 * ones > len(s)).view("<i8")[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def signed(docs: DataFrame, text: str, row: list[str]) -> DataFrame:
    """(row columns, sid, n, fp, keys) for each row of docs: sid names the set of shingles, n is its size, fp its SimHash."""
    factors, shifts = hashing()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in by_bytes(batch, text):
            sets = [shingles(x) for x in as_bytes(b.column(text))]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(s, factors, shifts) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([*(b.column(c) for c in row), pa.array(sid), pa.array([len(s) for s in sets], pa.int32()), pa.array([fingerprint(s) for s in sets], pa.int64()), keys], [*row, "sid", "n", "fp", "keys"])

    kinds = dict(docs.dtypes)
    return mapped(docs.select(*row, text), run, ", ".join([*(f"`{c}` {kinds[c]}" for c in row), "sid long, n int, fp long, keys array<long>"]))


def met(prints: DataFrame) -> DataFrame:
    """(key, low, low_n, sid, n): each member of each bucket of two or more, with the bucket's smallest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)
        for b in parts:
            rows = np.concatenate([rest, np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "sid", "n")])])
            new = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            last = int(new[-1]) if len(new) else 0
            yield from found(rows[:last])
            rest = rows[last:]
        yield from found(rest)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        sizes = np.diff(np.append(starts, len(rows)))
        low, many = np.repeat(starts, sizes), np.repeat(sizes > 1, sizes)
        if many.any():
            x, y = rows[many], rows[low[many]]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in (x[:, 0], y[:, 1], y[:, 2], x[:, 1], x[:, 2])], ["key", "low", "low_n", "sid", "n"])

    count = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = prints.select(F.explode("keys").alias("key"), "sid", "n").repartition(count, "key").sortWithinPartitions("key", "sid")
    return keyed.mapInArrow(run, "key long, low long, low_n long, sid long, n long")


def close(prints: DataFrame) -> DataFrame:
    """(a, b): sets whose fingerprints differ by at most 3 bits, as stars and forests over prints (sid, n, fp)."""
    one = prints.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("low"))
    same = prints.join(one, "fp").select(F.col("low.sid").alias("a"), F.col("low.n").alias("m"), F.col("sid").alias("b"), "n")
    linked = simhash.links(one.select("fp"))
    ends = linked.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")
    near = ends.select(F.col("x.sid").alias("a"), F.col("x.n").alias("m"), F.col("y.sid").alias("b"), F.col("y.n").alias("n"))
    return same.union(near).filter((F.col("a") != F.col("b")) & fits(F.col("m"), F.col("n"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fits(a, b) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets, in sets (sid, body), are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = (batch.column(c) for c in ("x", "y"))
        ok = [alike(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)]
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return mapped(both.select("a", "b", "x", "y"), run, "a long, b long")


def bodies(docs: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(sid, body): the sets of known (sid, digest), from the texts with these digests."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "body"):
            yield pa.record_batch([b.column("sid"), pa.array([shingles(x).tobytes() for x in as_bytes(b.column("body"))], pa.binary())], ["sid", "body"])

    one = docs.select(F.xxhash64(text).alias("digest"), F.col(text).alias("body")).join(known, "digest")
    # A set has one digest here; grouped by both, the texts are not shuffled once more.
    return mapped(one.groupBy("digest", "sid").agg(F.min("body").alias("body")).select("sid", "body"), run, "sid long, body binary")


def cut(rows: DataFrame, group: str, size: F.Column) -> DataFrame:
    """rows with a column sub: a group of over BLOCK rows, or BLOCK_BYTES in size, is cut into blocks by sid, and each two blocks are a sub."""
    total = rows.groupBy(group).agg(F.count("*").alias("rows"), F.sum(size).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("long")
    large = total.select(group, blocks.alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != own)
    subs = F.transform(others, lambda j: F.least(j, own) * F.col("blocks") + F.greatest(j, own))
    sub = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(subs)).alias("sub")
    return rows.join(large, group, "left").select(*rows.columns, sub)


def dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows, those of each (group, sub) in one task and side by side."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, group, "sub").sortWithinPartitions(group, "sub")


def runs(parts: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    """The rows of each (group, sub) in turn, out of sorted batches."""
    held, at = [], None
    for b in parts:
        if not b.num_rows:
            continue
        g = np.column_stack([b.column(c).to_numpy() for c in (group, "sub")])
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1).tolist(), len(g)]
        for i, j in zip(cuts, cuts[1:]):
            if held and tuple(g[i]) != at:
                yield pa.Table.from_batches(held)
                held = []
            at = tuple(g[i])
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def pairs_of(sid: np.ndarray, linked: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if linked:
        at = np.array(linked)
        yield pa.record_batch([pa.array(sid[at[:, 0]]), pa.array(sid[at[:, 1]])], ["a", "b"])


def agreeing(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a forest over the sets of each bucket that agree on AGREE minima or more and have different roots, in rooted (key, sid, n, root)."""
    factors, shifts = hashing()

    def sketch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        low = [minima(np.frombuffer(x.as_buffer(), np.uint64), factors, shifts).astype(np.uint8).tobytes() for x in batch.column("body")]
        yield pa.record_batch([batch.column("sid"), pa.array(low, pa.binary())], ["sid", "sketch"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(parts, "key"):
            sid, n, root = (t.column(c).to_numpy() for c in ("sid", "n", "root"))
            low = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(sid), -1)

            def near(at: int, left: np.ndarray) -> np.ndarray:
                ok = (root[left] != root[at]) & (DENOMINATOR * np.minimum(n[left], n[at]) >= NUMERATOR * np.maximum(n[left], n[at]))
                ok[ok] = (low[left[ok]] == low[at]).sum(1) >= AGREE
                return ok

            yield from pairs_of(sid, forest(len(sid), near))

    sketches = mapped(sets, sketch, "sid long, sketch binary")
    rows = cut(rooted, "key", F.lit(ROWS * BANDS)).join(sketches, "sid").select("key", "sub", "sid", "n", "root", "sketch")
    return dealt(rows, "key").mapInArrow(run, "a long, b long").distinct()


def decided(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a forest of links, by their whole sets, over the members of each family in families (sid, family)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(parts, "family"):
            bodies = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("body")]
            n, both = np.array([len(s) for s in bodies]), overlaps(bodies)
            yield from pairs_of(t.column("sid").to_numpy(), forest(len(n), lambda at, left: DENOMINATOR * both[at, left] >= NUMERATOR * (n[at] + n[left] - both[at, left])))

    return dealt(cut(families.join(sets, "sid"), "family", F.length("body")), "family").mapInArrow(run, "a long, b long").distinct()


def firsts(docs: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The smallest `order` (a struct `first`, nulls last in each column) of each group of near copies in docs.

    Groups are what links of a similarity of 0.8 or more connect; texts without words are one group.
    """
    spark = docs.sparkSession
    # `digest` finds the text of a set again. A null sorts before any value, so whether it is null goes ahead of each column.
    rows = signed(docs.select(*order, text, F.xxhash64(text).alias("digest")), text, [*order, "digest"])
    place = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    with batches(spark, TEXT_ROWS):
        prints = materialise(rows.groupBy("sid").agg(F.min(place).alias("first"), F.min("digest").alias("digest"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "prints")
    with batches(spark, SMALL_ROWS):
        buckets = materialise(met(prints), "buckets")
    star = buckets.filter((F.col("low") != F.col("sid")) & fits(F.col("low_n"), F.col("n"))).select(F.col("low").alias("a"), F.col("sid").alias("b"))
    star = materialise(star.union(close(prints)).distinct(), "pairs")
    named = star.select(F.col("a").alias("sid")).union(star.select("b")).distinct().join(prints.select("sid", "digest"), "sid")
    linked = materialise(verified(star, bodies(docs, text, named)), "links")
    tree = components(linked)
    # What the smallest of each bucket has not connected: buckets whose members lie in different groups so far.
    rooted = buckets.join(tree.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root"))
    open_ = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    rooted = materialise(rooted.join(open_, "key", "left_semi"), "open")
    discard(buckets)
    discard(star)
    if rooted.head(1):
        named = rooted.select("sid").distinct().join(prints.select("sid", "digest"), "sid")
        sets = materialise(bodies(docs, text, named), "bodies")
        with batches(spark, SMALL_ROWS):
            family = components(agreeing(rooted, sets)).toDF("sid", "family")
            family = family.union(family.select("family", "family").distinct())
            tree = components(linked.union(materialise(decided(family, sets), "links")))
        discard(sets)
    discard(rooted)
    rooted = prints.join(tree.withColumnRenamed("node", "sid"), "sid", "left")
    out = materialise(rooted.groupBy(F.coalesce("root", "sid").alias("group")).agg(F.min("first").alias("first")).select("first"), "firsts")
    discard(prints)
    return out
