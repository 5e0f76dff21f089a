"""Substring dedup: words covered by a window of 35 words that also starts elsewhere are removed.

Windows are hashed by rolling polynomials over word hashes. Each window names its smallest 18-word gram (leftmost of equals): the
same window names the same gram at the same place, so a gram's count is never below that of any window naming it. Only these
places, about a tenth of all, go through the count-min sketch:

1. Each task sends the cells that its grams touch, with the places, to the blocks of the sketch. A gram seen twice in a task sends
   one row of these, marked, and its places are known to need the second pass. The sketch is dealt over the cluster: the number of
   its blocks follows the bytes of the input, a block merges the cells of all tasks and lets the places pass whose estimate is 2 or
   more. No task and not the driver ever holds more than a block.
2. A second pass reads the documents of these places again and groups the hashes of the (at most 18) windows that name each of them
   exactly, by 64 bits of gram and 64 of window, made from the two independent halves of 128-bit word hashes. A task first combines
   its own: a window met twice there is known to repeat and sends one row, so a passage that is everywhere costs a row a task, not
   a row a copy.
3. Marks go back to their document by key, and the words that no marked window covers are joined.

A sketch too small makes the second pass larger, never wrong. Equal 128-bit hashes are taken as equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SMALL_ROWS, TEXT_ROWS, as_bytes, batches, by_bytes, mapped, materialise, mix, powers

WINDOW, ROWS, CELLS, BLOCK_BYTES, FLUSH = 35, 2, 20, 16 << 20, 1 << 19
GRAM_BASE, WINDOW_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd: they have inverses modulo 2**64


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(base, len(words)), dtype=np.uint64)])
    return mix((sums[width:] - sums[:n]) * powers(pow(base, -1, 1 << 64), n))


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of each `width` consecutive values."""
    at, span = np.arange(len(x)), 1

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while 2 * span <= width:
        at, span = join(at[: len(at) - span], at[span:]), 2 * span
    return join(at[: len(x) - width + 1], at[width - span :][: len(x) - width + 1]) if span < width else at


class Digests(dict):
    """Word to its 128-bit hash, worked out once."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        self[word] = out = xxhash.xxh3_128_digest(word)
        return out


def places(texts: list[bytes], window: int = WINDOW, hashes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each named gram: its hash, its text's number, its first window's place there, how many windows name it; then, if asked for, all windows' hashes."""
    gram = (window + 1) // 2
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    none = np.empty(0, np.int64)
    if total < window or sizes.max() < window:
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    known = Digests()
    words = np.frombuffer(b"".join([h for w in split for h in map(known.__getitem__, w)]), "<u8").reshape(-1, 2)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts)), sizes)
    starts = np.flatnonzero(ends[doc] - np.arange(total) >= window)
    grams = rolling(np.ascontiguousarray(words[:, 0]), gram, GRAM_BASE)
    named = lowest(grams, window - gram + 1)[starts]
    first = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])]))
    at = starts[first]
    count = np.diff(np.concatenate([first, [len(starts)]]))
    every = rolling(np.ascontiguousarray(words[:, 1]), window, WINDOW_BASE)[starts] if hashes else none.view(np.uint64)
    return grams[named[first]], doc[at], at - (ends - sizes)[doc[at]], count, every


def cells_of(low: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell in each row of a block's sketch, by the lower half of a gram's hash."""
    other = mix(low.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return [(x & np.uint64((1 << cells) - 1)).astype(np.int64) for x in (low.astype(np.uint64), other)]


def combine(gram: np.ndarray, hashes: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows: which repeat (or stand for some that are known to), and which stand for all equal ones (their first)."""
    if not len(gram):
        return np.empty(0, bool), np.empty(0, bool)
    order = np.lexsort((hashes, gram))
    g, h = gram[order], hashes[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
    run = np.cumsum(new) - 1
    twice = (np.bincount(run) > 1) | (np.bincount(run, weights=multi[order]) > 0)
    repeats, stands = np.empty(len(g), bool), np.empty(len(g), bool)
    repeats[order], stands[order] = twice[run], new
    return repeats, stands


def bits_of(flags: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The flags of each gram's windows as bits, the first window lowest."""
    place = np.arange(len(flags)) - np.repeat(first, count)
    return np.add.reduceat(flags.astype(np.int64) << place, first) if len(first) else np.empty(0, np.int64)


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Little-endian values as binary rows that end at `ends`."""
    size = values.dtype.itemsize
    offsets = np.concatenate([[0], ends]).astype(np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of binary rows, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.empty(0, np.uint8)
    size = np.dtype(kind).itemsize
    return np.frombuffer(values.tobytes(), kind), np.diff(offsets) // size


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, text): two hashes of id and text name a row; rows with both alike have one name, and the same marks."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit(1), text, "doc_id").alias("k2"), "text")


ENTRY = np.dtype([("k1", "<i8"), ("place", "<i4"), ("cell", "<u4")])  # of the cell's lowest bit, whether its gram is twice in the task
MARK = np.dtype([("place", "<i4"), ("mask", "<i8")])


def candidates(rows: DataFrame, window: int, cells: int, blocks: int) -> DataFrame:
    """(k1, place) of the named grams whose count the sketch estimates at 2 or more; places are their first windows'."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        entries: list[np.ndarray] = []
        for b in (s for b in parts if b.num_rows for s in by_bytes(b, "text")):
            gram, doc, place, _, _ = places(as_bytes(b.column("text")), window, False)
            gram = mix(gram)  # named grams are smallest ones: their hashes lie low
            mine = np.empty(len(gram), ENTRY)
            mine["k1"], mine["place"], mine["cell"] = b.column("k1").to_numpy()[doc], place, gram & np.uint64(0xFFFFFFFE)
            grams.append(gram)
            entries.append(mine)
            if sum(map(len, grams)) > FLUSH:
                yield touched(np.concatenate(grams), np.concatenate(entries))
                grams, entries = [], []
        if sum(map(len, grams)):
            yield touched(np.concatenate(grams), np.concatenate(entries))

    def touched(gram: np.ndarray, mine: np.ndarray) -> pa.RecordBatch:
        """Rows for blocks (0 and up): the first place of each gram. Rows for none (below 0): the places of grams that are here twice."""
        order = np.argsort(gram, kind="stable")
        gram, mine = gram[order], mine[order]
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        size = np.bincount(np.cumsum(new) - 1)
        mine["cell"] |= np.repeat(size > 1, size).astype(np.uint32)
        spread = (np.uint64(1) + (mine["k1"].view("<u8") >> np.uint64(44))).astype(np.int64)
        block = np.where(new, ((gram >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64), -spread)
        order = np.argsort(block, kind="stable")
        block, mine = block[order], mine[order]
        ends = np.flatnonzero(np.concatenate([block[1:] != block[:-1], [True]])) + 1
        return pa.record_batch([pa.array(block[ends - 1]), packed(mine.view(np.uint8), ends * ENTRY.itemsize)], ["block", "entries"])

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []
        for b in parts:
            block, entries = b.column("block").to_numpy(), b.column("entries")
            for k, row in zip(block.tolist(), range(len(block))):
                if k != at and held:
                    yield passed(at, np.concatenate(held))
                    held = []
                at = k
                held.append(np.frombuffer(entries[row].as_py(), ENTRY))
        if held:
            yield passed(at, np.concatenate(held))

    def passed(block: int, mine: np.ndarray) -> pa.RecordBatch:
        keep = np.ones(len(mine), bool)
        twice = (mine["cell"] & 1).astype(bool)
        for cell in cells_of(mine["cell"] >> 1, cells) if block >= 0 else ():
            seen = np.zeros(1 << cells, np.uint8)  # 0, 1, or 2 for more
            n = np.sort(np.concatenate([cell, cell[twice]]))
            seen[n] = 1
            seen[n[1:][n[1:] == n[:-1]]] = 2
            keep &= seen[cell] == 2
        return pa.record_batch([pa.array(np.ascontiguousarray(mine[c][keep])) for c in ("k1", "place")], ["k1", "place"])

    sent = rows.mapInArrow(count, "block long, entries binary").repartition("block").sortWithinPartitions("block")
    return sent.mapInArrow(merge, "k1 long, place int")


SENT = "gram long, k1 long, k2 long, place int, mask long, hashes binary, multi long"


def marks(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(k1, k2, place, mask): bit i of mask says that the window at place + i also starts elsewhere."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = keyed(docs)
    runs = window - (window + 1) // 2 + 1

    def second(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in (s for b in parts if b.num_rows for s in by_bytes(b, "text")):
            gram, doc, place, count, hashes = places(as_bytes(b.column("text")), window)
            at = b.column("at")
            wanted = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy())) << 32 | at.flatten().to_numpy()
            keep = np.isin(doc << 32 | place, wanted)
            k1, k2 = (b.column(k).to_numpy()[doc[keep]] for k in ("k1", "k2"))
            held.append((gram[keep], k1, k2, place[keep].astype(np.int32), count[keep], hashes[np.repeat(keep, count)]))
            if sum(len(x[5]) for x in held) > FLUSH:
                yield own(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield own(*map(np.concatenate, zip(*held)))

    def own(gram, k1, k2, place, count, hashes) -> pa.RecordBatch:
        """A row for each place with windows that stand for themselves elsewhere (their hashes), and one for each document's other places, whose windows are known to repeat (their marks)."""
        first = np.cumsum(count) - count
        repeats, stands = combine(np.repeat(gram, count), hashes, np.zeros(len(hashes), bool))
        known, sends = bits_of(repeats, first, count), bits_of(stands, first, count)
        go, done = np.flatnonzero(sends), np.flatnonzero((sends == 0) & (known != 0))
        done = done[np.lexsort((k2[done], k1[done]))]
        marks = np.empty(len(done), MARK)
        marks["place"], marks["mask"] = place[done], known[done]
        x, y = k1[done], k2[done]
        ends = np.flatnonzero(np.concatenate([(x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True]])) + 1 if len(done) else done
        at = done[ends - 1]
        body = np.concatenate([hashes[stands].view(np.uint8), marks.view(np.uint8)])
        size = np.concatenate([8 * np.add.reduceat(stands, first, dtype=np.int64)[go] if len(go) else go, MARK.itemsize * np.diff(ends, prepend=0)])
        both = np.concatenate([go, at])
        zero = np.zeros(len(at), np.int64)
        cols = [np.concatenate([gram[go].view(np.int64), k1[at]]), k1[both], k2[both], place[both], np.concatenate([known[go], zero])]
        return pa.record_batch([*map(pa.array, cols), packed(body, np.cumsum(size)), pa.array(np.concatenate([sends[go], zero]))], ["gram", "k1", "k2", "place", "mask", "hashes", "multi"])

    def exact(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by gram; the last gram of one may go on in the next."""
        rest = None
        for b in parts:
            alone = pc.equal(b.column("multi"), 0)
            if (done := b.filter(alone)).num_rows:
                made, count = unpacked(done.column("hashes"), MARK)
                yield pa.record_batch([pa.array(np.repeat(done.column(c).to_numpy(), count)) for c in ("k1", "k2")] + [pa.array(np.ascontiguousarray(made[c])) for c in ("place", "mask")], ["k1", "k2", "place", "mask"])
            b = b.filter(pc.invert(alone))
            b = b if rest is None else pa.concat_batches([rest, b])
            if not b.num_rows:
                continue
            gram = b.column("gram").to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))
            if last:
                yield grouped(b.slice(0, last))[0]
            rest = b.slice(last)
            if rest.num_rows > SMALL_ROWS:  # a gram of very many tasks: known repeats leave, what stands for them stays
                done, rest = grouped(rest)
                yield done
        if rest is not None and rest.num_rows:
            yield grouped(rest)[0]

    def grouped(b: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        gram, mask, sends = (b.column(c).to_numpy() for c in ("gram", "mask", "multi"))
        hashes, count = unpacked(b.column("hashes"), "<u8")
        row = np.repeat(np.arange(len(count)), count)
        bit = np.nonzero(sends[:, None] >> np.arange(runs) & 1)[1]
        repeats, stands = combine(gram[row], hashes, (mask[row] >> bit & 1).astype(bool))
        flags = mask.copy()
        np.bitwise_or.at(flags, row, repeats.astype(np.int64) << bit)
        done = np.flatnonzero(flags)
        name = ["k1", "k2", "place"]
        out = pa.record_batch([*(b.column(c).take(pa.array(done)) for c in name), pa.array(flags[done])], [*name, "mask"])
        kept = np.bincount(row[stands], minlength=len(count))
        go = np.flatnonzero(kept)
        sends2 = np.zeros(len(count), np.int64)
        np.bitwise_or.at(sends2, row[stands], np.int64(1) << bit[stands])
        rest = [b.column(c).take(pa.array(go)) for c in ("gram", *name)] + [pa.array(flags[go]), packed(hashes[stands], np.cumsum(kept)[go]), pa.array(sends2[go])]
        return out, pa.record_batch(rest, b.schema.names)

    with batches(spark, TEXT_ROWS):
        some = candidates(rows, window, cells, max(1, -(-size // block_bytes)))
        by_doc = some.groupBy("k1").agg(F.collect_set("place").alias("at"))  # no longer than the document
        sent = rows.join(by_doc, "k1").mapInArrow(second, SENT)
        # A row of a document's known places has its k1 for a gram: only what stands for a gram's windows meets.
        return materialise(sent.repartition("gram").sortWithinPartitions("gram").mapInArrow(exact, "k1 long, k2 long, place int, mask long"), "marks")


def remove_repeats(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, n_removed, kept_text, kept_sha256), one row for each row.

    Words are runs without ASCII white space. A null text has no words; a text with fewer words than `window` keeps all. Repeated
    rows repeat each other's windows. A null doc_id is a document like any other. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = marks(docs, window, cells, block_bytes)
    runs = window - (window + 1) // 2 + 1
    by_doc = found.groupBy("k1", "k2").agg(F.collect_set(F.shiftleft(F.col("place").cast("long"), runs) + F.col("mask")).alias("marks"))  # no longer than the document
    text = F.coalesce("text", F.lit(""))
    both = docs.withColumns({"k1": F.xxhash64("doc_id", text), "k2": F.xxhash64(F.lit(1), text, "doc_id")}).join(by_doc, ["k1", "k2"], "left")
    both = both.select("doc_id", "text", "marks")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "text"):
            texts, n_words, n_removed, kept = as_bytes(b.column("text")), [], [], []
            for text, m in zip(texts, b.column("marks")):
                words = text.split()
                left = words
                if m.is_valid:
                    mine = m.values.to_numpy()
                    row, bit = np.nonzero(mine[:, None] >> np.arange(runs) & 1)
                    starts = np.unique((mine >> runs)[row] + bit)
                    gone = np.zeros(len(words) + 1, np.int64)
                    gone[starts] += 1
                    np.subtract.at(gone, starts + window, 1)
                    left = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.record_batch([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return mapped(both, cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35
), k AS (
  SELECT r, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS h FROM s
), twice AS (
  SELECT h FROM k GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM k WHERE h IN (SELECT h FROM twice))
), flat AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w
), kept AS (
  SELECT f.r, string_agg(f.word, ' ' ORDER BY f.q) AS t, count(*) AS n FROM flat f ANTI JOIN gone g ON f.r = g.r AND f.q = g.q GROUP BY f.r
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(len(w.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r
"""
