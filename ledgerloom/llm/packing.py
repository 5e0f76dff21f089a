"""Best-fit packing of token pieces into sequences, each a bin with several capacities.

A piece's demand is a vector: its tokens, one document, and its attention cost (tokens squared). All three follow from its
length, so pieces of one length are interchangeable, and the packing works on the histogram of lengths: longest first, each
goes to the open bin where, under every constraint, the residual vector it leaves has the smallest norm (or where its weighted
dot-product with the residual is largest). Bins in the same state are kept as ranges of bin numbers and take a piece each, or
as many as they can, in one step. The plan says, for ranges of ranks among the pieces of a length, which bins and which offsets;
its size depends on the number of lengths (at most the capacity), not of documents. Pieces then look up their rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import TEXT_ROWS, as_bytes, batches, by_bytes, mapped, materialise, mix, powers

CAPACITY, END, PARTS, DEAL, LONGEST, BASE = 2048, 0, 2_000_000, 4096, 64, 0x9E3779B97F4A7C15


class Words:
    """Token ids of texts, by a table of parts already encoded: of at most about `most` parts, that is about 40 MB a million.

    The tokenizer drops white space and never joins across it, nor across a full stop or comma that ends a word after an ASCII
    letter; and it lowers ASCII letters. So texts are cut there, all at once as arrays of bytes, and parts are looked up by a
    64-bit hash. Equal hashes are taken as equal parts; parts of more than LONGEST bytes are not looked up.
    """

    def __init__(self, vocabulary: str, most: int = PARTS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # tokens that end a run of letters or of signs
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.most = most
        self.space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
        self.letter = np.isin(np.arange(256), list(range(65, 91)) + list(range(97, 123)))
        self.clear()

    def clear(self) -> None:
        self.hashes, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.tokens, self.used = np.empty(1 << 16, np.uint32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.tokens the ids of each part begin, and how many they are."""
        begin, size = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        texts = [p.decode("utf-8", "replace") for p in parts]
        runs = sorted((t, i) for i, t in enumerate(texts) if t.isalpha())
        odd = [i for i, t in enumerate(texts) if not t.isalpha()]
        for at in range(0, len(runs), 200):  # runs of letters go to the tokenizer many at once: each ends with a last token
            some = runs[at : at + 200]
            ids = np.array(self.encode([" ".join([t for t, _ in some])])[0], np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):  # a letter whose lower case is no letter
                odd += [i for _, i in some]
                continue
            place, starts = [i for _, i in some], np.concatenate([[0], ends[:-1]])
            begin[place], size[place] = self.add(ids) + starts, ends - starts
        for i, ids in zip(odd, self.encode([texts[i] for i in odd])):
            begin[i], size[i] = self.add(np.array(ids, np.uint32)), len(ids)
        return begin, size

    def add(self, ids: np.ndarray) -> int:
        at = self.used
        self.used += len(ids)
        if self.used > len(self.tokens):
            self.tokens = np.resize(self.tokens, max(self.used, 2 * len(self.tokens)))
        self.tokens[at : self.used] = ids
        return at

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.hashes) > self.most:
            self.clear()
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(b" ".join([b"", *texts, b" "]), np.uint8)  # every text between spaces
        follow = raw[1:]
        capital = (raw[:-1] >= 65) & (raw[:-1] <= 90) & (follow < 128)  # before a mark of several bytes the case may matter
        low = raw.copy()
        low[:-1] += np.uint8(32) * capital
        space = self.space[raw]
        sign = np.zeros(len(raw), bool)
        sign[1:-1] = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & space[2:] & self.letter[raw[:-2]]
        inside = ~space
        first = np.flatnonzero(inside[1:] & (space[:-1] | sign[1:])) + 1
        stop = np.flatnonzero(inside[:-1] & (space[1:] | sign[1:])) + 1
        if not len(first):
            return [np.empty(0, np.uint32)] * len(texts)
        if len(raw) > len(_powers[0]):
            _powers[:] = [powers(BASE, len(raw) * 5 // 4), powers(pow(BASE, -1, 1 << 64), len(raw) * 5 // 4)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(low)], dtype=np.uint64)])
        long = stop - first > LONGEST
        name = mix((sums[stop] - sums[first]) * _powers[1][first] ^ (stop - first).astype(np.uint64) << np.uint64(56))
        name, at, which = np.unique(name, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, name), max(0, len(self.hashes) - 1))
        have = self.hashes[place] == name if len(self.hashes) else np.zeros(len(name), bool)
        begin, size = np.empty(len(name), np.int64), np.empty(len(name), np.int64)
        begin[have], size[have] = self.begin[place[have]], self.size[place[have]]
        new = np.flatnonzero(~have)
        data = low.tobytes()
        begin[new], size[new] = self.learn([data[a:b] for a, b in zip(first[at[new]].tolist(), stop[at[new]].tolist())])
        order = np.argsort(merged := np.concatenate([self.hashes, name[new]]), kind="stable")
        self.hashes, self.begin, self.size = merged[order], np.concatenate([self.begin, begin[new]])[order], np.concatenate([self.size, size[new]])[order]
        begin, size = begin[which], size[which]
        if long.any():
            begin[long], size[long] = self.learn([data[a:b] for a, b in zip(first[long].tolist(), stop[long].tolist())])
        before = np.concatenate([[0], np.cumsum(size)])
        tokens = self.tokens[np.repeat(begin - before[:-1], size) + np.arange(before[-1])]
        return np.split(tokens, before[np.searchsorted(first, ends[:-1] + 1)])


_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def words_of_worker(vocabulary: str) -> Words:
    """The table that this Python worker keeps from task to task."""
    import sys
    import types
    import zlib

    kept = sys.modules.setdefault("_ledgerloom_words", types.ModuleType("_ledgerloom_words")).__dict__
    key = zlib.crc32(vocabulary.encode())
    if kept.get("key") != key:
        kept["key"], kept["words"] = key, Words(vocabulary)
    return kept["words"]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, nth): each document's ids and then `end`, cut every `capacity` ids. Null text: empty.

    nth counts a task's pieces: it tells rows apart that are alike, so that many of them need not meet in one place.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    tail = np.array([end], "<u4").tobytes()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, made = None, 0
        for b in (s for b in parts if b.num_rows for s in by_bytes(b, "text", 1 << 19)):
            words = words or words_of_worker(sent.value)
            rows: list[tuple[int, int, int, int]] = []
            who = []
            for i, ids in enumerate(words.ids(as_bytes(b.column("text")))):
                ids = ids.astype("<u4").tobytes() + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
                    who.append(i)
            cols = list(zip(*rows))
            yield pa.record_batch([b.column("doc_id").take(pa.array(who)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(np.arange(made, made + len(who)))], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])
            made += len(who)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long")


def plan_bins(lengths: dict[int, int], capacity: int = CAPACITY, documents: int | None = None, attention: int | None = None, rule: str = "norm", weight: tuple[float, float, float] = (1.0, 1e-3, 1e-3)) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, pieces a bin, offset) for the histogram `lengths`.

    documents and attention are a bin's further capacities (none: as large as tokens alone allow). rule: "norm", the smallest
    weighted norm of the residual left, or "dot", the largest weighted dot-product of demand and residual; ties go to the state
    opened first. A piece of a length whose own demand is beyond a bin's capacities is an error.
    """
    documents = documents or capacity
    attention = attention or capacity * capacity
    total = np.array([capacity, documents, attention], np.float64)
    scale = np.array(weight) / total**2
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> ranges (first bin, number) with that residual
    bins, plan = 0, []
    for length in sorted(lengths, reverse=True):
        left, rank, need = lengths[length], 0, (length, 1, length * length)
        if any(n > t for n, t in zip(need, total)):
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while left:
            keys = list(states)
            fit = np.zeros(0)
            if keys:
                r = np.array(keys, np.float64)
                ok = (r >= need).all(1)
                after = r - need
                cost = (after**2 * scale).sum(1) if rule == "norm" else -(r * need * scale).sum(1)
                fit = np.where(ok, cost, np.inf)
            if len(fit) and np.isfinite(fit.min()):
                key = keys[int(fit.argmin())]
                ranges = states.pop(key)
            else:  # no open bin takes it: open as many as the rest needs
                key = (capacity, documents, attention)
                each = min(k // n for k, n in zip(key, need))
                opened = -(-left // each)
                ranges, bins = [(bins, opened)], bins + opened
            # By the norm a bin that has just taken a piece is the best again, as long as it can take one more.
            each = 1 if rule == "dot" and key[0] < capacity else min(k // n for k, n in zip(key, need))
            while ranges and left:
                first, n = ranges.pop(0)
                full = min(n, left // each)
                odd = left - full * each if full < n else 0
                for at, count, m in ((first, full, each), (first + full, min(1, odd), odd)):
                    if count:
                        plan.append((length, rank, rank + count * m, at, m, capacity - key[0]))
                        rank, left = rank + count * m, left - count * m
                        states.setdefault(tuple(k - m * x for k, x in zip(key, need)), []).append((at, count))
                if rest := n - full - min(1, odd):
                    ranges.insert(0, (first + n - rest, rest))
            if ranges:
                states[key] = ranges + states.get(key, [])
    return np.array(plan, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, documents: int | None = None, attention: int | None = None, rule: str = "norm") -> DataFrame:
    """docs (doc_id, text) to a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of the end id alone. Repeated rows are packed each. No row in, no row out. Other columns
    are ignored. Offsets in a sequence are gapless from 0.
    """
    spark = docs.sparkSession
    with batches(spark, TEXT_ROWS):
        made = materialise(pieces(docs, vocabulary, capacity, end), "pieces")
    lengths = {r.length: r["count"] for r in made.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_bins(lengths, capacity, documents, attention, rule)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    sent = spark.sparkContext.broadcast(plan)
    # A piece's rank among those of its length: its place in a part of them, after all earlier parts.
    dealt = made.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.lit(max(1, sum(lengths.values()) // DEAL))))
    counts = dealt.groupBy("length", "deal").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("deal").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = counts.select("length", "deal", (before - F.col("count")).alias("base"))
    place = F.row_number().over(Window.partitionBy("length", "deal").orderBy("doc_id", "piece", "start", "ids_crc32", "nth"))
    ranked = dealt.withColumn("place", place).join(base, ["length", "deal"]).withColumn("rank", F.col("place") - 1 + F.col("base"))

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = sent.value
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        row = p[np.searchsorted((p[:, 0] << 44) + p[:, 1], (length << 44) + rank, side="right") - 1]
        nth = rank - row[:, 1]
        cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.record_batch([*cols, pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return mapped(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), assign, out)


def vocabulary(path: str | None = None) -> str:
    """Text of a tokenizer file; without a path, of the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary())
