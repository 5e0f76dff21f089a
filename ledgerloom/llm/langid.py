"""Language ID by prediction by partial matching: one byte context tree for each language, frozen after training.

A language's tree counts which byte follows each context of up to ORDER bytes. The code length of a byte is that of PPM: the
longest context of the merged trees gives it, or else an escape (method C: distinct followers / (total + distinct)) and the
next shorter context, down to a uniform code over 256 bytes. As statistics are frozen, every context's full row of code lengths
is worked out once; a text then costs one look-up a byte, and its code length is exact for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, by_bytes, fresh, mapped

ORDER, CONTEXTS, TRAIN_DOCS, TRAIN_BYTES, LANGS, SLACK, UNKNOWN = 3, 3000, 300, 1_000_000, 400, 256, "und"


@dataclass
class Model:
    """symbol: each byte's symbol (0: never seen in training); context: row of each ORDER symbols; cost: bits by row, symbol, language."""

    langs: list[str]
    symbol: np.ndarray
    context: np.ndarray
    cost: np.ndarray

    @property
    def width(self) -> int:
        return self.cost.shape[1]

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        sizes = np.array([len(t) + ORDER for t in texts], np.int64)
        gap = b"\n" * ORDER  # every text starts in the same context
        raw = np.frombuffer(b"".join(gap + t for t in texts), np.uint8)
        s = self.symbol[raw].astype(np.int32)
        at = np.zeros(len(s), np.int32)
        for k in range(ORDER, 0, -1):
            at[ORDER:] = at[ORDER:] * self.width + s[ORDER - k : len(s) - k]
        place = self.context[at].astype(np.int64) * self.width + s
        ends = np.cumsum(sizes)
        out = np.empty((len(texts), len(self.langs)))
        flat = self.cost.reshape(-1, len(self.langs))
        begin = np.concatenate([[0], ends[:-1]])
        for k in range(len(self.langs)):
            column = np.ascontiguousarray(flat[:, k])[place]
            column[(begin[:, None] + np.arange(ORDER)).ravel()] = 0
            out[:, k] = np.add.reduceat(column, begin, dtype=np.float64)
        return out


def lettered(text: bytes) -> bool:
    """Whether the text has a letter: a character of a Unicode category L."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def train(samples: dict[str, list[bytes]], contexts: int = CONTEXTS) -> Model | None:
    """None if there is no sample. Keeps `contexts` contexts a language of the merged trees, the most frequent ones, of each order whole ones first."""
    langs = sorted(k for k, v in samples.items() if any(v))
    if not langs:
        return None
    raw = {k: np.frombuffer(b"".join(b"\n" * ORDER + t for t in samples[k]), np.uint8) for k in langs}
    seen = np.zeros(256, bool)
    for x in raw.values():
        seen[x] = True
    symbol = np.zeros(256, np.uint8)
    symbol[seen] = np.arange(1, seen.sum() + 1) if seen.sum() < 256 else np.arange(256)
    width = int(symbol.max()) + 1
    grams = {}  # order -> language -> (gram code, count); a gram is a context and the byte after it
    for order in range(ORDER + 1):
        grams[order] = {}
        for k in langs:
            s = symbol[raw[k]].astype(np.int64)
            code = np.zeros(len(s) - order, np.int64)
            for j in range(order + 1):
                code = code * width + s[j : len(s) - order + j]
            grams[order][k] = np.unique(code, return_counts=True)
    kept: dict[int, np.ndarray] = {0: np.zeros(1, np.int64)}
    room = contexts * len(langs) - 1
    for order in range(1, ORDER + 1):
        codes = np.concatenate([grams[order][k][0] // width for k in langs])
        names, where = np.unique(codes, return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([grams[order][k][1] for k in langs]))
        best = np.lexsort((names, -total))[: max(0, room)]
        kept[order] = np.sort(names[best])
        room -= len(kept[order])
    offsets = np.cumsum([0] + [len(kept[o]) for o in range(ORDER + 1)])
    rows = np.empty((offsets[-1], width, len(langs)), np.float32)
    for i, k in enumerate(langs):
        for order in range(ORDER + 1):
            names = kept[order]
            if not len(names):
                continue
            count = np.zeros((len(names), width))
            code, n = grams[order][k]
            at = np.searchsorted(names, code // width)
            ok = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == code // width)
            count[at[ok], code[ok] % width] = n[ok]
            below = np.full((len(names), width), 1 / 256) if not order else 2.0 ** -rows[row_of(names, order, kept, offsets, width, order - 1), :, i]
            distinct, total = (count > 0).sum(1, keepdims=True), count.sum(1, keepdims=True)
            escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
            # PPM with frozen counts: seen symbols by their count, others by the escape and the shorter context.
            p = np.where(count > 0, count / np.maximum(total + distinct, 1), escape * below)
            rows[offsets[order] : offsets[order + 1], :, i] = -np.log2(p)
    every = np.arange(width**ORDER)
    context = row_of(every, ORDER, kept, offsets, width, ORDER).astype(np.uint16 if offsets[-1] < 65536 else np.int32)
    return Model(langs, symbol, context, rows)


def row_of(names: np.ndarray, order: int, kept: dict, offsets: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row of the longest kept suffix, of at most `most` symbols, of each context of `order` symbols."""
    out = np.zeros(len(names), np.int64)
    for o in range(1, most + 1):
        suffix = names % width**o
        if len(kept[o]):
            at = np.minimum(np.searchsorted(kept[o], suffix), len(kept[o]) - 1)
            out = np.where(kept[o][at] == suffix, offsets[o] + at, out)
    return out


def learn(docs: DataFrame, docs_of_lang: int = TRAIN_DOCS, bytes_of_lang: int = TRAIN_BYTES) -> Model | None:
    """Trains on a bounded sample of docs (doc_id, text, lang): of each language documents in the order of a hash of doc_id, at most
    docs_of_lang of them, as long as those before have fewer than bytes_of_lang characters; of a longer one its first
    bytes_of_lang. Rows with a null id, text or lang teach nothing. Of repeated ids the shortest texts come first. Of more than LANGS
    languages the most frequent are learned (ties: the first by name).
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    by = F.xxhash64(F.col("doc_id").cast("string"))
    sizes = known.select("doc_id", "lang", by.alias("by"), F.length("text").alias("size"))
    # Twice as many as wanted lie below a bound on the hash, so a language that has most rows is not ranked in one task.
    top = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()
    counts = F.broadcast(spark.createDataFrame(top, "lang string, n long"))  # at most LANGS rows
    unit = F.shiftrightunsigned("by", 11) / F.lit(float(1 << 53))
    some = sizes.join(counts, "lang").filter(unit * F.col("n") < 2 * docs_of_lang + 20)
    order = Window.partitionBy("lang").orderBy("by", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = some.withColumns({"place": F.row_number().over(order), "before": before}).filter((F.col("place") <= docs_of_lang) & (F.col("before") < bytes_of_lang))
    ids = first.groupBy("doc_id", "lang").agg(F.min("place").alias("place"))
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "place", F.left("text", F.lit(bytes_of_lang)).alias("text")).collect()  # at most docs_of_lang ids and about 2 * bytes_of_lang characters a language
    samples: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.place, len(r.text), r.text)):
        mine = samples.setdefault(r.lang, [])
        if sum(map(len, mine)) < bytes_of_lang:
            mine.append(r.text.encode())
    return train(samples)


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id's digits has remainder 1 by 3. A null id: not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model | None, reject: bool = False) -> DataFrame:
    """docs with lang_pred and score added, or under other names if docs has these; reject=True also drops what no language codes.

    lang_pred is the language of the shortest code (ties: the first by name), `und` if the text is null or has no letter or
    nothing was learned; score is its posterior under equal priors (und: 0). Only the column text is read. Rejected, where asked
    for, are documents that are `und` and those whose best code is longer than 8 bits a byte by SLACK bits: a short text with a strange
    word stays. If nothing was learned (model is None), only null texts and texts without a letter are rejected. Rows are judged one
    by one, repeated ones alike.
    """
    names = [fresh(docs, "lang_pred"), fresh(docs, "score")]
    # Plain arrays: a worker that gets them needs no copy of this package.
    sent = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.symbol, model.context, model.cost))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = sent.value and Model(*sent.value)
        for b in by_bytes(batch, "text", 1 << 20):
            texts = as_bytes(b.column("text"))
            lang, conf, keep = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.array([lettered(t) for t in texts])
            can = np.flatnonzero(keep).tolist() if model else []
            if can:
                bits = model.bits([texts[i] for i in can])
                best = bits.argmin(1)
                low = bits.min(1)
                odds = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(1)
                for i, k, p, x in zip(can, best.tolist(), odds.tolist(), low.tolist()):
                    lang[i], conf[i], keep[i] = model.langs[k], p, x < 8 * len(texts[i]) + SLACK
            out = pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(conf)], [*b.schema.names, *names])
            yield out.filter(pa.array(keep)) if reject else out

    out = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, score, f"{out}, `{names[0]}` string, `{names[1]}` double")


def op5_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.filter(~held_out("doc_id")))
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model).drop("text")
