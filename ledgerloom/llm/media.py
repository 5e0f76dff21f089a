"""Media columns: Matroska. A writer and a parser of EBML elements, and a store of documents as audio in such files.

parse() walks the elements of a file by their variable-length ids and sizes (unknown sizes included) down to the blocks of the
clusters, undoes lacing (none, Xiph, EBML, fixed) and returns a packet table (track, timestamp, byte range, keyframe, lacing),
with tracks and cues. A block has one timestamp; the laced packets after its first follow by the track's default duration, else by
their share of the block's duration, else, for PCM, by the samples before them; where nothing tells, they have the block's. A
document's bytes are stored as 8-bit unsigned PCM: packets of PACKET samples, several laced to a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import as_bytes, by_bytes, mapped

# Element ids of the EBML and Matroska specifications (RFC 8794, RFC 9559).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, TYPE, CODEC, LACING, NAME, EACH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x536E, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = (INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469)  # these end a cluster of unknown size

RATE_HZ, PACKET, LACED, BLOCKS = 8000, 2048, 4, 8  # 8 samples a millisecond; packets of 256 ms, 4 to a block, 8 blocks to a cluster


def number(value: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + number(len(data)) + data


def uint(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(packets: list[bytes], kind: str) -> tuple[int, bytes]:
    """Flag bits and lace header with data of several packets; kind: xiph, ebml or fixed."""
    sizes = [len(p) for p in packets]
    if kind == "fixed" and len(set(sizes)) > 1 or kind not in ("fixed", "xiph", "ebml"):
        raise ValueError("fixed lacing needs packets of one size")
    head = bytes([len(packets) - 1])
    if kind == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == "ebml":
        head += number(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            head += number(b - a + (1 << (7 * width - 1)) - 1, width)
    return {"xiph": 0x02, "fixed": 0x04, "ebml": 0x06}[kind], head + b"".join(packets)


def write(payload: bytes) -> bytes:
    """A Matroska file with one PCM track of the payload's bytes as unsigned 8-bit samples, with cues."""
    head = element(EBML, uint(VERSION, 1), uint(READ_VERSION, 1), uint(MAX_ID, 4), uint(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), uint(DOC_VERSION, 4), uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(SCALE, 1_000_000), element(MUXER, b"llm"), element(WRITER, b"llm"))
    audio = element(AUDIO, element(RATE, bytes.fromhex("45fa0000")), uint(CHANNELS, 1), uint(DEPTH, 8))  # 8000.0
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1), uint(UID, 1), uint(TYPE, 2), uint(LACING, 1), uint(EACH, PACKET * 1_000_000_000 // RATE_HZ), element(CODEC, b"A_PCM/INT/LIT"), audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    span = PACKET * LACED * BLOCKS
    for begin in range(0, len(payload), span):
        time = begin * 1000 // RATE_HZ
        blocks = []
        for b in range(begin, min(begin + span, len(payload)), PACKET * LACED):
            packets = [payload[i : min(i + PACKET, begin + span, b + PACKET * LACED)] for i in range(b, min(b + PACKET * LACED, len(payload)), PACKET)]
            same = len({len(p) for p in packets}) == 1
            flags, data = (0, packets[0]) if len(packets) == 1 else laced(packets, "fixed" if same else "ebml" if b // (PACKET * LACED) % 2 else "xiph")
            blocks.append(element(SIMPLE_BLOCK, b"\x81", (b * 1000 // RATE_HZ - time).to_bytes(2, "big", signed=True), bytes([0x80 | flags]), data))
        cluster = element(CLUSTER, uint(TIMESTAMP, time), *blocks)
        cues.append(element(CUE_POINT, uint(CUE_TIME, time), element(CUE_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, *parts, element(CUES, *cues))


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)  # number, type, codec, rate, channels, depth, each (nanoseconds a packet, or 0)
    packets: list[tuple[int, int, int, int, bool, str]] = field(default_factory=list)  # track, timestamp, start, end, keyframe, lacing
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, position in the file
    clusters: list[int] = field(default_factory=list)  # position in the file


def read_number(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place); keep: with its length bits, as ids are read. An unknown size is -1."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the file ends within an integer at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, until: tuple[int, ...] = ()) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, body, end of body), up to an id of `until`. A body of unknown size is given the end of what holds it."""
    while at < end:
        eid, body = read_number(data, at, keep=True)
        size, body = read_number(data, body)
        if eid in until:
            return
        stop = end if size < 0 else body + size
        if stop > end:
            raise ValueError(f"the element at byte {at} is longer than what holds it")
        yield eid, at, body, stop
        at = stop


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """Of a block: its track, relative time, flags, lacing, and the byte range of each frame."""
    track, at = read_number(data, at)
    time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at += 3
    kind = ("none", "xiph", "fixed", "ebml")[flags >> 1 & 3]
    if kind == "none":
        return track, time, flags, kind, [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == "xiph":
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == "ebml" and n > 1:
        size, at = read_number(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            raw, after = read_number(data, at, keep=True)
            width = after - at
            sizes.append(sizes[-1] + (raw & (1 << 7 * width) - 1) - ((1 << (7 * width - 1)) - 1))
            at = after
    elif kind == "fixed":
        if (end - at) % n:
            raise ValueError("the bytes of a fixed lace can't be divided among its packets")
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("a lace is longer than its block, or has a packet of less than no bytes")
        out.append((at, at + size))
        at += size
    return track, time, flags, kind, [*out, (at, end)]


def parse(data: bytes) -> Media:
    """Tracks, cues and the packet table of a Matroska file. A broken file raises ValueError; unknown elements are skipped."""
    m, value = Media(), lambda a, b: int.from_bytes(data[a:b], "big")
    at, segment = 0, 0

    def cluster(at: int, end: int, open_end: bool) -> int:
        time = 0
        for eid, place, body, stop in elements(data, at, end, TOP_LEVEL if open_end else ()):
            at = stop
            if eid == TIMESTAMP:
                time = value(body, stop)
            elif eid == SIMPLE_BLOCK:
                block(body, stop, time, False, 0)
            elif eid == BLOCK_GROUP:
                parts = [(sub, b, s) for sub, _, b, s in elements(data, body, stop)]
                lasts = next((value(b, s) for sub, b, s in parts if sub == BLOCK_DURATION), 0)
                for sub, b, s in parts:
                    if sub == BLOCK:
                        block(b, s, time, True, lasts)
        return at

    def block(body: int, stop: int, time: int, group: bool, lasts: int) -> None:
        try:
            track, relative, flags, kind, ranges = frames(data, body, stop)
        except IndexError:
            raise ValueError(f"the block at byte {body} is cut off") from None
        t = next((t for t in m.tracks if t["number"] == track), {"each": 0, "codec": ""})
        sample = t["channels"] * t["depth"] / 8 * t["rate"] if t["codec"].startswith("A_PCM") else 0  # bytes a second
        for i, (a, b) in enumerate(ranges):
            if t["each"]:
                later = i * t["each"] // m.scale
            elif lasts:
                later = i * lasts // len(ranges)
            else:
                later = int((a - ranges[0][0]) / sample * 1_000_000_000 / m.scale) if sample else 0
            m.packets.append((track, time + relative + later, a, b, bool(flags & 0x80) or group, kind))

    def track(body: int, stop: int) -> dict:
        t = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0, "each": 0}
        for eid, _, b, s in elements(data, body, stop):
            if eid in (NUMBER, TYPE, EACH):
                t[{NUMBER: "number", TYPE: "type", EACH: "each"}[eid]] = value(b, s)
            elif eid == CODEC:
                t["codec"] = data[b:s].rstrip(b"\0").decode("ascii", "replace")
            elif eid == AUDIO:
                import struct

                for sub, _, x, y in elements(data, b, s):
                    if sub == RATE and y - x in (4, 8):
                        t["rate"] = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0]
                    elif sub in (CHANNELS, DEPTH):
                        t["channels" if sub == CHANNELS else "depth"] = value(x, y)
        return t

    def point(body: int, stop: int) -> None:
        time, found = 0, []
        for eid, _, b, s in elements(data, body, stop):
            if eid == CUE_TIME:
                time = value(b, s)
            elif eid == CUE_POSITIONS:
                inner = {sub: value(x, y) for sub, _, x, y in elements(data, b, s)}
                found.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
        m.cues.extend((time, t, segment + p) for t, p in found)

    while at < len(data):
        eid, body = read_number(data, at, keep=True)
        size, body = read_number(data, body)
        end = len(data) if size < 0 else body + size
        if end > len(data):
            raise ValueError("the file is cut off")
        if eid == EBML:
            m.doc_type = next((data[b:s].decode("ascii", "replace") for sub, _, b, s in elements(data, body, end) if sub == DOC_TYPE), "")
        elif eid == SEGMENT:
            at = segment = body
            while at < end:
                eid, body = read_number(data, at, keep=True)
                size, body = read_number(data, body)
                stop = end if size < 0 else body + size
                if stop > end:
                    raise ValueError(f"the element at byte {at} is longer than its segment")
                if eid == CLUSTER:
                    m.clusters.append(at)
                    stop = cluster(body, stop, size < 0)
                elif eid == INFO:
                    m.scale = next((value(b, s) for sub, _, b, s in elements(data, body, stop) if sub == SCALE), m.scale)
                elif eid == TRACKS:
                    m.tracks += [track(b, s) for sub, _, b, s in elements(data, body, stop) if sub == ENTRY]
                elif eid == CUES:
                    for sub, _, b, s in elements(data, body, stop):
                        if sub == CUE_POINT:
                            point(b, s)
                at = stop
        at = end
    return m


def read(data: bytes) -> bytes:
    """The stored payload: the packets of the first PCM track, joined in order."""
    m = parse(data)
    track = next(t["number"] for t in m.tracks if t["codec"] == "A_PCM/INT/LIT" and t["depth"] == 8)
    return b"".join(data[a:b] for t, _, a, b, _, _ in m.packets if t == track)


def padded(text: bytes, to: int = 64) -> bytes:
    return text + bytes(-len(text) % to) if text else bytes(to)


def packets(files: DataFrame, key: str, media: str) -> DataFrame:
    """(key, track, timestamp, start, end, keyframe, lacing) of each packet of each Matroska file in the binary column `media`.

    timestamp is in the file's ticks. A null file has no packets; a broken one gives one row with the error in `lacing` and nulls.
    """
    kind = files.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "m"):
            rows, who = [], []
            for i, data in enumerate(b.column("m").to_pylist()):
                try:
                    found = parse(data).packets if data is not None else []
                except ValueError as e:
                    found = [(None, None, None, None, None, f"error: {e}")]
                rows += found
                who += [i] * len(found)
            cols = list(zip(*rows)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.record_batch([b.column("k").take(pa.array(who, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], ["k", "track", "timestamp", "start", "end", "keyframe", "lacing"])

    got = mapped(files.select(F.col(key).alias("k"), F.col(media).alias("m")), run, f"k {kind}, track long, timestamp long, start long, end long, keyframe boolean, lacing string")
    return got.withColumnRenamed("k", key)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, null as empty, padded and stored as a Matroska file. Repeated rows are stored each."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "text"):
            texts = as_bytes(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


def features(files: DataFrame) -> DataFrame:
    """files (doc_id, n_bytes, media) with what is read back from them: sizes, digests and a feature string of the packet table."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "media"):
            rows = []
            for data in b.column("media").to_pylist():
                m = parse(data)
                own = [(a, e) for t, _, a, e, _, _ in m.packets if t == m.tracks[0]["number"]]
                payload = b"".join(data[a:e] for a, e in own)
                kinds = ",".join(f"{k}{sum(p[5] == k for p in m.packets)}" for k in ("none", "xiph", "fixed", "ebml"))
                ms = len(payload) * 1000 // RATE_HZ
                cued = sum(p in m.clusters for _, _, p in m.cues)
                text = f"tracks={len(m.tracks)};clusters={len(m.clusters)};cues={cued};packets={len(m.packets)};{kinds};last={m.packets[-1][1]};ms={ms};mean={sum(payload) // len(payload)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), text))
            cols = list(zip(*rows))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return mapped(files, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    return features(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))
