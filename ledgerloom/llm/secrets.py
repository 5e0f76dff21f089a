"""Secret scans in DataFrame functions alone: listed patterns, and character Markov models for what these miss.

Two first-order Markov models over the characters of tokens, one of random strings and one of ordinary identifiers, are counted
from labelled samples on the driver. Their log-likelihood ratio is a table of weights by pair of characters, a literal array in the
plan; a token is a secret if the sum over its characters is above THRESHOLD and it holds both letters and digits.
"""

from __future__ import annotations

import base64
import hashlib
import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh

# The patterns of the contract, (kind, pattern, group that is measured, least characters of it), in listed order.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
METHOD, LONG, THRESHOLD = "markov", 20, 12.0
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LONG},}}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

# Words that ordinary identifiers are made of.
WORDS = """get set make load save read write open close file name path user group item list map key value index count total size width height
start end begin stop first last next prev time date year month day hour minute second config option param default result error message
request response client server service handler manager factory builder parser reader writer buffer stream cache queue stack node tree
table column row field type class method function module package test data text string number integer float double boolean array object
image page link section header body content title label button event listener callback update delete create insert select filter sort
group merge split join format convert encode decode encrypt hash token session account address email phone version release build""".split()


def samples() -> list[tuple[str, int]]:
    """Labelled samples, made by rule: (token, 1 if random). Random ones are digests written in hex, base64, base32 and 62 characters."""
    out = []
    for i in range(400):
        d = hashlib.sha512(f"sample {i}".encode()).digest()
        written = (d[:20].hex(), base64.b64encode(d[:30]).decode(), base64.b32encode(d[:20]).decode().rstrip("="), "".join(ALPHABET[b % 62] for b in d[:32]), base64.urlsafe_b64encode(d[:24]).decode())
        out += [(w, 1) for w in written]
    pairs = list(product(WORDS, WORDS))
    for i in range(1500):
        a, b = pairs[i * 7919 % len(pairs)]
        c, d = pairs[i * 104729 % len(pairs)]
        out += [(f"{a}_{b}_{c}", 0), (a + b.title() + c.title() + d.title(), 0), (f"{a}-{b}-{c}-{d}", 0), (f"/{a}/{b}/{c}/{d}", 0), (a + b + c + d, 0), (f"{a.upper()}_{b.upper()}_{i % 100}", 0), (f"{a}_{b}{i % 10}", 0)]
        out += [(f"{1990 + i % 40}-{i % 12 + 1:02}-{i % 28 + 1:02}T{i % 24:02}-{i % 60:02}-00-{a}", 0), (f"{a}-{i * i}/{b}-v{i % 9}", 0)]
    out += [(c * 24 + str(i % 10), 0) for i, c in enumerate(ALPHABET) for _ in range(3)]
    return out


def train(rows: list[tuple[str, int]]) -> list[float]:
    """Log-likelihood ratio of random against ordinary by (character before, character); row 0 is a token's start. Add-one counts."""
    n = len(ALPHABET) + 1
    counts = [[1.0] * (n * n) for _ in range(2)]
    for token, label in rows:
        before = 0
        for c in token:
            at = ALPHABET.find(c) + 1
            counts[label][before * n + at] += 1
            before = at
    ratio = []
    for before in range(n):
        row = [[counts[k][before * n + at] for at in range(n)] for k in range(2)]
        ratio += [math.log(row[1][at] / sum(row[1])) - math.log(row[0][at] / sum(row[0])) for at in range(n)]
    return [round(x, 4) for x in ratio]


def score(token: Column, ratio: list[float]) -> Column:
    """Sum of the weights over the token's characters."""
    n = len(ALPHABET) + 1
    table = F.split(F.lit(",".join(map(str, ratio))), ",").cast("array<double>")  # folded to one literal
    place = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    step = lambda acc, at: F.struct((acc["sum"] + F.get(table, acc["before"] * n + at)).alias("sum"), at.alias("before"))
    return F.aggregate(place, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("before")), step)["sum"]


SPAN = "array<struct<start:int,order:int,kind:string,stop:int,token:string>>"


def matches(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the pattern's matches, leftmost and apart from one another, whose group has the least characters: code points, end exclusive."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), sizes.alias("g"))
    init = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, r):
        start = acc["at"] + F.length(r["b"])
        stop = start + F.length(r["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), stop.alias("stop"), r["m"].alias("token"))
        return F.struct(stop.alias("at"), F.when(F.length(r["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, init, step)["out"]


def some(df: DataFrame, name: str, text: str, pattern: str, kind: str, order: int, group: int, least: int, hint: Column) -> DataFrame:
    none = F.array().cast(SPAN)
    return df.withColumn(name, F.when(hint, matches(F.col(text), kind, order, pattern, group, least)).otherwise(none))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """docs with two columns more, whose names are returned: the base spans, and all spans, each an array of SPAN by start and kind.

    A null or empty text has none. Spans of the method are whole tokens that no base span touches. Rows are scanned one by one.
    """
    base, every, t = fresh(docs, "base_spans"), fresh(docs, "spans"), fresh(docs, "scan_text")
    ratio = train(samples())
    got = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    col = F.col(t)
    # Cheap conditions that any match meets keep the patterns off most texts.
    hints = {"assign": (F.contains(col, F.lit("=")) | F.contains(col, F.lit(":"))) & col.rlike(KINDS[0][1]), "access": F.contains(col, F.lit("AKIA")), "hex": col.rlike(r"(?<![0-9a-f])[0-9a-f]{32,}+")}
    names = []
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        # A run of hex digits is one match whatever its length, so only long ones need be looked for.
        pattern = rf"(?<![0-9a-f])[0-9a-f]{{{least},}}+" if kind == "hex" else pattern
        names.append(fresh(got, f"{kind}_spans"))
        got = some(got, names[-1], t, pattern, kind, order, group, least, hints[kind])
    got = got.withColumn(base, F.array_sort(F.concat(*(F.col(n) for n in names))))
    mixed = lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]")
    clear = lambda s: ~F.exists(F.col(base), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
    own = fresh(got, "markov_spans")
    got = some(got, own, t, TOKEN, METHOD, len(KINDS), 0, LONG, col.rlike(TOKEN))
    secret = F.filter(F.col(own), lambda s: F.when(mixed(s) & clear(s), score(s["token"], ratio) > threshold).otherwise(F.lit(False)))
    got = got.withColumn(every, F.when(F.size(own) > 0, F.array_sort(F.concat(F.col(base), secret))).otherwise(F.col(base)))
    return got.drop(t, own, *names), base, every


def spans_text(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret in `text` replaced by the mark; overlapping spans by one. Texts without secrets, nulls too, stay as they are."""
    got, base, every = scan(docs, text)
    init = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        apart = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), apart.alias("out"))

    folded = F.aggregate(F.col(every), init, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return got.withColumn(text, F.when(F.size(every) > 0, folded).otherwise(F.col(text))).drop(base, every)


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    got, base, every = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter(F.col(base), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *(n(k[0]) for k in KINDS), F.sha2(spans_text(F.col(base)), 256).alias("base_sha256"), spans_text(F.col(every)).alias("spans"))
