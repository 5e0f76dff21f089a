"""URL filters: listed rules, and for other URLs logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_bytes, fresh, mapped, mix

SLOTS, GRAMS, ROUNDS, RATE, DECAY = 1 << 16, (3, 4, 5), 400, 20.0, 1e-4
ALLOW, BLOCK = "allow", "block"

# The rules of the query, (verdict, host, path).
RULES = [(BLOCK, "com", "/en/"), (ALLOW, "example.com", "/en/7"), (ALLOW, "net", "/de/"), (BLOCK, "example.net", "/de/8"), (BLOCK, "org", "/es/")]

# The labelled table: URLs written for it in the manner of real ones, none of them an actual address.
BLOCKED = """
http://casino-royal.example.com/play http://www.online-casino24.example.net/bonus?id=4 http://casinoslots.example.org/en/12 http://poker-room.example.com/tables/7 http://m.pokerbets.example.net/es/21
http://livebets.example.org/odds/today http://sportsbetting-tips.example.com/ http://betnow.example.net/signup http://betting.example.org/fr/67 http://jackpot-city.example.com/win http://megajackpots.example.net/en/3
http://free-slots.example.com/spin http://slot-machine.example.org/play/88 http://roulette-online.example.net/de/345.html http://bingo-win.example.com/cards http://lotto-winner.example.org/claim http://lottery-prize.example.net/claim?u=1
http://buy-viagra.example.com/order http://cheap-viagra-online.example.net/pills http://cialis.example.org/buy http://pharma-discount.example.com/rx http://rxpills.example.net/no-prescription http://diet-pills.example.org/buy-now
http://xxx-tube.example.com/watch/9 http://xxxvideos.example.net/en/12 http://free-porn.example.org/clips http://pornhd.example.com/v/1234 http://www.adult-cams.example.net/live http://adult.example.org/18plus http://adult-x.example.com/fr/780
http://sexcams.example.com/rooms http://sex-chat.example.net/now http://escort-service.example.org/city http://hot-escorts.example.com/book http://webcam-girls.example.net/live http://nude-pics.example.org/gallery
http://www.cheap-loans.example.com/apply http://payday-loan.example.net/instant http://instantloans.example.org/cash http://m.fast-cash.example.com/now http://get-rich.example.net/fast http://make-money-fast.example.org/join
http://replica-watches.example.com/rolex http://replicabags.example.net/sale http://fake-id.example.org/order http://essay-cheap.example.com/buy http://buy-followers.example.net/cheap http://cheap-likes.example.org/pay
http://cracked-software.example.com/download http://keygen-crack.example.net/serial http://warez.example.org/new http://torrent-movies.example.com/get http://www.freetorrents.example.net/top http://serials-keygen.example.org/all
http://ads.example.com/click?id=88 http://adserver.example.net/banner/1 http://ad-track.example.org/pixel.gif http://track.example.com/c/99/click http://tracker-pixel.example.net/t.gif http://blog.popup-ads.example.org/pop http://clicks.example.com/aff?id=1
http://affiliate-offers.example.net/go/77 http://offers.example.org/click/track http://go-offer.example.com/redirect?u=x http://promo-spam.example.net/mail http://www.spam-host.example.org/x http://www.link-farm.example.net/en/99 http://bulkmail.example.com/send http://blog.spammy.example.net/en/1
http://m.win-iphone.example.com/prize http://free-iphone.example.net/claim http://prize-winner.example.org/you http://free-gift-card.example.com/get http://giftcards-free.example.net/code http://survey-reward.example.org/claim
http://malware-drop.example.com/a.exe http://virus-alert.example.net/scan.exe http://phishing-login.example.org/bank http://secure-login-verify.example.com/account http://bank-verify.example.net/signin http://paypa1-login.example.org/update
http://free-crypto.example.com/airdrop http://bitcoin-double.example.net/send http://crypto-giveaway.example.org/claim http://forex-signals.example.com/profit http://miracle-cure.example.net/order http://weight-loss-fast.example.org/buy
"""
ALLOWED = """
http://www.essex-school.example.org/term/dates http://betterhealth.example.org/advice http://trackandfield.example.net/results http://winterlibrary.example.com/catalogue http://sussex-museum.example.org/visit http://therapist-guide.example.com/find
http://analysis-journal.example.net/issue/4 http://newsdaily.example.com/2024/05/12/council http://www.city-news.example.org/en/12 http://blog.example.com/posts/garden http://docs.example.net/en/latest/install.html http://wiki.example.org/History_of_paper
http://library.example.com/search?q=rivers http://university.example.net/faculty/physics http://school-district.example.org/calendar http://science.example.com/de/345.html http://physics-notes.example.net/lecture/3 http://maths.example.org/proofs
http://history-society.example.com/papers http://archaeology.example.net/digs http://recipes.example.org/bread http://bakery.example.com/menu http://gardening-club.example.net/tips http://birdwatch.example.org/list http://weather.example.com/fr/67
http://travelogue.example.net/norway http://railway-times.example.org/table http://bus-routes.example.com/line/9 http://hospital.example.net/wards http://nhs-clinic.example.org/opening http://dentist.example.com/contact http://pharmacy-school.example.net/courses
http://parliament.example.org/bills/77 http://council.example.com/minutes http://court-records.example.net/case/5 http://charity.example.org/donate http://volunteers.example.com/join http://orchestra.example.net/season http://theatre.example.org/tickets
http://music-school.example.com/lessons http://chess.example.net/games/88 http://football-club.example.org/fixtures http://cricket.example.com/scores http://cycling.example.net/routes http://sailing.example.org/tides http://athletics.example.com/track
http://photo-archive.example.net/album/3 http://gallery.example.org/painters http://poetry.example.com/poem/12 http://bookshop.example.net/novels http://publisher.example.org/authors http://magazine.example.com/es/21 http://radio.example.net/schedule
http://python-guide.example.org/tutorial http://compiler.example.com/manual http://opensource.example.net/project http://code-review.example.org/pull/9 http://database.example.com/reference http://network.example.net/rfc/793 http://forum.example.org/thread/1234
http://adviser.example.com/pensions http://address-book.example.net/help http://loan-library.example.org/books http://trading-standards.example.com/law http://alphabet.example.net/letters http://bethlehem-church.example.org/services http://sextant-makers.example.com/tools
http://middlesex-county.example.net/roads http://adelaide-zoo.example.org/animals http://broadcast.example.com/news http://shadow-puppets.example.net/shows http://headmaster.example.org/letters http://tracking-wolves.example.com/field http://popular-science.example.net/space
http://greenfield.example.org/farm http://riverside.example.com/walks http://northlake.example.net/fishing http://stonehouse.example.org/builders http://bright-minds.example.com/kids http://theron.example.net/en/7 http://www.ththre.example.org/de/78
http://blog.tionsh.example.com/fr/825 http://m.thering.example.net/en/843.html http://ining.example.org/es/317.html http://eran.example.com/en/25 http://ndation.example.net/fr/144.html http://stent.example.org/en/929 http://www.hament.example.com/index.html
"""


def labelled() -> list[tuple[str, str, int]]:
    """The table as (host, path, 1 to block)."""
    parts = re.compile(r"://([^/?#]*)([^?#]*)")
    return [(*parts.search(u).groups(), y) for y, urls in ((1, BLOCKED), (0, ALLOWED)) for u in urls.split()]


def slots(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of each distinct hashed n-gram of bytes of host and path, each marked with its part; runs of digits count as one 0."""
    texts = [f"\x02{h}\x03" if h else "" for h in hosts] + [f"\x04{p}\x05" if p else "" for p in paths]
    coded = [(re.sub(r"\d+", "0", t) if t else t).encode() for t in texts]
    size = np.array([len(t) for t in coded], np.int64)
    raw = np.frombuffer(b"".join(coded) + bytes(max(GRAMS)), np.uint8).astype(np.uint64) + np.uint64(1)
    row, left = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    found = []
    for n in GRAMS:
        grams = reduce(lambda h, i: h * np.uint64(0x100000001B3) + raw[i : i + len(row)], range(n), np.full(len(row), n, np.uint64))
        mark = (row >= len(hosts)).astype(np.uint64)  # the same letters in a path are another n-gram
        slot = mix(grams * np.uint64(2) + mark) >> np.uint64(64 - SLOTS.bit_length() + 1)
        ok = left >= n
        found.append((row[ok] % max(1, len(hosts)) * SLOTS + slot[ok].astype(np.int64)))
    both = np.unique(np.concatenate(found))
    return both // SLOTS, both % SLOTS


def train(rows: list[tuple[str, str, int]]) -> np.ndarray:
    """Weights of the slots, and the bias last: batch gradient descent from zero with L2 decay, so that equal rows give equal weights."""
    row, at = slots([r[0] for r in rows], [r[1] for r in rows])
    size = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(rows))))[row]
    y = np.array([r[2] for r in rows], np.float64)
    w, bias = np.zeros(SLOTS), 0.0
    for _ in range(ROUNDS):
        z = np.bincount(row, weights=w[at] * size, minlength=len(rows)) + bias
        slope = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= RATE * (np.bincount(at, weights=slope[row] * size, minlength=SLOTS) + DECAY * w)
        bias -= RATE / 10 * slope.sum()
    return np.append(w, bias)


@lru_cache(1)
def trained() -> np.ndarray:
    return train(labelled())


def chances(hosts: list[str], paths: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability that each URL is to be blocked. Without host and path nothing speaks for it: 0."""
    row, at = slots(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    z = np.bincount(row, weights=weights[at], minlength=len(hosts)) / np.sqrt(np.maximum(1, n)) + weights[-1]
    return np.where(n > 0, 1 / (1 + np.exp(-z)), 0.0)


def host_of(url) -> F.Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is none. Native."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> F.Column:
    """The longest rule (host and path together; ties: the first listed) of the host or a domain above it whose path starts the URL's; else null."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("string")
    for _, h, p in reversed(ordered):
        out = F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.lit(h + p)).otherwise(out)
    return out


def judge(pages: DataFrame, url: str, rules: list[tuple[str, str, str]], weights: np.ndarray) -> DataFrame:
    """pages with host, path, rule, chance (to be blocked by the method, set where no rule fits) and verdict.

    A null URL, or one without ://, has an empty host and path, fits no rule and is allowed. If pages has such column names, the new
    ones get a trailing underscore. Rows are judged one by one.
    """
    h, p, r, c, v = (fresh(pages, x) for x in ("host", "path", "rule", "chance", "verdict"))
    got = pages.withColumn(h, host_of(F.col(url))).withColumn(p, path_of(F.col(url)))
    got = got.withColumn(r, rule_of(F.col(h), F.col(p), rules))
    sent = pages.sparkSession.sparkContext.broadcast(weights)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, h, 1 << 20):
            hosts, paths, ruled = (b.column(x).to_pylist() for x in (h, p, r))
            free = [i for i, k in enumerate(ruled) if k is None]
            out = np.full(len(ruled), np.nan)
            if free:
                out[free] = chances([hosts[i] for i in free], [paths[i] for i in free], sent.value)
            yield pa.record_batch([*b.columns, pa.array(out, pa.float64(), mask=np.isnan(out))], [*b.schema.names, c])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in got.schema.fields)
    verdict = F.when(F.col(r).isNotNull(), F.element_at(F.create_map(*(F.lit(x) for k, a, b in rules for x in (a + b, k))), F.col(r)) if rules else F.lit(ALLOW)).when(F.col(c) >= 0.5, BLOCK).otherwise(ALLOW)
    return mapped(got, score, f"{schema}, `{c}` double").withColumn(v, verdict)


def op6_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, "url", RULES, trained()).select("page_id", "host", "path", "rule", "verdict")
