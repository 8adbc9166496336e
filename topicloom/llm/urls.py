"""URL filter: explicit rules first, then logistic regression on hashed character n-grams.

Host and path are cut from the url by Spark expressions, and so are rules applied: a
rule ``host/path`` fits its host and all subdomains where the path starts with the
rule's; the longest rule that fits wins. Other urls are judged by a classifier trained
in numpy on a small labelled table: n-grams of host and path, hashed by CRC-32. The
table is an argument; the one at hand is composed of common words of both kinds. A host
whose words share no n-grams with those of blocked sites is allowed.

Null urls and urls without ``://`` have an empty host and path, which no rule fits; the
classifier allows them, as nothing speaks against them. Urls of any length are read
whole. Repeated urls are judged alike; other columns are kept unless they bear the names
of the results. The rule list is a parameter and assumed to be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
THRESHOLD = 0.5

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

# The labelled table is composed of common words: what sites to be blocked are about, what
# others are about, and words that both use.
BLOCKED_WORDS = """
casino poker slots roulette jackpot betting bets lottery gambling bookmaker
porn xxx adult sex nude erotic escort webcams hookup dating
viagra cialis pills steroids slimming replica counterfeit
payday loans prizes giveaway getrich forex bitcoin-doubler
spam linkfarm clickbait popups adserver ads banners tracker tracking pixel telemetry
phishing login verify signin unlock suspended confirm-account wallet-recovery
torrent warez cracked keygen serials nulled pirated
malware hacks exploit botnet
""".split()
ALLOWED_WORDS = """
news times herald post daily weekly journal magazine press radio television cinema theatre
wiki encyclopedia dictionary library archive book reading poem novel author translation language
university college school academy student teacher lecture course learning science nature research
physics chemistry biology astronomy mathematics geology medicine history philosophy economy law
docs python java kernel linux compiler database software developer project source code package
forum questions answers community blog notes essay letter opinion interview reader
city council government ministry parliament embassy police court tax census statistics
health hospital doctor clinic nurse pharmacy therapy nutrition children family parents
weather climate forecast ocean river mountain forest garden flower bird animal farm
travel train airport airline hotel museum gallery map island guide cycling hiking
sport football tennis cricket chess swimming running olympics stadium league
music orchestra guitar piano choir festival dance painting photo design architecture
kitchen recipe cooking bread coffee tea wine market bakery restaurant
bank insurance energy engineering machine motor electric steel paper textile furniture
camera phone computer laptop printer electronics charity church society foundation association
street bridge station village castle harbour thunder theory method other there nation
""".split()
NEUTRAL_WORDS = "best my free online top world big live new the hub zone club shop 24 first easy cheap win fast".split()
_HOSTS = ["{0}.{2}", "www.{0}{1}.{2}", "{1}-{0}.{2}", "m.{0}-{1}.{2}", "{1}{0}.{2}", "{0}s.{1}.{2}"]
_DOMAINS = ["com", "org", "net", "info", "de", "fr", "es", "co.uk", "example.com", "io"]
_PATHS = ["/", "/{0}/{1}.html", "/en/{1}", "/{1}/{0}", "/index.php", "/a/{1}-{0}"]


def labelled_urls(blocked: Sequence[str] = BLOCKED_WORDS, allowed: Sequence[str] = ALLOWED_WORDS,
                  neutral: Sequence[str] = NEUTRAL_WORDS) -> list[tuple[str, int]]:
    """Urls of invented sites, 1 = block: every word in every host form, with changing
    neutral words, domains and neutral paths."""
    out = []
    for label, words in ((1, blocked), (0, allowed)):
        for k, word in enumerate(words):
            for j, form in enumerate(_HOSTS):
                host = form.format(word, neutral[(k + 7 * j) % len(neutral)], _DOMAINS[(k + 3 * j) % len(_DOMAINS)])
                path = _PATHS[(k + j) % len(_PATHS)].format(allowed[(5 * k + 11 * j) % len(allowed)], 37 * k + 11 * j + 100)
                out.append((f"https://{host}{path}", label))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        if slash:
            fits &= path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: str, mark: str) -> Iterator[int]:
    raw = f"{mark}^{text}$".encode()
    for size in SIZES:
        for at in range(len(raw) - size + 1):
            yield zlib.crc32(raw[at : at + size], ord(mark)) % BUCKETS


def gram_buckets(host: str, path: str) -> np.ndarray:
    """Different buckets of a url; digits count as one another."""
    digits = str.maketrans("123456789", "000000000")
    found = set(_grams(host.translate(digits), "h")) | set(_grams(path.translate(digits), "p"))
    return np.fromiter(found, np.int64, len(found)) if host or path else np.empty(0, np.int64)


def train(urls: list[tuple[str, int]], *, rounds: int = 600, rate: float = 1.0, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by full-batch gradient descent. Both
    classes weigh alike; n-grams that many urls have (``.com``, ``/en/``) learn little."""
    rows = []
    for url, _ in urls:
        rest = url.partition("://")[2]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        rows.append(gram_buckets(rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]))
    label = np.array([y for _, y in urls], float)
    share = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.array([len(r) for r in rows]))
    rare = np.log(len(rows) / np.maximum(np.bincount(flat, minlength=BUCKETS), 1)) / np.log(max(len(rows), 2))
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        score = np.bincount(owner, (weights * rare)[flat], len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-score)) - label) * share
        weights -= rate * 20 * (rare * np.bincount(flat, (error * scale)[owner], BUCKETS) + decay / 20 * weights)
        bias -= rate * error.sum()
    return weights * rare, bias


def blocked_chance(host: Column, path: Column, model: tuple[np.ndarray, float]) -> Column:
    """The classifier's probability that a url is to be blocked; 0 for an empty one."""
    weights, bias = model

    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict[tuple[str, str], float] = {}
        for hosts, paths in batches:
            if len(known) > 100_000:
                known.clear()
            out = []
            for pair in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
                if pair not in known:
                    found = gram_buckets(*pair)
                    total = weights[found].sum() / np.sqrt(max(len(found), 1)) + bias
                    known[pair] = float(1 / (1 + np.exp(-total))) if len(found) else 0.0
                out.append(known[pair])
            yield pa.array(out, pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()(host, path)


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, *,
           url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_chance`` and ``verdict``."""
    model = train(labelled_urls() if labelled is None else labelled)
    url = F.col(url_col)
    cut = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    scored = cut.withColumns({"_rule": matched_rule(F.col("host"), F.col("path"), rules),
                              "block_chance": blocked_chance(F.col("host"), F.col("path"), model)})
    learned = F.when(F.col("block_chance") >= threshold, "block").otherwise("allow")
    return scored.withColumns({"rule": F.col("_rule.rule"), "verdict": F.coalesce("_rule.verdict", learned)}).drop("_rule")
