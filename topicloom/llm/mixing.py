"""Mixing towards target weights with soft membership in domains. Native operations only.

*Membership.* A naive Bayes classifier over the presence of hashed words and signs is
fitted to a table of labelled documents (at most ``SAMPLE_ROWS``, picked by a hash of
the id) and gives each document posterior probabilities of the domains. Traits that no
domain has clearly more often than the others weigh nothing. The weights are a constant of fixed size, so texts are not shuffled.

*Rates.* Nonnegative rates r minimise the squared distance between expected domain
totals, sum of r x tokens x posterior, and the targets; distances are measured by the
inverse of the domains' second-moment matrix. Projected gradient from r = 1, for which
the step length 1 is exact, goes on while it is on course to end in ``MAX_ROUNDS``.
Otherwise steps are scaled by the moments of the documents whose rate is above 0 (a
two-metric projection), several dampings being tried in one pass; the step that ends
closest is taken. It ends when each domain is within ``TOLERANCE`` of its
own target, or when a bound on what other rates could gain shows that the targets are
out of reach. A round is a row or two of sums over a narrow stored table; the driver sees
vectors and matrices as long as the list of domains. As posteriors are all a rate
depends on, rates are an expression over stored columns. Misses are logged.

Null and blank texts have 0 tokens, the prior as posterior and a rate like others.
Labels that are null, of other domains or of no document do not teach; without any,
all domains are equally likely. A domain without labelled documents, while others have
some, has posterior 0; one with less than ``LEAST_MASS`` of its share of the tokens is
not there either. Such domains have no target, and the others' shares are scaled to 1.
By default the mix has as many tokens as the domains with a target: scarce domains are
repeated and never make the mix smaller. Repeated documents each count. Where no rates
reach the targets, the closest totals are found. Columns besides the id and the text
are kept, unless they bear the names of the results.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import by_hash, saved, words
from topicloom.session import drop_path, work_path

log = logging.getLogger(__name__)

BUCKETS = 1 << 15
SAMPLE_ROWS = 20_000
# A trait tells if a domain has it this much more often than the others, and by so many
# standard errors; others only say how long a text is.
MIN_LIFT, MIN_Z = 2.0, 5.0
MAX_ROUNDS, TOLERANCE = 20, 1e-3
SCALED_ROUNDS = 100
DAMPING = [10.0 ** (-k / 2) for k in range(18)]
# Out of reach: other rates could lower the squared distance by this part at most.
MIN_GAIN = 1e-2
# A domain with less than this part of its target would be some documents a thousand times.
LEAST_MASS = 1e-3


def traits(text: Column, words_of: Column) -> Column:
    """What the classifier looks at: buckets of the different words and signs of a text."""
    signs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>!?]"), F.lit(0))
    return F.transform(F.array_union(words_of, signs), lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def membership_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id",
                       text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[float, list[float]]]:
    """For each domain the log chance of a text without any telling trait, and what each
    of ``BUCKETS`` traits adds; minus infinity and nothing for a domain that no label
    taught. A fixed size, whatever the corpus."""
    some = (labelled.where(F.col("domain").isin(domains) & F.col(id_col).isNotNull())
            .select(F.col(id_col).alias("_id"), (F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1)
                    .cast("int").alias("_k")))
    some = by_hash(some, sample_rows, "_id").orderBy(F.xxhash64("_id"), "_id", "_k").limit(sample_rows)
    # Bucket -1 stands for the document itself.
    found = (docs.join(F.broadcast(some), F.col(id_col) == F.col("_id"))
             .select("_k", F.explode(F.array_append(F.array_distinct(traits(F.col(text_col), words(F.col(text_col)))),
                                                    F.lit(-1))).alias("_b")))
    seen = np.zeros((len(domains), BUCKETS + 1))
    for row in found.groupBy("_k", "_b").count().toLocalIterator():
        seen[row[0], row[1]] = row[2]
    have, docs_of = seen[:, :-1], seen[:, -1:]
    expected = have.sum(0) * docs_of / max(docs_of.sum(), 1)
    chance = (have + 0.5) / (docs_of + 1)
    elsewhere = (have.sum(0) - have) / np.maximum(docs_of.sum() - docs_of, 1)
    telling = ((have - expected > MIN_Z * np.sqrt(expected + 1)) & (chance > MIN_LIFT * elsewhere)).any(0)
    absent = np.where(telling, np.log1p(-chance), 0.0)
    added = np.where(telling, np.log(chance) - absent, 0.0)
    # Nothing is known of a domain without labelled documents: smoothing alone would give
    # it a share of every text. Without any labels all are alike.
    known = (docs_of[:, 0] > 0) | (docs_of.sum() == 0)
    prior = np.where(known, np.log((docs_of[:, 0] + 1) / (docs_of.sum() + known.sum())), -np.inf)
    added[~known] = 0.0
    return [(float(prior[k] + absent[k].sum()), added[k].tolist()) for k in range(len(domains))]


def with_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], *, id_col: str = "doc_id",
                    text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``_tokens`` and ``_p0``, ``_p1``, ...: chances of the domains."""
    model = membership_weights(docs, labelled, domains, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    # In steps, or every use of the arrays would compute them anew.
    hashed = (docs.withColumn("_words", words(F.col(text_col)))
              .withColumns({"_tokens": F.size("_words").cast("long"),
                            "_traits": traits(F.col(text_col), F.col("_words"))}))
    known = [k for k, (alone, _) in enumerate(model) if np.isfinite(alone)]
    scored = (hashed.withColumns({f"_s{k}": _sum_of(model[k][1]) + model[k][0] for k in known})
              .drop("_words", "_traits"))
    top = F.greatest(*[F.col(f"_s{k}") for k in known]) if len(known) > 1 else F.col(f"_s{known[0]}")
    scored = scored.withColumns({f"_e{k}": F.exp(F.greatest(F.col(f"_s{k}") - top, F.lit(-30.0))) for k in known})
    total = reduce(add, [F.col(f"_e{k}") for k in known])
    return (scored.withColumns({f"_p{k}": F.col(f"_e{k}") / total if k in known else F.lit(0.0)
                                for k in range(len(domains))})
            .drop(*[f"_{c}{k}" for c in "se" for k in known]))


def _sum_of(weights: list[float]) -> Column:
    """Sum of the weights of a document's traits; the table is folded to a constant."""
    constant = F.split(F.lit(",".join(f"{w:.5g}" for w in weights)), ",").cast("array<double>")
    return F.aggregate("_traits", F.lit(0.0), lambda total, trait: total + F.get(constant, trait))


@dataclass
class Fit:
    """Rates as an expression over ``_p0``...; totals reached and wanted, by domain;
    whether these are the closest totals there are, within the tolerance; whether it is
    proven that no rates reach the targets."""

    rate: Column
    reached: list[float]
    wanted: list[float]
    rounds: int
    converged: bool = True
    out_of_reach: bool = False


def fit_rates(posteriors: DataFrame, shares: list[float], *, total: float | None = None,
              max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE) -> Fit:
    """Rates for a stored table with ``_tokens`` and posteriors.

    ``total`` is the number of tokens wanted; by default as many as the domains with a
    target have. Domains with next to no tokens have none: what is wanted of them is 0,
    and what is reached does not count.
    """
    domains = len(shares)
    p = [F.col(f"_p{k}") for k in range(domains)]
    mass = [F.coalesce(F.sum(F.col("_tokens") * c), F.lit(0.0)).alias(f"m{k}") for k, c in enumerate(p)]
    moments = [F.coalesce(F.sum(F.col("_tokens") * p[i] * p[j]), F.lit(0.0)).alias(f"s{i}_{j}")
               for i in range(domains) for j in range(domains)]
    row = posteriors.agg(*mass, *moments).first()
    have = np.array(row[:domains], float)
    spread = np.array(row[domains:], float).reshape(domains, domains)
    shares = np.array(shares, float) / sum(shares)
    counts = (shares == 0) | (have > LEAST_MASS * shares * have.sum())
    shares = np.where(counts, shares, 0.0)
    shares /= shares.sum() or 1.0
    if total is None:
        total = float(have[shares > 0].sum())
    wanted = shares * total
    # Rows and columns of domains that do not count are 0, and so are their steps.
    spread = spread * np.outer(counts, counts)
    inverse = np.linalg.pinv(spread, rcond=1e-9, hermitian=True)
    rate, reached, rounds = F.lit(1.0), have, 0
    # A domain that is to be left out has no target of its own to be measured by.
    scale = np.where(wanted > 0, wanted, max(float(wanted.sum()), 1.0))
    miss = lambda totals: float((np.abs(totals - wanted) / scale)[counts].max(initial=0.0))
    before = np.inf
    while (error := miss(reached)) > tolerance and rounds < max_rounds:
        # Errors shrink by a factor a round; too slow for the rounds left, scaled steps take over.
        if rounds > 2 and (error >= before or error * (error / before) ** (max_rounds - rounds) > tolerance):
            break
        step = inverse @ (reached - wanted)
        rate = F.greatest(F.lit(0.0), rate - reduce(add, [c * float(s) for c, s in zip(p, step)]))
        rounds, before = rounds + 1, error
        sums = [F.coalesce(F.sum(F.col("_tokens") * c * rate), F.lit(0.0)) for c in p]
        reached = np.array(posteriors.agg(*sums).first(), float)
    if error <= tolerance or not have.sum():
        return Fit(rate, reached.tolist(), wanted.tolist(), rounds)
    return _scaled(posteriors, p, rate, reached, have, wanted, spread, inverse, miss, tolerance, rounds)


def _scaled(posteriors: DataFrame, p: list[Column], rate: Column, reached: np.ndarray, have: np.ndarray, wanted: np.ndarray,
            spread: np.ndarray, inverse: np.ndarray, miss: Callable[[np.ndarray], float], tolerance: float, rounds: int) -> Fit:
    """Projected gradient whose steps are scaled by the moments of the documents that still
    have a rate above 0, with a part of all documents' moments (``DAMPING``); of these
    steps, tried in one pass, the one that ends closest is taken."""
    domains = len(p)
    used = np.diag(spread) > 0
    total = lambda parts: reduce(add, parts)
    far = lambda totals: float((totals - wanted) @ inverse @ (totals - wanted)) / 2
    size, ended, lost = float(wanted @ inverse @ wanted), False, False
    limit = rounds + SCALED_ROUNDS
    spark = posteriors.sparkSession
    # Rates so far are a column of a narrow table, or a round would compute all before it.
    now, path = _stored_rates(posteriors, p, rate)
    while rounds < limit and not (ended := miss(reached) <= tolerance):
        pull = inverse @ (wanted - reached)
        held = F.when(F.col("_rate") > 0, F.col("_tokens")).otherwise(F.lit(0.0))
        top = F.max(F.when(F.col("_tokens") > 0, total([c * float(y) for c, y in zip(p, pull)])))
        row = now.agg(top, *[F.sum(held * p[i] * p[j]) for i in range(domains) for j in range(i, domains)]).first()
        # What could any rates gain? Their totals R lie in the cone of the posteriors, so that
        # R x pull is at most their tokens times the largest posterior x pull.
        gain = max(0.0, float(row[0])) * np.sqrt(have.sum() * size) - float(reached @ pull)
        if gain <= MIN_GAIN * far(reached) + 1e-12 * size:
            ended = lost = True
            break
        free = np.zeros((domains, domains))
        free[np.triu_indices(domains)] = np.array(row[1:], float)
        free = (free + np.triu(free, 1).T) * np.outer(used, used)
        steps = [np.linalg.pinv(free + part * spread, rcond=1e-12, hermitian=True) @ (reached - wanted) for part in DAMPING]
        steps = [np.where(used, step, 0.0) for step in steps]
        moved = [F.expr("greatest(0D, _rate - (" + " + ".join(f"_p{k} * {float(s)!r}D" for k, s in enumerate(step)) + "))")
                 for step in steps]
        tried = now.select("*", *[(F.col("_tokens") * m).alias(f"_r{n}") for n, m in enumerate(moved)])
        sums = np.array(tried.agg(*[F.expr(f"sum(_r{n} * _p{k})") for n in range(len(steps)) for k in range(domains)])
                        .first(), float)
        ends = sums.reshape(len(steps), domains)
        best = min(range(len(steps)), key=lambda n: far(ends[n]))
        rounds += 1
        if far(ends[best]) >= far(reached) * (1 - 1e-9):
            break
        rate = F.greatest(F.lit(0.0), rate - total([c * float(s) for c, s in zip(p, steps[best])]))
        reached = ends[best]
        before, (now, path) = path, _stored_rates(now, p, moved[best])
        drop_path(spark, before)
    drop_path(spark, path)
    return Fit(rate, reached.tolist(), wanted.tolist(), rounds, ended, lost)


def _stored_rates(rows: DataFrame, p: list[Column], rate: Column) -> tuple[DataFrame, str]:
    path = work_path(rows.sparkSession, "llm-rates")
    narrow = rows.select("_tokens", *p, rate.alias("_rate"))
    narrow.write.parquet(path)
    return rows.sparkSession.read.schema(narrow.schema).parquet(path), path


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """The documents of ``mixed_and_fit``."""
    return mixed_and_fit(docs, labelled, targets, **options)[0]


def mixed_and_fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], *, id_col: str = "doc_id",
                  text_col: str = "text", total: float | None = None, sample_rows: int = SAMPLE_ROWS,
                  keep_text: bool = True) -> tuple[DataFrame, Fit]:
    """``docs`` with ``n_tokens``, ``domain`` (the most probable), ``posterior`` (in the
    order of ``targets``) and ``rate``; without the text unless ``keep_text``. And what
    of the targets is reached; a miss is logged as well."""
    domains = list(targets)
    members = with_posteriors(docs, labelled, domains, id_col=id_col, text_col=text_col, sample_rows=sample_rows)
    stored = saved(members if keep_text else members.drop(text_col), "posteriors")
    fit = fit_rates(stored, [targets[d] for d in domains], total=total)
    totals = ", ".join(f"{d} {r:.6g} of {w:.6g}" for d, r, w in zip(domains, fit.reached, fit.wanted))
    missed = any(abs(r - w) > TOLERANCE * w for r, w in zip(fit.reached, fit.wanted))
    log.log(logging.WARNING if missed else logging.INFO, "mixing, tokens reached of wanted: %s; %d rounds%s", totals,
            fit.rounds, ", out of reach" if fit.out_of_reach else "" if fit.converged else ", not converged")
    p = [F.col(f"_p{k}") for k in range(len(domains))]
    posterior = F.array(*p)
    domain = F.get(F.array(*map(F.lit, domains)), F.array_position(posterior, F.array_max(posterior)).cast("int") - 1)
    out = stored.withColumns({"n_tokens": F.col("_tokens"), "domain": domain, "posterior": posterior, "rate": fit.rate})
    out = out.drop("_tokens", *[f"_p{k}" for k in range(len(domains))])
    return out, fit


def totals(spark: SparkSession, targets: dict[str, float], fit: Fit) -> DataFrame:
    """Expected tokens ``wanted`` and ``reached`` of each domain, and ``out_of_reach``."""
    rows = [(d, float(w), float(r), fit.out_of_reach) for d, w, r in zip(targets, fit.wanted, fit.reached)]
    return spark.createDataFrame(rows, "domain string, wanted double, reached double, out_of_reach boolean")


def copies(rate: Column, *keys: Column, seed: int = 13) -> Column:
    """How often a document goes into the mix: the whole part of its rate, and once more
    with the chance that is left, decided by a hash of ``keys``. Documents with equal keys
    share the draw, so the text should be among them where ids may be null or repeated."""
    chance = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int")
