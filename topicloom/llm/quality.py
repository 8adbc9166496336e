"""Quality rules: an ordered list of threshold conjunctions learned from labels.

Text statistics are counted over whole texts in Arrow batches. A bounded sample of
labelled statistics (``SAMPLE_ROWS``, picked by a hash of the id) comes to the driver,
where sequential covering learns when a document is junk: a rule grows by the condition
with the largest information gain on two thirds of the rows, loses conditions that do
not help on the last third, and is kept while it is precise enough there; what it
covers is taken out and the next rule is learned from the rest. The list becomes one
Spark expression, ``CASE WHEN rule 1 THEN ... WHEN rule 2 ...``.

Null and empty texts have no words: all counts are 0 and the base rules reject them.
Without labels of both kinds the list is empty and only the base rules decide. Labels
that are null or belong to no document are ignored, repeated ones count repeatedly.
Very long texts are counted whole. Columns besides the id and the text play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import by_hash

SAMPLE_ROWS = 20_000
MIN_WORDS = 50
# A rule must be this precise on rows it was not grown from.
MIN_PRECISION = 0.97
MAX_RULES, MAX_CONDITIONS, CUTS = 16, 4, 48

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks",
          "n_upper", "n_distinct_words")
_COUNTS_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"

_symbols = re.compile(r"[#*$%&|<>]").findall
_marks = re.compile(r"[!?]").findall
_capitals = re.compile(rb"(?<![^\x20\x09-\x0D])[A-Z]{2,}").findall
_space = re.compile(r"[\x20\x09-\x0D]").findall


def counts_of(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text. Words are runs of anything but ASCII white space."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    if not words:
        return (0,) * len(COUNTS)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    return (len(words), len(text) - len(_space(text)), len(_symbols(text)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(_marks(text)), len(_capitals(raw)), len(set(words)))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words within windows of ``width`` words that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if window in often:
            covered += at + width - max(at, until)
            until = at + width
    return covered


def _counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = np.array([counts_of(text) for text in batch.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        yield pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(COUNTS))], list(COUNTS))


def text_counts(text: Column) -> Column:
    """``struct`` of ``COUNTS`` of a text column."""
    return F.arrow_udf(_counts, _COUNTS_TYPE).asNondeterministic()(text)


def features(counts: Column) -> dict[str, Column]:
    """What rules may look at: ratios that do not depend on the length of a text."""
    n, c = F.greatest(counts["n_words"], F.lit(1)).cast("double"), counts
    lines = F.greatest(c["n_lines"], F.lit(1)).cast("double")
    return {
        "word_length": c["word_chars"] / n, "symbols_per_word": c["n_symbols"] / n,
        "repeated_share": c["n_repeat_words"] / n, "duplicate_line_share": c["n_dup_lines"] / lines,
        "marks_per_word": c["n_marks"] / n, "capitals_share": c["n_upper"] / n,
        "distinct_share": c["n_distinct_words"] / n, "words_per_line": n / lines,
    }


def base_failed(counts: Column) -> Column:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def mask(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] > self.cut if self.above else table[self.feature] <= self.cut

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.cut if self.above else of[self.feature] <= self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, table: dict[str, np.ndarray], rows: int) -> np.ndarray:
    return reduce(and_, (c.mask(table) for c in rule), np.ones(rows, bool))


def learn(table: dict[str, np.ndarray], junk: np.ndarray, *, min_precision: float = MIN_PRECISION,
          seed: int = 11) -> list[Rule]:
    """Ordered rules for ``junk`` rows by sequential covering."""
    rules: list[Rule] = []
    left = np.ones(len(junk), bool)
    third = np.random.default_rng(seed).permutation(len(junk)) % 3
    while len(rules) < MAX_RULES and (left & junk).any() and (left & ~junk).any():
        growing, pruning = left & (third != 0), left & (third == 0)
        rule = _prune(_grow(table, junk, growing), table, junk, pruning)
        covers = _covered(rule, table, len(junk))
        held = covers & pruning
        if not rule or held.sum() == 0 or junk[held].mean() < min_precision \
                or junk[covers & left].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~covers
    return rules


def _grow(table: dict[str, np.ndarray], junk: np.ndarray, rows: np.ndarray) -> Rule:
    rule: list[Condition] = []
    inside = rows.copy()
    while len(rule) < MAX_CONDITIONS and (inside & ~junk).any() and (inside & junk).any():
        bad, good = (inside & junk).sum(), (inside & ~junk).sum()
        before = np.log2(bad / (bad + good))
        best, gain = None, 1e-9
        for name, values in table.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(values[inside & junk], np.linspace(0, 1, 16))]))
            order_bad, order_good = np.sort(values[inside & junk]), np.sort(values[inside & ~junk])
            low_bad = np.searchsorted(order_bad, cuts, "right")
            low_good = np.searchsorted(order_good, cuts, "right")
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(b > 0, b * (np.log2(b / (b + g)) - before), -1)
                at = int(gains.argmax())
                if gains[at] > gain:
                    best, gain = Condition(name, above, float(cuts[at])), gains[at]
        if best is None:
            break
        best = _centred(best, table[best.feature][inside])
        rule.append(best)
        inside &= best.mask(table)
    return tuple(rule)


def _centred(condition: Condition, values: np.ndarray) -> Condition:
    """The same split with the cut halfway between the values on either side."""
    above, below = values[values > condition.cut], values[values <= condition.cut]
    if not len(above) or not len(below):
        return condition
    return Condition(condition.feature, condition.above, float((above.min() + below.max()) / 2))


def _prune(rule: Rule, table: dict[str, np.ndarray], junk: np.ndarray, rows: np.ndarray) -> Rule:
    """Drop last conditions unless precision less error on fresh rows falls."""

    def worth(short: Rule) -> float:
        hit = _covered(short, table, len(junk)) & rows
        bad, good = (hit & junk).sum(), (hit & ~junk).sum()
        return (bad - good) / (bad + good) if bad + good else -1.0

    options = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(options, key=worth) if options else rule


def decision(rules: list[Rule], of: dict[str, Column]) -> Column:
    """The list as one conditional expression: number of the first rule that fits, or null."""
    out = None
    for number, rule in enumerate(rules, 1):
        fits = reduce(and_, (c.column(of) for c in rule))
        out = F.when(fits, F.lit(number)) if out is None else out.when(fits, F.lit(number))
    return F.lit(None).cast("int") if out is None else out


def rules_from(stats: DataFrame, labels: DataFrame, *, counts: str = "_counts", id_col: str = "doc_id",
               label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from labelled statistics that pass the base rules; label 0 is junk."""
    of = features(F.col(counts))
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
             .where(F.col("_label").isNotNull()))
    passed = stats.where(~base_failed(F.col(counts))).join(known, F.col(id_col) == F.col("_id"))
    rows = (by_hash(passed, sample_rows, id_col)
            .select(F.xxhash64(id_col).alias("_h"), "_label", *[c.alias(name) for name, c in of.items()])
            .orderBy("_h", "_label", *of).limit(sample_rows).toPandas())
    return learn({name: rows[name].to_numpy(np.float64) for name in of}, (rows["_label"] == 0).to_numpy())


def judged(stats: DataFrame, rules: list[Rule], *, counts: str = "_counts", into: str = "_quality") -> DataFrame:
    """``stats`` and a struct ``into``: ``base_failed``, ``rule`` (first that fits), ``kept``."""
    failed = base_failed(F.col(counts))
    rule = decision(rules, features(F.col(counts)))
    return stats.withColumn(into, F.struct(failed.alias("base_failed"), rule.alias("rule"),
                                           (~failed & rule.isNull()).alias("kept")))
