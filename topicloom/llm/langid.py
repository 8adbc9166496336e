"""Language identification by a convolutional network over bytes.

Byte embeddings, filters of several widths, maximum over the window, one softmax
layer. It is trained in numpy on the driver with a bounded sample of labelled texts
(``per_language`` documents of each language, a few windows of each), and applied in
Arrow batches to the *whole* text, cut into windows of ``WINDOW`` bytes; a document's
distribution is the normalised geometric mean over its windows, weighted by bytes.

As a byte has 256 values and a pair 65,536, the filters are tabulated once per task:
wide filters become sums of two looked-up rows instead of products.

Null texts and texts without a letter get ``und`` and score 0, also everything if no
labelled text exists. Ties go to the language first in alphabetical order. Texts of
any length are read whole; memory is bounded by blocks of windows. Repeated rows are
judged alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import hash_below, utf8

WINDOW = 256
BLOCK = 64
DIM, FILTERS, WIDTHS = 8, 16, (2, 3, 4)
UNKNOWN = "und"
PREDICTION = "struct<lang_pred:string,score:double>"

# A to Z count as a to z.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class ByteNet:
    """Weights; ``languages`` in alphabetical order."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width a table by byte pair for its first two places, and one for
        the rest: by byte for a third place, by byte pair for a third and fourth."""
        first, second = np.divmod(np.arange(65536), 256)
        out = []
        for w in self.filters:
            at = [(self.embedding @ w[j]).astype(np.float32) for j in range(len(w))]
            rest = None if len(w) == 2 else at[2] if len(w) == 3 else at[2][first] + at[3][second]
            out.append((at[0][first] + at[1][second], rest))
        return out


def train(texts: list[str], labels: list[str], *, steps: int = 500, rate: float = 0.01,
          seed: int = 7) -> ByteNet | None:
    """Fit on windows of the given texts; None without any."""
    languages = sorted(set(labels))
    if not languages:
        return None
    data, target = [], []
    for text, label in zip(texts, labels):
        raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
        for start in range(0, len(raw), WINDOW):
            piece = raw[start : start + WINDOW]
            if start == 0 or len(piece) >= WINDOW // 4:
                data.append(np.pad(piece, (0, WINDOW - len(piece))))
                target.append(languages.index(label))
    x, y = np.array(data, np.uint8), np.array(target)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (256, DIM)), *(rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)) for w in WIDTHS),
              np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))),
              np.zeros(len(languages))]
    params = [p.astype(np.float32) for p in params]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    per_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        # Every language equally often; also short pieces, as short texts come too.
        rows = np.array([rng.choice(per_class[k]) for k in rng.integers(0, len(languages), 48)])
        batch = x[rows].copy()
        for row, keep in zip(batch, rng.choice([24, 64, WINDOW, WINDOW], len(batch))):
            row[keep:] = 0
        for p, (m, v), g in zip(params, moments, _gradients(params, batch, y[rows]), strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return ByteNet(languages, params[0], params[1:4], params[4], params[5], params[6])


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, by hand: each filter learns from its maximal place."""
    embedding, filters, bias, out, out_bias = params[0], params[1:4], params[4], params[5], params[6]
    rows, features = np.arange(len(x)), FILTERS * len(WIDTHS)
    embedded = embedding[x]
    best = np.empty((len(x), features), np.int64)
    top = np.empty((len(x), features), np.float32)
    for k, w in enumerate(filters):
        width, places = len(w), WINDOW - len(w) + 1
        seen = sum(embedded[:, j : j + places] @ w[j] for j in range(width))
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        best[:, own] = seen.argmax(1)
        top[:, own] = seen.max(1)
    pre = top + bias
    hidden = np.maximum(pre, 0)
    logits = hidden @ out + out_bias
    chance = np.exp(logits - logits.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    error = chance
    error[rows, y] -= 1
    error /= len(x)
    back = (error @ out.T) * (pre > 0)
    to_embedding, to_filters = np.zeros_like(embedding), []
    for k, w in enumerate(filters):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        grad = np.zeros_like(w)
        for j in range(len(w)):
            at = x[rows[:, None], best[:, own] + j]
            grad[j] = np.einsum("nfd,nf->df", embedding[at], back[:, own])
            np.add.at(to_embedding, at, back[:, own, None] * w[j].T[None])
        to_filters.append(grad)
    return [to_embedding, *to_filters, back.sum(0), hidden.T @ error, error.sum(0)]


class Scorer:
    """A network with its tables, inside a task."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.tables = net.tables()

    def documents(self, column: pa.Array) -> np.ndarray:
        """Log probabilities of each row's languages, over its whole text."""
        data, offsets = utf8(column)
        sizes = np.diff(offsets)
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), counts)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = offsets[:-1][owner] + inside * WINDOW
        ends = np.minimum(starts + WINDOW, offsets[1:][owner])
        total = np.zeros((len(sizes), len(self.net.languages)))
        for at in range(0, len(owner), BLOCK):
            some = slice(at, at + BLOCK)
            places = starts[some, None] + np.arange(WINDOW)
            inside = places < ends[some, None]
            windows = np.where(inside, _FOLD[data[np.minimum(places, len(data) - 1)]], 0)
            weight = (ends[some] - starts[some])[:, None]
            np.add.at(total, owner[some], self.windows(windows) * weight)
        return total / np.maximum(sizes, 1)[:, None]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities of windows; the places of a window lie outermost, so that
        the maximum runs over long contiguous rows."""
        x = np.ascontiguousarray(x.T).astype(np.int32)
        pairs = x[:-1] * 256 + x[1:]
        top = []
        for (head, rest), width in zip(self.tables, WIDTHS, strict=True):
            seen = head.take(pairs[: WINDOW - width + 1], axis=0, mode="clip")
            if rest is not None:
                seen += rest.take((x if width == 3 else pairs)[2:], axis=0, mode="clip")
            top.append(seen.max(0))
        logits = np.maximum(np.hstack(top) + self.net.bias, 0) @ self.net.out + self.net.out_bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def predictor(net: ByteNet | None):
    """A column function: text to ``struct<lang_pred, score>``."""

    @F.arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(net) if net else None
        for batch in batches:
            lettered = np.array([any(map(str.isalpha, t or "")) for t in batch.to_pylist()], bool)
            if scorer is None or not len(batch):
                names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            else:
                logs = scorer.documents(batch)
                chances = np.exp(logs - logs.max(1, keepdims=True))
                chances /= chances.sum(1, keepdims=True)
                best = chances.argmax(1)
                names = [net.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
                scores = np.where(lettered, chances.max(1), 0.0)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["lang_pred", "score"])

    return predict.asNondeterministic()


def sample(docs: DataFrame, usable: Column, *, per_language: int = 250, id_col: str = "doc_id",
           text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """At most ``per_language`` usable documents of each language, picked by a hash of
    the id, three stretches of 512 characters of each: a bounded sample to train on."""
    length = F.length(text_col)
    cuts = [F.substring(text_col, 1, 512), F.when(length > 1024, F.substring(F.col(text_col), length / 2, F.lit(512))),
            F.when(length > 2048, F.substring(F.col(text_col), length - 511, F.lit(512)))]
    order = Window.partitionBy("label").orderBy("h", "t")
    teach = docs.where(usable & F.col(lang_col).isNotNull())
    # One row a language, as the network has a class for each. Texts are read only where the
    # hash is low enough; a language of which 7 in 8 have no letter gets a smaller sample.
    part = teach.groupBy(F.col(lang_col).alias("_taught")).agg((F.lit(8.0 * per_language) / F.count(F.lit(1))).alias("_part"))
    few = teach.join(F.broadcast(part), F.col(lang_col) == F.col("_taught")).where(hash_below(F.col("_part"), id_col))
    rows = (few.where(F.col(text_col).rlike(r"\p{L}"))
            .select(F.col(lang_col).alias("label"), F.xxhash64(id_col).alias("h"),
                    F.concat_ws("\n", *[c.cast("string") for c in cuts]).alias("t"))
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
            .orderBy("label", "n").select("t", "label").toPandas())
    return rows["t"].tolist(), rows["label"].tolist()


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that never teach: CRC-32 of the id's text leaves 2 when divided by 4
    (also where the id is null)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def with_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  per_language: int = 250, into: str = "_language") -> DataFrame:
    """``docs`` and a struct column ``into`` of ``lang_pred`` and ``score``."""
    texts, labels = sample(docs, ~held_out(id_col), per_language=per_language, id_col=id_col,
                           text_col=text_col, lang_col=lang_col)
    return docs.withColumn(into, predictor(train(texts, labels))(F.col(text_col)))
