"""Model stages: embedding and text generation with pluggable callables.

A stage gets a factory; each task calls it once, so a client is built per task
and never pickled. Text must be masked before it comes here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.functions.arrow import list_array

EMBEDDING_DIMENSION = 1536
# Texts handed to a provider at a time; also bounds the matrix a task holds.
EMBED_ROWS = 256

Embed = Callable[[Sequence[str]], np.ndarray]
Generate = Callable[[str], str]


class _WordCodes(dict):
    """First 32 bits of a word's MD5, computed once per word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = code = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return code


def hashing_embedder(dimension: int = EMBEDDING_DIMENSION) -> Callable[[], Embed]:
    """Offline default: signed feature hashing of lower-cased words."""

    def build() -> Embed:
        code_of, words_of = _WordCodes(), re.compile(r"[^\W_]+").findall

        def embed(texts: Sequence[str]) -> np.ndarray:
            words = [words_of(text.lower()) for text in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            codes = np.fromiter(map(code_of.__getitem__, chain.from_iterable(words)), np.int64, sizes.sum())
            place = np.repeat(np.arange(len(texts)) * dimension, sizes) + codes % dimension
            signs = np.where(codes < 1 << 31, 1.0, -1.0)
            return np.bincount(place, signs, len(texts) * dimension).reshape(len(texts), dimension)

        return embed

    return build


_EMBEDDERS: dict[str, Callable[[int], Callable[[], Embed]]] = {"hashing": hashing_embedder}


def register_embedder(name: str, make: Callable[[int], Callable[[], Embed]]) -> None:
    _EMBEDDERS[name] = make


def embedder(name: str, dimension: int = EMBEDDING_DIMENSION) -> Callable[[], Embed]:
    if name not in _EMBEDDERS:
        raise ValueError(f"Unknown provider {name!r}; known: {sorted(_EMBEDDERS)}")
    return _EMBEDDERS[name](dimension)


def _checked_units(rows: np.ndarray, count: int, dimension: int) -> np.ndarray:
    rows = np.asarray(rows, dtype=np.float64)
    if rows.shape != (count, dimension):
        raise ValueError(f"provider returned shape {rows.shape}, wanted {(count, dimension)}")
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=rows.copy(), where=norms > 0)


def embed_texts(df: DataFrame, text_col: str, build: Callable[[], Embed],
                dimension: int = EMBEDDING_DIMENSION, out_col: str = "embedding") -> DataFrame:
    """Replace ``text_col`` by a unit vector of ``dimension`` floats."""
    kept = [c for c in df.columns if c not in (text_col, out_col)]
    schema = T.StructType([df.schema[c] for c in kept])
    schema = schema.add(out_col, T.ArrayType(T.FloatType()))
    arrow_schema = to_arrow_schema(schema)

    def stage(batches):
        embed = build()
        pieces = (batch.slice(at, EMBED_ROWS) for batch in batches for at in range(0, len(batch), EMBED_ROWS))
        for batch in pieces:
            texts = batch.column(text_col).to_pylist()
            units = _checked_units(embed(texts), len(texts), dimension)
            columns = [batch.column(c).cast(arrow_schema.field(c).type) for c in kept]
            vectors = list_array(units.astype(np.float32)).cast(arrow_schema.field(out_col).type)
            yield pa.RecordBatch.from_arrays([*columns, vectors], schema=arrow_schema)

    return df.mapInArrow(stage, schema)


def generate_texts(df: DataFrame, prompt_col: str, build: Callable[[], Generate],
                   out_col: str = "answer", error_col: str = "error") -> DataFrame:
    """Replace ``prompt_col`` by an answer; a failed call becomes its row's error."""
    kept = [c for c in df.columns if c != prompt_col]
    schema = T.StructType([df.schema[c] for c in kept])
    schema = schema.add(out_col, T.StringType()).add(error_col, T.StringType())
    arrow_schema = to_arrow_schema(schema)

    def stage(batches):
        generate = build()
        for batch in batches:
            answers, errors = [], []
            for prompt in batch.column(prompt_col).to_pylist():
                answer = error = None
                try:
                    answer = generate(prompt)
                    if not answer:
                        error = "provider returned no text"
                except Exception as failure:  # noqa: BLE001 - isolated per row by design
                    error = str(failure)
                answers.append(answer)
                errors.append(error)
            columns = [batch.column(c).cast(arrow_schema.field(c).type) for c in kept]
            columns += [pa.array(answers, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    return df.mapInArrow(stage, schema)
