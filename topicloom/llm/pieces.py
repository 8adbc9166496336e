"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A text is normalised as the model says and cut before every run of the space mark
that follows another character. No piece of such a vocabulary spans that cut (this is
tested when the model is loaded; otherwise the text stays whole), so the chunks are
encoded one by one, and repeated chunks only once per cache fill. Within a chunk an
agenda of adjacent symbol pairs, ordered by piece score and then by position, is
worked off; characters without a piece become byte pieces. The agendas of all short
chunks that are not cached are worked off side by side, a step of each at a time.

Every text is compared with the sentencepiece library, which encodes it whole: what holds
of its chunks need not hold of the text, as the rules of a model may span blanks.

Null and empty texts have no pieces. A text of any length is encoded whole; one chunk
of n characters takes n log n steps. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, repeat
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_CHUNKS = 500_000
CACHED_LENGTH = 64
# Chunks whose agendas are worked off side by side.
AT_ONCE = 32_768
# Chunks up to this length keep their agenda as a list, longer ones as a heap.
SHORT = 48

RESULT = "struct<n_tokens:bigint,ids:binary,decoded:string,agrees:boolean>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,agrees:boolean>"

_loaded: dict[str, Pieces] = {}


class _Cache(dict):
    """Ids of chunks met so far in this process; emptied when full."""

    def __init__(self, encode: Callable[[str], bytes], encode_all: Callable[[list[str]], list[bytes]] | None = None):
        super().__init__()
        self.encode, self.encode_all = encode, encode_all

    def prepare(self, lists: Iterable[list[str]]) -> None:
        """Encode the short chunks of all ``lists`` that are not here, side by side."""
        if self.encode_all is None:
            return
        chunks = set().union(*lists)
        fresh = [chunk for chunk in chunks if chunk not in self and len(chunk) < SHORT]
        if len(self) + len(fresh) > CACHE_CHUNKS:
            self.clear()
            fresh = [chunk for chunk in chunks if len(chunk) < SHORT]
        del fresh[CACHE_CHUNKS:]
        for k in range(0, len(fresh), AT_ONCE):
            self.update(zip(fresh[k : k + AT_ONCE], self.encode_all(fresh[k : k + AT_ONCE])))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


class Agendas:
    """Pairs of symbols that are a piece, looked up by number, for many chunks at a time."""

    def __init__(self, ranks: dict[str, int], packed_symbol: Callable[[str], bytes]):
        self.packed_symbol = packed_symbol
        # Symbols are pieces and characters, numbered as they are met.
        self.symbols = list(dict.fromkeys([*ranks, *{c for piece in ranks for c in piece}]))
        number = {symbol: k for k, symbol in enumerate(self.symbols)}
        self.packed = list(map(packed_symbol, self.symbols))
        self.of_character = np.full(0x110000, -1, np.int64)
        for symbol, k in number.items():
            if len(symbol) == 1:
                self.of_character[ord(symbol)] = k
        pairs = sorted((number[piece[:k]] << 32 | number[piece[k:]], rank, number[piece])
                       for piece, rank in ranks.items() for k in range(1, len(piece))
                       if piece[:k] in number and piece[k:] in number)
        self.keys, ranks, joined = np.array([*pairs, (1 << 62, 0, 0)], np.int64).T.copy()
        self.ranks, self.joined = ranks.astype(np.int32), joined.astype(np.int32)

    def numbered(self, text: str) -> np.ndarray:
        """The symbols that the characters of a text are."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = self.of_character[codes]
        for code in np.unique(codes[out < 0]).tolist():
            self.of_character[code] = len(self.symbols)
            self.symbols.append(chr(code))
            self.packed.append(self.packed_symbol(chr(code)))
        return self.of_character[codes]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, 0 if it is no piece, and the symbol it is."""
        keys = left << 32 | right
        place = np.searchsorted(self.keys, keys)
        return self.ranks[place] * (self.keys[place] == keys), self.joined[place]

    def encode_all(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, named without their first mark."""
        if not chunks:
            return []
        marked = [SPACE + chunk for chunk in chunks]
        symbols = self.numbered("".join(marked))
        chunk = np.repeat(np.arange(len(marked), dtype=np.int32), list(map(len, marked)))
        at, done = np.arange(len(symbols), dtype=np.int32), []
        rank, joined = self.pairs(symbols, np.append(symbols[1:], 0))
        rank[np.diff(chunk, append=-1) != 0] = 0
        while len(chunk):
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            best = np.repeat(np.maximum.reduceat(rank, first), np.diff(first, append=len(chunk)))
            if not best.all():  # chunks without a pair are done
                done.append((at[best == 0], symbols[best == 0]))
                left = best > 0
                symbols, chunk, at, rank, joined, best = (x[left] for x in (symbols, chunk, at, rank, joined, best))
            pair = np.flatnonzero(rank == best)
            pair = pair[np.diff(chunk[pair], prepend=-1) != 0]  # the leftmost of each chunk
            symbols[pair] = joined[pair]
            stay = np.ones(len(chunk), bool)
            stay[pair + 1] = False
            pair -= np.arange(len(pair))  # where they are once the second symbols are gone
            symbols, chunk, at, rank, joined = (x[stay] for x in (symbols, chunk, at, rank, joined))
            changed = np.concatenate([pair, pair[pair > 0] - 1])
            after = np.minimum(changed + 1, len(chunk) - 1)
            rank[changed], joined[changed] = self.pairs(symbols[changed], symbols[after])
            rank[changed[(after == changed) | (chunk[after] != chunk[changed])]] = 0
        at, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        ends = np.searchsorted(at[order], list(accumulate(map(len, marked)))).tolist()
        out = list(map(self.packed.__getitem__, symbols[order].tolist()))
        return [b"".join(out[a:b]) for a, b in zip([0, *ends], ends)]


class Pieces:
    """A merge-type vocabulary read from a model file. Chunks are named without the
    space mark they all start with."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, size = self.library, self.library.get_piece_size()
        special = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        if any(lib.is_unused(i) for i in range(size)):
            raise ValueError("vocabularies with unused pieces are not supported")
        pieces = {lib.id_to_piece(i): i for i in range(size) if i not in special}
        scores = {piece: lib.get_score(i) for piece, i in pieces.items()}
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values())), 1)}
        self.ranks = {piece: ranks[score] for piece, score in scores.items()}
        self.known = {piece: _packed([i]) for piece, i in pieces.items()}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): _packed([i]) for i in special if lib.is_byte(i)}
        self.unknown = _packed([lib.unk_id()])
        self.ends = _packed([lib.bos_id()]), _packed([lib.eos_id()])
        every = " ".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000) + "  "
        self.identity = lib.normalize(every) == SPACE + every.replace(" ", SPACE)
        self.whole_texts = any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.runs = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        # Without byte pieces, what an unknown character gives depends on the one before it.
        self.cache = _Cache(self.chunk_ids, Agendas(self.ranks, self.symbol_ids).encode_all if self.bytes else None)

    def plain(self, text: str) -> bool:
        """Whether the chunks of a text are what lies between its blanks."""
        return (self.identity and not self.whole_texts and "  " not in text and SPACE not in text
                and not text.startswith(" ") and not text.endswith(" "))

    def chunks(self, text: str | None) -> list[str]:
        """The parts of a text that no piece spans, each without its first mark."""
        if not text:
            return []
        if self.plain(text):
            return text.split(" ")
        normal = SPACE + text.replace(" ", SPACE) if self.identity else self.library.normalize(text)
        if not normal.startswith(SPACE):
            raise ValueError("models without a dummy prefix are not supported")
        return [normal[1:]] if self.whole_texts else [run[1:] for run in self.runs(normal)]

    def merged(self, chunk: str) -> list[str]:
        """Symbols of a chunk once no adjacent pair is a piece; the best pair goes
        first, of equal ones the leftmost."""
        symbols = list(chunk)
        if len(symbols) > SHORT:
            return self.merged_long(symbols)
        rank = self.ranks.get
        agenda = list(map(rank, map(add, symbols, symbols[1:]), repeat(0)))
        while agenda and (best := max(agenda)):
            at = agenda.index(best)
            joined = symbols[at] + symbols.pop(at + 1)
            symbols[at] = joined
            del agenda[at]
            if at < len(agenda):
                agenda[at] = rank(joined + symbols[at + 1], 0)
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + joined, 0)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        rank, count = self.ranks.get, len(symbols)
        before, after = list(range(-1, count - 1)), [*range(1, count), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                pair = symbols[left] + symbols[right]
                if (found := rank(pair)) is not None:
                    heapq.heappush(agenda, (-found, left, right, len(pair)))

        for left in range(count - 1):
            offer(left, left + 1)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            first, second = symbols[left], symbols[right]
            if not first or not second or len(first) + len(second) != length:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = first + second, ""
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> bytes:
        symbols = self.merged(SPACE + chunk)
        try:
            return b"".join([self.known[s] for s in symbols])
        except KeyError:
            pass
        out: list[bytes] = []
        for symbol in symbols:
            if symbol in self.known or self.bytes:
                out.append(self.symbol_ids(symbol))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return b"".join(out)

    def symbol_ids(self, symbol: str) -> bytes:
        """Ids of a piece, or of the bytes of a character without one."""
        return self.known[symbol] if symbol in self.known else b"".join([self.bytes[b] for b in symbol.encode()])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end, as little-endian unsigned 32-bit integers, of each text."""
        chunks = list(map(self.chunks, texts))
        self.cache.prepare(chunks)
        return [b"".join([self.ends[0], *map(self.cache.__getitem__, one), self.ends[1]]) for one in chunks]

    def agrees(self, text: str | None, ids: list[int]) -> bool:
        """Whether the library, given the whole text, has the same ids."""
        return ids == self.library.encode(text or "", add_bos=True, add_eos=True)

    def checked(self, texts: list[str | None], check_every: int) -> tuple[list[bytes], list[str], list[bool]]:
        """Ids, decoded text and whether the library has the same ids, for each text;
        ``check_every`` texts are encoded and decoded at a time."""
        ids, decoded, agrees = [], [], []
        for k in range(0, len(texts), check_every):
            some = texts[k : k + check_every]
            ids += self.encode(some)
            numbers = list(map(_numbers, ids[k:]))
            decoded += self.library.decode(numbers, num_threads=1)
            agrees += map(self.agrees, some, numbers)
        return ids, decoded, agrees


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()


def _numbers(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def loaded(path: str) -> Pieces:
    """The model of this worker process, with what it has cached in earlier tasks."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text",
            digests_only: bool = False, check_every: int = 64) -> DataFrame:
    """One row per document: token count, ids (begin and end included), decoded text.

    ``ids`` is binary, four little-endian bytes each. ``digests_only`` gives SHA-256
    of the ids and of the decoded text instead, so that no text leaves the task.
    ``agrees`` says of every text whether the library, which encodes each of them whole, has
    the same ids. ``check_every`` texts are encoded and decoded at a time.
    """

    @F.arrow_udf(DIGEST if digests_only else RESULT)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(model_path)
        for batch in batches:
            ids, decoded, agrees = model.checked(batch.to_pylist(), check_every)
            columns = {"n_tokens": pa.array([len(one) // 4 for one in ids], pa.int64())}
            if digests_only:
                columns["ids_sha256"] = pa.array([hashlib.sha256(one).hexdigest() for one in ids], pa.string())
                columns["decoded_sha256"] = pa.array(
                    [hashlib.sha256(one.encode()).hexdigest() for one in decoded], pa.string())
            else:
                columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}
            columns["agrees"] = pa.array(agrees, pa.bool_())
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return (docs.select(F.col(id_col), encode.asNondeterministic()(F.col(text_col)).alias("_e"))
            .select(id_col, "_e.*"))
