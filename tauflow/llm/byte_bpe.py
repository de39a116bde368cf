"""Byte-level byte-pair encoding and decoding.

Pieces are found without a regular expression. Each code point becomes a class by one table look-up; each class is
a transition function over the states of a small automaton. All functions that composing them can give are numbered
once, so composing two is one look-up in a table, and because composing is associative the state before every code
point of a whole batch comes from a blocked scan: all blocks advance together, then the blocks' totals are scanned,
then every block is started in its true state. A text's end is the constant function back to the first state, so
texts of a batch do not touch each other. State, class and the next class tell where a piece starts.

A piece's bytes are merged by rank (the lowest rank first, the leftmost of equal ones). All new short pieces of a batch
are merged together in numpy, each by its own best pair in every round; ids of pieces are kept in a cache of bounded
size. The ids and the byte offset of every id in its text are returned. Decoding puts each id's bytes at its
offset; without offsets they are the running sum of the ids' lengths.

Null and empty texts have no ids. Texts are encoded whole, of any length (one piece of n bytes costs n log n).
Special tokens are ordinary text. Repeated rows each get their row; an empty table gives an empty table; equal ranks
cannot occur in a rank file, and ties between pairs go to the left. Added columns go into one struct, so no name of
the table clashes.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tauflow.llm.common import record

ENCODED = record(ids="binary", offsets="binary", n_tokens="long")
ROUND_TRIP = record(ids="binary", offsets="binary", n_tokens="long", decoded="binary")
#: Code points worked on together; only memory depends on it.
CHUNK = 1 << 19
#: Pieces that a worker keeps with their ids (besides as many used before), the longest piece kept and merged with others
#: at the same time, and how many are; only time and memory depend on them.
CACHED, SHORT_BYTES, TOGETHER = 100_000, 64, 8192

# Classes of code points.
END, SPACE, OTHER_SPACE, QUOTE, ONE, LEAD_E, LEAD_L, LAST_E, LETTER, NUMBER, OTHER = range(11)
# States: what the last code point was. QUOTED: a quote that begins a piece; then one that may become 're or 've, 'll; SHORT: after such.
START, SPACED, BLANK, IN_WORD, IN_NUMBER, IN_OTHER, QUOTED, QUOTED_E, QUOTED_L, SHORT = range(10)

# The code points with the White_Space property.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Letters after a quote that are a piece with it: 's 't 'm 'd, 're 've, 'll.
SINGLE, BEFORE_E = "stmd", "rv"


@cache
def class_of() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE_SPACE)] = OTHER_SPACE
    table[ord(" ")], table[ord("'")], table[ord("l")], table[ord("e")] = SPACE, QUOTE, LEAD_L, LAST_E
    table[[ord(c) for c in SINGLE]] = ONE
    table[[ord(c) for c in BEFORE_E]] = LEAD_E
    return table


def _next(state: int, kind: int) -> int:
    if kind == END:
        return START
    if kind in (SPACE, OTHER_SPACE):
        return SPACED if kind == SPACE else BLANK
    if kind == NUMBER:
        return IN_NUMBER
    if kind in (QUOTE, OTHER):
        return IN_OTHER if kind == OTHER or state in (SPACED, IN_OTHER, QUOTED) else QUOTED
    if state == QUOTED:
        return {ONE: SHORT, LEAD_E: QUOTED_E, LEAD_L: QUOTED_L}.get(kind, IN_WORD)
    return SHORT if (state, kind) in ((QUOTED_E, LAST_E), (QUOTED_L, LEAD_L)) else IN_WORD


def _starts(state: int, kind: int, following: int) -> bool:
    """Whether a piece starts at a code point, by the state before it, its class and the next one's class."""
    if kind == END:
        return True
    if kind in (SPACE, OTHER_SPACE):
        return state not in (SPACED, BLANK) or following not in (SPACE, OTHER_SPACE, END)
    if state == SPACED:
        return False
    if kind == NUMBER:
        return state != IN_NUMBER
    if kind in (QUOTE, OTHER):
        return state not in (IN_OTHER, QUOTED)
    if state == QUOTED:
        return not (kind == ONE or (kind, following) in ((LEAD_E, LAST_E), (LEAD_L, LEAD_L)))
    return state not in (IN_WORD, QUOTED_E, QUOTED_L)


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of each class's function; composition table of all numbered functions; function x state -> state; start table."""
    classes, states = range(OTHER + 1), range(SHORT + 1)
    single = [tuple(_next(s, k) for s in states) for k in classes]
    numbered: dict[tuple, int] = {}
    for f in single:
        numbered.setdefault(f, len(numbered))
    todo = list(numbered)
    while todo:  # close under composition with one more class
        f = todo.pop()
        for g in single:
            composed = tuple(g[s] for s in f)
            if composed not in numbered:
                numbered[composed] = len(numbered)
                todo.append(composed)
    functions = list(numbered)
    compose = np.array([[numbered[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    starts = np.array([[[_starts(s, k, n) for n in classes] for k in classes] for s in states])
    return np.array([numbered[f] for f in single], np.uint16), compose, np.array(functions, np.uint8), starts


def states_before(kinds: np.ndarray) -> np.ndarray:
    """State of the automaton before every code point: an exclusive scan of the classes' transition functions."""
    number, compose, apply, _ = automaton()
    n, size = len(kinds), len(compose)
    rows = max(1, int(np.sqrt(n)))
    blocks = -(-n // rows)
    padded = np.full(rows * blocks, number[END], np.uint16)
    padded[:n] = number[kinds]
    running = np.ascontiguousarray(padded.reshape(blocks, rows).T).astype(np.intp)  # one column per block
    flat = compose.ravel()
    for j in range(1, rows):
        running[j] = flat[running[j - 1] * size + running[j]]
    entry = np.zeros(blocks, np.intp)  # state at the start of each block
    totals, state = running[-1].tolist(), START
    for b in range(blocks):
        entry[b] = state
        state = int(apply[totals[b], state])
    before = np.empty((rows, blocks), np.uint8)
    before[0] = entry
    before[1:] = apply[running[:-1], entry[None, :]]
    return before.T.ravel()[:n]


def piece_starts(kinds: np.ndarray) -> np.ndarray:
    """Positions at which a piece starts or a text ends. ``kinds`` must close with ``END``."""
    following = np.append(kinds[1:], END)
    return np.flatnonzero(automaton()[3][states_before(kinds), kinds, following])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: neighbours with the lowest rank are joined, the leftmost first, until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if stop[i] else n
        if j >= n or stop[j] != end or not stop[i]:
            continue  # one of the two was joined otherwise meanwhile
        stop[i], stop[j], after[i] = end, 0, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : stop[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, stop[after[j]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : stop[i]]])
        i = after[i]
    return ids


class Vocabulary(dict):
    """Pieces with their ids as bytes; holds the ranks, the pairs that may be joined and, for decoding, all tokens end to end."""

    def __init__(self, file: bytes) -> None:
        super().__init__()
        pairs = [line.split() for line in file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, self.size)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        rank = self.ranks.get
        halves = [
            (first * (self.size + 1) + second, joined) for token, joined in self.ranks.items() for i in range(1, len(token))
            if (first := rank(token[:i])) is not None and (second := rank(token[i:])) is not None]
        self.pairs, self.joined = np.array(sorted(halves), np.int64).reshape(-1, 2).T.copy()
        self.older: dict[bytes, bytes] = {}

    def _join(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Id of two tokens joined; the vocabulary's size where there is none."""
        key = first.astype(np.int64) * (self.size + 1) + second
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joined[at], self.size).astype(np.int32)

    def _merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, all merged at the same time: every round joins the best pair of each piece that has one."""
        count, width = len(pieces), max(map(len, pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(piece.ljust(width, b"\0") for piece in pieces), np.uint8).reshape(count, width)
        beyond = np.arange(width + 1) >= lengths[:, None]
        ids = np.full((count, width + 1), self.size, np.int32)  # a token beyond the end joins with none
        ids[:, :-1] = self.of_byte[raw]
        ids[beyond] = self.size
        after = np.minimum(np.arange(1, width + 2), width)[None, :].repeat(count, 0)
        before = np.arange(-1, width)[None, :].repeat(count, 0)
        best = np.full((count, width + 1), self.size, np.int32)
        best[:, :-1] = self._join(ids[:, :-1], ids[:, 1:])
        rows = np.arange(count)
        while True:
            at = best[rows].argmin(1)  # the leftmost of equal ones
            rank = best[rows, at]
            open_ = rank < self.size
            rows, at, rank = rows[open_], at[open_], rank[open_]
            if not len(rows):
                break
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            ids[rows, at], ids[rows, gone] = rank, -1
            after[rows, at], before[rows, right] = right, at
            best[rows, gone] = self.size
            best[rows, at] = self._join(rank, ids[rows, right])
            has_left = left >= 0
            to, column = rows[has_left], left[has_left]
            best[to, column] = self._join(ids[to, column], rank[has_left])
        kept = (ids >= 0) & ~beyond
        ends = np.cumsum(kept.sum(1)).tolist()
        flat = ids[kept].astype("<u4").tobytes()
        return [flat[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Have the ids of all these pieces ready; returns those too long to be kept."""
        if len(self) >= CACHED:  # what was not used since the last time goes
            self.older = dict(self)
            self.clear()
        new = set(pieces).difference(self)
        known = {p: self.older[p] for p in new if p in self.older}
        known |= {p: self.ranks[p].to_bytes(4, "little") for p in new if p in self.ranks}
        self.update(known)
        new.difference_update(known)
        long = [p for p in new if len(p) > SHORT_BYTES]
        self.update({p: np.array(merge(p, self.ranks), "<u4").tobytes() for p in long})
        short = sorted(new.difference(long), key=len)
        for at in range(0, len(short), TOGETHER):
            some = short[at : at + TOGETHER]
            self.update(zip(some, self._merge_all(some)))
        return long

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids and byte offsets of the ids of each text, as little-endian unsigned 32-bit integers."""
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kinds = class_of()[points]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends] = END
        starts = piece_starts(kinds)
        width = 1 + (points >= 0x80).view(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        cuts = (np.cumsum(width, dtype=np.int64)[starts] - width[starts]).tolist()
        raw = "\0".join([*texts, ""]).encode()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:])]  # those of the texts' ends among them
        long = self.learn(pieces)
        ids, offsets, at = [], [], 0
        for stop in np.searchsorted(starts, ends).tolist():
            own = b"".join(map(self.__getitem__, pieces[at:stop]))
            sizes = self.lengths[np.frombuffer(own, "<u4")]
            ids.append(own)
            offsets.append((np.cumsum(sizes) - sizes).astype("<u4").tobytes())
            at = stop + 1
        for piece in long:
            del self[piece]
        return ids, offsets

    def decode(self, ids: bytes, offsets: bytes | None = None) -> bytes:
        """The bytes of the ids, each at its offset."""
        numbers = np.frombuffer(ids, "<u4")
        sizes = self.lengths[numbers]
        places = np.frombuffer(offsets, "<u4").astype(np.int64) if offsets is not None else np.cumsum(sizes) - sizes
        steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out = np.zeros(int((places + sizes).max(initial=0)), np.uint8)
        out[np.repeat(places, sizes) + steps] = self.bytes[np.repeat(self.places[numbers], sizes) + steps]
        return out.tobytes()


_vocabularies: dict[object, Vocabulary] = {}


def _vocabulary(file) -> Vocabulary:
    """A worker's vocabulary, made once from the broadcast rank file."""
    if file.id not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[file.id] = Vocabulary(file.value)
    return _vocabularies[file.id]


def _chunks(texts: pd.Series) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        chunk.append(text if isinstance(text, str) else "")
        size += len(chunk[-1]) + 1
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _encoded(file, batches: Iterator[pd.Series]) -> Iterator[tuple[Vocabulary, list[bytes], list[bytes]]]:
    vocabulary = _vocabulary(file)
    for texts in batches:
        for chunk in _chunks(texts):  # results leave the worker chunk by chunk
            yield vocabulary, *vocabulary.encode(chunk)


class _Shipped:
    """A broadcast with a name that stays the same in a worker."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        self._broadcast = spark.sparkContext.broadcast(content)
        self.id = (path, len(content), hash(content))

    @property
    def value(self) -> bytes:
        return self._broadcast.value


class Codec:
    """Encoder and decoder by one rank file. The driver reads the file (its size is fixed, about 1 MB) and broadcasts it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._file = _Shipped(spark, path)

    def encode(self, text: Column | str) -> Column:
        """Struct of ``ids`` and ``offsets`` (both little-endian unsigned 32-bit integers) and ``n_tokens``."""
        file = self._file

        @F.pandas_udf(ENCODED)
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vocabulary, ids, offsets in _encoded(file, batches):
                yield pd.DataFrame({"ids": ids, "offsets": offsets, "n_tokens": [len(x) // 4 for x in ids]}, columns=ENCODED.names)

        return encode(text)

    def round_trip(self, text: Column | str) -> Column:
        """As ``encode``, with the bytes that the ids decode to, ``decoded``; in one worker."""
        file = self._file

        @F.pandas_udf(ROUND_TRIP)
        def round_trip(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for vocabulary, ids, offsets in _encoded(file, batches):
                decoded = [vocabulary.decode(i, o) for i, o in zip(ids, offsets)]
                yield pd.DataFrame(
                    {"ids": ids, "offsets": offsets, "n_tokens": [len(x) // 4 for x in ids], "decoded": decoded}, columns=ROUND_TRIP.names)

        return round_trip(text)

    def decode(self, ids: Column | str, offsets: Column | str) -> Column:
        """The bytes of a text from its ids and their offsets."""
        file = self._file

        @F.pandas_udf("binary")
        def decode(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            vocabulary = _vocabulary(file)
            for some_ids, some_offsets in batches:
                yield pd.Series([None if i is None else vocabulary.decode(i, o) for i, o in zip(some_ids, some_offsets)], dtype=object)

        return decode(ids, offsets)


def encode_documents(docs: DataFrame, path: str, text: Column | str = "text") -> DataFrame:
    """One row per document row: doc_id and ``tokens`` (ids, offsets, n_tokens, and ``decoded``: the bytes that the ids give)."""
    return docs.select("doc_id", Codec(docs.sparkSession, path).round_trip(text).alias("tokens"))


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded bytes."""
    return encode_documents(docs, path).select(
        "doc_id", "tokens.n_tokens", F.sha2("tokens.ids", 256).alias("ids_sha256"), F.sha2("tokens.decoded", 256).alias("decoded_sha256"),
    )
