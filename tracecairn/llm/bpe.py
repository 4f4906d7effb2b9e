"""Byte-level BPE encoding and decoding without regular expressions.

Texts are cut into pieces by a small automaton over classes of code points. What a
character does to the automaton is a function from state to state, and such functions
compose associatively, so the state before every character of a whole chunk comes from a
scan over composed functions: within blocks column by column, across blocks by doubling.
A piece begins where the automaton says so. Pieces are then looked up in a cache of merged
pieces; new ones are merged pair by pair, lowest rank first.

Null texts count as empty and give no ids. Any code point is allowed, unpaired surrogates
aside, which Spark's strings cannot hold. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecairn.llm.common import chunks, code_points, runs_within, texts_of

_LETTER, _NUMBER, _SPACE = 1, 2, 3
#: What a character is to the automaton, after a look at its next two neighbours.
(LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, BLANK, LAST_SPACE, LAST_BLANK) = range(8)
#: Added to a symbol where a text begins: the state before it is forgotten.
RESET = 8
#: States: a fresh start, inside a run of each kind, after a space that joins the next run,
#: and one or two letters before the end of a contraction.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE) = range(8)
#: The letters after an apostrophe that form a contraction.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Symbol of each class before the neighbours are looked at.
_PLAIN = np.array([OTHER, LETTER, NUMBER, BLANK], np.uint8)
BLOCK = 128
CACHE_PIECES = 400_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this character."""
    if symbol == LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return START, False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (OTHER, QUOTE2, QUOTE3):
        if state in (IN_OTHERS, JOINING):
            return IN_OTHERS, False
        return {OTHER: IN_OTHERS, QUOTE2: ONE_MORE, QUOTE3: TWO_MORE}[symbol], True
    if symbol == BLANK:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINING if symbol == LAST_SPACE else IN_BLANKS), True


@cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables: state and cut by (state, symbol); functions by (function, symbol) and by
    (function, function); each function's value at START."""
    symbols = range(2 * RESET)
    step = [[_step(START if y >= RESET else s, y % RESET) for y in symbols] for s in range(8)]
    after = np.array([[x[0] for x in row] for row in step], np.uint8)
    cut = np.array([[x[1] or y >= RESET for y, x in enumerate(row)] for row in step])
    single = [tuple(int(after[s, y]) for s in range(8)) for y in symbols]
    known = {tuple(range(8)): 0}
    waiting = list(known)
    while waiting:
        f = waiting.pop()
        for g in single:
            made = tuple(g[x] for x in f)
            if made not in known:
                known[made] = len(known)
                waiting.append(made)
    functions = list(known)
    by_symbol = np.array([[known[tuple(g[x] for x in f)] for g in single] for f in functions],
                         np.uint16)
    by_function = np.array([[known[tuple(g[x] for x in f)] for g in functions]
                            for f in functions], np.uint16)
    return after, cut, by_symbol, by_function, np.array([f[START] for f in functions], np.uint8)


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the public tokenizer library's patterns see it."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    single_bytes = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        one = tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single_bytes,
                                special_tokens={})
        found = bytes(one.encode_ordinary(every)).decode()
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


def symbols_of(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Automaton symbols; ``begins`` as code_points() gives it."""
    n = len(points)
    kind = classes()[points]
    full = begins[1:] > begins[:-1]
    last = np.zeros(n, bool)
    last[begins[1:][full] - 1] = True
    out = _PLAIN[kind]
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        ahead = np.concatenate((points, np.zeros(2, np.uint32)))
        ends = np.concatenate((last, [True, True]))
        a = np.where(ends[quote], 0, ahead[quote + 1])
        b = np.where(ends[quote] | ends[quote + 1], 0, ahead[quote + 2])
        for x in SHORT_ENDINGS:
            out[quote[a == ord(x)]] = QUOTE2
        for x, y in LONG_ENDINGS:
            out[quote[(a == ord(x)) & (b == ord(y))]] = QUOTE3
    # Blanks before something else; the end of a text counts as a blank.
    blank = kind == _SPACE
    ends_run = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends_run = ends_run[~last[ends_run]]
    out[ends_run] = np.where(points[ends_run] == ord(" "), LAST_SPACE, LAST_BLANK)
    out[begins[:-1][full]] += RESET
    return out


def piece_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions, in code points, at which pieces begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    after, cut, by_symbol, by_function, at_start = automaton()
    after, cut, by_symbol = after.ravel(), cut.ravel(), by_symbol.ravel()
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint8)
    grid[:n] = symbols_of(points, begins)
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    whole = np.zeros(rows, np.uint16)
    for column in grid:
        whole = by_symbol[whole * (2 * RESET) + column]
    reach = 1
    while reach < rows:
        joined = whole.copy()
        joined[reach:] = by_function[whole[:-reach], whole[reach:]]
        whole, reach = joined, 2 * reach
    state = np.concatenate((np.uint8([START]), at_start[whole[:-1]]))
    found = np.empty(grid.shape, bool)
    for i, column in enumerate(grid):
        at = state * np.uint8(2 * RESET) + column
        found[i] = cut[at]
        state = after[at]
    return np.flatnonzero(found.T.reshape(-1)[:n])


def byte_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def pieces_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different pieces of all texts as UTF-8, which of them each piece is, and how many
    pieces each text has."""
    points, begins = code_points(texts)
    starts = piece_starts(points, begins)
    counts = np.diff(np.searchsorted(starts, begins))
    data = "".join(texts).encode()
    if len(data) != len(points):
        at = np.concatenate(([0], np.cumsum(byte_lengths(points))))
        starts = at[starts]
    edges = np.append(starts, len(data)).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(edges), pa.py_buffer(data)])
    known = every.dictionary_encode()
    return known.dictionary.to_pylist(), known.indices.to_numpy(), counts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: neighbours that form the lowest rank merge first, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    # A heap of candidate pairs over a linked list of parts.
    end, n = list(range(1, len(piece) + 1)), len(piece)
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if middle is None or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, None
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i]:stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Merger:
    """Merges many short pieces at once: in each round every piece merges its best pair."""

    LONGEST = 64
    NONE = np.int64(1) << 40

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: rank for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.values = np.fromiter(map(pairs.__getitem__, self.keys.tolist()), np.int64, len(pairs))
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        left, right = np.meshgrid(self.single, self.single, indexing="ij")
        self.of_bytes = self.look_up(left.reshape(-1), right.reshape(-1))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), self.NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], self.NONE)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each piece has."""
        is_long = [len(x) > self.LONGEST for x in pieces]
        if any(is_long):
            return self._mixed(pieces, is_long)
        sizes = np.array([len(x) for x in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        ids, owner = self.single[data], np.repeat(np.arange(len(pieces)), sizes)
        rank = np.full(len(ids), self.NONE)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.of_bytes[data[inner] * 256 + data[inner + 1]]
        done_ids, done_owner = [], []
        while len(ids):
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, heads)
            spread = np.repeat(best, np.diff(np.concatenate((heads, [len(ids)]))))
            over = spread == self.NONE
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, spread = ids[~over], owner[~over], rank[~over], spread[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == spread)
            at = at[np.concatenate(([True], owner[at[1:]] != owner[at[:-1]]))]
            ids[at] = rank[at]
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, owner, rank = ids[kept], owner[kept], rank[kept]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                rank[i] = self.NONE
                i = i[i + 1 < len(ids)]
                i = i[owner[i] == owner[i + 1]]
                rank[i] = self.look_up(ids[i], ids[i + 1])
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(done_ids)[order] if done_ids else owner,
                np.bincount(owner, minlength=len(pieces)))

    def _mixed(self, pieces: list[bytes], is_long: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self([b"" if long else x for x, long in zip(pieces, is_long)])
        parts, at = [], 0
        ends = np.cumsum(sizes)
        for i in np.flatnonzero(is_long).tolist():
            own = np.array(merge(pieces[i], self.ranks), np.int64)
            parts += [ids[at:ends[i]], own]
            at, sizes[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[at:]]), sizes


class PieceCache:
    """Ids of pieces seen so far, in arrays. Emptied when it holds CACHE_PIECES pieces."""

    def __init__(self, encode, decimals: list[bytes] | None = None):
        self.encode, self.decimals = encode, decimals
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.ends, self.decimal = array("i"), array("q", [0]), []

    def places(self, pieces: list[bytes]) -> np.ndarray:
        """Where the ids of each of these different pieces are; unknown ones are encoded first."""
        if len(self.place) > CACHE_PIECES:
            self.clear()
        got = list(map(self.place.get, pieces))
        missing = [i for i, at in enumerate(got) if at is None]
        if missing:
            new = [pieces[i] for i in missing]
            ids, sizes = self.encode(new)
            fresh = range(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, fresh))
            ends = np.cumsum(sizes)
            self.ends.frombytes((ends + len(self.ids)).astype(np.int64).tobytes())
            self.ids.frombytes(ids.astype(np.int32).tobytes())
            if self.decimals:
                words = list(map(self.decimals.__getitem__, ids.tolist()))
                edges = [0, *ends.tolist()]
                self.decimal += [b" ".join(words[a:b]) for a, b in zip(edges, edges[1:])]
            for i, at in zip(missing, fresh):
                got[i] = at
        return np.array(got, np.int64)

    def expand(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many each piece has."""
        ends = np.frombuffer(self.ends, np.int64)
        sizes = (ends[1:] - ends[:-1])[places]
        at = np.repeat(ends[:-1][places], sizes) + runs_within(sizes)
        # Copies, as arrays with a view of them cannot grow.
        return np.array(np.frombuffer(self.ids, np.int32)[at]), sizes


class Codec:
    """Encodes and decodes lists of texts by one rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        size = max(self.ranks.values(), default=-1) + 1
        self.cache = PieceCache(Merger(self.ranks), [b"%d" % i for i in range(size)])
        words = [b""] * size
        for token, rank in self.ranks.items():
            words[rank] = token
        self.blob = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(x) for x in words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """All ids, how many each text has, and each text's ids as decimals joined by a space."""
        pieces, which, counts = pieces_of(texts)
        places = self.cache.places(pieces)[which]
        ids, sizes = self.cache.expand(places)
        edges = np.concatenate(([0], np.cumsum(counts)))
        tokens = np.diff(np.concatenate(([0], np.cumsum(sizes)))[edges])
        decimal, places = self.cache.decimal, places.tolist()
        return ids, tokens, [b" ".join([decimal[p] for p in places[a:b]])
                             for a, b in zip(edges.tolist(), edges[1:].tolist())]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and the byte offset at which each id ends."""
        sizes = self.lengths[ids]
        return (self.blob[np.repeat(self.starts[ids], sizes) + runs_within(sizes)].tobytes(),
                np.cumsum(sizes))


@cache
def codec(path: str) -> Codec:
    """One codec, and so one cache, for each worker process and rank file."""
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<int>): token ids and the byte offset where each ends."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for part in chunks(batches, "text"):
            ids, counts, _ = own.encode(texts_of(part, "text"))
            at = np.concatenate(([0], np.cumsum(counts)))
            sizes = own.lengths[ids]
            total = np.concatenate(([0], np.cumsum(sizes)))
            ends = total[1:] - np.repeat(total[at[:-1]], counts)
            edges = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(edges, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(ends, pa.int32()))],
                ["id", "ids", "ends"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>, ends array<int>")
            .withColumnRenamed("id", id_col))


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, text binary): the bytes that the ids stand for."""
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            out = [own.decode(np.array(x or [], np.int64))[0]
                   for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             ["id", "text"])

    return (tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(run, f"id {kind}, text binary").withColumnRenamed("id", id_col))


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the decimal ids and of the decoded bytes.

    Encodes and decodes in one pass, so that ids need not travel between the two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for part in chunks(batches, "text"):
            ids, counts, decimal = own.encode(texts_of(part, "text"))
            data, ends = own.decode(ids)
            at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(counts, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decimal]),
                pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at, at[1:])]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
