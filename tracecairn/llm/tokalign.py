"""Alignment of two tokenizers over the bytes of the same texts, as an Arrow pipeline.

Per chunk of documents: the token lists are flattened with the index of their parent document, byte
lengths are taken from the vocabulary, and cumulative sums over all tokens less what stands before the
document give each token's end. A hash join of both sides on (document, end), outer on both sides,
yields one row for each end of either; in order, with gaps filled from behind, these rows are the
links: each is a stretch of bytes that lies in one token of A and one of B. Rows that both sides have
close a group.

Counts of id pairs: every block of documents counts its own with Table.group_by, Spark adds them up and
finds each B id's highest. A block keeps its links as places in its list of pairs, so that only a block's
distinct pairs are joined with the corpus counts, not its links; a block is one row of about
``block_bytes`` of text. What the counts say comes back to the block as one list and is added up there.

A document has no tokens, and zeros, if its text is null or empty or if the joined bytes of either side
differ from a blank and the text. Repeated rows and ids count as often as they are there, null ids are
kept, the text of a special token is plain text. A very long text is a block of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracecairn.llm.common import chunks, texts_of
from tracecairn.llm.tokenbin import encode_texts
from tracecairn.operators.storage import materialize

BLOCK_BYTES = 8 << 20
#: Bits of a key that hold the end; the rest holds the document's place in its chunk.
END_BITS = 40
COUNTERS = ("n_a", "n_b", "n_groups", "n_links")
_CODEC = pa.Codec("zstd", compression_level=1)
_BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_level_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte.

    Fixed rule: printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Vocabularies:
    """Both tokenizers: how they encode, and each id's bytes."""

    path_a: str
    model_b: object
    bytes_a: pa.Array
    bytes_b: pa.Array
    #: Decimals with what follows them in a group's text: A "," and "|", then B "," and ";".
    decimals: pa.Array

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        ids, sizes = encode_texts(self.path_a, [" " + x for x in texts])
        a = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32),
                                     pa.array(ids, pa.int64()))
        b = pa.array(self.model_b.encode(texts, num_threads=1), pa.list_(pa.int64()))
        return a, b


@cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    pa.set_cpu_count(1)   # a task has one core
    tokenizer, alphabet = Tokenizer.from_file(path_a), byte_level_alphabet()
    added = tokenizer.get_added_tokens_decoder()
    names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    own = [added[i].content.encode() if i in added else bytes(map(alphabet.__getitem__, x))
           for i, x in enumerate(names)]
    model = SentencePieceProcessor(model_file=path_b)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    other = [bytes.fromhex(_BYTE_PIECE.fullmatch(x)[1]) if model.is_byte(i)
             else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
    decimals = [f"{i}{c}" for n, marks in ((len(own), ",|"), (len(other), ",;"))
                for c in marks for i in range(n)]
    return Vocabularies(path_a, model, pa.array(own, pa.large_binary()),
                        pa.array(other, pa.large_binary()), pa.array(decimals, pa.large_binary()))


def _buffer(taken: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and joined bytes of a binary array that ``take`` has just made."""
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int64)[:len(taken) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _same_bytes(tokens: pa.ListArray, table: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which documents' tokens join to a blank and the text."""
    at, data = _buffer(table.take(tokens.flatten()))
    edges = at[np.asarray(tokens.offsets)]
    raw = memoryview(data)
    return np.array([raw[s:e] == b" " + x for s, e, x in zip(edges, edges[1:], texts)], bool)


def _ends(tokens: pa.ListArray, table: pa.Array) -> pa.Table:
    """(at, id): each token's document and end in its document, as one key."""
    flat, parent = tokens.flatten(), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.cast(pc.binary_length(table.take(flat)), pa.int64()))
    before = np.concatenate(([0], total.to_numpy()))[np.asarray(tokens.offsets)[:-1]]
    end = pc.subtract(total, pa.array(before).take(parent))
    at = pc.bit_wise_or(pc.shift_left(pc.cast(parent, pa.int64()), END_BITS), end)
    return pa.table({"at": at, "id": flat})


@dataclass
class Aligned:
    """One chunk: counters and digests by document, and the links' id pairs in order."""

    doc_ids: pa.Array
    counters: dict[str, np.ndarray]
    digests: list[str]
    pairs: pa.Array


def align(doc_ids: pa.Array, texts: list[str], vocab: Vocabularies) -> Aligned:
    raw = [x.encode() for x in texts]
    a, b = vocab.encode(texts)
    good = (_same_bytes(a, vocab.bytes_a, raw) & _same_bytes(b, vocab.bytes_b, raw)
            & np.array([bool(x) for x in raw], bool))
    keep = pa.array(np.flatnonzero(good))
    a, b = a.take(keep), b.take(keep)
    left, right = _ends(a, vocab.bytes_a), _ends(b, vocab.bytes_b)
    cells = left.rename_columns(["at", "a"]).join(
        right.rename_columns(["at", "b"]), "at", join_type="full outer").sort_by("at")
    cells = cells.combine_chunks()
    both = pc.and_(pc.is_valid(cells["a"]), pc.is_valid(cells["b"]))
    # The token that covers a stretch is the first of its side to end at or behind it.
    pairs = pc.add(pc.multiply(pc.fill_null_backward(cells["a"]), len(vocab.bytes_b)),
                   pc.fill_null_backward(cells["b"])).combine_chunks()
    at = cells["at"].to_numpy()
    common = at[both.to_numpy()]
    where = np.flatnonzero(good)

    def by_document(found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        out[where] = found
        return out

    counters = {
        "n_a": by_document(np.diff(np.asarray(a.offsets))),
        "n_b": by_document(np.diff(np.asarray(b.offsets))),
        "n_groups": by_document(np.bincount(common >> END_BITS, minlength=len(where))),
        "n_links": by_document(np.bincount(at >> END_BITS, minlength=len(where))),
    }
    digests = [""] * len(texts)
    for i, x in zip(where.tolist(), _group_digests(left, right, a, b, common, vocab)):
        digests[i] = x
    return Aligned(doc_ids, counters, digests, pairs)


def _group_digests(left: pa.Table, right: pa.Table, a: pa.ListArray, b: pa.ListArray,
                   common: np.ndarray, vocab: Vocabularies) -> list[str]:
    """Digest of each document's groups, written as A ids, "|", B ids, ";" and so on."""
    at_a, at_b = left["at"].to_numpy(), right["at"].to_numpy()
    group_a, group_b = np.searchsorted(common, at_a), np.searchsorted(common, at_b)
    # A token stands behind all earlier groups of the other side; a B token also behind its own.
    place_a = np.arange(len(at_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(at_b)) + np.searchsorted(group_a, group_b, "right")
    n_a, n_b = len(vocab.bytes_a), len(vocab.bytes_b)
    code = np.empty(len(at_a) + len(at_b), np.int64)
    if len(code):
        code[place_a] = left["id"].to_numpy() + n_a * (common[group_a] == at_a)
        code[place_b] = 2 * n_a + right["id"].to_numpy() + n_b * (common[group_b] == at_b)
    at, data = _buffer(vocab.decimals.take(pa.array(code)))
    edges = at[np.asarray(a.offsets).astype(np.int64) + np.asarray(b.offsets)]
    raw = memoryview(data)
    # The last group has no ";".
    return [sha256(raw[s:e - 1]).hexdigest() for s, e in zip(edges, edges[1:])]


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + _CODEC.compress(
        values.astype(np.int32).tobytes(), asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(_CODEC.decompress(packed[8:], 4 * size, asbytes=True), np.int32)


def align_blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                 text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a block: its documents' counters and digests, its distinct id pairs with their
    counts, and its links as places in the list of pairs."""
    kind = docs.schema[id_col].dataType
    schema = (f"block long, ids array<{kind.simpleString()}>, "
              + ", ".join(f"{x} array<long>" for x in COUNTERS)
              + ", digests array<string>, pairs array<long>, counts array<long>, links binary")
    arrow_kind = to_arrow_type(kind)

    def row(block: int, parts: list[Aligned]) -> pa.RecordBatch:
        pairs = pa.chunked_array([x.pairs for x in parts], pa.int64())
        counted = pa.table({"pair": pairs}).group_by("pair").aggregate([([], "count_all")])
        places = pc.index_in(pairs, value_set=counted["pair"].combine_chunks())
        columns = [
            pa.array([block], pa.int64()),
            pa.array([[x for p in parts for x in p.doc_ids.to_pylist()]], pa.list_(arrow_kind)),
            *(pa.array([np.concatenate([p.counters[x] for p in parts])], pa.list_(pa.int64()))
              for x in COUNTERS),
            pa.array([[x for p in parts for x in p.digests]]),
            pa.array([counted["pair"].to_numpy()], pa.list_(pa.int64())),
            pa.array([counted["count_all"].to_numpy()], pa.list_(pa.int64())),
            pa.array([_pack(places.to_numpy())], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(
            columns, ["block", "ids", *COUNTERS, "digests", "pairs", "counts", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, parts, size = vocabularies(path_a, path_b), [], 0
        block = TaskContext.get().partitionId() << 32
        for part in chunks(batches, "text"):
            texts = texts_of(part, "text")
            parts.append(align(part.column("id"), texts, vocab))
            size += sum(map(len, texts))
            if size >= block_bytes:
                yield row(block, parts)
                block, parts, size = block + 1, [], 0
        if parts:
            yield row(block, parts)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, schema)


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many links hold each id pair, and whether no pair of its B id has more."""
    counted = materialize(
        blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")), "pair-counts")
    b = (F.col("pair") % n_b).alias("b")
    highest = counted.groupBy(b).agg(F.max("n").alias("highest"))
    # At most one row an id of B's vocabulary.
    return counted.select("pair", "n", b).join(F.broadcast(highest), "b").select(
        "pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def cross_align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    from sentencepiece import SentencePieceProcessor

    blocks = materialize(
        align_blocks(docs, path_a, path_b, id_col, text_col, block_bytes), "aligned")
    counted = pair_counts(blocks, SentencePieceProcessor(model_file=path_b).get_piece_size())
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counted, "pair").groupBy("block").agg(
        F.collect_list(F.struct("place", "n", "best")).alias("x")).select(
        F.col("block").alias("of"), F.col("x.place").alias("place"), F.col("x.n").alias("n"),
        F.col("x.best").cast("array<tinyint>").alias("best"))
    both = blocks.drop("pairs", "counts").join(answers, F.col("block") == F.col("of"), "left")
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    names = ["id", *COUNTERS, "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {x: batch.column(x)[i] for x in batch.schema.names}
                n_links = one["n_links"].values.to_numpy()
                place = np.array([] if not one["place"].is_valid else one["place"].values, np.int64)
                count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
                if len(place):
                    count[place], best[place] = one["n"].values, one["best"].values
                links = _unpack(one["links"].as_py())
                edges = np.concatenate(([0], np.cumsum(n_links)))
                sums = [np.diff(np.concatenate(([0], np.cumsum(x[links])))[edges])
                        for x in (best, count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one["ids"].values, arrow_kind),
                     *(pa.array(one[x].values, pa.int64()) for x in COUNTERS),
                     *(pa.array(x, pa.int64()) for x in sums), pa.array(one["digests"].values)],
                    names)

    schema = (f"id {kind.simpleString()}, "
              + ", ".join(f"{x} long" for x in (*COUNTERS, "n_best", "count_sum"))
              + ", groups_sha256 string")
    return both.mapInArrow(run, schema).withColumnRenamed("id", id_col)
