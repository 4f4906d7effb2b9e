"""Token ids as raw binary shards with a minimal perfect hash index for keyed access.

A shard is one file: the raw ids of its documents back to back in ascending document order
(the payload), then the document keys in the same order with an index, then a footer. The index
places each distinct key without storing it: keys go through levels of bit arrays; a key
that is alone at its position on a level is settled there, the others go on to the next
level. The number of settled positions before a key's own is its slot, so n keys use exactly
the slots 0..n-1. A slot holds a 32-bit fingerprint of its key (another key is refused but
for one in 2**32), and the place and count of the key's records. A look-up touches one bit
per level, a constant number on average.

Rows are dealt to shards by ranges of the key and sorted within; one task writes one shard
to a file of its own name and reports it in the manifest, so that what a lost or repeated
attempt leaves behind is never read. Null texts are empty; a null key sorts first and is kept
as a record outside the index. Repeated keys are consecutive records of one slot.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.llm.bpe import PieceCache, pieces_of
from tracecairn.llm.common import chunks, runs_within, texts_of
from tracecairn.operators.storage import materialize, scratch_path

MAGIC = b"IDSHARD1"
#: Positions per key on each level, and levels before the last few keys are listed in full.
ROOM, LEVELS = 2, 40
#: Code points below this have had their classes since long before any pattern library here.
SETTLED_POINTS = 0x530
#: Fixed value: how byte-level vocabularies write a space.
SPACE_MARK = "\u0120"
#: New pieces that the library gets in one text.
JOINED = 1_000
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct int64 keys."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, before = [], 0
        for bits in levels:
            self.ranks.append(before + np.cumsum(bits, dtype=np.int64) - bits)
            before += int(bits.sum())
        self.settled = before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left) and len(levels) < LEVELS:
            size = max(1, ROOM * len(left))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; a key that was not indexed gets any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.ranks[k][at[hit]]
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[at] == keys[open_]
            out[open_[same]] = self.settled + at[same]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, LEVELS + 1) >> np.uint64(32)).astype(np.uint32)


def write_index(out, keys: np.ndarray, null_keys: int, counts: np.ndarray) -> None:
    """Append keys, counts and index to a shard whose payload has been written."""
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else keys
    distinct = keys[heads]
    index = PerfectHash.build(distinct)
    slots = index.slots(distinct)
    marks, first, many = (np.zeros(len(distinct), t) for t in (np.uint32, np.int64, np.int64))
    marks[slots] = fingerprints(distinct)
    first[slots] = null_keys + heads
    many[slots] = np.diff(np.concatenate((heads, [len(keys)])))
    np.savez(held := io.BytesIO(), keys=keys, nulls=np.int64([null_keys]), counts=counts,
             marks=marks, first=first, many=many, rest=index.rest,
             sizes=np.array([len(x) for x in index.levels], np.int64),
             bits=np.packbits(np.concatenate([*index.levels, np.zeros(0, bool)])))
    out.write(held.getvalue())


class Shard:
    """Reader of one shard file."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(at)
        end = self.file.size() - 24
        foot = self.file.read_at(24, max(0, end))
        if foot[16:] != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.width, index_at = (int(x) for x in np.frombuffer(foot[:16], np.int64))
        with np.load(io.BytesIO(self.file.read_at(end - index_at, index_at))) as x:
            self.keys, self.counts, self.nulls = x["keys"], x["counts"], int(x["nulls"][0])
            self.marks, self.first, self.many = x["marks"], x["first"], x["many"]
            sizes = x["sizes"]
            bits = np.unpackbits(x["bits"])[:int(sizes.sum())].astype(bool)
            self.hash = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [],
                                    x["rest"])
        self.starts = np.cumsum(self.counts) - self.counts

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; 0 records for a foreign key."""
        slots = self.hash.slots(keys)
        known = slots >= 0
        known[known] = self.marks[slots[known]] == fingerprints(keys[known])
        at = np.where(known, slots, 0)
        if not len(self.first):
            return at, np.zeros(len(at), np.int64)
        return self.first[at], np.where(known, self.many[at], 0)

    def ids(self, record: int) -> np.ndarray:
        raw = self.file.read_at(int(self.counts[record]) * self.width,
                                int(self.starts[record]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every record of one key."""
        first, many = self.records(np.array([key], np.int64))
        return [self.ids(int(first[0]) + i) for i in range(int(many[0]))]


@cache
def _encoder(path: str, plain_special: bool) -> tuple[PieceCache, object, list[str]]:
    """Piece cache, tokenizer, and what added tokens it finds inside texts.

    The cache's tokenizer reads special tokens as text: pieces hold none. The other one keeps
    the library's settings unless ``plain_special`` says that special tokens are text there too.
    """
    from tokenizers import Tokenizer

    tokenizer, whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    if plain_special:
        whole.encode_special_tokens = True
    added = [x for x in whole.get_added_tokens_decoder().values()
             if not (plain_special and x.special)]
    # A token found in normalised text may look otherwise in the text: then every text is whole.
    contents = ["" if x.normalized and whole.normalizer is not None else x.content for x in added]
    names = map(tokenizer.id_to_token, range(tokenizer.get_vocab_size()))
    opens = np.array([(x or "").startswith(SPACE_MARK) for x in names])

    def ask(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int64), sizes

    def encode(new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A piece of a space and more holds no other space. Such pieces are joined for the library,
        which cuts them at the spaces again; an id that opens with one begins the next piece."""
        texts = [x.decode() for x in new]
        spaced = np.array([x[:1] == " " and x[1:2] != "" and not x[1].isspace() for x in texts],
                          bool)
        at = np.flatnonzero(spaced)
        some = [texts[i] for i in at.tolist()]
        ids, _ = ask(["".join(some[i:i + JOINED]) for i in range(0, len(some), JOINED)])
        heads = np.flatnonzero(opens[ids])
        if len(heads) != len(at) or (len(heads) and heads[0]):
            return ask(texts)   # another kind of vocabulary
        others = np.flatnonzero(~spaced)
        other_ids, other_sizes = ask([texts[i] for i in others.tolist()])
        sizes = np.empty(len(new), np.int64)
        sizes[at], sizes[others] = np.diff(np.append(heads, len(ids))), other_sizes
        out, begins = np.empty(len(ids) + len(other_ids), np.int64), np.cumsum(sizes) - sizes
        for own, values in ((at, ids), (others, other_ids)):
            out[np.repeat(begins[own], sizes[own]) + runs_within(sizes[own])] = values
        return out, sizes

    return PieceCache(encode), whole, contents


def encode_texts(path: str, texts: list[str],
                 plain_special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and how many each has, as the tokenizers library gives them.

    ``plain_special`` encodes the contents of special tokens as text; without it they become
    their ids, which is the library's own setting.

    The library is asked once for each new piece; a byte-level vocabulary never merges across
    pieces. Texts with code points whose class depends on the library's Unicode version, and
    texts that hold an added token, go to it whole.
    """
    known, tokenizer, added = _encoder(path, plain_special)
    plain = [i for i, x in enumerate(texts) if (x.isascii() or max(x) < chr(SETTLED_POINTS))
             and not any(token in x for token in added)]
    pieces, which, counts = pieces_of([texts[i] for i in plain])
    ids, sizes = known.expand(known.places(pieces)[which])
    edges = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.diff(np.concatenate(([0], np.cumsum(sizes)))[edges])
    if len(plain) == len(texts):
        return ids, tokens
    other = sorted(set(range(len(texts))) - set(plain))
    parts = dict(zip(plain, np.split(ids, np.cumsum(tokens)[:-1]) if len(plain) else []))
    for i, x in zip(other, tokenizer.encode_batch([texts[i] for i in other],
                                                  add_special_tokens=False)):
        parts[i] = np.array(x.ids, np.int32)
    each = [parts[i] for i in range(len(texts))]
    return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None,
                 shards: int | None = None, width: int = 2, key: str = "doc_id",
                 text: str = "text", plain_special: bool = True) -> DataFrame:
    """Encode ``docs`` into shard files under ``folder``; the manifest, one row a shard.

    ``width`` is the bytes of an id (2 or 4); an id that does not fit is an error. ``shards``
    defaults to the session's shuffle partitions and should grow with the input.
    ``plain_special`` is that of encode_texts.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A folder without a scheme is on the cluster's own file system, where Spark also reads it.
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(
        target).toString().replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path = None, f"{folder}/{uuid.uuid4().hex}.ids"
        keys, counts, nulls, total, shard = [], [], 0, 0, None
        for part in chunks(batches, "text"):
            if sink is None:
                store, at = fs.FileSystem.from_uri(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(at)
                shard = part.column(2)[0].as_py()
            ids, sizes = encode_texts(tokenizer_path, texts_of(part, "text"), plain_special)
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
            sink.write(ids.astype(f"<u{width}").tobytes())
            nulls += part.column(0).null_count
            keys.append(part.column(0).drop_null().to_numpy().astype(np.int64))
            counts.append(sizes)
            total += len(ids)
        if sink is None:
            return
        write_index(sink, np.concatenate(keys), nulls, np.concatenate(counts))
        sink.write(np.int64([width, total * width]).tobytes() + MAGIC)
        sink.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([path]),
             pa.array([sum(map(len, counts))], pa.int64()), pa.array([total], pa.int64())],
            ["shard", "path", "n_docs", "n_ids"])

    rows = (docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
            .repartitionByRange(n, F.col("key").asc_nulls_first())
            .sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
            .withColumn("shard", F.spark_partition_id()))
    # Written at once: the manifest names the files of the attempts that count.
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all shards before; one row a shard, not a document."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_digests(manifest: DataFrame) -> DataFrame:
    """Read all shards back: doc_id, start, n_tokens, ids_crc32, found by keyed access.

    Each record's ids are fetched through the index by its key; records of a repeated key
    follow one another. Null keys lie outside the index and are read in place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                heads, many = shard.records(shard.keys)
                repeat = np.arange(len(shard.keys)) + shard.nulls - heads
                if len(heads) and ((repeat < 0) | (repeat >= many)).any():
                    raise ValueError(f"the index of {path} does not hold its keys")
                record = np.concatenate((np.arange(shard.nulls), heads + repeat))
                keys = pa.array([*[None] * shard.nulls, *shard.keys.tolist()], pa.int64())
                for a in range(0, len(record), 20_000):
                    own = record[a:a + 20_000]
                    sums = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in own.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [keys[a:a + 20_000], pa.array(first_id + shard.starts[own], pa.int64()),
                         pa.array(shard.counts[own], pa.int64()), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = with_starts(manifest).select("path", "first_id")
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write shards below the shared folder and return the digests read back from them.

    Special tokens are read as the library does by itself.
    """
    folder = scratch_path(docs.sparkSession, "shards")
    return read_digests(write_shards(docs, tokenizer_path, folder, end_id,
                                     plain_special=False))
