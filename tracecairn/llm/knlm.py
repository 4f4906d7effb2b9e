"""Perplexity under an interpolated modified Kneser-Ney model of characters or words.

The model is trained on trusted texts of each language: its longest n-grams are counted in the tasks,
summed by a shuffle, and turned into interpolated probabilities and back-off weights by joins over
the counts, order by order. The tables stay sharded by n-gram; nothing of them is collected.

Documents are packed into blocks of some ten thousand. A block asks for each distinct n-gram in it once, so one
equality join brings a block all it needs, however often an n-gram occurs and in however many
documents; the answers go back to the block, where every symbol takes the longest known
n-gram that ends in it.

A document is kept when its perplexity is at most a quantile of its language's trusted texts that were held
out of training. N-grams carry the language in their key, so languages share tables, not counts.
Keys are 64-bit hashes of language and symbols. A symbol is a character (``CHARACTERS``) or a word between
blanks (``WORDS``); words take several times the disk, see the README.

Null and empty texts, and with words blank ones, have no perplexity (null) and are kept, as are documents of languages
without trusted text. A null language is a language of its own. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecairn.llm.common import BLANKS, chunks, code_points, runs_within, texts_of
from tracecairn.operators.storage import materialize

BLOCK_BYTES = 32 << 20
#: A block is read in pieces of this many bytes, whose keys alone take some hundred times as much memory.
PIECE_BYTES = 512 << 10
#: Pieces whose distinct keys are merged at a time.
MERGED_PIECES = 8
#: Ids of trusted documents that may be sent to every task, 16 MB or so; more are joined by shuffle.
SENT_IDS = 1_000_000
QUANTILE = 0.995
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.array([ord(c) for c in BLANKS], np.uint32)


def _hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(1)) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Grams:
    """What n-grams are made of, and the symbols of the longest."""

    order: int
    words: bool = False

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A positive number for each symbol of all texts in one array, and where each text begins."""
        points, begins = code_points(texts)
        if not self.words:
            return points.astype(np.uint64) + np.uint64(1), begins
        inner = ~np.isin(points, _BLANKS)
        heads = inner.copy()
        heads[1:] &= ~inner[:-1]
        edges = begins[begins < len(points)]
        heads[edges] = inner[edges]
        own, first = np.flatnonzero(inner), np.flatnonzero(heads[inner])
        if not len(own):
            return np.zeros(0, np.uint64), np.zeros_like(begins)
        lengths = np.diff(np.append(first, len(own)))
        power = np.cumprod(np.full(lengths.max(), _MIX))
        value = _hash(np.zeros(len(own), np.uint64), points[own].astype(np.uint64))
        value = np.add.reduceat(value * power[runs_within(lengths)], first)
        return np.maximum(value, np.uint64(1)), np.searchsorted(own[first], begins)


CHARACTERS, WORDS = Grams(4), Grams(3, words=True)


def seeds(languages: list[str | None]) -> np.ndarray:
    """A 64-bit seed for each name; null differs from every name."""
    out = np.zeros(len(languages), np.uint64)
    for i, name in enumerate(languages):
        h = 1469598103934665603 if name is None else 1099511628211
        for b in (name or "").encode():
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        out[i] = h
    return out


def gram_keys(texts: list[str], languages: list[str | None], grams: Grams = CHARACTERS,
              ) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys by order at each position, the positions of symbols, the symbols, and text sizes.

    Each text is preceded by order - 1 border symbols; the end is not modelled. Order 0 is the
    language alone. The key at a position is that of the n-gram ending there, so the context of a symbol
    is the key of the position before it.
    """
    pad = grams.order - 1
    symbols, begins = grams.symbols(texts)
    sizes = np.diff(begins)
    at = np.arange(len(symbols)) + np.repeat(np.arange(1, len(texts) + 1), sizes) * pad
    padded = np.zeros(len(symbols) + len(texts) * pad, np.uint64)
    padded[at] = symbols
    keys = [np.repeat(seeds(languages), sizes + pad)]
    for n in range(1, grams.order + 1):
        before = keys[-1]
        if n > 1:
            before = np.concatenate((before[:1], before[:-1]))
        keys.append(_hash(before, padded))
    return keys, at, padded, sizes


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one holder of each key, and for each key its place among them."""
    n = len(key)
    bits = max(4, min(20, n.bit_length()))
    seen = np.empty(1 << bits, np.int64)
    holder, rows, shift = np.zeros(n, np.int64), np.arange(n), 64 - bits
    while len(rows):
        slot = ((key[rows] << np.uint64(64 - bits - shift)) >> np.uint64(64 - bits)).astype(np.int64)
        seen[slot] = rows
        held = seen[slot]
        same = key[held] == key[rows]
        holder[rows[same]] = held[same]
        rows, shift = rows[~same], max(0, shift - 5)
        if not shift and len(rows):
            _, first, back = np.unique(key[rows], return_index=True, return_inverse=True)
            holder[rows] = rows[first][back]
            break
    own = np.zeros(n, bool)
    own[holder] = True
    return np.flatnonzero(own), (np.cumsum(own) - 1)[holder]


def count(trusted: DataFrame, text_col: str = "text", lang_col: str = "lang",
          grams: Grams = CHARACTERS) -> DataFrame:
    """Top-order n-grams: lang, keys g1..gN of the suffixes, contexts c1..c(N-1), and n."""
    order, kind = grams.order, "long" if grams.words else "int"
    points = [f"p{k}" for k in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts, names = texts_of(part, "text"), part.column(1)
            keys, at, padded, sizes = gram_keys(texts, names.to_pylist(), grams)
            if not len(at):
                continue
            first, place = distinct(keys[order][at])
            own = at[first]
            owner = np.searchsorted(np.cumsum(sizes), first, side="right")
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(owner)),
                 *(pa.array(padded[own - order + k].astype(np.int64 if grams.words else np.int32))
                   for k in range(1, order + 1)),
                 pa.array(np.bincount(place, minlength=len(first)), pa.int64())],
                ["name", *points, "n"])

    def name_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = seeds(batch.column(0).to_pylist())
            parts = [batch.column(k).to_numpy().astype(np.uint64) for k in range(1, order + 1)]

            def key(own: list[np.ndarray], start=start) -> np.ndarray:
                for x in own:
                    start = _hash(start, x)
                return start

            columns = [start, *(key(parts[order - k:]) for k in range(1, order + 1)),
                       *(key(parts[order - 1 - k:-1]) for k in range(1, order))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in columns), batch.column(order + 1)],
                [*fields, "n"])

    fields = ["lang", *(f"g{k}" for k in range(1, order + 1)), *(f"c{k}" for k in range(1, order))]
    rows = trusted.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(
        run, "name string, " + ", ".join(f"{p} {kind}" for p in points) + ", n long")
    return rows.groupBy("name", *points).agg(F.sum("n").alias("n")).mapInArrow(
        name_keys, ", ".join(f"{f} long" for f in fields) + ", n long")


def model(counts: DataFrame, order: int = CHARACTERS.order) -> DataFrame:
    """(key, logp, backoff): natural logs; backoff is 0 where a key is no context.

    Below the top order an n-gram counts the different symbols before it.
    """
    grams = counts
    by_order = {order: grams}
    for k in range(order - 1, 0, -1):
        rest = ["lang", *(f"g{j}" for j in range(1, k)), *(f"c{j}" for j in range(1, k))]
        grams = materialize(
            grams.groupBy(f"g{k}").agg(F.count("*").alias("n"),
                                       *(F.first(f).alias(f) for f in rest)), f"grams{k}")
        by_order[k] = grams
    lower, tables, backs = None, [], []
    for k in range(1, order + 1):
        own = by_order[k].withColumn("ctx", F.col(f"c{k - 1}") if k > 1 else F.col("lang"))
        t = own.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("long")).alias(f"t{i}")
                                      for i in range(1, 5)))
        y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1))
        # One row a language; a count of counts of zero leaves the discount at its bound.
        discounts = t.select("lang", *(
            F.least(F.greatest(F.when(F.col(f"t{i}") > 0, i - (i + 1) * y * F.col(f"t{i + 1}")
                                      / F.col(f"t{i}")).otherwise(0.5 * i), F.lit(0.05)),
                    F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)))
        own = own.join(F.broadcast(discounts), "lang").withColumn(
            "cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2"))
            .otherwise(F.col("d3")))
        contexts = own.groupBy("ctx").agg(F.sum("n").alias("all"), F.sum("cut").alias("freed"),
                                          F.count("*").alias("kinds"))
        own = own.join(contexts, "ctx")
        # Below single symbols lies the even share of those known and one unknown.
        base = (1 / (F.col("kinds") + 1)) if k == 1 else F.exp(F.col("lower"))
        if k > 1:
            own = own.join(lower.select(F.col("key").alias(f"g{k - 1}"),
                                        F.col("logp").alias("lower")), f"g{k - 1}")
        p = (F.col("n") - F.col("cut")) / F.col("all") + F.col("freed") / F.col("all") * base
        lower = materialize(own.select(F.col(f"g{k}").alias("key"), F.log(p).alias("logp")),
                            f"order{k}")
        tables.append(lower)
        share = F.col("freed") / F.col("all")
        if k == 1:
            share /= F.col("kinds") + 1
        backs.append(contexts.select(F.col("ctx").alias("key"), F.log(share).alias("backoff")))
    every, back = tables[0], backs[0]
    for a in tables[1:]:
        every = every.unionByName(a)
    for b in backs[1:]:
        back = back.unionByName(b)
    # A context of only border symbols is no n-gram of its own: its probability stays null.
    return materialize(every.join(back, "key", "full"), "model")


def log_likelihoods(texts: list[str], languages: list[str | None], key: np.ndarray,
                    logp: np.ndarray, backoff: np.ndarray,
                    grams: Grams = CHARACTERS) -> tuple[np.ndarray, np.ndarray]:
    """Summed log-probability and symbols of each text; ``key`` sorted, unknown logp nan."""
    keys, at, _, sizes = gram_keys(texts, languages, grams)
    if not len(at) or not len(key):
        return np.zeros(len(texts)), sizes
    first, place = distinct(keys[grams.order][at])
    own = at[first]

    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return found, key[found] == wanted

    # Each different n-gram once: the longest known suffix, after the contexts that led down to it.
    value, open_ = np.zeros(len(own)), np.arange(len(own))
    for k in range(grams.order, 0, -1):
        found, hit = find(keys[k][own[open_]])
        hit &= ~np.isnan(logp[found])
        value[open_[hit]] += logp[found[hit]]
        open_ = open_[~hit]
        # A context that was never seen weighs nothing; order 0 holds the share of unknown symbols.
        context = keys[k - 1][own[open_] - 1] if k > 1 else keys[0][own[open_]]
        found, hit = find(context)
        value[open_[hit]] += backoff[found[hit]]
    sums = np.zeros(len(texts))
    full = np.flatnonzero(sizes)
    begins = np.cumsum(sizes) - sizes
    sums[full] = np.add.reduceat(value[place], begins[full])
    return sums, sizes


#: Asked for by every block, so that a block without an answer is told from one without n-grams.
_MARK = 0


def _blocks(docs: DataFrame, carry: list[str], text_col: str, lang_col: str) -> DataFrame:
    return docs.select(*carry, F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))


def _block_name(part: pa.RecordBatch) -> int:
    mark = xxhash.xxh64()
    for piece in chunks(iter([part]), "_text"):   # so that a block is never whole in Python strings
        for c in ("_text", "_lang"):
            for x in piece.column(c).to_pylist():
                mark.update(b"\0" if x is None else x.encode() + b"\1")
    return int(np.uint64(mark.intdigest()).view(np.int64))


def _ask(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "_text", BLOCK_BYTES):
        found, wanted = np.zeros(1, np.uint64), []
        for i, piece in enumerate(chunks(iter([part]), "_text", PIECE_BYTES), 1):
            keys, at, _, _ = gram_keys(texts_of(piece, "_text"), piece.column("_lang").to_pylist(),
                                       grams)
            own = at[distinct(keys[grams.order][at])[0]]
            wanted += [np.unique(x) for k in range(grams.order + 1) for x in (keys[k][own], keys[k][own - 1])]
            if i % MERGED_PIECES == 0:
                found, wanted = np.unique(np.concatenate([found, *wanted])), []
        found = np.unique(np.concatenate([found, *wanted])).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(found), _block_name(part))), pa.array(found)],
            ["block", "key"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block as a stream of compressed batches, so that it is unpacked batch by batch."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
    for part in chunks(batches, "_text", BLOCK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=options) as out:
            for piece in chunks(iter([part]), "_text"):
                out.write_batch(piece)
        yield pa.RecordBatch.from_arrays(
            [pa.array([_block_name(part)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            ["block", "blob"])


def perplexity(docs: DataFrame, table: DataFrame, carry: list[str], text_col: str = "text",
               lang_col: str = "lang", grams: Grams = CHARACTERS) -> DataFrame:
    """``carry`` columns with n_symbols and perplexity.

    ``docs`` is read twice, once to ask and once to score, and must give the same partitions both
    times, as a table does; a block that finds no answers of its own is an error.
    """
    fields = [docs.schema[c] for c in carry]
    rows = _blocks(docs, carry, text_col, lang_col)
    asked = rows.mapInArrow(partial(_ask, grams=grams), "block long, key long").join(table, "key", "left").where(
        F.col("logp").isNotNull() | F.col("backoff").isNotNull() | (F.col("key") == _MARK))
    answers = asked.groupBy("block").agg(F.collect_list(F.struct("key", "logp", "backoff")).alias("m"))
    joined = rows.mapInArrow(_pack, "block long, blob binary").join(
        answers, "block", "left").select(
        "blob", F.col("m.key").alias("key"), F.col("m.logp").alias("logp"),
        F.col("m.backoff").alias("backoff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                key, logp, backoff = (one.column(j).flatten().to_numpy(zero_copy_only=False)
                                      for j in (1, 2, 3))
                if not len(key):
                    raise RuntimeError("the documents were dealt differently when read again")
                key = key.astype(np.int64).view(np.uint64)
                order = np.argsort(key)
                key, logp = key[order], logp.astype(float)[order]
                backoff = np.nan_to_num(backoff.astype(float)[order])
                with pa.ipc.open_stream(one.column(0)[0].as_buffer()) as part:
                    for piece in chunks(part, "_text", PIECE_BYTES):
                        sums, sizes = log_likelihoods(
                            texts_of(piece, "_text"), piece.column("_lang").to_pylist(),
                            key, logp, backoff, grams)
                        value = np.exp(np.minimum(-sums / np.maximum(sizes, 1), 700))
                        yield pa.RecordBatch.from_arrays(
                            [*(piece.column(c) for c in carry), pa.array(sizes, pa.int64()),
                             pa.array(value, pa.float64(), mask=(sizes == 0) | (sums == 0))],
                            [*carry, "n_symbols", "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return joined.mapInArrow(run, f"{schema}, n_symbols long, perplexity double")


def _only(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; few ids are sent to the tasks, more are shuffled."""
    if ids.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col(id_col) == F.col("_trusted"), "left_semi")


def classify(docs: DataFrame, trusted_ids: DataFrame, held_out, quantile: float = QUANTILE,
             id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             grams: Grams = CHARACTERS) -> DataFrame:
    """(id, lang, n_symbols, perplexity, threshold, kept) for every document.

    ``trusted_ids`` has the ids of trusted documents (distinct); ``held_out`` is a condition on the id
    that keeps part of them for the thresholds.
    """
    trusted = trusted_ids.select(F.col(id_col).alias("_trusted")).distinct()
    narrow = docs.select(id_col, text_col, lang_col)
    trusted = materialize(trusted, "trusted")
    train = _only(narrow.where(~held_out), trusted, id_col)
    table = model(materialize(count(train, text_col, lang_col, grams), "counts"), grams.order)
    scored = materialize(perplexity(narrow, table, [id_col, lang_col], text_col, lang_col, grams),
                         "scored")
    limits = (_only(scored.where(held_out), trusted, id_col)
              .groupBy(F.col(lang_col).alias("_lang"))
              .agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")))
    # One row a language.
    return scored.join(F.broadcast(limits), F.col(lang_col).eqNullSafe(F.col("_lang")), "left").select(
        id_col, lang_col, "n_symbols", "perplexity", "threshold",
        F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
