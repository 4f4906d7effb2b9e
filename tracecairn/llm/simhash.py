"""SimHash near-duplicates through deletion variants of fingerprint segments.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit in one of
their two halves. So each distinct fingerprint is indexed under both halves as they are, and
under every variant of a half with one bit left out; equality joins on these keys meet every
pair, and the whole fingerprints verify it. A variant joins only rows whose left-out bits
differ, so that equal halves meet once.

Where more than ``bucket`` fingerprints share a key, what is left of them is cut and indexed the same
way again, down to eight bits, where a key can hold no more than some thousand different
fingerprints: no bucket is emitted as all its pairs, and no link is lost. Equal
fingerprints are one node, however many rows hold them. Components come from alternating star
contractions over the links; every round is a written table.

A text is lower-cased in A-Z and cut at ASCII white space; null, empty and blank texts have fingerprint
zero and link like any other. Repeated rows each keep their row; a null id
takes part and is never a component's name unless no other id is there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecairn.llm.common import chunks, texts_of
from tracecairn.operators.storage import materialize, remove, scratch_path

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
BUCKET = 64
#: Index rows of one fingerprint, and how many a task should make.
KEYS, KEYS_PER_TASK = BITS + 2, 500_000
#: Names of columns that documents carry on the way.
FINGERPRINT, ROW = "_simhash_fp", "_simhash_row"
#: Halving stops at this width.
NARROWEST = 8


def text_fingerprints(texts: list[str], words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    hashes: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = text.encode().lower().split()
        if not parts:
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        n = max(1, len(parts) - words + 1)
        starts = np.concatenate(([0], ends[:n - 1])).tolist()
        stops = (ends[-n:] - 1).tolist()
        own = [joined[a:b] for a, b in zip(starts, stops)]
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(SEED)), np.uint64, n))
        sizes[i] = n
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1,
                         bitorder="little")
    heads = (np.cumsum(sizes) - sizes)[full]
    votes = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    chosen = 2 * votes > sizes[full, None]
    out[full] = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): one row a document; the long holds the unsigned bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            own = text_fingerprints(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(own.view(np.int64), pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keys(fp: Column, covered: Column, low: int, width: int, budget: int,
          out: Column, side: Column) -> Column:
    """Keys that further cover one half of the ``width`` bits from ``low``.

    ``covered`` are the bits that are equal so far, ``budget`` the bits that may differ. A key
    holds the bits that it covers, those bits, the bit left out (-1: none) and its value (2:
    none), and what is left: its lowest bit, its width, and how many bits of it may differ.
    """
    half = width // 2
    found = []
    for own, rest in ((low, low + half), (low + half, low)):
        whole = covered.bitwiseOR(F.lit(_signed(((1 << half) - 1) << own)))
        found.append(F.array(F.struct(
            whole.alias("mask"), fp.bitwiseAND(whole).alias("part"), out.alias("out"),
            side.alias("side"), F.lit(rest).alias("low"), F.lit(half).alias("width"),
            F.lit(budget).alias("budget"))))
        if budget == 2:
            places = F.sequence(F.lit(own), F.lit(own + half - 1))
            found.append(F.transform(places, _variant(fp, whole, rest, half)))
    return F.concat(*found)


def _variant(fp: Column, whole: Column, rest: int, half: int) -> Callable[[Column], Column]:
    def leave_out(place: Column) -> Column:
        left = whole.bitwiseAND(F.bitwise_not(_bit(place)))
        return F.struct(
            left.alias("mask"), fp.bitwiseAND(left).alias("part"), place.alias("out"),
            F.when(fp.bitwiseAND(_bit(place)) == 0, 0).otherwise(1).alias("side"),
            F.lit(rest).alias("low"), F.lit(half).alias("width"), F.lit(1).alias("budget"))

    return leave_out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def candidate_links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints at one or two differing bits; ``nodes`` has fp."""
    # Fingerprints are narrow, their keys are not: spread them before, as many as a task should hold.
    tasks = 1 + nodes.count() * KEYS // KEYS_PER_TASK
    rows = nodes.select("fp").repartition(tasks).select("fp", F.explode(_keys(
        F.col("fp"), F.lit(0).cast("long"), 0, BITS, 2, F.lit(-1), F.lit(2))).alias("k")
        ).select("fp", "k.*")
    key = ["mask", "part", "out"]
    width, links = BITS // 2, None
    while True:
        if width > NARROWEST:
            rows = materialize(rows, "keys")
            full = rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > bucket)
            full = materialize(full.drop("n"), "full")
            hot = rows.join(full, key, "left_semi")
            rows_now = rows.join(full, key, "left_anti")
        else:
            hot, rows_now = None, rows
        left = rows_now.where("side <> 1").select(
            *key, F.col("fp").alias("a"), F.col("side").alias("side_a"))
        right = rows_now.where("side <> 0").select(*key, F.col("fp").alias("b"))
        found = left.join(right, key).where(
            ((F.col("side_a") == 0) | (F.col("a") < F.col("b")))
            & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        links = found if links is None else links.unionByName(found)
        if hot is None or full.isEmpty():
            return links.distinct()
        half = width // 2
        again = None
        for low in range(0, BITS, width):
            for budget in (1, 2):
                own = hot.where((F.col("low") == low) & (F.col("budget") == budget)).select(
                    "fp", F.explode(_keys(F.col("fp"), F.col("mask"), low, width, budget,
                                          F.col("out"), F.col("side"))).alias("k")
                ).select("fp", "k.*")
                again = own if again is None else again.unionByName(own)
        rows, width = again, half


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node it reaches."""
    spark = links.sparkSession
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    old, state = None, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: what lies above a node hangs on the smallest of its neighbourhood.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"),
                                                           F.col("m").alias("v"))).distinct()
        # Small star: a node and what lies below it hang on the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct()
        path = scratch_path(spark, "edges")
        small.write.parquet(path)
        edges = spark.read.schema(small.schema).parquet(path)
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if old:
            remove(spark, old)
        if tuple(sums) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        old, state = path, tuple(sums)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id): one row a document."""
    marks = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(marks.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    roots = components(candidate_links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "nodes")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return marks.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, whatever its ids are.

    It is the row of smallest id (null last), then of smallest fingerprint, then of smallest hash of
    all columns; of equal rows one. Rows of one id with unrelated texts are different components.
    """
    columns = docs.columns
    marks = materialize(_with_fingerprints(docs, text_col).withColumn(
        ROW, F.monotonically_increasing_id()), "marked")
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(FINGERPRINT),
                     F.xxhash64(*columns), F.col(ROW))
    nodes = materialize(marks.groupBy(F.col(FINGERPRINT).alias("fp")).agg(
        F.min(order).alias("first")), "nodes")
    roots = components(candidate_links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "first", F.coalesce("root", "fp").alias("root"))
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col(f"first.{ROW}").alias(ROW))
    return marks.join(kept, ROW, "left_semi").select(*columns)


def _with_fingerprints(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the fingerprint of each row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, text_col):
            own = text_fingerprints(texts_of(part, text_col))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.view(np.int64))],
                                             [*part.schema.names, FINGERPRINT])

    return docs.mapInArrow(run, f"{fields}, {FINGERPRINT} long")
