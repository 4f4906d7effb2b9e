"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. With integer weight a of a total A, block j of a source (from
0) may start at slot floor(j * A / a) and must be out by slot ceil((j + 1) * A / a). At every
slot, of the blocks that may start the one with the earliest deadline goes; then at every slot
each source is less than one block away from its share. The schedule repeats every A
slots, so it is worked out for one period from the weights alone, and a block's slot is arithmetic.

When a source has no blocks left, a new phase begins in which the others share by their weights:
no row is dropped or repeated. Sources without a weight, null included, share that of ``OTHER``.

Rank within a source is counted in two steps, so that a source with most of the rows is spread: rows
fall into buckets by the leading bits of a hash of their id, are numbered inside, and buckets have
offsets. A bucket crowded by one id (null included) is cut again by a hash of the whole row; only rows that are
equal in all columns stay together. The tables sent to all tasks hold one row for each unit of weight and phase.

Rows with the same id (null included) are ordered by a hash of all their columns; equal rows are
interchangeable. Empty tables give empty results. Result columns replace columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.operators.storage import materialize

OTHER = "*"
HASH_BITS = 60
ROWS_PER_BUCKET = 50_000
MAX_PERIOD = 10_000
RESULTS = ("mix_source", "mix_block", "mix_slot", "mix_position")


def period(weights: list[int]) -> list[int]:
    """Which source each slot of one period goes to: earliest deadline first."""
    total = sum(weights)
    done, out = [0] * len(weights), []
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // a), s) for s, a in enumerate(weights)
                 if a and done[s] < a and done[s] * total // a <= slot]
        _, chosen = min(ready)
        done[chosen] += 1
        out.append(chosen)
    return out


def phases(weights: dict[str, int], blocks: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (source, phase, first block, end, first slot, a, A) and (source, phase, k, slot)."""
    left = {s: blocks.get(s, 0) for s in weights}
    used = dict.fromkeys(weights, 0)
    spans, places, start, phase = [], [], 0, 0
    while any(left.values()):
        active = [s for s in weights if left[s]]
        own = [weights[s] for s in active]
        total = sum(own)
        at: dict[str, list[int]] = {s: [] for s in active}
        for slot, i in enumerate(period(own)):
            at[active[i]].append(slot)
        length = min((left[s] - 1) // weights[s] * total + at[s][(left[s] - 1) % weights[s]] + 1
                     for s in active)
        for s in active:
            whole, rest = divmod(length, total)
            n = whole * weights[s] + sum(slot < rest for slot in at[s])
            spans.append((s, phase, used[s], used[s] + n, start, weights[s], total))
            places += [(s, phase, k, slot) for k, slot in enumerate(at[s])]
            used[s], left[s] = used[s] + n, left[s] - n
        start, phase = start + length, phase + 1
    return spans, places


def hash60(value: Column, seed: int) -> Column:
    """60 leading bits of an MD5, as a long that orders as they do."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def split_crowded(rows: DataFrame, bucket: Column, tie: Column, rows_per_bucket: int) -> DataFrame:
    """``rows`` with _bucket, _own and _part, in the order of _h and ``tie``.

    A bucket with over twice ``rows_per_bucket`` rows holds an id with many rows: there each hash is a part
    of its own, cut by the leading bits of ``tie``. Elsewhere _own and _part are 0.
    """
    sizes = materialize(rows.groupBy("mix_source", bucket.alias("_bucket")).agg(
        F.count("*").alias("n")), "buckets")
    crowded = sizes.where(F.col("n") > 2 * rows_per_bucket).select(
        "mix_source", "_bucket", F.ceil(F.log2(F.col("n") / rows_per_bucket)).cast("int").alias("_bits"))
    rows = rows.withColumn("_bucket", bucket)
    if not crowded.limit(1).count():
        return rows.withColumn("_own", F.lit(0).cast("long")).withColumn("_part", F.lit(0).cast("long"))
    part = F.expr("shiftright(_tie, 64 - _bits) + shiftleft(1L, _bits - 1)")
    return (rows.join(crowded, ["mix_source", "_bucket"], "left").withColumn("_tie", tie)
            .withColumn("_own", F.when(F.col("_bits").isNotNull(), F.col("_h")).otherwise(0))
            .withColumn("_part", F.coalesce(part, F.lit(0).cast("long"))).drop("_bits", "_tie"))


def ranked(rows: DataFrame, bucket: Column, tie: Column, id_col: str,
           rows_per_bucket: int) -> DataFrame:
    """``rows`` with _rank within mix_source, by _h and, for one id, by ``tie``."""
    cell = ["_bucket", "_own", "_part"]
    rows = split_crowded(rows, bucket, tie, rows_per_bucket)
    before = Window.partitionBy("mix_source").orderBy(*cell).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("mix_source", *cell).agg(F.count("*").alias("n"))
               .withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("mix_source", *cell).orderBy("_h", id_col, tie)
    return (rows.withColumn("_in", F.row_number().over(inside) - 1)
            .join(offsets, ["mix_source", *cell])
            .withColumn("_rank", F.col("_before") + F.col("_in")))


def interleave(docs: DataFrame, weights: dict[str, int], block_docs: int = 16, seed: int = 7,
               source_col: str = "source", id_col: str = "doc_id",
               rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``docs`` with mix_source, mix_block, mix_slot and mix_position (dense, from 0)."""
    if sum(weights.values()) > MAX_PERIOD or min(weights.values(), default=0) < 1:
        raise ValueError(f"weights are whole numbers from 1 that sum to at most {MAX_PERIOD}")
    weights = weights if OTHER in weights else {**weights, OTHER: 1}
    spark = docs.sparkSession
    rows = docs.drop(*RESULTS)
    source = F.col(source_col).cast("string")
    named = [s for s in weights if s != OTHER]
    rows = rows.withColumn("mix_source", F.when(source.isin(named), source).otherwise(OTHER)
                           ).withColumn("_h", hash60(F.col(id_col), seed))
    sizes = {r["mix_source"]: r["n"] for r in
             rows.groupBy("mix_source").agg(F.count("*").alias("n")).collect()}
    bits = min(30, max(0, math.ceil(math.log2(max(1, sum(sizes.values()) / rows_per_bucket)))))
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS
               and docs.schema[c].dataType.typeName() not in ("map", "variant")]
    rows = ranked(rows, F.shiftright("_h", HASH_BITS - bits), F.xxhash64(*columns), id_col,
                  rows_per_bucket).withColumn("mix_block", F.expr(f"_rank div {block_docs}"))

    spans, places = phases(weights, {s: -(-n // block_docs) for s, n in sizes.items()})
    slots = spark.createDataFrame(
        [(s, first, end, k, start + slot, a, total) for s, p, first, end, start, a, total in spans
         for q, ph, k, slot in places if (q, ph) == (s, p)],
        "mix_source string, _first long, _end long, _k long, _slot long, _a long, _all long")
    rows = rows.join(F.broadcast(slots), "mix_source").where(
        (F.col("mix_block") >= F.col("_first")) & (F.col("mix_block") < F.col("_end"))
        & ((F.col("mix_block") - F.col("_first")) % F.col("_a") == F.col("_k"))
    ).withColumn("mix_slot", F.expr("_slot + (mix_block - _first) div _a * _all"))

    # The last block of a source may be short; whatever comes later moves up.
    position = F.col("mix_slot") * block_docs + F.col("_rank") % block_docs
    for s, n in sizes.items():
        if n % block_docs:
            last = n // block_docs
            p, first, start, a, total = next((p, f, st, a, t) for q, p, f, e, st, a, t in spans
                                             if q == s and f <= last < e)
            k = (last - first) % a
            slot = start + (last - first) // a * total + next(
                x for q, ph, i, x in places if (q, ph, i) == (s, p, k))
            position -= F.when(F.col("mix_slot") > slot, block_docs - n % block_docs).otherwise(0)
    return rows.withColumn("mix_position", position).select(
        *(f"`{c}`" for c in docs.columns if c not in RESULTS), *RESULTS)


def mixed_order(docs: DataFrame, weights: dict[str, int], block_docs: int = 16, seed: int = 7,
                **columns: str) -> DataFrame:
    """The rows of ``docs`` in the mixed order: files written from it follow one another."""
    rows = interleave(docs, weights, block_docs, seed, **columns)
    return rows.orderBy("mix_position").select(docs.columns)


def sql(weights: dict[str, int], block_docs: int, seed: int) -> str:
    """The interleaving as DuckDB SQL over ``documents``: the scheduler, slot by slot."""
    weights = weights if OTHER in weights else {**weights, OTHER: 1}
    values = ", ".join(f"('{s}', {a}, {i})" for i, (s, a) in enumerate(weights.items(), 1))
    k, named = len(weights), ", ".join(f"'{s}'" for s in weights if s != OTHER)
    active = f"[x for x in range(1, {k + 1}) if lft[x] > 0]"
    return f"""
WITH RECURSIVE w(g, a, i) AS (VALUES {values}),
d AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY h, doc_id) - 1 AS r FROM (
    SELECT doc_id, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS g,
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
    FROM documents)),
n AS (SELECT w.i, w.a, w.g, ceil(count(d.r) / {block_docs})::BIGINT AS b FROM w LEFT JOIN d USING (g) GROUP BY ALL),
sim(t, u, done, lft, aw, pick) AS (
    SELECT -1::BIGINT, 0::BIGINT, [0 * x for x in list(b ORDER BY i)], list(b ORDER BY i),
        list(a::BIGINT ORDER BY i), 0::BIGINT FROM n
    UNION ALL
    SELECT t + 1, CASE WHEN lft[p] = 1 THEN 0 ELSE u + 1 END,
        [CASE WHEN lft[p] = 1 THEN 0 WHEN x = p THEN done[x] + 1 ELSE done[x] END for x in range(1, {k + 1})],
        [CASE WHEN x = p THEN lft[x] - 1 ELSE lft[x] END for x in range(1, {k + 1})], aw, p
    FROM (SELECT *, list_min([((done[x] + 1) * tot + aw[x] - 1) // aw[x] * 100000 + x for x in act
            if done[x] * tot // aw[x] <= u]) % 100000 AS p
        FROM (SELECT *, list_sum([aw[x] for x in act])::BIGINT AS tot
            FROM (SELECT *, {active} AS act FROM sim WHERE list_sum(lft) > 0)))),
slots AS (SELECT t, w.g, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS blk
    FROM sim JOIN w ON w.i = pick WHERE t >= 0)
SELECT doc_id, d.g AS mix_source, r // {block_docs} AS mix_block, t AS mix_slot,
    row_number() OVER (ORDER BY t, r) - 1 AS mix_position
FROM d JOIN slots ON slots.g = d.g AND slots.blk = r // {block_docs}"""
