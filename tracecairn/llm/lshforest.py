"""Approximate nearest neighbours by cosine, with a forest of hash prefixes.

Every tree gives a vector a string of BITS bits, the signs of random projections; vectors that are close
share long prefixes. A tree's strings are kept sorted. A query descends each tree to the longest prefix
that its string shares with an entry; then all trees ascend together, one bit at a time, until the
prefixes of that length hold enough entries in all trees together (an entry counts once for each tree).
What they hold is ranked by its exact cosine.

How many are enough is measured: a sample of queries is compared with every entry, and the number is the
least with which TARGET of their nearest k are met. It grows with the table where its neighbours
ask for it. ``candidates`` gives the number instead; recall is then not held.

The sorted strings lie in leaves: the shortest prefixes with at most ``leaf`` entries, but none longer
than the depth down to which FLOOR_TARGET of the sample's neighbours share a prefix. Ascents end at
the tops of their leaves at the latest. Large leaves are cut into blocks of entries and of queries.
First the ascents are counted on strings alone; vectors are then joined once, and each query ranks a slice of
the sorted strings of its block.

Equal vectors are one entry with its lowest ids, so groups of copies don't crowd a leaf.

Vectors that are null or zero, or that hold null or non-finite components, take no part, neither do rows with
a null id; vectors of different lengths never meet. Repeated rows (same id) count once. Ties go to the
smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.llm.exthash import directory
from tracecairn.operators.storage import materialize

TREES, BITS = 40, 48
LEAF = 4096
#: Queries that are compared with every entry, the share of their nearest that must be met, and the
#: share that must lie in their leaves.
SAMPLE, TARGET, FLOOR_TARGET = 256, 0.95, 0.98
#: Numbers in the vectors of one block, of entries and of queries alike: 16 MB as doubles.
BLOCK_NUMBERS = 2_000_000
#: More than any number of entries.
ALL = 1 << 62
SEED = 5


def planes(tree: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, tree, size]).standard_normal((size, bits))


def strings(vectors: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as longs whose order is the strings' order."""
    signs = vectors @ planes(tree, BITS, vectors.shape[1]) > 0
    return signs @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of BITS-bit strings."""
    _, length = np.frexp((a ^ b).astype(np.float64))
    return BITS - length


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _forest(groups: DataFrame) -> DataFrame:
    """(id, tree, h) for every entry and tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                rows = flat[(ends[at] - size)[:, None] + np.arange(size)]
                for tree in range(TREES):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at)), pa.array([tree] * len(at), pa.int32()),
                         pa.array([int(size)] * len(at), pa.int32()),
                         pa.array(strings(rows, tree), pa.int64())], ["id", "tree", "size", "h"])

    return groups.select("id", "vector").mapInArrow(run, "id long, tree int, size int, h long")


def depth_for(met: np.ndarray, target: float = FLOOR_TARGET) -> int:
    """Largest depth that ``target`` of the neighbours reach; ``met``: their longest common prefixes."""
    depths = np.arange(BITS + 1)
    share = (met[:, None] >= depths).mean(0)
    return int(depths[share >= target].max())


def held_depths(groups: DataFrame, k: int) -> tuple[dict[int, int], pd.DataFrame]:
    """Depth to which leaves of each vector size may go; size 0 holds for sizes outside the sample.

    Also the sample's nearest as (query, size, met), at most SAMPLE * k rows.
    """
    sample = (groups.where("asked").select("id", "vector")
              .orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect())
    own: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for size in {len(r["vector"]) for r in sample}:
        rows = [r for r in sample if len(r["vector"]) == size]
        q = np.array([r["vector"] for r in rows], float)
        own[size] = (np.array([r["id"] for r in rows], np.int64), q,
                     np.stack([strings(q, tree) for tree in range(TREES)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best k of a batch for each sampled query, with their longest common prefix."""
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.cumsum(sizes)
            for size, (names, q, hashes) in own.items():
                at = np.flatnonzero(sizes == size)
                if not len(at):
                    continue
                x = flat[(ends[at] - size)[:, None] + np.arange(size)]
                cosine = (q @ x.T) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1)))
                cosine[names[:, None] == ids[at]] = -np.inf
                n = min(k, len(at))
                best = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
                which, place = np.unique(best, return_inverse=True)
                place = place.reshape(best.shape)
                met = np.zeros(best.shape, np.int64)
                for tree in range(TREES):
                    h = strings(x[which], tree)[place]
                    met = np.maximum(met, common_prefix(h, hashes[tree][:, None]))
                score = np.take_along_axis(cosine, best, 1)
                real = np.isfinite(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(names[:, None], best.shape)[real]),
                     pa.array(score[real]), pa.array(met[real].astype(np.int32)),
                     pa.array(np.full(int(real.sum()), size, np.int32))],
                    ["query", "score", "met", "size"])

    if not own:
        return {0: BITS}, pd.DataFrame({"query": [], "size": [], "met": []}, dtype="int64")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("met"))
    found = (groups.select("id", "vector")
             .mapInArrow(run, "query long, score double, met int, size int")
             .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
             .select("query", "size", "met").toPandas())
    depths = {int(size): depth_for(part.to_numpy()) for size, part in found.groupby("size")["met"]}
    return {0: min(depths.values(), default=BITS)} | depths, found


def _of_role(members: pd.DataFrame, role: int) -> pd.DataFrame:
    return members[members["role"] == role]


def _levels(members: pd.DataFrame) -> pd.DataFrame:
    """Entries of one block that share at least 0, 1, ... BITS bits with each query's string."""
    asked, held = _of_role(members, 1), np.sort(_of_role(members, 0)["h"].to_numpy())
    own = asked["h"].to_numpy()
    out = {"query": asked["id"].to_numpy()}
    for depth in range(BITS + 1):
        first, last = spans(held, own, depth)
        out[f"c{depth}"] = last - first
    return pd.DataFrame(out)


def spans(held: np.ndarray, own: np.ndarray, depth: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings that share ``depth`` bits with ``own`` begin and end in sorted ``held``."""
    free = np.asarray(BITS - depth, np.int64)
    low = (own >> free) << free
    return np.searchsorted(held, low), np.searchsorted(held, low + (np.int64(1) << free))


def _meet(keep: int):
    def run(members: pd.DataFrame) -> pd.DataFrame:
        """Each query's best entries among those of one block that its ascent has reached."""
        asked, held = _of_role(members, 1), _of_role(members, 0).sort_values("h", kind="stable")
        out = []
        if len(asked) and len(held):
            x = np.stack(held["vector"].to_numpy()).astype(float)
            x /= np.sqrt((x * x).sum(1))[:, None]
            ids = held["id"].to_numpy()
            first, last = spans(held["h"].to_numpy(), asked["h"].to_numpy(),
                                asked["stop"].to_numpy())
            for own, q, a, b in zip(asked["id"], asked["vector"], first, last):
                if a == b:
                    continue
                cosine = x[a:b] @ np.asarray(q, float)
                n = min(keep, len(cosine))
                at = np.flatnonzero(cosine >= -np.partition(-cosine, n - 1)[n - 1])
                best = at[np.lexsort((ids[a:b][at], -cosine[at]))[:n]]
                out.append((own, ids[a:b][best].tolist()))
        return pd.DataFrame(out, columns=["query", "ids"])

    return run


def stops(levels: DataFrame, needed: Column) -> DataFrame:
    """(query, stop): the largest depth at which all trees together hold ``needed`` entries, else 0."""
    sums = levels.groupBy("query", "size").agg(
        *(F.sum(f"c{d}").alias(f"c{d}") for d in range(BITS + 1)))
    stop = F.coalesce(*(F.when(F.col(f"c{d}") >= needed, d) for d in range(BITS, -1, -1)), F.lit(0))
    return sums.select("query", stop.alias("stop"))


def needed_for(found: pd.DataFrame, levels: pd.DataFrame, depths: dict[int, int],
               target: float = TARGET) -> dict[int, int]:
    """Entries to meet, by vector size, so that ``target`` of the sample's neighbours are among them.

    A neighbour is met if the ascent does not end before the longest prefix it shares, so unless the
    next longer prefixes hold enough already. Where leaves end too early for the target, all of them.
    """
    sums = levels.groupby("query").sum()
    out = {}
    for size, part in found.groupby("size"):
        floor = depths.get(int(size), depths[0])
        rows = sums.reindex(part["query"])[[f"c{d}" for d in range(BITS + 1)]].to_numpy()
        rows = np.concatenate((rows, np.zeros((len(rows), 1))), axis=1)
        met = part["met"].to_numpy()
        need = np.where(met >= floor, rows[np.arange(len(met)), met + 1] + 1, np.inf)
        at = int(np.ceil(target * len(need))) - 1
        worst = np.sort(need)[at]
        out[int(size)] = int(worst) if np.isfinite(worst) else ALL
    return {0: max(out.values(), default=ALL)} | out


def by_size(values: dict[int, int]) -> Column:
    """The value for a row's ``size``; that of size 0 holds for sizes outside the sample."""
    out = F.lit(values[0])
    for size, value in values.items():
        if size:
            out = F.when(F.col("size") == size, F.lit(value)).otherwise(out)
    return out


def nearest(rows: DataFrame, is_query: Column, k: int = 5, leaf: int = LEAF,
            candidates: int | None = None, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, itself excluded."""
    clean = rows.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vid"), F.col(vector_col).alias("vector"),
        is_query.alias("asked"))
    # Entries: distinct vectors, named by their smallest id, with the k + 1 smallest.
    groups = materialize(clean.groupBy("vector").agg(
        F.min("vid").alias("id"), F.max("asked").alias("asked")), "vectors")
    first = Window.partitionBy("vector").orderBy("vid")
    few = clean.select("vid", "vector").withColumn("r", F.dense_rank().over(first)).where(
        F.col("r") <= k + 1).distinct().groupBy("vector").agg(F.collect_list("vid").alias("copies"))
    copies = materialize(groups.join(few, "vector").select("id", "copies"), "copies")

    forest = materialize(_forest(groups), "forest").withColumn("weight", F.lit(1).cast("long"))
    placed = directory(forest, leaf, ["tree", "size"], BITS)
    depths, sample = held_depths(groups, k) if candidates is None else ({0: BITS}, None)
    node = ["tree", "size", "depth", "leaf"]
    placed = placed.withColumn("depth", F.least("depth", by_size(depths))).withColumn(
        "leaf", F.expr(f"shiftright(h, {BITS} - least(depth, {BITS}))")).join(
        groups.select("id", "asked"), "id")
    # Leaves at the depth that recall needs, and strings that no prefix separates: entries and
    # queries are cut into as many blocks as their numbers ask for, each of these meets each of those.
    per_block = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col("size")))
    over = (placed.groupBy(*node).agg(
        F.ceil(F.count("*") / F.first(per_block)).cast("int").alias("blocks"),
        F.ceil(F.count_if("asked") / F.first(per_block)).cast("int").alias("parts"))
        .where("parts > 0"))
    # Leaves without a query meet nobody.
    placed = materialize(placed.join(over, node).select(
        *node, "blocks", "parts", "id", "h", "asked"), "leaves")
    mix = F.xxhash64("id")
    as_entry = F.expr("transform(sequence(0, parts - 1), p -> struct(0 AS role, own AS block, p AS part))")
    as_query = F.expr("transform(sequence(0, blocks - 1), b -> struct(1 AS role, b AS block, mine AS part))")

    def spread(rows: DataFrame) -> DataFrame:
        return rows.withColumn("own", F.pmod(mix, F.col("blocks")).cast("int")).withColumn(
            "mine", F.pmod(mix, F.col("parts")).cast("int")).withColumn(
            "seat", F.explode(F.when(F.col("asked"), F.concat(as_entry, as_query)).otherwise(as_entry))
        ).select("*", "seat.*").drop("seat", "own", "mine")

    cell = [*node, "block", "part"]
    schema = "query long, " + ", ".join(f"c{d} long" for d in range(BITS + 1))
    levels = materialize(
        spread(placed).select(*cell, "role", "id", "h").groupBy(*cell).applyInPandas(_levels, schema)
        .join(groups.where("asked").select(F.col("id").alias("query"), F.size("vector").alias("size")),
              "query"), "levels")
    if candidates is None:
        asked_ids = [int(i) for i in sample["query"].unique()]
        of_sample = levels.where(F.col("query").isin(asked_ids)).groupBy("query").agg(
            *(F.sum(f"c{d}").alias(f"c{d}") for d in range(BITS + 1))).toPandas()
        needed = by_size(needed_for(sample, of_sample, depths))
    else:
        needed = F.lit(candidates)
    reached = stops(levels, needed).withColumnRenamed("query", "id")
    met = spread(placed.join(reached, "id", "left").join(groups.select("id", "vector"), "id")).select(
        *cell, "role", "id", "h", "stop", "vector").groupBy(*cell).applyInPandas(
        _meet(k + 1), "query long, ids array<long>")
    met = materialize(met, "met")
    found = met.select("query", F.explode("ids").alias("id")).distinct()
    vectors = groups.select("id", F.col("vector").alias("v"))
    asked = clean.where("asked").select("vid", "vector").distinct().join(
        groups.select("id", "vector"), "vector").select(
        F.col("vid").alias("query_id"), F.col("id").alias("query"))
    dot = F.aggregate(F.zip_with("u", "v", lambda a, b: a.cast("double") * b.cast("double")),
                      F.lit(0.0), lambda s, x: s + x)

    def norm(name: str) -> Column:
        return F.sqrt(F.aggregate(name, F.lit(0.0),
                                  lambda s, x: s + x.cast("double") * x.cast("double")))

    scored = (found.join(vectors, "id")
              .join(groups.select(F.col("id").alias("query"), F.col("vector").alias("u")), "query")
              .withColumn("score", dot / (norm("u") * norm("v"))).select("query", "id", "score")
              .join(copies, "id").select("query", "score", F.explode("copies").alias("vid")))
    # The k + 1 best serve every query with this vector: each leaves out itself.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vid")
    return (asked.join(top, "query").where(F.col("vid") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("vid").alias("vec_id"), "score"))
