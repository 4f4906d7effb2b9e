"""Sharding by extendible hashing.

The directory is indexed by leading bits of a key's hash. A bucket that holds more than the limit splits
on the next bit, and only that one; so every shard is the shortest prefix whose rows fit. Prefix
sizes are summed in the tasks and shuffled as one row for each cell of a fine prefix; cells that are still too
large are refined from their own rows alone.

Rows whose whole hash is equal cannot be split by bits. If they exceed the limit together they go to overflow
pages: rows above half the limit have one each, the others are packed by running sums, counted by partition first,
so that no key's rows meet in one task. A single row above the limit is a shard of its own.

A null text has 0 bytes; a null key is hashed as the empty text. Repeated rows are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracecairn.llm.pfair import HASH_BITS, hash60
from tracecairn.operators.storage import materialize, scratch_path

#: A first cell holds about 1 / 2**SPARE of a shard; later rounds refine by STEP bits.
SPARE, STEP = 4, 10


def cell(hash_col: str, bits: int, total_bits: int = HASH_BITS) -> Column:
    return F.shiftright(hash_col, total_bits - bits)


def leaves(cells: DataFrame, group: list[str], bits: int, floor: int, limit: float) -> DataFrame:
    """``cells`` (group, cell, weight) with depth: the least one at which the prefix fits.

    Depths up to ``floor`` are known not to fit; a cell that does not fit alone gets bits + 1.
    """
    nodes = cells.withColumn("d", F.explode(F.sequence(F.lit(floor), F.lit(bits)))).withColumn(
        "p", F.expr(f"shiftright(cell, {bits} - d)"))
    over = nodes.groupBy(*group, "d", "p").agg(F.sum("weight").alias("s")).where(
        F.col("s") > limit).drop("s")
    deepest = (nodes.join(over, [*group, "d", "p"]).groupBy(*group, "cell")
               .agg((F.max("d") + 1).alias("depth")))
    return cells.join(deepest, [*group, "cell"], "left").withColumn(
        "depth", F.coalesce("depth", F.lit(floor)).cast("int"))


def directory(rows: DataFrame, limit: float, group: list[str], total_bits: int = HASH_BITS,
              hash_col: str = "h", weight_col: str = "weight") -> DataFrame:
    """``rows`` with depth: bits of the hash that name its bucket; total_bits + 1: unsplittable."""
    total = rows.groupBy(*group).agg(F.sum(weight_col).alias("s")).agg(F.max("s")).first()[0] or 0
    bits, floor, out = min(total_bits, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE)), 0, None
    left = rows
    while True:
        own = left.withColumn("cell", cell(hash_col, bits, total_bits))
        cells = materialize(own.groupBy(*group, "cell").agg(F.sum(weight_col).alias("weight")),
                            "cells")
        known = materialize(leaves(cells, group, bits, floor, limit), "leaves").drop("weight")
        placed = own.join(known, [*group, "cell"]).drop("cell")
        over = known.where(F.col("depth") > bits).limit(1).count()
        if bits == total_bits or not over:
            return placed if out is None else out.unionByName(placed)
        done = placed.where(F.col("depth") <= bits)
        out = done if out is None else out.unionByName(done)
        left = placed.where(F.col("depth") > bits).drop("depth")
        floor, bits = bits + 1, min(total_bits, bits + STEP)


def shards(docs: DataFrame, limit: int, seed: int = 11, id_col: str = "doc_id",
           text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, shard, depth, bytes): the shard is the hash prefix as bits, with -page for overflow.

    ``whole`` adds _row, a struct of all columns of the same row of ``docs``.
    """
    carried = ["_row"] if whole else []
    rows = materialize(docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"),
        hash60(F.col(id_col), seed).alias("h"),
        *(F.struct(*docs.columns).alias(x) for x in carried)), "keys")
    found = directory(rows, limit, [], weight_col="bytes")
    prefix = F.expr(f"substr(lpad(bin(h), {HASH_BITS}, '0'), 1, least(depth, {HASH_BITS}))")
    found = found.withColumn("shard", prefix)
    fits = found.where(F.col("depth") <= HASH_BITS)
    over = materialize(found.where(F.col("depth") > HASH_BITS), "overflow").withColumn(
        "_part", F.spark_partition_id()).withColumn(
        "_big", (2 * F.col("bytes") > limit).cast("int"))
    over = materialize(over, "overflow")
    weight = F.when(F.col("_big") == 1, limit).otherwise(2 * F.col("bytes"))
    per_part = over.groupBy("shard", "_big", "_part").agg(F.sum(weight).alias("s"))
    earlier = Window.partitionBy("shard", "_big").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    per_part = per_part.withColumn("_before", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    inside = Window.partitionBy("shard", "_big", "_part").orderBy("bytes").rowsBetween(
        Window.unboundedPreceding, -1)
    paged = (over.withColumn("_in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
             .join(per_part, ["shard", "_big", "_part"])
             .withColumn("shard", F.concat("shard", F.when(F.col("_big") == 1, "-x").otherwise("-"),
                                           F.expr(f"(_before + _in) div {limit}").cast("string"))))
    return fits.unionByName(paged.select(fits.columns)).select(
        id_col, "shard", F.least("depth", F.lit(HASH_BITS)).alias("depth"), "bytes", *carried)


def write_shards(docs: DataFrame, path: str, limit: int, seed: int = 11, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write every row of ``docs``, null and repeated ids included, to one folder a shard."""
    folder = folder_column(docs.columns)
    (shards(docs, limit, seed, id_col, text_col, whole=True)
     .select("_row.*", F.col("shard").alias(folder)).repartition(folder)
     .write.partitionBy(folder).option("compression", "zstd").parquet(path))


def folder_column(columns: list[str]) -> str:
    """The column that names the folders: shard, behind underscores where ``columns`` has that."""
    taken, name = {c.lower() for c in columns}, "shard"
    while name in taken:
        name = "_" + name
    return name


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of written shards, with their shard as the column that ``folder_column`` names.

    ``schema`` is that of the documents.
    """
    folder = folder_column(schema.names)
    # Given as a string: bits would be read as a number. A table of one shard has the empty prefix.
    rows = spark.read.schema(StructType([*schema, StructField(folder, StringType())])).parquet(path)
    return rows.withColumn(folder, F.coalesce(folder, F.lit("")))


def write_and_read(docs: DataFrame, limit: int, seed: int = 11, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id, shard, depth, bytes) of shards written below the shared folder, from the rows read back."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "id-shards")
    write_shards(docs, path, limit, seed, id_col, text_col)
    shard = F.col(folder_column(docs.columns))
    prefix = F.substring_index(shard, "-", 1)
    return read_shards(spark, path, docs.schema).select(
        id_col, shard.alias("shard"), F.length(prefix).alias("depth"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"))


def sql(limit: int, seed: int) -> str:
    """The same as DuckDB SQL over ``documents``, without overflow pages."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d.*, k, h >> ({HASH_BITS} - k) AS x FROM d, range({HASH_BITS + 1}) AS r(k)),
s AS (SELECT k, x, sum(bytes) AS total FROM p GROUP BY ALL),
f AS (SELECT doc_id, bytes, h, min(k) AS depth FROM p JOIN s USING (k, x) WHERE total <= {limit}
    GROUP BY doc_id, bytes, h)
SELECT doc_id, substr(lpad(bin(h), {HASH_BITS}, '0'), 1, depth::INT) AS shard, depth::INT AS depth, bytes FROM f"""
