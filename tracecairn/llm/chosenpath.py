"""MinHash near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, and carries ``COORDINATES`` minwise tokens of it (the
smallest shingle hash under so many hash functions). Each of ``TREES`` independent trees sends
documents down paths: a node selects one or two coordinates, by its own path alone, and a document
goes on to the child named by its minwise token there. Two sets of similarity J take the same child
with probability J for each coordinate; as a node selects 1.5 coordinates on average, pairs above the
threshold multiply on their way down while others get lost. A node of at most ``LEAF`` documents is
compared exhaustively. A link at the threshold is met in a tree with probability 0.64 or more, however
deep the nodes where it is found (0.85 where the first node is small already), so ``TREES`` = 10 miss
at most four in 100,000 of such links and fewer of closer ones.

Nodes are compared in cells, block against block, so a task never gets more than two blocks of one
node. A comparison asks for lengths that can reach the threshold and for sketches of 2 x 64 bits (one
bit of each minwise token) that differ in at most ``SKETCH`` bits, 4.8 standard deviations above what a
link at the threshold differs in. A pair that several trees meet belongs to its smallest path. What
passes is packed into one row a cell and confirmed on the full sets, whose words are sent once to each
cell that asks for them; a cell returns a spanning forest of its links, as only components are asked for. Pairs of documents already in
one component are not compared again.

Nodes that stay large hold groups of near copies. Their most central documents are compared with all
others, which puts most of the group into one component. A node with one component is done; one with
few documents outside its largest component compares those with all of them; any other goes down
another level. What is still large after ``LEVELS`` levels is compared in cells, however many, so that no
link depends on a cap.

Equal sets are one node of the trees, however many documents hold them. Words are lower-cased in A-Z and
cut at ASCII white space. Texts of fewer words than a shingle are one shingle; null, empty and blank
texts have none and link with nothing. Repeated rows each keep their row; a null id takes part, names a
component only where no other id is there, and counts as kept there. Very long texts are sets like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecairn.llm.common import chunks, texts_of
from tracecairn.llm.simhash import components
from tracecairn.operators.storage import materialize

SHINGLE_WORDS, PERCENT = 5, 85
COORDINATES, TREES = 64, 10
LEAF, LEVELS, PIVOTS = 2048, 16, 4
#: Documents of a node in one block; a cell compares two blocks.
BLOCK = 256
#: Every other node selects a second coordinate.
SECOND = 0.5
SKETCH = 24
#: Columns of the membership matrix that a cell multiplies at a time.
COLUMNS = 4096
CACHE_WORDS = 400_000
_FUNCTIONS = 128
_ODD = np.random.default_rng(12).integers(0, 1 << 31, _FUNCTIONS, np.uint32) * 2 + np.uint32(1)
_FLIP = np.random.default_rng(13).integers(0, 1 << 32, _FUNCTIONS, np.uint32)


# --- sets ------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash of each word; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _by_place(width: int) -> np.ndarray:
    return np.random.default_rng(14).integers(0, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingle_set(parts: list[bytes], known: WordHashes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a sequence of words."""
    hashes = known.of(parts)
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    n = len(hashes) - width + 1
    # A word counts by its place; the number of words too, as short texts are one shingle.
    sums = np.full(n, width, np.uint64)
    for k, odd in enumerate(_by_place(width)):
        sums += hashes[k:k + n] * odd
    return np.unique(_mix(sums))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minwise tokens and sketches of non-empty sets, one row each."""
    heads = np.cumsum([0, *map(len, sets)])[:-1]
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    mins = np.empty((_FUNCTIONS, len(sets)), np.uint32)
    for i in range(_FUNCTIONS):
        mins[i] = np.minimum.reduceat((low ^ _FLIP[i]) * _ODD[i], heads)
    bits = (mins * np.uint32(0x9E3779B1) + _FLIP[:, None]) >> np.uint32(31)
    packed = np.packbits(bits.T.astype(np.uint8), axis=1, bitorder="little")
    tokens = np.ascontiguousarray(mins[:COORDINATES].T).view(np.int32)
    return tokens, np.ascontiguousarray(packed).view(np.int64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """One row a document: id, n, key of the set (k1, k2), sketch (s1, s2), minwise tokens, and the
    words, packed."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = (f"id {kind}, n long, k1 long, k2 long, s1 long, s2 long, tokens array<int>, "
              "body binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = WordHashes(), zstandard.ZstdCompressor(level=3)
        for part in chunks(batches, "text"):
            parts = [words_of(x) for x in texts_of(part, "text")]
            sets = [shingle_set(x, known, words) for x in parts]
            sizes = np.array([len(x) for x in sets], np.int64)
            full = np.flatnonzero(sizes)
            longs = np.zeros((4, len(sets)), np.int64)
            tokens = np.zeros((len(sets), COORDINATES), np.int32)
            joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            if len(full):
                heads = (np.cumsum(sizes) - sizes)[full]
                tokens[full], sketches = signatures([sets[i] for i in full])
                longs[2:, full] = sketches.T
                longs[0, full] = np.add.reduceat(joined, heads).view(np.int64)
                longs[1, full] = np.add.reduceat(_mix(joined + np.uint64(1)), heads).view(np.int64)
            wide = np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), *map(pa.array, longs),
                 pa.ListArray.from_arrays(wide, pa.array(tokens.ravel())),
                 pa.array([packer.compress(b" ".join(x)) for x in parts], pa.binary())],
                ["id", "n", "k1", "k2", "s1", "s2", "tokens", "body"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, fields).withColumn("row", F.monotonically_increasing_id())


# --- comparing -------------------------------------------------------------------------------


def _block(count: Column) -> Column:
    return F.pmod(F.xxhash64("node"), F.greatest(F.ceil(count / BLOCK), F.lit(1)))


def _cell_rows(rows: DataFrame, cell: Column, side: Column, earlier: Column | None = None) -> DataFrame:
    """Rows of a cell: two of them are compared if their sides cover both bits."""
    earlier = F.array().cast("array<long>") if earlier is None else earlier
    return rows.select(cell.alias("cell"), "node", "n", "s1", "s2", "root",
                       side.cast("int").alias("side"), earlier.alias("earlier"))


def _by_cells(rows: DataFrame) -> DataFrame:
    """Cells that compare all pairs of each path. ``rows``: path, _size and a node's columns.

    Every row goes to the cells of its own block with each block of the path.
    """
    own = rows.groupBy("node").agg(F.collect_set("path").alias("_paths"))
    rows = rows.withColumn("_block", _block(F.col("_size"))).join(own, "node")
    others = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_size") / BLOCK) - 1)
    rows = rows.withColumn("_other", F.explode(others))
    cell = F.xxhash64("path", F.least("_block", "_other"), F.greatest("_block", "_other"))
    side = F.when(F.col("_block") == F.col("_other"), 3).when(
        F.col("_block") < F.col("_other"), 1).otherwise(2)
    return _cell_rows(rows, cell, side, F.filter("_paths", lambda x: x < F.col("path")))


def _against(few: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Cells that compare ``few`` rows of each path with all of its rows, a block at a time."""
    last = F.greatest(F.ceil(F.col("_size") / BLOCK), F.lit(1)) - 1
    few = few.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = all_rows.withColumn("_block", _block(F.col("_size")))
    cell = F.xxhash64("path", "_block", F.lit("few"))
    return _cell_rows(rows, cell, F.lit(0)).unionByName(_cell_rows(few, cell, F.lit(3)))


def _passing(nodes: np.ndarray, n: np.ndarray, sketches: np.ndarray, root: np.ndarray,
             side: np.ndarray, earlier: list[set], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows that may be a link and belong to this path."""
    a, b = np.triu_indices(len(nodes), 1)
    good = ((side[a] | side[b]) == 3) & (root[a] != root[b]) & (
        100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    a, b = a[good], b[good]
    near = np.bitwise_count(sketches[a] ^ sketches[b]).sum(axis=1) <= SKETCH
    a, b = a[near], b[near]
    own = [earlier[i].isdisjoint(earlier[j]) for i, j in zip(a.tolist(), b.tolist())]
    own = np.array(own, bool)
    return a[own], b[own]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype(np.int32).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int32)


def candidates(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row a cell with pairs to confirm: its nodes and, packed, the pairs' places among them."""
    fields = ("node", "n", "s1", "s2", "root", "side", "earlier")
    grouped = cells.groupBy("cell").agg(F.collect_list(F.struct(*fields)).alias("m")).where(
        F.size("m") > 1).select("cell", *[F.col(f"m.{x}").alias(x) for x in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                nodes, n, s1, s2, root, side = (
                    batch.column(x)[i].values.to_numpy() for x in fields[:-1])
                # A row that stands on both sides of a comparison with few is one node.
                once = np.unique(nodes, return_index=True)[1]
                if len(once) < len(nodes):
                    once = np.lexsort((-side, nodes))
                    once = once[np.concatenate(([True], np.diff(nodes[once]) != 0))]
                sketches = np.stack((s1, s2), axis=1).view(np.uint64)[once]
                earlier = [set(x) for x in batch.column("earlier")[i].as_py()]
                nodes = nodes[once]
                a, b = _passing(nodes, n[once], sketches, root[once], side[once],
                                [earlier[k] for k in once.tolist()], percent)
                if len(a):
                    used, places = np.unique(np.concatenate((a, b)), return_inverse=True)
                    found.append((batch.column("cell")[i].as_py(), nodes[used], _pack(places)))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in found], pa.int64()),
                     pa.array([x[1] for x in found], pa.list_(pa.int64())),
                     pa.array([x[2] for x in found], pa.binary())], ["cell", "asked", "pairs"])

    return grouped.mapInArrow(run, "cell long, asked array<long>, pairs binary")


def _forest(nodes: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray,
            percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of places (a, b) whose sets reach the threshold."""
    sizes = np.array([len(x) for x in sets], np.int64)
    # Shingles of one set alone are in no intersection.
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    owner = np.repeat(np.arange(len(nodes)), sizes)[many[column] > 1]
    column = place[column[many[column] > 1]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    common = np.zeros((len(nodes), len(nodes)), np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, COLUMNS):
        own = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        member = np.zeros((len(nodes), COLUMNS), np.float32)
        member[owner[own], column[own] - low] = 1
        common += member @ member.T
    shared = common[a, b].astype(np.int64)
    link = 100 * shared >= percent * (sizes[a] + sizes[b] - shared)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    kept = []
    for x, y in zip(a[link].tolist(), b[link].tolist()):
        p, q = top(x), top(y)
        if p != q:
            above[p] = q
            kept.append((x, y))
    found = np.array(kept, np.int64).reshape(-1, 2)
    return nodes[found[:, 0]], nodes[found[:, 1]]


def confirmed(cells: DataFrame, bodies: DataFrame, percent: int = PERCENT,
              words: int = SHINGLE_WORDS) -> DataFrame:
    """(a, b): links that connect what all links among the cells' pairs connect.

    ``bodies`` has node and body; each is sent once to a cell. A cell has a few hundred of them.
    """
    members = cells.select("cell", F.explode("asked").alias("node")).join(bodies, "node").groupBy(
        "cell").agg(F.collect_list(F.struct("node", "body")).alias("m")).select(
        "cell", F.col("m.node").alias("nodes"), F.col("m.body").alias("bodies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unpacker = WordHashes(), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                asked, nodes, packed = (
                    batch.column(x)[i].values for x in ("asked", "nodes", "bodies"))
                sets = [shingle_set(unpacker.decompress(x.as_buffer()).split(), known, words)
                        for x in packed]
                asked, nodes = asked.to_numpy(), nodes.to_numpy()
                order = np.argsort(nodes)
                places = order[np.searchsorted(nodes, asked, sorter=order)]
                a, b = places[_unpack(batch.column("pairs")[i].as_py())].reshape(2, -1)
                found = _forest(nodes, sets, a, b, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return members.join(cells, "cell").mapInArrow(run, "a long, b long")


class Components:
    """Links found so far, and each linked node's component."""

    def __init__(self, bodies: DataFrame, percent: int, words: int):
        self.bodies, self.percent, self.words = bodies, percent, words
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def name(self, rows: DataFrame) -> DataFrame:
        """Add each node's component; a node without links is its own."""
        rows = rows.drop("root")
        if self.roots is None:
            return rows.withColumn("root", F.col("node"))
        return rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def add(self, cells: DataFrame) -> None:
        """Join the components of all pairs of the cells that are links."""
        pairs = materialize(candidates(cells, self.percent), "pairs")
        found = materialize(confirmed(pairs, self.bodies, self.percent, self.words), "links")
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.roots = components(self.links)


# --- trees -----------------------------------------------------------------------------------


def _roots_of_trees(nodes: DataFrame) -> DataFrame:
    """Each node's path in each tree after the first level: tree t selects coordinate t."""
    paths = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.xxhash64(
        t, F.element_at("tokens", t + 1)))
    return nodes.select("node", "n", "s1", "s2", F.explode(paths).alias("path"))


def _children(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """One level down: the coordinates follow from the path, the child from the minwise token."""
    path = F.col("path")
    first = F.pmod(F.xxhash64(path, F.lit(1)), F.lit(COORDINATES)).cast("int")
    step = F.pmod(F.xxhash64(path, F.lit(2)), F.lit(COORDINATES - 1)).cast("int") + 1
    second = F.when(F.pmod(F.xxhash64(path, F.lit(3)), F.lit(1000)) < int(1000 * SECOND),
                    F.pmod(first + step, F.lit(COORDINATES)))

    def child(at: Column) -> Column:
        return F.when(at.isNotNull(), F.xxhash64(path, at, F.element_at("tokens", at + 1)))

    return rows.join(tokens, "node").select(
        "node", "n", "s1", "s2",
        F.explode(F.array_compact(F.array(child(first), child(second)))).alias("path")).distinct()


def _central(large: DataFrame) -> DataFrame:
    """The documents of each path whose first 64 sketch bits are nearest to the majority's."""
    bits = [F.sum(F.call_function("shiftright", F.col("s1"), F.lit(i)).bitwiseAND(F.lit(1)))
            .alias(f"_{i}") for i in range(64)]
    majority = F.lit(0).cast("long")
    for i in range(64):
        majority = majority.bitwiseOR(
            F.when(2 * F.col(f"_{i}") > F.col("_n"),
                   F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(i)))
            .otherwise(F.lit(0).cast("long")))
    middle = large.groupBy("path").agg(F.count("*").alias("_n"), *bits).select(
        "path", majority.alias("_middle"))
    away = F.bit_count(F.col("s1").bitwiseXOR(F.col("_middle")))
    order = Window.partitionBy("path").orderBy("_away", F.xxhash64("path", "node"))
    return (large.join(middle, "path").withColumn("_away", away)
            .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= PIVOTS)
            .drop("_middle", "_away", "_rank"))


def _outside(large: DataFrame) -> DataFrame:
    """(path, main, others): each path's largest component, and how many rows lie outside of it."""
    by_root = large.groupBy("path", "root").agg(F.count("*").alias("_n"))
    return by_root.groupBy("path").agg(
        F.max(F.struct("_n", "root")).alias("_main"), F.sum("_n").alias("_all")).select(
        "path", F.col("_main.root").alias("main"), (F.col("_all") - F.col("_main._n")).alias("others"))


def join_sets(nodes: DataFrame, bodies: DataFrame, percent: int = PERCENT,
              words: int = SHINGLE_WORDS, leaf: int = LEAF,
              levels: int = LEVELS) -> DataFrame | None:
    """(node, root) of all nodes with links; None without any.

    ``nodes`` has node, n, s1, s2, tokens; ``bodies`` node and body.
    """
    found = Components(bodies, percent, words)
    tokens = nodes.select("node", "tokens")
    rows = _roots_of_trees(nodes)
    for level in range(1, levels + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("_size")).where("_size > 1")
        shared = materialize(found.name(rows.join(sizes, "path")), "shared")
        if level == 1:
            # Who meets nobody here never will.
            active = shared.select("node").distinct()
            found.bodies = materialize(bodies.join(active, "node", "left_semi"), "bodies")
        large = shared.where(F.col("_size") > leaf)
        cells = _by_cells(shared.where(F.col("_size") <= leaf))
        if large.isEmpty():
            found.add(cells)
            break
        found.add(cells.unionByName(_against(_central(large), large)))
        large = materialize(found.name(large), "large")
        large = large.join(_outside(large).where("others > 0"), "path")
        few = large.where(F.col("others") <= leaf // 16)
        found.add(_against(few.where("root <> main"), few))
        rest = found.name(large.where(F.col("others") > leaf // 16).drop("main", "others"))
        if level == levels:
            found.add(_by_cells(rest))
            break
        rows = materialize(_children(rest, tokens), "paths")
        if rows.isEmpty():
            break
    return found.roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, percent: int = PERCENT, leaf: int = LEAF,
                    levels: int = LEVELS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every document."""
    rows = materialize(shingle_sets(docs, id_col, text_col, words), "shingle-sets")
    own = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.min("id").alias("first"))
    own = materialize(own, "distinct-sets")
    facts = rows.select(F.col("row").alias("node"), "n", "s1", "s2", "tokens").join(
        own.select("node"), "node", "left_semi")
    bodies = rows.select(F.col("row").alias("node"), "body")
    roots = join_sets(materialize(facts, "nodes"), bodies, percent, words, leaf, levels)
    if roots is None:
        named = own.withColumn("component_id", F.col("first"))
    else:
        named = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = named.join(lowest, "root")
    named = named.select("k1", "k2", "component_id")
    linked = rows.where("n > 0").select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select(
        "id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
