"""Near-duplicate embeddings by a PCA-ordered comparison of tiles.

Vectors are scaled to length 1 and turned so that the directions of most spread come first; neither changes a cosine.
Two vectors with cosine t are at most sqrt(2 - 2 t) apart, in every coordinate too: vectors fall into cells of that
width in the first three coordinates, and only cells that touch are compared. A cell is dealt into tiles of bounded
size, which are compared pair by pair: the products of the leading coordinates come first, and a pair of vectors goes on
only while they and the norms of what is left can reach t. Tile pairs with boxes too far apart are left out.

Tiles do not travel once for every tile they are compared with. They are dealt into blocks, a task compares a pair of
blocks, and a tile is copied to the block pairs that have a near one of it. Block pairs are taken in rounds, and a
round's copies are removed before the next, so that the disk they take is a few times the vectors however many there are.

Turning and scaling rounds, so a pair within NEAR of t is not decided there: its given vectors are fetched by a join, and
exact arithmetic compares their cosine with t.

Equal vectors form a class first and are compared once. A tile pair returns how many links each vector has and a
spanning forest of them, never the links themselves, so a group of thousands of copies gives thousands of rows.

Vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
neither, nor do those with a null vec_id, which are kept. vec_id is otherwise taken to be unique: rows that repeat it with another vector count as one vector linked with itself.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlemill.llm.graph import components
from candlemill.llm.scratch import Scratch, shuffles_removed, small_batches

TILE_ROWS = 2048
CELL_AXES = 3
LEADING = (8, 24)
#: Bytes of vectors in a block of tiles on average, and how many copies of all vectors a round may make.
BLOCK_BYTES = 16 << 20
ROUND_COPIES = 4
#: How near to the threshold a rounded cosine leaves the decision to exact arithmetic.
NEAR = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, unit, given): little-endian doubles, scaled to length 1 and as they are; both null for vectors that
    link with nothing."""

    def scale(batches):
        for batch in batches:
            dims, units, given = [], [], []
            for vec_id, value in zip(batch.column(0), batch.column(1), strict=True):
                x = np.array([v if v is not None else np.nan for v in value.as_py()], "<f8") if value.is_valid else np.zeros(0)
                top = np.abs(x).max() if len(x) else 0.0
                good = bool(np.isfinite(top) and top > 0) and vec_id.is_valid
                given.append(x.tobytes() if good else None)
                x = x / top if good else x
                units.append((x / np.sqrt((x * x).sum())).astype("<f8").tobytes() if good else None)
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(given, pa.binary())], ["vec_id", "dim", "unit", "given"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(scale, "vec_id long, dim int, unit binary, given binary")


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Orthonormal axes as columns, those of most spread first. What tasks return is one matrix each, added up by tasks."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py()).reshape(dim, dim)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    sums = classes.select("unit").mapInArrow(moments, "m binary").repartition(8).mapInArrow(add, "m binary").collect()
    total = sum(np.frombuffer(row.m).reshape(dim, dim) for row in sums)
    return np.ascontiguousarray(np.linalg.eigh(total)[1][:, ::-1])


def _turned(classes: DataFrame, axes, width: float) -> DataFrame:
    def turn(batches):
        for batch in batches:
            x = _matrix(batch.column(2)) @ axes.value
            cells = np.floor(x[:, :CELL_AXES] / width).astype(np.int32)
            cells = np.pad(cells, ((0, 0), (0, max(0, CELL_AXES - cells.shape[1]))))
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * CELL_AXES), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cell, pa.array([r.tobytes() for r in x], pa.binary())], ["id", "n", "cell", "x"])

    return classes.select("cls", "n", "unit").mapInArrow(turn, "id long, n long, cell array<int>, x binary")


def _pack(key, table):
    x = _matrix(table.column("x").combine_chunks())
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(ids, kind="stable")
    x = x[order]
    return pa.table(
        {
            "cell": pa.array([key[0].as_py()], pa.list_(pa.int32())), "tile": pa.array([key[1].as_py()], pa.int64()),
            "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "ns": pa.array([n[order].astype("<i8").tobytes()], pa.binary()),
            "xs": pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()),
            "low": pa.array([x.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([x.max(0).tolist()], pa.list_(pa.float64())),
        }
    )


def candidates(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a and b, turned unit vectors, whose product may be `least` or more, and the product as it was rounded."""
    dim = a.shape[1]
    steps = [d for d in LEADING if d < dim] + [dim]
    least = least - NEAR
    i = j = None
    done = 0
    value = np.zeros(0)
    for d in steps:
        rest_a, rest_b = np.sqrt(np.maximum(0, (a[:, d:] ** 2).sum(1))), np.sqrt(np.maximum(0, (b[:, d:] ** 2).sum(1)))
        if i is None:
            value = a[:, :d] @ b[:, :d].T
            i, j = np.nonzero(value >= least - rest_a[:, None] * rest_b[None, :])
            value = value[i, j]
        else:
            value = value + np.concatenate([np.einsum("ij,ij->i", a[i[s : s + 65536], done:d], b[j[s : s + 65536], done:d]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            keep = value >= least - rest_a[i] * rest_b[j]
            i, j, value = i[keep], j[keep], value[keep]
        done = d
    return i, j, value


def similar(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b, turned unit vectors, with a product of `least` or more, as it was rounded."""
    i, j, value = candidates(a, b, least)
    keep = value >= least
    return i[keep], j[keep]


def reaches(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether the cosine of two vectors is `least` or more, in exact arithmetic."""
    x, y = ([Fraction(v) for v in vector.tolist()] for vector in (a, b))
    dot = sum(p * q for p, q in zip(x, y, strict=True))
    square = dot * dot - Fraction(least) ** 2 * sum(p * p for p in x) * sum(q * q for q in y)
    return dot >= 0 and square >= 0 if least > 0 else dot >= 0 or square <= 0


def _decide(least: float):
    """(a, n_a, given_a, b, n_b, given_b) to the links of both, for pairs that reach `least`."""

    def decide(batches):
        for batch in batches:
            out = []
            for a, n_a, x, b, n_b, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reaches(np.frombuffer(x, "<f8"), np.frombuffer(y, "<f8"), least):
                    out += [(a, n_b, min(a, b)), (b, n_a, min(a, b))]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "links", "root"])

    return decide


def forest(i: np.ndarray, j: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns of a bipartite graph: the smallest row that links lead to, or `rows` without links."""
    left, right = np.full(rows, rows), np.full(columns, rows)
    left[i] = i
    while True:
        before = left.copy()
        np.minimum.at(right, j, left[i])
        np.minimum.at(left, i, right[j])
        if (left == before).all():
            return left, right


def blocks_and_rounds(size: int, cores: int) -> tuple[int, int]:
    """Into how many blocks tiles of `size` bytes are dealt, with a few block pairs for every core at least, and in how
    many rounds they are compared: of k blocks each goes to k block pairs, in a round to ROUND_COPIES of them."""
    blocks = max(ceil(size / BLOCK_BYTES), ceil(sqrt(4 * cores)))
    return blocks, ceil(blocks / ROUND_COPIES)


def _tile_links(ids: list, ns: list, a: np.ndarray, b: np.ndarray, same: bool, least: float) -> tuple[list, list]:
    """(id, links, root) columns of two tiles: pairs left to exact arithmetic, with -1 links, and links with their forest."""
    i, j, value = candidates(a, b, least)
    apart = i != j if same else np.ones(len(i), bool)
    near = apart & (value < least + NEAR)
    first = near & (i < j) if same else near  # a pair within a tile comes twice
    undecided = [(ids[0][i[first]], np.full(int(first.sum()), -1), ids[1][j[first]])]
    i, j = i[apart & ~near], j[apart & ~near]
    if not len(i):
        return undecided, []
    # A tile with itself: without a link to itself a vector's row and its column may lie in two trees.
    every = np.arange(len(a) if same else 0)
    left, right = forest(np.append(i, every), np.append(j, every), len(a), len(b))
    root = np.append(ids[0], -1)
    links = np.bincount(i, weights=ns[1][j], minlength=len(a)).astype(np.int64)
    has = np.flatnonzero(links)
    out = [(ids[0][has], links[has], root[left[has]])]
    if not same:
        links = np.bincount(j, weights=ns[0][i], minlength=len(b)).astype(np.int64)
        has = np.flatnonzero(links)
        out.append((ids[1][has], links[has], root[right[has]]))
    return undecided, out


def _compare(least: float, width: float):
    """All near tiles of a pair of blocks; a row per vector and root of its links."""
    names = ["id", "links", "root"]

    def table_of(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names)

    def compare(key, table):
        one, two = (k.as_py() for k in key)
        block = table.column("block").to_numpy()
        ids, ns = ([np.frombuffer(v.as_py(), "<i8") for v in table.column(c)] for c in ("ids", "ns"))
        xs = [np.frombuffer(v.as_py(), "<f8").reshape(len(i), -1) for v, i in zip(table.column("xs"), ids, strict=True)]
        low, high = np.array([x.min(0) for x in xs]), np.array([x.max(0) for x in xs])
        undecided, links = [], []
        for a in np.flatnonzero(block == one):
            others = np.flatnonzero(block == two)
            others = others[others >= a] if one == two else others
            gap = np.maximum(0, np.maximum(low[a] - high[others], low[others] - high[a]))
            for b in others[(gap * gap).sum(1) <= width * width]:
                more = _tile_links([ids[a], ids[b]], [ns[a], ns[b]], xs[a], xs[b], a == b, least)
                undecided += more[0]
                links += more[1]
        added = table_of(links).group_by(["id", "root"]).aggregate([("links", "sum")]).rename_columns(["id", "root", "links"])
        return pa.concat_tables([table_of(undecided), added.select(names)])

    return compare


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links to other vectors with a cosine of `least` or more."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    units = scratch.keep(unit_vectors(vectors), "units")
    classes = scratch.keep(units.where("unit is not null").groupBy("dim", "unit").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"), F.min_by("given", "vec_id").alias("given")), "classes")
    width = float(np.sqrt(2 - 2 * (least - NEAR))) + 1e-9
    found = None
    for (dim,) in sorted(classes.select("dim").distinct().collect()):
        own = classes.where(F.col("dim") == dim)
        axes = spark.sparkContext.broadcast(principal_axes(own, dim))
        turned = scratch.keep(_turned(own, axes, width), "turned")
        cells = turned.groupBy("cell").count().withColumn("tiles", F.ceil(F.col("count") / TILE_ROWS)).drop("count")
        dealt = turned.join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
        packed = dealt.groupBy("cell", "tile").applyInArrow(_pack, "cell array<int>, tile long, ids binary, ns binary, xs binary, low array<double>, high array<double>")
        tiles = scratch.keep(packed, "tiles")
        scratch.drop(turned)
        # Neighbours of a cell, itself included; of a pair of tiles the smaller one looks for the other.
        boxes = tiles.select("cell", "tile", "low", "high")
        shifts = F.array(*[F.array(*[F.lit(v) for v in (x, y, z)]) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)])
        near = boxes.withColumn("shift", F.explode(shifts)).withColumn("next", F.zip_with("cell", "shift", lambda c, s: c + s))
        one, two = near.alias("a"), boxes.alias("b")
        name_a, name_b = F.struct("a.cell", "a.tile"), F.struct("b.cell", "b.tile")
        gaps = F.zip_with(F.zip_with("a.low", "b.high", lambda x, y: x - y), F.zip_with("b.low", "a.high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
        far = F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g)
        pairs = one.join(two, (F.col("a.next") == F.col("b.cell")) & (name_a <= name_b)).where(far <= width * width)
        # A tile goes to the block pairs in which it has a near one, once to each.
        blocks, rounds = blocks_and_rounds(own.count() * dim * 8, spark.sparkContext.defaultParallelism)
        block_of = lambda side: F.pmod(F.xxhash64(f"{side}.cell", f"{side}.tile"), F.lit(blocks))
        met = pairs.select(name_a.alias("a"), name_b.alias("b"), F.least(block_of("a"), block_of("b")).alias("one"), F.greatest(block_of("a"), block_of("b")).alias("two"))
        ends = met.select(F.explode(F.array("a", "b")).alias("name"), "one", "two").distinct()
        needed = scratch.keep(ends.withColumn("round", F.pmod(F.xxhash64("one", "two"), F.lit(rounds))), "needed")
        data = tiles.select(F.struct("cell", "tile").alias("name"), F.pmod(F.xxhash64("cell", "tile"), F.lit(blocks)).alias("block"), "ids", "ns", "xs")
        tasks = max(spark.sparkContext.defaultParallelism, ceil(blocks * (blocks + 1) / 2 / rounds))
        for turn in range(rounds):
            copies = needed.where(F.col("round") == turn).join(data, "name").select("one", "two", "block", "ids", "ns", "xs").repartition(tasks, "one", "two")
            work = copies.groupBy("one", "two").applyInArrow(_compare(least, width), "id long, links long, root long")
            with small_batches(spark, 8), shuffles_removed(spark):
                links = scratch.keep(work, "links")
            found = links if found is None else found.union(links)
        scratch.drop(tiles, needed)
    if found is None:
        return units.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # Pairs next to the threshold have no links yet; they are few but for vectors made so.
    own = [classes.select(F.col("cls").alias(k), F.col("n").alias(f"n_{k}"), F.col("given").alias(f"given_{k}")) for k in ("a", "b")]
    near = found.where("links < 0").select(F.col("id").alias("a"), F.col("root").alias("b")).join(own[0], "a").join(own[1], "b")
    decided = near.select("a", "n_a", "given_a", "b", "n_b", "given_b").repartition("a", "b").mapInArrow(_decide(least), "id long, links long, root long")
    found = found.where("links > 0").unionByName(scratch.keep(decided, "links"))
    joined = components(scratch, found.select("id", "root"))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.join(counts, F.col("id") == F.col("cls"), "left").select("dim", "unit", "cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    facts = facts.join(joined.withColumnRenamed("id", "node"), F.col("node") == F.col("cls"), "left").select("dim", "unit", "n_links", F.coalesce("component", "cls").alias("component"))
    result = units.join(facts, ["dim", "unit"], "left")
    component = F.coalesce("component", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
