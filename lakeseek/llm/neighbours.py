"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a string of 64 random-hyperplane bits; a tree is the sorted array of these strings, cut by their first bits
into blocks of about ``BLOCK`` vectors, the unit of a task. The entries of a tree carry the vectors as bytes (one for each dimension);
the vectors themselves are fetched for the best candidates only. Queries are the rows whose id is divisible by ``every``.

1. Descent: in every tree the query's string leads to its longest prefix matches, found in the sorted array by bisection.
2. Synchronous ascent: all trees go up level by level together, until they hold ``CANDIDATES`` entries below the level; a level is taken
   whole. The k-th best cosine among them is a bound: the true k-th neighbour is at least as near.
3. A vector at the bound shares a prefix of ``d`` bits in a tree with probability ``p ** d``, ``p = 1 - angle / pi``. While the level is above
   the one at which the trees together miss such a vector with a probability below ``1 - RECALL``, the ascent is over. The other queries
   go on up, tree by tree, to just that place, or one tree to its root where that is less. So each of the true neighbours is met with that probability or a higher one, whatever the
   data: near copies need the ends of long strings only, vectors without near neighbours (random ones) go up far.

A level shorter than a block's prefix sends the query to all blocks below; a block of more than ``2 * BLOCK`` vectors (many equal strings)
is cut by id, and its queries go to every part. Equal vectors are one entry with its k + 1 least ids. Nothing is capped, and what a task
holds is bounded.

Defined cases: rows with a null id, a null, empty or zero vector or one with a value that is null or not finite have no direction and
are left out, as are vectors of another length than the commonest (the shorter of equally common ones); of rows with the same id the one
with the least values counts; equally near neighbours (to six digits) are taken in order of id; fewer than k other vectors give fewer
rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if, cut

K = 10
TREES = 32
CANDIDATES = 400
BLOCK = 4096
RECALL = 0.9
EVERY = 20
GRID = 64
_planes: dict[tuple, np.ndarray] = {}


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    key = (dim, trees, seed)
    if key not in _planes:
        _planes[key] = np.random.default_rng(seed).standard_normal((dim, trees * 64), dtype=np.float32)
    return _planes[key]


def strings(vectors: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """The 64-bit string of each vector in each tree, first bit highest."""
    bits = vectors @ planes(vectors.shape[1], trees, seed) > 0
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def ascent(bound: np.ndarray, trees: int, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, first): with the first trees at this level and the others one deeper, a vector of this cosine is met with the wanted probability."""
    p = np.clip(1 - np.arccos(np.clip(bound, -1, 1)) / np.pi, 1e-9, 1 - 1e-12)
    one = 1 - (1 - recall) ** (1 / trees)
    level = np.clip(np.floor(math.log(one) / np.log(p)), 0, 64)
    here, deeper = np.log1p(-np.minimum(p**level, 1 - 1e-15)), np.where(level < 64, np.log1p(-(p ** (level + 1))), 0.0)
    # the least number with: first * here + (trees - first) * deeper <= log(1 - recall)
    first = np.ceil((math.log(1 - recall) - trees * deeper) / np.minimum(here - deeper, -1e-300) - 1e-9)
    first = np.clip(np.where(level == 0, 1, first), 1, trees)
    # where that is more than the number of vectors, the root of one tree is less and misses none
    root = (level > 0) & (first * 2.0**-level + (trees - first) * 2.0 ** -(level + 1) >= 1)
    return np.where(root, 0, level).astype(np.int32), np.where(root | (level == 0), 1, first).astype(np.int32)


def _unit(dim: int):
    """Vectors of length one as bytes of 32-bit numbers; divided by their greatest value first, so that none is too large or too small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("vector").flatten().to_numpy().reshape(-1, dim)
            v = v / np.abs(v).max(1, keepdims=True)
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)  # no negative zeros
            yield pa.record_batch([b.column("id"), pa.array([x.tobytes() for x in v], pa.binary())], ["id", "body"])

    return run


def _prepare(dim: int, trees: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                v = np.frombuffer(b"".join(part.column("body").to_pylist()), np.float32).reshape(-1, dim)
                h = strings(v, trees, seed).view(np.int64)
                scale = np.abs(v).max(1, keepdims=True) / np.float32(127)
                code = np.rint(v / scale).astype(np.int8)
                error = np.linalg.norm(v - code * scale, axis=1)
                off = pa.array(np.arange(len(v) + 1, dtype=np.int32) * trees)
                yield pa.record_batch(
                    [part.column("id"), part.column("ids"), part.column("body"), pa.array([s.tobytes() + x.tobytes() for s, x in zip(scale, code)], pa.binary()), pa.array(error.astype(np.float64)), pa.ListArray.from_arrays(off, pa.array(h.reshape(-1)))],
                    ["id", "ids", "body", "code", "error", "strings"],
                )

    return run


def by_group(solve: Callable, keys: tuple[str, ...], out: list[str]):
    """Rows come sorted by their keys; each group goes to ``solve`` as one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                for got in solve(pa.Table.from_batches(held)):
                    yield pa.record_batch([pa.array(c) for c in got], out)
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if last is not None and tuple(key[lo]) != last:
                    yield from close()
                last = tuple(key[lo])
                held.append(b.slice(lo, hi - lo))
        yield from close()

    return run


def _below(level: np.ndarray) -> np.ndarray:
    """The bits that are free below a level of 0 to 64 bits."""
    full = np.uint64(2**64 - 1)
    return np.where(level >= 64, np.uint64(0), full >> np.minimum(level, 63).astype(np.uint64))


def _descend(candidates: int, bits: int):
    """(id, level, more): for each query of a block the entries that each level adds, from the longest prefix match up to enough of them."""

    def solve(t: pa.Table) -> Iterator[tuple]:
        member = t["member"].to_numpy()
        h = t["h"].to_numpy().view(np.uint64)
        ask = np.flatnonzero(t["query"].to_numpy())
        tree = np.sort(h[member])
        if not len(ask):
            return
        q, own = h[ask], t["id"].to_numpy()[ask]
        before = np.zeros(len(q), np.int64)
        open_ = np.ones(len(q), bool)
        mine = member[ask].astype(np.int64)  # the query itself is no candidate
        ids, levels, more = [], [], []
        for level in range(64, bits - 1, -1):
            free = _below(np.full(len(q), level))
            n = np.searchsorted(tree, q | free, side="right") - np.searchsorted(tree, q & ~free) - mine
            new = open_ & (n > before)
            ids.append(own[new])
            levels.append(np.full(int(new.sum()), level, np.int32))
            more.append(n[new] - before[new])
            before = n
            open_ = open_ & (n < candidates)
            if not open_.any():
                break
        yield np.concatenate(ids), np.concatenate(levels), np.concatenate(more)

    return solve


def _search(k: int, dim: int, slack: float, counter: Accumulator | None):
    """(id, other): for each query the candidates below its level in a block that may be among the k nearest of them."""

    def solve(t: pa.Table) -> Iterator[tuple]:
        ids, h = t["id"].to_numpy(), t["h"].to_numpy().view(np.uint64)
        inside = np.flatnonzero(t["member"].to_numpy())
        inside = inside[np.argsort(h[inside], kind="stable")]
        ask = np.flatnonzero(t["query"].to_numpy())
        if not len(ask) or not len(inside):
            return
        raw = np.frombuffer(b"".join(t["code"].take(pa.array(inside)).to_pylist()), np.uint8).reshape(len(inside), 4 + dim)
        p = raw[:, 4:].view(np.int8).astype(np.float32) * raw[:, :4].copy().view(np.float32)
        v = np.frombuffer(b"".join(t["body"].take(pa.array(ask)).to_pylist()), np.float32).reshape(len(ask), dim)
        mine, hp, hq, own = ids[inside], h[inside], h[ask], ids[ask]
        bound = t["bound"].to_numpy()[ask]
        free = _below(t["level"].to_numpy()[ask])
        # ranges are widened to a grid, so that queries that lie close together share a product
        lo = np.searchsorted(hp, hq & ~free) // GRID * GRID
        hi = np.minimum(-(-np.searchsorted(hp, hq | free, side="right") // GRID) * GRID, len(mine))
        order = np.lexsort((hi, lo))
        cuts = np.flatnonzero((np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
        found: list[tuple] = []
        for run in np.split(order, cuts):
            a, z = int(lo[run[0]]), int(hi[run[0]])
            if z <= a:
                continue
            if counter is not None:
                counter.add(len(run) * (z - a))
            for at in range(0, len(run), 512):
                q = run[at : at + 512]
                s = v[q] @ p[a:z].T
                s[own[q][:, None] == mine[a:z][None]] = -4
                least = bound[q]
                if z - a > k:
                    least = np.maximum(least, np.partition(s, z - a - k, axis=1)[:, z - a - k])
                r, c = np.nonzero((s >= (least - 2 * slack)[:, None]) & (s > -3))
                found.append((own[q][r], mine[a:z][c]))
            if sum(len(x[0]) for x in found) > 100_000:
                yield tuple(np.concatenate(c) for c in zip(*found))
                found = []
        if found:
            yield tuple(np.concatenate(c) for c in zip(*found))

    return solve


def _clean(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, vector) of the usable rows, one for each id, and the length of the vectors."""
    v = F.col("vector")
    table = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size("vector") > 0))
    table = table.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    length = table.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return table, 0
    return table.where(F.size("vector") == length["n"]).groupBy("id").agg(F.min("vector").alias("vector")), length["n"]


def _prefix(h: str, length: int) -> str:
    return f"shiftrightunsigned({h}, {64 - length})" if length else "0L"


class Forest:
    """The trees over one table of distinct vectors, cut into blocks."""

    def __init__(self, points: DataFrame, trees: int, block: int):
        n = points.count()
        self.bits = max(0, math.ceil(math.log2(n / block))) if n else 0
        entries = points.select("id", "code", F.posexplode("strings").alias("tree", "h")).withColumn("prefix", F.expr(_prefix("h", self.bits)))
        # blocks with more than twice their members are cut in parts
        parts = entries.groupBy("tree", "prefix").count().where(f"count > {2 * block}").selectExpr("tree as _t", "prefix as _x", f"cast(ceil(count / {block}) as int) as parts")
        self.parts = broadcast_if(cut(parts))
        placed = entries.join(self.parts, F.expr("tree = _t and prefix = _x"), "left")
        self.entries = placed.selectExpr("id", "code", "tree", "h", "prefix", "cast(pmod(xxhash64(id), coalesce(parts, 1)) as int) as part")

    def blocks(self, queries: DataFrame, codes: bool) -> DataFrame:
        """The entries and, beside them, the queries (id, body, bound, level, tree, h) of each block that lies below their level."""
        bits = self.bits
        own = F.expr(_prefix("h", bits))
        below = f"case when level >= {bits} then array(own) else sequence(shiftleft(shiftright(own, {bits} - level), {bits} - level), shiftleft(shiftright(own, {bits} - level) + 1, {bits} - level) - 1) end"
        spread = queries.withColumn("own", own).withColumn("prefix", F.explode(F.expr(below)) if bits else F.col("own"))
        spread = spread.join(self.parts, F.expr("tree = _t and prefix = _x"), "left").withColumn("part", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
        columns = "id", "tree", "prefix", "part", "h", "member", "query", "level", "bound", "code", "body"
        asked = spread.selectExpr("id", "tree", "prefix", "part", "h", f"own = prefix and cast(pmod(xxhash64(id), coalesce(parts, 1)) as int) = part as inside", "level", "bound", "body")
        asked = asked.selectExpr("id", "tree", "prefix", "part", "h", "false as member" if codes else "inside as member", "true as query", "level", "bound", "cast(null as binary) as code", "body")
        held = self.entries if codes else self.entries.withColumn("code", F.lit(None).cast("binary"))
        held = held.selectExpr("id", "tree", "prefix", "part", "h", "true as member", "false as query", "0 as level", "0D as bound", "code", "cast(null as binary) as body")
        both = held.unionByName(asked).select(*columns)
        return both.repartition("tree", "prefix", "part").sortWithinPartitions("tree", "prefix", "part")


def neighbours(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, trees: int = TREES, candidates: int = CANDIDATES, recall: float = RECALL, block: int = BLOCK, every: int = EVERY, seed: int = 10, counter: Accumulator | None = None) -> DataFrame:
    """(key, neighbour_id, rank, similarity): the k nearest others by cosine of every row whose id is divisible by ``every``, nearest first, rank from 1.

    counter: an accumulator that is given the number of vectors compared.
    """
    table, dim = _clean(rows, key, vector)
    spark = rows.sparkSession
    if not dim:
        return spark.createDataFrame([], f"{key} long, neighbour_id long, rank int, similarity double")
    base = cut(table.mapInArrow(_unit(dim), "id long, body binary"))
    # of equal vectors the k + 1 least ids are enough: a limit in each task comes before the shuffle
    least = base.withColumn("_r", F.row_number().over(W.partitionBy("body").orderBy("id"))).where(f"_r <= {k + 1}")
    folded = least.groupBy("body").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "ids", "body")
    points = cut(folded.mapInArrow(_prepare(dim, trees, seed), "id long, ids array<long>, body binary, code binary, error double, strings array<long>"))
    slack = points.agg(F.max("error")).first()[0] + 1e-6
    forest = Forest(points, trees, block)
    # equal queries are asked once, as the entry that they are folded into
    of = cut(base.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "body").join(points.select(F.col("id").alias("rep"), "body"), "body").select("query_id", "rep"))
    reps = of.select(F.col("rep").alias("id")).distinct()
    asked = cut(points.join(reps, "id").select("id", "body", "strings"))
    each = asked.select("id", "body", F.posexplode("strings").alias("tree", "h"))

    start = each.withColumns({"level": F.lit(forest.bits), "bound": F.lit(-2.0)}).withColumn("body", F.lit(None).cast("binary"))
    steps = forest.blocks(start, False).mapInArrow(by_group(_descend(candidates, forest.bits), ("tree", "prefix", "part"), ["id", "level", "more"]), "id long, level int, more long")
    up = W.partitionBy("id").orderBy(F.desc("level"))
    reached = steps.groupBy("id", "level").agg(F.sum("more").alias("more")).withColumn("held", F.sum("more").over(up)).where(F.col("held") >= candidates)
    level = reached.groupBy("id").agg(F.max("level").alias("level"))

    def visit(queries: DataFrame) -> DataFrame:
        shape = "id long, other long"
        found = forest.blocks(queries, True).mapInArrow(by_group(_search(k, dim, slack, counter), ("tree", "prefix", "part"), ["id", "other"]), shape).distinct()
        near = points.select(F.col("id").alias("other"), "ids", F.col("body").alias("theirs"))
        pair = found.join(near, "other").join(asked.select("id", "body"), "id")
        return pair.mapInArrow(_cosines(dim), "id long, ids array<long>, similarity double")

    first = each.join(level, "id", "left").withColumns({"level": F.coalesce("level", F.lit(forest.bits)), "bound": F.lit(-2.0)})
    one = cut(visit(first))
    own = points.select("id", "ids", F.lit(1.0).alias("similarity")).join(reps, "id", "left_semi")
    # the k-th best of what was met, copies of the query's own vector among them
    met = one.withColumn("n", F.size("ids")).unionByName(own.withColumn("n", F.size("ids") - 1))
    met = met.withColumn("upto", F.sum("n").over(W.partitionBy("id").orderBy(F.desc("similarity"), F.col("ids")[0])))
    kth = met.where(f"upto >= {k}").groupBy("id").agg(F.max("similarity").alias("bound"))
    state = asked.select("id").join(level, "id", "left").join(kth, "id", "left").select("id", F.coalesce("level", F.lit(forest.bits)).alias("at"), F.coalesce("bound", F.lit(-2.0)).alias("bound"))

    def depths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            level, first = ascent(b.column("bound").to_numpy(), trees, recall)
            yield pa.record_batch([b.column("id"), b.column("at"), b.column("bound"), pa.array(level), pa.array(first)], ["id", "at", "bound", "goal", "trees"])

    open_ = cut(state.mapInArrow(depths, "id long, at int, bound double, goal int, trees int").where("at > goal"))
    again = each.join(open_, "id").withColumn("level", F.when(F.col("tree") < F.col("trees"), F.col("goal")).otherwise(F.col("goal") + 1)).where("level <= 64 and (goal > 0 or tree = 0)").drop("at", "goal", "trees")
    two = visit(again)
    pairs = one.unionByName(two).unionByName(own).groupBy("id", "ids").agg(F.max("similarity").alias("similarity"))
    answers = of.join(pairs, F.col("rep") == F.col("id")).select("query_id", F.explode("ids").alias("other"), "similarity").where("query_id <> other")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "other"))
    return answers.withColumn("rank", rank).where(f"rank <= {k}").select(F.col("query_id").alias(key), F.col("other").alias("neighbour_id"), "rank", "similarity")


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(-1, dim).astype(np.float64) for c in ("body", "theirs"))
                yield pa.record_batch([b.column("id"), b.column("ids"), pa.array(np.round((x * y).sum(1), 6))], ["id", "ids", "similarity"])

    return run

