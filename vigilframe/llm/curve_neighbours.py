"""Approximate nearest neighbours (largest inner product) by shifted space-filling curves.

Each of CURVES orderings turns vectors at random, keeps DIMS coordinates, shifts them at random (by up to three cells of a
grid of 2 ** COARSE a side) and cuts them into a grid of 2 ** BITS cells a side; the cell's place on the Hilbert curve, in
words of WORD bits a dimension, is the key. So fine a grid orders near copies too: a cell is 2e-8 of a coordinate's
deviation wide, and a curve orders what is left in one cell by a hash of its own. Spark range-partitions the keys of a curve,
which gives every row its rank; a query is compared with all rows of its block of BLOCK ranks and of the blocks within
REACH of all ranks on either side. What the curves find is merged and ranked by exact inner products in double precision.
The comparison is dealt in groups of neighbouring blocks (more of them together where a window is wide, GROUP_MOST at most);
the queries that meet in a group are cut into parts of about QUERIES, each with its own copy of the group's rows. So a task
holds GROUP_MOST * BLOCK rows and about QUERIES queries at once, whatever the table, and groups without a query are left out.

For inner products, vectors of unequal length get one more coordinate, sqrt(M^2 - |x|^2), M being the largest length, and
queries get 0 there: the nearest then have the largest inner product. The shift and scale of the grid are fitted on the
SAMPLE vectors of least hash; every vector is indexed. Equal vectors are indexed once, with the ids that can be in a
result, so a vector that a third of all rows share neither crowds a block nor hides others.

REACH is a share of the rows because vectors without structure need it: in 64 independent dimensions a window of fixed
size loses recall as rows are added. Clustered embeddings keep the recall with a smaller one.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have another length than the
most frequent one (the smaller, if two are) take no part; so do rows without an id. Repeated rows with one id are one
vector (the least, by components, if they differ). Equal scores rank by the smaller id. Fewer candidates than asked for:
all of them. Extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.util import materialize, shuffle_partitions

CURVES = 16
DIMS = 8
BITS = 28
WORD = 7
COARSE = 6
BLOCK = 512
GROUP_LEAST, GROUP_MOST = 16, 64
QUERIES = 4096
REACH = 0.028
SAMPLE = 4096
TOP = 20
KEYS = tuple(f"key{k}" for k in range(BITS // WORD))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each row of cells (rows, dimensions) on the Hilbert curve, where it fits into 63 bits."""
    return hilbert_words(cells, bits, bits)[0]


def hilbert_words(cells: np.ndarray, bits: int = BITS, word: int = WORD) -> list[np.ndarray]:
    """The place of each row of cells (rows, dimensions) on the Hilbert curve, by Skilling's transform: numbers of word bits
    of each dimension, the highest first."""
    x = cells.astype(np.int64).T.copy()
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    words = []
    for top in range(bits, 0, -word):
        out = np.zeros(x.shape[1], np.int64)
        for b in range(top - 1, max(top - word, 0) - 1, -1):
            for i in range(n):
                out = (out << 1) | ((x[i] >> b) & 1)
        words.append(out)
    return words


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def curves(dim: int, seed: int, sample: np.ndarray, longest: float, n: int = CURVES):
    """For each curve: the turn, the middle, the width of a cell."""
    rng, lifted, out = np.random.default_rng(seed), lift(sample, longest), []
    for _ in range(n):
        turn = np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :DIMS]
        at = lifted @ turn
        spread = np.maximum(at.std(0), 1e-12) * 5.0
        shift = rng.random(turn.shape[1]) * 6 - 3
        out.append((turn, at.mean(0) + shift * spread / (1 << COARSE), spread / (1 << BITS)))
    return out


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))[:, None]])


def _keys(shapes, longest):
    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"))
            if not len(x):
                continue
            role = batch.column("is_query").to_numpy(zero_copy_only=False)
            y = lift(x, longest)
            y[role, -1] = 0.0
            for c, (turn, middle, wide) in enumerate(shapes):
                cell = np.clip(np.floor((y @ turn - middle) / wide) + (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), *[pa.array(w) for w in hilbert_words(cell)], batch.column("is_query"), batch.column("id")], ["curve", *KEYS, "is_query", "id"])

    return run


def _number(batches):
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield batch.append_column("part", pa.array(np.full(batch.num_rows, part, np.int32))).append_column("at", pa.array(at))


def _best(top: int, reach: int):
    def run(part):
        role = part["is_query"].to_numpy(zero_copy_only=False)
        ids, block = part["id"].to_numpy(), part["block"].to_numpy()
        q, d = np.flatnonzero(role), np.flatnonzero(~role)
        out: list = [[], [], []]
        if len(q) and len(d):
            x = _matrix(part["v"])
            d = d[np.argsort(block[d], kind="stable")]
            at_once = max(16, (1 << 21) // len(d))
            for lo in range(0, len(q), at_once):
                mine = q[lo : lo + at_once]
                near = np.abs(block[mine][:, None] - block[d][None, :]) <= reach
                score = np.where(near, x[mine] @ x[d].T, -np.inf)
                k = min(top, len(d)) - 1
                least = -np.partition(-score, k, axis=1)[:, k]
                least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)
                for row, bound in enumerate(least):
                    some = d[np.flatnonzero(near[row] & (score[row] >= bound))]
                    exact = (x[some] * x[mine[row]]).sum(1)
                    first = np.lexsort((ids[some], -exact))[:top]
                    out[0].append(np.full(len(first), ids[mine[row]]))
                    out[1].append(ids[some][first])
                    out[2].append(exact[first])
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table([pa.array(c) for c in cols], ["q", "c", "score"])

    return run


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v of the rows that take part, one for each id."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(v, lambda x: x != 0)
    out = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    common = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.filter(F.size("v") == (common[0] if common else 0)).groupBy("id").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, is_query, top: int = TOP, reach: float = REACH, n_curves: int = CURVES, seed: int = 5, **names) -> DataFrame:
    """query_id, rank, vec_id, score for each row of df(vec_id, embedding) for which the Column is_query (over id) holds,
    against all other rows."""
    spark = df.sparkSession
    rows = materialize(usable(df, **names).withColumn("h", F.xxhash64("v")), "curve-rows")
    # Equal vectors: the first top + 1 ids are all that a result can need.
    alike = Window.partitionBy("h", "v").orderBy("id")
    members = rows.select("id", "h", "v", F.row_number().over(alike).alias("nth")).filter(F.col("nth") <= top + 1)
    members = materialize(members, "curve-members")
    index = members.filter("nth = 1").select("id", "h", "v")
    # Queries are searched once for each distinct vector, under the id that the index has for it.
    asked = rows.filter(is_query).select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("v").alias("qv"))
    asked = asked.join(index, (F.col("qh") == F.col("h")) & (F.col("qv") == F.col("v"))).select("query_id", F.col("id").alias("q"))
    asked = materialize(asked, "curve-asked")
    queries = index.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi")
    both = index.select("id", "v", F.lit(False).alias("is_query")).unionByName(queries.select("id", "v", F.lit(True).alias("is_query")))
    both = materialize(both, "curve-both")
    known = both.filter("NOT is_query").agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    sample = np.array([r[0] for r in index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()])
    if not len(sample):
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("q").alias("vec_id"), F.lit(0.0).alias("score"))
    shapes = curves(sample.shape[1], seed, sample, known[1], n_curves)
    keys = materialize(both.mapInArrow(_keys(shapes, known[1]), f"curve int, {', '.join(f'{k} long' for k in KEYS)}, is_query boolean, id long"), "curve-keys")
    # Ties of a curve in an order of its own, so that no two curves show a query the same ones.
    order = ("curve", *KEYS, F.xxhash64("curve", "id"), "id")
    ordered = keys.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "is_query").select("curve", "is_query", "id")
    ordered = materialize(ordered.mapInArrow(_number, "curve int, is_query boolean, id long, part int, at long"), "curve-order")
    # One number for each partition.
    before, total = {}, 0
    for p, n in sorted(ordered.groupBy("part").count().collect()):
        before[p], total = total, total + n
    offsets = spark.createDataFrame(list(before.items()), "part int, before long")
    block = F.floor((F.col("before") + F.col("at")) / BLOCK)
    around = -(-int(np.ceil(reach * known[0])) // BLOCK)
    placed = ordered.join(F.broadcast(offsets), "part").select("curve", "is_query", "id", block.alias("block"))
    wide = min(GROUP_MOST, max(GROUP_LEAST, around))
    group = lambda b: F.floor(b / wide)
    asks = placed.filter("is_query").withColumn("part", F.explode(F.sequence(group(F.col("block") - around), group(F.col("block") + around))))
    # Queries of each group and the parts that they are cut into: one row for each group.
    cuts = asks.groupBy("curve", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("cuts"))
    cuts = materialize(cuts, "curve-groups")
    asks = asks.join(cuts, ["curve", "part"]).withColumn("cut", F.pmod(F.xxhash64("id", "curve"), F.col("cuts")).cast("int"))
    rows_of = placed.filter("NOT is_query").withColumn("part", group(F.col("block"))).join(cuts, ["curve", "part"])
    rows_of = rows_of.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    columns = ("curve", "part", "cut", "is_query", "id", "block")
    meeting = asks.select(*columns).unionByName(rows_of.select(*columns)).join(both, ["id", "is_query"])
    found = meeting.groupBy("curve", "part", "cut").applyInArrow(_best(top + 1, around), "q long, c long, score double")
    # One exchange by query serves the distinct rows and their ranks.
    found = found.repartition(shuffle_partitions(spark), "q").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))).filter(F.col("nth") <= top + 1)
    # Back from distinct vectors to rows.
    of = members.select("id", "h", "v")
    first = index.select(F.col("id").alias("c"), "h", "v")
    ids = of.join(first, ["h", "v"]).select("c", F.col("id").alias("vec_id"))
    out = asked.join(found.select("q", "c", "score"), "q").join(ids, "c").filter("vec_id <> query_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return out.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
