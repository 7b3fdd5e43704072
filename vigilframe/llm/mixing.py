"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words by weight; a target stops at
three times its source's size and the excess is shared again, which is water-filling and has a closed form over the
sources ordered by cap / weight. Within a source every document wants r = target / source size copies, r <= 3: each takes
floor(r) copies, and the cube method decides which take one more. The flight phase moves the fractional inclusion
probabilities of three documents at a time along the one direction that changes neither the expected number of documents
nor the expected number of words, until one of them is 0 or 1. It runs in blocks of about BLOCK documents of one source;
each block leaves at most two undecided. These fly again in blocks, level after level, until what a source has left is one
block. RESERVE documents of spread sizes wait out the flights; the landing, one block for each source, decides them and the
last two by the smallest error. A block has three documents
in flight at any time, and random numbers are seeded by source rank and block: reruns agree.

Defined results: null texts, and texts without words, have size 0 and take 0 words; a source whose size is 0 has target 0;
null sources form one source, the last; repeated rows are decided one by one; a source of a single document gets the whole
number of copies nearest its target. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.llm.util import materialize, n_words, shuffle_partitions

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 2048
EPS = 1e-9
#: Documents of each source that are held for the landing, and what an error of one document of mean size counts there
#: against an error of as many words.
RESERVE = 14
DOCS_WEIGHT = 0.02
_FIELDS = "doc_id long, tag long, size long, source_size long, target double, rank long, copies int, share double, block long, blocks long, held boolean"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def _running(df: DataFrame, order: tuple, sums: tuple[str, ...] = ()) -> DataFrame:
    """df with nth (from 1) and, for each column of sums, its total over the rows before, as before_<column>, in the given
    order. Ranges of the order are numbered on their own; only one row for each partition comes to the driver."""
    spark = df.sparkSession

    def number(batches):
        part, n, so_far = TaskContext.get().partitionId(), 0, dict.fromkeys(sums, 0.0)
        for batch in batches:
            batch = batch.append_column("__part", pa.array(np.full(batch.num_rows, part, np.int64)))
            batch = batch.append_column("nth", pa.array(np.arange(n + 1, n + 1 + batch.num_rows)))
            n += batch.num_rows
            for c in sums:
                total = so_far[c] + np.cumsum(batch.column(c).to_numpy())
                batch = batch.append_column(f"before_{c}", pa.array(total - batch.column(c).to_numpy()))
                so_far[c] = float(total[-1]) if len(total) else so_far[c]
            yield batch

    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__part", "nth")), *(T.StructField(f"before_{c}", T.DoubleType()) for c in sums)])
    out = materialize(df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, schema), "mix-running")
    before, rows = np.zeros(1 + len(sums)), []
    for r in sorted(out.groupBy("__part").agg(F.count(F.lit(1)), *[F.sum(c) for c in sums]).collect()):
        rows.append((r[0], int(before[0]), *map(float, before[1:])))
        before += np.array(r[1:], float)
    parts = spark.createDataFrame(rows, ", ".join(["__p long", "__n long", *(f"__b{k} double" for k in range(len(sums)))]))
    out = out.join(F.broadcast(parts), F.col("__part") == F.col("__p")).withColumn("nth", F.col("nth") + F.col("__n"))
    for k, c in enumerate(sums):
        out = out.withColumn(f"before_{c}", F.col(f"before_{c}") + F.col(f"__b{k}"))
    return out.select(*df.columns, "nth", *[f"before_{c}" for c in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """source, rank, n_docs, source_size and target of each source in sizes(source, size). Sources are ordered, by name and
    by where their cap is reached, in ranges, so that hosts or users may be the sources as well."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")).withColumn("unnamed", F.col("source").isNull())
    per = _running(per, ("unnamed", "source")).drop("unnamed").withColumnRenamed("nth", "rank")
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int")).cast("double"))
    per = per.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    per = _running(per, ("level", "rank"), ("cap", "weight"))
    every = per.agg(F.sum("source_size"), F.sum("weight")).first()
    size, weight = float(every[0] or 0), float(every[1] or 0)
    # The water's height if all sources before are full and all others share the rest; the first that holds is it.
    height = (F.lit(size) - F.col("before_cap")) / (F.lit(weight) - F.col("before_weight"))
    first = per.withColumn("water", height).filter("water <= level").agg(F.min(F.struct("level", "rank", "water"))).first()[0]
    water = F.lit(None if first is None else first["water"]).cast("double")
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.coalesce(water * F.col("weight"), F.col("cap"))))
    return per.select("source", "rank", "n_docs", "source_size", target.alias("target"))


def _flight(sizes: np.ndarray, share: np.ndarray, seed: list[int]) -> np.ndarray:
    """Shares after the flight, in the order given: all but at most two are 0 or 1. Sums of shares and of sizes * shares
    stay as they were."""
    rng, share, active = np.random.default_rng(seed), share.tolist(), []
    dice, used = rng.random(len(share) + 8), 0
    sizes = sizes.tolist()
    for k, p in enumerate(share):
        if p <= EPS or p >= 1 - EPS:
            share[k] = 0.0 if p <= EPS else 1.0
            continue
        active.append(k)
        if len(active) < 3:
            continue
        a, b, c = active
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - share[i]) / x if x > 0 else share[i] / -x for i, x in zip(active, u) if x)
        down = min(share[i] / x if x > 0 else (1 - share[i]) / -x for i, x in zip(active, u) if x)
        step = up if dice[used] * (up + down) < down else -down
        used += 1
        left = []
        for i, x in zip(active, u):
            share[i] += step * x
            if share[i] <= EPS:
                share[i] = 0.0
            elif share[i] >= 1 - EPS:
                share[i] = 1.0
            else:
                left.append(i)
        active = left
    return np.array(share)


def _held(share: np.ndarray) -> np.ndarray:
    """Positions of the undecided documents, RESERVE at most and of evenly spread sizes, that wait for the landing."""
    open_ = np.flatnonzero((share > EPS) & (share < 1 - EPS))
    return open_ if len(open_) <= RESERVE else open_[(np.arange(RESERVE) * (len(open_) - 1)) // (RESERVE - 1)]


def _land(sizes: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Decide all that is left, RESERVE + 2 documents at most, by the least error in words and, lightly, in documents."""
    left = np.flatnonzero((share > 0) & (share < 1))
    words, docs = np.array([-float(sizes[left] @ share[left])]), np.array([-float(share[left].sum())])
    for i in left:
        words, docs = np.concatenate([words, words + sizes[i]]), np.concatenate([docs, docs + 1])
    best = int(np.argmin(np.abs(words) + DOCS_WEIGHT * max(1.0, float(sizes.mean())) * np.abs(docs)))
    share[left] = best >> np.arange(len(left)) & 1
    return share


def _decide(part: pa.Table, seed: int, level: int, block: int, last: bool) -> pa.Table:
    size, ids, tag = (part[c].fill_null(-1).to_numpy() for c in ("size", "doc_id", "tag"))
    part = part.take(pa.array(np.lexsort((tag, ids, -size))))
    sizes, rank = part["size"].to_numpy(), part["rank"][0].as_py()
    share = part["share"].to_numpy().copy()
    held = np.flatnonzero(part["held"].to_numpy())
    if last or (level == 0 and block == 0):
        held = _held(share)
    flown = np.setdiff1d(np.arange(len(share)), held)
    share[flown] = _flight(sizes[flown], share[flown], [seed, level, rank, block])
    if last:
        share = _land(sizes, share)
    whole = (share == 0) | (share == 1)
    copies = part["copies"].to_numpy() + np.where(whole, share, 0).astype(np.int32)
    waits = np.zeros(len(share), bool)
    waits[held] = True
    new = {"copies": pa.array(copies, pa.int32()), "share": pa.array(np.where(whole, np.nan, share), mask=whole), "held": pa.array(waits)}
    return pa.table([new.get(c, part[c]) for c in _NAMES], _NAMES)


def mix(df: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """One row for each row of df(doc_id, text, source): doc_id, size, source_size, target, taken, copies, and tag (a
    hash of text and source that, with doc_id, tells which rows are the same)."""
    docs = df.select("doc_id", F.xxhash64("text", "source").alias("tag"), n_words(F.col("text")).alias("size"), "source")
    docs = materialize(docs, "mix-sizes")
    t = targets(docs, weights, most).withColumnRenamed("source", "__mix_source")
    ratio = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(most)), F.col("target") / F.col("source_size")))
    # Whether the source table is broadcast is left to its measured size at run time.
    docs = docs.join(t, F.col("source").eqNullSafe(F.col("__mix_source"))).withColumn("ratio", ratio)
    whole = F.floor(F.col("ratio") + EPS)
    docs = docs.withColumn("blocks", F.ceil(F.col("n_docs") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("doc_id", "tag"), F.col("blocks")))
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "tag", "size", "source_size", "target", "rank", whole.cast("int").alias("copies"),
        F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("share"), "block", "blocks", F.lit(False).alias("held"),
    )

    def flight(rows, level, last=False):
        return rows.groupBy("rank", "block").applyInArrow(lambda key, part: _decide(part, seed, level, key[1].as_py(), last), _FIELDS)

    flown = materialize(flight(docs, 0), "mix-flight")
    n_blocks, level, done = flown.agg(F.max("blocks")).first()[0] or 1, 1, [flown.filter("share IS NULL")]
    fewer = F.ceil(F.col("blocks") / (BLOCK // 2))
    while n_blocks > BLOCK // 2:
        left = flown.filter("share IS NOT NULL").withColumn("block", F.pmod("block", fewer)).withColumn("blocks", fewer)
        flown = materialize(flight(left, level), "mix-flight")
        done.append(flown.filter("share IS NULL"))
        n_blocks, level = -(-n_blocks // (BLOCK // 2)), level + 1
    done.append(flight(flown.filter("share IS NOT NULL").withColumn("block", F.lit(0).cast("long")), level, last=True))
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "tag")


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it, with df's own columns."""
    p = "__mix_"
    taken = mix(df, **options).groupBy(F.col("doc_id").alias(p + "id"), F.col("tag").alias(p + "tag")).agg(F.sum("copies").alias(p + "copies"), F.count(F.lit(1)).alias(p + "rows"))
    out = df.withColumn(p + "key", F.xxhash64("text", "source"))
    out = out.join(taken.filter(F.col(p + "copies") > 0), F.col("doc_id").eqNullSafe(F.col(p + "id")) & (F.col(p + "key") == F.col(p + "tag")))
    # Rows that are the same share their copies; the key is that of the join, so nothing is dealt out anew.
    alike = Window.partitionBy(p + "id", p + "tag").orderBy(F.lit(1))
    nth = F.row_number().over(alike)
    n = F.floor(F.col(p + "copies") / F.col(p + "rows")) + F.when(nth <= F.col(p + "copies") % F.col(p + "rows"), 1).otherwise(0)
    out = out.withColumn(p + "n", n.cast("int")).filter(F.col(p + "n") > 0)
    return out.withColumn(p + "each", F.explode(F.sequence(F.lit(1), p + "n"))).select(*df.columns)
