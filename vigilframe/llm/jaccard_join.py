"""N-gram Jaccard join by parity sketches: every pair of texts whose sets of five-word shingles have a Jaccard of 0.75.

Two sets of sizes a <= b with that Jaccard differ in at most (a + b) / 7 shingles, and b <= 4a / 3. A shingle toggles bits
of a sketch (XOR), so sketches differ in at most as many bits, or blocks of bits, as sets differ in shingles.

1. Classes. Texts with the same set are one class; only classes go on. The same pass counts shingles in a table of fixed
   size (CELLS counters), which only serves to order keys by rarity.
2. Pigeonhole. Sets of sizes within a factor BAND share a band (larger ones that can still match its sets join it too).
   A band's sketch has more blocks than twice the differences that it allows, D; a matching pair agrees in all but D of
   them. If each set offers the values of its D + 1 rarest blocks, rarity being one fixed order of block values, the
   rarest value on which a pair agrees is offered by both. So frequent passages, which many texts share, are offered
   last, and no link is lost. D follows from each set's own size. Values meet in packed arrays, hash-partitioned.
3. Few texts on one value (BIG at most) become pairs at once; they are filtered by the Hamming distance of 512-bit parity
   sketches and verified on their sets. Values with more texts become stars, whose connected groups are verified block
   against block: a block pair sends back each text's number of links and a spanning forest of its links, never the pairs.
4. Components of the verified links, labelled with the smallest doc_id.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own component. A text of
fewer than five words is one shingle. Copies and repeated rows link with each other (Jaccard 1) and are counted in
n_links. Rows with a null doc_id are returned with their size, a null component and null n_links, and link with nothing.
Extra columns are never read. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.components import components
from vigilframe.llm.textcore import blobs, dealt, mix, shingle_sets
from vigilframe.llm.util import materialize, shuffle_partitions

BAND = 4
CELL_BITS = 20
CELLS = 1 << CELL_BITS
SLICE = 1 << 14
SALTS = 256
BIG = 48
BLOCK = 192
SKETCH = 8
KEYS_PER_FLUSH = 1_500_000
KEYS_PER_PARTITION = 1_000_000
_U = np.uint64
_LOW = _U(0xFFFFFFFF)


def _class_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(mix(np.array([np.sum(mix(grams, 7)) + _U(len(grams))], np.uint64), 8).view(np.int64)[0])


def _sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCH longs; each shingle toggles one bit."""
    bits = np.bincount((mix(grams, 9) >> _U(64 - 9)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bands(n: int) -> list[tuple[int, int]]:
    """(band, differences allowed) for each band that a set of n shingles joins. A pair meets in the smaller set's band."""
    k = 0
    while BAND ** (k + 1) <= n:
        k += 1
    out = [(k, (n + 4 * n // 3) // 7)]
    below = BAND**k - 1
    if k and n <= 4 * below // 3:
        out.append((k - 1, (n + below) // 7))
    return out


def block_keys(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The 48-bit keys that a set offers, over all its bands."""
    out = []
    rarity = counts[(grams >> _U(64 - CELL_BITS)).astype(np.int64)]
    for band, allowed in bands(len(grams)):
        blocks = 2 * (BAND ** (band + 1) // 3 + 1) + 2
        where = ((mix(grams, 100 + band) >> _U(32)) * _U(blocks)) >> _U(32)
        order = np.argsort(where, kind="stable")
        where = where[order]
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        parity = np.bitwise_xor.reduceat(mix(grams[order], 11), first)
        keys = mix(parity ^ mix(where[first], 200 + band), 12) >> _U(16)
        if len(keys) > allowed:
            rare = (np.minimum.reduceat(rarity[order], first).astype(np.uint64) << _U(32)) | (keys & _LOW)
            keys = keys[np.argsort(rare, kind="stable")[: allowed + 1]]
        else:
            # All it has, and one key that stands for agreeing in an empty block.
            keys = np.append(keys, mix(np.array([band], np.uint64), 13) >> _U(16))
        out.append(keys)
    return np.concatenate(out)


_DOCS = "doc_id long, n long, cls long, " + ", ".join(f"k{i} long" for i in range(SKETCH)) + ", slice int, counts binary"


def _measure(batches):
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sketch = np.zeros((batch.num_rows, SKETCH), np.int64)
        for row, grams in shingle_sets(batch.column(1)):
            if len(grams):
                n[row], cls[row], sketch[row] = len(grams), _class_of(grams), _sketch(grams)
                counts[(grams >> _U(64 - CELL_BITS)).astype(np.int64)] += 1  # cells hit twice by one text count once
        columns = [batch.column(0).cast(pa.int64()), pa.array(n), pa.array(cls), *map(pa.array, sketch.T.copy())]
        columns += [pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "cls", *(f"k{i}" for i in range(SKETCH)), "slice", "counts"])
    if counts.any():
        packed = counts.reshape(-1, SLICE)
        empty = [pa.nulls(len(packed), pa.int64())] * (3 + SKETCH)
        yield pa.RecordBatch.from_arrays(
            [*empty, pa.array(range(len(packed)), pa.int32()), pa.array([_shut(x) for x in packed], pa.binary())],
            ["doc_id", "n", "cls", *(f"k{i}" for i in range(SKETCH)), "slice", "counts"],
        )


def _shut(counts: np.ndarray) -> bytes:
    """Counters of a slice as bytes: places and counts of the few that aren't zero, or all of them."""
    at = np.flatnonzero(counts)
    return counts.astype(np.uint32).tobytes() if len(at) * 6 >= SLICE * 4 else at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()


def _opened(blob) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places and counts."""
    raw = bytes(blob)
    n = len(raw) // 6
    return (slice(None), np.frombuffer(raw, np.uint32)) if len(raw) == SLICE * 4 else (np.frombuffer(raw[: 2 * n], np.uint16), np.frombuffer(raw[2 * n :], np.uint32))


def _add_slices(batches):
    """Per task, one sum for each slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums.setdefault(s, np.zeros(SLICE, np.uint64))
            at, counts = _opened(x.as_buffer())
            sums[s][at] += counts
    for s, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_shut(np.minimum(x, 2**32 - 1))], pa.binary())], ["slice", "counts"])


def _frequencies(measured: DataFrame) -> np.ndarray:
    """The table of counters: CELLS numbers, whatever the input."""
    rows = measured.filter("slice IS NOT NULL").select("slice", "counts")
    # First within each task and by salted slice, so that no task has a row from every task of a large input.
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(shuffle_partitions(measured.sparkSession), "slice", "salt")
    rows = rows.select("slice", "counts").mapInArrow(_add_slices, "slice int, counts binary")
    rows = rows.repartition(CELLS // SLICE, "slice").mapInArrow(_add_slices, "slice int, counts binary").collect()
    out = np.zeros(CELLS, np.uint32)
    for s, x in rows:
        at, counts = _opened(x)
        out[s * SLICE : (s + 1) * SLICE][at] = counts
    return out


_KEYS = ("p", "high", "low", "who", "names", "sizes", "hot", "spokes")


def _packed(parts: int, counts):
    """Key arrays of many texts, one row for each partition that they go to; the keys of more than BIG texts, hot, and
    pairs of the first of these texts with the others, spokes."""

    def flush(keys, ids, names, sizes):
        frame = pd.DataFrame({"k": np.concatenate(keys), "i": np.concatenate(ids)})
        names, first, same = np.unique(np.array(names, np.int64), return_index=True, return_inverse=True)
        sizes = np.array(sizes, np.int64)[first]
        frame["i"] = same[frame["i"].to_numpy()]
        frame = frame.drop_duplicates()
        k, i = frame["k"].to_numpy(), frame["i"].to_numpy()
        # A key of more than BIG texts is a star already; only its first text goes on, marked as one of many.
        order = np.lexsort((i, k))
        k, i = k[order], i[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        length = np.diff(np.append(start, len(k)))
        many, lead = np.repeat(length > BIG, length), np.repeat(start, length)
        rest = many & (lead < np.arange(len(k)))
        spoke = k[rest], np.stack([names[i[lead[rest]]], names[i[rest]]], 1)
        hot, k, i = many[~rest], k[~rest], i[~rest]

        def part(key):
            return (((key & _LOW) * _U(parts)) >> _U(32)).astype(np.int64)

        order, occupied, cuts, mine, who, who_cuts = dealt(part(k), i)
        k, hot = k[order], hot[order]
        # Every spoke's key has its first text here, so its part occurs.
        by = np.argsort(part(spoke[0]), kind="stable")
        spoke_cuts = np.append(np.searchsorted(part(spoke[0])[by], occupied), len(by))
        hot_cuts = np.concatenate([[0], np.cumsum(hot)])[cuts]
        columns = [blobs((k >> _U(32)).astype(np.uint16), cuts), blobs(k.astype(np.uint32), cuts), blobs(mine, cuts), blobs(names[who], who_cuts), blobs(sizes[who].astype(np.uint32), who_cuts)]
        return pa.RecordBatch.from_arrays([pa.array(occupied, pa.int32()), *columns, blobs(k[hot], hot_cuts), blobs(spoke[1][by], spoke_cuts)], _KEYS)

    def run(batches):
        keys, ids, names, sizes, have, seen = [], [], [], [], 0, set()
        for batch in batches:
            for _, grams in shingle_sets(batch.column(0)):
                if not len(grams) or (name := _class_of(grams)) in seen:
                    continue
                seen.add(name)
                offered = block_keys(grams, counts.value)
                keys.append(offered)
                ids.append(np.full(len(offered), len(names), np.int64))
                names.append(name)
                sizes.append(len(grams))
                have += len(offered)
                if have >= KEYS_PER_FLUSH:
                    yield flush(keys, ids, names, sizes)
                    keys, ids, names, sizes, have, seen = [], [], [], [], 0, set()
        if have:
            yield flush(keys, ids, names, sizes)

    return run


_PAIRS = "a long, b long, big boolean"


def _meet(part):
    """Pairs of classes that share a key; stars where more than BIG do."""
    keys, names, sizes = [], [], []
    for high, low, who, name, size in zip(*(part[c].to_pylist() for c in ("high", "low", "who", "names", "sizes"))):
        name = np.frombuffer(name, np.int64)
        low = np.frombuffer(low, np.uint32)
        who = np.frombuffer(who, np.uint16 if len(who) == 2 * len(low) else np.uint32)
        keys.append((np.frombuffer(high, np.uint16).astype(np.uint64) << _U(32)) | low)
        names.append(name[who])
        sizes.append(np.frombuffer(size, np.uint32)[who])
    keys, names, sizes = (np.concatenate(x) for x in (keys, names, sizes))
    order = np.argsort(keys, kind="stable")
    keys, names, sizes = keys[order], names[order], sizes[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    length = np.diff(np.append(start, len(keys)))
    found = []
    hot = np.isin(keys[start], np.frombuffer(b"".join(part["hot"].to_pylist()), np.uint64))
    few = (length > 1) & (length <= BIG) & ~hot
    for m in np.unique(length[few]).tolist():
        at = start[few & (length == m)]
        x, y = np.triu_indices(m, 1)
        for lo in range(0, len(at), step := max(1, 400_000 // len(x))):
            base = at[lo : lo + step, None]
            a, b = names[base + x].ravel(), names[base + y].ravel()
            na, nb = sizes[base + x].ravel(), sizes[base + y].ravel()
            ok = (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (a != b)
            found.append(pd.DataFrame({"a": np.minimum(a, b)[ok], "b": np.maximum(a, b)[ok], "big": False}).drop_duplicates())
    spokes = np.frombuffer(b"".join(part["spokes"].to_pylist()), np.int64).reshape(-1, 2)
    if len(spokes):
        found.append(pd.DataFrame({"a": spokes.min(1), "b": spokes.max(1), "big": True}).drop_duplicates())
    for s, m in zip(start[(length > 1) & ~few].tolist(), length[(length > 1) & ~few].tolist()):
        who = np.unique(names[s : s + m])
        if len(who) > 1:
            found.append(pd.DataFrame({"a": who[0], "b": who[1:], "big": True}))
    out = pd.concat(found).drop_duplicates() if found else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "big": np.zeros(0, bool)})
    return pa.Table.from_pandas(out, preserve_index=False)


def _sets(batches):
    """cls and set of each text that stands for its class."""
    for batch in batches:
        out = [(row, grams.tobytes()) for row, grams in shingle_sets(batch.column(3)) if len(grams) and _class_of(grams) == batch.column(0)[row].as_py()]
        rows = pa.array([r for r, _ in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array([x for _, x in out], pa.binary())], ["cls", "rep", "copies", "grams"])


def similar(inter, na, nb):
    return 100 * inter >= 75 * (na + nb - inter)


def _verify(batches):
    for batch in batches:
        good = []
        for row, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            inter = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
            good.append(similar(inter, len(x), len(y)))
        out = batch.filter(pa.array(good, pa.bool_()))
        yield out.select(["a", "b", "rep_a", "rep_b", "copies_a", "copies_b"])


_LINKS = "cls long, links long, u long, v long"


def _blocks(key, part):
    """Links between the sets of two blocks of one group (or within one): each set's number, and a spanning forest."""
    frame = part.select(["cls", "rep", "copies", "block"]).to_pandas()
    grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in part["grams"]]
    keep = frame.drop_duplicates("cls").index
    frame, grams = frame.loc[keep].reset_index(drop=True), [grams[i] for i in keep]
    m, n = len(grams), np.array([len(x) for x in grams])
    values, code, many = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), n)
    dense = np.cumsum(many > 1) - 1
    shared = many[code] > 1
    who, code = who[shared], dense[code[shared]]
    order = np.argsort(code, kind="stable")
    who, code = who[order], code[order]
    inter = np.zeros((m, m), np.float64)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[who[a:b], code[a:b] - lo] = 1
        inter += x @ x.T
    linked = similar(inter, n[:, None], n[None, :]) & ~np.eye(m, dtype=bool)
    if key[1].as_py() != key[2].as_py():
        side = frame["block"].to_numpy()
        linked &= side[:, None] != side[None, :]
    links = linked @ frame["copies"].to_numpy()
    todo, edges = set(np.flatnonzero(linked.any(1)).tolist()), []
    while todo:
        front = [todo.pop()]
        while front:
            i = front.pop()
            new = todo.intersection(np.flatnonzero(linked[i]).tolist())
            edges += [(i, j) for j in new]
            todo -= new
            front += new
    rep = frame["rep"].to_numpy()
    u, v = (rep[[e[s] for e in edges]] if edges else np.zeros(0, np.int64) for s in (0, 1))
    some = np.flatnonzero(links)
    none = pa.nulls(len(u), pa.int64()), pa.nulls(len(some), pa.int64())
    return pa.table(
        [pa.chunked_array([pa.array(frame["cls"].to_numpy()[some]), none[0]]), pa.chunked_array([pa.array(links[some].astype(np.int64)), none[0]]), pa.chunked_array([none[1], pa.array(u)]), pa.chunked_array([none[1], pa.array(v)])],
        ["cls", "links", "u", "v"],
    )


def jaccard_join(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other documents that it links with) and n_copies (documents with the
    same set, itself included) for each row of df(doc_id, text)."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = materialize(docs.mapInArrow(_measure, _DOCS), "jaccard-docs")
    rows = measured.filter("slice IS NULL")
    sketch = [f"k{i}" for i in range(SKETCH)]
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in sketch])
    classes = materialize(classes, "jaccard-classes")
    offered = (classes.agg(F.sum("n")).first()[0] or 0) * 2 // 5
    parts = max(shuffle_partitions(spark), -(-offered // KEYS_PER_PARTITION))
    counts = spark.sparkContext.broadcast(_frequencies(measured))

    keys = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(_packed(parts, counts), ", ".join(f"{c} {'binary' if k else 'int'}" for k, c in enumerate(_KEYS)))
    met = materialize(keys.groupBy("p").applyInArrow(_meet, _PAIRS), "jaccard-met").groupBy("a", "b").agg(F.max("big").alias("big"))
    met = materialize(met, "jaccard-pairs")
    groups = components(met.filter("big").select(F.col("a").alias("u"), F.col("b").alias("v")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    known = materialize(classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left"), "jaccard-groups")

    def side(s):
        return known.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "copies", "n", "root", *sketch)])

    pairs = met.filter("NOT big").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    apart = ~F.coalesce(F.col("root_a") == F.col("root_b"), F.lit(False))
    distance = sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in sketch[1:]), F.bit_count(F.col("k0_a").bitwiseXOR(F.col("k0_b"))))
    pairs = pairs.filter(apart & (7 * distance <= F.col("n_a") + F.col("n_b")))
    pairs = materialize(pairs.select("a", "b", "rep_a", "rep_b", "copies_a", "copies_b"), "jaccard-close")
    needed = pairs.select(F.col("a").alias("cls"), F.col("rep_a").alias("rep"), F.col("copies_a").alias("copies")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("rep_b").alias("rep"), F.col("copies_b").alias("copies")))
    needed = needed.unionByName(known.filter("root IS NOT NULL").select("cls", "rep", "copies")).distinct()
    sets = needed.join(docs, F.col("rep") == F.col("doc_id")).select("cls", "rep", "copies", "text")
    sets = materialize(sets.mapInArrow(_sets, "cls long, rep long, copies long, grams binary"), "jaccard-sets")

    x = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    checked = pairs.join(x, "a").join(y, "b").select("a", "b", "rep_a", "rep_b", "copies_a", "copies_b", "x", "y")
    checked = checked.mapInArrow(_verify, "a long, b long, rep_a long, rep_b long, copies_a long, copies_b long").distinct()
    checked = materialize(checked, "jaccard-links")

    grouped = sets.join(known.filter("root IS NOT NULL").select("cls", "root"), "cls")
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    sizes = known.filter("root IS NOT NULL").groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    grouped = grouped.join(sizes, "root").withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    grouped = grouped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = grouped.select("root", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "rep", "copies", "grams")
    dense = materialize(grouped.groupBy("root", "lo", "hi").applyInArrow(_blocks, _LINKS), "jaccard-dense")

    edges = checked.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(dense.filter("u IS NOT NULL").select("u", "v"))
    roots = components(edges)
    links = checked.select(F.col("a").alias("cls"), F.col("copies_b").alias("links")).unionByName(checked.select(F.col("b").alias("cls"), F.col("copies_a").alias("links")))
    links = links.unionByName(dense.filter("cls IS NOT NULL").select("cls", "links")).groupBy("cls").agg(F.sum("links").alias("links"))
    final = classes.select("cls", "rep", "copies").join(links, "cls", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    final = final.select("cls", "copies", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cls")).alias("cls")).join(final, "cls", "left")
    lone = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"),
        F.when(lone, F.coalesce("links", F.lit(0))).alias("n_links"), F.when(lone, F.coalesce("copies", F.lit(1))).alias("n_copies"),
    )


def one_of_each(df: DataFrame) -> DataFrame:
    """The rows of df that stay when one document of each component does: the one with the smallest doc_id. Of repeated
    rows with that doc_id one stays; rows with a null doc_id stay."""
    p = "__jaccard_"
    stay = jaccard_join(df).filter("doc_id = component_id").select(F.col("doc_id").alias(p + "id")).distinct()
    with_id = df.filter("doc_id IS NOT NULL").join(stay, F.col("doc_id") == F.col(p + "id"), "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(df.filter("doc_id IS NULL"))
