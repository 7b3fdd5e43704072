"""Near-duplicate pairs by a prefix filter over hashed word n-grams: what plan j4_word_gram_duplicates says, without a row
for each gram.

1. Sets. A text's set is that of its word n-grams, as 64-bit hashes. Texts with equal sets are one class; only classes go
   on. The same pass counts grams in a table of fixed size (CELLS counters), which only serves to order grams by rarity.
2. Prefix filter. Sets with a Jaccard of 0.8 share one of the n // 5 + 1 rarest grams of each, rarity being one fixed order
   of all grams. Only these grams are exchanged.
3. Few classes on one gram (BIG at most) become pairs at once, filtered by the Hamming distance of parity sketches, whose
   length follows the set's: a pair differs in at most (a + b) / 9 grams. Grams with more classes become stars. No gram is
   dropped.
4. Groups that these pairs and stars connect are compared set against set, larger groups in blocks and only where sizes can
   match; a text is sent once to each block pair that it is in.
5. Similar classes, and each class with itself, are expanded into pairs of texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.graph import labels
from vigilframe.plans.shared import cut

PIECE = 1 << 20
CELL_BITS = 21
SLICE = 1 << 15
SALTS = 256
BIG = 48
BLOCK = 192
COPIES = 64
KEYS_PER_FLUSH = 1_500_000
KEYS_PER_PARTITION = 1_500_000
ID_BITS = 24
_U = np.uint64

_rng = np.random.default_rng(20261127)
_LETTER = np.zeros(256, np.uint64)
_LETTER[97:123] = _rng.integers(1, 2**63, 26, dtype=np.uint64) * _U(2) + _U(1)
_ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, those of a piece kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE:
            _POWERS[base] = have
    return have[:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of a-z, and the first word's index for each text (one more than texts)."""
    inside = (data >= 97) & (data <= 122)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    sums = np.add.reduceat(_LETTER[data] * _powers(len(data), _P), starts)
    return _mix(sums * _powers(len(data), _P_INV)[starts]), np.searchsorted(starts, offsets)


def gram_sets(column: pa.Array, n: int):
    """The sorted distinct hashes of the word n-grams of each row, a list of lower-case texts. No gram spans two texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.flatten().cast(pa.large_binary())
    lists = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    if len(texts):
        _, offsets, raw = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
    else:
        data, offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends, i = offsets[lists], 0
    while i < len(column):
        # Whole rows of about a megabyte; a longer row is alone.
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        a, b = lists[i], lists[j]
        words, first = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        grams = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            grams += words[k : k + len(grams)] * _ORDER[k]
        grams = _mix(grams, n)
        for row in range(i, j):
            own = [grams[first[t - a] : max(first[t - a], first[t - a + 1] - n + 1)] for t in range(lists[row], lists[row + 1])]
            yield np.unique(own[0] if len(own) == 1 else np.concatenate([*own, grams[:0]]))
        i = j


def _class_of(grams: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(_mix(np.array([np.sum(_mix(grams, 7)) + _U(len(grams))], np.uint64), 8).view(np.int64)[0])


def _sketch(grams: np.ndarray) -> bytes:
    """A bit for each gram at least, a power of two; each gram toggles one bit."""
    width = 1 << max(9, (len(grams) - 1).bit_length())
    bits = np.bincount((_mix(grams, 9) & _U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _distance(x: bytes, y: bytes) -> int:
    """At most the number of grams that only one of two sets has. The longer sketch is folded to the length of the other."""
    x, y = (np.frombuffer(s, np.uint8) for s in ((x, y) if len(x) <= len(y) else (y, x)))
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0) ^ x).sum(dtype=np.int64))


def _similar(inter, na, nb):
    return 10 * inter >= 8 * (na + nb - inter)


_MEASURED = "doc_id long, n long, cls long, sketch binary, slice int, counts binary"


def _measure(n: int):
    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            out = []
            for doc, grams in zip(batch.column(0).to_pylist(), gram_sets(batch.column(1), n)):
                if len(grams):
                    out.append((doc, len(grams), _class_of(grams), _sketch(grams)))
                    counts[(grams >> _U(64 - CELL_BITS)).astype(np.int64)] += 1  # cells hit twice by one text count once
            ids, sizes, names, sketches = zip(*out) if out else ((), (), (), ())
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())], ["doc_id", "n", "cls", "sketch", "slice", "counts"])
        if counts.any():
            packed = counts.reshape(-1, SLICE)
            blobs = pa.array([zlib.compress(x.tobytes(), 1) for x in packed], pa.binary())
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(packed), pa.int64())] * 3, pa.nulls(len(packed), pa.binary()), pa.array(range(len(packed)), pa.int32()), blobs], ["doc_id", "n", "cls", "sketch", "slice", "counts"])

    return run


def _add_slices(batches):
    """Per task, one sum for each slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums.setdefault(s, np.zeros(SLICE, np.uint64))
            sums[s] += np.frombuffer(zlib.decompress(x), np.uint32)
    for s, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())], ["slice", "counts"])


def _frequencies(measured: DataFrame) -> np.ndarray:
    """The table of counters, of one size whatever the input."""
    parts = int(measured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = measured.filter("slice IS NOT NULL").select("slice", "counts")
    # First within each task and by salted slice, so that no task has a row from every task of a large input.
    rows = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).repartition(parts, "slice", "salt")
    rows = rows.select("slice", "counts").mapInArrow(_add_slices, "slice int, counts binary")
    out = np.zeros(1 << CELL_BITS, np.uint32)
    for s, x in rows.repartition((1 << CELL_BITS) // SLICE, "slice").mapInArrow(_add_slices, "slice int, counts binary").collect():
        out[s * SLICE : (s + 1) * SLICE] = np.frombuffer(zlib.decompress(x), np.uint32)
    return out


def prefix(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The grams that a set offers: its rarest, by count and then by hash."""
    m = len(grams) // 5 + 1
    order = np.lexsort((grams, counts[(grams >> _U(64 - CELL_BITS)).astype(np.int64)]))
    return grams[order[:m]]


_KEYS = "key long, cls long, n int, lead long"


def _offered(n: int, counts):
    """A row for each gram that a class offers. Where more than BIG classes of a task offer one, the first goes on, as its
    own lead, and the others are rows that name it as theirs, dealt out by class."""

    def flush(keys, names, sizes):
        who = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        key, names, sizes = np.concatenate(keys).view(np.int64), np.array(names, np.int64), np.array(sizes, np.int32)
        order = np.argsort(key, kind="stable")
        key, who = key[order], who[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        many = np.repeat(length > BIG, length)
        cls, lead = names[who], names[who[np.repeat(start, length)]]
        key = np.where(many & (cls != lead), cls, key)
        # One row is enough for a class and its lead, whatever the number of grams.
        spoke = pd.DataFrame({"c": cls, "l": lead})[many & (cls != lead)].drop_duplicates().index.to_numpy()
        take = np.concatenate([np.flatnonzero(~many | (cls == lead)), spoke])
        yield from pa.Table.from_arrays([pa.array(key[take]), pa.array(cls[take]), pa.array(sizes[who[take]]), pa.array(lead[take], mask=~many[take])], ["key", "cls", "n", "lead"]).to_batches(100_000)

    def run(batches):
        keys, names, sizes, have, seen = [], [], [], 0, set()
        for batch in batches:
            for grams in gram_sets(batch.column(0), n):
                if not len(grams) or (name := _class_of(grams)) in seen:
                    continue
                seen.add(name)
                keys.append(prefix(grams, counts.value))
                names.append(name)
                sizes.append(len(grams))
                have += len(keys[-1])
                if have >= KEYS_PER_FLUSH:
                    yield from flush(keys, names, sizes)
                    keys, names, sizes, have, seen = [], [], [], 0, set()
        if have:
            yield from flush(keys, names, sizes)

    return run


_PAIRS = "a long, b long, star boolean"


def _meet(batches):
    """Pairs of classes that offer the same gram; stars where more than BIG do."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns[:3]] + [batch.column(3).fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch.column(3).is_valid())] for batch in batches if batch.num_rows]
    if not parts:
        return
    key, cls, n, lead, has = (np.concatenate(x) for x in zip(*parts))
    spoke = has & (lead != cls)
    found = [pd.DataFrame({"a": np.minimum(cls, lead)[spoke], "b": np.maximum(cls, lead)[spoke], "star": True})]
    key, cls, n, has = key[~spoke], cls[~spoke], n[~spoke].astype(np.int64), has[~spoke]
    order = np.lexsort((cls, key))
    key, cls, n, has = key[order], cls[order], n[order], has[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    hot = np.maximum.reduceat(has, start) if len(key) else np.zeros(0, bool)
    # Copies in several tasks.
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    cls, n = cls[first], n[first]
    start = np.concatenate([[0], np.cumsum(first)])[start]
    length = np.diff(np.append(start, len(cls)))
    few = (length > 1) & (length <= BIG) & ~hot
    for m in np.unique(length[few]).tolist():
        at = start[few & (length == m)]
        x, y = np.triu_indices(m, 1)
        for lo in range(0, len(at), step := max(1, 400_000 // len(x))):
            base = at[lo : lo + step, None]
            a, b, na, nb = cls[base + x].ravel(), cls[base + y].ravel(), n[base + x].ravel(), n[base + y].ravel()
            ok = 5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)
            found.append(pd.DataFrame({"a": a[ok], "b": b[ok], "star": False}).drop_duplicates())
    for s, m in zip(start[(length > 1) & ~few].tolist(), length[(length > 1) & ~few].tolist()):
        found.append(pd.DataFrame({"a": cls[s], "b": cls[s + 1 : s + m], "star": True}))
    yield from pa.Table.from_pandas(pd.concat(found).drop_duplicates(), preserve_index=False).to_batches(100_000)


def _close(batches):
    """Pairs whose sketches differ in no more bits than similar sets can."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")))
        yield batch.filter(pa.array([9 * _distance(x, y) <= na + nb for na, nb, x, y in rows], pa.bool_())).select(["a", "b"])


def _wanted(bits):
    """The rows whose id is marked, by hash; a few others pass too."""

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7)).astype(np.uint8) & 1).cast(pa.bool_())).select([0, 1])

    return run


def _shared(grams: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets with each other."""
    m = len(grams)
    inter = np.zeros((m, m), np.int64)
    if m <= 12:
        for i in range(m):
            for j in range(i + 1, m):
                at = np.searchsorted(grams[j], grams[i])
                inter[i, j] = inter[j, i] = np.count_nonzero(grams[j][np.minimum(at, len(grams[j]) - 1)] == grams[i])
        return inter
    _, code, many = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    who, dense, kept = np.repeat(np.arange(m), [len(x) for x in grams]), np.cumsum(many > 1) - 1, many[code] > 1
    who, code = who[kept], dense[code[kept]]
    order = np.argsort(code, kind="stable")
    who, code = who[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        x = np.zeros((m, 4096), np.float32)
        x[who[a:b], code[a:b] - lo] = 1
        inter += (x @ x.T).astype(np.int64)
    return inter


def _compare(n: int):
    """Similar classes of each group; the rows of a group follow each other."""

    def pairs(apart, cells, names, sets):
        inter, size = _shared(sets), np.array([len(x) for x in sets])
        ok = _similar(inter, size[:, None], size[None, :]) & np.triu(np.ones(inter.shape, bool), 1)
        if apart:
            # Each cell is compared with itself in a group of its own.
            cells = np.array(cells)
            ok &= cells[:, None] != cells[None, :]
        i, j = np.nonzero(ok)
        names = np.array(names, np.int64)
        both = inter[i, j]
        return pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), pa.array(both / (size[i] + size[j] - both).astype(np.float64))], ["a", "b", "similarity"])

    def run(batches):
        group, cells, names, sets = None, [], [], []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi", "cell", "cls")))
            for (root, lo, hi, cell, name), grams in zip(keys, gram_sets(batch.column(5), n)):
                if (root, lo, hi) != group:
                    if len(sets) > 1:
                        yield pairs(group[1] != group[2], cells, names, sets)
                    group, cells, names, sets = (root, lo, hi), [], [], []
                cells.append(cell)
                names.append(name)
                sets.append(grams)
        if len(sets) > 1:
            yield pairs(group[1] != group[2], cells, names, sets)

    return run


def _marked(ids: DataFrame) -> np.ndarray:
    """2**ID_BITS bits; that of each id's hash is set."""
    at = F.pmod(F.xxhash64("id"), F.lit(1 << ID_BITS))
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((1 << ID_BITS) // 8 + 4096, np.uint8)
    for k, bits in rows:
        # Bucket 0 has the number 0 alone, and position 0 of bucket k the number 32768 (k - 1) + 1.
        lo = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        where = np.flatnonzero(lo) + (32768 * (k - 1) + 1 if k else 0)
        np.bitwise_or.at(out, where >> 3, (1 << (where & 7)).astype(np.uint8))
    return out


def _routes(grouped: DataFrame) -> DataFrame:
    """root, lo, hi, cell, cls for each comparison that a class of grouped(root, cls, rep, n) takes part in: groups of up to
    BLOCK classes in one, larger ones cut into cells by size and number, of which those that can match are compared."""
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    grouped = cut(grouped.join(sizes, "root"))
    zero = F.lit(0).cast("long")
    small = grouped.filter(F.col("m") <= BLOCK).select("root", zero.alias("lo"), zero.alias("hi"), zero.alias("cell"), "cls", "rep")
    # Sizes of a similar pair differ by a factor of 1.25 at most, so by one step of 1.3.
    large = grouped.filter(F.col("m") > BLOCK).withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.3))).cast("long"))
    steps = large.groupBy("root", "step").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    other = steps.select("root", F.col("step").alias("to"), F.col("blocks").alias("blocks_to"))
    near = steps.join(other, "root").filter(F.abs(F.col("step") - F.col("to")) <= 1)
    large = large.join(near, ["root", "step"])
    cell = lambda step, k: F.col(step) * (1 << 32) + k
    large = large.withColumn("cell", cell("step", F.pmod(F.xxhash64("cls"), F.col("blocks")))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks_to") - 1))).withColumn("and", cell("to", F.col("k")))
    return small.unionByName(large.select("root", F.least("cell", "and").alias("lo"), F.greatest("cell", "and").alias("hi"), "cell", "cls", "rep"))


def near_pairs(df: DataFrame, n: int = 3) -> DataFrame:
    """id_a, id_b, similarity: the pairs of documents of df(doc_id, text) whose sets of n-grams of lower-case ASCII words
    have a Jaccard of 0.8. Rows with the same doc_id are one document; null ids and texts have no part."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    docs = rows.select("doc_id", F.array("text").alias("texts"))
    repeated = cut(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if not repeated.isEmpty():
        docs = docs.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts")))

    measured = cut(docs.mapInArrow(_measure(n), _MEASURED))
    members = measured.filter("slice IS NULL").select("doc_id", "cls")
    classes = cut(measured.filter("slice IS NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.first("sketch").alias("sketch")))
    counts = spark.sparkContext.broadcast(_frequencies(measured))

    offered = classes.agg(F.sum(F.floor(F.col("n") / 5) + 1)).first()[0] or 0
    keys = docs.select("texts").mapInArrow(_offered(n, counts), _KEYS).repartition(max(parts, -(-offered // KEYS_PER_PARTITION)), "key")
    met = cut(cut(keys.mapInArrow(_meet, _PAIRS)).groupBy("a", "b").agg(F.max("star").alias("star")))
    side = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    close = met.filter("NOT star").join(side("a"), "a").join(side("b"), "b").mapInArrow(_close, "a long, b long")
    edges = cut(close.unionByName(met.filter("star").select("a", "b")))

    groups = labels(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("cls"), F.col("component").alias("root"))
    routes = cut(_routes(groups.join(classes.select("cls", "rep", "n"), "cls")))
    bits = spark.sparkContext.broadcast(_marked(routes.select(F.col("rep").alias("id"))))
    needed = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))).mapInArrow(_wanted(bits), "doc_id long, texts array<string>")
    sent = routes.join(needed, F.col("rep") == F.col("doc_id")).select("root", "lo", "hi", "cell", "cls", "texts")
    sent = sent.repartition(parts, "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    found = cut(sent.mapInArrow(_compare(n), "a long, b long, similarity double"))

    # The class with fewer texts is expanded first, the other in parts of COPIES texts straight into the result.
    many = classes.select("cls", "copies")
    a, b = many.select(F.col("cls").alias("a"), F.col("copies").alias("copies_a")), many.select(F.col("cls").alias("b"), F.col("copies").alias("copies_b"))
    linked = found.join(a, "a").join(b, "b")
    swap = F.col("copies_a") > F.col("copies_b")
    linked = linked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("cls"), F.greatest("copies_a", "copies_b").alias("copies"), "similarity")
    linked = linked.unionByName(many.filter("copies > 1").select(F.col("cls").alias("few"), "cls", "copies", F.lit(1.0).alias("similarity")))
    salts = F.ceil(F.col("copies") / COPIES)
    left = linked.join(members.select(F.col("cls").alias("few"), F.col("doc_id").alias("x")), "few").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    right = members.join(many, "cls").select("cls", F.col("doc_id").alias("y"), F.pmod(F.xxhash64("doc_id"), salts).alias("salt"))
    out = left.join(right, ["cls", "salt"]).filter((F.col("few") != F.col("cls")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
