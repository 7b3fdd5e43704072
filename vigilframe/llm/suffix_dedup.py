"""Suffix-array deduplication: bytes covered by a 100-byte string that also starts earlier are removed.

Suffixes are compared on their first SPAN bytes only, so the suffix array can be built in independent parts, as long as
equal suffixes meet. They do by their minimizer: of the GRAM-byte strings inside the SPAN bytes, the one with the least
hash (the leftmost, if equal). Consecutive suffixes with one minimizer form a segment of SPAN to SPAN + 68 bytes.

1. Map: segments of whole texts, repeated ones removed at once within the task; one packed row for each partition.
2. Meet by minimizer: where whole segments are equal, the earliest stays and the others go. What is left to compare is
   different segments around one minimizer: the borders of repeated passages. Only their bytes are fetched.
3. Deep-shallow sorting of the suffixes that start in those segments: multikey quicksort, eight bytes at a time, to a
   shallow depth; groups that are still equal there are finished by blind tries, which jump to the next place where a
   group differs, all groups in step. Suffixes equal to the end are the same string; all but the earliest go.
   A minimizer with more than HOT segments (say, a line in very many texts) is dealt out by the hash of each string.
4. The removed pieces of each text are united and cut out.

Earlier means a smaller (doc_id, start). Defined results: null texts are empty and keep no byte; texts shorter than SPAN
keep everything; rows with a null doc_id come after all others; repeated rows (same doc_id and text) are one document,
returned as often as it is there, and don't remove each other; texts under one doc_id are laid over each other. Other
columns are never read. Segments meet by two 64-bit hashes; strings are compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.textcore import blobs, dealt, mix, pieces, powers, utf8
from vigilframe.llm.util import materialize, shuffle_partitions

SPAN = 100
GRAM = 32
SHALLOW = 4
HOT = 4096
FLUSH = 16 << 20
WINDOW = 1 << 27
BYTES_PER_PARTITION = 16 << 20
_GRAMS = SPAN - GRAM + 1
_U = np.uint64
_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 2**64)
_BYTE = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LAST = np.iinfo(np.int64).max
_PLACE = _U((1 << 28) - 1)


def segments(data: np.ndarray, offsets: np.ndarray):
    """row, start in the row, suffixes, minimizer's place after the start, minimizer's hash and content's hash of every
    segment of the rows."""
    n = len(data)
    ends = offsets[1:]
    starts_ok = np.repeat(ends, np.diff(offsets)) - np.arange(n) >= SPAN
    if not starts_ok.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(n, _P), out=sums[1:])
    inverse = powers(n, _P_INV)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= _GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (_GRAMS - width)], low[_GRAMS - width :])
    starts = np.flatnonzero(starts_ok[: len(low)])
    owner = (low[starts] & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    start, owner, row = starts[first], owner[first], row[first]
    end = start + count - 1 + SPAN
    content = mix((sums[end] - sums[start]) * inverse[start], 3) ^ mix((count * 256 + owner - start).astype(np.uint64), 4)
    return row, start - offsets[row], count, owner - start, gram[owner], content


_PACKED = ("part", "gram", "content", "who", "at", "shape", "docs", "gone")


def _packed(parts: int):
    """Segments of whole texts, one row for each partition. gone: pieces that repeat within the task, along with them."""

    def flush(docs, tags, texts):
        frame = pd.DataFrame({"doc": docs, "tag": tags}).sort_values(["doc", "tag"], kind="stable")
        frame = frame.drop_duplicates()
        copy = frame.duplicated("tag").to_numpy()
        order, copies = frame.index.to_numpy(), frame[copy]
        gone = [np.array([(d, t, 0, len(texts[i])) for i, d, t in zip(copies.index, copies["doc"], copies["tag"])], np.int64).reshape(-1, 4)]
        order = order[~copy]
        data, offsets, _ = utf8(pa.array([texts[i] for i in order], pa.large_binary()))
        found = []
        for i, j in pieces(offsets):
            # A text longer than WINDOW, which is a piece of its own, goes in windows; a segment that one cuts is two.
            for lo in range(offsets[i], max(offsets[j] - SPAN + 1, offsets[i] + 1), WINDOW):
                hi = min(offsets[j], lo + WINDOW + SPAN - 1)
                inside = np.clip(offsets[i : j + 1] - lo, 0, hi - lo)
                row, at, *rest = segments(data[lo:hi], inside)
                found.append((row + i, at + inside[row] + lo - offsets[row + i], *rest))
        who, at, count, place, gram, content = (np.concatenate(x) for x in zip(*found))
        doc, tag = np.array(docs, np.int64)[order], np.array(tags, np.int64)[order]
        # Rows come in the order of doc; within one text by start. So the first of equal segments is the earliest.
        by = np.lexsort((at, doc[who], content, gram))
        who, at, count, place, gram, content = (x[by] for x in (who, at, count, place, gram, content))
        again = np.zeros(len(by), bool)
        again[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))
        later = again & ((doc[who] > doc[who[lead]]) | (at > at[lead]))
        gone.append(np.stack([doc[who[later]], tag[who[later]], at[later], (at + count - 1 + SPAN)[later]], 1))
        gone = np.concatenate(gone)
        who, at, count, place, gram, content = (x[~later] for x in (who, at, count, place, gram, content))
        # By the hash's low bits: the high ones, being least in their window, are small.
        to = (((gram & _PLACE) * _U(parts)) >> _U(28)).astype(np.int64)
        order, occupied, cuts, mine, few, few_cuts = dealt(to, who)
        shape = (count[order] * 256 + place[order]).astype(np.uint16)
        columns = [blobs(x, cuts) for x in (gram[order], content[order], mine, at[order].astype(np.uint32), shape)]
        columns += [blobs(np.stack([doc[few], tag[few]], 1), few_cuts), blobs(gone, np.arange(len(occupied) + 1) * len(gone) // len(occupied))]
        return pa.RecordBatch.from_arrays([pa.array(occupied, pa.int32()), *columns], _PACKED)

    def run(batches):
        docs, tags, texts, have = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for d, t, x in zip(*(batch.slice(lo, 500).column(c).to_pylist() for c in ("doc", "tag", "body"))):
                    if len(x) >= SPAN:
                        docs.append(d)
                        tags.append(t)
                        texts.append(x)
                        have += len(x)
                    if have >= FLUSH:
                        yield flush(docs, tags, texts)
                        docs, tags, texts, have = [], [], [], 0
        if have:
            yield flush(docs, tags, texts)

    return run


_MET = "doc long, tag long, start long, stop long, gram long, count int, place int"


def _meet(part):
    """Rows with a stop: removed pieces. Rows with a gram: the earliest of each segment, where one minimizer has several."""
    columns, gone = [], np.frombuffer(b"".join(part["gone"].to_pylist()), np.int64).reshape(-1, 4)
    for gram, content, who, at, shape, docs in zip(*(part[c].to_pylist() for c in _PACKED[1:-1])):
        gram = np.frombuffer(gram, np.uint64)
        who = np.frombuffer(who, np.uint16 if len(who) == 2 * len(gram) else np.uint32)
        doc, tag = np.frombuffer(docs, np.int64).reshape(-1, 2).T
        columns.append((gram, np.frombuffer(content, np.uint64), doc[who], tag[who], np.frombuffer(at, np.uint32), np.frombuffer(shape, np.uint16)))
    gram, content, doc, tag, at, shape = (np.concatenate(x) for x in zip(*columns))
    # Only minimizers that occur twice matter.
    order = np.argsort(gram, kind="stable")
    sorted_ = gram[order]
    twin = np.zeros(len(order), bool)
    twin[1:] = sorted_[1:] == sorted_[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    gram, content, doc, tag, at, shape = (x[order] for x in (gram, content, doc, tag, at, shape))
    order = np.lexsort((at, doc, content, gram))
    gram, content, doc, tag, at, shape = (x[order] for x in (gram, content, doc, tag, at.astype(np.int64), shape.astype(np.int64)))
    again = np.zeros(len(gram), bool)
    again[1:] = (gram[1:] == gram[:-1]) & (content[1:] == content[:-1])
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(gram))))
    later = again & ((doc > doc[lead]) | (at > at[lead]))
    fresh = ~again
    kinds = np.add.reduceat(fresh.astype(np.int64), start) if len(start := np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))) and len(gram) else np.zeros(0, np.int64)
    several = np.repeat(kinds, np.diff(np.append(start, len(gram)))) > 1 if len(gram) else np.zeros(0, bool)
    ask = several & ~later
    count = shape // 256
    null = np.int64(0)

    def rows(mask, removed):
        n = int(mask.sum())
        stop = pa.array((at + count - 1 + SPAN)[mask]) if removed else pa.nulls(n, pa.int64())
        of = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())] if removed else [pa.array(gram[mask].view(np.int64)), pa.array(count[mask].astype(np.int32)), pa.array((shape % 256)[mask].astype(np.int32))]
        return pa.table([pa.array(doc[mask]), pa.array(tag[mask]), pa.array(at[mask] + null), stop, *of], ["doc", "tag", "start", "stop", "gram", "count", "place"])

    n = len(gone)
    before = pa.table([*map(pa.array, gone.T.copy()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], ["doc", "tag", "start", "stop", "gram", "count", "place"])
    return pa.concat_tables([before, rows(later, True), rows(ask, False)])


_FETCHED = "part long, doc long, tag long, start long, count int, place int, gram long, bytes binary"


def _fetch(parts: int):
    """The bytes of each segment asked for; those of a hot minimizer string by string."""

    def run(batches):
        for batch in batches:
            out = []
            for doc, tag, body, asks in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "body", "asks"))):
                for a in asks:
                    start, count, place, gram = a["start"], a["count"], a["place"], a["gram"]
                    if not a["hot"]:
                        out.append((gram % parts, doc, tag, start, count, place, gram, body[start : start + count - 1 + SPAN]))
                        continue
                    for k in range(count):
                        x = body[start + k : start + k + SPAN]
                        key = int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
                        out.append((key % parts, doc, tag, start + k, 1, place - k, key, x))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()])], ["part", "doc", "tag", "start", "count", "place", "gram", "bytes"])

    return run


def _split(group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, word), and the number of each one's new group in that order."""
    order = np.lexsort((word, group))
    g, w = group[order], word[order]
    return order, np.cumsum(np.concatenate([[False], (g[1:] != g[:-1]) | (w[1:] != w[:-1])]))


def _shared(group: np.ndarray) -> np.ndarray:
    """Which members of ordered groups have company."""
    same = np.concatenate([group[1:] == group[:-1], [False]]) if len(group) else np.zeros(0, bool)
    out = same.copy()
    out[1:] |= same[:-1]
    return out


def deep_shallow(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of data that start at `at` by their first SPAN bytes within each group. Returns the indexes of
    those that equal another one, and a number for each set of equals, in order."""
    n_words = -(-SPAN // 8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(where, k):
        # Eight bytes as one big-endian letter; the last letter has the rest of the span only.
        x = np.ascontiguousarray(view[where + 8 * k]).view(">u8").ravel().astype(np.uint64)
        return x if 8 * (k + 1) <= SPAN else x >> _U(8 * (8 * (k + 1) - SPAN))

    who = np.arange(len(at))
    order = np.argsort(group, kind="stable")
    who, group = who[order], group[order]
    keep = _shared(group)
    who, group = who[keep], group[keep]
    for k in range(SHALLOW):  # multikey quicksort
        if not len(who):
            return who, group
        order, new = _split(group, word(at[who], k))
        keep = _shared(new)
        who, group = who[order][keep], new[keep]
    done_who, done_group, base = [], [], 0
    depth = np.full(len(who), SHALLOW)
    while len(who):  # blind tries, one level of branches at a time
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(start, len(group)))
        branch = np.full(len(start), n_words)
        for k in range(SHALLOW, n_words):
            open_ = (branch == n_words) & (depth[start] <= k)
            if not open_.any():
                continue
            mine = np.repeat(open_, size)
            letters = word(at[who[mine]], k)
            cut = np.concatenate([[0], np.cumsum(size[open_])[:-1]])
            differs = np.minimum.reduceat(letters, cut) != np.maximum.reduceat(letters, cut)
            branch[np.flatnonzero(open_)[differs]] = k
        equal = np.repeat(branch == n_words, size)
        done_who.append(who[equal])
        done_group.append(group[equal] + base)
        base += int(group[-1]) + 1
        rest, at_letter = ~equal, np.repeat(branch, size)[~equal]
        who, group = who[rest], group[rest]
        if not len(who):
            break
        letters = np.zeros(len(who), np.uint64)
        for k in np.unique(at_letter).tolist():
            letters[at_letter == k] = word(at[who[at_letter == k]], k)
        order, new = _split(group, letters)
        keep = _shared(new)
        who, group, depth = who[order][keep], new[keep], (at_letter + 1)[order][keep]
    return np.concatenate(done_who), np.concatenate(done_group)


_REMOVED = "doc long, tag long, start long, stop long"


def _sort(part):
    """Removed pieces among the suffixes of the fetched segments."""
    data, offsets, _ = utf8(part["bytes"])
    doc, tag, start, count, place, gram = (part[c].to_numpy() for c in ("doc", "tag", "start", "count", "place", "gram"))
    seg = np.repeat(np.arange(len(count)), count)
    k = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    meet = mix(gram.view(np.uint64)[seg] ^ mix((place[seg] - k).astype(np.int64).view(np.uint64), 21), 22)
    who, group = deep_shallow(data, offsets[seg] + k, meet)
    out = pd.DataFrame({"g": group, "doc": doc[seg[who]], "tag": tag[seg[who]], "start": start[seg[who]] + k[who]})
    out = out.sort_values(["g", "doc", "start"], kind="stable")
    first = out.groupby("g")[["doc", "start"]].transform("first")
    out = out[(out["doc"] > first["doc"]) | (out["start"] > first["start"])].sort_values(["doc", "tag", "start"])
    d, t, s = (out[c].to_numpy() for c in ("doc", "tag", "start"))
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + SPAN)]) if len(d) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(d)) - 1 if len(a) else a
    return pa.table([pa.array(d[a]), pa.array(t[a]), pa.array(s[a]), pa.array(s[b] + SPAN)], ["doc", "tag", "start", "stop"])


def unite(pieces_: np.ndarray) -> np.ndarray:
    """Maximal runs of sorted or unsorted (start, stop) rows."""
    pieces_ = pieces_[np.argsort(pieces_[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pieces_[:, 1])
    new = np.concatenate([[True], pieces_[1:, 0] > reach[:-1]])
    at = np.flatnonzero(new)
    return np.stack([pieces_[at, 0], reach[np.append(at[1:], len(reach)) - 1]], 1)


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for body, removed in zip(batch.column("body"), batch.column("removed")):
                body = body.as_buffer()
                if not removed.is_valid:
                    rows.append((len(body), 0, 0, bytes(body)))
                    continue
                packed = removed.values.to_numpy()
                runs = unite(np.stack([packed >> 32, packed & 0xFFFFFFFF], 1))
                ends = [0, *runs.ravel().tolist(), len(body)]
                kept = b"".join(bytes(body[a:b]) for a, b in zip(ends[::2], ends[1::2]))
                rows.append((len(body), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept))
            n, gone, spans, kept = zip(*rows) if rows else ((), (), (), ())
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kept, pa.binary())] if with_text else out, [*names, "kept"] if with_text else names)

    return run


def removed_pieces(docs: DataFrame) -> DataFrame:
    """doc, tag, start, stop of removed pieces (they may overlap) of docs(doc_id, doc, tag, body)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // BYTES_PER_PARTITION))
    packed = docs.select("doc", "tag", "body").mapInArrow(_packed(parts), ", ".join(f"{c} {'binary' if k else 'int'}" for k, c in enumerate(_PACKED)))
    met = materialize(packed.groupBy("part").applyInArrow(_meet, _MET), "suffix-met")
    asks = met.filter("gram IS NOT NULL")
    hot = asks.groupBy("gram").count().filter(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    asks = asks.join(hot, "gram", "left").groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "count", "place", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("asks"))
    # The same columns of docs as the last join reads, so that both share one exchange of the texts.
    fetched = docs.join(asks, ["doc", "tag"]).select("doc_id", "doc", "tag", "body", "asks").mapInArrow(_fetch(parts), _FETCHED)
    sorted_ = fetched.groupBy("part").applyInArrow(_sort, _REMOVED)
    return met.filter("stop IS NOT NULL").select("doc", "tag", "start", "stop").unionByName(sorted_)


def suffix_dedup(df: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of df(doc_id, text); with_text: also the remaining
    bytes, kept (they need not be valid UTF-8, as strings are cut bytewise)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("body").alias("tag"), "body")
    removed = removed_pieces(docs).groupBy("doc", "tag").agg(F.collect_list(F.col("start") * F.lit(1 << 32) + F.col("stop")).alias("removed"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(removed, ["doc", "tag"], "left").select("doc_id", "body", "removed").mapInArrow(_cut(with_text), schema)
