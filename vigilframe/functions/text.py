"""Column functions over texts and arrays. All are built-in expressions; none is a Python function at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE, LOW, MEDIUM, HIGH, CRITICAL = range(5)
RISK_NAMES = ("none", "low", "medium", "high", "critical")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pinned(e: Column) -> Column:
    """e, always. The partition's number, which is not deterministic to the optimizer, keeps it from copying an expensive
    expression into the filters and projections above, where it would run once for each use."""
    return F.when(F.spark_partition_id() >= 0, e)


def risk_name(rank) -> Column:
    return F.get(F.array(*map(F.lit, RISK_NAMES)), col(rank))


def ascii_only(text) -> Column:
    """Non-ASCII characters as blanks: on such text regular expressions mean the same in every engine."""
    return F.regexp_replace(col(text), r"[^\x00-\x7F]", " ")


def tokens(text, pattern: str = "[a-z0-9]+") -> Column:
    """All matches of the pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), F.lit(0))


def words(text) -> Column:
    """The text split at white space, without empty words."""
    return F.filter(F.split(col(text), r"\s+"), lambda x: x != "")


def sentences(text) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(col(text), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def char_ngrams(text, n: int = 4) -> Column:
    """Distinct character n-grams of the trimmed lower-cased text; a shorter text is one gram."""
    t = F.trim(F.lower(col(text)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(t) < n, F.array(t)).otherwise(grams))


def word_ngrams(ws, n: int = 3) -> Column:
    """n-grams of a word array, joined by blanks."""
    ws = col(ws)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(ws, i, n), " "))
    return F.when(F.size(ws) >= n, grams).otherwise(F.array().cast("array<string>"))


def jaccard(a, b, both_empty: float = 0.0) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(col(a), col(b))) / union)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def spans(text, pattern: str) -> Column:
    """start and stop (from 0) and match of every non-empty match: matches and the pieces between them alternate."""
    text = col(text)
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,stop:int,match:string>>")
    fold = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["b"])).alias("start"), (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("stop"), x["m"].alias("match")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(F.size(found) > 0, fold).otherwise(empty)


def without_overlaps(found) -> Column:
    """Of an array of spans with start and stop, ordered by start: each that starts after the last one kept ends."""
    found = col(found)
    return F.aggregate(
        found, F.struct(F.lit(0).alias("end"), F.filter(found, lambda x: F.lit(False)).alias("out")),
        lambda a, x: F.when(x["start"] >= a["end"], F.struct(x["stop"].alias("end"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a),
        lambda a: a["out"],
    )


def redact(text, found, label) -> Column:
    """The text with each span (ordered, none overlapping) replaced by label(span)."""
    text = col(text)
    return F.aggregate(
        col(found), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(x["stop"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, x["start"] - a["at"]), label(x)).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.greatest(F.length(text) - a["at"], F.lit(0)))),
    )


def grade(score, steps=((0.9, "A"), (0.8, "B"), (0.7, "C"), (0.6, "D"))) -> Column:
    out = F.lit("F")
    for least, name in reversed(steps):
        out = F.when(col(score) >= least, name).otherwise(out)
    return out


def luhn_valid(number) -> Column:
    """13 to 19 digits that pass the Luhn check; other characters are ignored."""
    digits = F.regexp_replace(col(number), "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def entropy(items) -> Column:
    """Shannon entropy in bits of an array's values: runs of the sorted array are the counts."""
    items = F.sort_array(col(items))
    n = F.size(items)
    edges = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (F.get(items, i - 1) != F.get(items, i - 2)))
    counts = F.zip_with(edges, F.concat(F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1))), F.array(n + 1)), lambda a, b: b - a)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda s, c: s - (c / n) * F.log2(c / n)))
