"""Quality rules: a threshold table compiled into one projection, without user functions.

`measures` turns a text column into counts (words, characters in words, symbols, lines, repeated lines, words in repeated
three-word windows, stop words). `RULES` is the threshold table: each row bounds one count by a multiple of another, in
whole percents, so that both sides are integers. `compile_rules` turns the table into one Boolean column. No shuffle, no
Python; each document is measured in its own row.

Defined results: a null text counts as empty; empty and blank texts have no words and fail the base rules; repeated rows
are judged one by one; other columns of the input are never read. A text of any length is measured whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.util import SPACE_CHARS, SPACES

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "with", "as", "was", "on", "are", "be", "this", "by", "at",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "nicht", "ein", "eine", "dem", "im",
    "le", "la", "les", "de", "du", "et", "un", "une", "est", "dans", "que", "qui", "par", "pour", "en", "au", "ce",
    "el", "los", "las", "del", "y", "lo", "con", "por", "para", "se", "su", "al",
)

#: (rule, measure, bound, percent, of): keep a document only if 100 * measure <= percent * of ("most") or >= ("least").
RULES = (
    ("word length, most", "word_chars", "most", 2000, "n_words"),
    ("word length, least", "word_chars", "least", 150, "n_words"),
    ("symbols per word", "n_symbols", "most", 10, "n_words"),
    ("stop words per word", "n_stop_words", "least", 1, "n_words"),
    ("repeated lines per line", "n_dup_lines", "most", 50, "n_lines"),
)


def _once(e: Column) -> Column:
    """e, always. The partition's number, which is not deterministic to the optimizer, keeps it from copying e into a
    filter above, where a lambda would evaluate the whole array again for each of its elements."""
    return F.when(F.spark_partition_id() >= 0, e)


def measures(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """The columns `keep` of df, and one column for each measure, named with `prefix`."""
    p, mine = prefix, "__q_"
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.select(*keep, body.alias(mine + "t"), F.btrim(body, F.lit(SPACE_CHARS)).alias(mine + "b"))
    none = F.array().cast("array<string>")
    out = out.select(
        *keep, mine + "t", _once(F.when(F.col(mine + "b") == "", none).otherwise(F.split(mine + "b", f"[{SPACES}]+"))).alias(mine + "w"),
    )
    w, h, g, s = (F.col(mine + x) for x in "whgs")
    lines = F.filter(F.split(mine + "t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = out.select(
        *keep, F.size(w).cast("long").alias(p + "n_words"), F.length(F.array_join(w, "")).cast("long").alias(p + "word_chars"),
        F.regexp_count(mine + "t", F.lit(f"[{SYMBOLS}]")).cast("long").alias(p + "n_symbols"),
        _once(lines).alias(mine + "l"), _once(F.transform(w, lambda x: F.xxhash64(x))).alias(mine + "h"),
    )
    done = [p + x for x in ("n_words", "word_chars", "n_symbols")]
    stop = [F.xxhash64(F.lit(x)) for x in STOP_WORDS]
    out = out.select(
        *keep, *done, F.size(F.filter(h, lambda x: x.isin(*stop))).cast("long").alias(p + "n_stop_words"),
        F.size(mine + "l").cast("long").alias(p + "n_lines"), (F.size(mine + "l") - F.size(F.array_distinct(mine + "l"))).cast("long").alias(p + "n_dup_lines"),
        _once(F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))).alias(mine + "g"),
    )
    done += [p + x for x in ("n_stop_words", "n_lines", "n_dup_lines")]
    # Only a text with a repeated window has its windows sorted.
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.select(*keep, *done, _once(F.when(F.size(F.array_distinct(g)) < F.size(g), pairs)).alias(mine + "s"))
    twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    out = out.select(*keep, *done, _once(F.when(s.isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"])))).alias(mine + "i"))
    # Each window covers three words; in order, a window adds as many as the one before it leaves open.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(mine + "i", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return out.withColumn(p + "n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop(mine + "i")


def base_failed(prefix: str = "") -> Column:
    n = F.col(prefix + "n_words")
    return (n < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT_PERCENT * n)


def compile_rules(rules=RULES, prefix: str = "") -> Column:
    """The threshold table as one Boolean column."""
    verdict = F.lit(True)
    for _, measure, bound, percent, of in rules:
        a, b = 100 * F.col(prefix + measure), percent * F.col(prefix + of)
        verdict = verdict & ((a <= b) if bound == "most" else (a >= b))
    return verdict


def quality_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept for each row of documents."""
    out = measures(df.select("doc_id", "text"))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & compile_rules(rules))


def keep_good(df: DataFrame, rules=RULES) -> DataFrame:
    """The rows of df that the rules keep, with df's own columns and no others."""
    p = "__quality_"
    out = measures(df.withColumn(p + "body", F.col("text")), p + "body", tuple(df.columns), p)
    return out.filter(~base_failed(p) & compile_rules(rules, p)).select(*df.columns)


def _sql() -> str:
    word = rf"[^{SPACES}]+"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " AND ".join(f"100 * {m} {'<=' if b == 'most' else '>='} {pc} * {of}" for _, m, b, pc, of in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '{word}')) AS word, generate_subscripts(regexp_extract_all(t, '{word}'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM g WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, b, c) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
cnt AS (SELECT r, count(*) AS n, count(*) FILTER (word IN ({stop})) AS s FROM w GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM l WHERE regexp_matches(line, '{word}') GROUP BY r),
m AS (
  SELECT d.doc_id, coalesce(cnt.n, 0) AS n_words,
    length(regexp_replace(t, '[{SPACES}]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
    coalesce(cnt.s, 0) AS n_stop_words, coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.u, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cnt USING (r) LEFT JOIN ln USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {verdict} AS kept FROM f
"""


SQL = _sql()
