"""Declarative plans: operators written once as SQL over named tables, for Spark and for an independent engine.

`op` registers a function from a dialect to SQL text. `apply` runs one over the caller's own DataFrames (any DataFrame with
the named columns takes the place of a table); `oracle` gives the text for the other engine. What differs between the
engines is spelled by the dialect, so a plan stays one text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

PLANS: dict[str, Callable] = {}
#: Letters beyond ASCII, roughly.
LETTERS = r"[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}]"
#: Tables that are made of others: the table that each reads, its DataFrame function, and SQL for the other engine.
MADE: dict[str, tuple[str, Callable, Callable]] = {}


#: Inputs that operators name and the test tables don't have: SQL that makes each from the test tables.
INPUTS: dict[str, Callable] = {}


def op(f: Callable) -> Callable:
    PLANS[f.__name__] = f
    return f


def given(f: Callable) -> Callable:
    INPUTS[f.__name__] = f
    return f


class Spark:
    #: A JSON string. Possessive, as Java's matcher descends once for every character or escape of a group that may yield.
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'

    def t(self, name):
        return "{" + name + "}"

    def s(self):
        return "STRING"

    def lit(self, p):
        # A dollar before a brace would be a variable of the session.
        return "'" + p.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{").replace("{", "{{").replace("}", "}}") + "'"

    def us(self, x):
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {x})"

    def rx(self, x, p):
        return f"({x} RLIKE {self.lit(p)})"

    def rxn(self, x, p):
        return f"regexp_count({x}, {self.lit(p)})"

    def rep(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, '{r}')"

    def rep1(self, x, p, r):
        """The first match alone replaced, case ignored."""
        return f"regexp_replace({x}, {self.lit(f'(?is)^(.*?){p}')}, '$1{r}')"

    def get(self, x, p, g=0):
        return f"regexp_extract({x}, {self.lit(p)}, {g})"

    def all(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def all0(self, x, p):
        """Whole matches, also where the pattern has groups."""
        return self.all(x, p)

    def pct(self, x, q):
        return f"percentile({x}, {q})"

    def sha(self, x):
        return f"sha2({x}, 256)"

    def explode(self, x):
        return f"explode({x})"

    def distinct(self, x):
        return f"array_distinct({x})"

    def size(self, x):
        return f"size({x})"

    def inter(self, a, b):
        return f"size(array_intersect({a}, {b}))"

    def filter(self, x, v, e):
        return f"filter({x}, {v} -> {e})"

    def map(self, x, v, e):
        return f"transform({x}, {v} -> {e})"

    def at(self, x, i):
        return f"get({x}, ({i}) - 1)"

    def join(self, x, s):
        return f"array_join({x}, '{s}')"

    def slice(self, x, a, n):
        return f"slice({x}, {a}, {n})"

    def seq(self, a, b):
        return f"(CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE CAST(array() AS array<int>) END)"

    def dot(self, a, b):
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS double) * CAST(y AS double)), 0D, (s, x) -> s + x)"

    def json(self, x, k):
        return f"get_json_object({x}, '$.{k}')"

    def sort(self, x):
        return f"array_sort({x})"

    def arr(self, *x):
        return f"array({', '.join(x)})"

    def collect(self, x):
        return f"collect_set({x})"

    def lmax(self, x):
        return f"array_max({x})"

    def lsum(self, x):
        return f"aggregate({x}, CAST(0 AS DOUBLE), (s, v) -> s + v)"

    def pos(self, x, v):
        """The first place of v in x, from 1; 0 where it isn't there."""
        return f"CAST(array_position({x}, {v}) AS INT)"

    def has(self, x, v):
        return f"array_contains({x}, {v})"

    def valid_json(self, x):
        return f"(try_parse_json({x}) IS NOT NULL)"

    def values(self, rows, name, *columns):
        """A table of literals. Strings are quoted here."""
        cell = lambda v: self.lit(v) if isinstance(v, str) else "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS {name}({', '.join(columns)})"

    def strings(self, xs):
        return self.arr(*map(self.lit, xs))

    def r4(self, x):
        """Rounded to four places, in the same steps on every engine."""
        return f"(floor(({x}) * 10000.0 + 0.5) / 10000.0)"


class Duck(Spark):
    string = r'"[^"\\]*(?:\\.[^"\\]*)*"'

    def t(self, name):
        return f"({MADE[name][2]()})" if name in MADE else f"({INPUTS[name](self)})" if name in INPUTS else name

    def lit(self, p):
        return "'" + p.replace("'", "''") + "'"

    def s(self):
        return "VARCHAR"

    def us(self, x):
        return f"epoch_us({x})"

    def bounded(self, x, p):
        r"""Letters beyond ASCII as _ where the pattern asks for \b, which RE2 knows for ASCII only; other engines take them
        for letters."""
        return f"regexp_replace({x}, {self.lit(LETTERS)}, '_', 'g')" if r"\b" in p else x

    def rx(self, x, p):
        return f"regexp_matches({self.bounded(x, p)}, {self.lit(p)})"

    def rxn(self, x, p):
        return f"len(regexp_extract_all({self.bounded(x, p)}, {self.lit(p)}))"

    def rep(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(p)}, '{r}', 'g')"

    def rep1(self, x, p, r):
        return f"regexp_replace({x}, {self.lit(f'(?i){p}')}, '{r}')"

    def all(self, x, p):
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def pct(self, x, q):
        return f"quantile_cont({x}, {q})"

    def sha(self, x):
        return f"sha256({x})"

    def explode(self, x):
        return f"unnest({x})"

    def distinct(self, x):
        return f"list_distinct({x})"

    def size(self, x):
        return f"len({x})"

    def inter(self, a, b):
        return f"len(list_intersect({a}, {b}))"

    def filter(self, x, v, e):
        return f"list_filter({x}, lambda {v}: {e})"

    def map(self, x, v, e):
        return f"list_transform({x}, lambda {v}: {e})"

    def at(self, x, i):
        return f"({x})[{i}]"

    def join(self, x, s):
        return f"array_to_string({x}, '{s}')"

    def slice(self, x, a, n):
        return f"({x})[({a}):({a}) + ({n}) - 1]"

    def seq(self, a, b):
        return f"range({a}, ({b}) + 1)"

    def dot(self, a, b):
        return f"list_inner_product(CAST({a} AS double[]), CAST({b} AS double[]))"

    def json(self, x, k):
        return f"json_extract_string({x}, '$.{k}')"

    def sort(self, x):
        return f"list_sort({x})"

    def arr(self, *x):
        return f"[{', '.join(x)}]"

    def collect(self, x):
        return f"list(DISTINCT {x})"

    def lmax(self, x):
        return f"list_max({x})"

    def lsum(self, x):
        return f"coalesce(list_sum({x}), 0.0)"

    def pos(self, x, v):
        return f"coalesce(list_position({x}, {v}), 0)"

    def has(self, x, v):
        return f"list_contains({x}, {v})"

    def valid_json(self, x):
        return f"json_valid({x})"


def _doubles(sql: str, suffix: str) -> str:
    """Decimal literals as doubles, outside of quotes: the engines differ in the scale of decimal results."""
    quoted = r"('(?:[^'\\]|\\.)*')" if suffix == "D" else r"('(?:[^']|'')*')"
    parts = re.split(quoted, sql, flags=re.S)
    return "".join(x if i % 2 else re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", rf"\1{suffix}", x) for i, x in enumerate(parts))


def named(sql: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", sql))


def tables(name: str) -> set[str]:
    return named(PLANS[name](Spark()))


def apply(spark: SparkSession, name: str, options: dict | None = None, **frames: DataFrame) -> DataFrame:
    """The plan over the caller's DataFrames. options: the plan's own parameters (pattern tables, weights, thresholds)."""
    return spark.sql(_doubles(PLANS[name](Spark(), **(options or {})), "D"), **frames)


def frame(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
    """A test table, or an input made from the test tables."""
    if t in MADE:
        return MADE[t][1](frame(spark, sf_dir, MADE[t][0]))
    if t in INPUTS:
        text = INPUTS[t](Spark())
        return spark.sql(_doubles(text, "D"), **{u: frame(spark, sf_dir, u) for u in named(text)})
    return spark.read.parquet(f"{sf_dir}/{t}.parquet")


def query(name: str):
    def run(spark, sf_dir):
        return apply(spark, name, **{t: frame(spark, sf_dir, t) for t in tables(name)})

    return run


def oracle(name: str) -> str:
    return _doubles(PLANS[name](Duck()), "::DOUBLE")
