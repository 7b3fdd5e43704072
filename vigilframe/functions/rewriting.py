"""What built-in expressions can't say: Unicode normal forms, and masks that number what they find. Arrow batches, no shuffle."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Invisible characters, Cyrillic letters that look Latin, and the formats that are masked.
INVISIBLE = "​‌‍﻿­"
LOOKALIKES = ("аеорсухіАВЕКМНОРСТХ", "aeopcyxiABEKMHOPCTX")
MASKS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"),
    (r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "PHONE"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
    (r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", "CC"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "IP"),
    (r"(?i)\b(?:sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{36}|xoxb-[a-zA-Z0-9-]+)\b", "KEY"),
)
STEPS = ("nfkc", "invisible", "lookalikes", "whitespace", "accents", "lowercase")


def _differences(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b)) + abs(len(a) - len(b))


def normalise(text: str, steps=STEPS[:4]) -> tuple[str, dict[str, int]]:
    """The text after each of the steps in their order, and how many characters each changed."""
    how = {
        "nfkc": lambda x: unicodedata.normalize("NFKC", x), "invisible": lambda x: x.translate(dict.fromkeys(map(ord, INVISIBLE))), "lookalikes": lambda x: x.translate(str.maketrans(*LOOKALIKES)),
        "whitespace": lambda x: re.sub(r"[ \t\n\r]+", " ", x).strip(), "accents": lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"), "lowercase": str.lower,
    }
    changed = {}
    for step in STEPS:
        if step in steps:
            new = how[step](text)
            changed[step] = len(text) - len(new) if step == "invisible" else _differences(text, new)
            text = new
    return text, changed


def mask(text: str, masks=MASKS) -> tuple[str, dict[str, str]]:
    """The text with what the formats find as [NAME_1], [NAME_2] ..., the longest pattern first, and what each stands for."""
    out, mapping, count = text, {}, {}
    for pattern, name in sorted(masks, key=lambda m: -len(m[0])):
        for value in [m.group() for m in re.finditer(pattern, out)]:
            count[name] = count.get(name, 0) + 1
            mapping[f"[{name}_{count[name]}]"] = value
            out = out.replace(value, f"[{name}_{count[name]}]", 1)
    return out, mapping


def normalised(text, steps=STEPS[:4]) -> Column:
    """F16: struct<text, changed map, modified>. Null stays null."""

    @F.pandas_udf("text string, changed map<string,int>, modified boolean")
    def run(column: pd.Series) -> pd.DataFrame:
        done = [(None, None) if x is None else normalise(x, steps) for x in column]
        return pd.DataFrame({"text": [t for t, _ in done], "changed": [c for _, c in done], "modified": [None if x is None else t != x for x, (t, _) in zip(column, done)]})

    return run(F.col(text) if isinstance(text, str) else text)


def masked(text, masks=MASKS) -> Column:
    """struct<text, mapping>; `unmasked` undoes it. Null stays null."""

    @F.pandas_udf("text string, mapping map<string,string>")
    def run(column: pd.Series) -> pd.DataFrame:
        done = [(None, None) if x is None else mask(x, masks) for x in column]
        return pd.DataFrame({"text": [t for t, _ in done], "mapping": [m for _, m in done]})

    return run(F.col(text) if isinstance(text, str) else text)


def unmasked(text, mapping) -> Column:
    """The text with each placeholder of the mapping replaced by what it stands for."""
    text, mapping = (F.col(c) if isinstance(c, str) else c for c in (text, mapping))
    return F.aggregate(F.map_entries(mapping), text, lambda s, e: F.replace(s, e["key"], e["value"]))
