"""Obfuscated texts: what encodings hide, decoded by built-in expressions and held against dangerous terms.

`obfuscation` adds an array of (kind, risk, decoded) to a table. Decoded bytes that aren't UTF-8 text count as nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import HIGH, MEDIUM, col, pinned

# Dangerous terms, encodings and look-alike letters.
DANGEROUS = r"(?i)(ignore\s+(all\s+)?instructions|system\s+prompt|rm\s+-rf|drop\s+table|delete\s+from|exec\s*\(|eval\s*\(|subprocess|os\.system|__import__|curl\s+.*\|\s*(sh|bash)|wget\s+.*\|\s*(sh|bash)|/etc/passwd|/etc/shadow|\.ssh/|password|secret.?key|api.?key|access.?token)"
BASE64 = r"(?<![A-Za-z0-9+/=])([A-Za-z0-9+/]{16,}={0,2})(?![A-Za-z0-9+/=])"
HEX = r"((?:\\x[0-9a-fA-F]{2}){4,}|(?:0x[0-9a-fA-F]{2}\s*){4,})"
ROT13 = r"(?i)(?:rot13|rot-13|rotate\s*13)\s*[:=]?\s*([A-Za-z\s]{8,})"
UNICODE = r"((?:\\u[0-9a-fA-F]{4}){4,})"
ZERO_WIDTH = "[\\u200b\\u200c\\u200d\\u2060\\ufeff]"
CONCAT = r"['\"](\w{1,6})['\"]\s*\+\s*['\"](\w{1,6})['\"](?:\s*\+\s*['\"](\w{1,6})['\"])?(?:\s*\+\s*['\"](\w{1,6})['\"])?"
CONCAT_WORDS = ("eval", "exec", "system", "import", "require", "subprocess", "password", "passwd", "secret")
CHARCODE = r"(?i)String\.fromCharCode\s*\(\s*([0-9,\s]+)\s*\)"
LEET = ("0134578@$!", "oieastbasi")
LEET_TARGETS = ("ignore instructions", "system prompt", "drop table", "delete from", "exec(", "eval(", "rm -rf", "passwd", "hack", "exploit", "bypass filter", "bypass safety")
CYRILLIC = ("АВСЕНКМОРТХаеорсух", "ABCEHKMOPTXaeopcyx")
GREEK = ("ΑΒΕΗΙΚΜΝΟΡΤΧαεορ", "ABEHIKMNOPTXaeop")


def _utf8(raw: Column) -> Column:
    """Bytes as text, or null where they aren't text."""
    return F.try_validate_utf8(raw.cast("string"))


def _chars(codes: Column) -> Column:
    """An array of code points as text."""
    return F.array_join(F.transform(codes, lambda c: F.call_function("char", c.cast("long"))), "")


def base64_texts(text) -> Column:
    """Decoded base64 runs of at least 16 characters, padded where padding is missing."""
    runs = F.regexp_extract_all(col(text), F.lit(BASE64), F.lit(1))
    bare = F.transform(runs, lambda x: F.regexp_replace(x, "=+$", ""))
    return F.filter(F.transform(bare, lambda x: _utf8(F.try_to_binary(F.rpad(x, (F.length(x) + 3 - (F.length(x) + 3) % 4).cast("int"), F.lit("=")), F.lit("base64")))), lambda x: x.isNotNull())


def hex_texts(text) -> Column:
    r"""Decoded runs of \xNN or 0xNN."""
    runs = F.regexp_extract_all(col(text), F.lit(HEX), F.lit(1))
    return F.filter(F.transform(runs, lambda x: _utf8(F.unhex(F.regexp_replace(x, r"\\x|0x|\s", "")))), lambda x: x.isNotNull())


def rot13_texts(text) -> Column:
    a, b = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
    return F.transform(F.regexp_extract_all(col(text), F.lit(ROT13), F.lit(1)), lambda x: F.translate(x, a, b))


def escape_texts(text) -> Column:
    r"""Decoded runs of \uNNNN in the ASCII range; other code points as a question mark."""
    runs = F.regexp_extract_all(col(text), F.lit(UNICODE), F.lit(1))
    code = lambda h: F.conv(h, 16, 10).cast("long")
    return F.transform(runs, lambda x: _chars(F.transform(F.filter(F.split(x, r"\\u"), lambda h: h != ""), lambda h: F.when(code(h) < 128, code(h)).otherwise(63))))


def charcode_texts(text) -> Column:
    runs = F.regexp_extract_all(col(text), F.lit(CHARCODE), F.lit(1))
    number = lambda n: F.expr("1").cast("long") * F.coalesce(F.trim(n).try_cast("long"), F.lit(63))
    return F.transform(runs, lambda x: _chars(F.transform(F.filter(F.split(x, ","), lambda n: F.trim(n) != ""), lambda n: F.when(number(n) < 128, number(n)).otherwise(63))))


def concatenated(text) -> Column:
    """Strings that are put together from pieces of quoted text."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(CONCAT), F.lit(0)), lambda x: F.regexp_replace(x, r"['\"+\s]", ""))


def plain_letters(text) -> Column:
    """Cyrillic and Greek look-alikes as the Latin letters they look like."""
    return F.translate(col(text), CYRILLIC[0] + GREEK[0], CYRILLIC[1] + GREEK[1])


def suspicious(t: Column, low: Column) -> Column:
    """Whether any encoding can be in a text: cheap tests that most texts fail."""
    return (
        t.rlike("[A-Za-z0-9+/]{16}") | F.contains(low, F.lit("\\x")) | F.contains(low, F.lit("0x")) | F.contains(low, F.lit("rot")) | F.contains(t, F.lit("\\u")) | F.contains(low, F.lit("fromcharcode"))
        | t.rlike("[0134578@$!]") | t.rlike(ZERO_WIDTH) | t.rlike("['\"]\\s*\\+") | t.rlike(f"[{CYRILLIC[0]}{GREEK[0]}]")
    )


def hidden_terms(t: Column, low: Column) -> Column:
    """An array of kind, risk and decoded text of what each encoding hides."""

    def rows(kind, decoded, when=lambda x: x.rlike(DANGEROUS), risk=HIGH):
        return F.transform(F.filter(decoded, when), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(risk).alias("risk"), x.alias("decoded")))

    undone = F.translate(low, *LEET)
    leet = F.slice(F.filter(F.array(*map(F.lit, LEET_TARGETS)), lambda x: F.contains(undone, x) & ~F.contains(low, x)), 1, 1)
    looks = F.when(t.rlike(f"[{CYRILLIC[0]}{GREEK[0]}]"), F.array(plain_letters(t))).otherwise(F.array().cast("array<string>"))
    smuggled = F.when(F.regexp_count(t, F.lit(ZERO_WIDTH)) >= 5, F.array(F.lit("zero-width characters"))).otherwise(F.array().cast("array<string>"))
    every = lambda x: F.lit(True)
    return F.flatten(F.array(
        rows("base64", base64_texts(t)), rows("hex", hex_texts(t)), rows("rot13", rot13_texts(t)), rows("unicode_escape", escape_texts(t)), rows("leetspeak", leet, every, MEDIUM),
        rows("zero_width", smuggled, every), rows("concatenation", concatenated(t), lambda x: F.lower(x).isin(*CONCAT_WORDS)), rows("charcode", charcode_texts(t)), rows("homoglyph", looks),
    ))


def obfuscation(df: DataFrame, text: str = "text") -> DataFrame:
    """SC9-SC17: df with `hidden`, an array of kind, risk and decoded text. Null texts hide nothing."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    none = F.array().cast("array<struct<kind:string,risk:int,decoded:string>>")
    return df.withColumn("hidden", pinned(F.when(suspicious(t, low), hidden_terms(t, low)).otherwise(none)))
