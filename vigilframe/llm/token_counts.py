"""Token counts as an exact length histogram.

Documents are encoded whole and counted by encoded length; each Arrow batch sends one row for each length it holds, so the
shuffle is small whatever the texts. Suffix sums over the histogram then answer, for a context limit equal to any length
that occurs, how many documents and tokens reach it, the tokens left after truncation, and the rank of the length, that is
its quantile. `at_limits` answers for any list of limits. The sums run in bands of BAND lengths and then over the bands,
so no task orders the whole histogram of a corpus with very long texts.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count each; the strings of
special tokens are ordinary text; an empty table gives an empty histogram. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.util import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that the vocabulary's tokenizer cuts text with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BAND = 1024
_LOADED: dict = {}


def read(vocabulary: str = VOCABULARY) -> bytes:
    with open(vocabulary, "rb") as f:
        return f.read()


def encoder(raw: bytes, pattern: str = PATTERN):
    """The encoder of a vocabulary file's bytes, built once in each process."""
    key = hashlib.blake2b(raw).digest(), pattern
    if key not in _LOADED:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


def lengths(texts: list, raw: bytes) -> np.ndarray:
    encode = encoder(raw).encode_ordinary
    return np.array([len(encode(t)) if t else 0 for t in texts], np.int64)


def histogram(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs: how many texts have each encoded length. The driver reads the vocabulary, a file of about a
    megabyte whatever the input, and broadcasts it: executors need not have it."""
    raw = df.sparkSession.sparkContext.broadcast(read(vocabulary))

    def count(batches):
        for batch in batches:
            if batch.num_rows:
                values, n = np.unique(lengths(batch.column(0).to_pylist(), raw.value), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["n_tokens", "n"])

    rows = df.select(text).mapInArrow(count, "n_tokens long, n long")
    return rows.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame, band: int = BAND) -> DataFrame:
    """For each length: documents and tokens of that length or more, tokens left if every text is cut to that length, and
    the share of documents that are no longer."""
    hist = hist.withColumn("band", F.floor(F.col("n_tokens") / band)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    bands = hist.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    bands = bands.select(
        F.col("band").alias("b"), F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = hist.withColumn("docs_at_least", F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.sum("tokens").over(inside))
    out = out.join(bands, F.col("band") == F.col("b"))
    out = out.withColumn("docs_at_least", F.col("docs_at_least") + F.col("docs_later")).withColumn("tokens_at_least", F.col("tokens_at_least") + F.col("tokens_later"))
    shorter = F.col("docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        (shorter / F.col("docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, documents cut, tokens kept and tokens lost for each limit; one aggregate over the histogram."""
    limit = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    rows = hist.select(limit, "n_tokens", "n_docs")
    over = F.greatest(F.col("n_tokens") - F.col("context_limit"), F.lit(0)) * F.col("n_docs")
    return rows.groupBy("context_limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        F.sum(F.col("n_tokens") * F.col("n_docs") - over).alias("tokens_kept"), F.sum(over).alias("tokens_lost"),
    )


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    # Written once: the sums read it twice, and each reading would encode every text.
    return suffix_sums(materialize(histogram(df, text, vocabulary), "token-histogram"))
