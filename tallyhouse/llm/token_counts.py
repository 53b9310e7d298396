"""Exact length histogram of a corpus, and the answers it gives for every context limit.

Documents are counted by encoded length. Sums over the shorter and the longer lengths then answer, for each length taken
as a context limit: how many documents fit, how many tokens there are, how many are left when longer documents are
truncated, and the quantile of the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyhouse.llm.bpe import lengths
from tallyhouse.llm.common import durable

#: Neighbouring lengths summed by one task.
STRIDE = 256


def histogram(lengths_df: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of (.., n_tokens); null lengths count as 0."""
    return lengths_df.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """One row per distinct length, read as a context limit.

    Columns: n_tokens (the limit), n_docs (documents of just this length), docs_within (not longer), docs_over (longer),
    tokens_within (in the documents that fit), truncated_total (all tokens when each document is cut at the limit),
    tokens_total, quantile (share of documents not longer). An empty histogram gives no rows. Two levels of sums: inside
    runs of STRIDE lengths, then over the runs, of which there is one for each STRIDE tokens of the longest document.
    """
    tokens = (F.col("n_tokens") * F.col("n_docs")).cast("long")
    hist = hist.withColumn("_run", F.floor(F.col("n_tokens") / STRIDE))
    runs = hist.groupBy("_run").agg(F.sum("n_docs").alias("_d"), F.sum(tokens).alias("_t"))
    before, whole = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    runs = runs.select(
        "_run",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_dall"),
        F.sum("_t").over(whole).alias("_tall"),
    )
    inside = Window.partitionBy("_run").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    within = (F.col("_d0") + F.sum("n_docs").over(inside)).cast("long")
    fit = (F.col("_t0") + F.sum(tokens).over(inside)).cast("long")
    out = hist.join(runs, "_run").select(
        "n_tokens", "n_docs", within.alias("docs_within"), fit.alias("tokens_within"), "_dall", F.col("_tall").alias("tokens_total")
    )
    over = (F.col("_dall") - F.col("docs_within")).cast("long")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_within",
        over.alias("docs_over"),
        "tokens_within",
        (F.col("tokens_within") + over * F.col("n_tokens")).cast("long").alias("truncated_total"),
        F.col("tokens_total").cast("long"),
        (F.col("docs_within") / F.col("_dall")).alias("quantile"),
    )


def length_quantiles(limits_df: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): for each share, the least length that so many of the documents don't exceed."""
    return limits_df.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "n_tokens", "quantile").where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """limits() of every whole text of docs by the byte-level tokenizer; null and empty texts have length 0.

    The histogram, a row for each distinct length, is read twice and kept in between: texts are encoded once.
    """
    return limits(durable(histogram(lengths(docs, path))))
