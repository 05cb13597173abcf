"""Sources mixed to target weights (problem 8).

Sizes are tokens of a public tokenizer. Each source gets a mean repetition rate from its target share; each document
the number of copies that a Poisson distribution of that mean, cut at the source's greatest number of repeats, has
at a quantile drawn from the hash of its id. The rates are settled on the hashed quantiles themselves, so the shares
reached are those aimed at, up to the size of single documents. Copies are put in an order by hash over all sources.

Defined results: null and empty texts have no tokens and aren't used; documents of sources that aren't listed, or of
no source, aren't used; listed sources without documents are reported with nothing, and the other shares fill up to 1;
repeated documents count as documents of their own; targets that are null or not positive give no copies, a missing
max_repeats means once.
"""

from __future__ import annotations

import base64
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, written

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
SEED = 17
#: A source is used up to this share of what its repeats allow; the source that reaches it first sets the size of the mix.
FILL = 0.95
#: Quantiles are counted in so many bins for each source.
BINS = 4096


def tokens(documents: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every document with a text. The pattern that goes with the vocabulary files comes from
    their module; without it sizes would be others, so a missing module is an error."""

    def run(batches):
        import public_tokenizers
        import tiktoken

        with open(os.path.join(folder, name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("mix", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return spread(documents.select("doc_id", "source", "text")).mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def quantile(seed: int):
    """A number in (0, 1) from the hash of doc_id, the same for the same document wherever it is computed."""
    return (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def poisson_cdf(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k from 0 to cap - 1."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def copies(u: float, cdf: list[float]) -> int:
    return sum(u > c for c in cdf)


def _reached(u: np.ndarray, n: np.ndarray, rate: float, cap: int) -> float:
    return float(sum(n[u > c].sum() for c in poisson_cdf(rate, cap)))


def settle(u: np.ndarray, n: np.ndarray, wanted: float, cap: int) -> float:
    """The rate at which quantiles u with n tokens each come nearest to the wanted number of tokens."""
    low, high = 0.0, 1.0
    while _reached(u, n, high, cap) < wanted and high < 600:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if _reached(u, n, mid, cap) < wanted else (low, mid)
    under, over = wanted - _reached(u, n, low, cap), _reached(u, n, high, cap) - wanted
    return high if over <= under or low == 0 else low


def plan(sized: DataFrame, targets: DataFrame, seed: int = SEED, total: int | None = None) -> DataFrame:
    """(source, target_share, cap, cdf) of each listed source; without documents or weight its cdf is empty. total: tokens
    of the mix; by default as many as FILL allows.

    Each source's rate is settled in a task of its own over BINS numbers; of a bin with one document the quantile is that
    document's. Of sources listed twice the row with the greatest share counts.
    """
    rows = targets.filter("source is not null").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("int").alias("cap"))
    listed = rows.groupBy("source").agg(F.max(F.struct("target_share", "cap")).alias("t")).select("source", "t.*")
    at = F.floor(quantile(seed) * BINS)
    hist = sized.filter("tokens > 0").groupBy("source", at.alias("bin")).agg(F.sum("tokens").alias("n"), F.min(quantile(seed)).alias("u"))
    live = hist.groupBy("source").agg(F.sum("n").alias("all")).join(listed.filter("target_share > 0 and cap > 0"), "source")
    sums = live.agg(F.sum("target_share").alias("whole"), F.min(FILL * F.col("cap") * F.col("all") / F.col("target_share")).alias("fill")).first()
    whole = sums["whole"] or 1.0
    size = (sums["fill"] or 0.0) * whole if total is None else float(total)

    def run(table: pa.Table) -> pa.Table:
        source, share, cap = (table.column(c)[0].as_py() for c in ("source", "target_share", "cap"))
        rate = settle(table.column("u").to_numpy(), table.column("n").to_numpy(), size * share / whole, cap)
        return pa.table({"source": [source], "cdf": pa.array([poisson_cdf(rate, cap)], pa.list_(pa.float64()))})

    bins = hist.join(live.select("source", "target_share", "cap"), "source")
    rates = bins.groupBy("source").applyInArrow(run, "source string, cdf array<double>")
    return listed.join(rates, "source", "left").select("source", "target_share", "cap", F.coalesce("cdf", F.array().cast("array<double>")).alias("cdf"))


def selection(documents: DataFrame, mix_targets: DataFrame, seed: int = SEED, total: int | None = None, folder: str = TOKENIZERS, name: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(copies, plan): doc_id, source, copy (from 1), tokens, place in random order; and the plan as a table."""
    listed = mix_targets.select("source").filter("source is not null").distinct()
    used = documents.join(F.broadcast(listed) if listed.count() <= 10_000 else listed, "source", "left_semi")
    sized = written(tokens(used, folder, name), "tokens")
    table = written(plan(sized, mix_targets, seed, total), "rates")
    u = quantile(seed)
    counted = sized.filter("tokens > 0").withColumn("u", u).join(F.broadcast(table) if table.count() <= 10_000 else table, "source")
    times = F.size(F.filter("cdf", lambda c: c < F.col("u")))
    chosen = counted.withColumn("times", times).filter("times > 0")
    each = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    return each.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed + 1))), table


def mix(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    """The selection with its repeats in random order: place, doc_id, copy, source, tokens."""
    chosen, _ = selection(documents, mix_targets, **options)
    return chosen.select("place", "doc_id", "copy", "source", "tokens").orderBy("place", "doc_id", "copy")


def shares(documents: DataFrame, mix_targets: DataFrame, **options) -> DataFrame:
    """For each listed source the share aimed at and the share reached, in documents, copies and tokens."""
    chosen, table = selection(documents, mix_targets, **options)
    got = chosen.groupBy("source").agg(F.sum((F.col("copy") == 1).cast("int")).alias("docs"), F.count("*").alias("copies"), F.max("copy").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    both = table.select("source", "target_share", F.col("cap").alias("max_repeats")).join(got, "source", "left").na.fill(0)
    whole = both.agg(F.sum("tokens").alias("all"))
    return both.join(F.broadcast(whole)).withColumn("share", F.when(F.col("all") > 0, F.round(F.col("tokens") / F.col("all"), 6)).otherwise(0.0)).drop("all")
