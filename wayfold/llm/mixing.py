"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's share of the tokens, raised to an exponent between 0 (all alike) and 1 (as they come)
and normalised, is its weight. The exponent is bracketed step by step until the weights have a
target entropy or no source is read more often than a limit. A budget of tokens is then realised:
each source gives whole passes over its documents and a part of one more, and every pass goes
through the source's blocks, and the documents of a block, in an order of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.operators.ordered import running
from wayfold.session import cut

#: Documents per block, and the most hex digits of a block's name (65,536 blocks a source).
BLOCK_DOCS, BLOCK_DIGITS = 1024, 4
SECTIONS, ROUNDS = 64, 5


def words(text: Column) -> Column:
    """Number of words: runs of anything but white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("bigint")


def bracket(shares: DataFrame, holds) -> tuple[float, float]:
    """Narrows [0, 1] to the place where ``holds`` turns from true to false.

    ``shares`` has one column p > 0. ``holds(a)`` is a condition on the columns a (exponent), z (sum
    of p^a), s (sum of p^a ln p) and m (largest (a - 1) ln p). Each round evaluates equally spaced
    exponents in one small grouped job and brings that many rows to the driver."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = F.explode(F.array(*[F.lit(lo + (hi - lo) * i / SECTIONS) for i in range(SECTIONS + 1)])).alias("a")
        rows = (shares.select("p", grid).groupBy("a").agg(F.sum(F.exp(F.col("a") * F.log("p"))).alias("z"), F.sum(F.exp(F.col("a") * F.log("p")) * F.log("p")).alias("s"),
                                                        F.max((F.col("a") - 1) * F.log("p")).alias("m"))
                .select("a", holds().alias("ok")).collect())
        good = [r["a"] for r in rows if r["ok"]]
        bad = [r["a"] for r in rows if not r["ok"]]
        if not good:
            return lo, lo
        if not bad:
            return hi, hi
        lo, hi = max(good), min(bad)
    return lo, hi


def weights(docs: DataFrame, source: str, tokens: str, budget_share: float = 1.0, entropy_share: float | None = None, max_repeats: float | None = None,
            widen: bool = False) -> DataFrame:
    """One row per source: _s (its key), rows, have (tokens), exponent, weight and quota (tokens to give).

    The budget is ``budget_share`` of all tokens. The exponent is the largest in [0, 1] whose
    weights keep ``entropy_share`` of the largest possible entropy; it is raised as far as needed
    for no source to be repeated more than ``max_repeats`` times, and quotas end there even where
    the natural shares already ask for more. Without either target it is 1. Sources without tokens
    get weight 0.

    With both targets and ``widen`` the budget grows to the largest share, all tokens at most, at
    which they are met together. Sources whose own shares meet the entropy then give all they have."""
    stats = cut(docs.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("rows"), F.sum(tokens).alias("have")))
    total = stats.agg(F.sum("have").alias("t"), F.sum((F.col("have") > 0).cast("int")).alias("n")).head()
    all_tokens, kinds = total["t"] or 0, total["n"] or 0
    shares = stats.filter("have > 0").select((F.col("have") / F.lit(float(all_tokens or 1))).alias("p"))
    exponent = 1.0
    if kinds and entropy_share is not None:
        target = entropy_share * math.log(kinds)
        exponent = bracket(shares, lambda: F.log("z") - F.col("a") * F.col("s") / F.col("z") >= target - 1e-12)[0]
        if widen and max_repeats is not None:
            # The source that is read most often, relative to its size, bounds the budget.
            p = F.col("p")
            top = shares.agg((F.sum(F.pow(p, F.lit(exponent))) * max_repeats / F.max(F.pow(p, F.lit(exponent - 1)))).alias("b")).head()["b"] if exponent < 1 else max_repeats
            budget_share = max(budget_share, min(1.0, top))
    if kinds and max_repeats is not None:
        limit = max_repeats / budget_share
        low = bracket(shares, lambda: F.exp("m") / F.col("z") > limit * (1 + 1e-12))[1]
        exponent = low if entropy_share is None else max(exponent, low)
    power = F.when(F.col("have") > 0, F.pow(F.col("have") / F.lit(float(all_tokens or 1)), F.lit(exponent))).otherwise(0.0)
    mass = stats.agg(F.sum(power).alias("z")).head()["z"] or 1.0
    quota = F.floor(power / mass * all_tokens * budget_share + 1e-6)
    if widen and exponent == budget_share == 1:
        quota = F.col("have")
    if max_repeats is not None:
        quota = F.least(quota, F.floor(F.col("have") * F.lit(max_repeats)))
    return stats.select("_s", "rows", "have", F.lit(exponent).alias("exponent"), (power / mass).alias("weight"), quota.cast("bigint").alias("quota"))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", budget_share: float = 1.0, entropy_share: float | None = None, max_repeats: float | None = None,
        seed: int = 1, widen: bool = False) -> DataFrame:
    """The rows of ``docs`` as often as the mixture reads them, with epoch, block, tokens, exponent
    and weight.

    A null source is a source of its own. The last, partial pass over a source takes documents in
    its order until the quota is reached; the document that crosses it is still taken. Documents
    without words cost nothing and follow the same rule. Rows that repeat an id are separate
    documents. No document is read more than max_repeats times, rounded up. Columns of ``docs``
    may have any names but epoch, block, tokens, exponent, weight and names that begin with _mix."""
    key = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select("*", key.alias("_mix_s"), words(F.col(text)).alias("tokens"), F.md5(name.cast("binary")).alias("_mix_id"))
    given = cut(weights(rows, "_mix_s", "tokens", budget_share, entropy_share, max_repeats, widen).withColumnRenamed("_s", "_mix_s"))
    digits = F.lit(0)
    for d in range(1, BLOCK_DIGITS + 1):
        digits = digits + (F.col("rows") > BLOCK_DOCS * 16 ** (d - 1)).cast("int")
    passes = F.when(F.col("have") > 0, F.floor(F.col("quota") / F.col("have"))).otherwise(0)
    plan = given.select("_mix_s", "exponent", "weight", digits.alias("_mix_digits"), passes.alias("_mix_full"), (F.col("quota") - passes * F.col("have")).alias("_mix_rest"))
    joined = rows.join(plan, "_mix_s").withColumn("block", F.expr("substring(_mix_id, 1, _mix_digits)"))
    own = [*docs.columns, "epoch", "block", "tokens", "exponent", "weight"]
    whole = joined.filter("_mix_full > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, cast(_mix_full as bigint) - 1)"))).select(own)
    # The partial pass needs a running sum; it is taken over narrow rows, block by block.
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_mix_full").cast("string"), F.col("_mix_s"), F.col("block")).cast("binary"))
    inside = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_mix_full").cast("string"), F.col("_mix_id")).cast("binary"))
    part = joined.filter("_mix_rest > 0").withColumn("epoch", F.col("_mix_full").cast("bigint"))
    narrow = part.select("_mix_s", "_mix_id", "tokens", "_mix_rest", at.alias("_mix_at"), inside.alias("_mix_in"))
    spent = running(cut(narrow), ["_mix_s"], ["_mix_at", "_mix_in", "tokens"], {"before": (F.col("tokens"), "sum")}, F.col("_mix_at"), exclusive=True)
    # All rows before the border are taken: the border of a source is one (place, id) pair.
    border = spent.filter("before < _mix_rest").groupBy("_mix_s").agg(F.max(F.struct("_mix_at", "_mix_in")).alias("_mix_end"))
    taken = part.join(border, "_mix_s").filter(F.struct(at.alias("_mix_at"), inside.alias("_mix_in")) <= F.col("_mix_end")).select(own)
    return whole.unionByName(taken)
