"""Mixing sources to target weights by entropy balancing.

The mix gives document i a rate r_i: how often it is repeated.  Among all rates that give every
source its target of words, entropy balancing picks those with the least token-weighted divergence
from the base rates q_i, and it also wants the mix to keep the corpus's shares of words by length
class (doublings of the size), so that a source that is cut does not lose its long or short documents
alone.  Sources hold exactly; classes give way at a price, since both together may be out of reach.

The dual is convex, with a multiplier a_s a source and b_c a class: r_i = min(cap, q_i * exp(a_s + b_c)).
Newton steps run as aggregations over a table of (source, class, base) sums.  A source's own second
derivative is one number, so sources are eliminated where they are, on the cluster; what is left is a
system over at most 64 classes.  A step that does not lower the dual is halved.  Rates become whole
copies by carrying the rounding error from large to small documents inside bounded chunks of a source.

Nulls: a null text has size 0; a null source is a source of its own and comes last.  Empty tables
give empty results.  Repeated rows count and are taken separately; columns of other names are kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_rank
from ..session import broadcast_small, cut_lineage
from .common import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Length classes: the doublings of a size below 2 ** 63.
CLASSES = 64
#: Price of a class that misses its share: a miss of this part of its words moves its rates by a factor e.
SOFTNESS = 0.1


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, docs, source_size, target): ``share`` of all words dealt by weight, in code point
    order of the sources, none above ``cap`` times its size; what is cut is dealt again by weight."""
    per = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = ordered_rank(per, [F.col("source").isNull(), F.col("source")], name="_k")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_k") - 1) % len(weights) + 1).cast("int"))
    per = cut_lineage(ranked.withColumn("_w", w).withColumn("_most", cap * F.col("source_size")))
    whole = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and each round caps another source or ends
        over = F.col("_w") * F.lit(level) > F.col("_most")
        capped, free = per.agg(F.sum(F.when(over, F.col("_most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        new = (whole - capped) / free if free else level
        if not free or new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "docs", "source_size", F.least(F.col("_w") * F.lit(level), F.col("_most")).alias("target"))


def length_class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double") + 1)).cast("int")


@dataclass
class Balance:
    """``sources``: source, multiplier (null: every document at the cap).  ``classes``: a multiplier each.
    ``steps`` Newton steps were taken; ``gap`` is the largest miss of a source, as a share of its target,
    and ``trace`` the dual's value before each step and at the end."""

    sources: DataFrame
    classes: np.ndarray
    steps: int
    gap: float
    trace: list[float]


def balanced_rates(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, softness: float = SOFTNESS, rounds: int = 100, tolerance: float = 1e-10) -> Balance:
    """Multipliers that solve the dual for documents (source, size, base), from zero on.

    Documents of a source, class and base rate are summed first, so a step reads few rows and a source
    with a third of all rows is not hot; a source's sums are then at most 64 rows.  A source whose target
    takes all it may give has no multiplier.  Multipliers are rounded to 8 digits, so that the order of
    summation does not show in the rates.
    """
    cells = cut_lineage(sizes.filter("size > 0 and base > 0").groupBy("source", length_class(F.col("size")).alias("class"), "base").agg(F.sum("size").alias("words")))
    goal = targets.select(F.col("source").alias("_s"), "target")
    able = cells.groupBy("source").agg((F.sum("words") * F.lit(float(cap))).alias("_most"))
    state = cut_lineage(
        able.join(goal, able.source.eqNullSafe(goal._s))
        .filter("target > 0")
        .select("source", "target", (F.col("target") >= F.col("_most") * (1 - 1e-12)).alias("full"), F.lit(0.0).alias("multiplier"))
    )
    b = np.zeros(CLASSES)
    whole = state.agg(F.sum("target")).first()[0]
    if whole is None:
        return Balance(state.select("source", "multiplier"), b, 0, 0.0, [])
    wanted = np.zeros(CLASSES)
    shares = cells.groupBy("class").agg(F.sum("words").alias("w")).collect()  # at most 64
    for r in shares:
        wanted[r["class"]] = whole * r["w"] / sum(x["w"] for x in shares)
    softened = softness * np.maximum(wanted, 1.0)

    def summed(state: DataFrame, b: np.ndarray) -> DataFrame:
        """state with, for each class, the words taken, their derivative and the dual's share."""
        known = broadcast_small(state.withColumnRenamed("source", "_s"))
        met = cells.join(known, F.col("source").eqNullSafe(F.col("_s")))
        top = F.log(F.lit(float(cap)) / F.col("base"))
        x = F.col("multiplier") + F.element_at(F.array(*[F.lit(float(v)) for v in b]), F.col("class") + 1)
        met = met.withColumn("_x", x).withColumn("_free", ~F.col("full") & (F.col("_x") < top))
        rate = F.when(F.col("_free"), F.col("base") * F.exp("_x")).otherwise(F.lit(float(cap)))
        value = F.when(F.col("_free"), F.col("base") * F.exp("_x")).when(F.col("full"), 0.0).otherwise(cap * (1.0 + F.col("_x") - top))
        by = met.groupBy("source", "class").agg(
            *[F.first(c).alias(c) for c in ("target", "full", "multiplier")],
            F.sum(F.col("words") * rate).alias("taken"),
            F.sum(F.when(F.col("_free"), F.col("words") * rate).otherwise(0.0)).alias("slope"),
            F.sum(F.col("words") * value).alias("value"),
        )
        return cut_lineage(by.groupBy("source").agg(*[F.first(c).alias(c) for c in ("target", "full", "multiplier")], F.collect_list(F.struct("class", "taken", "slope", "value")).alias("cells")))

    def arrays(own) -> tuple[np.ndarray, ...]:
        out = np.zeros((3, CLASSES))
        for c in own:
            out[:, c["class"]] = c["taken"], c["slope"], c["value"]
        return out[0], out[1], out[2]

    def measured(sums: DataFrame, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        """(dual, gradient by class, class system, largest miss), the sources eliminated."""

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dual, worst, g, h = 0.0, 0.0, np.zeros(CLASSES), np.zeros((CLASSES, CLASSES))
            for pdf in batches:
                for own, target, full, a in zip(pdf["cells"], pdf["target"], pdf["full"], pdf["multiplier"], strict=True):
                    taken, slope, value = arrays(own)
                    g += taken
                    if full:  # taken whole, whatever the multipliers: linear in those of the classes
                        dual += b @ taken
                        continue
                    dual += value.sum() - a * target
                    worst = max(worst, abs(taken.sum() - target) / target)
                    h += np.diag(slope)
                    if slope.sum() > 0:
                        g -= slope * (taken.sum() - target) / slope.sum()
                        h -= np.outer(slope, slope) / slope.sum()
            yield pd.DataFrame({"s": [np.concatenate([[dual], g, h.ravel()])], "worst": [worst]})

        row = sums.mapInPandas(part, "s array<double>, worst double").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"), F.max("worst").alias("worst")).first()
        s = np.array(row["s"])
        dual = s[0] - (b * wanted).sum() + 0.5 * (softened * b * b).sum()
        return dual, s[1 : 1 + CLASSES] - wanted + softened * b, s[1 + CLASSES :].reshape(CLASSES, CLASSES) + np.diag(softened), row["worst"]

    def moved(sums: DataFrame, step: np.ndarray, share: float) -> DataFrame:
        """Sources after a step of the classes: each answers it by its own derivative."""

        @F.pandas_udf("double")
        def answer(cells: pd.Series, target: pd.Series, full: pd.Series, a: pd.Series) -> pd.Series:
            out = []
            for own, t, f, x in zip(cells, target, full, a, strict=True):
                taken, slope, _ = arrays(own)
                # All at the cap and the target below: come down.
                d = 0.0 if f else -(taken.sum() - t + slope @ step) / slope.sum() if slope.sum() > 0 else -1.0
                out.append(x + share * min(2.0, max(-2.0, d)))
            return pd.Series(out, dtype="float64")

        return sums.select("source", "target", "full", answer("cells", "target", "full", "multiplier").alias("multiplier"))

    sums, steps, trace = summed(state, b), 0, []
    dual, g, h, worst = measured(sums, b)
    while steps < rounds and (worst > tolerance or np.abs(g).max() > tolerance * whole):
        trace.append(float(dual))
        step, share = -np.linalg.solve(h, g), 1.0
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        while True:
            tried = summed(moved(sums, step, share), b + share * step)
            after = measured(tried, b + share * step)
            if after[0] <= dual + 1e-9 * abs(dual) or share < 1e-4:
                break
            share /= 2
        sums, b, steps = tried, b + share * step, steps + 1
        dual, g, h, worst = after
    trace.append(float(dual))
    return Balance(cut_lineage(sums.select("source", F.when(~F.col("full"), F.round("multiplier", 8)).alias("multiplier"))), np.round(b, 8), steps, float(worst), trace)


def _rounded(cap: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "_r"], ascending=[False, True, True], kind="stable")
        copies, owed = np.zeros(len(pdf), dtype=np.int64), 0.0
        for i, (size, rate) in enumerate(zip(pdf["size"].tolist(), pdf["_rate"].tolist(), strict=True)):
            if size:
                owed += size * rate
                copies[i] = min(cap, max(0, int(np.floor(owed / size + 0.5))))
                owed -= copies[i] * size
            else:
                copies[i] = min(cap, int(np.floor(rate + 0.5)))
        return pdf.assign(copies=copies)[["_r", "copies"]]

    return run


def _bounded_repeats(spread: DataFrame, chunk: int) -> DataFrame:
    """Rows that share source, id and size and are more than ``chunk`` get chunks of their own, by rank.

    Which row is which does not matter among them, so reruns give the same copies per document.
    """
    keys = ["source", "doc_id", "size"]
    hot = cut_lineage(spread.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > chunk).select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    if not hot.limit(1).count():
        return spread
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys])
    repeated = spread.join(F.broadcast(hot), same, "left_semi")  # at most one key for each ``chunk`` rows
    ranked = ordered_rank(repeated.select(*keys, "_rate", "_r"), [*keys, "_rate", "_r"], name="_k")
    own = ranked.select(F.col("_r").alias("_h_r"), (-1 - F.floor((F.col("_k") - 1) / F.lit(chunk))).alias("_own"))
    return spread.join(own, F.col("_r") == F.col("_h_r"), "left").withColumn("_chunk", F.coalesce("_own", "_chunk")).drop("_h_r", "_own")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: int = 2, base: str | None = None, chunk: int = 1024, softness: float = SOFTNESS) -> tuple[DataFrame, DataFrame]:
    """(sizes, plan): ``sizes`` is the documents' stored table with a row key ``_r``; ``plan`` gives
    (_r, copies).  ``chunk`` bounds the rows that are rounded together."""
    text = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rate = F.col(base).cast("double") if base else F.lit(1.0)
    sizes = stored(docs.select("doc_id", "source", text.alias("size"), F.coalesce(rate, F.lit(1.0)).alias("base")).withColumn("_r", F.monotonically_increasing_id()), "mix-sizes")
    targets = cut_lineage(source_targets(sizes, weights, share, cap))
    balance = balanced_rates(sizes, targets, cap, softness)
    per = targets.join(balance.sources.select(F.col("source").alias("_m"), "multiplier"), targets.source.eqNullSafe(F.col("_m")), "left").drop("_m")
    per = cut_lineage(per.select(F.col("source").alias("_s"), "docs", "source_size", "target", "multiplier"))
    joined = sizes.join(per, sizes.source.eqNullSafe(per._s)).drop("_s")
    tilt = F.element_at(F.array(*[F.lit(float(x)) for x in balance.classes]), length_class(F.col("size")) + 1)
    tilted = F.when(F.col("multiplier").isNotNull(), F.col("base") * F.exp(F.col("multiplier") + tilt)).otherwise(F.lit(float(cap)))
    rates = F.when((F.col("target") > 0) & (F.col("base") > 0), F.least(tilted, F.lit(float(cap)))).otherwise(F.lit(0.0))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(chunk)))
    spread = joined.select(
        "doc_id", "source", "size", "_r", "source_size", "target",
        F.round(rates, 9).alias("_rate"), F.lit(balance.steps).cast("bigint").alias("steps"), F.lit(balance.gap).alias("gap"),
        F.pmod(F.xxhash64("doc_id", "size"), chunks).alias("_chunk"),
    )
    spread = _bounded_repeats(spread, chunk)
    plan = spread.groupBy("source", "_chunk").applyInPandas(_rounded(cap), "_r long, copies long")
    return spread, plan


def op8(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken, and the Newton steps taken
    and the largest miss of a source's target at their end, before rates are rounded."""
    spread, plan = mix(docs, **settings)
    return spread.join(plan, "_r").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "steps", "gap")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns it came with."""
    keyed = stored(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    plan = op8(keyed.select(F.col("_mix_row").alias("doc_id"), "source", "text"), **settings)
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias("_mix_key"), F.col("copies").cast("int").alias("_mix_copies"))
    repeated = keyed.join(plan, keyed._mix_row == plan._mix_key)
    return repeated.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[keyed[c] for c in docs.columns])
