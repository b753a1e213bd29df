"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected copies are target / source size (times its own weight, if a
weight column is given); the whole part is certain, and the rest is drawn by Pareto order sampling: with u uniform from a
keyed hash, documents are ranked by (u / (1 - u)) / (p / (1 - p)), p being the inclusion probability, and the least ranks are
taken until the words wanted are reached. The cut is found by two histograms of the ranks for all sources at once, so no source is ever
sorted in one task. The same seed gives the same sample; rows with the same id and text share their rank.

Defined results: null text has size 0; the null source is a source of its own and comes last; a source of size 0 has target 0
and nothing is taken; an empty table gives an empty result; further columns are ignored (mix) or kept (take_copies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, quoted, settle, small, spare

#: Bins of a histogram of ranks; two levels tell apart BINS**2 ranks.
BINS = 4096
#: The targets are worked out on the driver from one number per source; more sources than this are refused.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: Sequence[float], budget: float, most: float = 2.0) -> list[float]:
    """Shares of the budget by weight; a source stops at `most` times its size, and the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = min(budget, most * sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = most * sizes[i]
            open_.discard(i)
        left -= sum(out[i] for i in over)
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, weight_col: str | None = None) -> DataFrame:
    """id, source, size (words), weight, u in (0, 1)."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    draw = F.xxhash64(F.lit(seed), F.col(quoted(id_col)), F.xxhash64(text))
    return docs.select(
        F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (F.col(quoted(weight_col)).cast("double") if weight_col else F.lit(1.0)).alias("weight"), ((F.shiftrightunsigned(draw, 12).cast("double") + 0.5) / float(1 << 52)).alias("u"),
    )


def _cut(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source the rank t (in [0, 1)) below which the sizes sum to about the words wanted: columns k, cut."""
    one = F.floor(F.col("t") * BINS).cast("int")
    two = F.floor((F.col("t") * BINS - F.floor(F.col("t") * BINS)) * BINS).cast("int")

    def crossing(hist: DataFrame, goal: DataFrame) -> DataFrame:
        """The bin in which the running sum reaches the goal, what is still wanted there, and what the bin holds. A source has BINS bins at most."""
        bins = hist.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("bin", "words"))).alias("bins"))
        none = F.lit(0).cast("long")
        start = F.struct(none.alias("sum"), F.lit(BINS).alias("bin"), none.alias("before"), none.alias("holds"))

        def step(a, x):
            open_, reached = a["bin"] == BINS, a["sum"] + x["words"] >= F.col("goal")
            here = open_ & reached
            return F.struct((a["sum"] + x["words"]).alias("sum"), F.when(here, x["bin"]).otherwise(a["bin"]).alias("bin"), F.when(open_ & ~reached, a["sum"] + x["words"]).otherwise(a["before"]).alias("before"), F.when(here, x["words"]).otherwise(a["holds"]).alias("holds"))

        walk = F.aggregate("bins", start, step)
        return bins.join(goal, "k").select("k", "goal", walk.alias("w")).select("k", F.col("w.bin").alias("at"), (F.col("goal") - F.col("w.before")).alias("goal"), F.col("w.holds").alias("holds"))

    first = settle(crossing(ranked.groupBy("k", one.alias("bin")).agg(F.sum("size").alias("words")), wanted), "cut")
    inside = ranked.join(F.broadcast(first.drop("holds")), "k").filter(one == F.col("at"))  # one row per source: bounded by MOST_SOURCES
    second = crossing(inside.groupBy("k", two.alias("bin")).agg(F.sum("size").alias("words")), first.select("k", "goal"))
    cut = first.select("k", F.col("at").alias("a")).join(second.select("k", F.col("at").alias("b"), F.col("goal").alias("rest"), "holds"), "k", "left")
    # the bin that crosses is taken if that ends nearer to the goal; no bin crosses: all are wanted
    taken = F.when((F.col("rest") > 0) & (2 * F.col("rest") >= F.col("holds")), 1).otherwise(0)
    whole = (F.col("a").cast("double") + (F.coalesce(F.col("b"), F.lit(0)) + taken) / F.lit(float(BINS))) / BINS
    return cut.select("k", F.when(F.col("a") >= BINS, F.lit(2.0)).otherwise(whole).alias("cut"))


def mix(docs: DataFrame, weights: Sequence[float], share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken."""
    marks = settle(sized(docs, id_col, text_col, source_col, seed, weight_col), "sizes")
    per_source = marks.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("weight") * F.col("size")).alias("weighed"))
    found = per_source.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in found]
    goals = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share * sum(sizes), most)
    rate = [g / r["weighed"] if r["weighed"] else 0.0 for g, r in zip(goals, found, strict=True)]
    table = docs.sparkSession.createDataFrame([(i, r["source"], r["source_size"], g, q) for i, (r, g, q) in enumerate(zip(found, goals, rate, strict=True))], "k int, name string, source_size long, target double, rate double")
    joined = marks.join(F.broadcast(table), marks["source"].eqNullSafe(table["name"])).drop("name")
    expected = F.least(F.lit(most), F.col("rate") * F.col("weight"))
    certain = joined.withColumn("certain", F.floor(expected)).withColumn("p", F.least(expected - F.floor(expected), F.lit(1 - 1e-9)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    ranked = certain.withColumn("t", F.when(F.col("p") > 1e-9, odds / (1 + odds)))
    goal = certain.groupBy("k", "target").agg(F.sum(F.col("certain") * F.col("size")).alias("sure")).select("k", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")).alias("goal"))
    cut = settle(_cut(ranked.filter(F.col("t").isNotNull()), settle(goal, "goals")), "cuts")
    drawn = ranked.join(F.broadcast(cut), "k", "left").withColumn("copies", (F.col("certain") + F.when(F.col("t") < F.col("cut"), 1).otherwise(0)).cast("long"))
    return drawn.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "u")


def take_copies(docs: DataFrame, mixed: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as mix() takes it. Rows are recognised by id and rank, and rows alike in both are alike in copies."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(quoted(id_col)), F.xxhash64(text))
    u = (F.shiftrightunsigned(key, 12).cast("double") + 0.5) / float(1 << 52)
    draw, i, source, rank, times, again = (spare(x, docs) for x in ("_draw", "_id", "_source", "_u", "_copies", "_again"))
    copies = settle(mixed.select("id", "source", "u", "copies").distinct().toDF(i, source, rank, times), "copies-of")
    keyed = docs.withColumn(draw, u)
    got = keyed.join(small(copies), F.col(quoted(id_col)).eqNullSafe(F.col(i)) & (F.col(draw) == F.col(rank)) & F.col(quoted(source_col)).eqNullSafe(F.col(source)))
    return got.filter(F.col(times) > 0).withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*(F.col(quoted(c)) for c in docs.columns))
