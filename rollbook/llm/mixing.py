"""Mixing sources to target weights by entropy balancing.

Rates start at one copy of each document. Among all rates in (0, 2) that meet each source's token target, those nearest
to one (in the entropy of a bounded rate) are 2 / (1 + exp(-tilt * size)), with one tilt for each source: the dual
variable of its token constraint. Newton steps on the convex dual, one aggregation each, find the tilts. Rates are then
rounded into copies.

Documents with the same source and size have the same rate, so all steps but the first and the last work on a
histogram of (source, size). A source with a third of all rows has no more histogram rows than distinct sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import settled, written

WORD_BREAK = "[\\x20\\x09-\\x0D]+"
#: No document is taken more often.
MOST_COPIES = 2
#: Documents of one source, size and hash bucket that are ranked together.
RANKED_TOGETHER = 256


def n_words(text: str) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text column; null: 0."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), WORD_BREAK), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5) -> DataFrame:
    """(src, source, source_size, target): each source's number in code point order (null last), tokens and target.

    Sources get weights in turn and share `total` times all tokens by weight; a target stops at MOST_COPIES times its
    source's tokens and the excess is reshared. In order of cap / weight, the level at which nothing more is above its
    cap is the first (total - caps so far) / (weights left) that is below the next cap / weight.
    The table has one row for each source, and the windows run over these rows alone.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(turn).cast("long") - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", MOST_COPIES * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", "src")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("full_at") * (1 + 1e-12), F.struct("full_at", "src", "level"))).over(everything)["level"]
    return per.withColumn("t", F.least(F.col("cap"), F.col("w") * F.coalesce(first, F.lit(float("inf"))))).select("src", "source", "source_size", F.col("t").alias("target"))


def tilts(cells: DataFrame, goal: DataFrame, tolerance: float = 1e-9, most_steps: int = 120) -> DataFrame:
    """(src, tilt, scale): the dual variable of each source's constraint.

    cells: src, size, n. A Newton step that leaves the interval known to hold the solution is replaced by its middle
    (or by doubling, where one end is still open). Sources at their cap, or without tokens, have no finite tilt and
    are not iterated. Steps end when every constraint is met to `tolerance`, or after most_steps.
    """
    scale = cells.groupBy("src").agg(F.try_divide(F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")), F.sum(F.col("n") * F.col("size").cast("double"))).alias("scale"))
    open_ = goal.join(scale, "src").where("scale > 0 and target > 0 and target < source_size * %s * (1 - 1e-9)" % MOST_COPIES)
    inf = F.lit(float("inf"))
    state = written(open_.select("src", "target", "scale", F.lit(0.0).alias("tilt"), F.when(F.col("target") < F.col("source_size"), -inf).otherwise(F.lit(0.0)).alias("lo"), F.when(F.col("target") > F.col("source_size"), inf).otherwise(F.lit(0.0)).alias("hi")), "tilts")
    for step in range(most_steps):
        rate = MOST_COPIES / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))))
        tokens = F.col("n") * F.col("size").cast("double")
        now = cells.join(state, "src").withColumn("rate", rate).groupBy("src", "target", "scale", "tilt", "lo", "hi").agg(
            F.sum(tokens * F.col("rate")).alias("got"),
            F.sum(tokens * F.col("size") / F.col("scale") * F.col("rate") * (1 - F.col("rate") / MOST_COPIES)).alias("slope"))
        now = now.withColumn("lo", F.when(F.col("got") <= F.col("target"), F.greatest("lo", "tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("got") >= F.col("target"), F.least("hi", "tilt")).otherwise(F.col("hi")))
        newton = F.col("tilt") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        inner = F.when(F.col("hi") == inf, F.greatest(F.lit(1.0), F.col("lo") * 2)).when(F.col("lo") == -inf, F.least(F.lit(-1.0), F.col("hi") * 2)).otherwise((F.col("lo") + F.col("hi")) / 2)
        now = now.withColumn("newton", newton)
        held = F.lit(step < most_steps // 3) & F.col("newton").isNotNull() & ~F.isnan("newton") & (F.col("newton") >= F.col("lo")) & (F.col("newton") <= F.col("hi"))
        ahead = F.when(F.abs(F.col("got") / F.col("target") - 1) <= tolerance, F.col("tilt")).when(held, F.col("newton")).otherwise(inner)
        state = written(now.select("src", "target", "scale", ahead.alias("tilt"), "lo", "hi", F.abs(F.col("got") / F.col("target") - 1).alias("off")), "tilts")
        off = state.agg(F.max("off")).first()[0]
        state = state.drop("off")
        if off is None or off <= tolerance:
            break
    if off is not None and off > 1e-6:
        raise ArithmeticError(f"a source's target is missed by {off:.2g} of it after {most_steps} steps")
    return state.select("src", "tilt", "scale")


def cell_copies(cells: DataFrame, goal: DataFrame, tilt: DataFrame, mends: int = 3) -> DataFrame:
    """(src, size, n, copies): how many copies the n documents of a cell have together, at most MOST_COPIES * n.

    Expected copies are rounded along the sizes of a source so that the running sum is off by less than one document.
    Each mend then adds or takes one copy of the size nearest to what a source still lacks or has too much.
    """
    x = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))
    rate = F.when(F.col("tilt").isNotNull(), MOST_COPIES / (1 + F.exp(-x))).when(F.col("target") > 0, F.lit(float(MOST_COPIES))).otherwise(F.lit(1.0))
    rated = cells.join(goal.select("src", "target"), "src").join(tilt, "src", "left").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    along = Window.partitionBy("src").orderBy("size")
    run = F.round(F.sum(F.col("n") * F.col("rate")).over(along), 6)
    out = rated.withColumn("run", F.floor(run + 0.5)).withColumn("copies", F.col("run") - F.coalesce(F.lag("run").over(along), F.lit(0)))
    out = out.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("copies"), MOST_COPIES * F.col("n"))).cast("long")).select("src", "size", "n", "target", "copies")
    out = written(out, "cells")
    for _ in range(mends):
        lack = out.groupBy("src").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("lack"))
        able = out.join(lack, "src").where("size > 0 and ((lack > 0 and copies < %s * n) or (lack < 0 and copies > 0)) and abs(abs(lack) - size) < abs(lack)" % MOST_COPIES)
        pick = able.groupBy("src").agg(F.min_by(F.struct("size", F.signum("lack").alias("sign")), F.struct(F.abs(F.abs("lack") - F.col("size")), F.col("size"))).alias("p")).select("src", F.col("p.size").alias("size"), F.col("p.sign").cast("long").alias("sign"))
        out = written(out.join(pick, ["src", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("sign", F.lit(0))).drop("sign"), "cells")
    return out.select("src", "size", "n", "copies")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each document, written in the shared folder; copies is 0, 1 or 2.

    Null text has size 0; null source is a source of its own, the last; a null doc_id is a document. Documents without
    words get one copy. Repeated rows are documents of their own, and which of them has more copies makes no
    difference to the result. Reruns agree: nothing random is drawn, ties go by a hash of doc_id. An empty table gives
    an empty table. Other columns are not looked at.
    """
    return settled(lambda: _mix(docs, weights, total), "mixed")


def _mix(docs: DataFrame, weights: tuple[float, ...], total: float) -> DataFrame:
    sizes = docs.select("doc_id", "source", n_words("text").alias("size"))
    sizes = written(sizes, "sizes")
    goal = written(targets(sizes, weights, total), "targets")
    keyed = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select("doc_id", "src", sizes["source"], "size", "source_size", "target")
    cells = written(keyed.groupBy("src", "size").agg(F.count("*").alias("n")), "cells")
    copies = cell_copies(cells, goal, tilts(cells, goal))
    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = F.ceil(F.col("n") / RANKED_TOGETHER)
    placed = keyed.join(copies, ["src", "size"]).withColumn("order", order).withColumn("part", F.pmod("order", parts))
    each = placed.groupBy("src", "size", "part").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("copies").alias("copies"))
    cell = Window.partitionBy("src", "size").orderBy("part")
    extra = F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n")
    each = each.withColumn("cum", F.sum("k").over(cell)).withColumn("base", F.floor(F.col("copies") / F.col("n"))).withColumn("up", F.floor(extra * F.col("cum") / F.col("n")) - F.floor(extra * (F.col("cum") - F.col("k")) / F.col("n"))).select("src", "size", "part", "base", "up")
    rank = F.row_number().over(Window.partitionBy("src", "size", "part").orderBy("order", "doc_id"))
    got = placed.drop("n", "copies").join(each, ["src", "size", "part"]).withColumn("copies", F.col("base") + (rank <= F.col("up")).cast("long"))
    return got.select("doc_id", "source", "size", "source_size", "target", "copies")
