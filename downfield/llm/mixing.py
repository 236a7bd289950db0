"""Mixing sources to target weights by Pareto order sampling (operator 11).

A source's target divided by its size says how many copies of each of its documents the mix wants. The whole part
is certain: every document gets so many copies. The rest is an inclusion probability, and one more copy goes to a
sample: documents are ranked by their random odds divided by their inclusion odds, and the sample is the first of
them whose sizes fill what the whole copies leave of the target.

All steps are column expressions. The cut of a source is found by adding up sizes by leading digits of the rank,
and only rows that share the digits of the cut are ordered, so no task holds a source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .numbering import numbered

WORD = r"[^\x20\x09-\x0D]+"
RANK_BITS, DIGIT_BITS, DIGITS = 52, 13, 2
CHUNK = 4096  # equal rows written by one step of the last expansion


def mark(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> Column:
    """A digest of id, source and text; rows that agree in all three are repeats of one document."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (doc_id, source, text)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark, rows): each different document once, with the number of its rows. Stored.

    The size is the number of words, 0 for a null text.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select("doc_id", "source", size.alias("size"), mark().alias("mark"))
    return stored(rows.groupBy("doc_id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("rows")), "measured")


def cyclic_weights(units: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): the weights dealt in turn to the sources by code point, null last."""
    names = units.select("source").distinct()
    ranked = numbered(names, [], [F.col("source").isNull(), F.col("source")], "source-order")
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    return ranked.select("source", dealt.alias("weight"))


def targets(units: DataFrame, weights: DataFrame, share: float, most: int) -> DataFrame:
    """(source, source_size, target): `share` of all sizes dealt by weight, at most `most` times a source's size.

    What a bound cuts off goes to the other sources by weight until none exceeds its bound. A round is one sum
    over the sources; a source bounded once stays so. Sources without a weight count as weight 0.
    """
    sums = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    sources = stored(
        sums.join(weights.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        .select("source", "source_size", F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight")),
        "source-sizes",
    )
    bound = (most * F.col("source_size")).cast("double")
    budget = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = 0.0
    while True:
        free = F.col("weight") * level < bound
        row = sources.agg(
            F.coalesce(F.sum(F.when(~free, bound)), F.lit(0.0)).alias("bounded"),
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        higher = (share * budget - row["bounded"]) / row["weight"] if row["weight"] > 0 else level
        if higher <= level:
            break
        level = higher
    return sources.select("source", "source_size", F.least(F.col("weight") * level, bound).alias("target"))


def _ranked(units: DataFrame, goals: DataFrame) -> DataFrame:
    """The units with their source's goal, and the rank of random odds divided by inclusion odds as an integer."""
    scale = float(1 << RANK_BITS)
    draw = (F.conv(F.substring("mark", 1, RANK_BITS // 4), 16, 10).cast("long").cast("double") + 0.5) / scale
    odds = (F.col("draw") / (1 - F.col("draw"))) / (F.col("chance") / (1 - F.col("chance")))
    rank = F.floor(F.col("odds") / (1 + F.col("odds")) * scale)
    return (
        units.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        .withColumn("draw", draw)
        .withColumn("odds", F.when(F.col("chance") > 0, odds))
        .withColumn("rank", F.when(F.col("chance") > 0, rank))
        .drop("draw", "odds")
    )


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def cuts(ranked: DataFrame) -> DataFrame:
    """Per source with a chance: the first unit that does not fit (cut_rank, cut_mark), how many of its rows do
    (cut_rows), and the unit beyond whose size comes nearest to what is then left (fill_mark), if it helps.

    Zero-sized documents and sources without a chance have no part in it.
    """
    sized = ranked.where((F.col("size") > 0) & F.col("rank").isNotNull())
    amount = F.col("size") * F.col("rows")
    open_, before = sized, sized.select("source").distinct().withColumn("before", F.lit(0))
    for digit in range(1, DIGITS + 1):
        step = F.shiftright("rank", RANK_BITS - digit * DIGIT_BITS)
        sums = open_.groupBy("source", step.alias("step")).agg(F.sum(amount).alias("amount"), F.max("rest").alias("rest"))
        upto = F.sum("amount").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
        crossed = _same_source(sums.withColumn("upto", upto), before).withColumn("upto", F.col("before") + F.col("upto"))
        first = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("step", (F.col("upto") - F.col("amount")).alias("before"))))
        found = stored(crossed.groupBy("source").agg(first.alias("first")).select("source", "first.*"), "cut")
        before = found.drop("step")
        open_ = _same_source(sized, found.select("source", F.col("step").alias("at"))).where(step == F.col("at")).drop("at")
    # the last digit leaves about one row in 2 ** 26 of a source
    ordered = Window.partitionBy("source").orderBy("rank", "mark").rowsBetween(Window.unboundedPreceding, 0)
    upto = _same_source(open_.withColumn("upto", F.sum(amount).over(ordered)), before)
    upto = upto.withColumn("upto", F.col("before") + F.col("upto")).where(F.col("upto") > F.col("rest"))
    left = F.col("rest") - (F.col("upto") - amount)
    cut = upto.withColumn("fits", F.floor(left / F.col("size"))).withColumn("gap", left - F.col("fits") * F.col("size"))
    names = ["rank", "mark", "fits", "gap"]
    cut = stored(
        cut.groupBy("source").agg(F.min(F.struct(*names)).alias("cut"))
        .select("source", *[F.col(f"cut.{n}").alias(f"cut_{n}") for n in names]), "cut",
    )
    away = F.abs(F.col("cut_gap") - F.col("size"))
    beyond = _same_source(sized, cut).where(
        (F.struct("rank", "mark") >= F.struct("cut_rank", "cut_mark")) & (away < F.col("cut_gap"))
    )
    fill = beyond.groupBy("source").agg(F.min(F.struct(away.alias("away"), "rank", "mark"))["mark"].alias("fill_mark"))
    # stored, so that its size is known and a join with it need not deal out the units by source
    return stored(_same_source(cut.withColumnRenamed("cut_fits", "cut_rows").drop("cut_gap"), fill, "left"), "cut")


def mixture(
    documents: DataFrame, weights: tuple[float, ...] | DataFrame = (3, 1, 2), share: float = 1.5, most: int = 2
) -> DataFrame:
    """(doc_id, source, size, mark, rows, source_size, target, whole, more): what the mix takes of each document.

    Each of the `rows` equal rows of a document is taken `whole` times, and `more` of them once more. `weights` is a
    table (source, weight) or weights dealt in turn to the sources by code point, null last; null is a source like
    others. The words taken of a source differ from its target by less than the size of its document that crosses
    the target, mostly by far less: the gap goes to the document that fills it best. No document is taken more than
    `most` times. The draw is a digest of id, source and text, so reruns agree, whatever the order of the rows.

    Null and empty texts have size 0 and stay, taken or not. Rows equal in id, source and text are one document here,
    with other columns ignored; null ids and ids with several texts are documents like others. Very long texts may be
    the one document of a source, which is then taken in whole copies as near the target as these come. An empty
    table gives no rows.
    """
    units = measured(documents)
    by_source = weights if isinstance(weights, DataFrame) else cyclic_weights(units, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = targets(units, by_source, share, most).withColumn("whole", F.floor(ratio)).withColumns(
        {"rest": F.col("target") - F.col("whole") * F.col("source_size"), "chance": ratio - F.col("whole")}
    )
    ranked = _ranked(units, stored(goals, "goals"))
    here, cut = F.struct("rank", "mark"), F.struct("cut_rank", "cut_mark")
    more = (
        F.when(F.col("rank").isNull(), 0).when(F.col("cut_rank").isNull() | (here < cut), F.col("rows"))
        .when(here == cut, F.col("cut_rows")).otherwise(0)
    )
    filled = F.when(F.col("mark") == F.col("fill_mark"), 1).otherwise(0)
    return _same_source(ranked, cuts(ranked), "left").select(
        "doc_id", "source", "size", "mark", "rows", "source_size", "target", "whole",
        (more + filled).cast("long").alias("more"),
    )


def per_row(mix: DataFrame) -> DataFrame:
    """The mixture with one line per row of the documents, and `copies`, how often the mix takes that row."""
    names = [c for c in mix.columns if c not in ("rows", "whole", "more")]
    single = mix.where("rows = 1").select(*names, (F.col("whole") + F.col("more")).alias("copies"))
    chunks = mix.where("rows > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / CHUNK))))
    last = F.least((F.col("chunk") + 1) * CHUNK, F.col("rows"))
    numbers = chunks.repartition("mark", "chunk").withColumn("number", F.explode(F.sequence(F.col("chunk") * CHUNK + 1, last)))
    one_more = F.when(F.col("number") <= F.col("more"), 1).otherwise(0)
    return single.unionByName(numbers.select(*names, (F.col("whole") + one_more).alias("copies")))


def mixed_documents(documents: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents as the mix takes them, each row as often as it is taken, with all their columns.

    Rows equal in id, source and text come with the other columns of any one of them.
    """
    columns = [F.col(f"document.`{c}`") for c in documents.columns]
    taken = mix.select(F.col("mark").alias("of"), "rows", (F.col("whole") * F.col("rows") + F.col("more")).alias("copies"))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("document"), mark().alias("mark"))
    found = rows.join(taken.where("copies > 0"), F.col("mark") == F.col("of"))
    repeated = found.where("rows > 1").dropDuplicates(["mark"])
    parts = [found.where("rows = 1"), repeated]
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return reduce(DataFrame.unionByName, [p.withColumn("copy", copies) for p in parts]).select(*columns)
