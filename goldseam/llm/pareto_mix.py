"""Mixing sources to target weights by Pareto order sampling.

A source's target is a number of words. Every document first gets the whole
copies that the target allows to all of them; the rest is a sample in which a
document has inclusion probability p, higher for shorter documents, so that the
same words bring in more documents. Documents are ranked by random odds
u / (1 - u) divided by inclusion odds p / (1 - p) and taken in that order until
the next one would pass the target: the size of the sample is fixed, in words.
The last place goes to the document behind whose words come nearest to what is
still missing, so that a source misses its target by a few words only.

The order is never sorted as a whole. Ranks fall into bins, words are summed per
source and bin, and only the bin in which the target falls is looked at closely;
so a source of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, fresh, lookup, uniform, whole
from goldseam.llm.ranges import places

WORD = r"[^\x20\x09-\x0D]+"
#: Bins of ranks, looked at in groups of 2 ** STEP_BITS.
BINS, STEP_BITS = 65_536, 8


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: 'n' for no source, else 's' and the source."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def fill(order: list, by: list[str], need: Column, cap: Column, weight: Column) -> Column:
    """The level at which min(cap, level * weight) adds up to ``need`` over each group ``by``.

    Rows must come in the order of cap / weight, ascending: the first are full, and
    the level is that of the first row that is not. Null if all rows are full.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(cap).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(window.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.try_divide(need - before, rest)
    open_level = F.when(level * weight < cap, F.struct(F.row_number().over(window).alias("n"), level.alias("level")))
    return open_level


def source_targets(
    sizes: DataFrame, shares: tuple[float, ...], amount: float, ceiling: float
) -> DataFrame:
    """From one row per source (skey, source_size): the target in words of each.

    Sources in code point order, null last, weigh ``shares``, repeating. They share
    ``amount`` times all words; no target is over ``ceiling`` times its source's
    words, and what is over goes to the others by weight. One row per source, so
    the windows over all of them stay small.
    """
    numbered = Window.orderBy(F.col("skey") == "n", "skey")
    weights = F.array(*(F.lit(float(s)) for s in shares))
    everything = Window.partitionBy()
    frame = (
        sizes.withColumn("weight", F.element_at(weights, F.pmod(F.row_number().over(numbered) - 1, F.lit(len(shares))) + 1))
        .withColumn("cap", F.lit(ceiling) * F.col("source_size"))
        .withColumn("need", F.lit(amount) * F.sum("source_size").over(everything))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    frame = frame.withColumn("open", fill([F.col("ratio"), F.col("skey")], [], F.col("need"), F.col("cap"), F.col("weight")))
    level = F.min("open").over(everything)["level"]
    return frame.select(
        "skey", "source_size",
        F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"),
    )


def _measured(docs: DataFrame, key: str, text: str, source: str, names: list[str]) -> DataFrame:
    """Adds skey, size, class (of sizes, by powers of two), tie (rows of equal key, source and size) and a text's mark."""
    skey, size, kind, tie, mark = names
    out = docs.withColumn(size, word_count(F.col(text))).withColumn(skey, source_key(F.col(source)))
    out = out.withColumn(kind, F.when(F.col(size) > 0, F.floor(F.log2(F.col(size)))).otherwise(F.lit(0)).cast("int"))
    return out.withColumns({tie: F.xxhash64(F.col(key), F.col(skey), F.col(size)), mark: F.xxhash64(F.col(text))})


def _tied(measured: DataFrame, tie: str) -> DataFrame:
    """The ties that more than one row has."""
    return cut(measured.groupBy(tie).agg(F.count("*").alias("n")).filter("n > 1").select(tie))


def _drawn(rows: DataFrame, ties: DataFrame, tie: str, mark: str, u: str, seed: int) -> DataFrame:
    """Adds u, a row's random number; rows that tie are numbered by their texts' marks first.

    The numbers of a tie are the same in every run. Rows that also agree in their text are
    interchangeable.
    """
    def draw(nth: Column) -> Column:
        return uniform(F.lit(seed), F.col(tie), nth)

    if ties.isEmpty():
        return rows.withColumn(u, draw(F.lit(0).cast("long")))
    once = lookup(rows, ties, [tie], "left_anti").withColumn(u, draw(F.lit(0).cast("long")))
    many = places(cut(lookup(rows, ties, [tie], "left_semi")), tie, [mark])
    return once.unionByName(many.withColumn(u, draw(F.col("at"))).drop("at", "n"))


def _rank(u: Column, p: Column) -> Column:
    """x / (1 + x) of the Pareto rank x = odds(u) / odds(p): in [0, 1), in the same order; 0 for p = 1."""
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _crossing(bins: DataFrame, by: str) -> DataFrame:
    """Per source, the least ``by`` at which the summed words reach the need, and the words before it."""
    start = F.first("start") if "start" in bins.columns else F.lit(0)
    summed = bins.groupBy("skey", by).agg(
        F.sum("words").alias("words"), F.first("need").alias("need"), start.alias("start")
    )
    so_far = Window.partitionBy("skey").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = summed.withColumn("upto", F.col("start") + F.sum("words").over(so_far)).filter("upto >= need")
    first = F.min(F.struct(by, (F.col("upto") - F.col("words")).alias("before"), "need")).alias("at")
    return cut(upto.groupBy("skey").agg(first).select("skey", "at.*"))


def mixing_plan(measured: DataFrame, shares: tuple[float, ...], amount: float, ceiling: float) -> DataFrame:
    """Per source and size class: source_size, target, whole copies, p, and the rank up to which one more is taken."""
    classes = measured.groupBy("skey", "kind").agg(F.sum("size").cast("double").alias("words"))
    sizes = classes.groupBy("skey").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, shares, amount, ceiling).withColumn(
        "copies", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    )
    targets = cut(targets.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")))
    # Inclusion grows as 1 / (2 + class) until it is certain.
    weighed = lookup(classes, targets, ["skey"]).withColumn("gain", F.col("words") / (2 + F.col("kind")))
    weighed = weighed.withColumn(
        "open", fill([F.col("kind")], ["skey"], F.col("need"), F.col("words"), F.col("gain"))
    )
    level = F.min("open").over(Window.partitionBy("skey"))["level"]
    p = F.when(F.col("need") <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce(level / (2 + F.col("kind")), F.lit(1.0))))
    chances = cut(weighed.select("skey", "kind", "source_size", "target", "copies", "need", p.alias("p")))

    ranked = lookup(measured.select("skey", "kind", "size", "u"), chances, ["skey", "kind"]).filter("p > 0 and size > 0")
    ranked = ranked.withColumn("rank", _rank(F.col("u"), F.col("p"))).withColumn(
        "bin", F.floor(F.col("rank") * BINS).cast("int")
    )
    bins = cut(ranked.groupBy("skey", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need")))
    # First the group of bins in which the words are reached, then the bin: both windows see STEP rows of a source.
    group = _crossing(bins.withColumn("group", F.shiftright("bin", STEP_BITS)), "group")
    fine = lookup(bins.drop("need").withColumn("group", F.shiftright("bin", STEP_BITS)), group, ["skey", "group"], "inner")
    crossed = _crossing(fine.withColumnRenamed("before", "start"), "bin")
    inside = lookup(ranked.drop("need"), crossed, ["skey", "bin"], "inner")
    steps = inside.groupBy("skey", "bin", "rank", "before", "need").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("skey").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("upto", F.col("before") + F.sum("words").over(within)).select(
        "skey", "bin", "rank", (F.col("need") - F.col("upto")).alias("gap")
    )
    none = crossed.select("skey", "bin", F.lit(-1.0).alias("rank"), (F.col("need") - F.col("before")).alias("gap"))
    cuts = cut(
        steps.unionByName(none)
        .filter("gap >= 0")
        .groupBy("skey")
        .agg(F.min(F.struct("gap", "rank", "bin")).alias("best"))
        .select("skey", F.col("best.gap").alias("gap"), F.col("best.bin").alias("last_bin"), F.col("best.rank").alias("last_rank"))
    )
    behind = lookup(ranked, cuts, ["skey"], "inner").filter(
        "bin > last_bin or (bin = last_bin and rank > last_rank)"
    )
    off = F.abs(F.col("size") - F.col("gap"))
    border = behind.filter(off < F.col("gap")).groupBy("skey").agg(F.min(F.struct(off, "rank")).alias("best"))
    border = border.select("skey", F.col("best.rank").alias("border_rank"))
    cuts = cuts.drop("gap").join(border, "skey", "left")
    return cut(chances.join(cuts, "skey", "left").drop("need"))


def _copies(u: str, size: str) -> Column:
    rank = _rank(F.col(u), F.col("p"))
    at = F.floor(rank * BINS).cast("int")
    # Where the ranks of a source never reach the target, all of them are taken.
    taken = F.col("last_bin").isNull() | (at < F.col("last_bin")) | (
        (at == F.col("last_bin")) & (rank <= F.col("last_rank"))
    ) | F.coalesce(rank == F.col("border_rank"), F.lit(False))
    more = F.when((F.col("p") > 0) & (F.col(size) > 0) & taken, 1).otherwise(0)
    return (F.col("copies") + more).cast("long")


_SHARES, _AMOUNT, _CEILING, _SEED = (5, 2, 1), 1.5, 2.0, 20240229


def mixed_sizes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    shares: tuple[float, ...] = _SHARES, amount: float = _AMOUNT, ceiling: float = _CEILING, seed: int = _SEED,
) -> DataFrame:
    """One row per document: key, size and source_size (words), target (of its source), copies, taken (words).

    A null text has no words; a null source is a source of its own; a null key is a
    value like others. Rows with the same key, source and size are numbered and drawn
    one by one, so that any number of repeated rows comes as near to the target. No rows
    in, none out. Other columns are not read.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    names = ["skey", "size", "kind", "tie", "mark"]
    measured = cut(_measured(narrow, "key", "text", "source", names).select("key", *names))
    drawn = _drawn(measured, _tied(measured, "tie"), "tie", "mark", "u", seed)
    plan = mixing_plan(drawn, shares, amount, ceiling)
    out = lookup(drawn, plan, ["skey", "kind"]).withColumn("copies", _copies("u", "size"))
    return out.select(
        F.col("key").alias(key), "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    shares: tuple[float, ...] = _SHARES, amount: float = _AMOUNT, ceiling: float = _CEILING, seed: int = _SEED,
) -> DataFrame:
    """The documents, all columns, each as often as :func:`mixed_sizes` says. Only texts of rows that tie are shuffled."""
    row, *names = fresh(docs, "_docs", "_skey", "_size", "_kind", "_tie", "_mark")
    plain = ["skey", "size", "kind", "tie", "mark"]
    marked = _measured(docs, key, text, source, names).select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(row), *(F.col(n).alias(p) for n, p in zip(names, plain, strict=True))
    )
    narrow = cut(marked.select(*plain))
    ties = _tied(narrow, "tie")
    plan = mixing_plan(_drawn(narrow, ties, "tie", "mark", "u", seed), shares, amount, ceiling)
    joined = lookup(_drawn(marked, ties, "tie", "mark", "u", seed), plan, ["skey", "kind"])
    times = joined.select(row, _copies("u", "size").alias("times")).filter("times > 0")
    return times.select(row, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(f"{row}.*")
