"""Records and documents cut out of large CSV and JSON files by many tasks, wherever their line breaks are.

Whether a line begins inside a quoted value depends on all lines before it. So each
line first says what it does to either state: keep it, turn it, or set it. Effects
combine: those of a block (the piece of a file that one task reads) make one effect,
and going through the blocks of a file, one row each, gives the state that every
block begins in. With that, records are put together from their lines in parallel.
No task reads more than a block, whatever the size of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, DELIMITER = '"', ","
#: A line's effect: it keeps the state (0), turns it (1), or leaves a value open (3) or none (2) whatever was before.
KEEP, TURN, CLOSE, OPEN = 0, 1, 2, 3


def end_state(line: Column, inside: bool) -> Column:
    """1 if a quoted value is open after the line, which began inside one or not.

    A quote opens a value only where a field begins; inside, it closes the value, unless
    another one follows at once.
    """
    pieces = F.split(line, QUOTE)
    start = F.struct(F.lit(int(inside)).alias("open"), F.lit(False).alias("closed"), F.lit(True).alias("first"))

    def quote(state: Column, piece: Column) -> Column:
        begins = piece.endswith(DELIMITER) | ((piece == "") & (state["first"] | state["closed"]))
        shut = state["open"] == 1
        opened = F.when(~shut & begins, 1).otherwise(0)
        return F.struct(opened.alias("open"), shut.alias("closed"), F.lit(False).alias("first"))

    # Every piece but the last has a quote after it.
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, quote)["open"]


def effect(line: Column) -> Column:
    outside, inside = end_state(line, False), end_state(line, True)
    found = F.when((outside == 0) & (inside == 1), KEEP).when(outside == 1, F.when(inside == 0, TURN).otherwise(OPEN))
    return F.when(~line.contains(QUOTE), KEEP).otherwise(found.otherwise(CLOSE))


def _combined(name: str, order: Window) -> tuple[Column, Column]:
    """Of the effects before a row: what the last one that sets a state set it to (null if none), and the turns since."""
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.bit_xor(F.when(F.col(name) == TURN, 1).otherwise(0))
    # A set state is noted without the turns so far; the turns up to a later row then put it right.
    base = F.when(F.col(name) >= CLOSE, (F.col(name) - CLOSE).bitwiseXOR(turns.over(so_far)))
    return base, F.coalesce(turns.over(before), F.lit(0))


def _with_effects_before(rows: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Adds ``set`` and ``turns``: the state before a row is ``set``, or else the group's first state, turned ``turns`` times."""
    window = Window.partitionBy(*group).orderBy(order)
    base, turns = _combined(name, window)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"_base": base, "turns": turns}).withColumn(
        "set", F.last("_base", ignorenulls=True).over(before)
    ).drop("_base")


def _state(first: Column | int) -> Column:
    return F.coalesce(F.col("set"), F.lit(first) if isinstance(first, int) else first).bitwiseXOR(F.col("turns"))


def spanning_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(file, head, crlf, record)``: the records of CSV files; ``head`` marks a file's first, which is its header.

    Lines are shuffled once, by block; only those of records that span lines are
    shuffled again. Blank records are left out. ``crlf`` tells whether the file's header
    ends with a carriage return, which records then lose at every line end.
    """
    at = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "line": F.monotonically_increasing_id()}
    lines = spark.read.option("lineSep", "\n").text(files).select("value", *(c.alias(n) for n, c in at.items()))
    scanned = _with_effects_before(
        lines.withColumn("effect", effect(F.col("value"))), ["file", "block"], "line", "effect"
    )
    # A block's own effect, and its last record start, for either state that it may begin in.
    after = F.when(F.col("effect") >= CLOSE, F.col("effect") - CLOSE)
    end = {s: F.coalesce(after, _state(s).bitwiseXOR(F.when(F.col("effect") == TURN, 1).otherwise(0))) for s in (0, 1)}
    text = F.trim("value") != ""
    blocks = scanned.groupBy("file", "block").agg(
        *(F.max_by(end[s], "line").alias(f"end{s}") for s in (0, 1)),
        *(F.max(F.when(_state(s) == 0, F.col("line"))).alias(f"start{s}") for s in (0, 1)),
        F.min(F.when(text, F.col("line"))).alias("first"), F.min_by("value", F.when(text, F.col("line"))).alias("header"),
    )
    of_block = F.when((F.col("end0") == 0) & (F.col("end1") == 1), KEEP).when(
        F.col("end0") == 1, F.when(F.col("end1") == 0, TURN).otherwise(OPEN)
    ).otherwise(CLOSE)
    blocks = _with_effects_before(blocks.withColumn("effect", of_block), ["file"], "block", "effect")
    blocks = blocks.withColumn("begins", _state(0))
    start = F.when(F.col("begins") == 0, F.col("start0")).otherwise(F.col("start1"))
    started = F.when(start.isNotNull(), F.struct(F.col("block").alias("b"), start.alias("l")))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy("file")
    blocks = blocks.select(
        "file", "block", "begins", F.last(started, ignorenulls=True).over(earlier).alias("carried"),
        F.min(F.when(F.col("first").isNotNull(), F.struct(F.col("block").alias("b"), F.col("first").alias("l")))).over(everywhere).alias("top"),
        F.min_by(F.col("header").endswith("\r"), F.when(F.col("first").isNotNull(), F.col("block"))).over(everywhere).alias("crlf"),
    )
    within = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = scanned.join(blocks, ["file", "block"])
    starts = _state(F.col("begins")) == 0
    own = F.struct(F.col("block").alias("b"), F.col("line").alias("l"))
    known = known.withColumn("starts", starts).withColumn(
        "key", F.coalesce(F.last(F.when(F.col("starts"), own), ignorenulls=True).over(within), F.col("carried"))
    )
    closed = _state(F.col("begins")).bitwiseXOR(F.when(F.col("effect") == TURN, 1).otherwise(0))
    alone = F.col("starts") & (F.coalesce(after, closed) == 0)
    known = known.withColumn("alone", alone).select("file", "block", "line", "value", "key", "top", "crlf", "alone")
    single = known.filter("alone").select("file", (F.col("key") == F.col("top")).alias("head"), "crlf", F.col("value").alias("record"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    joined = (
        known.filter("not alone")
        .groupBy("file", "key", "top", "crlf")
        .agg(F.array_join(F.transform(ordered, lambda r: r["value"]), "\n").alias("record"))
        .select("file", (F.col("key") == F.col("top")).alias("head"), "crlf", "record")
    )
    records = single.unionByName(joined)
    plain = F.when(F.col("crlf"), F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\r$", "")).otherwise(F.col("record"))
    return records.withColumn("record", plain).filter(F.col("record") != "")


#: A chunk of a JSON file has so many closing braces, as a power of two.
CHUNK_BITS = 8
#: Stands before a closing brace that lies in a string. Strings of JSON have no control characters.
_MARK = "\u0001"


def _count(text: Column, characters: str) -> Column:
    """How many of the characters the text has; native replacements take a tenth of the time of ``translate``."""
    return reduce(lambda a, b: a + b, (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in characters))


def _plain(values: Column) -> Column:
    """The text of a chunk without its escapes, so that every quote left opens or closes a string."""
    text = F.concat(F.array_join(values, "}"), F.lit("}"))
    # An escape never has the closing brace after it, at which pieces are cut.
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\[^}]", "")).otherwise(text)


def _braces(plain: Column, in_string: Column) -> Column:
    """The brackets and opening braces before each closing brace of a chunk, and _MARK if that one lies in a string."""
    whole = F.concat(F.when(in_string == 1, '"').otherwise(""), plain)
    # Strings without closing braces go at once; of what is left, every second part is a string.
    parts = F.split(F.regexp_replace(whole, r'"[^"}]*+"|("[^"]*+(?:"|$))', "$1"), '"')
    braces = lambda text: F.replace(F.regexp_replace(text, "[^}]+", ""), F.lit("}"), F.lit(_MARK + "}"))
    bare = F.transform(parts, lambda part, i: F.when(i % 2 == 0, part).otherwise(braces(part)))
    return F.split(F.regexp_replace(F.array_join(bare, ""), f"[^\\[\\]{{}}{_MARK}]+", ""), "}")


def _ends(marks: Column, depth: Column, base: Column) -> Column:
    """Numbers of the pieces of a chunk with whose brace a document ends; the chunk begins at a depth."""
    # Either the closing brace counts or a mark does, so that one is to be taken from the length.
    deeper = F.transform(marks, lambda mark: F.length(mark) - 2 * _count(mark, "]") - 1)
    start = F.struct(depth.cast("int").alias("depth"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def piece(state: Column, step: Column) -> Column:
        at = state["at"]
        # A closing brace in a string ends nothing, wherever the depth is.
        ends = (state["depth"] + step == base) & ~F.get(marks, at).endswith(_MARK)
        return F.struct(
            (state["depth"] + step).alias("depth"), (at + 1).alias("at"),
            F.when(ends, F.array_append(state["ends"], at)).otherwise(state["ends"]).alias("ends"),
        )

    # What follows the last brace is no piece.
    return F.aggregate(F.slice(deeper, F.lit(1), F.size(marks) - 1), start, piece)["ends"]


def json_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, document)``: the objects of JSON files, as text; a file holds one, several, or an array of them.

    Files are read in pieces that end at a closing brace, whether or not they have line
    breaks, and 2^CHUNK_BITS pieces are put together at once, in the only shuffle of all text.
    A chunk says how deep it leads for either state, in a string or not, that it may begin
    in; going through the chunks of a file, one row each, gives the state and the depth
    that every chunk begins with. Where the depth comes back to that of the file's own
    objects, one ends. Documents within a chunk are cut out where they are; only the text
    before a chunk's first end and after its last is shuffled once more, by document.
    Values of an array that are no objects are passed over.
    """
    line = F.monotonically_increasing_id()
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")
    )
    # Sorted by the number first, which is cheaper to compare than a path. None of the three
    # can be null: else the joins below would add filters, and no longer read the same exchange.
    place = ["chunk", "file", "block"]
    chunks = pieces.groupBy(F.shiftright("line", CHUNK_BITS).alias("chunk"), "file", "block").agg(
        F.sort_array(F.collect_list(F.struct("line", "value")))["value"].alias("values")
    )
    # What is used several times is a column of its own, so that it is worked out once.
    plain = chunks.withColumn("plain", _plain(F.col("values")))
    outside = F.regexp_replace("plain", r'"[^"]*+(?:"|$)', "")
    lead = F.regexp_extract(F.array_join("values", ""), r"^[\uFEFF\s]*([^\uFEFF\s])", 1)
    facts = plain.select(*place, "plain", outside.alias("outside"), F.nullif(lead, F.lit("")).alias("lead"))

    def net(text: str) -> Column:
        return _count(F.col(text), "{[") - _count(F.col(text), "]}")

    # What lies outside of strings for one state lies inside for the other.
    facts = facts.select(
        *place, "lead", (_count(F.col("plain"), '"') % 2).alias("odd"), net("outside").alias("deeper0"),
        (net("plain") - net("outside")).alias("deeper1"),
    )
    order = Window.partitionBy("file").orderBy("block", "chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    known = facts.withColumn("in_string", F.coalesce(F.bit_xor("odd").over(earlier), F.lit(0)))
    deeper = F.when(F.col("in_string") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
    top = F.first("lead", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = known.select(
        *place, "in_string", F.coalesce(F.sum(deeper).over(earlier), F.lit(0)).alias("depth"),
        F.when(top == "[", 1).otherwise(0).alias("base"),
    )
    marks = plain.join(known, place).select(*place, "depth", "base", _braces(F.col("plain"), F.col("in_string")).alias("marks"))
    ends = marks.select(*place, _ends(F.col("marks"), F.col("depth"), F.col("base")).alias("ends"))
    mine = F.when(F.size("ends") > 0, F.struct(F.col("block").alias("b"), F.col("chunk").alias("c")))
    # The document that is open at a chunk's begin and the one at its end are named by the chunk that they begin in.
    dealt = ends.withColumns({"opened": F.last(mine, ignorenulls=True).over(earlier), "own": mine})
    cut = chunks.join(dealt, place)

    def joined(first: Column, last: Column) -> Column:
        """The pieces of these numbers, each with its brace."""
        return F.concat(F.array_join(F.slice("values", first + 1, last - first + 1), "}"), F.lit("}"))

    within = F.transform(
        F.slice("ends", F.lit(2), F.greatest(F.size("ends") - 1, F.lit(0))), lambda end, i: joined(F.get("ends", i) + 1, end)
    )
    final = F.size("values") - 1
    head = joined(F.lit(0), F.coalesce(F.get("ends", F.lit(0)), final))
    last = F.element_at("ends", -1)
    edge = F.struct(F.col("opened").alias("key"), head.alias("text"))
    after = F.struct(F.col("own").alias("key"), joined(last + 1, final).alias("text"))
    edges = F.when(F.size("ends") == 0, F.array(edge)).when(last == final, F.array(edge)).otherwise(F.array(edge, after))
    whole = cut.select("file", F.explode(within).alias("text"))
    open_ended = cut.select("file", "block", "chunk", F.inline(edges)).groupBy("file", "key").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("block", "chunk", "text")))["text"], "").alias("text")
    )
    texts = whole.unionByName(open_ended.select("file", "text"))
    text = F.substring("text", F.greatest(F.instr("text", "{"), F.lit(1)), F.length("text"))
    return texts.select("file", text.alias("document")).filter(F.col("document").startswith("{"))
