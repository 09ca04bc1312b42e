"""Secrets in texts: fixed patterns, and candidate strings of high entropy.

All of it is column expressions. A candidate is a run of one character class; a
window slides over it and keeps the counts of its characters and the sum of
c * log2(c) over them, which one character in and one out change by four table
values. Windows whose Shannon entropy reaches the class's bound are merged to
spans. Candidates on the allow list are passed over, windows do not reach into stated
examples, and what a fixed pattern has found is cut out of the spans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import whole

# Fixed patterns; a matched assignment counts if its value has six characters or more.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex")

_SPANS = "array<struct<start:int,end:int,body:string>>"
_PIECES = "array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters, the window over its runs, and the entropy in bits from which a window counts."""

    name: str
    characters: str
    pattern: str
    window: int
    bits: float


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", _DIGITS + "abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}+(?![0-9A-Za-z])", 16, 2.9),
    CharacterClass("entropy_base64", _DIGITS + _LOWER + _UPPER + "+/_=-", r"[A-Za-z0-9+/_=-]{20,}+", 20, 3.8),
)
_WORD = r"(?:[A-Z]?+[a-z]++(?:[A-Z][a-z]{2,}+)*+|[A-Z]++)"
#: Numbers, identifiers in UUID form, and words (one case, capitalised or camel case) with marks between them.
ALLOWED = (
    r"^[A-Z]+$", r"^[0-9]+$", rf"^{_WORD}(?:[-_/+=]++{_WORD})*+[-_/+=]*+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: The alphabet's and the digits' own order and stated examples, with up to a window of what is written in one with them.
EXAMPLE = r"(?i)[a-z0-9]{0,20}(?:0123456789|abcdefghij|example|placeholder|xxxxxx)[a-z0-9]{0,20}"


def found(text: Column, pattern: str) -> Column:
    """Start, end (code points) and body of every match, leftmost first and without overlaps.

    A text is its pieces between matches and the matches in turn, so their lengths
    give the offsets.
    """
    parts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda piece, body: F.struct(piece.alias("piece"), body.alias("body")),
    )

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.coalesce(F.length(part["body"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), part["body"].alias("body"))
        spans = F.when(part["body"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), spans.cast(_SPANS).alias("spans"))

    empty = F.array().cast(_SPANS)
    all_spans = F.aggregate(
        parts, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add, lambda state: state["spans"]
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), all_spans).otherwise(empty)


def high_entropy(body: Column, kind: CharacterClass) -> Column:
    """Merged spans (from, to, within the body) of the windows whose entropy reaches the class's bound."""
    width = kind.window
    table = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)))
    letters = F.split(body, "")

    def place(letter: Column) -> Column:
        return F.instr(F.lit(kind.characters), letter) - 1

    def step(state: Column, i: Column) -> Column:
        come, go = place(F.get(letters, i)), F.when(i >= width, place(F.get(letters, i - width))).otherwise(F.lit(-1))
        same = come == go
        more, less = F.get(state["counts"], come), F.when(go >= 0, F.get(state["counts"], go))
        gain = F.get(table, more + 1) - F.get(table, more)
        loss = F.when(go >= 0, F.get(table, less) - F.get(table, less - 1)).otherwise(0.0)
        total = F.when(same, state["sum"]).otherwise(state["sum"] + gain - loss)
        counts = F.when(same, state["counts"]).otherwise(
            F.transform(state["counts"], lambda c, at: c + (at == come).cast("int") - (at == go).cast("int"))
        )
        high = (i >= width - 1) & (F.lit(math.log2(width)) - total / width >= kind.bits - 1e-9)
        start = i - width + 1
        last = F.element_at(state["spans"], -1)
        joins = (F.size(state["spans"]) > 0) & (F.coalesce(last["end"], F.lit(-1)) >= start)
        span = F.struct(F.when(joins, last["start"]).otherwise(start).alias("start"), (i + 1).alias("end"))
        kept = F.when(joins, F.slice(state["spans"], 1, F.size(state["spans"]) - 1)).otherwise(state["spans"])
        spans = F.when(high, F.concat(kept, F.array(span))).otherwise(state["spans"])
        return F.struct(
            counts.cast("array<int>").alias("counts"), total.alias("sum"),
            spans.cast("array<struct<start:int,end:int>>").alias("spans"),
        )

    begin = F.struct(
        F.array_repeat(F.lit(0), len(kind.characters)).cast("array<int>").alias("counts"), F.lit(0.0).alias("sum"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.length(body) - 1), begin, step, lambda state: state["spans"])


def _entropy_spans(candidates: Column, kind: CharacterClass) -> Column:
    """The high-entropy spans of all candidates, as offsets in the text."""

    def moved(candidate: Column) -> Column:
        return F.transform(
            high_entropy(candidate["body"], kind),
            lambda w: F.struct(
                (candidate["start"] + w["start"]).alias("start"), (candidate["start"] + w["end"]).alias("end")
            ),
        )

    return F.flatten(F.transform(candidates, moved))


def allowed(body: Column) -> Column:
    tests = F.lit(False)
    for pattern in ALLOWED:
        tests = tests | F.regexp_like(body, F.lit(pattern))
    return tests


def _without(spans: Column, holes: Column) -> Column:
    """What is left of each span (start, end) outside the holes, in order."""

    def pieces(span: Column) -> Column:
        def step(state: Column, hole: Column) -> Column:
            hits = (hole["start"] < span["end"]) & (state["at"] < hole["end"])
            piece = F.array(F.struct(state["at"].alias("start"), hole["start"].alias("end")))
            return F.struct(
                F.when(hits, hole["end"]).otherwise(state["at"]).alias("at"),
                F.when(hits & (state["at"] < hole["start"]), F.concat(state["parts"], piece))
                .otherwise(state["parts"]).cast(_PIECES).alias("parts"),
            )

        begin = F.struct(span["start"].alias("at"), F.array().cast(_PIECES).alias("parts"))
        return F.aggregate(
            F.array_sort(holes), begin, step,
            lambda state: F.when(
                state["at"] < span["end"],
                F.concat(state["parts"], F.array(F.struct(state["at"].alias("start"), span["end"].alias("end")))),
            ).otherwise(state["parts"]).cast(_PIECES),
        )

    return F.flatten(F.transform(spans, pieces))


def _candidates(text: Column, kind: CharacterClass) -> Column:
    """The candidates of a class that are not allowed; one with stated examples in it is cut into what lies between them."""

    def split(candidate: Column) -> Column:
        body = candidate["body"]
        all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.length(body).alias("end")))
        parts = F.transform(
            _without(all_of_it, found(body, EXAMPLE)),
            lambda p: F.struct(
                (candidate["start"] + p["start"]).alias("start"), (candidate["start"] + p["end"]).alias("end"),
                F.substring(body, p["start"] + 1, p["end"] - p["start"]).alias("body"),
            ),
        )
        parts = F.filter(parts, lambda p: (F.length(p["body"]) >= kind.window) & ~allowed(p["body"]))
        return F.when(F.regexp_like(body, F.lit(EXAMPLE)), parts.cast(_SPANS)).otherwise(F.array(candidate).cast(_SPANS))

    return F.flatten(F.transform(F.filter(found(text, kind.pattern), lambda s: ~allowed(s["body"])), split))


def _tagged(spans: Column, number: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("number"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    A null text is empty and has no spans; repeated rows give equal rows; no rows in,
    none out. Other columns are not read.
    """
    frame = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    frame = frame.select(
        "key",
        F.filter(
            found(F.col("text"), ASSIGN), lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 6
        ).alias("assign"),
        found(F.col("text"), ACCESS).alias("access"),
        found(F.col("text"), HEX).alias("hex"),
        *(_candidates(F.col("text"), c).alias(c.name) for c in CLASSES),
    )
    frame = frame.withColumn("base", F.concat(*(_tagged(F.col(k), i, k) for i, k in enumerate(KINDS))))
    added = []
    for i, c in enumerate(CLASSES, len(KINDS)):
        inside = _entropy_spans(F.col(c.name), c)
        fresh_spans = _without(inside, F.col("base"))
        added.append(_tagged(fresh_spans, i, c.name))
    frame = frame.withColumn("added", F.concat(*added))
    return frame.select(
        F.col("key").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
