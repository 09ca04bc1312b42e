"""Best-fit packing of tokenised documents after a Martello-Toth reduction.

Only the counts of piece lengths (as many numbers as a sequence has places) reach
the driver. There, small sets that dominate all others with the same longest
piece are fixed, and best fit in decreasing length packs the rest; both work on
counts, so their time depends on the number of lengths and not on the number of
documents. The result is a table of layouts: "pieces number a to b of length n go
to sequences x, x+1, ..., k in each, from place o on". Pieces are numbered within
their length without a global sort, and each finds its place by that number.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import cut, whole

CAPACITY = 1024
END = 2
#: The number of pieces of a layout, then for each length in it: length, pieces of that length in a sequence.
Layout = tuple[int, tuple[tuple[int, int], ...]]


@functools.cache
def _added(path: str) -> tuple[dict[str, int], bool]:
    """The added tokens of a tokenizers file, and whether they are plain strings of which none begins another."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens") or []
    added = {t["content"]: t["id"] for t in tokens}
    flags = any(t.get(f) for t in tokens for f in ("single_word", "lstrip", "rstrip", "normalized"))
    return added, not flags and not any(a != b and b.startswith(a) for a in added for b in added)


@functools.cache
def _encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: same ids (tested), a sixth of the time."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(map(back.__getitem__, word)): i for word, i in vocabulary.items() if all(c in back for c in word)}
    added, plain = _added(path)
    for content in added:
        ranks.pop(content.encode(), None)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added if plain else {})


@functools.cache
def _ids(path: str) -> Callable[[str], list[int]]:
    """The ids that tokenizers gives with add_special_tokens=False: added tokens in a text are found first.

    tiktoken finds them itself if they are plain strings and none begins another;
    for other files a text with one goes through tokenizers.
    """
    encoder = _encoder(path)
    added, plain = _added(path)
    if plain:
        return functools.partial(encoder.encode, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer, marked = Tokenizer.from_file(path), re.compile("|".join(map(re.escape, added)))

    def encode(text: str) -> list[int]:
        if marked.search(text):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return encoder.encode_ordinary(text)

    return encode


def piece_bounds(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids, and n; all pieces are full but the first, which may be shorter."""
    return [0, *range(n % capacity or capacity, n + 1, capacity)]


def _cut_pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ids(path)
        for batch in batches:
            keys, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([*encode(text), end], "<u4")
                bounds = piece_bounds(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):  # noqa: B905
                    keys.append(i)
                    rows.append((piece, a, b - a, zlib.crc32(ids[a:b])))
            piece, start, length, crc = map(list, zip(*rows)) if rows else ([], [], [], [])  # noqa: B905
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32"],
            )

    return run


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Layout], dict[int, int]]:
    """Fix sets that dominate every other set with the same longest piece; returns them and what is left.

    For the longest piece j: alone, if nothing fits beside it; with the one piece
    that fills the sequence; with the longest piece k that fits, if no two others
    fit beside j, or if at most two do and no two together are longer than k. In
    each case the others could trade places with the set's pieces in any packing.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Layout] = []

    def fix(j: int, k: int | None) -> None:
        if k is None:
            fixed.append((left[j], ((j, 1),)))
            times, used = left[j], [j]
        elif j == k:
            times, used = left[j] // 2, [j, j]
            fixed.append((times, ((j, 2),)))
        else:
            times, used = min(left[j], left[k]), [j, k]
            fixed.append((times, ((j, 1), (k, 1))))
        for s in used:
            left[s] -= times
        for s in set(used):
            if not left[s]:
                del left[s]
                sizes.remove(s)

    def smallest(j: int, n: int) -> list[int]:
        """The n smallest pieces beside one j."""
        found: list[int] = []
        for s in sizes:
            found += [s] * min(n - len(found), left[s] - (s == j))
            if len(found) == n:
                break
        return found

    def best_pair(j: int, room: int) -> int:
        best, high = 0, len(sizes) - 1
        for a in sizes:
            while high >= 0 and a + sizes[high] > room:
                high -= 1
            if high < 0 or sizes[high] < a:
                break
            for b in (sizes[high], sizes[high - 1] if high else 0):
                if b and left[a] - (a == j) >= 1 + (a == b) and left[b] - (b == j) >= 1:
                    best = max(best, a + b)
                    break
        return best

    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while j in left:
                room = capacity - j
                at = bisect.bisect_right(sizes, room) - 1
                if at >= 0 and sizes[at] == j and left[j] < 2:
                    at -= 1
                if at < 0:
                    fix(j, None)
                    changed = True
                    continue
                k, low = sizes[at], smallest(j, 3)
                one = len(low) < 2 or low[0] + low[1] > room
                two = len(low) < 3 or sum(low) > room
                if k == room or one or (two and k >= best_pair(j, room)):
                    fix(j, k)
                    changed = True
                else:
                    break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best fit in decreasing length, all pieces of a length at once.

    A piece goes to the sequence with the least room that holds it, so equal pieces
    fill one sequence before they begin the next.
    """
    rooms: dict[int, list[list]] = defaultdict(list)
    order: list[int] = []

    def put(room: int, times: int, parts: tuple) -> None:
        if room not in rooms or not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append([times, parts])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                room = order[at]
                times, parts = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room, times, parts = capacity, n, ()
            each = min(room // size, n)
            filled = min(n // each, times)
            n -= filled * each
            put(room - each * size, filled, (*parts, (size, each)))
            if times > filled and parts:
                put(room, times - filled, parts)
    return [(times, parts) for groups in rooms.values() for times, parts in groups]


def plan_layouts(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first number, first sequence, pieces in a sequence, first place), sorted; and the sequences used."""
    full = counts.get(capacity, 0)
    fixed, left = reduce_instance({s: n for s, n in counts.items() if s != capacity}, capacity)
    rows, used, sequence = [], defaultdict(int), 0
    for times, parts in [*fixed, *best_fit(left, capacity), *([(full, ((capacity, 1),))] if full else [])]:
        place = 0
        for size, each in parts:
            rows.append((size, used[size], sequence, each, place))
            used[size] += times * each
            place += size * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _place(layouts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = layouts[:, 0] << 44 | layouts[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            _, first, sequence, each, place = layouts[np.searchsorted(keys, length << 44 | number, "right") - 1].T
            arrays = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(sequence + (number - first) // each), pa.array(place + (number - first) % each * length)]
            yield pa.RecordBatch.from_arrays(
                arrays, ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file on every executor. A null text
    is empty and gives the end id alone; repeated rows are documents of their own;
    null keys stay null. No rows in, none out. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    pieces = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text")).mapInArrow(
        _cut_pieces(tokenizer, capacity, end), f"key {kind}, piece int, start long, length long, ids_crc32 long"
    )
    pieces = cut(pieces.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33).alias("part")
    by_part = cut(pieces.groupBy(part, "length").count())
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("count")).collect()}
    layouts, _ = plan_layouts(counts, capacity)
    # A piece's number within its length: those in earlier partitions, then its rank in its own.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1
    numbered = (
        pieces.withColumn("part", part)
        .withColumn("rank", rank)
        .join(offsets, ["part", "length"])
        .select("key", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("number"))
    )
    placed = numbered.mapInArrow(
        _place(layouts),
        f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
    return placed.withColumnRenamed("key", key)
