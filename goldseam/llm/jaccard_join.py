"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same shingle set form one node. Nodes that agree on a band of
MinHash values meet in a bucket. There their values are compared a few at a time,
and a pair is dropped once the posterior probability that its similarity reaches
the threshold falls below TOLERANCE. What survives falls into candidate clusters,
and within those the remaining pairs are verified on their full shingle sets.

No table of pairs is ever made. A bucket or cluster emits, for each group of
linked nodes, a star around the least, and per node a number of links. Buckets of
the same members are compared once; a bucket or cluster too large for one task is
cut into blocks, and every two blocks meet in a task of their own. Intermediate
tables are dropped once what was made of them is written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import Tables, fresh, lookup, whole
from goldseam.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
#: A pair at the threshold misses all bands with a probability of 3e-6.
BANDS, BAND_ROWS = 42, 6
#: MinHash values compared for pruning, so many at a time.
COMPARED, STEP = 128, 16
TOLERANCE = 1e-6
BUCKET_ROWS = 2_048
#: A task compares two blocks of at most about so many shingles and texts.
BLOCK_SHINGLES, BLOCK_TEXTS = 500_000, 512
LAST = 2**63 - 1

_RANDOM = np.random.default_rng(11)
_TIMES = _RANDOM.integers(0, 2**32, BANDS * BAND_ROWS, np.uint32) | np.uint32(1)
_FLIP = _RANDOM.integers(0, 2**32, BANDS * BAND_ROWS, np.uint32)
_PLACES = _RANDOM.integers(0, 2**63, WIDTH, np.uint64) | np.uint64(1)
_JOIN = _RANDOM.integers(0, 2**63, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(0, 2**63, BANDS, np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct hashes of the runs of WIDTH words; words are lower-cased and parted by white space.

    A text of fewer words is one shingle, a text without words has none.
    """

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, words = self.known, text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(known) > 500_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - WIDTH + 1
        if n < 1:
            return _stir(np.array([(hashes * _PLACES[: len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))]))
        runs = hashes[:n] * _PLACES[0]
        for i in range(1, WIDTH):
            runs += hashes[i : i + n] * _PLACES[i]
        return np.unique(_stir(runs))


def min_hashes(shingles: np.ndarray, values: int = BANDS * BAND_ROWS) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    low = np.full(values, 2**32 - 1, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, ((x[at : at + 1024] ^ _FLIP[:values]) * _TIMES[:values]).min(axis=0), out=low)
    return low


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For k = STEP, 2 STEP, ... compared values: the fewest matches with which a pair stays.

    With a uniform prior, the posterior of reaching the threshold after m matches of k
    is the chance of at most m successes in k + 1 trials of probability threshold.
    """
    found = []
    for k in range(STEP, COMPARED + 1, STEP):
        chance, m = 0.0, 0
        while True:
            chance += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        found.append(m)
    return found


def may_reach(signatures: np.ndarray, sizes: np.ndarray, x: int, others: np.ndarray, threshold: float, fewest: list[int]):
    """Those of ``others`` that x may be as similar to as the threshold."""
    small, large = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
    left = others[small >= threshold * large - 1e-9]
    matches = np.zeros(len(left), np.int32)
    for at, least in zip(range(0, COMPARED, STEP), fewest, strict=True):
        if not len(left):
            break
        matches = matches + (signatures[left, at : at + STEP] == signatures[x, at : at + STEP]).sum(1, dtype=np.int32)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
    return left


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that come sorted by ``keys``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        first = tuple(c[0] for c in columns)
        if rest and tuple(rest[-1].column(k)[-1].as_py() for k in keys) != first:
            yield pa.Table.from_batches(rest)
            rest = []
        bounds = [0, *starts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its shingle set's hash and size, its band keys, and the values to compare, 16 bits each."""
    shingles_of = Shingler()
    for batch in batches:
        digests, sizes, bands, signatures = [], [], [], []
        for text in batch.column("text").to_pylist():
            shingles = shingles_of(text)
            sizes.append(len(shingles))
            if not len(shingles):
                digests.append(None)
                bands.append(None)
                signatures.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            low = min_hashes(shingles)
            rows = low.reshape(BANDS, BAND_ROWS).astype(np.uint64)
            bands.append(_stir((rows * _JOIN).sum(1, dtype=np.uint64) + _BAND).view(np.int64))
            signatures.append((low[:COMPARED] & np.uint32(0xFFFF)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("rank"), batch.column("mark"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
            ["rank", "mark", "digest", "size", "bands", "signature"],
        )


def _link_buckets(threshold: float):
    """Spanning links of the pairs in a bucket that survive pruning."""
    fewest = fewest_matches(threshold, TOLERANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in _groups(batches, ["band", "i", "j"]):
            nodes = group["node"].to_numpy()
            sizes = group["size"].to_numpy()
            signatures = np.frombuffer(b"".join(group["signature"].to_pylist()), "<u2").reshape(len(nodes), COMPARED)
            todo = np.arange(len(nodes))
            while len(todo) > 1:
                reached, todo = [todo[0]], todo[1:]
                found = reached[:]
                while reached and len(todo):
                    x = reached.pop()
                    near = may_reach(signatures, sizes, x, todo, threshold, fewest)
                    if len(near):
                        found += near.tolist()
                        reached += near.tolist()
                        todo = np.setdiff1d(todo, near, assume_unique=True)
                # A star around the least node: the links of many buckets then meet in few steps.
                if len(found) > 1:
                    least, *rest = np.sort(nodes[found]).tolist()
                    a += [least] * len(rest)
                    b += rest
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verify_block(
    nodes: np.ndarray, weights: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float,
    fewest: list[int],
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each node, counted in documents, and per group of linked nodes a star, over the pairs of a block.

    ``across``: only the pairs of nodes of different blocks count.
    """
    sizes = np.array([len(s) for s in sets])
    signatures = np.stack([min_hashes(s, COMPARED) & np.uint32(0xFFFF) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    present = np.zeros(column.max() + 1, np.int32)
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for x in range(len(nodes) - 1):
        others = np.arange(x + 1, len(nodes))
        if across:
            others = others[blocks[others] != blocks[x]]
        near = may_reach(signatures, sizes, x, others, threshold, fewest)
        if not len(near):
            continue
        own = column[starts[x] : starts[x] + sizes[x]]
        present[own] = 1
        if len(near) > len(nodes) // 16:
            shared = np.add.reduceat(present[column], starts)[near]
        else:
            shared = np.array([present[column[starts[y] : starts[y] + sizes[y]]].sum() for y in near])
        present[own] = 0
        near = near[shared >= threshold * (sizes[near] + sizes[x] - shared) - 1e-9]
        links[x] += weights[near].sum()
        links[near] += weights[x]
        for other in np.unique(label[near]):
            if other != label[x]:
                label[label == other] = label[x]
    least = np.full(len(nodes), LAST, np.int64)
    np.minimum.at(least, label, nodes)
    return links, [(int(n), int(m)) for n, m in zip(nodes, least[label], strict=True) if n != m]


def _verify(threshold: float):
    fewest = fewest_matches(threshold, TOLERANCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles_of = Shingler()
        for group in _groups(batches, ["cluster", "i", "j"]):
            nodes, first = np.unique(group["node"].to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            texts = group["text"].take(pa.array(first)).to_pylist()
            weights, blocks = (group[c].to_numpy()[first] for c in ("copies", "block"))
            across = group["i"][0].as_py() != group["j"][0].as_py()
            links, edges = verify_block(nodes, weights, blocks, [shingles_of(t) for t in texts], across, threshold, fewest)
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*nodes[linked].tolist(), *(e[0] for e in edges)], pa.int64()),
                 pa.array([*[None] * len(linked), *(e[1] for e in edges)], pa.int64()),
                 pa.array([*links[linked].tolist(), *[0] * len(edges)], pa.int64())],
                ["node", "other", "links"],
            )

    return run


def _one_text_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal key and text are the same node, however many there are; a task passes on one of them."""
    seen: set[int] = set()
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        first = [at for at, node in enumerate(nodes) if not (node in seen or seen.add(node))]
        if first:
            yield batch if len(first) == len(nodes) else batch.take(pa.array(first, pa.int64()))


def _cells(frame: DataFrame, blocks: Column) -> DataFrame:
    """Deals each row to the cells of its block: with itself and with every other block."""
    dealt = frame.withColumn("blocks", blocks.cast("int")).withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    )
    dealt = dealt.withColumn("other_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns(
        {"i": F.least("block", "other_block"), "j": F.greatest("block", "other_block")}
    ).drop("other_block", "blocks")


def _rank(key: Column) -> Column:
    return F.coalesce(key.cast("long"), F.lit(LAST))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tables: Tables | None = None
) -> DataFrame:
    """One row per document: rank, mark, class_rank, class_mark, copies, links.

    (rank, mark) is the document: its key (a null key comes last) and a hash of its
    text. A class is a connected component of the links; its least document stands for
    it. ``links``: other documents with a similarity of at least ``threshold``, among
    them the ``copies`` - 1 with the same shingles. A document without words has no
    links and is a class of its own.
    """
    tables = tables or Tables(docs.sparkSession, "jaccard")
    marked = docs.select(_rank(F.col(key)).alias("rank"), whole(F.col(text)).alias("text")).withColumn(
        "mark", F.xxhash64("text")
    )
    described = tables.put(
        marked.mapInArrow(
            _describe, "rank long, mark long, digest binary, size long, bands array<long>, signature binary"
        )
    )
    nodes = described.filter("digest is not null").groupBy("digest").agg(
        F.min(F.struct("rank", "mark")).alias("who"), F.count("*").alias("copies"), F.first("size").alias("size"),
        F.first("bands").alias("bands"), F.first("signature").alias("signature"),
    )
    nodes = tables.put(nodes.withColumn("node", F.monotonically_increasing_id()))
    rows = tables.put(described.select("rank", "mark", "digest"))
    tables.drop(described)

    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members"), F.min("node").alias("first")
    ).filter("n > 1")
    distinct = tables.put(buckets.groupBy("n", "members", "first").agg(F.min("band").alias("band")).select("band", "n"))
    members = banded.join(distinct, "band").join(nodes.select("node", "size", "signature"), "node")
    dealt = _cells(members, F.ceil(F.col("n") / BUCKET_ROWS)).select("band", "i", "j", "node", "size", "signature")
    survived = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(
        _link_buckets(threshold), "a long, b long"
    )
    clusters = components(survived, tables).withColumnRenamed("root", "cluster")
    tables.drop(distinct)
    known = tables.put(nodes.select("digest", "node", "who", "copies", "size"))
    tables.drop(nodes)

    placed = tables.put(clusters.join(known, "node").drop("digest"))
    needed = F.ceil(F.greatest(F.sum("size") / BLOCK_SHINGLES, F.count("*") / BLOCK_TEXTS)).cast("int")
    totals = tables.put(placed.groupBy("cluster").agg(needed.alias("blocks")))
    placed = tables.put(placed.join(totals, "cluster").select(
        "node", "cluster", "copies", "blocks", F.col("who.rank").alias("rank"), F.col("who.mark").alias("mark")
    ))
    with_text = lookup(marked, placed, ["rank", "mark"], "inner").select("node", "cluster", "copies", "blocks", "text")
    with_text = with_text.mapInArrow(_one_text_each, "node long, cluster long, copies long, blocks int, text string")
    dealt = _cells(with_text, F.col("blocks")).select(
        "cluster", "i", "j", "block", "node", "copies", "text"
    )
    verified = tables.put(
        dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(
            _verify(threshold), "node long, other long, links long"
        )
    )
    links = verified.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(
        verified.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), tables
    )

    grouped = tables.put(
        known.join(classes, "node", "left")
        .join(links, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    heads = tables.put(grouped.groupBy("root").agg(F.min("who").alias("head")))
    named = tables.put(
        grouped.join(heads, "root").select(
            "digest", "copies", F.col("head.rank").alias("class_rank"), F.col("head.mark").alias("class_mark"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
        )
    )
    # What is left: the rows and what each digest is called.
    tables.drop(*(t for t, _ in tables.paths if t is not rows and t is not named))
    found = rows.filter("digest is not null").join(named, "digest").drop("digest")
    alone = rows.filter("digest is null").select(
        "rank", "mark", F.lit(1).cast("long").alias("copies"), F.col("rank").alias("class_rank"),
        F.col("mark").alias("class_mark"), F.lit(0).cast("long").alias("links"),
    )
    return found.unionByName(alone)


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: key, class_id (the least key of its class), n_links.

    Nulls, empty texts and repeated rows as in :func:`near_duplicates`; a class of null
    keys only has a null id. No rows in, none out. Other columns are not read.
    """
    rows = near_duplicates(docs, key, text, threshold)

    def plain(rank: str) -> Column:
        return F.when(F.col(rank) != LAST, F.col(rank))

    return rows.select(plain("rank").alias(key), plain("class_rank").alias("class_id"), F.col("links").alias("n_links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, with one of each class. Rows with equal key and text stay or go together."""
    tables = Tables(docs.sparkSession, "jaccard")
    gone = near_duplicates(docs, key, text, threshold, tables).filter("rank != class_rank or mark != class_mark")
    rank, mark = fresh(docs, "_rank", "_mark")
    gone = tables.put(gone.select(F.col("rank").alias(rank), F.col("mark").alias(mark)))
    tables.drop(*(t for t, _ in tables.paths if t is not gone))
    marked = docs.withColumns({rank: _rank(F.col(key)), mark: F.xxhash64(whole(F.col(text)))})
    return lookup(marked, gone, [rank, mark], "left_anti").drop(rank, mark)
