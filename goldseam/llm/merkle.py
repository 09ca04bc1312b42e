"""A Merkle manifest of a table, with a proof for every row.

Every row is a leaf; 16 consecutive nodes of a source make one node of the next
level, the nodes left at the top (one per source) make the tree over all sources.
Whoever holds the root can check a row by its digest and its proof: the siblings
on the way up.

Proofs come from pointer jumping. Every inner node first holds one segment, its
siblings below its parent, and a pointer to that parent. A self-join appends the
segments that the pointed node holds and takes over its pointer, so the distance
doubles each time and a tree of height h takes log2(h) joins. Leaves take no part
in it: a run of 16 leaves is one row that ends up with the path they share.

The pointed node may be an ancestor of very many. Pointing rows are therefore
dealt by (ancestor, salt), and an ancestor is sent once to each salt in use.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import cut
from goldseam.llm.ranges import places

FAN = 16
SALTS, SALT_RUNS = 4_096, 64
TOP = -1
_BITS, _WIDTH = 4, 32
_NODE = ["tree", "level", "idx"]
_NEXT = ["next_tree", "next_level", "next_idx"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(hexed: Column) -> Column:
    return F.unhex(F.sha2(hexed.cast("binary"), 256))


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def encoded(value: Column) -> Column:
    """'-' for null, else the length in bytes, ':' and the value; so different rows never encode alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return _digest(F.concat(*(encoded(v) for v in values)))


def _lowered(text: Column) -> Column:
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _joined(kids: Column) -> Column:
    """The kids' digests as one hex text."""
    return F.array_join(F.transform(kids, lambda k: _text(k["digest"])), "")


def _level(nodes: DataFrame, tree: Column, level: Column, run: Column, slot: Column, n: Column) -> DataFrame:
    """The nodes of the next level; each keeps its kids and their digests in a row."""
    kid = F.struct(slot.cast("int").alias("slot"), *_NODE, "digest")
    grouped = nodes.groupBy(tree.alias("tree"), level.alias("level"), run.alias("idx"), n.alias("n")).agg(
        F.sort_array(F.collect_list(kid)).alias("kids")
    )
    hexed = grouped.withColumn("hexed", _joined(F.col("kids")))
    kept = F.transform("kids", lambda k: k.dropFields("digest"))
    return cut(
        hexed.select(*_NODE, "n", kept.alias("kids"), F.unhex("hexed").alias("row"), _digest(F.col("hexed")).alias("digest"))
    )


def _grow(first: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``first`` (level 1 of some trees), until each tree has a single node; ``most``: its largest n."""
    levels, reach = [first], FAN
    while most > reach:
        below = levels[-1].filter(F.col("n") > reach)
        levels.append(
            _level(
                below, F.col("tree"), F.col("level") + 1, F.shiftright("idx", _BITS), F.col("idx") % FAN, F.col("n")
            )
        )
        reach *= FAN
    return levels


def _beside(row: Column, slot: Column) -> Column:
    """The digests left and right of a slot."""
    left = F.substring(row, F.lit(1), slot * _WIDTH)
    right = F.substring(row, slot * _WIDTH + _WIDTH + 1, F.octet_length(row))
    return F.struct(left.alias("left"), right.alias("right"))


def _steps(levels: list[DataFrame]) -> DataFrame:
    """One row per kid of the given nodes: its siblings and a pointer to its parent."""
    frames = []
    for nodes in levels:
        opened = nodes.select(
            "row", F.col("tree").alias("next_tree"), F.col("level").alias("next_level"), F.col("idx").alias("next_idx"),
            F.explode("kids").alias("kid"),
        )
        frames.append(
            opened.select(
                *(F.col(f"kid.{c}").alias(c) for c in _NODE), F.array(_beside(F.col("row"), F.col("kid.slot"))).alias("path"),
                *_NEXT,
            )
        )
    return functools.reduce(DataFrame.unionByName, frames)


def jump(paths: DataFrame, rounds: int) -> DataFrame:
    """Paths to the root: (tree, level, idx, path, subroot, pointer); each round doubles the distance of the pointers."""
    salt = F.pmod(F.col("tree") * 31 + F.floor(F.col("idx") / SALT_RUNS), F.lit(SALTS)).alias("salt")
    paths = cut(paths)
    for _ in range(rounds):
        moving = paths.filter(F.col("next_tree").isNotNull()).withColumn("salt", salt)
        ahead = paths.select(
            *(F.col(c).alias(n) for c, n in zip(_NODE, _NEXT, strict=True)), F.col("path").alias("more"),
            F.col("subroot").alias("its_subroot"), *(F.col(n).alias(f"then_{n}") for n in _NEXT),
        )
        sent = moving.select(*_NEXT, "salt").distinct().join(ahead, _NEXT)
        moved = moving.join(sent, [*_NEXT, "salt"]).select(
            *_NODE, F.concat("path", "more").alias("path"), F.coalesce("subroot", "its_subroot").alias("subroot"),
            *(F.col(f"then_{n}").alias(n) for n in _NEXT),
        )
        paths = cut(moved.unionByName(paths.filter(F.col("next_tree").isNull())))
    return paths


def manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("lang", "n_chars"),
    text: str = "text", tamper_every: int = 5,
) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes key, source, ``fields`` and text, nulls included. Within a source
    leaves ascend by key (null first), then by digest, so repeated rows are
    neighbours with equal leaves; a null source is a source of its own and comes
    first. Documents whose key's crc32 ``tamper_every`` divides are folded with A-Z of
    their text lower-cased (a null key never is; a text without A-Z stays as it was,
    and verifies). An empty table gives no rows; other columns are not read.
    """
    def leaf(body: Column) -> Column:
        return leaf_digest(F.col(key), F.col(source), *(F.col(f) for f in fields), body)

    tampered = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % tamper_every == 0, F.lit(False))
    leaves = cut(
        docs.select(
            F.col(key).alias("key"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")).alias("skey"),
            leaf(F.col(text)).alias("digest"), F.when(tampered, leaf(_lowered(F.col(text)))).alias("changed"),
        )
    )
    placed = places(leaves, "skey", ["key", "digest"], ranked=True)
    member = F.struct((F.col("at") % FAN).cast("int").alias("slot"), "key", "digest", "changed")
    runs = placed.groupBy(F.col("rank").alias("tree"), F.shiftright("at", _BITS).alias("idx"), "n").agg(
        F.sort_array(F.collect_list(member)).alias("members")
    )
    hexed = runs.withColumn("hexed", _joined(F.col("members")))
    # A source of one leaf has no node above it: its run stands for the leaf.
    alone = F.col("n") == 1
    runs = cut(
        hexed.select(
            "tree", F.lit(1).alias("level"), "idx", "n", "members", F.unhex("hexed").alias("row"),
            F.when(alone, F.unhex("hexed")).otherwise(_digest(F.col("hexed"))).alias("digest"),
        )
    )
    sources, most = runs.agg(F.max("tree") + 1, F.max("n")).first()
    if sources is None:
        return _result(runs.withColumns({"path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("binary")}), key, b"")
    trees = _grow(runs.select("tree", "level", "idx", "n", "digest"), most)
    subroots = functools.reduce(
        DataFrame.unionByName,
        (t.filter(F.col("n") <= FAN ** (at + 1)).select(*_NODE, "digest") for at, t in enumerate(trees)),
    )
    parents, height = trees[1:], len(trees) - 1
    last = trees[-1]
    if sources > 1:
        first = _level(
            subroots, F.lit(TOP).cast("long"), F.lit(1), F.shiftright("tree", _BITS), F.col("tree") % FAN,
            F.lit(sources).cast("long"),
        )
        top = _grow(first, sources)
        parents, height, last = [*parents, *top], height + len(top), top[-1]
    root, root_tree, root_level = last.orderBy("level").select("digest", "tree", "level").first()
    if not parents:
        paths = runs.select(*_NODE).limit(0).withColumns(
            {"path": F.lit(None).cast(_PATH), "subroot": F.lit(None).cast("binary")}
        )
    else:
        steps = _steps(parents)
        at_root = (F.col("next_tree") == root_tree) & (F.col("next_level") == root_level)
        steps = steps.withColumns({n: F.when(~at_root, F.col(n)) for n in _NEXT})
        steps = steps.join(subroots.select(*_NODE, F.col("digest").alias("subroot")), _NODE, "left")
        paths = jump(steps, (height - 1).bit_length())
    paths = paths.filter("level = 1").filter(F.col("tree") != TOP).select("tree", "idx", "path", "subroot")
    return _result(runs.join(paths, ["tree", "idx"], "left"), key, bytes(root))


_PATH = "array<struct<left: binary, right: binary>>"


def _result(runs: DataFrame, key: str, root: bytes) -> DataFrame:
    """The leaves of the runs, each with its proof, and folded up again."""
    top = F.lit(root.hex())
    hexed = "array<struct<left: string, right: string>>"
    shared = F.coalesce(
        F.transform("path", lambda s: F.struct(_text(s["left"]), _text(s["right"]))).cast(hexed), F.array().cast(hexed)
    )
    opened = runs.select(
        shared.alias("path"), F.coalesce(_text(F.col("subroot")), top).alias("subroot"), "row", "n",
        F.explode("members").alias("m"),
    )
    own = _beside(F.col("row"), F.col("m.slot"))
    sides = F.struct(_text(own["left"]).alias("left"), _text(own["right"]).alias("right"))
    steps = opened.select(
        F.col("m.key").alias(key), _text(F.col("m.digest")).alias("leaf"), "subroot",
        _text(F.coalesce("m.changed", "m.digest")).alias("held"),
        F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(sides), "path")).alias("path"),
    )
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate(
        "path", F.col("held"), lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]).cast("binary"), 256)
    )
    out = steps.select(
        key, "leaf", "subroot", top.alias("root"), F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
