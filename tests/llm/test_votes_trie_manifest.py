import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from goldseam.llm import merkle, prefix_trie, ranges, twins, weak_rules

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TURNS = "conv_id long, turn long, role string, text string"


def bag(rows, names):
    return Counter(tuple(r[n] for n in names) for r in rows)


# --- votes -----------------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for at, window in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if windows[window] > 1:
            inside |= {at, at + 1, at + 2}
    dup = sum(line in lines[:at] for at, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


LINES = [(20, "a b c\na b c\n\n \na b c", None, None, None), (21, "x\x1cy z #1\r\nx\x1cy z #1\r", None, None, None),
         (22, "w w w w", None, None, None), (23, "one two three " * 40, None, None, None)]


@pytest.mark.parametrize("name", ["odd", "sample", "none", "lines"])
def test_base_counts_equal_brute_force(request, spark, name):
    docs = (
        spark.createDataFrame(LINES, "doc_id long, text string, lang string, source string, n_chars long")
        if name == "lines" else request.getfixturevalue(name)
    )
    got = weak_rules.judge(docs).collect()
    want = Counter()
    for r in docs.collect():
        n, *rest = counts_by_hand(r.text)
        failed = n < 50 or 100 * rest[-1] > 50 * n
        want[(r.doc_id, n, *rest, failed)] += 1
    assert bag(got, ["doc_id", *weak_rules.COUNTS, "base_failed"]) == want
    assert all(r.kept == (not r.base_failed and r.p_good >= 0.5) for r in got)


def test_long_text_is_counted_whole():
    words = ["w%d" % (i % 70_000) for i in range(400_000)]
    text = " ".join(words) + "\n$"
    assert weak_rules.text_counts(text)[:5] == (400_001, sum(map(len, words)) + 1, 1, 0, 400_000)


def test_votes_and_posterior_equal_brute_force(spark):
    """Votes from the rules' own words, EM with dictionaries, posterior by products of chances."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [*weak_rules.COUNTS, *weak_rules.MORE]
    got = {r.doc_id: r for r in weak_rules.judge(docs).collect()}
    votes, failed = {}, {}
    for r in docs.collect():
        value = dict(zip(names, weak_rules.text_counts(r.text or ""), strict=True))
        found = ""
        for _, statistic, base, (low, high), below, above in weak_rules.RULES:
            over = 1 if base is None else value[base]
            x = value[statistic] / over if over else None
            bad = x is not None and ((below is not None and x < below) or (above is not None and x > above))
            found += "2" if x is None else "0" if bad else "1" if low <= x <= high else "2"
        votes[r.doc_id] = found
        failed[r.doc_id] = got[r.doc_id].base_failed
    assert votes == {i: r.votes for i, r in got.items()}
    table = Counter(v for i, v in votes.items() if not failed[i])
    share, chance = weak_rules.PRIOR_GOOD, {(y, j, v): weak_rules.PRIOR[y][v] for y in (0, 1) for j in range(10) for v in range(3)}

    def good(pattern):
        one, zero = (
            p * math.prod(chance[y, j, int(v)] for j, v in enumerate(pattern)) for y, p in ((1, share), (0, 1 - share))
        )
        return one / (one + zero)

    for _ in range(weak_rules.ROUNDS):
        belief = {p: good(p) for p in table}
        sums = {k: weak_rules.STRENGTH * weak_rules.PRIOR[k[0]][k[2]] for k in chance}
        for p, n in table.items():
            for j, v in enumerate(p):
                sums[1, j, int(v)] += n * belief[p]
                sums[0, j, int(v)] += n * (1 - belief[p])
        before = share
        share = (sum(n * belief[p] for p, n in table.items()) + weak_rules.STRENGTH * weak_rules.PRIOR_GOOD) / (
            sum(table.values()) + weak_rules.STRENGTH
        )
        chance = {(y, j, v): s / sum(sums[y, j, w] for w in range(3)) for (y, j, v), s in sums.items()}
        if abs(share - before) < weak_rules.SETTLED:
            break
    assert all(abs(r.p_good - good(votes[i])) < 1e-6 for i, r in got.items())


def test_accuracies_of_made_up_rules_are_found():
    rng = np.random.default_rng(5)
    truth = (rng.random(20_000) < 0.7).astype(int)
    against_bad, against_good = np.array([0.8, 0.6, 0.7, 0.5, 0.9]), np.array([0.02, 0.05, 0.1, 0.01, 0.05])
    chance = np.where(truth[:, None] == 1, against_good, against_bad)
    votes = np.where(rng.random((20_000, 5)) < chance, 0, 1)
    votes[rng.random((20_000, 5)) < 0.2] = 2
    patterns, counts = np.unique(votes @ 3 ** np.arange(4, -1, -1), return_counts=True)
    model = weak_rules.fit(patterns, counts, 5)
    assert abs(model.good - 0.7) < 0.02
    assert np.abs(model.chances[0][:, 0] - 0.8 * against_bad).max() < 0.03
    assert np.abs(model.chances[1][:, 0] - 0.8 * against_good).max() < 0.03


def test_kept_follows_unread_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = weak_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(
        spark.read.parquet(f"{folder}/labels.parquet"), "doc_id"
    ).filter("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.97 * len(rows)


# --- trie ------------------------------------------------------------------


def trie_by_hand(rows):
    """Nodes by walking the prefixes themselves."""
    own = {}
    for r in rows:
        if r.conv_id is not None:
            own.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    for c, turns in own.items():
        turns.sort(key=lambda t: (
            t[0] is not None, t[0] or 0, hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).hexdigest()))
        own[c] = [t[1:] for t in turns]
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(built[c]) == len(path)))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(q) == len(path) + 1 for q in below), len(leaves),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return Counter(out)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made_up(spark, seed):
    pick = random.Random(seed)
    rows = []
    for conv in [*range(-9, 40), 10**12]:
        for turn in range(pick.choice([1, 1, 2, 4, 9, 14])):
            shared = turn < 3
            rows.append((
                conv, pick.choice([turn, turn, turn, None, 1]), "u" if shared else pick.choice(["u", "a", None]),
                "same" if shared else pick.choice(["x", "é😀", "", None]),
            ))
    rows += [(None, 1, "u", "no conversation"), (3, 2, "u", "twice"), (3, 2, "u", "twice")]
    frame = spark.createDataFrame(rows, TURNS)
    return frame.withColumns({"depth": F.lit(1), "m": F.lit("x"), "shared": F.lit(True)}).repartition(3)


@pytest.mark.parametrize("max_bits", [27, 4])
def test_trie_equals_brute_force(spark, max_bits):
    """With a sketch too small to prove much, and with one that proves most singletons."""
    frame = made_up(spark, max_bits)
    got = prefix_trie.prefix_trie(frame, max_bits)
    assert sorted(got.columns) == sorted(NODE)
    assert bag(got.collect(), NODE) == trie_by_hand(frame.collect())


@pytest.mark.parametrize("keep", ["conv_id = 7", "false", "conv_id is null", "conv_id % 5 = 0"])
def test_trie_of_little(spark, keep):
    frame = made_up(spark, 1).filter(keep)
    assert bag(prefix_trie.prefix_trie(frame).collect(), NODE) == trie_by_hand(frame.collect())


def test_turnless_conversations(spark):
    """Conversation 1 keeps nothing of its own (crc32("1") % 9 = 5) and conversation 0 does not exist."""
    assert zlib.crc32(b"1") % 9 > 1
    frame = spark.createDataFrame([(1, 0, "u", "gone")], TURNS)
    row, = prefix_trie.prefix_trie(frame).collect()
    assert (row.conv_id, row.depth, row.n_convs, row.n_children, row.n_leaves) == (1, 0, 1, 0, 1)
    assert row.ends_sha256 == hashlib.sha256(b"1").hexdigest()


def test_long_conversations_span_chunks(spark, monkeypatch):
    """Two conversations of more turns than a chunk has, alike up to a turn in the third chunk."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = [(c, t, "u", f"t{t}" if t < 20 else f"{c} {t}") for c in (5, 10, 6) for t in range(40)]
    frame = spark.createDataFrame(rows, TURNS)
    assert bag(prefix_trie.prefix_trie(frame).collect(), NODE) == trie_by_hand(frame.collect())


def test_screen_proves_only_singletons_and_most_of_them(spark):
    rows = spark.range(3_000).select(F.xxhash64("id").alias("p1"), F.xxhash64(F.lit(7), "id").alias("p2"))
    twice = rows.unionByName(rows.limit(300))
    bits, marks = prefix_trie.sketch(twice, 3_300)
    p = twice.toPandas()
    seen = np.ones(len(p), bool)
    for row in range(prefix_trie.SKETCH_ROWS):
        cell = prefix_trie.cells(p.p1.to_numpy(), p.p2.to_numpy(), row, bits)
        seen &= (marks[row, cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    shared = p.duplicated(keep=False).to_numpy()
    assert seen[shared].all() and seen[~shared].mean() < 0.1


# --- manifest --------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest_by_hand(rows):
    def leaf(r, text):
        values = (r.doc_id, r.source, r.lang, r.n_chars, text)
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    keys = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in keys:
        sources[s].sort(key=lambda x: x[:3])
        trees.append(levels_of([x[2] for x in sources[s]]))
    top = levels_of([t[-1][0] for t in trees])
    out = Counter()
    for at, s in enumerate(keys):
        for i, (_, _, own, r) in enumerate(sources[s]):
            sides = []
            for levels, j in ((trees[at], i), (top, at)):
                for level in levels[:-1]:
                    first = j // 16 * 16
                    sides.append((level[first:j], level[j + 1 : first + 16]))
                    j //= 16
            held = own
            if r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                held = leaf(r, r.text.translate(LOW))
            for left, right in sides:
                held = digest(*left, held, *right)
            root = top[-1][0]
            out[r.doc_id, own, trees[at][-1][0], root, digest(*(d for side in sides for half in side for d in half)), held, held == root] += 1
    return out


LEAF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def spread(docs, sources):
    return docs.withColumn("source", F.concat("source", (F.col("doc_id") % sources).cast("string")))


@pytest.mark.parametrize("name, change", [
    ("odd", None), ("none", None), ("sample", None), ("sample", lambda d: spread(d, 60)),
    ("sample", lambda d: d.filter("doc_id = 5")), ("sample", lambda d: d.withColumn("source", F.lit("a"))),
    ("sample", lambda d: d.filter("doc_id < 17").withColumn("source", F.lit(None).cast("string"))),
    ("sample", lambda d: spread(d, 1_000)), ("odd", lambda d: d.unionByName(d).unionByName(d)),
])
def test_manifest_equals_brute_force(request, name, change):
    docs = request.getfixturevalue(name)
    docs = change(docs) if change else docs
    got = merkle.manifest(docs)
    assert sorted(got.columns) == sorted(LEAF)
    assert bag(got.collect(), LEAF) == manifest_by_hand(docs.collect())


def test_proofs_by_jumping_through_a_deep_tree(spark):
    """A chain: 1,000 levels take ten rounds, and every path holds all segments in their order."""
    side = lambda i: F.struct(F.encode(i.cast("string"), "utf-8").alias("left"), F.lit(b"").alias("right"))
    level = F.col("id").cast("int")
    chain = spark.range(1_000).select(
        F.lit(0).cast("long").alias("tree"), level.alias("level"), F.lit(0).cast("long").alias("idx"), F.array(side(level)).alias("path"),
        F.lit(0).cast("long").alias("next_tree"), (level + 1).alias("next_level"), F.lit(0).cast("long").alias("next_idx"),
        F.lit(None).cast("binary").alias("subroot"),
    )
    last = F.col("level") == 999
    chain = chain.withColumns({c: F.when(~last, F.col(c)) for c in ("next_tree", "next_level", "next_idx")})
    for r in merkle.jump(chain, 10).select("level", "path.left").collect():
        assert [int(bytes(x)) for x in r.left] == list(range(r.level, 1_000))


def test_places_over_many_ranges(spark):
    frame = spark.range(5_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 7).alias("v")
    )
    rows = ranges.places(frame, "g", ["v"], ranked=True).collect()
    groups = sorted({r.g for r in rows})
    for rank, g in enumerate(groups):
        mine = sorted((r.at, r.v) for r in rows if r.g == g)
        assert [a for a, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
        assert {(r.rank, r.n) for r in rows if r.g == g} == {(rank, len(mine))}


def test_crc32_in_sql():
    values = [0, 5, -17, 123456789, -(2**63)]
    got = duckdb.sql(f"select {twins.crc32_sql('i::varchar')} from (values {','.join(f'({v})' for v in values)}) t(i)").fetchall()
    assert [r[0] for r in got] == [zlib.crc32(str(v).encode()) for v in values]


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_manifest"])
def test_queries_equal_their_sql(spark, name):
    import os
    import sys

    import __spark_entry__ as registry

    sys.path.insert(0, os.path.join(os.path.dirname(registry.__file__), "tools"))
    import compare

    sf = "/root/testdata/sf0.001"
    assert compare.compare(spark, compare.connect(sf), sf, name) is None
