import functools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from goldseam.llm import packing, pareto_mix
from goldseam.llm.queries import tokenizer_file


def brute_targets(sizes, shares=(5, 2, 1), amount=1.5, ceiling=2.0):
    """Share, stop what is above, share the excess again, until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    fixed, total = {}, amount * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left, weights = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / weights > ceiling * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / weights for s in free}
        fixed |= {s: ceiling * sizes[s] for s in over}


def count_words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_mixed_sizes(request, name):
    docs = request.getfixturevalue(name)
    got = pareto_mix.mixed_sizes(docs).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, count_words(r.text)) for r in rows)
    if not rows:
        return
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)
    totals = defaultdict(int)
    for r in rows:
        totals[r.source] += count_words(r.text)
    want = brute_targets(dict(totals))
    assert Counter((r.source_size, round(r.target, 6)) for r in got) == Counter(
        (totals[r.source], round(want[r.source], 6)) for r in rows
    )


def test_taken_words_are_near_the_target(spark, sample):
    source = {r.doc_id: r.source for r in sample.collect()}
    got = pareto_mix.mixed_sizes(sample).collect()
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.02 * sum(target.values())
    again = pareto_mix.mixed_sizes(sample.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)


def test_inclusion_follows_the_stated_chances(spark):
    """Over many seeds, documents come in as often as their class's chance says, short ones more often."""
    rows = [(i, "w " * (2 if i % 2 else 16), "a" if i < 80 else "b") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = Counter()
    for seed in range(6):
        for r in pareto_mix.mixed_sizes(docs, shares=(1, 8), amount=1.0, ceiling=1.5, seed=seed).collect():
            if r.doc_id < 80:
                seen[r["size"]] += r.copies
    assert seen[2] > seen[16] > 0


def test_ties_are_taken_one_by_one(spark):
    """A third of all rows tie: no key, one size, one source; the texts are of two kinds."""
    tied = [(None, f"{'w' if i % 2 else 'v'} " * 10, "a") for i in range(600)]
    others = [(i, "w " * (1 + i % 37), "b" if i % 3 else None) for i in range(1_200)]
    docs = spark.createDataFrame(tied + others, "doc_id long, text string, source string").repartition(4)
    for shares in ((5, 2, 1), (5, 20, 20), (1, 3, 2)):
        got = pareto_mix.mixed_sizes(docs, shares=shares).collect()
        mine = [r for r in got if r.source_size == 6_000 and r["size"] == 10]
        assert len(mine) >= 600 and abs(sum(r.taken for r in mine) - mine[0].target) <= 10
    one, two = (Counter(tuple(r) for r in pareto_mix.mix(d, shares=(1, 3, 2)).collect()) for d in (docs, docs.repartition(7)))
    assert one == two
    taken = Counter(r.doc_id for r in pareto_mix.mix(docs, shares=(1, 3, 2)).collect())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert taken == +want


def test_selection_equals_brute_force(spark, sample):
    """Whole copies, then Pareto ranks of the rest until the next would pass, then the document nearest to the gap."""
    import math

    from pyspark.sql import functions as F

    from goldseam.llm.common import uniform

    tie = F.xxhash64("doc_id", pareto_mix.source_key(F.col("source")), pareto_mix.word_count(F.col("text")))
    drawn = sample.withColumn("u", uniform(F.lit(3), tie, F.lit(0).cast("long"))).collect()
    sources = defaultdict(list)
    for r in drawn:
        sources[r.source].append((r.doc_id, count_words(r.text), r.u))
    targets = brute_targets({s: sum(n for _, n, _ in rows) for s, rows in sources.items()})
    want = {}
    for s, rows in sources.items():
        total = sum(n for _, n, _ in rows)
        whole = int(targets[s] // total)
        need = targets[s] - whole * total
        kind = lambda n: int(math.log2(n)) if n else 0
        low, high = 0.0, 1e6
        for _ in range(200):
            level = (low + high) / 2
            words = sum(min(1.0, level / (2 + kind(n))) * n for _, n, _ in rows)
            low, high = (low, level) if words >= need else (level, high)
        ranked = []
        for i, n, u in rows:
            want[i] = whole
            p = min(1.0, high / (2 + kind(n)))
            if n and p > 0 and need > 0:
                ranked.append((u * (1 - p) / (u * (1 - p) + p * (1 - u)), i, n))
        ranked.sort()
        so_far, at = 0, 0
        while at < len(ranked) and so_far + ranked[at][2] <= need:
            so_far += ranked[at][2]
            want[ranked[at][1]] += 1
            at += 1
        gap = need - so_far
        nearest = min(((abs(n - gap), rank, i) for rank, i, n in ranked[at:]), default=(gap,))
        if nearest[0] < gap:
            want[nearest[2]] += 1
    got = pareto_mix.mixed_sizes(sample, seed=3).collect()
    assert {r.doc_id: r.copies for r in got} == want


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_mix_repeats_rows(request, name):
    docs = request.getfixturevalue(name)
    mixed = pareto_mix.mix(docs)
    assert mixed.schema == docs.schema
    want = Counter()
    for r in pareto_mix.mixed_sizes(docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want


sizes_of = st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=12)


def expand(layouts):
    return [[s for s, k in parts for _ in range(k)] for times, parts in layouts for _ in range(times)]


@settings(max_examples=200, deadline=None)
@given(sizes_of)
def test_reduction_and_best_fit_place_every_piece_once(counts):
    fixed, left = packing.reduce_instance(counts, 40)
    bins = expand([*fixed, *packing.best_fit(left, 40)])
    assert Counter(s for b in bins for s in b) == +Counter(counts)
    assert all(sum(b) <= 40 for b in bins)
    plain = expand(packing.best_fit(counts, 40))
    assert len(bins) <= len(plain) + 1


def fewest_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x + items[i] <= capacity}):
            rest = list(bins)
            rest.remove(b)
            place(i + 1, [*rest, b + items[i]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_never_costs_a_sequence(items):
    fixed, left = packing.reduce_instance(dict(Counter(items)), 12)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert len(expand(fixed)) + fewest_bins(rest, 12) == fewest_bins(items, 12)


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_pack(request, name):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, tokenizer_file()).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[r.doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 1024 * 1.02 + 2


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_the_encoder_gives_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    tokenizer.encode_special_tokens = True
    assert packing._encoder(tokenizer_file()).encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y \n <|endoftext|", "no marker", "<|endoftext|>" + "word " * 3_000]


def test_pack_knows_the_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    assert tokenizer.encode(MARKED[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.pack(spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string"), tokenizer_file()).collect()
    want = Counter()
    for key, text in enumerate(MARKED):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        bounds = packing.piece_bounds(len(ids), 1024)
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[key, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


@functools.cache
def loaded_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", " ", "<|", "|>"])), max_size=8))
def test_ids_with_markers_are_those_of_the_tokenizer_as_loaded(parts):
    text = "".join(parts)
    tokenizer = loaded_tokenizer()
    assert list(packing._ids(tokenizer_file())(text)) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("flag", ["lstrip", "rstrip", "single_word"])
def test_added_tokens_that_take_neighbours_along(tmp_path, flag):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_file(), encoding="utf-8") as file:
        described = json.load(file)
    described["added_tokens"][0][flag] = True
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(described), encoding="utf-8")
    tokenizer = Tokenizer.from_file(str(path))
    for text in MARKED:
        assert list(packing._ids(str(path))(text)) == tokenizer.encode(text, add_special_tokens=False).ids
