import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldseam.llm import components, exact_dedup, jaccard_join, passage_dedup
from goldseam.llm.common import Tables

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_exact(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[(text or "").translate(TABLE)].append(key)
    out = []
    for text, keys in groups.items():
        best = max((k for k in keys if k is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, best, len(keys), digest) for k in keys]
    return Counter(out)


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_exact_duplicates(request, name):
    docs = request.getfixturevalue(name)
    got = exact_dedup.exact_duplicates(docs).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_exact(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("name", ["odd", "none"])
def test_keep_last_keeps_all_columns(request, name):
    docs = request.getfixturevalue(name)
    kept = exact_dedup.keep_last(docs)
    assert kept.schema == docs.schema
    want = {key: n for (key, best, n, d), _ in brute_exact([(r.doc_id, r.text) for r in docs.collect()]).items() if key == best}
    assert Counter(r.doc_id for r in kept.collect())[9] == (1 if want else 0)
    assert kept.count() == len(brute_by_text(docs))


def brute_by_text(docs):
    return {(r.text or "").translate(TABLE) for r in docs.collect()}


def test_cuckoo_filter_grows_and_forgets():
    held, keys = exact_dedup.CuckooFilter(4), [hashlib.sha256(str(i).encode()).digest() for i in range(3_000)]
    for key in keys:
        assert held.find(key) < 0
        held.insert(key)
    assert held.mask + 1 >= 3_000 // 4
    assert all(held.digests[held.find(k)] == k for k in keys)
    for key in keys[::2]:
        held.delete(key)
    assert all((held.find(k) >= 0) == (i % 2 == 1) for i, k in enumerate(keys))


def test_a_false_hit_is_not_a_copy():
    held = exact_dedup.CuckooFilter(4)
    a = b"\x01\x02" + bytes(6) + bytes(8) + b"a" * 16
    b = b"\x01\x02" + bytes(6) + bytes(8) + b"b" * 16
    held.insert(a)
    assert held.place(a) == held.place(b) and held.find(b) < 0


def test_index_takes_insertions_and_deletions(spark):
    def changes(rows):
        frame = spark.createDataFrame(rows, "t string, live long, keep_rank long, keep_row long")
        return frame.withColumn("digest", F.unhex(F.sha2("t", 256))).drop("t")

    index = exact_dedup.update_index(None, changes([("a", 1, 1, 0), ("a", 1, 4, 0), ("b", 1, 2, 0)]), 3)
    index = exact_dedup.update_index(index, changes([("a", -1, 0, 0), ("b", -1, 0, 0), ("c", 1, 9, 0), ("x", -1, 0, 0)]), 3)
    held = {bytes(r.digest): (r.live, r.keep_rank) for r in index.collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert held == {digest("a"): (1, 4), digest("c"): (1, 9)}


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_links(rows, threshold=0.8):
    sets = [shingles(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if both >= threshold * (len(a) + len(b) - both) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    heads = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        heads[root(i)].append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in heads.items()}
    return Counter((key, least[root(i)], links[i]) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_jaccard_join(request, name):
    docs = request.getfixturevalue(name)
    got = jaccard_join.jaccard_join(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links([(r.doc_id, r.text) for r in docs.collect()])


def family(members, words=80, seed=1):
    """Near copies of one text, and texts that share only half of it."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(members):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(words)] = f"e{i}"
        rows.append((i, " ".join(own)))
    for i in range(members, 2 * members):
        rows.append((i, " ".join(base[: words // 2] + [f"o{i}_{k}" for k in range(words // 2)])))
    return rows


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 7)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(jaccard_join, "BLOCK_TEXTS", 5)
    rows = family(60)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)


@pytest.mark.parametrize("name", ["odd", "none"])
def test_keep_one(request, name):
    docs = request.getfixturevalue(name)
    kept = jaccard_join.keep_one(docs)
    assert kept.schema == docs.schema
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[5] == 0 and (not ids or ids[1] == 1)


def test_pruning_keeps_pairs_at_the_threshold():
    fewest = jaccard_join.fewest_matches(0.8, 1e-6)
    assert fewest == sorted(fewest) and fewest[-1] < 0.8 * jaccard_join.COMPARED
    shared, rng = list(range(800)), random.Random(5)
    for trial in range(20):
        base = [rng.getrandbits(64) for _ in shared]
        a = np.unique(np.array(base + [rng.getrandbits(64) for _ in range(100)], np.uint64))
        b = np.unique(np.array(base + [rng.getrandbits(64) for _ in range(100)], np.uint64))
        rows = np.stack([jaccard_join.min_hashes(x, jaccard_join.COMPARED) & np.uint32(0xFFFF) for x in (a, b)])
        assert len(jaccard_join.may_reach(rows, np.array([len(a), len(b)]), 0, np.array([1]), 0.8, fewest)) == 1, trial


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    star = [(1000, i) for i in range(1001, 1050)]
    got = components.components(spark.createDataFrame(chain + star, "a long, b long"), Tables(spark, "test"))
    roots = {r.node: r.root for r in got.collect()}
    assert roots == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100, **dict.fromkeys(range(1000, 1050), 1000)}


def brute_passages(rows, min_words):
    first, out = {}, {}
    key = lambda k: (k is None, k or 0)
    for k, t in sorted(rows, key=lambda r: key(r[0])):
        for a, _, normal in passage_dedup.units(t or ""):
            if normal:
                first[normal] = min(first.get(normal, (key(k), a)), (key(k), a))
    for k, t in rows:
        repeated = {a for a, _, n in passage_dedup.units(t or "") if n and first[n] != (key(k), a)}
        out[k, t] = ",".join(f"{a}:{b}" for a, b in passage_dedup.removed_spans(t or "", repeated, min_words))
    return out


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
@pytest.mark.parametrize("min_words", [5, 25])
def test_drop_repeats(request, name, min_words):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_passages(rows, min_words)
    got = passage_dedup.drop_repeats(docs, min_words=min_words).collect()
    assert Counter((r.doc_id, r.removed) for r in got) == Counter((k, want[k, t]) for k, t in rows)


def test_offsets_give_the_text_back():
    text = "One two.\nA b c d e f. G h i!  Last words"
    tiles = list(passage_dedup.units(text))
    assert "".join(text[a:b] for a, b, _ in tiles) == text
    assert [n for _, _, n in tiles] == ["one two.", "a b c d e f.", "g h i!", "last words"]


def test_a_shared_passage_goes_and_the_rest_stays(spark):
    passage = " ".join(f"sentence number {i} of the passage has seven words." for i in range(10))
    rows = [(i, f"Own opening {i} here. {passage}\nOwn ending {i} there.") for i in range(5)]
    got = {r.doc_id: r.text for r in passage_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"Own opening {i} here. Own ending {i} there." for i in range(1, 5))


def test_repeated_rows_are_one_node(spark):
    """Rows without a key that share a text, most of the table, with a near copy of it."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(None, words)] * 500 + [(7, words + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = jaccard_join.jaccard_join(docs).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert {(r[0], r[1], r[2]): r[3] for r in found} == {(None, 7, 500): 500, (7, 7, 500): 1}


def left_over(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r.text for r in passage_dedup.drop_repeats(docs).collect()}


def test_repeated_short_lines_go(spark):
    license_line = "This work is licensed under the GNU General Public License, version 3."
    texts = [f"Own words of text {i} begin it.\n{license_line}\nMenu\nIt ends with {i} words." for i in range(4)]
    got = left_over(spark, [*texts, "Menu", f"Menu\n{license_line}", "Fresh line. Menu\nNew"])
    assert got[0] == texts[0]
    assert all(got[i] == f"Own words of text {i} begin it.\nIt ends with {i} words." for i in range(1, 4))
    assert (got[4], got[5], got[6]) == ("", "", "Fresh line. Menu\nNew")


def test_a_passage_cut_inside_sentences_loses_its_whole_sentences(spark):
    inner = " ".join(f"sentence {i} inside of it has words." for i in range(3))
    passage = f"{' '.join(f'head{i}' for i in range(17))}. {inner} {' '.join(f'tail{i}' for i in range(17))}"
    assert 50 < len(passage.split()) <= 92
    got = left_over(spark, [f"Here text {i} opens with {passage} and closes by {i}." for i in range(3)])
    assert inner in got[0] and not any(inner in got[i] for i in (1, 2))
    assert all(f"Here text {i} opens with" in got[i] and f"closes by {i}." in got[i] for i in range(3))


def test_new_lines_of_known_parts_stay(spark):
    texts = ["3.5 and\n14\n", "3.14\n", "Dr. Who\n", "Dr. Strange speaks here\n"]
    got = left_over(spark, ["3.\n", *texts])
    assert [got[i + 1] for i in range(4)] == texts
