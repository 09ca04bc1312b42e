from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from goldseam.llm import exact_dedup, jaccard_join, pareto_mix, rule_quality

TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5
  If (feature 0 <= 2.5)
   Predict: 0.0
  Else (feature 0 > 2.5)
   If (feature 2 <= 0.25)
    Predict: 0.0
   Else (feature 2 > 0.25)
    Predict: 1.0
"""


def test_paths_become_rules():
    assert rule_quality.tree_rules(TREE) == {
        (("log_words", "<=", 2.5),), (("log_words", ">", 2.5),),
        (("distinct_words", "<=", 0.25), ("log_words", ">", 2.5)), (("distinct_words", ">", 0.25), ("log_words", ">", 2.5)),
    }


@pytest.mark.parametrize("name", ["odd", "sample", "none"])
def test_scores(request, name, labels):
    import zlib

    docs = request.getfixturevalue(name)
    got = rule_quality.quality_scores(docs, labels).collect()
    ids = [r.doc_id for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, held(i)) for i in ids)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    ordered = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.95 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)


def test_labels_of_held_out_documents_are_not_read(spark, sample, labels):
    turned = labels.withColumn("quality", F.when(rule_quality.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (
        {r.doc_id: round(r.score, 9) for r in rule_quality.quality_scores(sample, lab).collect()} for lab in (labels, turned)
    )
    assert one == two


def test_without_labels_everything_stays(spark, odd, labels):
    kept = rule_quality.keep_good(odd, labels.limit(0))
    assert kept.schema == odd.schema and kept.count() == odd.count()


def test_pipeline_stages(spark, tmp_path):
    """Every stage against what its operator's own result, or brute force, says of the stage's input."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        frames.append(docs)
    assert all(f.columns == frames[0].columns for f in frames[1:-1])
    quality, exact, near, mixed = (Counter(r.doc_id for r in f.collect()) for f in frames[1:-1])
    scored = rule_quality.quality_scores(frames[0], spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert quality == Counter(r.doc_id for r in scored if r.predicted)
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    last = {}
    for r in frames[1].collect():
        last[r.text.translate(table)] = max(last.get(r.text.translate(table), -1), r.doc_id)
    assert exact == Counter(last.values())
    assert exact == Counter(r.doc_id for r in exact_dedup.exact_duplicates(frames[1]).collect() if r.kept)
    assert near == Counter(r.doc_id for r in jaccard_join.jaccard_join(frames[2]).collect() if r.doc_id == r.class_id)
    assert mixed == +Counter({r.doc_id: r.copies for r in pareto_mix.mixed_sizes(frames[3]).collect()})
    assert Counter(r.doc_id for r in frames[-1].collect() if r.piece == 0) == mixed


def test_registered(spark):
    names = registry.queries()
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


def test_exact_query_equals_its_sql(spark):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(registry.__file__), "tools"))
    import compare

    sf = "/root/testdata/sf0.001"
    assert compare.compare(spark, compare.connect(sf), sf, "op9_exact_dedup") is None
