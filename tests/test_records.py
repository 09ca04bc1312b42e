import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from goldseam.sources import files, records
from goldseam.sources.files import read_csv_text, read_csv_typed

OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def some_field(pick):
    kind = pick.random()
    if kind < 0.3:
        return "".join(pick.choice("ab 1") for _ in range(pick.randrange(4)))
    if kind < 0.4:  # quotes that open nothing
        return pick.choice(['x"y', 'a "q" b', ' "z"', '5"'])
    inner = "".join(pick.choice(["a", "b", ",", '""', "\n", " ", '""""']) for _ in range(pick.randrange(7)))
    return f'"{inner}"' + ("x" if pick.random() < 0.03 else "")


def write_csv(path, seed, end="\n", rows=120):
    pick = random.Random(seed)
    lines = ["c1,c2,c3"] + [",".join(some_field(pick) for _ in range(pick.choice([3, 3, 2, 4]))) for _ in range(rows)]
    text = "\n".join(lines) + ("\n" if seed % 2 else "")
    path.write_text(text.replace("\n", end), newline="")
    return str(path)


@pytest.fixture
def small_blocks(spark):
    """Files are cut into blocks of 64 bytes, so that most values lie across some."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed, end", [(0, "\n"), (1, "\n"), (2, "\r\n"), (3, "\r\n"), (4, "\n")])
def test_cut_records_equal_the_multi_line_reader(spark, tmp_path, rows, small_blocks, seed, end):
    path = write_csv(tmp_path / "some.csv", seed, end)
    schema = "c1 string, c2 string, c3 string, more string"
    want = spark.read.schema(schema).options(**OPTIONS).csv(path)
    assert rows(read_csv_text(spark, path, ["c1", "c2", "c3"], surplus="more", cut=True)) == rows(want)


def test_many_files_in_blocks(spark, tmp_path, rows, small_blocks):
    for seed in range(4):
        write_csv(tmp_path / f"{seed}.csv", seed, rows=40)
    want = spark.read.schema("c1 string, c2 string, c3 string").options(**OPTIONS).csv(str(tmp_path))
    assert rows(read_csv_text(spark, str(tmp_path), ["c1", "c2", "c3"], cut=True)) == rows(want)


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_blocks):
    path = write_csv(tmp_path / "one.csv", 6, rows=400)
    found = records.spanning_records(spark, [path])
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan text" in line]
    assert scans and spark.read.text(path).rdd.getNumPartitions() > 20
    assert found.filter("head").count() == 1
    # The lines are dealt by block once; every other use of them reads that exchange again.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(file") >= 1


@pytest.mark.parametrize("text, want", [
    ("a,b\n", []), ('a,b\n"x\n",1', [("x\n", "1")]), ('\ufeffa,b\n"1\n",2\n\n\n', [("1\n", "2")]),
    ('a,b\n"never closed\n1,2\n', [("never closed\n1,2", None)]), ('"a\nb",c\n1,2\n', [("1", "2")]),
])
def test_odd_files(spark, tmp_path, text, want):
    path = tmp_path / "odd.csv"
    path.write_text(text)
    assert [tuple(r) for r in read_csv_text(spark, str(path), multi_line=True, cut=True).collect()] == want


def test_large_files_are_cut_without_being_asked(spark, tmp_path, rows, monkeypatch):
    path = write_csv(tmp_path / "some.csv", 5)
    columns = ["c1", "c2", "c3"]
    plan = lambda: read_csv_text(spark, path, columns)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan()
    whole = rows(read_csv_text(spark, path, columns))
    monkeypatch.setattr(files, "LARGE_FILE", 1_000)
    assert "Window" in plan() and rows(read_csv_text(spark, path, columns)) == whole


def test_typed_read_of_spanning_records(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text('id,note\n1,"x\n\ny"\nz,"q"\n')
    got = read_csv_typed(spark, str(path), {"id": "int", "note": "str"}, cut=True)
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x\n\ny"), (None, "q")]


@pytest.mark.parametrize("line", [
    "", "plain", '"', 'a,"b', 'a,"b"', '5" disk', 'x","y', 'a,""', '""', '"""', ',"a""', 'b"",c', '","', '"a"x"b"', '""""',
])
def test_effect_of_a_line(spark, line):
    """Each state after the line, compared with a walk over its characters."""
    def walk(state):
        at, begins = 0, True
        while at < len(line):
            c = line[at]
            if state:
                if c == '"' and line[at + 1 : at + 2] == '"':
                    at += 1
                elif c == '"':
                    state, begins = 0, False
            elif c == '"' and begins:
                state = 1
            else:
                begins = c == ","
            at += 1
        return state

    row = spark.range(1).select(
        records.end_state(F.lit(line), False).alias("o"), records.end_state(F.lit(line), True).alias("i"), records.effect(F.lit(line)).alias("e")
    ).first()
    assert (row.o, row.i) == (walk(0), walk(1))
    by_effect = {records.KEEP: (0, 1), records.TURN: (1, 0), records.CLOSE: (0, 0), records.OPEN: (1, 1)}
    assert by_effect[row.e] == (row.o, row.i)


def some_value(pick, depth=0):
    kind = pick.random()
    if depth < 3 and kind < 0.25:
        return {f"k{i}": some_value(pick, depth + 1) for i in range(pick.randrange(3))}
    if depth < 3 and kind < 0.4:
        return [some_value(pick, depth + 1) for _ in range(pick.randrange(3))]
    return pick.choice([1, None, True, "x", "}", '{"', "a\\", '\\"}', "[", "]]", "é\n", "", '{"a":1}', "\\\\"])


FORMS = {
    "array": json.dumps,
    "indented": lambda docs: json.dumps(docs, indent=2) + "\n",
    "lines": lambda docs: "\n".join(map(json.dumps, docs)),
    "one": lambda docs: json.dumps(docs[0]),
    "marked": lambda docs: "\ufeff [\n" + ",\n".join(json.dumps(d, ensure_ascii=False) for d in docs) + "\n]\n",
    "mixed": lambda docs: json.dumps([None, 1, "}", *docs, 2]),
}


@pytest.mark.parametrize("form", FORMS)
def test_documents_of_json_files(spark, tmp_path, small_blocks, form):
    """Files of every form, many blocks each; strings hold braces, brackets, quotes and backslashes."""
    want = Counter()
    for seed in range(3):
        pick = random.Random(f"{form}{seed}")
        docs = [{"id": i, "v": some_value(pick)} for i in range(25)]
        (tmp_path / f"{seed}.json").write_text(FORMS[form](docs), encoding="utf-8")
        want.update(json.dumps(d) for d in (docs[:1] if form == "one" else docs))
    got = records.json_documents(spark, str(tmp_path)).collect()
    assert Counter(json.dumps(json.loads(r.document)) for r in got) == want


@pytest.mark.parametrize("form", FORMS)
def test_documents_over_many_chunks(spark, tmp_path, monkeypatch, form):
    """Chunks of two braces in one block, and of one: documents within, across and at the ends of chunks."""
    pick = random.Random(form)
    docs = [{"id": i, "v": some_value(pick)} for i in range(25)]
    (tmp_path / "docs.json").write_text(FORMS[form](docs), encoding="utf-8")
    want = Counter(json.dumps(d) for d in (docs[:1] if form == "one" else docs))
    for bits in (1, 0):
        monkeypatch.setattr(records, "CHUNK_BITS", bits)
        got = records.json_documents(spark, str(tmp_path)).collect()
        assert Counter(json.dumps(json.loads(r.document)) for r in got) == want


def test_no_window_goes_over_pieces(spark, tmp_path):
    """Pieces are as many as closing braces: only their chunks are sorted, without their text."""
    (tmp_path / "docs.json").write_text('[{"a":{}},{"b":"}"}]')
    found = records.json_documents(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition" in x]
    assert windows and not [x for x in windows if "line#" in x]
    assert sorted(r.document for r in found.collect()) == ['{"a":{}}', '{"b":"}"}']


def test_cut_documents_equal_the_multi_line_reader(spark, tmp_path, rows, small_blocks):
    match = {"date": "2026-06-11", "team1": "A", "team2": "B}", "score": {"ft": [1, 2]}, "goals1": [{"name": "x\"{", "minute": "9"}]}
    docs = [{"matches": [match, {"team1": str(i)}]} for i in range(20)] + [{"matches": None}, {}]
    (tmp_path / "docs.json").write_text(json.dumps(docs, indent=1))
    both = [rows(files.read_match_documents(spark, str(tmp_path), cut=c)) for c in (True, False)]
    assert both[0] == both[1]
    variants = files.read_variant_documents(spark, str(tmp_path), cut=True).select(F.to_json("doc").alias("doc")).collect()
    assert Counter(r.doc for r in variants) == Counter(json.dumps(d, separators=(",", ":"), sort_keys=True) for d in docs)
    assert not files._cut(spark, str(tmp_path), None)
