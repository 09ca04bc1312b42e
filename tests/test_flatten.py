"""Nested documents with everything that may be missing."""

import json

from goldseam.operators.flatten import (
    CHILD_COLUMNS,
    PARENT_COLUMNS,
    flatten_children,
    flatten_parents,
    flatten_players,
    flatten_teams,
    flatten_variant_parents,
    with_player_ids,
)
from goldseam.sources.files import read_match_documents, read_squads, read_variant_documents

MATCHES = {
    "matches": [
        {
            "date": "2026-06-11", "time": "13:00", "round": "Matchday 1", "group": "Group A", "ground": "City",
            "team1": "A", "team2": "B", "score": {"ft": [2, 1], "ht": [1, 0]},
            "goals1": [{"name": "x", "minute": "9"}, {"name": "y", "minute": "90+2", "penalty": True}],
            "goals2": [{"name": "z", "minute": "50", "owngoal": True}],
        },
        {"date": None, "team1": "C", "team2": "D", "score": {"ft": [3]}, "goals1": None},
        {"team1": "E", "team2": None, "score": None},
        {"team1": "G", "team2": "H", "score": {"ft": []}, "goals2": []},
    ]
}


def landing(tmp_path, name, document):
    folder = tmp_path / name
    folder.mkdir()
    (folder / "doc.json").write_text(json.dumps(document, indent=1))
    return str(folder)


def test_parents(spark, tmp_path):
    docs = read_match_documents(spark, landing(tmp_path, "m", MATCHES))
    parents = flatten_parents(docs)
    assert parents.columns == PARENT_COLUMNS
    got = [tuple(r) for r in parents.orderBy("match_num").collect()]
    assert got == [
        (0, "2026-06-11", "13:00", "Matchday 1", "Group A", "City", "A", "B", 2, 1, 1, 0),
        (1, "", "", "", "", "", "C", "D", 3, None, None, None),
        (2, "", "", "", "", "", "E", "", None, None, None, None),
        (3, "", "", "", "", "", "G", "H", None, None, None, None),
    ]


def test_children(spark, tmp_path):
    docs = read_match_documents(spark, landing(tmp_path, "m", MATCHES))
    children = flatten_children(docs)
    assert children.columns == CHILD_COLUMNS
    got = sorted(tuple(r) for r in children.collect())
    assert got == [
        (0, "2026-06-11", "Matchday 1", "A", "B", "A", "x", "9", True, False, False),
        (0, "2026-06-11", "Matchday 1", "A", "B", "A", "y", "90+2", True, False, True),
        (0, "2026-06-11", "Matchday 1", "A", "B", "B", "z", "50", False, True, False),
    ]


def test_variant_documents_tell_null_from_missing(spark, tmp_path):
    docs = read_variant_documents(spark, landing(tmp_path, "v", MATCHES))
    got = {r.match_num: r for r in flatten_variant_parents(docs, "doc").collect()}
    assert (got[0].match_date, got[1].match_date, got[2].match_date) == ("2026-06-11", "None", "")
    assert (got[2].team2_name, got[0].score_ft_team1, got[1].score_ft_team2) == ("None", 2, None)


def test_squads_and_running_ids(spark, tmp_path):
    squads = [
        {"name": "A", "fifa_code": "AAA", "group": "A", "players": [
            {"name": "p1", "pos": "GK", "number": 1, "date_of_birth": "2000-01-01", "club": {"name": "c", "country": "AAA"}},
            {"name": "p2", "pos": "DF", "club": None},
        ]},
        {"name": "B", "group": "A"},
        {"name": "C", "players": [{"name": "p3"}]},
    ]
    df = read_squads(spark, landing(tmp_path, "s", squads))
    assert sorted(tuple(r) for r in flatten_teams(df).collect()) == [("A", "AAA", "A"), ("B", "", "A"), ("C", "", "")]
    players = with_player_ids(flatten_players(df), ["team_name", "player_pos"], blocks=3)
    got = sorted(tuple(r) for r in players.drop("player_pos").collect())
    assert got == [
        ("P00001", "A", "p1", "GK", 1, "c", "AAA", "2000-01-01"),
        ("P00002", "A", "p2", "DF", None, "", "", ""),
        ("P00003", "C", "p3", "", None, "", "", ""),
    ]


def test_flattening_needs_no_shuffle(spark, tmp_path):
    docs = read_match_documents(spark, landing(tmp_path, "m", MATCHES))
    for df in (flatten_parents(docs), flatten_children(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
