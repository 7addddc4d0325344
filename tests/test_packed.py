"""Problem 1: packed labels."""

import pytest

from burstloom.operators.packed import _forward_backward, _viterbi, _weights, certain_labels, lattice, packed_labels

CASES = [
    ("37 و 2 و 1", ["37", "2", "1"]),
    ('"a ""b"" c ",7', ['a "b" c', "7"]),
    ("(۲۱ + ۲۲ + نقاشی پازیج)", ["۲۱", "۲۲", "نقاشی پازیج"]),
    (" 8  36  19 ", ["8", "36", "19"]),
    ('"3" و "6"', ["3", "6"]),
    ("a b 5 c d", ["a b", "5", "c d"]),
    ("30.0 5.0", ["30.0", "5.0"]),
    ("پدر و مادر|5", ["پدر و مادر", "5"]),
    ("«10», «29»", ["10", "29"]),
    ("fupuk-border", ["fupuk-border"]),
    (",;6,,7,", ["6", "7"]),
    ("9, 9", ["9", "9"]),
    ("(a) | (b)", ["(a)", "(b)"]),
    ("it's 5", ["it's", "5"]),
    ("'x, y'/8", ["x, y", "8"]),
    ("", []),
    ("   ", []),
    ('""', []),
]


@pytest.mark.parametrize("field,labels", CASES)
def test_viterbi(field, labels):
    assert _viterbi(lattice(field), _weights({})) == labels


def test_expected_counts_sum_to_paths():
    counts = _forward_backward(lattice("a 5"), lambda label, joined: 0.0)
    assert sorted((x, round(c, 6)) for x, c in counts) == [("5", 0.5), ("a", 0.5), ("a 5", 0.5)]


def test_edges_that_must_part_are_left_out():
    assert [e[3] for e in lattice("a b|5")] == ["a b", "5"]
    assert ("a و 5", True) in [(e[3], e[4]) for e in lattice("a و 5")]
    assert certain_labels('a b|"c 5"|7 x|9') == [("a b", False), ("c 5", True), ("9", False)]


def test_frequencies_decide_the_split(spark):
    apart = [(i, t) for i, t in enumerate(['"red"', "5", "7", "part", '"blue sky"', "5, 7"] * 10)]
    inside = [(i, t) for i, t in enumerate(['"part 5"', '"part 6"', '"part 5", "part 7"', '"red"'] * 10)]
    asked = [(1000, "part 5"), (1001, "7 5")]
    got = []
    for rows in (apart, inside):
        df = spark.createDataFrame(rows + asked, "gold_id long, gold_class string")
        found = packed_labels(df, "gold_id", ["gold_class"]).where("gold_id >= 1000").orderBy("gold_id", "pos").collect()
        got.append([r["value"] for r in found if r["gold_id"] == 1000])
    assert got == [["part", "5"], ["part 5"]]


def test_rounds_of_expectation_move_the_split():
    edges = lattice("x 5")
    few, many = {"x": 0.01, "5": 0.01}, {"x": 0.01, "5": 0.01, "x 5": 0.3}
    assert _viterbi(edges, _weights(few)) == ["x", "5"] and _viterbi(edges, _weights(many)) == ["x 5"]


def test_packed_labels(spark):
    rows = [(1, "7,7", None, "x"), (2, None, "1 2", "y"), (3, "", " ", "z"), (4, "7,7", "q" * 5000 + ",2", "w")]
    df = spark.createDataFrame(rows, "gold_id long, gold_class string, gold_cluster string, value string")
    got = sorted(tuple(r) for r in packed_labels(df, "gold_id", ["gold_class", "gold_cluster"]).collect())
    want = [(1, "gold_class", 1, "7"), (1, "gold_class", 2, "7"), (2, "gold_cluster", 1, "1"), (2, "gold_cluster", 2, "2"), (4, "gold_class", 1, "7"), (4, "gold_class", 2, "7"), (4, "gold_cluster", 1, "q" * 5000), (4, "gold_cluster", 2, "2")]
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "gold_id long, gold_class string, gold_cluster string")
    assert packed_labels(df, "gold_id", ["gold_class"]).collect() == []
