import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.operators.packed import _batch, split_field, split_packed

CASES = {
    "Tirv HC,,Pekozhan VS, ,Maelm UC": ["Tirv HC", "Pekozhan VS", "Maelm UC"],
    'A B, "Working Party on Cells, Tissues and Organs of X"': ["A B", "Working Party on Cells, Tissues and Organs of X"],
    '"Prar ""Zh"" SH"': ['Prar "Zh" SH'],
    "Grou, M. O.; Jei, B.R.；Prin, H": ["Grou, M. O.", "Jei, B.R.", "Prin", "H"],
    "A B and C D AND E F, & G H": ["A B", "C D", "E F", "G H"],
    "A B, Jr; C D 3rd": ["A B, Jr", "C D 3rd"],
    "A｜B|C / D、E，F": ["A｜B", "C", "D", "E", "F"],
    'say "x" and y': ['say "x"', "y"],
    '"open, x': ['"open', "x"],
    "Sand O": ["Sand O"],
    " 　 ": [],
    '"" ; ""': [],
    "": [],
}


def batch(texts):
    out = _batch(pa.array(range(len(texts))), pa.array(texts, pa.string()))
    got = [[] for _ in texts]
    for i, p, v in zip(*(c.to_pylist() for c in out.columns)):
        got[i].append((p, v))
    return [[v for _, v in sorted(x)] for x in got]


def test_cases():
    assert {k: split_field(k) for k in CASES} == CASES
    assert batch(list(CASES)) == list(CASES.values())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(['"', " ", ",", ";", "and", "A", "b", ".", "，", "é", "　", "-", "|", "Jr"]), max_size=14).map("".join), max_size=8))
def test_masks_agree_with_the_scanner(texts):
    assert batch(texts) == [split_field(t) for t in texts]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A B; C D", 9), (None, "E", 9), (2, None, 9), (3, " ", 9), (1, "A B; C D", 9), (4, "x," * 40_000, 9)], "row_id bigint, authors string, pos int")
    out = split_packed(df, "row_id", "authors", value_name="author")
    rows = out.collect()
    assert sorted((r.row_id or 0, r.pos, r.author) for r in rows if r.row_id != 4) == [(0, 1, "E"), (1, 1, "A B"), (1, 1, "A B"), (1, 2, "C D"), (1, 2, "C D")]
    assert sum(r.row_id == 4 for r in rows) == 40_000
    assert split_packed(df.limit(0), "row_id", "authors").count() == 0
