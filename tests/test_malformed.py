import pytest

from termloom.operators.malformed import loaded_lines, rejected_lines

GOOD = "PMID:1|DOI:x\tA B\tJ\t2020\tT\ttext"
LINES = {
    1: (GOOD, ""),
    2: (GOOD + "\r", ""),
    3: ("PMID:1\ta\tj\t\tt", "field_count"),
    4: (GOOD + "\tmore", "field_count"),
    5: ('"PMID:1"\t"a\tb"\t"j ""x"""\t\t\t"x\ty"', ""),
    6: ('PMID:1\t"a"b\tj\t\tt\tx', "quote_closed_inside"),
    7: ('PMID:1\t"a\tj\t\tt\tx', "quote_not_closed"),
    8: ('PMID:1\ta "b" c\tj"\t\t5" x\t\\', ""),
    9: ("PMID:0\ta\tj\t\tt\tx", "identifier_invalid"),
    10: ("PMID:2147483648\ta\tj\t\tt\tx", "identifier_invalid"),
    11: ("PMID:0007|\ta\tj\t\tt\tx", ""),
    12: ("PMID :1\ta\tj\t\tt\tx", "identifier_invalid"),
    13: ("PMID:1\ta\tj\t1799\tt\tx", "year_invalid"),
    14: ("PMID:1\ta\tj\t2100\tt\tx", ""),
    15: ("PMID:1\ta\tj\t2020 \tt\tx", "year_invalid"),
    16: ("PMID:1\ta\tj\t\tt\t  　", "text_blank"),
    17: ("PMID:1\ta\u0007\tj\t\tt\tx", "authors_control_character"),
    18: ("PMID:1\ta\tj\t\tt�\tx", "title_control_character"),
    19: ("", "field_count"),
    20: (None, "line_null"),
    21: ("PMID:1\ta\tj\r\t\tt\tx", "journal_control_character"),
    22: ('PMID:1\t""\t""""\t""\t\t"""x"', ""),
    23: ("PMID:x\ta\tj\t20\tt\t", "identifier_invalid,text_blank,year_invalid"),
    24: ("PMID:1\ta\tj\t\tt\t" + "y" * 200_000, ""),
    25: ("\t" * 50_000, "field_count"),
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k, line, 5, "x") for k, (line, _) in LINES.items()]
    return spark.createDataFrame(rows, "line_id bigint, line string, value int, column string")


def test_reasons(lines):
    got = {r.line_id: ",".join(r.reasons) for r in rejected_lines(lines).collect()}
    assert got == {k: why for k, (_, why) in LINES.items() if why}


def test_loaded_values(lines):
    rows = {r.line_id: r for r in loaded_lines(lines, keep=()).collect()}
    assert set(rows) == {k for k, (_, why) in LINES.items() if not why}
    assert (rows[5].authors, rows[5].journal, rows[5].text) == ("a\tb", 'j "x"', "x\ty")
    assert (rows[22].authors, rows[22].journal, rows[22].text) == ("", '"', '"x')
    assert rows[2].text == "text"


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, GOOD), (None, "bad"), (7, GOOD), (7, "bad"), (7, GOOD)], "line_id bigint, line string")
    assert sorted((r.line_id or 0) for r in loaded_lines(df, keep=()).collect()) == [0, 7, 7]
    assert sorted((r.line_id or 0) for r in rejected_lines(df).collect()) == [0, 7]


def test_empty_table(spark):
    df = spark.createDataFrame([], "line_id bigint, line string")
    assert rejected_lines(df).count() == 0 and loaded_lines(df, keep=()).count() == 0
