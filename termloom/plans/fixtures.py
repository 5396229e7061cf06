"""Small tables that stand in for files the test data doesn't have: stop lists, groups, organisms and pages.

Each is a handful of rows, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STOP_GLOBAL = (("roudysti", "t"), ("fouklapaet", "f"), ("skin grafts", "t"), ("GROUVR90", "y"), ("retina", "0"))
STOP_LOCAL = (("Wipr-36", "10000002", "t"), ("PASN30", "10000015", "t"), ("GROUVR90", "10000027", "f"))
TYPE_PAIRS = ((990601, 990110), (-26, 990601), (-27, -26))
GROUPS = tuple((s, 1900000 + s % 7) for s in range(1800000, 1800100)) + tuple((s, 1910000 + s % 3) for s in range(1800000, 1800100, 2))
#: The taxa of organisms, by their serial modulo 4, and names that can be a long form of three or four words.
TAXA = (990601, 990110, 990204, 990318)
LONG_FORM = r"\A[A-Za-z]+([ -][A-Za-z]+){2,3}\z"
BLOCKS = tuple((f"name{n}", f"{d}") for n in range(1, 9) for d in range(1, n + 1))
STRINGS = (
    "P-53", '"p53"', "p 53.", "-p53", "p53-", "a, b", "a,b", "a b", "TIMP-1", "timp1", "(ATM) kinase", "ATM_kinase", "", " ", "...", "-", "x--y", "{x", "x}", "'quoted'", "é-É", "A.B.C", "\tx",
    "P53", "p53", "the cell", "cell of", "10 mg", "10mg", "5 days", "C-3", "C-123", "is", "a-b", "or 12", "state of", "fish are red", "12A", "1234A", "&amp", "the", "that", "RAN", "ran", "TGF", "TIMP1",
    "PLK1", "ATM-kinase", "fish and chips", "tissue growth factor",
)
TYPE_NAMES = ((-26, "disease"), (-25, "tissue"), (-27, "environment"), (-1, "chemical"))
IRIS = ((9606, "ENSP1"), (0, "x"), (-1, "CID1"), (-2, "9606"), (-25, "BTO:0000142"), (-26, "DOID:1"), (-27, "local"), (-11, "q"))


def rows(spark: SparkSession, data: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame(list(data), schema)


def literal(value: object) -> str:
    """A value as SQL."""
    if isinstance(value, str):
        escaped = value.replace("'", "''")
        return "'" + escaped.replace("\t", "' || chr(9) || '") + "'"
    return str(value)


def values(data: tuple, *columns: str) -> str:
    """The same rows as a SQL table expression."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in data) + ") AS v(" + ", ".join(columns) + "))"
