import pytest
from pyspark.sql import functions as F

from kgspark.functions import scalars as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn("x")).first()[0]


@pytest.mark.parametrize("value,good", [
    ("a_b", True), ("ä1", True), ("1a", True), ("²x", True), ("", False), ("_a", False), ("a_", False),
    ("a__b", False), ("A_b", False), ("a-b", False), ("a b", False), ("a\n", False), (None, False),
])
def test_is_snake_case(spark, value, good):
    assert one(spark, value, S.is_snake_case) is good


@pytest.mark.parametrize("value,good", [("City", True), ("city", False), ("1City", False), ("", False)])
def test_starts_uppercase(spark, value, good):
    assert one(spark, value, S.starts_uppercase) is good


@pytest.mark.parametrize("value,name", [
    ('a/b:c', "a_b_c"), ("  My  Domain ", "my_domain"), ("x" * 120, "x" * 100), ('<A>|"B"', "a___b"),
])
def test_sanitize_filename(spark, value, name):
    assert one(spark, value, S.sanitize_filename) == name


def test_word_count_counts_empty_words(spark):
    assert one(spark, "a  b ", S.word_count) == 4
    assert one(spark, "", S.word_count) == 1


def test_issue_text_leaves_out_empty_parts(spark):
    rows = spark.createDataFrame(
        [("p", "m", "c", "h"), ("p", "m", None, ""), ("p", "m", None, "h")],
        "path string, message string, context string, hint string",
    )
    got = [r[0] for r in rows.select(S.issue_to_string("path", "message", "context", "hint")).collect()]
    assert got == ["[p] m (context: c) (hint: h)", "[p] m", "[p] m (hint: h)"]


def test_widths_and_sizes(spark):
    row = spark.range(1).select(
        S.node_size(F.lit(5), F.lit(10)).alias("size"), S.edge_width(F.lit(5), F.lit(10)).alias("edge"),
        S.confidence_width(F.lit(None)).alias("sure"), S.confidence_width(F.lit(0.5)).alias("half"),
    ).first()
    assert tuple(row) == (16.0, 2.0, 5.0, 3.0)


def test_name_normalisers(spark):
    assert one(spark, "Jane  Austen's", S.to_snake_case) == "jane_austen_s"
    assert one(spark, "small ring-set", S.to_pascal_case) == "SmallRingSet"
