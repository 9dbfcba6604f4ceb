"""Nulls, empty tables, long and repeated rows and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import decontaminate, language, licences, lines, minhash, mixing, passages, quality, rules, suffixes

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven " * 3, "en", "a", 5),
    (1, "one two three four five six seven eight nine ten eleven " * 3, "en", "a", 5),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, " \n\t ", "de", "b", 3),
    (5, LONG, "fr", "b", len(LONG)),
    (6, "é\U0001f600 ẞ \x00 x", None, "c", 6),
    (None, "no id here but words enough to be looked at in every way", "en", None, None),
    (7, "same id", "en", "a", 1),
    (7, "other text, same id", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
EXTRA = tuple(
    "id key a b k p q n s h i c v w words host path size line version component ranges gone win doc row read p_bad site score kept lines from each copy copies "
    "check check_version check_line n_lines lead first degree end d rid blob bucket block blocks own segment sketch t hs hn labelled low toxic "
    "_p_bad _h _path _s _n _site _score _gone _d _v _lines _kept source_size target taken lot part turn more times at pos off anchor".split()
)


def benchmark(spark, rows=((10, "four five six seven"), (11, None), (None, "one two"), (12, "..."))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 1, 0), (1, 0, None), (4, None, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda s, d: quality.classify(d, labels(s)),
    "decontaminate": lambda s, d: decontaminate.contaminated(d, benchmark(s)),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "lines": lambda s, d: lines.line_report(d),
    "mixing": lambda s, d: mixing.mix(d),
    "licences": lambda s, d: licences.scan(d),
    "rules": lambda s, d: rules.judge(d),
    "suffixes": lambda s, d: suffixes.dedup_bytes(d),
    "language": lambda s, d: language.identify(d, language.learn(d)),
    "passages": lambda s, d: passages.dedup_passages(d),
}
STAGES = {
    "quality": lambda s, d: quality.good_documents(d, labels(s)),
    "lines": lambda s, d: lines.dedup_lines(d),
    "minhash": lambda s, d: minhash.one_of_each(d, size=5),
    "decontaminate": lambda s, d: decontaminate.clean_documents(d, benchmark(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})
    got = OPERATORS[name](spark, docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)
    again = OPERATORS[name](spark, docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stages(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = STAGES[name](spark, docs)
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} <= {r[0] for r in ROWS}
    assert STAGES[name](spark, docs.limit(0)).collect() == []


def test_empty_sides(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert decontaminate.contaminated(docs, benchmark(spark, ())).where("contaminated").count() == 0
    assert quality.classify(docs, labels(spark, ())).count() == len(ROWS)


def test_columns_that_clash_stay(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None], SCHEMA).withColumns({c: F.lit("x") for c in EXTRA})
    for name in STAGES:
        got = STAGES[name](spark, docs)
        assert got.columns == docs.columns and all(r[c] == "x" for r in got.collect() for c in EXTRA)
