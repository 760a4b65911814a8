import re

import pytest
from pyspark.sql import functions as F

from codestrata.functions import links, owners, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("pattern, yes, no", [("a*c", ["ac", "a/b/c"], ["acd", "Ac"]), ("?x", ["ax"], ["x", "aax"]), ("[ab]1", ["a1"], ["c1"]), ("[^ab]1", ["c1"], ["a1"]), ("a.b", ["a.b"], ["axb"]), ("[", ["["], ["a"])])
def test_glob(spark, pattern, yes, no):
    regex = text.glob_regex(pattern)
    df = spark.createDataFrame([(x,) for x in yes + no], "x string").filter(F.col("x").rlike(regex))
    assert sorted(r["x"] for r in df.collect()) == sorted(yes)


def test_ascii_fold_leaves_other_letters(spark):
    assert one(spark, text.ascii_fold(F.lit("AbÉ"))) == "abÉ"


def test_checked_regex_rejects():
    with pytest.raises(ValueError):
        text.checked_regex("(")


def test_ratio(spark):
    assert one(spark, text.ratio(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, text.ratio(F.lit(1), F.lit(4))) == 0.25


def test_lexical_score(spark):
    a, b = text.subject_terms(F.lit("net/tcp_input.c")), text.subject_terms(F.lit("tcp-inputs.rst"))
    assert one(spark, text.lexical_score(a, b)) == (30 + 3) + (5 + 5)


def test_occurrences(spark):
    assert one(spark, text.occurrences(F.lit(2), F.lit(1), F.lit(0))) == "2d 1i"


@pytest.mark.parametrize("pattern, score", [("*", -1000), ("*/", -1000), ("fs/ext4/", 48), ("kernel/", 27)])
def test_specificity(pattern, score):
    assert owners.specificity(pattern) == score


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("fs/ext4/", ["fs/ext4/a.c", "fs/ext4/x/a.c"], ["fs/ext2/a.c"]), ("drivers/net/*", ["drivers/net/a.c"], ["drivers/net/x/a.c"]), ("a/**/b.c", ["a/x/y/b.c"], ["a/b"]), ("a/b?.c", ["a/b1.c"], ["a/b12.c"]), ("a/[xy].c", ["a/x.c"], ["a/z.c"])],
)
def test_path_regex(pattern, yes, no):
    regex = re.compile(owners.path_regex(pattern))
    assert all(regex.match(x) for x in yes) and not any(regex.match(x) for x in no)


def test_links(spark):
    assert links.release_tag("6.12") == "v6.12" and links.release_tag("6.12.104") == "v6.12.104" and links.release_tag("6.12.0") is None and links.release_tag("next") is None
    assert links.repository("2.6.32") == links.MAINLINE and links.repository("2.6.32.4") == links.STABLE and links.repository("6.12-rc3") == links.MAINLINE
    assert links.series("6.12.104") == "v6.12" and links.series("next-2") == "latest" and not links.has_provenance("6.12", "/home/x.tar.gz")
    got = one(spark, links.source_link("6.12.104", F.lit("fs/a b.c"), F.lit(7)))
    assert got == links.plain_link("6.12.104", "fs/a b.c", 7)
    assert links.archive_url("6.12.104").endswith("v6.x/linux-6.12.104.tar.xz")
