import itertools

import pytest
from pyspark.sql import functions as F

from tagloom.functions import tags as t

SCHEMA = "tags array<struct<k: string, v: string>>"


def value(spark, tags, column):
    return spark.createDataFrame([(tags,)], SCHEMA).select(column(F.col("tags")).alias("x")).first().x


def test_first_key_wins_or_any(spark):
    tags = [("amenity", "cafe"), ("amenity", "pub"), ("highway", "path"), ("highway", "primary")]
    assert value(spark, tags, lambda c: t.find_tag(c, "amenity")) == "cafe"
    assert value(spark, tags, lambda c: t.has_tag(c, "amenity", "pub")) is False
    assert value(spark, tags, lambda c: t.has_tag(c, "amenity", "cafe")) is True
    assert value(spark, tags, lambda c: t.find_tag_by(c, lambda k, v: (k == "amenity") & (v == "pub"))) == "pub"
    assert value(spark, tags, t.is_drivable) is True
    assert value(spark, tags, lambda c: t.has_key(c, "highway")) is True
    assert value(spark, tags, lambda c: F.size(t.with_prefix(c, "high"))) == 2


@pytest.mark.parametrize("tags", [None, [], [(None, None)], [("highway", None)]])
def test_nothing_there(spark, tags):
    assert value(spark, tags, lambda c: t.find_tag(c, "amenity")) is None
    assert value(spark, tags, lambda c: t.has_tag(c, "amenity", "pub")) is False
    assert value(spark, tags, t.is_drivable) is False


@pytest.mark.parametrize(("text", "number"), [("12", 12), ("+12", 12), (" 12", None), ("12 ", None), ("-1", None), ("", None), (None, None), ("1.0", None), ("٣", None), ("99999999999999999999", None), ("007", 7), ("4294967296", None)])
def test_unsigned(spark, text, number):
    assert spark.createDataFrame([(text,)], "s string").select(t.parse_unsigned(F.col("s"), 2**32 - 1).alias("x")).first().x == number


@pytest.mark.parametrize(
    ("tags", "refs", "want"),
    [
        ([("highway", "primary")], 3, ("road", None)), ([("highway", "primary")], 2, None), ([("highway", "path"), ("highway", "primary")], 5, None), ([("waterway", "x")], 3, ("river", 1)),
        ([("maxwidth", "7"), ("waterway", "x"), ("width", "2")], 3, ("river", 7)), ([("waterway", "x"), ("width", "wide")], 3, None), ([("waterway", "x"), ("highway", "path")], 3, ("river", 1)), ([], 9, None),
    ],
)
def test_ways(spark, tags, refs, want):
    got = value(spark, tags, lambda c: t.classify_way(c, F.lit(refs)))
    assert (got and tuple(got)) == want


def machine(tags):
    multi = park = lake = False
    for k, v in tags:
        if (k, v) == ("type", "multipolygon"):
            if park:
                return "park"
            if lake:
                return "water"
            multi = True
        if (k, v) in (("leisure", "park"), ("landuse", "forest"), ("landuse", "recreation_ground")):
            if multi:
                return "park"
            park = True
        if (k, v) == ("water", "lake"):
            if multi:
                return "water"
            lake = True
    return None


def test_relations_like_a_reader_of_tags(spark):
    kinds = [("type", "multipolygon"), ("leisure", "park"), ("water", "lake"), ("type", "route")]
    all_ = [list(x) for n in range(6) for x in itertools.product(kinds, repeat=n)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(all_)], "i int, " + SCHEMA).select("i", t.classify_relation(F.col("tags")).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: machine(x) for i, x in enumerate(all_)}


def test_unsigned_edges(spark):
    texts = {"12\n": None, "12\r": None, "\n12": None, " 12": None, "+": None, "++1": None, "-0": None, "+0": 0, "000": 0, "0" * 50 + "7": 7, "+" + "0" * 30 + "4294967295": 4294967295, "4294967296": None, "9" * 60: None, "1٣": None, "": None}
    df = spark.createDataFrame(list(texts.items()), "s string, n bigint")
    assert [r for r in df.select("s", "n", t.parse_unsigned(F.col("s"), 2**32 - 1).alias("x")).collect() if r.n != r.x] == []
    big = spark.createDataFrame([(str(2**64 - 1),), (str(2**64),), (str(2**63 - 1),), (str(2**63),)], "s string")
    assert [r[0] and int(r[0]) for r in big.select(t.parse_unsigned(F.col("s"), 2**64 - 1)).collect()] == [2**64 - 1, None, 2**63 - 1, 2**63]
    assert [r[0] for r in big.select(t.parse_unsigned(F.col("s"), 2**63 - 1)).collect()] == [None, None, 2**63 - 1, None]
