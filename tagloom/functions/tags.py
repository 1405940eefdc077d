"""Predicates on ordered tag lists, ARRAY<STRUCT<k, v>>. Keys may repeat; which one counts is part of each meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roads that are not drawn.
NOT_DRIVABLE = ("pedestrian", "steps", "footway", "construction", "bic", "cycleway", "layby", "bridleway", "path")


def find_tag_by(tags: Column, predicate: Callable[[Column, Column], Column]) -> Column:
    """Value of the first tag for which predicate(k, v) is true; NULL if there is none."""
    return F.try_element_at(F.filter(tags, lambda t: predicate(t.k, t.v)), F.lit(1)).v


def find_tag(tags: Column, key: str) -> Column:
    """Value of the first tag with this key."""
    return find_tag_by(tags, lambda k, _: k == key)


def has_tag(tags: Column, key: str, value: str) -> Column:
    """Whether the first tag with this key has this value; later tags with the key don't count."""
    return F.coalesce(find_tag(tags, key) == value, F.lit(False))


def has_key(tags: Column, key: str) -> Column:
    """Whether any tag has this key."""
    return F.coalesce(F.exists(tags, lambda t: t.k == key), F.lit(False))


def is_drivable(tags: Column) -> Column:
    """Whether any highway tag has a value outside NOT_DRIVABLE."""
    return F.coalesce(F.exists(tags, lambda t: (t.k == "highway") & ~t.v.isin(*NOT_DRIVABLE)), F.lit(False))


def with_prefix(tags: Column, prefix: str) -> Column:
    """The tags whose key starts with this prefix."""
    return F.filter(tags, lambda t: F.startswith(t.k, F.lit(prefix)))


def parse_unsigned(text: Column, most: int) -> Column:
    """An optional plus sign and digits, nothing else, up to `most` (below 10 ** 20); NULL for any other text.

    BIGINT, or DECIMAL(20, 0) where most doesn't fit into it. Leading zeros don't count, however many.
    """
    digits = F.regexp_extract(text, r"\A\+?0*([0-9]+)\z", 1)
    number = F.when(F.length(digits).between(1, 20), digits).try_cast("decimal(20,0)")
    fits = F.when(number <= F.lit(str(most)).cast("decimal(20,0)"), number)
    return fits.cast("bigint") if most < 2**63 else fits


def classify_way(tags: Column, n_refs: Column) -> Column:
    """STRUCT<category, width>: 'road' or 'river' with the width to draw; NULL if the way is neither.

    The first highway or waterway tag decides. A river takes the first width or maxwidth tag; one that is no whole number
    leaves the way out.
    """
    first = F.try_element_at(F.filter(tags, lambda t: t.k.isin("highway", "waterway")), F.lit(1))
    wide = F.try_element_at(F.filter(tags, lambda t: t.k.isin("width", "maxwidth")), F.lit(1))
    width = F.when(wide.isNull(), F.lit(1).cast("bigint")).otherwise(parse_unsigned(wide.v, 2**32 - 1))
    road = (first.k == "highway") & ~F.coalesce(first.v.isin(*NOT_DRIVABLE), F.lit(False))
    return F.when(n_refs < 3, None).when(road, F.struct(F.lit("road").alias("category"), F.lit(None).cast("bigint").alias("width"))).when(
        (first.k == "waterway") & width.isNotNull(), F.struct(F.lit("river").alias("category"), width.alias("width"))
    )


def is_park(k: Column, v: Column) -> Column:
    return ((k == "leisure") & (v == "park")) | ((k == "landuse") & v.isin("recreation_ground", "forest"))


def is_lake(k: Column, v: Column) -> Column:
    return (k == "water") & (v == "lake")


def relation_category(multipolygon: Column, park: Column, lake: Column, park_after: Column, lake_after: Column) -> Column:
    """'park', 'water' or NULL from the first places of: type=multipolygon, a park tag, a lake tag, and of those behind the first.

    Park tags before the multipolygon tag win over lake tags before it; else the first of either behind it decides.
    """
    return (
        F.when(multipolygon.isNull(), None)
        .when(park < multipolygon, "park")
        .when(lake < multipolygon, "water")
        .when(park_after.isNull() & lake_after.isNull(), None)
        .when(lake_after.isNull() | (park_after < lake_after), "park")
        .otherwise("water")
    )


def classify_relation(tags: Column) -> Column:
    """The category of a relation with these tags."""
    at = F.transform(tags, lambda t, i: F.struct(i.alias("i"), t.k.alias("k"), t.v.alias("v")))

    def first(predicate: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.filter(at, predicate), F.lit(1)).i

    m = first(lambda t: (t.k == "type") & (t.v == "multipolygon"))
    return relation_category(m, first(lambda t: is_park(t.k, t.v)), first(lambda t: is_lake(t.k, t.v)), first(lambda t: is_park(t.k, t.v) & (t.i > m)), first(lambda t: is_lake(t.k, t.v) & (t.i > m)))
