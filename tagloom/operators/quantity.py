"""Quantities as texts state them: one number and, where it is named, its unit."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa

#: The common unit of a measure and what one of another unit is in it.
LENGTH = {"m": 1.0, "ft": 0.3048, "in": 0.0254, "cm": 0.01, "mm": 0.001, "km": 1000.0}
SPEED = {"km/h": 1.0, "mph": 1.609344, "knot": 1.852, "m/s": 3.6}
PEOPLE = {"person": 1.0, "thousand": 1000.0, "million": 1_000_000.0}
MEASURES = {"population": PEOPLE, "ele": LENGTH, "height": LENGTH, "maxspeed": SPEED}
COMMON = {"population": "person", "ele": "m", "height": "m", "maxspeed": "km/h"}
#: How units are written, in lower case and without a full stop at the end.
LENGTH_NAMES = {
    "m": ("m", "metre", "metres", "meter", "meters", "metro", "metros", "mètre", "mètres"),
    "ft": ("ft", "feet", "foot", "fuß", "fuss", "pied", "pieds", "pie", "pies", "'", "′", "’"),
    "in": ("in", "inch", "inches", "zoll", "pouce", "pouces", '"', "″", "”", "''"),
    "cm": ("cm", "centimetre", "centimetres", "centimeter", "centimeters", "zentimeter"),
    "mm": ("mm", "millimetre", "millimetres", "millimeter", "millimeters"),
    "km": ("km", "kilometre", "kilometres", "kilometer", "kilometers"),
}
SPEED_NAMES = {
    "km/h": ("km/h", "kmh", "kph", "kmph", "km/std", "kilometres per hour", "kilometers per hour"),
    "mph": ("mph", "mi/h", "mile/h", "miles/h", "mile per hour", "miles per hour", "m.p.h"),
    "knot": ("knot", "knots", "kn", "kt", "kts", "knoten"),
    "m/s": ("m/s", "m/sec", "mps", "metres per second", "meters per second"),
}
PEOPLE_NAMES = {
    "person": ("inhabitant", "inhabitants", "pers", "person", "persons", "people", "hab", "habitants", "habitantes", "einwohner", "ew", "residents"),
    "thousand": ("k", "thousand", "tausend", "tsd", "mil", "mille", "thsd"),
    "million": ("m", "million", "millions", "millionen", "mio", "mill", "millon", "millones", "millón", "mln"),
}
WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
#: Greater numbers measure nothing.
MOST = 1e200
_ABOUT = re.compile(r"^(?:(?:ca|circa|about|approx|approximately|around|etwa|rund|environ|unos|over|some|c)(?:\.\s*|\s+)|[~≈]\s*)")
_NUMBER = r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]{1,3}(?:'[0-9]{3})+(?![0-9])|[0-9]{1,3}(?: [0-9]{3})+(?![0-9])|[0-9]+(?:[.,][0-9]+)?)"
_FEET_INCHES = re.compile(r"([0-9]+)\s*-?\s*(?:ft\.?|feet|foot|'|′|’)\s*-?\s*([0-9]+(?:[.,][0-9]+)?)\s*-?\s*(?:in\.?|inch|inches|\"|″|”|'')")


def _spellings(names: dict[str, tuple[str, ...]]) -> dict[str, str]:
    return {spelt: unit for unit, all_ in names.items() for spelt in all_}


_UNITS = {"ele": _spellings(LENGTH_NAMES), "height": _spellings(LENGTH_NAMES), "maxspeed": _spellings(SPEED_NAMES), "population": _spellings(PEOPLE_NAMES)}
_BEFORE = re.compile(rf"([^0-9+.,-]+?)\.?\s*({_NUMBER})")
_AFTER = re.compile(rf"({_NUMBER})\s*-?\s*(.*)")


def _number(text: str) -> float:
    text = text.replace("'", "").replace(" ", "")
    if "," in text and "." not in text:
        whole, *parts = text.split(",")
        grouped = all(len(p) == 3 for p in parts) and 1 <= len(whole.lstrip("+-")) <= 3 and whole.lstrip("+-") != "0"
        text = text.replace(",", "") if grouped else text.replace(",", ".")
    return float(text.replace(",", ""))


def _unit(name: str, key: str) -> str | None:
    """The unit that a text names; '' if it is empty, None if it is no unit."""
    name = name.strip()
    if not name:
        return ""
    units = _UNITS[key]
    for one in (name, name.rstrip(".")):
        if one in units:
            return units[one]
    if key == "population":  # 1.5 million people
        first, _, second = name.partition(" ")
        if units.get(second.rstrip(".")) == "person" and (unit := units.get(first.rstrip("."))):
            return unit
    return None


def read_quantity(key: str, text: str | None) -> tuple[float, str | None] | None:
    """(number, unit named or None) if the text states exactly one quantity of this key; else None.

    Ranges, lists, empty texts and words without a number are none. However long the text, the time is in proportion to it. A
    number of 1e200 or more is no quantity.
    """
    found = None if text is None or key not in _UNITS else _read(key, text)
    return found if found and abs(found[0]) < MOST else None


def _read(key: str, text: str) -> tuple[float, str | None] | None:
    text = re.sub(r"\s+", " ", text.strip().lower())
    text = _ABOUT.sub("", text)
    if m := _AFTER.fullmatch(text):
        unit = _unit(m[2], key)
        if unit is not None:
            return _number(m[1]), unit or None
    if key in ("ele", "height") and (m := _FEET_INCHES.fullmatch(text)):
        return float(m[1]) + float(m[2].replace(",", ".")) / 12, "ft"
    if m := _BEFORE.fullmatch(text):
        unit = _unit(m[1], key)
        if unit:
            return _number(m[2]), unit
    return _words(text, key)


def _words(text: str, key: str) -> tuple[float, str | None] | None:
    words = deque(text.replace("-", " ").split())
    total, seen = 0.0, False
    while words and (words[0] in WORDS or words[0] in ("half", "hundred")):
        word = words.popleft()
        if word == "half":
            total, seen = total + 0.5, True
            if words and words[0] in ("a", "an"):
                words.popleft()
        elif word == "hundred":
            total, seen = max(total, 1) * 100, True
        else:
            total, seen = total + WORDS[word], True
    unit = _unit(" ".join(words), key) if seen else None
    return (total, unit) if unit else None


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, v, ... -> ..., number, named; each different text of a batch is read once."""
    for batch in batches:
        read: dict[tuple[str, str], tuple[float, str | None] | None] = {}
        out = []
        for at in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if at not in read:
                read[at] = read_quantity(*at)
            out.append(read[at] or (None, None))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.string())], [*batch.schema.names, "number", "named"])
