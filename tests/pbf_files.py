"""Writes small .osm.pbf files for tests."""

import zlib


def number(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def zig(n: int) -> int:
    return n << 1 if n >= 0 else ((-n) << 1) - 1


def field(at: int, value) -> bytes:
    if isinstance(value, int):
        return number(at << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(at << 3 | 2) + number(len(value)) + value


def packed(values) -> bytes:
    return b"".join(number(v) for v in values)


def deltas(values) -> bytes:
    return packed(zig(b - a) for a, b in zip([0, *values], values))


def frame(kind: str, data: bytes, raw: bool = False) -> bytes:
    blob = field(1, data) if raw else field(2, len(data)) + field(3, zlib.compress(data))
    head = field(1, kind) + field(3, len(blob))
    return len(head).to_bytes(4, "big") + head + blob


def header(box=(-10, 20, 30, -40), source="a source", more=b"") -> bytes:
    out = field(4, "OsmSchema-V0.6") + field(4, "DenseNodes") + field(16, "writer")
    if box:
        out = field(1, b"".join(field(i + 1, zig(v)) for i, v in enumerate(box))) + out
    if source is not None:
        out += field(17, source) + field(32, 1700000000) + field(33, 7) + field(34, "http://example.org/r")
    return out + more


class Strings:
    def __init__(self):
        self.all = [""]

    def __call__(self, s: str) -> int:
        if s not in self.all:
            self.all.append(s)
        return self.all.index(s)

    def table(self) -> bytes:
        return b"".join(field(1, s) for s in self.all)


def nodes_group(rows, strings, tagless=False) -> bytes:
    """rows: (id, lat, lon, [(k, v)]) with raw positions."""
    pairs = []
    for *_, tags in rows:
        for k, v in tags:
            pairs += [strings(k), strings(v)]
        pairs.append(0)
    dense = field(1, deltas([r[0] for r in rows])) + field(8, deltas([r[1] for r in rows])) + field(9, deltas([r[2] for r in rows]))
    return field(2, dense + (b"" if tagless else field(10, packed(pairs))))


def ways_group(rows, strings) -> bytes:
    """rows: (id, [(k, v)], [ref])."""
    return b"".join(field(3, field(1, i) + field(2, packed(strings(k) for k, _ in tags)) + field(3, packed(strings(v) for _, v in tags)) + field(8, deltas(refs))) for i, tags, refs in rows)


def relations_group(rows, strings) -> bytes:
    """rows: (id, [(k, v)], [(type, id, role)])."""
    kinds = {"node": 0, "way": 1, "relation": 2}
    return b"".join(
        field(4, field(1, i) + field(2, packed(strings(k) for k, _ in tags)) + field(3, packed(strings(v) for _, v in tags)) + field(8, packed(strings(r) for _, _, r in m)) + field(9, deltas([x for _, x, _ in m])) + field(10, packed(kinds[t] for t, _, _ in m)))
        for i, tags, m in rows
    )


def block(groups, strings, granularity=None, lat_offset=None, lon_offset=None) -> bytes:
    out = field(1, strings.table()) + b"".join(field(2, g) for g in groups)
    for at, value in ((17, granularity), (19, lat_offset), (20, lon_offset)):
        if value is not None:
            out += field(at, value)
    return out


def tiny(raw=False) -> bytes:
    s = Strings()
    nodes = nodes_group([(10, 520000000, 130000000, [("name", "A"), ("place", "city"), ("population", "+12")]), (12, 520000100, 130000100, []), (15, -5, 7, [("amenity", "pub"), ("addr:street", "é Street"), ("empty", "")])], s)
    first = block([nodes], s)
    s = Strings()
    second = block([ways_group([(5, [("highway", "primary")], [10, 12, 15]), (9, [], [12, 99]), (11, [("waterway", "river"), ("width", "4")], [15, 12, 10])], s)], s)
    s = Strings()
    third = block([relations_group([(3, [("type", "multipolygon"), ("leisure", "park")], [("way", 5, "outer"), ("node", 10, "label"), ("relation", 4, "sub"), ("way", 77, "inner")]), (4, [], [("relation", 8, "x")])], s)], s)
    return b"".join([frame("OSMHeader", header(), raw), *(frame("OSMData", b, raw) for b in (first, second, third))])
