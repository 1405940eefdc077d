import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pbf_files import Strings, block, deltas, field, frame, header, nodes_group, number, packed, tiny, ways_group

from tagloom.__main__ import main
from tagloom.plans.compile import block_index, compile_pbf
from tagloom.sources import wire
from tagloom.sources.dataset import MapDataset, SchemaMismatch, from_tables
from tagloom.sources.pbf import PbfError, _stops, frames, read_pbf


def write(tmp_path, data, name="f.osm.pbf"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_packed_numbers(values):
    assert wire.packed(packed(values)).tolist() == values


@given(st.lists(st.integers(-(2**61), 2**61)))
def test_deltas_are_undone(values):
    coded = wire.unzigzag(wire.packed(deltas(values)))
    with np.errstate(over="ignore"):
        assert np.cumsum(coded).tolist() == values


@given(st.lists(st.lists(st.integers(-(2**40), 2**40))))
def test_lists_at_once(lists):
    values, ends = wire.packed_lists([deltas(x) for x in lists])
    sums = wire.sums_within(wire.unzigzag(values), ends)
    starts = [0, *ends]
    assert [sums[a:b].tolist() for a, b in zip(starts, ends)] == lists


def test_zero_as_a_value_ends_no_list():
    assert _stops(np.array([5, 0, 0, 0, 7, 8, 0])).tolist() == [2, 3, 6]


def test_wire_errors():
    with pytest.raises(ValueError, match="wire type"):
        list(wire.fields(number(1 << 3 | 3)))
    with pytest.raises(ValueError, match="ends within"):
        list(wire.fields(number(1 << 3 | 2) + number(9) + b"x"))


@pytest.mark.parametrize("raw", [False, True])
@pytest.mark.parametrize("partition_bytes", [1, 1 << 20])
def test_entities(spark, tmp_path, raw, partition_bytes):
    path = write(tmp_path, tiny(raw))
    nodes = {r.osm_id: r for r in read_pbf(spark, path, "nodes", partition_bytes).collect()}
    assert (nodes[10].lat_nano, nodes[10].lon_nano, nodes[15].lat_nano) == (52000000000, 13000000000, -500)
    assert [tuple(t) for t in nodes[15].tags] == [("amenity", "pub"), ("addr:street", "é Street"), ("empty", "")] and nodes[12].tags == []
    ways = {r.osm_id: r for r in read_pbf(spark, path, "ways", partition_bytes).collect()}
    assert ways[9].refs == [12, 99] and ways[11].refs == [15, 12, 10] and [tuple(t) for t in ways[11].tags] == [("waterway", "river"), ("width", "4")]
    relations = {r.osm_id: r for r in read_pbf(spark, path, "relations", partition_bytes).collect()}
    assert [tuple(m) for m in relations[3].members] == [("way", 5, "outer"), ("node", 10, "label"), ("relation", 4, "sub"), ("way", 77, "inner")]
    head = read_pbf(spark, path, "header").first()
    assert (head.bbox_left, head.bbox_right, head.bbox_top, head.bbox_bottom, head.source, head.replication_sequence_number, head.required) == (-10, 20, 30, -40, "a source", 7, "OsmSchema-V0.6,DenseNodes")
    assert [r.block_type for r in block_index(spark, path, partition_bytes).collect()] == ["nodes", "ways", "relations"]


def _nodes(rows, **scale):
    s = Strings()
    g = nodes_group(rows, s)
    return frame("OSMData", block([g], s, **scale))


def test_granularities_offsets_and_tagless_groups(spark, tmp_path):
    s = Strings()
    groups = [nodes_group([(1, 10, 10, [("a", "b")])], s), nodes_group([(2, 20, 20, []), (3, 30, 30, [])], s, tagless=True), nodes_group([(4, 40, 40, [("c", "d")])], s)]
    data = frame("OSMHeader", header(box=None, source=None)) + frame("OSMData", block(groups, s, granularity=1000, lat_offset=5000, lon_offset=-3000)) + _nodes([(9, 7, -7, []), (9, 7, -7, [])])
    path = write(tmp_path, data)
    counts = compile_pbf(spark, path, str(tmp_path / "d"), ids=True).first()
    assert counts.nodes == 5 and counts.ways == 0
    d = MapDataset.open(spark, str(tmp_path / "d"))
    assert d.header.first().asDict() == {"coord_scale": 10_000_000, "bbox_left": None, "bbox_right": None, "bbox_top": None, "bbox_bottom": None, "writingprogram": "writer", "source": None, "replication_timestamp": None, "replication_sequence_number": None, "replication_base_url": None}
    rows = [(r.idx, r.osm_id, r.lat, r.lon, [tuple(t) for t in r.tags]) for r in d.nodes.orderBy("idx").collect()]
    assert rows == [(0, 1, 150, 70, [("a", "b")]), (1, 2, 250, 170, []), (2, 3, 350, 270, []), (3, 4, 450, 370, [("c", "d")]), (4, 9, 7, -7, [])]


def test_compile_resolves(spark, tmp_path, capsys):
    path, target = write(tmp_path, tiny()), str(tmp_path / "d")
    assert main(["compile", path, target, "--ids"], spark) == 0
    assert "nodes:        3" in capsys.readouterr().out
    d = MapDataset.open(spark, target)
    ways = {r.osm_id: [tuple(x) for x in r.refs] for r in d.ways.collect()}
    assert ways == {5: [(10, 0), (12, 1), (15, 2)], 9: [(12, 1), (99, None)], 11: [(15, 2), (12, 1), (10, 0)]}
    relations = {r.osm_id: [tuple(x) for x in r.members] for r in d.relations.collect()}
    assert relations[3] == [("way", 5, 0, "outer"), ("node", 10, 0, "label"), ("relation", 4, 1, "sub"), ("way", 77, None, "inner")]
    for command, text in (("count", "node: 3"), ("cities", '[{"name":"A","population":12}]'), ("pub-names", "unknown pub name\n  addr:street: é Street"), ("road-length", " km"), ("debug", '"osm_id":10')):
        assert main([command, target], spark) == 0
        assert text in capsys.readouterr().out, command
    png, svg = tmp_path / "r.png", tmp_path / "f.svg"
    assert main(["render-roads", target, "-o", str(png), "-w", "50"], spark) == 0 and png.read_bytes().startswith(b"\x89PNG")
    assert main(["render-features", target, "-o", str(svg)], spark) == 0
    assert svg.read_text().count("<polyline points") == 3 and 'stroke-width="4"' in svg.read_text()
    assert main(["read", target], spark) == 0
    assert main(["count", str(tmp_path / "nothing")], spark) == 1


def test_compile_without_ids(spark, tmp_path):
    row = compile_pbf(spark, write(tmp_path, tiny()), str(tmp_path / "d")).first()
    assert row.asDict() == {"nodes": 3, "ways": 3, "relations": 2, "unresolved_nodes": 1, "unresolved_ways": 1, "unresolved_relations": 1}
    assert MapDataset.open(spark, str(tmp_path / "d")).nodes.where("osm_id is not null").count() == 0


def _bad(spark, tmp_path, data, entity="nodes"):
    with pytest.raises(Exception, match="PbfError|blob|group|header|ends within"):
        read_pbf(spark, write(tmp_path, data), entity).collect()


def test_rejected(spark, tmp_path):
    _bad(spark, tmp_path, frame("OSMOther", b""))
    for kind in (1, 5):
        _bad(spark, tmp_path, frame("OSMData", field(2, field(kind, b""))))
    _bad(spark, tmp_path, tiny()[:-5])
    lzma = field(2, 4) + field(4, b"abcd")
    head = field(1, "OSMData") + field(3, len(lzma))
    _bad(spark, tmp_path, len(head).to_bytes(4, "big") + head + lzma)
    two = frame("OSMHeader", header()) * 2
    for data in (two, b""):
        with pytest.raises(PbfError, match="header"):
            compile_pbf(spark, write(tmp_path, data), str(tmp_path / "x"))
    with pytest.raises(Exception, match="entity"):
        read_pbf(spark, write(tmp_path, tiny()), "people")


def test_frames(tmp_path):
    assert [b.kind for b in frames(write(tmp_path, tiny()))] == ["OSMHeader", "OSMData", "OSMData", "OSMData"]


def test_more_ways_than_a_batch(spark, tmp_path):
    s = Strings()
    rows = [(i, [("highway", str(i % 3))], list(range(i, i + i % 5))) for i in range(1, 3000)]
    data = frame("OSMHeader", header()) + frame("OSMData", block([ways_group(rows, s)], s))
    got = {r.osm_id: (r.refs, r.tags[0].v) for r in read_pbf(spark, write(tmp_path, data), "ways").collect()}
    assert got == {i: (refs, tags[0][1]) for i, tags, refs in rows}


def test_dataset_of_tables_gives_the_same_answers(spark, sf, tmp_path):
    from tagloom.operators.maps import MapTables
    from tagloom.plans.queries import MAP_QUERIES

    m = MapTables(spark, sf)
    from_tables(m).save(str(tmp_path / "d"))
    stored = MapDataset.open(spark, str(tmp_path / "d")).tables()
    for name in ("entity_counts", "road_length_total", "classify_ways", "classified_features", "cities", "multipolygon_sizes", "raster_transform", "pub_names"):
        assert sorted(map(repr, MAP_QUERIES[name](m).collect())) == sorted(map(repr, MAP_QUERIES[name](stored).collect())), name
    spark.range(1).write.mode("overwrite").parquet(str(tmp_path / "d/ways"))
    with pytest.raises(SchemaMismatch):
        MapDataset.open(spark, str(tmp_path / "d"))


def test_every_map_query_with_and_without_ids(spark, sf, tmp_path):
    """Queries about ids raise where there are none; all others give the same rows but for the ids that they show."""
    import tarfile

    from tagloom.operators.maps import MapTables, MissingIds
    from tagloom.plans import queries as q

    data = from_tables(MapTables(spark, sf))
    data.save(str(tmp_path / "with"))
    MapDataset.open(spark, str(tmp_path / "with")).save(str(tmp_path / "without"), ids=False)
    with tarfile.open(tmp_path / "packed.tar", "w") as tar:
        tar.add(tmp_path / "without", "map")
    a, b = MapDataset.open(spark, str(tmp_path / "with")).tables(), MapDataset.open(spark, str(tmp_path / "packed.tar")).tables()
    shown = {"scan_nodes", "scan_ways", "scan_relations", "debug_nodes", "debug_ways", "debug_relations"}
    raised = set()
    for name, f in q.MAP_QUERIES.items():
        try:
            without = f(b)
        except MissingIds:
            raised.add(name)
            continue
        with_ = f(a)
        if name in shown:
            with_, without = with_.drop("osm_id"), without.drop("osm_id")
        assert sorted(map(repr, with_.collect())) == sorted(map(repr, without.collect())), name
    assert raised == {"id_to_idx", "unsorted_ids", "delta_decode", "i40_roundtrip", "block_order", "unresolved_refs", "ids_join", "id_block_offsets", "bitmap_rank"}


def test_index_blocks_and_folders(spark, tmp_path):
    import json

    from tagloom.sources.pbf import _Reader

    path = write(tmp_path, tiny())
    index = read_pbf(spark, path, "index").collect()
    assert [r.kinds for r in index] == [["nodes"], ["ways"], ["relations"]]
    one = [(r.path, r.blob_start, r.blob_len) for r in index if "ways" in r.kinds]
    # only the blocks of the list are opened
    parts = _Reader(path, "ways", 1, json.dumps(one)).partitions()
    assert [(b.path, b.start, b.size) for p in parts for b in p.blobs] == one
    assert read_pbf(spark, path, "ways", blobs=one).count() == 3 and read_pbf(spark, path, "nodes", blobs=one).count() == 0
    write(tmp_path, tiny(), "g.osm.pbf")
    assert read_pbf(spark, str(tmp_path), "ways", 1).count() == 6 and read_pbf(spark, f"file://{path}", "ways").count() == 3
    with pytest.raises(PbfError, match="different entities"):
        twice = frame("OSMHeader", header()) + _nodes([(9, 7, -7, []), (9, 7, -8, [])])
        compile_pbf(spark, write(tmp_path, twice, "h.osm.pbf"), str(tmp_path / "h"))
