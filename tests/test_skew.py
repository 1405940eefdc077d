"""A third of all rows or more in one group: results stay whole."""

from tagloom.operators.hierarchy import hierarchy
from tagloom.operators.near import pairs_within
from tagloom.operators.wide import widen


def test_copies_of_one_row(spark):
    tags = [("node", 1, 0, "k", "7")] * 20_000 + [("node", i, 0, "k", str(i)) for i in range(2, 5000)]
    out = widen(spark.createDataFrame(tags, "kind string, idx bigint, pos int, k string, v string"), spark.createDataFrame([("k", "c", "int")], "k string, col_name string, col_type string"), None)
    assert out.count() == 4999 and out.where("size(issues) > 0").count() == 0


def test_one_entity_with_many_keys(spark):
    tags = [("node", 1, i, f"k{i}", "x") for i in range(15_000)] + [("node", i, 0, "k0", "y") for i in range(2, 3000)]
    out = widen(spark.createDataFrame(tags, "kind string, idx bigint, pos int, k string, v string"), spark.createDataFrame([("k0", "c", "text")], "k string, col_name string, col_type string"), None)
    assert len(out.where("idx = 1").first().other) == 14_999 and out.count() == 2999


def test_one_parent_of_most(spark):
    links = [(i, 0) for i in range(1, 6000)] + [(10_000 + i, i) for i in range(1, 2000)]
    out = hierarchy(spark.createDataFrame(links, "child bigint, parent bigint"))
    assert {(r.depth, r["count"]) for r in out.groupBy("depth").count().collect()} == {(1, 5999), (2, 1999)}


def test_copies_of_one_place(spark):
    rows = [(1, 5.0, 5.0)] * 30_000 + [(i, 5.0 + i * 1e-3, 5.0) for i in range(2, 3000)] + [(9000, 5.00001, 5.0)]
    assert [(r.id_a, r.id_b) for r in pairs_within(spark.createDataFrame(rows, "idx bigint, lat double, lon double"), 25).collect()] == [(1, 9000)]


def test_half_of_the_references_on_one_node(spark, tmp_path, monkeypatch):
    """Half of the references on one node, a third without any; with and without a broadcast the same rows."""
    import tagloom.core as core
    from tagloom.operators.geometry import located_refs
    from tagloom.operators.maps import MapTables

    nodes = [(i, 100 + i, i * 10, None if i == 7 else i) for i in range(50)]
    refs = [(i, p, *((100 + 3, 3) if i % 2 else (999, None) if i % 3 else (100 + i % 50, i % 50))) for i in range(300) for p in range(4)]
    spark.createDataFrame(nodes, "idx bigint, osm_id bigint, lat int, lon int").write.parquet(f"{tmp_path}/node.parquet")
    spark.createDataFrame(refs, "idx bigint, pos int, ref_osm_id bigint, node_idx bigint").write.parquet(f"{tmp_path}/way_ref.parquet")
    m = MapTables(spark, str(tmp_path))

    def rows():
        return sorted(map(repr, located_refs(m).collect())), sorted(map(repr, m.resolved_refs().collect()))

    small = rows()
    monkeypatch.setattr(core, "BROADCAST_ROWS", 1)
    assert rows() == small and len(small[0]) == 1200
    assert sum(r.lat is None for r in located_refs(m).collect()) == sum(n is None or n == 7 for *_, n in refs)


def test_broadcasts_are_measured_in_bytes(spark):
    from tagloom.core import fits_broadcast

    assert fits_broadcast(spark.range(1000)) and not fits_broadcast(spark.range(300_000))
    assert not fits_broadcast(spark.range(20).selectExpr("id", "sequence(1L, 300000L) as trail")) and not fits_broadcast(spark.range(20).selectExpr("repeat('x', 2000000) as t"))
