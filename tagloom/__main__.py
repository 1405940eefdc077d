"""python -m tagloom COMMAND ...: compile a .osm.pbf file, and ask a compiled dataset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagloom.plans import queries as q
from tagloom.plans.compile import compile_pbf
from tagloom.sources.dataset import MapDataset
from tagloom.sources.render import draw_features, draw_roads


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagloom", description=__doc__)
    p.add_argument("-v", "--verbose", action="count", default=0, help="log what Spark does; twice for details")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compile", help="write a dataset of a .osm.pbf file")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--ids", action="store_true", help="keep the original ids")
    for name in ("count", "read", "cities", "pub-names", "road-length"):
        sub.add_parser(name).add_argument("dataset")
    d = sub.add_parser("debug", help="print entities with what they refer to")
    d.add_argument("dataset")
    d.add_argument("--types", default="nwr")
    d.add_argument("--num", type=int, default=None)
    d.add_argument("--relations", type=int, default=3, help="at most so many relations")
    r = sub.add_parser("render-roads")
    r.add_argument("dataset")
    r.add_argument("-o", "--output", required=True)
    r.add_argument("-w", "--width", type=int, default=4320)
    f = sub.add_parser("render-features")
    f.add_argument("dataset")
    f.add_argument("-o", "--output", required=True)
    f.add_argument("--width", type=int, default=800)
    f.add_argument("--height", type=int, default=600)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tagloom").getOrCreate()
    if args.verbose:
        spark.sparkContext.setLogLevel("INFO" if args.verbose == 1 else "DEBUG")
    try:
        return _run(args, spark)
    except Exception as e:  # noqa: BLE001 - a command line reports and ends
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "compile":
        row = compile_pbf(spark, args.input, args.output, args.ids).first()
        print(f"Converted:\n  nodes:        {row.nodes}\n  ways:         {row.ways}\n  relations:    {row.relations}")
        print(f"Unresolved ids:\n  nodes:        {row.unresolved_nodes}\n  ways:         {row.unresolved_ways}\n  relations:    {row.unresolved_relations}")
        return 0
    data = MapDataset.open(spark, args.dataset)
    m = data.tables()
    if args.command == "count":
        for row in q.entity_counts(m).orderBy("kind").collect():
            print(f"{row.kind}: {row.n}")
    elif args.command == "read":
        for df in (data.nodes, data.ways, data.relations):
            df.write.format("noop").mode("overwrite").save()
    elif args.command == "cities":
        rows = q.cities(m, 2**64 - 1).orderBy("idx").select(F.to_json(F.struct("name", "population")).alias("j")).toLocalIterator()
        print("[" + ",".join(r.j for r in rows) + "]")
    elif args.command == "pub-names":
        addresses = q.pub_addresses(m).groupBy("kind", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", "v"))), lambda x: F.concat(F.lit("\n  "), x.k, F.lit(": "), x.v)).alias("a"))
        pubs = q.pub_names(m).join(addresses, ["kind", "idx"], "left").orderBy("kind", "idx")
        for row in pubs.select(F.concat("name", F.coalesce(F.array_join("a", ""), F.lit(""))).alias("t")).toLocalIterator():
            print(row.t)
    elif args.command == "road-length":
        print(f"{q.road_length_total(m).first().km:.0f} km")
    elif args.command == "debug":
        data.header_view().show(vertical=True, truncate=False)
        for letter, df, most in (("n", data.nodes, args.num), ("w", data.ways, args.num), ("r", data.relations, min(args.relations, args.relations if args.num is None else args.num))):
            if letter in args.types:
                for row in (df if most is None else df.where(F.col("idx") < most)).orderBy("idx").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                    print(row.j)
    elif args.command == "render-roads":
        print("{} x {}".format(*draw_roads(m, args.output, args.width)))
    else:
        print(f"{draw_features(m, args.output, args.width, args.height)} features")
    return 0


if __name__ == "__main__":
    sys.exit(main())
