"""Spark-native analytics over map tables (nodes, ways, relations, tags) and message corpora."""

from tagloom.operators.maps import MapTables
from tagloom.plans.compile import compile_pbf
from tagloom.sources.dataset import MapDataset, from_tables
from tagloom.sources.pbf import read_pbf

__all__ = ["MapDataset", "MapTables", "compile_pbf", "from_tables", "read_pbf"]
__version__ = "0.1.0"
