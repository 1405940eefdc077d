"""The queries on language-model data, p1, p2, p3, p8, p9 and p10, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.core import materialise
from tagloom.llm.bpe import encode_corpus
from tagloom.llm.heavy import heavy_terms
from tagloom.llm.mix import mix_sources
from tagloom.llm.pairs import count_pairs
from tagloom.llm.split import split_oversized
from tagloom.llm.termcount import count_terms, mark_terms
from tagloom.sources.tables import table, tag_rows


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    """All tag rows with a number for their kind, which is narrower in an exchange."""
    return tag_rows(spark, folder).withColumn("kind", F.expr("cast(case kind when 'node' then 0 when 'way' then 1 else 2 end as tinyint)"))


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    return mark_terms(count_terms(_tags(spark, folder), ("kind", "idx"), ("k", "v"))).select("field", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark is not null").select("field", "term", "mark")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return tag_rows(spark, folder, ("node", "way")).where("k is not null and v is not null").select("kind", "idx", F.concat("k", F.lit("="), "v").alias("item"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair, however rare."""
    return count_pairs(_items(spark, folder)).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"))


def p2_odds(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs of p2_pairs with their odds ratios beside the lift."""
    return count_pairs(_items(spark, folder)).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    exact = F.col("n_ab").cast("decimal(38,0)") * F.col("n").cast("decimal(19,0)") >= F.lit(5).cast("decimal(1,0)") * F.col("n_a").cast("decimal(18,0)") * F.col("n_b").cast("decimal(18,0)")
    return count_pairs(_items(spark, folder), min_together=10).where(exact).select("item_a", "item_b")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialise(_tags(spark, folder).distinct().select("k", "v"), "tag_set")
    return heavy_terms(rows, ("k", "v"), 200)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_terms(spark, folder).select("field", "term")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_target"))[1]


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), 3000, 150)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_pieces(spark, folder).where("piece = 0").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_odds": p2_odds,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pieces": p10_pieces,
}

_TAGS = """t as (select distinct 'node' as kind, idx, pos, k, v from node_tag
  union all select distinct 'way', idx, pos, k, v from way_tag
  union all select distinct 'relation', idx, pos, k, v from rel_tag),
f as (select kind, idx, 'k' as field, k as term from t where k is not null
  union all select kind, idx, 'v', v from t where v is not null)"""

_TERMS = f"""with {_TAGS},
a as (select count(*) as n from (select distinct kind, idx from f)),
c as (select field, term, sum(n) as occurrences, count(*) as records
  from (select field, term, kind, idx, count(*) as n from f group by all) group by field, term)
select field, term, cast(occurrences as bigint) as occurrences, records,
  case when records <= 2 then 'rare' when records * 20 >= n then 'common' end as mark from c, a"""

_PAIRS = """with i as (select distinct 0 as kind, idx, k || '=' || v as item from node_tag where k is not null and v is not null
  union all select distinct 1, idx, k || '=' || v from way_tag where k is not null and v is not null),
n as (select count(*) as n from (select distinct kind, idx from i)),
c as (select item, count(*) as n from i group by item),
p as (select a.item as item_a, b.item as item_b, count(*) as n_ab from i a join i b
  on a.kind = b.kind and a.idx is not distinct from b.idx and a.item < b.item group by 1, 2)
select item_a, item_b, n_ab, ca.n as n_a, cb.n as n_b, n.n as n
from p join c ca on ca.item = item_a join c cb on cb.item = item_b, n"""

_HEAVY = f"""with {_TAGS},
a as (select field, count(*) as n from f group by field),
c as (select field, term, count(*) as rows from f group by field, term)
select c.field, term, rows from c join a on a.field = c.field where rows * 200 >= n"""

SQL: dict[str, str] = {
    "p1_terms": _TERMS,
    "p1_found": f"select field, term, mark from ({_TERMS}) where mark is not null",
    "p2_pairs": f"select item_a, item_b, n_ab, n_a, n_b, n, round(cast(n_ab as double) * n / (cast(n_a as double) * n_b), 6) as lift from ({_PAIRS})",
    "p2_odds": f"""select item_a, item_b, n_ab, n_a, n_b, n, round(cast(n_ab as double) * n / (cast(n_a as double) * n_b), 6) as lift,
      round((n_ab + 0.5e0) * (n - n_a - n_b + n_ab + 0.5e0) / ((n_a - n_ab + 0.5e0) * (n_b - n_ab + 0.5e0)), 6) as odds_ratio from ({_PAIRS})""",
    "p2_found": f"select item_a, item_b from ({_PAIRS}) where n_ab >= 10 and n_ab * n >= 5 * n_a * n_b",
    "p3_terms": _HEAVY,
    "p3_found": f"select field, term from ({_HEAVY})",
}
