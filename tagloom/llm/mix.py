"""Mixing sources to target shares: nested histograms of hash thresholds instead of a sort.

Every document has a hash. Tokens are summed by source and hash bucket; the bucket in which a source's budget ends is
refined by the next bits of the hash, until it holds one hash. A document gets one copy more if its hash lies below its
source's threshold. Only one row a source ever goes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.core import materialise, spread
from tagloom.llm.bpe import VOCABULARY_FOLDER, count_tokens

#: Bits of the hash that one histogram resolves, and bits that are used in all.
LEVEL_BITS, HASH_BITS = 10, 60
#: Rounds in which documents are added to a budget, beside one for each further copy.
FILLS = 4
#: A source whose tokens miss its budget by a larger share is short.
TOLERANCE = 0.01
MOST_SOURCES = 10_000


@dataclass
class _Plan:
    source: str
    weight: float
    repeat: int
    size: int = 0
    share: float = 0.0
    full: int = 0
    rest: float = 0.0  # budget not yet filled
    start: int = 0  # hashes from which on the next rule may take documents
    lap: int = 1  # copies beyond the full ones that the next rule gives the last of
    rules: list[tuple[int, int, int, int]] = field(default_factory=list)  # one copy more for low <= hash < high and least < tokens <= most


def _fill(sizes: DataFrame, plans: list[_Plan], bits: int, hash_bits: int) -> None:
    """Give each plan one more rule: as many documents in the order of their hashes as fit into its rest."""
    spark = sizes.sparkSession
    low, below, open_ = {p.source: p.start for p in plans}, {p.source: 0 for p in plans}, {p.source: p for p in plans}
    for level in range(-(-hash_bits // bits)):
        if not open_:
            return
        left = max(0, hash_bits - (level + 1) * bits)  # bits of the hash below this level
        above = min(hash_bits, left + bits)
        at = spark.createDataFrame([(s, low[s], p.rest - below[s], p.start, int(p.rest)) for s, p in open_.items()], "source string, _low bigint, _rest double, _start bigint, _most bigint")
        inside = sizes.join(F.broadcast(at), "source").where((F.col("hash") >= F.col("_start")) & (F.col("tokens") <= F.col("_most")))
        if level:
            inside = inside.where(F.shiftright("hash", above) == F.shiftright("_low", above))
        hist = inside.groupBy("source", "_rest", F.shiftright("hash", left).alias("bucket")).agg(F.sum("tokens").alias("t"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        running = F.sum("t").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2 ** bits rows a source
        edge = hist.withColumn("upto", running).groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("_rest"), F.struct("bucket", "t", "lo", "hi", "upto"))).alias("e"), F.sum("t").alias("all"))
        found = {r.source: r for r in edge.collect()}
        for s, p in list(open_.items()):
            e = found[s].e if s in found else None
            if e is None:  # all that may be taken fits: from here on the next copies
                p.rules.append((p.start, 1 << hash_bits, -1, int(p.rest)))
                p.rest, p.start, p.lap = p.rest - (found[s]["all"] if s in found else 0), 0, p.lap + 1
                del open_[s]
            elif e.lo == e.hi or not left:
                most, taken = int(p.rest), below[s] + e.upto - e.t
                p.rules.append((p.start, e.lo, -1, most))
                p.rest, p.start = p.rest - taken, e.lo + 1
                del open_[s]
            else:
                below[s], low[s] = below[s] + e.upto - e.t, e.bucket << left


def _copies(rules: str = "_rules") -> Column:
    """Copies that a document gets beyond the full ones: one for each rule that it meets."""
    return F.size(F.filter(rules, lambda r: (F.col("hash") >= r.low) & (F.col("hash") < r.high) & (F.col("tokens") > r.least) & (F.col("tokens") <= r.most)))


def _nearest(sizes: DataFrame, plans: list[_Plan]) -> None:
    """Where much of a budget is left because every document is larger than the rest, one more comes nearer: the smallest below twice the rest."""
    if not plans:
        return
    at = sizes.sparkSession.createDataFrame([(p.source, p.rest, p.repeat - p.full, p.rules) for p in plans], f"source string, _rest double, _more int, _rules {_RULES}")
    able = sizes.join(F.broadcast(at), "source").where((F.col("tokens") > F.col("_rest")) & (F.col("tokens") < 2 * F.col("_rest"))).where(_copies() < F.col("_more"))
    for r in able.groupBy("source").agg(F.min(F.struct("tokens", "hash")).alias("d")).collect():
        next(p for p in plans if p.source == r.source).rules.append((r.d.hash, r.d.hash + 1, r.d.tokens - 1, r.d.tokens))


_RULES = "array<struct<low: bigint, high: bigint, least: bigint, most: bigint>>"


def mix_sources(
    docs: DataFrame, targets: DataFrame, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    tokenizer: str = "byte_bpe_50k", folder: str = VOCABULARY_FOLDER, level_bits: int = LEVEL_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(documents, shares).

    targets has source, weight and max_repeat. documents: id_col, source, tokens and copies (1 to max_repeat) of every
    document that is used. shares: for each source of targets source, weight, target_share, available_tokens, tokens,
    share, most_copies and short (true if the source can't reach its weight).

    total is the size of the mixture in tokens; by default the largest for which each source that has tokens can give its
    share. With a larger total, a source gives max_repeat copies of everything and is short. Sources without a token are
    short; the others divide their weight in proportion, so that they keep their shares among each other. Which documents
    of a source get one copy more follows from a hash of id and text. A source is filled up to its budget in FILLS rounds and
    one more for each further copy that it may give; if more than TOLERANCE of the budget is then left, because all
    documents are larger, the one is added that comes nearest. short is also true if the budget is missed by more than
    TOLERANCE all the same (equal rows are used alike). Documents with a NULL or unnamed source take no part; sources are compared exactly.
    NULL and empty texts have 0 tokens and are never used for size, but belong to the set like any other. NULL, zero and
    negative weights or max_repeats give a source nothing. Rows of targets with NULL or repeated sources count once, as
    the largest. Empty tables give empty documents and shares of 0. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = (
        targets.where(F.col("source").isNotNull()).groupBy("source")
        .agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeat"), F.lit(0)).alias("max_repeat")).limit(MOST_SOURCES + 1).collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in targets")
    plans = {r.source: _Plan(r.source, max(0.0, float(r.weight)), max(0, int(r.max_repeat))) for r in rows}
    names = spark.createDataFrame([(s,) for s in plans], "source string")
    plain = spread(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source")))
    plain = plain.withColumn("hash", F.shiftrightunsigned(F.xxhash64("_id", "text"), 64 - HASH_BITS)).join(F.broadcast(names), "source", "left_semi")
    sizes = materialise(count_tokens(plain, "text", ("_id", "source", "hash"), "tokens", tokenizer, folder), "mix_sizes")
    for r in sizes.groupBy("source").agg(F.sum("tokens").alias("t")).collect():
        plans[r.source].size = r.t
    usable = [p for p in plans.values() if p.size and p.weight and p.repeat]
    whole = sum(p.weight for p in usable)
    for p in usable:
        p.share = p.weight / whole
    most = min((p.repeat * p.size / p.share for p in usable), default=0)
    size = most if total is None else total
    for p in plans.values():
        budget = min(p.share * size, p.repeat * p.size) if p.share else 0
        p.full = int(budget // p.size) if p.share else 0
        p.rest = budget - p.full * p.size if p.share else 0
    budgets = {p.source: p.rest + p.full * p.size for p in plans.values()}
    # fills, and laps while a source may give further copies
    for _ in range(FILLS + max((p.repeat - p.full for p in plans.values() if p.share and p.rest >= 1), default=0)):
        left = [p for p in plans.values() if p.rest >= 1 and p.full + p.lap <= p.repeat]
        if not left:
            break
        _fill(sizes, left, level_bits, HASH_BITS)
    _nearest(sizes, [p for p in plans.values() if p.share and p.rest > TOLERANCE * budgets[p.source]])
    wanted = spark.createDataFrame([(p.source, p.full, p.rules) for p in plans.values() if p.share], f"source string, _full int, _rules {_RULES}")
    used = (
        sizes.join(F.broadcast(wanted), "source")
        .withColumn("copies", F.col("_full") + _copies())
        .where(F.col("copies") > 0)
        .select(F.col("_id").alias(id_col), "source", "tokens", F.col("copies").cast("int").alias("copies"))
    )
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    asked = spark.createDataFrame([(p.source, p.weight, p.share, int(p.size), float(p.share * size)) for p in plans.values()], "source string, weight double, target_share double, available_tokens bigint, _asked double")
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # one row a source
    shares = (
        asked.join(reached, "source", "left").fillna(0, ["tokens", "most_copies"])
        .withColumn("short", (F.col("weight") > 0) & ((F.col("target_share") == 0) | (F.abs(F.col("tokens") - F.col("_asked")) > F.greatest(F.lit(1.0), TOLERANCE * F.col("_asked")))))
        .withColumn("share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(0.0))
        .select("source", "weight", "target_share", "available_tokens", "tokens", "share", "most_copies", "short")
    )
    return used, shares
