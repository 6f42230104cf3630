"""Mixing sources to target weights with a low-discrepancy schedule.

Every source gives ``target_share`` of the tokens of the mixture, whose size is the largest for which
no record is used more than ``max_repeats`` times.  The records of a source are shuffled anew for each
use, laid end to end, and cut into blocks of about equal tokens.  Slots of the mixture go to sources by
mapping the golden-ratio sequence through the cumulative weights; slots are ranked within their source,
and the n-th slot of a source takes its n-th block.

Defined results: records of sources without target, of size 0, or with null key give nothing; source
names are compared without case, outer blanks, and with ``_`` like ``-``; a target without records has
no share and the others keep their proportions; copies of a record count once; equal hashes are
ordered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsheet.llm.ranks import parts_for, running
from loomsheet.session import checkpoint

#: tokens of a block, which one slot takes
BLOCK = 8_192
#: fractional part of the golden ratio
GOLDEN = 0.6180339887498949
#: slots ranked in one window partition
CHUNK = 65_536


def source_name(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), "_", "-")


def mixture(items: DataFrame, targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, doc_id, use_no, tokens, slot, place) of the mixture of items (doc_id, source, tokens).

    ``targets`` (source, target_share, max_repeats) is a small table of sources and is read to the
    driver, as is the number of tokens by source; ``place`` is the token at which a record starts
    within its slot's block.
    """
    named = items.select("doc_id", source_name(F.col("source")).alias("source"), "tokens").filter("tokens > 0 and doc_id is not null and source is not null")
    wanted = {}
    for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect():
        if r["source"] and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0:
            wanted[r["source"]] = (float(r["target_share"]), int(r["max_repeats"]))
    rows = checkpoint(named.filter(F.col("source").isin(*wanted)).groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens"))
    have = {r["source"]: (r["t"], r["n"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    sources = sorted(s for s in wanted if s in have)
    out = "source string, doc_id bigint, use_no int, tokens bigint, slot bigint, place bigint"
    if not sources:
        return items.sparkSession.createDataFrame([], out)
    weight = sum(wanted[s][0] for s in sources)
    shares = {s: wanted[s][0] / weight for s in sources}
    size = min(wanted[s][1] * have[s][0] / shares[s] for s in sources)
    quota = {s: size * shares[s] for s in sources}
    uses = {s: min(wanted[s][1], int(-(-quota[s] // have[s][0]))) for s in sources}
    parts = parts_for(sum(n * uses[s] for s, (_, n) in have.items() if s in uses))

    def by_source(values: dict, kind: str) -> Column:
        return F.try_element_at(F.create_map(*[x for s in sources for x in (F.lit(s), F.lit(values[s]).cast(kind))]), F.col("source"))

    used = rows.withColumn("use_no", F.explode(F.sequence(F.lit(0), by_source(uses, "int") - 1))).withColumn("_hash", F.xxhash64("doc_id", "use_no"))
    part = F.col("use_no") * parts + F.pmod("_hash", F.lit(parts))
    laid = running(used, ["source"], ["_hash", "doc_id"], part, F.col("tokens"), "start")
    kept = laid.filter(F.col("start") + F.col("tokens") / 2 <= by_source(quota, "double"))
    blocks = kept.select("source", "doc_id", "use_no", "tokens", (F.col("start") / block).cast("long").alias("block"), (F.col("start") % block).alias("place"))
    return blocks.join(schedule(items, shares, quota, block), ["source", "block"]).select("source", "doc_id", F.col("use_no").cast("int").alias("use_no"), "tokens", "slot", "place")


def schedule(items: DataFrame, shares: dict[str, float], quota: dict[str, float], block: int = BLOCK) -> DataFrame:
    """(source, block, slot): the slot each block of a source takes; some slots at the end stay free."""
    sources = sorted(shares)
    # the sequence gives a source its share to within a few slots; so many more cover all blocks
    slots = max(int(quota[s] / block / shares[s]) for s in sources) + int(16 / min(shares.values())) + 16
    point = F.pmod((F.col("slot") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    source: Column = F.lit(sources[-1])
    reached = sum(shares[s] for s in sources[:-1])
    for s in reversed(sources[:-1]):
        source = F.when(point < reached, F.lit(s)).otherwise(source)
        reached -= shares[s]
    numbered = items.sparkSession.range(slots).select(F.col("id").alias("slot")).withColumn("source", source)
    return running(numbered, ["source"], ["slot"], (F.col("slot") / CHUNK).cast("long"), F.lit(1).cast("long"), "block")


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, records, most_uses): what each source gives in the mixture."""
    per_record = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    sums = per_record.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("records"), F.max("uses").alias("most_uses"))
    total = sums.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    joined = sums.join(F.broadcast(total)).join(wanted, "source")  # the total is one row
    return joined.select("source", "target_share", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("share"), "tokens", "records", "most_uses")
