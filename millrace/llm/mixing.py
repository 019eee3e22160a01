"""Problem 7: a mix of sources with target shares of all tokens, small sources repeated up to a cap.

The schedule is a low-discrepancy sequence: slot i lies at the fractional part of (i + 1) / golden ratio, and the source on whose
stretch of the cumulative weights it falls fills it. A slot's rank among its source's slots names the block of documents that it
takes; beyond the last block the source begins again, and slots beyond max_repeats rounds stay empty (the source misses its share).

Blocks hold equal numbers of tokens: a source's documents are spread over shards by a hash, put into a hashed order within each
shard, and cut at equal steps of the running token sum. A shard holds about SHARD_TOKENS, so a source with a third of all
documents is many shards, and no window sees more than one. Ranks are counted in chunks of CHUNK slots plus the sums before.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import strip
from millrace.session import written

#: SLACK: slots by which a source may be off what its stretch of the weights asks for (golden-ratio points: a few, even for 2**60).
SHARD_TOKENS, CHUNK, SLACK = 4_000_000, 65_536, 64
BLOCK_LEAST, BLOCK_MOST, BLOCKS_WANTED = 64, 65_536, 20_000

#: Where a public tokenizer's ranks lie, and (fixed value) the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict = {}


def _encoder(path: str, pattern: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def token_counts(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens): the source unified (white space at its ends and letter case ignored); a null text has 0 tokens."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer, pattern).encode_ordinary
        for s in batches:
            yield pd.Series([len(encode(x)) if x else 0 for x in s], dtype="int64")

    return docs.select(F.col(id).alias("doc_id"), F.lower(strip(F.col(source))).alias("source"), F.pandas_udf(count, T.LongType())(F.col(text)).alias("tokens"))


def planned(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's sources: (source, name, share, max_repeats, tokens, total, shards, per_shard, blocks, weight, low, high), written once.

    blocks are the equal blocks that the source's documents make up, weight the slots that its share asks for, and low to high its
    stretch of the cumulative weights. The window over all sources sees one row each.
    """
    key = F.lower(strip(F.col("source")))
    rows = plan.where("source is not null and target_share > 0").groupBy(key.alias("source")).agg(F.min("source").alias("name"), F.max("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    sums = rows.join(counts.groupBy("source").agg(F.sum("tokens").alias("tokens")), "source", "left")
    sums = sums.selectExpr("source", "name", "share", "greatest(0, coalesce(max_repeats, 0)) as max_repeats", "coalesce(tokens, 0L) as tokens").selectExpr("*", "sum(tokens) over () as total")
    sums = sums.selectExpr("*", f"greatest(1L, cast(ceil(tokens / {SHARD_TOKENS}) as bigint)) as shards", f"least({BLOCK_MOST}, greatest({BLOCK_LEAST}, total div {BLOCKS_WANTED})) as size")
    sums = sums.selectExpr("*", "greatest(1L, cast(round(tokens / shards / size) as bigint)) as per_shard").selectExpr("*", "if(tokens > 0, shards * per_shard, 0L) as blocks")
    # a source's slots are as many as blocks of its own size make up its share
    sums = sums.selectExpr("*", f"share * total * if(tokens > 0, blocks / tokens, 1 / {BLOCK_LEAST}) as weight")
    sums = sums.selectExpr("*", "try_divide(coalesce(sum(weight) over (order by source rows between unbounded preceding and 1 preceding), 0D), sum(weight) over ()) as low")
    sums = sums.selectExpr("*", "coalesce(lead(low) over (order by source), 1D) as high")
    return written(sums.drop("size"), "shares")


def schedule(shares: DataFrame) -> DataFrame:
    """(slot, source, repetition, block): every slot with the block that fills it; block is null where the source is used up.

    Points meet the sources' stretches in a join on equal cells of the unit interval (about as many as there are sources).
    """
    spark = shares.sparkSession
    one = shares.agg(F.sum("weight").alias("slots"), F.count("*").alias("sources")).first()
    slots, cells = round(one.slots or 0), max(1, one.sources)
    point = (F.col("slot") + 1) * F.lit((math.sqrt(5) - 1) / 2)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point)).withColumn("cell", F.floor(F.col("u") * cells))
    stretches = shares.where("weight > 0").selectExpr("source", "low", "high", f"explode(sequence(floor(low * {cells}), floor(high * {cells}))) as cell")
    named = points.join(stretches, "cell").where("low <= u and u < high").select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), "source")
    sizes = named.groupBy("source", "chunk").count()
    before = sizes.selectExpr("source", "chunk", "coalesce(sum(count) over (partition by source order by chunk rows between unbounded preceding and 1 preceding), 0) as before")
    ranked = named.selectExpr("*", "row_number() over (partition by source, chunk order by slot) - 1 as place").join(before, ["source", "chunk"])
    rank = ranked.join(shares.select("source", "blocks", "max_repeats"), "source").withColumn("rank", F.col("before") + F.col("place"))
    used = "blocks > 0 and rank < blocks * max_repeats"
    return rank.selectExpr("slot", "source", f"case when {used} then cast(rank div blocks as int) end as repetition", f"case when {used} then rank % blocks end as block")


def blocks(counts: DataFrame, shares: DataFrame, seed: int = 0) -> DataFrame:
    """(source, block, doc_id, tokens): each document of a planned source with its block."""
    rows = counts.join(shares.select("source", "shards", "per_shard"), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "shards"))
    over = "over (partition by source, shard{0})"
    order = f" order by xxhash64({seed + 1}, doc_id), doc_id rows between unbounded preceding and 1 preceding"
    cut = rows.selectExpr("*", f"coalesce(sum(tokens) {over.format(order)}, 0) as before", f"sum(tokens) {over.format('')} as all")
    return cut.selectExpr("source", "shard * per_shard + least(per_shard - 1, case when all > 0 then cast(before * per_shard div all as bigint) else 0 end) as block", "doc_id", "tokens")


def mixed(docs: DataFrame, plan: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """The mix: (slot, source, doc_id, repetition, tokens), in the order of slot; sources as the plan spells them.

    Each source has its share of the tokens of all planned sources, as far as its tokens times max_repeats reach; no document
    is used more often than max_repeats. Documents of null or unplanned sources stay out, repeated texts count as they stand.
    Plan rows without a source or a positive share stay out; an empty table of documents gives an empty mix.
    """
    counts = written(token_counts(docs, **columns), "tokens")
    shares = planned(counts, plan)
    filled = schedule(shares).where("block is not null").join(shares.select("source", "name"), "source")
    return filled.join(blocks(counts, shares, seed), ["source", "block"]).select("slot", F.col("name").alias("source"), "doc_id", "repetition", "tokens")


def shortfalls(docs: DataFrame, plan: DataFrame, **columns: str) -> DataFrame:
    """(source, target_share, tokens, slots, empty_slots, misses) of the schedule: misses says whether the source falls short of
    its share even if all its documents are used max_repeats times.

    The schedule names the sources that may miss: those with empty slots, and those whose blocks are all used but for as many as a
    low-discrepancy sequence may be off (SLACK, and one block in 10,000 for the rounding of blocks). The exact sums decide them.
    Without any tokens none misses.
    """
    shares = planned(written(token_counts(docs, **columns), "tokens"), plan)
    slots = schedule(shares).groupBy("source").agg(F.count("*").alias("slots"), F.count_if(F.col("block").isNull()).alias("empty_slots"))
    rows = shares.join(slots, "source", "left").selectExpr("*", "coalesce(slots, 0L) as filled", f"coalesce(empty_slots, 0L) > 0 or blocks * max_repeats <= (coalesce(slots, 0L) + {SLACK}) * 1.0001 as near")
    return rows.selectExpr("name as source", "share as target_share", "tokens", "filled as slots", "coalesce(empty_slots, 0L) as empty_slots", "near and tokens * max_repeats < share * total as misses")


def actual_shares(docs: DataFrame, plan: DataFrame, seed: int = 0, **columns: str) -> DataFrame:
    """(source, target_share, documents, tokens, actual_share, most_repeats) of the mix, a row for each planned source."""
    used = mixed(docs, plan, seed, **columns)
    by_doc = used.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    sums = by_doc.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("n").alias("most_repeats"))
    targets = plan.where("source is not null and target_share > 0").select("source", "target_share")
    rows = targets.join(sums, "source", "left")
    return rows.selectExpr("source", "target_share", "coalesce(documents, 0) as documents", "coalesce(tokens, 0) as tokens", "coalesce(tokens, 0) / sum(tokens) over () as actual_share", "coalesce(most_repeats, 0) as most_repeats")
