"""Mixing sources to target weights: fixed-length blocks, multinomial source counts per output shard, permuted block indices.

The words of a source form one stream, document after document in a fixed order, cut into blocks of ``block_words`` words (shorter for a
source that would have fewer than ``min_blocks`` blocks; a source's last block may be short). The output is a sequence of shards of
``shard_slots`` slots. A draw for every slot gives each shard multinomial source counts; where a source's draws exceed its quota, the slots over
it go to the sources still short, so every source ends at its quota. A source's k-th slot takes block ``perm(k mod n)`` of pass ``k div n``, where
perm is a pseudorandom permutation of its n block indices, another in each pass; slots meet blocks by an equality join on the index.

Targets: sources in code point order (null last) weigh ``weights``, repeating, and share all words; no target exceeds ``max_epochs`` times its
source, and the excess is shared by weight among the others.

No step sees a whole source: positions are running sums inside hash buckets plus bucket offsets, and the rest is keyed by block or document.
Tables of one row per source are small by nature, but are joined, never collected or forced into a broadcast.

Defined cases: a null source is a source of its own; null, empty or blank texts have size 0 and are never taken; repeated rows and repeated or
null ids are rows of their own, ordered by text hash; an empty table mixes to nothing. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carnet.llm.common import WORD, bounded
from carnet.session import cut_lineage

ROUNDS = 12
CELLS = 4096


@dataclass(frozen=True)
class Plan:
    """Parameters of a mix."""

    weights: Sequence[float] = (5.0, 2.0, 1.0)
    max_epochs: int = 3
    block_words: int = 64
    min_blocks: int = 64
    shard_slots: int = 4096
    seed: int = 17
    bucket_docs: int = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, plan: Plan) -> DataFrame:
    """Per source (``owner``, ``source_size``): weight, target, block length, number of blocks and quota of slots. The level at which the
    targets settle has a closed form: with sources ordered by capacity per weight, those below the level are full."""
    ranked = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("owner.source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), (F.col("nth") % len(plan.weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(plan.max_epochs))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    full = F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy())
    # If the sources before this one are full, the level would be this; it holds for the first source it does not fill.
    level = (total - F.coalesce(full, F.lit(0.0))) / rest
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    block = F.greatest(F.lit(1), F.least(F.lit(plan.block_words), F.floor(F.col("source_size") / plan.min_blocks))).cast("long")
    out = ranked.withColumn("target", target).withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.least(F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1))).cast("long"), F.col("blocks") * plan.max_epochs)
    return out.select("owner", "source_size", "weight", "target", "block", "blocks", slots.alias("slots"))


def with_starts(docs: DataFrame, plan: Plan, n_docs: int) -> DataFrame:
    """Documents with the position of their first word in the stream of their source (``owner``)."""
    buckets = max(1, -(-n_docs // plan.bucket_docs))
    keyed = docs.withColumn("bucket", F.pmod(F.xxhash64(F.lit(plan.seed), "doc_id", "text_hash"), F.lit(buckets)))
    inside = F.sum("size").over(W.partitionBy("owner", "bucket").orderBy("doc_id", "text_hash").rowsBetween(W.unboundedPreceding, -1))
    totals = keyed.groupBy("owner", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(W.partitionBy("owner").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("owner", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = keyed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["owner", "bucket"])
    return placed.withColumn("start", F.col("inside") + F.col("offset")).drop("bucket", "inside", "offset")


def permuted(k: Column, n: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1 at k, for any n: in each round an index and its mirror image around a round key swap or stay,
    by a bit drawn for the pair."""
    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(*seed, r) - x, n)
        return F.when(F.xxhash64(*seed, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1).cast("long")) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, turn)


def drawn_slots(sources: DataFrame, plan: Plan) -> DataFrame:
    """All slots of the output: shard, slot, owner and the owner's running number ``k`` of the slot, from 0 to its quota."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    # Each source owns a range of [0, total) as long as its quota; a uniform draw in it picks the source.
    upto = F.sum("slots").over(W.orderBy("owner"))
    ranges = cut_lineage(sources.where("slots > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("slots")).select("owner", "slots", "lo", "hi", "block", "blocks"))
    width = max(1, -(-total // CELLS))
    cells = bounded(cut_lineage(ranges.select("owner", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))))
    grid = spark.range(0, total, 1, max(1, min(-(-total // 100_000), 50_000)))
    grid = grid.select(F.floor(F.col("id") / plan.shard_slots).alias("shard"), (F.col("id") % plan.shard_slots).alias("slot"), F.pmod(F.xxhash64(F.lit(plan.seed), "id"), F.lit(max(1, total))).alias("u"))
    drawn = grid.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= lo AND u < hi").select("shard", "slot", "owner")
    # Number of a slot among its source's draws: its place inside the shard, plus the counts of the shards before.
    counts = drawn.groupBy("owner", "shard").agg(F.count("*").alias("n"))
    running = F.sum("n").over(W.partitionBy("owner").orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("owner", "shard", F.coalesce(running, F.lit(0)).alias("base"))
    local = F.row_number().over(W.partitionBy("owner", "shard").orderBy("slot")) - 1
    numbered = drawn.withColumn("local", local).join(counts, ["owner", "shard"]).select("shard", "slot", "owner", (F.col("base") + F.col("local")).alias("k"))
    quota = ranges.select("owner", "slots", "block", "blocks")
    numbered = cut_lineage(numbered.join(bounded(quota), "owner"))
    within = numbered.where("k < slots")
    # Slots over a quota, in order of shard, are given to the sources that fell short, in order of source.
    spare = numbered.where("k >= slots").select("shard", "slot")
    per_shard = spare.groupBy("shard").agg(F.count("*").alias("n"))
    per_shard = per_shard.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    spare = spare.withColumn("local", F.row_number().over(W.partitionBy("shard").orderBy("slot")) - 1).join(per_shard, "shard").select("shard", "slot", (F.col("base") + F.col("local")).alias("turn"))
    got = within.groupBy("owner").agg(F.count("*").alias("got"))
    short = quota.join(got, "owner", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    short = short.withColumn("end", F.sum(F.col("slots") - F.col("got")).over(W.orderBy("owner"))).withColumn("begin", F.col("end") - (F.col("slots") - F.col("got")))
    step = 1024
    wanted = short.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / step), F.floor((F.col("end") - 1) / step))))
    given = spare.withColumn("cell", F.floor(F.col("turn") / step)).join(wanted, "cell").where("turn >= begin AND turn < end")
    given = given.select("shard", "slot", "owner", (F.col("got") + F.col("turn") - F.col("begin")).alias("k"), "slots", "block", "blocks")
    return within.select(given.columns).unionByName(given)


def slot_blocks(slots: DataFrame, plan: Plan) -> DataFrame:
    """Slots with the block they take: ``owner``, ``pass``, ``index``."""
    passed = F.floor(F.col("k") / F.col("blocks"))
    index = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.lit(plan.seed), F.col("owner.source"), passed)
    return slots.select("shard", "slot", "owner", passed.alias("pass"), index.alias("index"))


@dataclass
class Mix:
    """What a mix is made of: documents with sizes, targets and starts; slots with their blocks."""

    docs: DataFrame
    slots: DataFrame

    def pieces(self) -> DataFrame:
        """Overlaps of documents and blocks: owner, start of the document, index, number of words."""
        start, end, block = F.col("start"), F.col("start") + F.col("size"), F.col("block")
        numbers = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
        parts = self.docs.where("size > 0").select("owner", "start", "size", "block", F.explode(numbers).alias("index"))
        return parts.select("owner", "start", "index", (F.least(end, (F.col("index") + 1) * block) - F.greatest(start, F.col("index") * block)).alias("words"))

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target and the words taken of it, repeats counted."""
        times = self.slots.groupBy("owner", "index").agg(F.count("*").alias("times"))
        used = self.pieces().join(times, ["owner", "index"]).groupBy("owner", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        docs = self.docs.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
        joined = docs.join(used.select(F.col("owner"), F.col("start").alias("at"), "taken"), ["owner", "at"], "left")
        return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The mix itself: one row per slot with source, pass, block index, the block's words, single-spaced, and the ids of its documents."""
        # Through an array of one, the words of a text are cut out once, not once per block.
        words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
        start, end, block = F.col("start"), F.col("start") + F.col("size"), F.col("block")

        def pieces(w: Column) -> Column:
            def piece(i: Column) -> Column:
                lo = F.greatest(start, i * block)
                return F.struct(i.alias("index"), F.array_join(F.slice(w, (lo - start + 1).cast("int"), (F.least(end, (i + 1) * block) - lo).cast("int")), " ").alias("piece"))

            return F.transform(F.sequence(F.floor(start / block), F.floor((end - 1) / block)), piece)

        cut = self.docs.where("size > 0").select("doc_id", "owner", "start", F.explode(F.transform(words, pieces)[0]).alias("p")).select("doc_id", "owner", "start", "p.*")
        blocks = cut.groupBy("owner", "index").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "doc_id"))).alias("parts"))
        blocks = blocks.select("owner", "index", F.array_join(F.col("parts.piece"), " ").alias("text"), F.col("parts.doc_id").alias("doc_ids"))
        return self.slots.join(blocks, ["owner", "index"]).select("shard", "slot", F.col("owner.source").alias("source"), F.col("pass"), F.col("index").alias("block"), "text", "doc_ids")


def mix(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text", source: str = "source", with_text: bool = True) -> Mix:
    """Mix the documents. ``with_text=False`` keeps the texts out, for counts only."""
    owner = F.struct(F.col(source).cast("string").alias("source"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), owner.alias("owner"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"), *([F.col(text).alias("text")] if with_text else []))
    rows = rows if with_text else cut_lineage(rows)
    sizes = cut_lineage(rows.groupBy("owner").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    n_docs = sizes.agg(F.sum("n")).first()[0] or 0
    sources = cut_lineage(source_targets(sizes, plan))
    placed = with_starts(rows, plan, n_docs).join(bounded(sources.select("owner", "source_size", "target", "block")), "owner").drop("text_hash")
    return Mix(placed if with_text else cut_lineage(placed), cut_lineage(slot_blocks(drawn_slots(sources, plan), plan)))
