"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end as a stream of words, which is cut into
blocks of equally many words; a source that gives more than it has is read a second time. The points k * phi mod 1
of the golden ratio, put through the cumulative shares of the sources, say whose block comes next;
ranking the slots of each source gives the block. So that every source is met often enough even where it holds one block
of a million, three times as many points as slots are drawn (a gap between M points is below 2 / M)
and each source keeps its first ones. The last block of a source is taken as far as its target goes. A document's slots
are the places of its blocks in the mix: in their order every stretch of the mix has the sources near their shares.

Blocks have BLOCK_WORDS words, and more where there would be over MAX_SLOTS of them (a mix of more than 4.3 thousand million words).
No source is brought into one task: streams, ranks and totals are summed over chunks first.

Defined results: a null text or one without words has size 0 and nothing is taken of it; a null
source is a source, last in order; sources without words have target 0; equal rows are told apart by their
place in the stream only; an empty table gives no rows; columns of the input keep their names and values, result columns
replace any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairline.llm.common import BROADCAST_ROWS, cut, spread_join
from pairline.operators.order import index_rows, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Words in a block at least; slots at most (blocks grow beyond that).
BLOCK_WORDS, MAX_SLOTS = 1024, 1 << 22
#: Rows that one task orders.
CHUNK = 2000
#: From one point of the sequence to the next.
GOLDEN = 0.6180339887498949


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Mix:
    """sources: one row each, with target; slots: the schedule; rows: one row for each document, with what is taken and where.

    rows: the id and the source, size, source_size, target, start (words of the source before it), taken, first_slot,
    n_slots and turns (turn, first slot and words of each time that it is read); place, chunk and number say which row it is.
    """

    sources: DataFrame
    slots: DataFrame
    rows: DataFrame
    chunks: int


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, size): weights in turn, capped targets reshared."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = index_rows(totals, F.col("source").asc_nulls_last(), name="place")
    turn = F.pmod(F.col("place"), F.lit(len(weights)))
    weight = F.coalesce(*[F.when(turn == k, float(w)) for k, w in enumerate(weights)])
    table = cut(placed.withColumn("weight", weight), "sources")
    full = F.col("source_size") * float(cap)
    wanted = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = 0.0, -1
    while True:
        over = F.col("weight") * rate > full
        n, held, rest = table.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not rest:
            break
        capped, rate = n, (wanted - held) / rest
    return table.withColumn("target", F.least(F.col("weight") * rate, full))


def _in_chunk():
    return Window.partitionBy("place", "chunk").orderBy("__hash", "size")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with size, the hash that shuffles, and the source as two columns that are never null."""
    text, source = F.col(text_col), F.col(source_col)
    mark = F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(text, F.lit(""))))
    return docs.withColumns({"size": size_of(text), "__hash": mark, "__none": source.isNull(), "__name": F.coalesce(source.cast("string"), F.lit(""))})


def _placed(rows: DataFrame, places: DataFrame, chunks: int) -> DataFrame:
    """rows with the number of their source and of their chunk of it, and their number in the chunk."""
    own = spread_join(rows, places, ["__none", "__name"], ["__hash"]).withColumn("chunk", F.pmod("__hash", F.lit(chunks)))
    return own.withColumn("number", F.row_number().over(_in_chunk()))


def schedule(sources: DataFrame, block: int, step: float = GOLDEN) -> DataFrame:
    """(slot, place, rank): slots numbered along the points k * step mod 1; each source has as many as its target needs."""
    size, goal = F.col("source_size"), F.col("goal")
    need = F.when(goal <= size, F.ceil(goal / block)).otherwise(F.ceil(size / block) + F.ceil((goal - size) / block))
    needs = cut(running_total(sources.withColumn("need", need.cast("long")), "place", "need", "low").select("place", "need", "low"), "needs")
    total, n = needs.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    width = max(1, total // (4 * max(1, n)))
    bins = needs.where("need > 0").select("place", "need", "low", F.explode(F.sequence(F.expr(f"low div {width}L"), F.expr(f"(low + need - 1) div {width}L"))).alias("bin"))
    k = F.col("id")
    far, near = F.shiftright(k, 20), k.bitwiseAND(F.lit((1 << 20) - 1))
    point = far * F.lit(float(Fraction(step) * (1 << 20) % 1)) + near * F.lit(step)
    point = point - F.floor(point)
    points = sources.sparkSession.range(3 * total).select(k.alias("slot"), F.least(F.floor(point * total), F.lit(total - 1)).alias("at")).withColumn("bin", F.expr(f"at div {width}L"))
    owned = points.join(_small(bins, 6 * n), "bin").where("at >= low and at < low + need").select("slot", "place", "need", F.expr(f"slot div {CHUNK * 4}L").alias("__part"))
    parts = owned.groupBy("place", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("place").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("place", "__part", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("place", "__part").orderBy("slot"))
    return owned.withColumn("__inside", inside).join(bases, ["place", "__part"]).select("slot", "place", (F.col("__base") + F.col("__inside") - 1).alias("rank"), "need").where("rank < need").drop("need")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 0, block_words: int = BLOCK_WORDS, max_slots: int = MAX_SLOTS, step: float = GOLDEN) -> Mix:
    """Plan the mix of all documents."""
    keyed = _keyed(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, seed)
    keys = cut(keyed.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), "__none", "__name", "size", "__hash"), "sizes")
    sources = cut(source_targets(keys.select(F.col("__source").alias("source"), "size"), weights, share, cap).withColumn("goal", F.round("target").cast("long")), "targets")
    words = sources.agg(F.coalesce(F.sum("goal"), F.lit(0))).first()[0]
    chunks = max(1, -(-keys.count() // CHUNK))
    block = max(block_words, -(-words // max_slots))
    places = sources.select(F.col("source").isNull().alias("__none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__name"), "place", "source_size", "target", "goal")

    inside = F.coalesce(F.sum("size").over(_in_chunk().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut(_placed(keys, places, chunks).withColumn("__inside", inside).drop("__none", "__name", "__hash"), "placed")
    sums = placed.groupBy("place", "chunk").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(sums.select("place", "chunk", F.coalesce(before, F.lit(0)).alias("__base")), "offsets")
    streams = spread_join(placed, offsets, ["place", "chunk"], ["number"]).withColumn("start", F.col("__base") + F.col("__inside")).drop("__base", "__inside")

    slots = cut(schedule(sources, block, step), "slots")
    passes = F.expr(f"(source_size + {block - 1}L) div {block}L")
    turns = spread_join(slots, sources.select("place", "source_size"), ["place"], ["slot"])
    turns = turns.select("slot", "place", F.floor(F.col("rank") / passes).cast("long").alias("turn"), F.pmod("rank", passes).alias("block"))
    pieces = streams.where("size > 0").select("place", "chunk", "number", "start", "size", "source_size", "goal", F.explode(F.expr(f"sequence(start div {block}L, (start + size - 1) div {block}L)")).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block) + F.col("turn") * F.col("source_size")
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) + F.col("turn") * F.col("source_size")
    met = pieces.join(turns, ["place", "block"]).withColumn("words", F.least(high, F.col("goal")) - low).where("words > 0")
    each = met.groupBy("place", "chunk", "number", "turn").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"), F.count("*").alias("n"))
    whole = each.groupBy("place", "chunk", "number").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sum("n").alias("n_slots"), F.array_sort(F.collect_list(F.struct("turn", "slot", "words"))).alias("turns"))
    rows = streams.join(whole, ["place", "chunk", "number"], "left")
    zero = F.lit(0).cast("long")
    out = [F.col("__id").alias(id_col), F.col("__source").alias(source_col), "size", "source_size", "target", "start", F.coalesce("taken", zero).alias("taken"), "first_slot", F.coalesce("n_slots", zero).alias("n_slots"), "turns", "place", "chunk", "number"]
    return Mix(sources, slots, rows.select(*out), chunks)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, slot_col: str | None = None, **options) -> DataFrame:
    """The documents of the mix in the order of their slots, with the columns of docs: one row for each time a document is taken, always with its whole text.

    A document is taken as often as half of its words or more are, so that a source is off its target by half a document at most.
    slot_col adds the slot of its first block; without it the order of the rows (of the files, once written) is that of the schedule.
    """
    plan = mix(docs, id_col, text_col, source_col, seed=seed, **options)
    rows = cut(plan.rows, "plan")
    slots = F.transform(F.filter("turns", lambda t: 2 * t["words"] >= F.col("size")), lambda t: t["slot"])
    few = rows.select("place", "chunk", "number", F.coalesce(slots, F.expr("cast(array() as array<bigint>)")).alias("slots"))
    # chunks hold about CHUNK rows of a source, numbered alike on both sides
    held = few.groupBy("place", "chunk").agg(F.array_sort(F.collect_list(F.struct("number", "slots"))).alias("__plan"))
    places = plan.sources.select(F.col("source").isNull().alias("__none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__name"), "place")
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(id_col), F.col(text_col), F.col(source_col))
    own = _placed(_keyed(packed, id_col, text_col, source_col, seed).drop(id_col, text_col, source_col), places, plan.chunks).join(held, ["place", "chunk"])
    each = own.select("__row", F.explode(F.element_at("__plan", F.col("number"))["slots"]).alias("__slot")).orderBy("__slot", F.xxhash64(F.col(f"__row.{id_col}")))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c != slot_col]
    return each.select(*kept, *([F.col("__slot").alias(slot_col)] if slot_col else []))
