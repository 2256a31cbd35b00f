"""MinHash near-deduplication of whole texts by 5-word shingles.

1. Each text becomes the set of its shingles as 64-bit hashes; 128 universal hash minima of the set
   give 32 bands of 4 and a sketch of 256 bits. Texts with one set are one node from here on.
2. Nodes that share a band are candidates. In each of a few turns a hub is drawn for every band, and of the pairs of
   its members with hubs of other components that sketch and set sizes allow, each component confirms
   the likeliest on the full sets; alternating large-star and small-star joins the components.
3. Only pairs of a band whose nodes are still in different components are left. All of them are tried, in the
   join that meets them: by sketch, by sizes and by their sets in 32 bits, which never understate what
   two sets have in common; what is left is confirmed on the full sets, and components are taken again. So no link
   between different texts is lost, and a large group of copies is never paired within itself.

A pair at exactly 0.75 misses all bands with probability 5e-6, and the sketch bound with 3e-6.

Defined results: a text is lower-cased (A-Z) and split at blanks and controls \\x09-\\x0D; with fewer
words than a shingle has, the whole sequence is its one shingle; a null text or one without
words has no shingle, links with nothing and stays; rows of one id with different texts are
different documents; a null id never is a group's smallest id, unless all are null; ties
cannot occur, as components are named by their smallest id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairline.llm.common import cut, small_batches, spread_join
from pairline.llm.components import connected_components

SHINGLE, PERCENT = 5, 75
HASHES, BAND_ROWS = 128, 4
BANDS = HASHES // BAND_ROWS
#: Bits of 256 in which the sketches of a pair may differ: 32 are expected at 0.75, with a deviation of 6.3.
SKETCH_BITS = 60
#: Nodes of a band that one task compares with as many others.
BLOCK = 4096
#: Turns of single trial pairs for each component before all pairs that are left are tried.
TURNS = 2
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_BAND = _RNG.integers(1, 1 << 62, (BANDS, BAND_ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that sums of products are spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.translate(LOWER_BYTES).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(k, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        out = out * _MULTIPLIER + hashes[j : len(words) - size + 1 + j]
    return np.unique(_mix(out))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over the set."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024] * _A + _B).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = (low.reshape(BANDS, BAND_ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64)
    return _mix(keys + np.arange(BANDS, dtype=np.uint64) * _MULTIPLIER).view(np.int64)


def sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, as four 64-bit words."""
    mixed = low * np.uint32(0x85EBCA6B)
    bits = np.concatenate([mixed >> np.uint32(31), mixed >> np.uint32(30) & np.uint32(1)]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


PRINTS = "node long, n_shingles long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key) of each row with its node, set size, bands and sketch; node is null without words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands, sketches = [], [], [], []
            for body in batch.column(2):
                own = shingle_set(body.as_py())
                sizes.append(len(own))
                if not len(own):
                    nodes.append(None)
                    bands.append(None)
                    sketches.append((None,) * 4)
                    continue
                low = minima(own)
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63))
                bands.append(band_keys(low))
                sketches.append(tuple(sketch(low).tolist()))
            arrays = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            arrays += [pa.array([s[i] for s in sketches], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "node", "n_shingles", "bands", "s0", "s1", "s2", "s3"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, {PRINTS}")


SKETCHED = ("n_shingles", "s0", "s1", "s2", "s3")


def _likely(a: str, b: str) -> Column:
    """Set sizes and sketches allow the similarity; a and b come before the columns' names."""
    n, m = F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (_apart(a, b) <= SKETCH_BITS)


def _similar(pairs: DataFrame) -> DataFrame:
    """Of (a, b, text_a, text_b) the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            for one, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if other not in known:  # the rows of one partner come together
                    known = {other: shingle_set(other)}
                x, y = shingle_set(one), known[other]
                met = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * met >= PERCENT * (len(x) + len(y) - met))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _texts(wanted: DataFrame, prints: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """(node, body): one text for each wanted node; copies of a text are one before anything is joined."""
    keys = prints.where("node is not null").groupBy("node").agg(F.min("text_key").alias("text_key")).join(wanted, "node", "left_semi")
    body = docs.select(F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("binary").alias("body")).groupBy("text_key").agg(F.first("body").alias("body"))
    return keys.join(body, "text_key").select("node", "body")


def _short_sets(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, short): the shingle sets of placed nodes in 32 bits, to rule out pairs inside the join that meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_set(body.as_py()) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for body in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "short"])

    return texts.join(placed.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node long, short array<int>")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of nodes (a, b) whose full shingle sets have the similarity; texts: (node, body).

    A node of very many pairs is no one task's: nothing after the joins needs their keys together, so that Spark splits skewed ones.
    """
    left = texts.select(F.col("node").alias("a"), F.col("body").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("text_b"))
    return _similar(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"))


def _apart(a: str, b: str) -> Column:
    """Differing bits of two sketches."""
    bits = [F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(4)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def _star_pairs(placed: DataFrame, near: DataFrame, parts: DataFrame | None, turn: int) -> DataFrame:
    """For each component its likeliest pair (a, b) with the hub of a band.

    A band's hub is drawn anew in each turn, from its largest component, so that large components
    meet each other; there are at most as many pairs as components.
    """
    sized = placed.join(near.select("node", *SKETCHED), "node")
    if parts is None:
        sized = sized.withColumn("members", F.lit(1).cast("long"))
    else:
        sizes = cut(parts.groupBy("component").agg(F.count("*").alias("size")), "sizes")
        sized = spread_join(sized, sizes, ["component"], ["node"], "left").withColumn("members", F.coalesce("size", F.lit(1))).drop("size")
    order = F.struct("members", "component", F.xxhash64("node", F.lit(turn)))
    hub = F.max_by(F.struct(F.col("node").alias("hub"), F.col("component").alias("home"), *[F.col(c).alias(f"b_{c}") for c in SKETCHED]), order)
    hubs = cut(sized.groupBy("band").agg(hub.alias("hub")).select("band", "hub.*"), "hubs")
    own = sized.select("node", "band", "component", *[F.col(c).alias(f"a_{c}") for c in SKETCHED])
    met = spread_join(own, hubs, ["band"], ["node"]).where((F.col("component") != F.col("home")) & _likely("a_", "b_"))
    order = F.struct("apart", "node", "hub")
    rated = met.select("node", "hub", "component", _apart("a_", "b_").alias("apart"))
    return rated.groupBy("component").agg(F.min_by("node", order).alias("a"), F.min_by("hub", order).alias("b")).select("a", "b").distinct()


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, band, component) of the bands whose nodes are in different components."""
    named = cut(members.join(parts, "node", "left").select("node", "band", F.coalesce("component", "node").alias("component")), "named")
    mixed = named.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    return spread_join(named, cut(mixed, "mixed"), ["band"], ["node"], "left_semi")


def _left_pairs(placed: DataFrame, near: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b, ca, cb): the pairs of a band in different components that sketches, sizes and short sets allow.

    The nodes of a band are dealt into blocks of about BLOCK, and each two blocks meet in a task of their own.
    """
    large = cut(placed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "large")
    left = spread_join(placed, large, ["band"], ["node"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    left = left.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    left = left.join(near, "node").join(short, "node").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["node", "component", "bands", "short", *SKETCHED]
    a = left.select("band", F.col("own").alias("p"), F.col("met").alias("q"), *[F.col(c).alias(f"a_{c}") for c in names])
    b = left.select("band", F.col("met").alias("p"), F.col("own").alias("q"), *[F.col(c).alias(f"b_{c}") for c in names])
    once = F.get(F.array_intersect("a_bands", "b_bands"), F.lit(0)) == a.band  # a pair is met once, whatever bands it shares
    common = F.size(F.array_intersect("a_short", "b_short")) + F.col("a_n_shingles") - F.size("a_short")  # at least what the full sets have in common
    enough = 100 * common >= PERCENT * (F.col("a_n_shingles") + F.col("b_n_shingles") - common)
    at = (a.band == b.band) & (a.p == b.p) & (a.q == b.q)
    rest = a.join(b, at & (F.col("a_component") < F.col("b_component")) & _likely("a_", "b_") & once & enough)
    return rest.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), F.col("a_component").alias("ca"), F.col("b_component").alias("cb"))


def _one_each(rest: DataFrame) -> DataFrame:
    """Of pairs (a, b, ca, cb) one for each component."""
    order = F.struct("a", "b")
    each = [rest.groupBy(c).agg(F.min_by("a", order).alias("a"), F.min_by("b", order).alias("b")).select("a", "b") for c in ("ca", "cb")]
    return each[0].union(each[1]).distinct()


def _still_apart(rest: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with these."""
    at = rest.select("a", "b")
    for end, name in (("a", "ca"), ("b", "cb")):
        at = at.join(parts.select(F.col("node").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    return at.where("ca != cb").select("a", "b", "ca", "cb")


def _tree(parts: DataFrame) -> DataFrame:
    return parts.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of each document; kept: doc_id = component_id."""
    small_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col), "prints")
    nodes = prints.where("node is not null")
    facts = [F.first(c).alias(c) for c in ("bands", *SKETCHED)]
    unique = cut(nodes.groupBy("node").agg(*facts, F.min("doc_id").alias("least")), "nodes")  # copies are one node from here on
    bands = unique.select("node", F.explode("bands").alias("band"))
    shared = cut(bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band"), "shared")
    members = cut(bands.join(shared, "band", "left_semi"), "members")  # nothing after it needs a band together: Spark splits a skewed one
    near = cut(unique.drop("least").join(members.select("node").distinct(), "node", "left_semi"), "near")
    texts = cut(_texts(near.select("node"), prints, docs, text_col), "texts")

    placed = members.withColumn("component", F.col("node"))
    parts = None
    for turn in range(TURNS):
        pairs = cut(_star_pairs(placed, near, parts, turn), "pairs")
        links = cut(confirm(pairs, texts), "links")
        if links.isEmpty():
            break
        parts = cut(connected_components(links if parts is None else _tree(parts).union(links)), "parts")
        placed = cut(_placed(members, parts), "placed")
    if parts is None:
        parts = cut(members.limit(0).select("node", F.col("node").alias("component")), "parts")

    rest = cut(_left_pairs(placed, near, _short_sets(texts, placed)), "rest")
    for turn in range(TURNS + 1):
        if rest.isEmpty():
            break
        pairs = rest.select("a", "b") if turn == TURNS else cut(_one_each(rest), "pairs")
        parts = cut(connected_components(_tree(parts).union(confirm(pairs, texts))), "parts")
        if turn < TURNS:
            rest = cut(_still_apart(rest.join(pairs, ["a", "b"], "left_anti"), parts), "rest")

    joined = cut(parts.join(unique.select("node", "least"), "node"), "joined")
    named = cut(joined.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    labels = unique.select("node", "least").join(spread_join(joined, named, ["component"], ["node"]).select("node", "component_id"), "node", "left")
    labels = labels.select("node", F.coalesce("component_id", "least").alias("component_id"))
    linked = spread_join(nodes, labels, ["node"], ["doc_id", "text_key"], counted=False).select("doc_id", "text_key", "n_shingles", "component_id")
    alone = prints.where("node is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with the columns of docs; of rows with equal id and text one stays, if they have words."""
    groups = near_duplicates(docs, id_col, text_col).where("kept")
    keep = groups.where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.min("text_key").alias("text_key"), F.count("*").alias("rows"))
    keep = cut(keep.select("doc_id", "text_key", "rows").union(groups.where("n_shingles = 0").select("doc_id", "text_key", F.lit(1).cast("long"))).distinct(), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    held = rows.join(keep, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
    kept = [F.col("row")[c].alias(c) for c in docs.columns]
    if keep.where("rows > 1").isEmpty():
        return held.select(*kept)
    repeated = held.where("rows > 1").dropDuplicates(["id", "key"])
    return held.where("rows = 1").select(*kept).union(repeated.select(*kept))
