"""Near-duplicate documents: MinHash bands give candidates, odd sketches sift them, full
shingle sets decide."""

from __future__ import annotations

from dataclasses import dataclass
from math import exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WordHashes, ascii_words, in_batches, list_column, mixed, pick, signed, slices, weights, window_hashes
from .components import components


@dataclass(frozen=True)
class NearDup:
    """``bands`` * ``rows`` MinHash samples. Two sets at the default threshold of 0.85 share no band
    with probability (1 - 0.85**6)**32 = 3e-7. The odd sketch has ``bits`` bits; pairs whose
    estimate is under ``sift`` are dropped, about six standard deviations below 0.85.
    In each bucket all members are compared with one hub, in up to ``hubs`` rounds. Members
    that are then outside the bucket's largest component are compared with all members
    where that is at most ``direct`` comparisons, and elsewhere with those that share enough
    of their differences from the hub, which loses no link."""

    words: int = 5
    percent: int = 85
    bands: int = 32
    rows: int = 6
    bits: int = 512
    sift: float = 0.65
    hubs: int = 3
    direct: int = 1024

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def max_differing_bits(self) -> int:
        half = self.bits / 2
        return int(half * (1 - exp(-4 * self.samples / self.bits * (1 - self.sift))))


def minima(shingles: np.ndarray, by: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The smallest image of the set under each hash function, in blocks of the set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, (by[:, None] * short[None, at:at + 1024] + plus[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap: each sample flips the bit its number and value hash to."""
    where = mixed((np.arange(len(low), dtype=np.uint64) << np.uint64(32)) + low) % np.uint64(bits)
    parity = np.bincount(where.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, bands, sketch) of (doc_id, text). k1 and k2 are 128 bits
    over the whole word sequence: equal for equal texts only."""
    def run(batches):
        cache = WordHashes()
        by = (weights(p.samples, 1) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
        plus = (weights(p.samples, 2) >> np.uint64(17)).astype(np.uint32)
        per_band = weights(p.rows, 3)
        number = weights(p.bands, 4)
        for batch in slices(batches, "text"):
            key1, key2, counts, bands, sketches = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                words = ascii_words(text)
                words = b" ".join(words).lower().split()
                digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                key1.append(digest >> 64)
                key2.append(digest & 0xFFFFFFFFFFFFFFFF)
                shingles = np.unique(window_hashes(cache.array(words), p.words))
                counts.append(len(shingles))
                if len(shingles):
                    low = minima(shingles, by, plus)
                    grid = low.reshape(p.bands, p.rows).astype(np.uint64) * per_band
                    bands.append(signed(mixed(grid.sum(axis=1, dtype=np.uint64) + number)))
                    sketches.append(odd_sketch(low, p.bits))
                else:
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(signed(np.array(key1, np.uint64))), pa.array(signed(np.array(key2, np.uint64))),
                 pa.array(counts, pa.int64()), list_column(bands), list_column(sketches)],
                names=["doc_id", "k1", "k2", "n_shingles", "bands", "sketch"])

    return in_batches(docs, run, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text): the full set of 64-bit shingle hashes."""
    def run(batches):
        cache = WordHashes()
        for batch in slices(batches, "text"):
            sets = []
            for text in batch.column("text").to_pylist():
                tokens = b" ".join(ascii_words(text)).lower().split()
                sets.append(signed(np.unique(window_hashes(cache.array(tokens), words))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), list_column(sets)], names=["node", "shingles"])

    return in_batches(docs, run, "node long, shingles array<long>")


def sifted(pairs: DataFrame, sketches: DataFrame, p: NearDup) -> DataFrame:
    """Pairs (a, b) whose set sizes and odd sketches allow the threshold."""
    one = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    two = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sized = pairs.join(one, "b").join(two, "a").where(
        100 * F.least("na", "nb") >= p.percent * F.greatest("na", "nb"))
    differing = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return sized.where(differing <= p.max_differing_bits).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """Pairs that hold on the full sets."""
    one = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(one, "b").join(two, "a").where(100 * both >= p.percent * either).select("a", "b")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after the links (a, b): only roots that a link joins change."""
    a = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = components(links.join(a, "a").join(b, "b").where("ra <> rb").select("ra", "rb"), "ra", "rb")
    moved = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return cut_lineage(labels.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")


def open_buckets(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, order, root, main, work): the members of buckets of ``keys`` with several
    components. ``main`` is the component most members are in; ``work`` is the number of the
    others times the number of members."""
    placed = keys.join(labels, "node")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"))
    sized = parts.groupBy("key").agg(F.max_by("root", "n").alias("main"), (F.sum("n") * (F.sum("n") - F.max("n"))).alias("work"))
    return cut_lineage(placed.join(sized.where("work > 0"), "key"), "open")


def direct_pairs(members: DataFrame, sizes: DataFrame, p: NearDup) -> DataFrame:
    """(a, b): the members outside their bucket's main component with all other members of
    other components that are of a fitting size."""
    near = members.join(sizes, "node")
    others = near.where("root <> main").select("key", F.col("node").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("other_n"))
    fit = (F.col("root") != F.col("other_root")) & (100 * F.least("n", "other_n") >= p.percent * F.greatest("n", "other_n"))
    return near.join(others, "key").where(fit).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def differing_pairs(members: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """As ``direct_pairs``, but only pairs that share a telling difference from their hub.

    Let x lack A and add B to the hub's set of size h, and y likewise. With t the threshold
    over one plus the threshold, J(x, y) is at the threshold only if x and y share at least
    need = c(x) + c(y) - (1 - 2t) h of their differences, where c = (1 - t) |A| + t |B|. So, with
    differences in one order, rarest first, the first |A| + |B| - need + 1 of x and of y have
    one in common (prefix filter), and from the first such one on enough are left in both
    (position filter). Members are laid out by layers of c, powers of two, and a member has
    a prefix for each layer a partner can be in, so one close copy widens no other prefix. The hub
    itself has been compared with all of them.
    """
    t = p.percent / (100 + p.percent)
    hubs = members.groupBy("key").agg(F.min_by("node", "order").alias("hub"))
    grouped = members.join(hubs, "key").where("node <> hub").groupBy("hub", "node", "root").agg(
        F.max((F.col("root") != F.col("main")).cast("int")).alias("outside"))
    own = sets.select("node", F.col("shingles").alias("x"))
    base = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h"))
    lacks, adds = F.array_except("h", "x"), F.array_except("x", "h")
    made = grouped.join(own, "node").join(base, "hub").select(
        "hub", "node", "root", "outside", F.concat(lacks, adds).alias("tokens"),
        ((1 - t) * F.size(lacks) + t * F.size(adds)).alias("c"), ((1 - 2 * t) * F.size("h")).alias("spare"))
    layer = F.when(F.col("c") < 2, 0).otherwise(F.floor(F.log2("c"))).cast("int")
    made = cut_lineage(made.withColumn("layer", layer), "differences")
    layers = made.groupBy("hub").agg(F.collect_set("layer").alias("any"), F.collect_set(F.when(F.col("outside") == 1, F.col("layer"))).alias("out"))
    each = made.select("hub", "node", "root", F.explode("tokens").alias("token"))
    # Only differences that members of several components share can join two of them. The others
    # come first in the order and are counted, not listed.
    shared = each.groupBy("hub", "token").agg(F.count("*").alias("times"), F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low <> high").select("hub", "token", "times")
    ranked = each.join(shared, ["hub", "token"]).groupBy("hub", "node").agg(
        F.array_sort(F.collect_list(F.struct("times", "token"))).alias("ranked"))
    full = cut_lineage(made.withColumn("size", F.size("tokens")).drop("tokens").join(ranked, ["hub", "node"]).join(layers, "hub"), "ranked")

    def prefixes(rows: DataFrame, partners: str, mine: str, theirs: str) -> DataFrame:
        """(hub, token, layer of x, layer of y, node, root, c, size, place) of the prefixes."""
        least = F.when(F.col("partner") == 0, 0.0).otherwise(F.pow(F.lit(2.0), F.col("partner")))
        need = F.greatest(F.ceil(F.col("c") + least - F.col("spare") - 1e-6), F.lit(1)).cast("int")
        first = F.col("size") - F.size("ranked")
        cut = F.slice("ranked", F.lit(1), F.greatest(F.size("ranked") - need + 1, F.lit(0)))
        each = rows.select("*", F.explode(partners).alias("partner")).select(
            "hub", "node", "root", "c", "spare", "layer", "partner", "size", first.alias("first"), F.posexplode(cut).alias("place", "t"))
        return each.select(
            "hub", F.col("t.token").alias("token"), F.col("layer").alias(mine), F.col("partner").alias(theirs), "node", "root", "c", "spare", "size", (F.col("first") + F.col("place")).alias("place"))

    left = prefixes(full.where("outside = 1"), "any", "lx", "ly")
    right = prefixes(full.where(F.size("out") > 0), "out", "ly", "lx").select(
        "hub", "token", "lx", "ly", *[F.col(c).alias(f"{c}_y") for c in ("node", "root", "c", "size", "place")])
    need = F.col("c") + F.col("c_y") - F.col("spare") - 1e-6
    able = (F.least(F.col("size") - F.col("place"), F.col("size_y") - F.col("place_y")) >= need) & (F.col("root") != F.col("root_y"))
    return left.join(right, ["hub", "token", "lx", "ly"]).where(able).select(
        F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()


def grouped(keys: DataFrame, labels: DataFrame, sketches: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """``labels`` (node, root) after all links between members of the buckets of ``keys``
    (key, node, order) that matter for the components.

    1. Each bucket compares its members with one hub, the member that most others share
       bands with, then with other hubs while that joins components.
    2. Buckets within one component are done.
    3. Two members of different components cannot both be in the bucket's main component.
       The others are compared with all members in small buckets, and in large ones with
       the members that share enough of their differences from the hub.
    """
    members = open_buckets(keys, labels)
    for turn in range(p.hubs):
        order = F.col("order") if turn == 0 else F.xxhash64("node", F.lit(turn))
        hubs = members.groupBy("key").agg(F.min_by("node", order).alias("hub"), F.min_by("root", order).alias("hub_root"))
        pairs = members.select("key", "node", "root").join(hubs, "key").where("root <> hub_root").select(
            F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
        links = cut_lineage(confirmed(sifted(pairs, sketches, p), sets, p), "links")
        if links.isEmpty():
            break
        labels = merged(labels, links)
        members = open_buckets(keys, labels)
    light, heavy = members.where(F.col("work") <= p.direct), members.where(F.col("work") > p.direct)
    pairs = direct_pairs(light, sketches.select("node", "n"), p)
    if not heavy.isEmpty():
        pairs = pairs.union(differing_pairs(heavy, sets, p)).distinct()
    links = cut_lineage(confirmed(sifted(pairs, sketches, p), sets, p), "links")
    return labels if links.isEmpty() else merged(labels, links)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: NearDup = NearDup()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    distinct word shingles (words cut at ASCII white space, A-Z lowered). component_id is
    the smallest doc_id reachable over links, kept says that the row is that document.

    Documents with the same word sequence are one node, so groups of copies of any size cost
    one node and no pairs. Null or empty texts have an empty set and are linked with
    nothing. Fewer words than a shingle: the whole sequence is the one shingle. Rows with a
    null doc_id are linked with nothing, have a null component and are kept. Several rows
    with one doc_id are one document, linked when any of its texts is; equal repeated rows
    are all kept or all not. Other columns are ignored. An empty table gives an empty result.
    """
    p = params
    base = pick(docs, doc_id=doc_id, text=text)
    made = cut_lineage(signatures(base, p), "signatures")
    usable = made.where("doc_id is not null and n_shingles > 0")
    nodes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    owners = cut_lineage(usable.select("doc_id", "k1", "k2", "n_shingles").join(nodes, ["k1", "k2"]), "owners")
    heads = owners.where("doc_id = node").select("doc_id", "k1", "k2").distinct()
    features = usable.join(heads, ["doc_id", "k1", "k2"], "left_semi").select(
        F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bands", "sketch").distinct()
    exploded = features.select("node", F.explode("bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = cut_lineage(exploded.join(shared, "key"), "keys")
    # The more members a node shares buckets with, the sooner it is a hub; ties by a hash.
    members = met.groupBy("node").agg(F.sum("m").alias("met")).select(
        "node", (-F.col("met") * 4096 + F.pmod(F.xxhash64("node"), F.lit(4096))).alias("order"))
    members = cut_lineage(members, "members")
    keys = cut_lineage(met.select("key", "node").join(members, "node"), "keys")
    known = cut_lineage(features.join(members.select("node"), "node").select("node", "n", "sketch"), "features")
    texts = base.join(members.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text")
    texts = texts.withColumn("h", F.xxhash64("text")).dropDuplicates(["node", "h"]).drop("h")
    sets = cut_lineage(shingle_sets(texts, p.words), "sets")
    labels = grouped(keys, members.select("node", F.col("node").alias("root")), known, sets, p)
    # One doc_id may own several texts: its nodes belong together.
    several = owners.groupBy("doc_id").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y")
    if not several.isEmpty():
        own = owners.join(several.select("doc_id"), "doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
        every = owners.select("node").distinct().union(owners.select("doc_id")).distinct()
        labels = every.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        labels = merged(labels, own)
    placed = owners.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    alone = made.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(alone).select(
        "doc_id", "n_shingles", "component_id",
        (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))
