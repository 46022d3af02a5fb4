"""SimHash near-dedup over vantage-point trees.

Fingerprints of 64 bits are cut into (radius + 1) // 2 parts; two fingerprints within `radius` bits agree to one
bit in one part at least. Each part has a vantage-point tree, fitted on a bounded sample: a node holds a vantage
point and a distance, and sends a fingerprint to its inner or outer child by the part's Hamming distance to that
point. By the triangle inequality, a fingerprint further from the border than the part's radius has no partner on
the other side, so that only those near the border visit both. Each leaf is a shard: it holds its own fingerprints
and the visitors whose balls cross into it, and finds their exact pairs in full 64-bit distance.

Equal fingerprints are one node from the start, and a leaf gives a least spanning forest of its links (the nearest
pairs first), never all pairs. A shard's size grows slowly with the input (CELL_POWER), so that visits to other
shards stay few; within its task a shard of over LEAF_MOST fingerprints has a tree of its own, down to leaves of
about LEAF_AIM. Nothing is cut off at any size. Several independent fingerprints of a text go through one pass of the
same trees, each with shards of its own. Links may be verified
by the Jaccard similarity of their texts' shingles: first each text's nearest pair, then in large groups those
to some central texts, at last all candidate pairs between parts that are still apart. In large groups these are found by prefixes: with a group's shingles in order of their number in it, the rarest first, sets as alike as asked for share
one among their first few. So at the end each candidate pair was verified, can't be alike enough, or lies within a
part that verified links connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, slices
from .components import components

SEED = 42
#: Fingerprints of a leaf that trees aim at, those of a shard beyond which it has a tree of its own, sampled fingerprints for each leaf.
LEAF_AIM, LEAF_MOST, LEAF_SAMPLE = 1024, 2048, 16
#: Shards of a tree: fingerprints / LEAF_AIM to this power.
CELL_POWER = 0.65
#: Fingerprints that a task deals to shards at a time, some 10 MB of memory.
DEALT = 1 << 15
#: Comparisons at a time, and pairs that a leaf holds beside a spanning forest before they join it.
PAIRS_MOST = 1 << 18
#: Texts of a group of candidates whose pairs are all looked at; in larger groups, those with a rare shingle in common.
GROUP_SMALL = 16
#: Texts of a large group whose shingles most others hold, too: those that stand apart meet these first.
HUBS = 8


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and white space \x20 \x09-\x0D
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        joined = [b" ".join(found)]
    else:
        joined = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes made of these, for the k-th fingerprint; the first one takes them as they are."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document, whose hashes lie together: bit set if it is set in over half of them; 0 without any."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # runs of at most 255 hashes, so that sums of single bits fit in the bytes of a word
    n = counts[some].astype(np.int64)
    runs = -(-n // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(n) - n, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first_run, runs))
    sums = np.empty((len(starts), 8), np.uint64)
    for k in range(8):  # bit k of each byte
        sums[:, k] = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
    ones = np.add.reduceat(sums.astype("<u8").view(np.uint8).reshape(-1, 8, 8), first_run, axis=0, dtype=np.int64)  # [document, k, byte]
    bits = (2 * ones > n[:, None, None]).transpose(0, 2, 1).reshape(-1, 64)
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit set if it is set in over half of the hashes; 0 without any."""
    return int(fingerprints_of(hashes, np.array([len(hashes)]))[0])


def fingerprints(docs: DataFrame, words: int = 3, prints: int = 1, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row (of row_col, else 0), key (a hash of the text) and fp0, fp1, ... (fingerprints as signed longs) of each row."""
    shared_dir(docs.sparkSession)
    names = [f"fp{k}" for k in range(prints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [shingle_hashes(t, words) for t in batch.column("text").to_pylist()]
            hashes, counts = np.concatenate(found), np.array([len(h) for h in found])
            fps = [fingerprints_of(_mixed(hashes, k), counts).view(np.int64) for k in range(prints)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "key")), *map(pa.array, fps)], names=["doc_id", "row", "key", *names])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.col(row_col).cast("long") if row_col else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), text.alias("text"), F.xxhash64(text).alias("key"))
    return rows.mapInArrow(run, "doc_id long, row long, key long, " + ", ".join(f"{n} long" for n in names))


class VantageTree:
    """nodes: (vantage, cut, inner, outer); a negative child c is leaf -c - 1. Distances count the bits of mask."""

    def __init__(self, mask: int, radius: int, sample: np.ndarray, leaves: int, seed: int):
        self.mask, self.radius, self.nodes, self.leaves = np.uint64(mask), radius, [], 0
        rng = np.random.default_rng(seed)
        self.root = self._grow(sample, max(1, leaves), rng)

    def _grow(self, sample: np.ndarray, leaves: int, rng) -> int:
        best = None
        if leaves > 1 and len(sample) >= 4:
            for vantage in rng.choice(sample, min(8, len(sample)), replace=False):
                d = self.distance(sample, vantage)
                for cut in {int(np.median(d)), int(np.median(d)) - 1}:
                    inner = int((d <= cut).sum())
                    if 0.2 * len(d) <= inner <= 0.8 * len(d):
                        visits = int(((d > cut - self.radius) & (d <= cut + self.radius)).sum())
                        if best is None or visits + abs(2 * inner - len(d)) < best[0]:
                            best = (visits + abs(2 * inner - len(d)), vantage, cut)
        if best is None:
            self.leaves += 1
            return -self.leaves
        _, vantage, cut = best
        at = len(self.nodes)
        self.nodes.append(None)
        d = self.distance(sample, vantage)
        inner = self._grow(sample[d <= cut], leaves // 2, rng)
        outer = self._grow(sample[d > cut], leaves - leaves // 2, rng)
        self.nodes[at] = (vantage, cut, inner, outer)
        return at

    def distance(self, fps: np.ndarray, vantage: np.uint64) -> np.ndarray:
        return np.bitwise_count((fps ^ vantage) & self.mask).astype(np.int16)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each leaf that the ball around a fingerprint meets; radius 0: its own leaf."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                rows.append(at)
                leaves.append(np.full(len(at), -node - 1))
            elif len(at):
                vantage, cut, inner, outer = self.nodes[node]
                d = self.distance(fps[at], vantage)
                todo += [(inner, at[d <= cut + radius]), (outer, at[d > cut - radius])]
        return np.concatenate(rows), np.concatenate(leaves)


def _spanning(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int, roots: np.ndarray | None = None) -> np.ndarray:
    """Indexes of pairs that form a least spanning forest by d. Each round hooks roots onto smaller ones.

    roots, if given, gets for each d the parts that pairs up to it connect.
    """
    root, kept = np.arange(n, dtype=np.int32), [np.zeros(0, np.int64)]
    for level in np.unique(d) if roots is None else range(len(roots)):
        at = np.flatnonzero(d == level)
        while len(at):
            x, y = root[i[at]], root[j[at]]
            apart = x != y
            at, low, high = at[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            if not len(at):
                break
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
            kept.append(at[first])
            root[high[first]] = low[first]
            while (jumped := root[root] != root).any():
                root[jumped] = root[root[jumped]]
        if roots is not None:
            roots[level] = root
    return np.concatenate(kept)


def forest(home: np.ndarray, visitors: np.ndarray, radius: int, earlier: tuple[int, ...] = (), part_radius: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, distance) that connect whatever home x home and visitors x home pairs within the radius connect, the nearest first.

    Of new pairs, those whose ends are connected already by links no longer than they are go at once. Pairs
    that agree to part_radius bits in one of the earlier parts (masks) are left to that part's tree.
    """
    both = np.concatenate([home, visitors])
    roots = np.tile(np.arange(len(both), dtype=np.int32), (radius + 1, 1))
    held, total = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8))], 0
    step = max(1, PAIRS_MOST // max(1, len(home)))
    for a in range(0, len(both), step):
        d = np.bitwise_count(both[a : a + step, None] ^ home[None, :])
        i, j = np.nonzero(d <= radius)
        d, i, j = d[i, j], (i + a).astype(np.int32), j.astype(np.int32)
        fits = ((i >= len(home)) | (i > j)) & (roots[d, i] != roots[d, j])  # each pair of home once
        for mask in earlier:
            fits &= np.bitwise_count((both[i] ^ both[j]) & np.uint64(mask)) > part_radius
        if fits.any():
            held.append((i[fits], j[fits], d[fits]))
            total += len(held[-1][0])
        if total > PAIRS_MOST or (total and a + step >= len(both)):
            i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
            kept = _spanning(i, j, d, len(both), roots)
            held, total = [(i[kept], j[kept], d[kept])], 0
    i, j, d = held[0]
    return both[i], both[j], d


def routed(tree: VantageTree, fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, at home there) of each leaf that a fingerprint is dealt to; home: False for those that only visit.

    Of two leaves whose fingerprints may meet, that of the lower one visits the higher one.
    """
    row, leaf = tree.route(fps, 0)
    own = np.full(len(fps), -1)
    own[row] = leaf
    own[~home] = -1
    row, leaf = tree.route(fps, tree.radius)
    fits = leaf >= own[row]
    row, leaf = row[fits], leaf[fits]
    return row, leaf, leaf == own[row]


def shard_links(fps: np.ndarray, home: np.ndarray, radius: int, masks: list[int], part: int, part_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a shard of a part's tree (see forest); a large one is cut by a tree of its own."""
    earlier = tuple(masks[:part])
    if home.sum() <= LEAF_MOST:
        return forest(fps[home], fps[~home], radius, earlier, part_radius)
    own = fps[home]
    leaves = len(own) // LEAF_AIM
    sample = own[:: max(1, len(own) // (leaves * 4 * LEAF_SAMPLE))]
    row, leaf, at_home = routed(tree := VantageTree(masks[part], part_radius, sample, leaves, 5), fps, home)
    order = np.argsort(leaf, kind="stable")
    row, at_home, ends = row[order], at_home[order], np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    found = [forest(fps[row[a:b]][at_home[a:b]], fps[row[a:b]][~at_home[a:b]], radius, earlier, part_radius) for a, b in zip(ends, ends[1:], strict=False)]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def links(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Links (print, a, b, d) that span the components of distinct fingerprints within the radius. fps: print (0, 1, ...), fp."""
    spark = fps.sparkSession
    n = max([r["count"] for r in fps.groupBy("print").count().collect()], default=0)
    cells = max(1, int((n / LEAF_AIM) ** CELL_POWER))
    # a hash below a share of its range: some LEAF_SAMPLE fingerprints for each shard; all prints share the trees
    below = F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(1 << 40)) < int(min(1.0, 4 * cells * LEAF_SAMPLE / max(1, n)) * (1 << 40))
    sample = np.sort(np.array([r[0] for r in fps.where("print = 0").where(below).select("fp").collect()], np.int64).view(np.uint64))
    parts = max(1, (radius + 1) // 2)
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    shared = spark.sparkContext.broadcast([VantageTree(m, radius // parts, sample, cells, 11 + k) for k, m in enumerate(masks)])

    def dealt(at: np.ndarray, base: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, tree in enumerate(shared.value):
            row, leaf, home = routed(tree, at, np.ones(len(at), bool))
            cell = ((base[row] + k) << 32) + leaf
            order = np.argsort(2 * cell + ~home, kind="stable")
            cell, home, fp = cell[order], home[order], at[row[order]].astype("<u8")
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])  # a fingerprint is dealt to its own leaf at least
            cuts = list(zip(starts.tolist(), (starts + np.add.reduceat(home.astype(np.int64), starts)).tolist(), [*starts[1:].tolist(), len(cell)], strict=True))
            own, visitors = [fp[a:m].tobytes() for a, m, _ in cuts], [fp[m:b].tobytes() for _, m, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(cell[starts]), pa.array(own, pa.binary()), pa.array(visitors, pa.binary())], names=["cell", "home", "visitors"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row holds all fingerprints that some DEALT ones send to a cell: one row for each would take four times their bytes."""
        held, total = [], 0
        for batch in batches:
            held.append((batch.column("fp").to_numpy().view(np.uint64), batch.column("print").to_numpy().astype(np.int64) * parts))
            total += batch.num_rows
            if total >= DEALT:
                yield from dealt(*map(np.concatenate, zip(*held, strict=True)))
                held, total = [], 0
        if total:
            yield from dealt(*map(np.concatenate, zip(*held, strict=True)))

    def pairs(key, group):  # a pa.Table in and out
        number = key[0].as_py() >> 32
        own, visitors = (np.frombuffer(b"".join(group.column(c).to_pylist()), "<u8").astype(np.uint64) for c in ("home", "visitors"))
        a, b, d = shard_links(np.concatenate([own, visitors]), np.arange(len(own) + len(visitors)) < len(own), radius, masks, number % parts, radius // parts)
        return pa.table({"print": pa.array(np.full(len(a), number // parts, np.int32)), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "d": pa.array(d.astype(np.int32))})

    return fps.mapInArrow(deal, "cell long, home binary, visitors binary").groupBy("cell").applyInArrow(pairs, "print int, a long, b long, d int")


def shingle_sets(keys: DataFrame, docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """(key, shingles) of the texts whose hashes are in keys: the set of hashes of their shingles."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "key long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b, ...) of text hashes, those whose sets of shingles have a Jaccard similarity of `least` or more."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(least) * (F.size("x") + F.size("y") - shared)).drop("x", "y")


def _near(names: list[str], radius: int):
    near = F.lit(False)
    for n in names:
        near |= F.bit_count(F.col(f"{n}_a").bitwiseXOR(F.col(f"{n}_b"))) <= radius
    return near


def _ends(pairs: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b) with columns of state for either end, named with _a and _b behind."""
    for x in ("a", "b"):
        pairs = pairs.join(state.select(F.col("key").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)), x)
    return pairs


def _apart(state: DataFrame) -> DataFrame:
    """Rows of groups whose parts are still apart."""
    apart = state.groupBy("grp").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("grp")
    return state.where("members > 2").join(apart, "grp", "left_semi")


def _held(state: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, key, part, n, shingle, held) of large groups that are apart; held: texts of the group with the shingle."""
    many = _apart(state).where(F.col("members") > GROUP_SMALL).select("grp", "key", "part", "n")
    each = many.join(sets.select("key", "shingles"), "key").select("grp", "key", "part", "n", F.explode("shingles").alias("shingle"))
    return each.join(each.groupBy("grp", "shingle").agg(F.count("*").alias("held")), ["grp", "shingle"])


def central(state: DataFrame, sets: DataFrame, tried: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Candidate pairs (a, b, part_a, part_b) of the texts of a large group with its HUBS central ones, in other parts."""
    texts = _held(state, sets).groupBy("grp", "key", "part").agg(F.avg("held").alias("held"))
    hubs = texts.groupBy("grp", F.pmod(F.xxhash64("key"), F.lit(HUBS)).alias("slot")).agg(F.max_by("key", F.struct("held", "key")).alias("hub"))
    met = texts.select("grp", F.col("key").alias("a")).join(hubs.select("grp", F.col("hub").alias("b")), "grp").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _ends(met, state, ["part", *names]).where((F.col("part_a") != F.col("part_b")) & _near(names, radius)).select("a", "b", "part_a", "part_b").join(tried, ["a", "b"], "left_anti")


def untried(state: DataFrame, sets: DataFrame, tried: DataFrame, names: list[str], radius: int, similar: float) -> DataFrame:
    """Candidate pairs (a, b, part_a, part_b) between parts of a group that are still apart, without those in tried and
    those that can't be as alike.

    state: key, n (its shingles), fingerprints, grp, members (of grp), part.
    """
    rows = _apart(state)
    few = rows.where(F.col("members") <= GROUP_SMALL)
    sides = [few.select("grp", *(F.col(c).alias(f"{c}_{x}") for c in ("key", "n", "part", *names))) for x in ("a", "b")]
    sized = F.least("n_a", "n_b") >= F.lit(similar) * F.greatest("n_a", "n_b")
    found = sides[0].join(sides[1], "grp").where((F.col("key_a") < F.col("key_b")) & (F.col("part_a") != F.col("part_b")) & sized & _near(names, radius))
    found = found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "part_a", "part_b")

    many = rows.where(F.col("members") > GROUP_SMALL)
    ranked = _held(state, sets).withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("held", "shingle")))
    least = F.ceil(F.lit(similar) * F.col("n") - 1e-9)  # shingles in common with a set of the least size, none of which may be larger
    prefix = ranked.where((F.col("pos") <= F.col("n") - least + 1) & (F.col("held") > 1)).drop("held")
    # the largest part of a group needn't meet itself
    largest = many.groupBy("grp", "part").agg(F.count("*").alias("size")).groupBy("grp").agg(F.max_by("part", F.struct("size", "part")).alias("largest"))
    left = prefix.join(largest, "grp").where("part <> largest").select("grp", "shingle", *(F.col(c).alias(f"{c}_a") for c in ("key", "part", "n", "pos")))
    right = prefix.select("grp", "shingle", *(F.col(c).alias(f"{c}_b") for c in ("key", "part", "n", "pos")))
    shared = F.ceil(F.lit(similar / (1 + similar)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    fits = (F.col("part_a") != F.col("part_b")) & sized & (F.col("pos_a") <= F.col("n_a") - shared + 1) & (F.col("pos_b") <= F.col("n_b") - shared + 1)
    turned = F.col("key_a") < F.col("key_b")
    met = left.join(right, ["grp", "shingle"]).where(fits).select(*(F.when(turned, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(to) for c, x, y, to in (("key", "a", "b", "a"), ("key", "b", "a", "b"), ("part", "a", "b", "part_a"), ("part", "b", "a", "part_b"))))
    met = _ends(met.distinct(), many, names).where(_near(names, radius)).select("a", "b", "part_a", "part_b")
    return found.union(met).join(tried, ["a", "b"], "left_anti")


def near_groups(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Rows whose fingerprints differ in `radius` bits or fewer are linked; component_id is the smallest doc_id that
    links reach. Null and empty texts have fingerprint zero, linked like any other. Null ids take part but name
    no component, unless all of its ids are null. An empty table gives no rows; further columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprints(docs, words, 1, id_col, text_col).select("doc_id", F.col("fp0").alias("fp")), "fingerprints")
    nodes = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    named = _named(nodes, "fp", links(nodes.select(F.lit(0).alias("print"), "fp"), radius, scratch).select("a", "b"), scratch)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def _named(nodes: DataFrame, key: str, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, first) of nodes (key, least): the smallest `least` of each component."""
    found = components(edges, scratch)
    whole = nodes.join(found.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("component", key).alias("component"))
    whole = scratch.table(whole, "components")
    least = whole.groupBy("component").agg(F.min("least").alias("first"))
    return whole.join(least, "component").select(key, "first")


def near_copies(docs: DataFrame, similar: float = 0.8, shingle: int = 5, words: int = 3, radius: int = 7, prints: int = 2, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per input row: doc_id, component_id, kept, row; linked are texts whose sets of shingles are `similar` or more.

    Candidates are texts that agree to `radius` bits in one of `prints` independent fingerprints. Each candidate
    pair is verified in full, unless verified links connect its texts already. kept is true for one row of each
    component, that of the smallest id (of these, of the smallest row_col, a number that no other row has; without
    row_col all rows of that id and component are kept). The result reads tables in scratch, which the caller may
    clear afterwards. The other terms are those of near_groups.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession, "near")
    rows = scratch.table(fingerprints(docs, words, prints, id_col, text_col, row_col), "fingerprints")
    names = [f"fp{k}" for k in range(prints)]
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")  # null ids come last
    texts = scratch.table(rows.groupBy("key").agg(F.min(first).alias("least"), *(F.first(n).alias(n) for n in names)), "texts")
    each = texts.select("key", F.posexplode(F.array(*names)).alias("print", "fp"))
    one = scratch.table(each.groupBy("print", "fp").agg(F.min("key").alias("key")), "one")
    near = links(one.select("print", "fp"), radius, scratch).distinct()
    ends = [one.select("print", F.col("fp").alias(x), F.col("key").alias(f"key_{x}")) for x in ("a", "b")]
    linked = near.join(ends[0], ["print", "a"]).join(ends[1], ["print", "b"]).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"), "d")
    equal = each.withColumnRenamed("key", "own").join(one, ["print", "fp"]).where("own <> key").select(F.col("key").alias("a"), F.col("own").alias("b"), F.lit(0).alias("d"))
    pairs = scratch.table(linked.union(equal).groupBy("a", "b").agg(F.min("d").alias("d"), F.count("*").alias("prints")), "pairs")
    sets = scratch.table(shingle_sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), docs, shingle, text_col), "sets")
    # groups that candidate pairs connect, and their parts that verified ones do
    groups = components(pairs.select("a", "b"), scratch.below("groups")).select(F.col("node").alias("key"), F.col("component").alias("grp"))
    state = sets.select("key", F.size("shingles").alias("n"), F.col("key").alias("part")).join(texts.select("key", *names), "key").join(groups, "key")
    state = scratch.table(state.join(groups.groupBy("grp").agg(F.count("*").alias("members")), "grp"), "state0")

    def merged(state: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """state with parts joined that those of the pairs (a, b, part_a, part_b) which are alike connect."""
        found = verified(scratch.table(pairs, f"pairs{k}"), sets, similar)
        joined = components(found.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), scratch.below("parts")).withColumnRenamed("node", "part")
        return scratch.table(state.join(joined, "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component"), f"state{k + 1}")

    best = F.struct("d", (-F.col("prints")).alias("prints"), "a", "b").alias("pair")
    nearest = pairs.select(F.col("a").alias("key"), best).union(pairs.select("b", best)).groupBy("key").agg(F.min("pair").alias("pair"))
    state = merged(state, nearest.select("pair.a", "pair.b").distinct().select("a", "b", F.col("a").alias("part_a"), F.col("b").alias("part_b")), 0)
    tried = spark.read.parquet(scratch.path("pairs0")).select("a", "b")
    # what follows looks at texts of groups that are still apart only
    sets = scratch.table(sets.join(_apart(state).select("key"), "key", "left_semi"), "sets1")
    state = merged(state, central(state, sets, tried, names, radius), 1)
    tried = tried.union(spark.read.parquet(scratch.path("pairs1")).select("a", "b"))
    state = merged(state, untried(state, sets, tried, names, radius, similar), 2)
    named = _named(texts.select("key", "least"), "key", state.select(F.col("key").alias("a"), F.col("part").alias("b")), scratch)
    return rows.join(named, "key").select("doc_id", F.col("first.doc_id").alias("component_id"), first.eqNullSafe(F.col("first")).alias("kept"), "row")
