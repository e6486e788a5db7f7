"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

A fingerprint has 64 bits; two are linked if at most `radius` (3) bits differ. Equal fingerprints are one item, so copies
never meet. Of four 16-bit blocks at least one is equal in any linked pair, so an item goes to four bins (block number,
block value). In a bin the items are sorted by population count and cut into tiles; a pair of tiles is skipped if their
population counts differ by more than the radius, else all its pairs are compared by exclusive-or and bit counts in
numpy. A bin of more than `bin_rows` items is dealt out by bands of population counts, and large bands as groups; only groups of equal or successive
bands meet, each pair in a task of its own, so no bin is capped and no link is lost. Of the links in a bin only a spanning tree of fan-out 64 leaves the task; components of those trees are
the components of all links.

Cases: null and empty texts have fingerprint zero, and are linked like any other; a text below three words is one shingle;
repeated rows and rows with one id are kept, each with its row; null ids take part, and a component's smallest id ignores them
(null if it has no other); bytes that are not UTF-8 count as the replacement character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm._common import forget, give_back, map_batches, materialize, valid
from engram.llm.components import components, contracted_components

RADIUS = 3
BIN_ROWS = 16_384
TILE = 1_024
SHINGLE = 3


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles; A-Z are lower-cased, words are separated by ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = len(w)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(w), 42)]
    else:
        joined, ends, p = b" ".join(w), [], -1
        for x in w:
            p += len(x) + 1
            ends.append(p)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[: ends[words - 1]], 42)]
        hashes += [digest(joined[a + 1 : b], 42) for a, b in zip(ends, ends[words:], strict=False)]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = SHINGLE) -> DataFrame:
    """One row for each row of df: id, bits (the fingerprint as a signed long)."""

    def make():
        def step(batch):
            found = np.array([fingerprint(x.as_py() or "", words) for x in batch.column(1)], dtype=np.uint64)
            return {id_col: batch.column(0), "bits": pa.array(found.view(np.int64))}

        return step

    return map_batches(df.select(id_col, valid(F.col(text_col))), make, f"{id_col} {df.schema[id_col].dataType.simpleString()}, bits long")


class _Union:
    """Components of numbered items, by union of roots; the smaller number is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """All links at once: hook larger roots to smaller ones until nothing changes."""
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            apart = lo != hi
            if not apart.any():
                return
            a, b, lo, hi = a[apart], b[apart], lo[apart], hi[apart]
            np.minimum.at(self.up, hi, lo)


def compare(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, tile: int = TILE, names: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Rows of left (and right, numbered on) whose links span the components of all pairs at distance <= radius, within `left` or
    between left and right. A row is a fingerprint of one or more 64-bit lanes. With names, each row is linked to that of the least name of its
    component, so that bins which share members mostly give the same links; else the links are a tree of fan-out 64."""
    own = right is None
    items = left if own else np.concatenate([left, right])
    items = items.reshape(len(items), -1)
    side = np.zeros(len(items), dtype=np.int8)
    side[len(left) :] = 1
    ones = np.bitwise_count(items).sum(axis=1, dtype=np.int32)
    order = np.argsort(ones, kind="stable")
    items, ones, side = items[order], ones[order], side[order]
    union = _Union(len(items))
    starts = range(0, len(items), tile)
    for i in starts:
        a, a_side = items[i : i + tile], side[i : i + tile]
        top = ones[min(i + tile, len(items)) - 1]
        root = union.roots() if len(starts) > 1 else None
        for j in starts[i // tile :]:
            if ones[j] - top > radius:
                break  # the tiles behind hold yet higher counts
            if root is not None and (root[i : i + tile] == root[i]).all() and (root[j : j + tile] == root[i]).all():
                continue  # one component already
            b = items[j : j + tile]
            apart = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
            for lane in range(1, items.shape[1]):
                apart += np.bitwise_count(a[:, None, lane] ^ b[None, :, lane])
            near = apart <= radius
            if not own:
                near &= a_side[:, None] != side[j : j + tile][None, :]
            x, y = np.nonzero(near)
            ahead = x + i < y + j
            union.link(x[ahead] + i, y[ahead] + j)
    root = union.roots()
    rest = np.nonzero(root != np.arange(len(items)))[0]
    if not len(rest):
        return []
    # a tree of fan-out 64 over each component: no item becomes a hub of the edge table
    members = np.argsort(root, kind="stable")
    members = members[np.isin(root[members], root[rest])]
    out = []
    for _, group in groupby(members.tolist(), key=lambda k: root[k]):
        group = order[list(group)].tolist()
        if names is not None:
            first = min(group, key=names.__getitem__)
            out += [(first, g) for g in group if g != first]
            continue
        out += [(group[k // 64 if k // 64 < k else 0], group[k]) for k in range(1, len(group))]
    return out


#: Groups of one band of a bin are numbered below this.
_GROUPS = 1 << 32


def _meet(binned: DataFrame, bin_rows: int, compare_rows: Callable[[list[bytes], list[bytes] | None, np.ndarray], list[tuple[int, int]]], weight: Column | None = None, band: Column | None = None) -> DataFrame:
    """binned: (bin, item, lanes). Items of one bin meet. A bin of more than bin_rows items (or that sum of weights) is dealt out: by bands, of which only
    equal and successive ones meet (those of population counts, a radius wide: others cannot be linked), and large bands as groups by
    a hash. Each pair of groups that meet is a task."""
    weight = F.lit(1) if weight is None else weight
    big = materialize(binned.groupBy("bin").agg(F.sum(weight).alias("n")).where(F.col("n") > bin_rows).select("bin"), "bins")
    zero = F.lit(0).cast("long")
    if big.limit(1).count():
        rows = binned.withColumn("band", (F.lit(0) if band is None else band).cast("long"))
        counts = rows.join(big, "bin", "left_semi").groupBy("bin", "band").agg(F.ceil(F.sum(weight) / bin_rows).cast("long").alias("groups"))
        large = materialize(counts.groupBy("bin").agg(F.map_from_entries(F.collect_list(F.struct("band", "groups"))).alias("groups")), "bands")
        size = lambda b: F.coalesce(F.get(F.map_values(F.map_filter("groups", lambda k, _: k == b)), F.lit(0)), zero)
        own = F.when(F.col("groups").isNotNull(), F.col("band") * _GROUPS + F.pmod(F.xxhash64("item", F.lit(7)), size(F.col("band")))).otherwise(zero)
        near = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
        others = F.flatten(F.transform(near, lambda b: F.when(size(b) > 0, F.transform(F.sequence(zero, size(b) - 1), lambda g: b * _GROUPS + g)).otherwise(F.array().cast("array<bigint>"))))
        # a group meets itself, and each other group once: (low, high) names the task
        meets = F.when(F.col("groups").isNull(), F.array(zero)).otherwise(others)
        dealt = rows.join(large, "bin", "left").withColumn("part", own)
        tasks = dealt.select("item", "lanes", "bin", "part", F.explode(meets).alias("m")).select("bin", "part", F.least("m", "part").alias("low"), F.greatest("m", "part").alias("high"), "item", "lanes")
    else:
        tasks = binned.select("bin", zero.alias("part"), zero.alias("low"), zero.alias("high"), "item", "lanes")
    spread = tasks.repartition("bin", "low", "high").sortWithinPartitions("bin", "low", "high", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the rows of the task that the last batch broke off in
        out: list[tuple[int, int]] = []

        def close(rows: pa.Table) -> None:
            if rows.num_rows > 1:
                part, low, high = (np.asarray(rows[c]) for c in ("part", "low", "high"))
                item = np.asarray(rows["item"])
                lanes = rows["lanes"].to_pylist()
                if low[0] == high[0]:
                    found, names = compare_rows(lanes, None, item), item
                else:
                    first = part == low[0]
                    if first.all() or not first.any():
                        return  # the hash has put nothing into the other group
                    names = np.concatenate([item[first], item[~first]])
                    found = compare_rows([x for x, f in zip(lanes, first) if f], [x for x, f in zip(lanes, first) if not f], names)
                out.extend((int(names[a]), int(names[b])) for a, b in found)

        def flush() -> pa.RecordBatch:
            both = np.array(out, dtype=np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            keys = np.stack([np.asarray(rows[c]).astype(np.int64) for c in ("bin", "low", "high")])
            edges = [0, *(np.nonzero((np.diff(keys, axis=1) != 0).any(axis=0))[0] + 1).tolist()]
            for a, b in zip(edges, edges[1:], strict=False):
                if b - a > 1:
                    close(rows.slice(a, b - a))
            held = rows.slice(edges[-1]).combine_chunks()
            if len(out) > 100_000:
                yield flush()
        if held is not None:
            close(held)
        yield flush()
        held = None
        give_back()

    return spread.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """distinct: (bits), without repeats. Returns (a, b), enough links to span the components of all pairs within radius."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find pairs of at most 3 differing bits")
    blocks = F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("bits", 16 * k).bitwiseAND(F.lit(65535)).alias("value")) for k in range(4)])
    lanes = F.unhex(F.lpad(F.hex("bits"), 16, "0"))
    binned = distinct.select("bits", lanes.alias("lanes"), F.explode(blocks).alias("bin")).select(F.col("bits").alias("item"), "lanes", (F.col("bin.value") * 4 + F.col("bin.block")).alias("bin"))
    ones = F.bit_count("item")
    return _meet(binned, bin_rows, _within(radius, False), band=F.floor(ones / (radius + 1)))


def _within(radius: int, name: bool) -> Callable[[list[bytes], list[bytes] | None, np.ndarray], list[tuple[int, int]]]:
    """Comparison of two groups, or of one, of fingerprints as bytes; their order does not matter to the number of differing bits."""

    def near(left: list[bytes], right: list[bytes] | None, names: np.ndarray) -> list[tuple[int, int]]:
        rows = [x if x is None else np.frombuffer(b"".join(x), dtype="<u8").reshape(len(x), -1) for x in (left, right)]
        return compare(rows[0], rows[1], radius, names=names if name else None)

    return near


def near_duplicates(df: DataFrame, id_col: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """One row for each row of df: id, fingerprint (16 hex digits), component_id (the smallest id that links reach)."""
    prints = materialize(fingerprints(df, id_col, text_col), "prints")
    items = materialize(prints.groupBy("bits").agg(F.min(id_col).alias("first_id")), "items")
    linked = materialize(links(items.select("bits"), radius), "links")
    rooted = components(linked).withColumnsRenamed({"node": "bits"})
    with_root = materialize(items.join(rooted, "bits", "left").select("bits", "first_id", F.coalesce("root", "bits").alias("root")), "rooted")
    lowest = materialize(with_root.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    classes = materialize(with_root.join(lowest, "root").select("bits", "component_id"), "classes")
    forget(items, linked, with_root, lowest)
    return prints.join(classes, "bits").select(id_col, F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


# ---- similarity of word shingles, by wide fingerprints

WIDE_WORDS, WIDE_LANES, BLOCK_BITS, SIMILARITY = 5, 7, 11, 0.8
#: Items of an average bin beyond which keys are made wider, and the share of similar pairs that may share no key.
MEAN_BIN, LOST = 2_048, 2.5e-3
#: Shingles of a cluster of candidates that one group compares at most; larger clusters are dealt out as pairs of groups.
CLUSTER_SHINGLES = 250_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str, words: int = WIDE_WORDS) -> np.ndarray:
    """The hashes of the text's word shingles, in order, each once."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    joined, ends, p = b" ".join(w), [-1], -1
    for x in w:
        p += len(x) + 1
        ends.append(p)
    return np.unique(np.array([digest(joined[a + 1 : b], 42) for a, b in zip(ends, ends[words:], strict=False)] or [digest(joined, 42)], dtype=np.uint64))


def wide_fingerprint(text: str, words: int = WIDE_WORDS, lanes: int = WIDE_LANES) -> np.ndarray:
    """Fingerprint of several 64-bit lanes; each lane is the SimHash of the set of shingles under another mixing of their hashes."""
    return _lanes(shingles(text, words), lanes)


def _lanes(h: np.ndarray, lanes: int) -> np.ndarray:
    if not len(h):
        return np.zeros(lanes, dtype=np.uint64)
    out = [majority(h)]
    for k in range(1, lanes):
        m = (h ^ (h >> np.uint64(29))) * _MIX[k]
        out.append(majority(m ^ (m >> np.uint64(32))))
    return np.array(out, dtype=np.uint64)


def _set_name(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63)


def wide_radius(similarity: float = SIMILARITY, lanes: int = WIDE_LANES) -> int:
    """Differing bits up to which two fingerprints are candidates: what sets of that Jaccard similarity are expected to differ by,
    and six standard deviations more, as small sets differ by more than expected; candidates are verified."""
    bits = 64 * lanes
    p = differing_share(similarity)
    return int(bits * p + 6 * np.sqrt(bits * p * (1 - p)))


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two fingerprints, of sets of that Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def key_bits(items: int, similarity: float = SIMILARITY, lanes: int = WIDE_LANES, block_bits: int | None = None) -> np.ndarray:
    """The bits that make up each key (keys x bits). Keys have 11 bits, in successive blocks of the fingerprint, and one bit more for each doubling of the items
    beyond 4 million, so that bins stay as large as they are; of wider keys there are as many, at fixed random bits, as let a similar pair
    share one but for LOST of all pairs. Their number grows as the items to the power 0.24."""
    bits = 64 * lanes
    width = block_bits or max(BLOCK_BITS, int(np.ceil(np.log2(max(1, items) / MEAN_BIN))))
    if width <= BLOCK_BITS:
        return np.arange(bits // width * width).reshape(-1, width)
    keys = 1
    while lost_pairs(keys, width, similarity, lanes) > LOST:
        keys += 1 + keys // 50
    rng = np.random.default_rng(13)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(keys)])


def lost_pairs(keys: int, width: int, similarity: float = SIMILARITY, lanes: int = WIDE_LANES) -> float:
    """The share of pairs of that similarity that share none of so many keys of random bits, over all numbers of differing bits."""
    bits, p = 64 * lanes, differing_share(similarity)
    differ = np.arange(bits - width + 1)  # with more, no key can be equal
    log = np.cumsum(np.log(np.maximum(1, np.arange(bits + 1))))  # of factorials
    weight = np.exp(log[bits] - log[differ] - log[bits - differ] + differ * np.log(p) + (bits - differ) * np.log(1 - p))
    equal = np.exp(log[bits - differ] - log[bits - differ - width] - log[bits] + log[bits - width])
    return float((weight * (1 - equal) ** keys).sum() + 1 - weight.sum())


def jaccard_links(sets: list[np.ndarray], names: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of each row to that of the least name of its component, for the components of all pairs of sets whose Jaccard similarity is
    at least `similarity`. A set is compared with those of fitting size that its component has not reached yet."""
    sizes = np.array([len(x) for x in sets])
    rest = np.argsort(sizes, kind="stable")
    rest = rest[sizes[rest] > 0]
    if len(rest) < 2:
        return []
    sizes = sizes[rest]
    _, flat = np.unique(np.concatenate([sets[k] for k in rest]), return_inverse=True)
    code = np.split(flat, np.cumsum(sizes)[:-1])
    alive, mark = np.ones(len(rest), dtype=bool), np.zeros(flat.max() + 1, dtype=bool)
    at, held = np.arange(len(rest)), flat  # the rows that are still looked through, and their shingles
    out: list[tuple[int, int]] = []
    for seed in range(len(rest)):
        if not alive[seed]:
            continue
        alive[seed], group, done = False, [seed], 0
        while done < len(group):
            x = group[done]
            done += 1
            if alive[at].sum() * 2 < len(at):
                at = at[alive[at]]
                held = np.concatenate([code[k] for k in at]) if len(at) else flat[:0]
            ends = np.concatenate([[0], np.cumsum(sizes[at])])
            lo, hi = np.searchsorted(sizes[at], [np.ceil(similarity * sizes[x] - 1e-9), np.floor(sizes[x] / similarity + 1e-9) + 1])
            if lo >= hi:
                continue
            mark[code[x]] = True
            both = np.add.reduceat(mark[held[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], dtype=np.int64)
            mark[code[x]] = False
            near = at[lo:hi][(both >= similarity * (sizes[at[lo:hi]] + sizes[x] - both) - 1e-9) & alive[at[lo:hi]]]
            alive[near] = False
            group += near.tolist()
        members = rest[group].tolist()
        first = min(members, key=names.__getitem__)
        out += [(first, k) for k in members if k != first]
    return out


def similar_texts(df: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, words: int = WIDE_WORDS, lanes: int = WIDE_LANES, block_bits: int | None = None, bin_rows: int = BIN_ROWS, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """One row for each row of df: id, component_id, for texts whose sets of word shingles have a Jaccard similarity of `similarity` or more.

    Texts of equal sets are one item. A pair meets if one of the fingerprints' keys is equal (see key_bits): with 40 keys of 11 bits that holds for 997 of
    1000 pairs of similarity 0.8; where they meet, whole fingerprints are compared in tiles as above, within a wide radius. That only finds clusters of
    candidates: the links are all pairs of a cluster whose sets of shingles are similar enough, which is computed from the texts."""
    kind = df.schema[id_col].dataType.simpleString()
    radius = wide_radius(similarity, lanes)

    def make():
        def step(batch):
            found = [shingles(x.as_py() or "", words) for x in batch.column(1)]
            return {id_col: batch.column(0), "lanes": pa.array([_lanes(h, lanes).astype("<u8").tobytes() for h in found], pa.binary()), "item": pa.array(map(_set_name, found), pa.int64())}

        return step

    prints = materialize(map_batches(df.select(id_col, valid(F.col(text_col))), make, f"{id_col} {kind}, lanes binary, item long"), "prints")
    items = materialize(prints.groupBy("item").agg(F.min(id_col).alias("first_id"), F.min("lanes").alias("lanes")), "items")

    keys = key_bits(items.count(), similarity, lanes, block_bits)
    count, width = keys.shape

    def bins():
        def step(batch):
            n = batch.num_rows
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(n, -1)
            bits = np.unpackbits(data, axis=1, bitorder="little")
            value = np.stack([bits[:, own] @ (1 << np.arange(width, dtype=np.int64)) for own in keys], axis=1)
            place = (value * count + np.arange(count)).reshape(-1)
            again = pa.array(np.repeat(np.arange(n), count))
            return {"item": batch.column(0).take(again), "lanes": batch.column(1).take(again), "bin": pa.array(place, pa.int64())}

        return step

    binned = map_batches(items.select("item", "lanes"), bins, "item long, lanes binary, bin long")
    found = materialize(_meet(binned, bin_rows, _within(radius, True)), "found")
    clusters = materialize(contracted_components(found).select(F.col("node").alias("item"), F.col("root").alias("bin")), "clusters")

    def named():
        def step(batch):
            return {"item": pa.array([_set_name(shingles(x.as_py() or "", words)) for x in batch.column(0)], pa.int64()), "text": batch.column(0)}

        return step

    def sets():
        def step(batch):
            made = [shingles(x.as_py() or "", words) for x in batch.column(2)]
            return {"bin": batch.column(0), "item": batch.column(1), "n": pa.array(map(len, made), pa.int64()), "lanes": pa.array([h.astype("<u8").tobytes() for h in made], pa.binary())}

        return step

    # the texts of equal sets meet within tasks and then once more, whatever the number of clusters; so copies are no hot keys
    once = map_batches(df.select(valid(F.col(text_col)).alias("text")), named, "item long, text string").groupBy("item").agg(F.first("text").alias("text")).join(clusters, "item")
    members = materialize(map_batches(once.select("bin", "item", "text"), sets, "bin long, item long, n long, lanes binary"), "members")

    def same(left: list[bytes], right: list[bytes] | None, names: np.ndarray) -> list[tuple[int, int]]:
        return jaccard_links([np.frombuffer(x, dtype="<u8") for x in left + (right or [])], names, similarity)

    linked = materialize(_meet(members, cluster_shingles, same, F.col("n")), "links")
    forget(found, clusters, members)
    return _with_components(prints.select(id_col, "item"), items.select("item", "first_id"), linked, id_col)


def _with_components(prints: DataFrame, items: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    rooted = contracted_components(linked).withColumnsRenamed({"node": "item"})
    with_root = materialize(items.join(rooted, "item", "left").select("item", "first_id", F.coalesce("root", "item").alias("root")), "rooted")
    lowest = materialize(with_root.groupBy("root").agg(F.min("first_id").alias("component_id")), "lowest")
    classes = materialize(with_root.join(lowest, "root").select("item", "component_id"), "classes")
    return prints.join(classes, "item").select(id_col, "component_id")
