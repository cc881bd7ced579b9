"""SimHash near-duplicates: fingerprints over word shingles, linked by a binary trie joined with itself.

Two fingerprints within b differing bits agree exactly in at least one of b + 1 blocks of their 64 bits. For each
block the fingerprints are rotated so that it comes first and dealt by its value; each task then joins the trie of its
fingerprints with itself: pairs of nodes go down together, one bit at a time, adding up differing bits, with no budget
inside the block and b after it, and a pair is pruned when it exceeds that. A block value that very many distinct
fingerprints share is dealt on by the same rule: its free bits are cut into b + 1 blocks again, one of which must agree.
Copies of a fingerprint count once, so that their number does not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import Scratch, bounded_batches, connected_components, materialize, unused

BITS, BUDGET = 64, 2
SHINGLE = 3
SEED = 42
#: A block value with more distinct fingerprints than this is dealt on by the bits that are still free.
BUCKET = 4096
#: Node pairs that are open at once, and the product of node sizes below which pairs of fingerprints are compared.
FRONTIER, LEAF = 1 << 17, 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: a bit is set if it is in over half of the shingles' hashes. No words: zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    width = min(shingle, len(words))
    stops = (ends[width - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(stops)
    for low in range(0, n, 8192):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[low : low + 8192], stops[low : low + 8192])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed 64-bit integer."""

    @F.pandas_udf(T.LongType())
    def run(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("string"))


def trie_pairs(values: np.ndarray, fixed: int, budget: int):
    """Batches of index pairs (i, j), i < j, of sorted distinct uint64 values that agree in the first fixed bits and
    differ in at most budget bits. The trie's nodes are ranges of the sorted values."""
    n = len(values)
    if n < 2:
        return
    if fixed:
        top = values >> np.uint64(64 - fixed)
        cuts = np.flatnonzero(top[1:] != top[:-1]) + 1
        lows, highs = np.r_[0, cuts], np.r_[cuts, n]
    else:
        lows, highs = np.array([0]), np.array([n])
    many = highs - lows > 1
    lows, highs = lows[many], highs[many]
    stack = [(fixed, lows[i : i + FRONTIER], highs[i : i + FRONTIER], lows[i : i + FRONTIER], highs[i : i + FRONTIER], np.zeros(len(lows[i : i + FRONTIER]), np.int8)) for i in range(0, len(lows), FRONTIER)]

    def split(low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
        """First index of the range whose bit is set."""
        prefix = values[low] & ~np.uint64((int(bit) << 1) - 1)
        return np.clip(np.searchsorted(values, prefix | bit), low, high)

    while stack:
        depth, al, ah, bl, bh, diff = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack.append((depth, al[half:], ah[half:], bl[half:], bh[half:], diff[half:]))
            al, ah, bl, bh, diff = al[:half], ah[:half], bl[:half], bh[:half], diff[:half]
        small = (ah - al) * (bh - bl) <= LEAF
        if depth >= 64:
            small[:] = True
        if small.any():
            la, lb, hb = al[small], bl[small], bh[small]
            na, nb = ah[small] - la, hb - lb
            of = np.repeat(np.arange(len(la)), na * nb)
            within = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            i, j = la[of] + within // nb[of], lb[of] + within % nb[of]
            near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            al, ah, bl, bh, diff = al[~small], ah[~small], bl[~small], bh[~small], diff[~small]
        if not len(al):
            continue
        bit = np.uint64(1 << (63 - depth))
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        same = al == bl
        kids = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am[~same], ah[~same], bl[~same], bm[~same], diff[~same] + 1)]
        al, ah, bl, bh, diff = (np.concatenate([k[x] for k in kids]) for x in range(5))
        live = (ah > al) & (bh > bl) & (diff <= budget) & ~((al == bl) & (ah - al < 2))
        if live.any():
            stack.append((depth + 1, al[live], ah[live], bl[live], bh[live], diff[live].astype(np.int8)))


def local_roots(n: int, batches) -> np.ndarray:
    """The smallest index that each of n indexes reaches by the pairs."""
    root = np.arange(n)
    for i, j in batches:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def _rotated(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Moves the bits of each mask to the top, in order; the other bits follow. All masks are equal."""
    mask = int(masks[0])
    order = [b for b in range(63, -1, -1) if mask >> b & 1] + [b for b in range(63, -1, -1) if not mask >> b & 1]
    out = np.zeros_like(values)
    for to, b in enumerate(order):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - to)
    return out


def _blocks(free: list[int], parts: int) -> list[int]:
    """Masks of the free bits cut into as many runs as parts."""
    edges = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in free[edges[i] : edges[i + 1]]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    """The rows once for each mask, with the bits of fp under it."""
    return rows.select("*", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))


def _trie_tasks(distinct: DataFrame, task, schema: str, budget: int, bucket: int, always: int) -> DataFrame:
    """What task makes of the fingerprints (fp and other columns of numbers) of a table that share a block of bits.

    Any two within budget bits of one another (and equal in the bits of always) meet in some task. A block value of more
    than bucket fingerprints is dealt on by the bits that are still free. task gets, for each mask, the sorted distinct
    fingerprints turned so that the mask's bits come first, a list of their other columns, the number of those bits, and
    the mask; it gives columns of numbers.
    """
    bounded_batches(distinct.sparkSession)
    parts, done, columns = [], [], distinct.columns
    free = lambda mask: [b for b in range(63, -1, -1) if not mask >> b & 1]
    waiting = _dealt(distinct, [always | m for m in _blocks(free(always), budget + 1)])
    while True:  # what is dealt first is not kept, as distinct is a table; of what is dealt on, the crowded rows are
        crowded = materialize(waiting.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket))
        masks = [r[0] & (2**64 - 1) for r in crowded.select("mask").distinct().collect()]  # at most (budget + 1) ** rounds
        masks = [m for m in masks if len(free(m)) > 12]  # else there are 4096 values at most
        if not masks:
            done.append(waiting)
            break
        crowded = crowded.where(F.col("mask").isin([_signed(m) for m in masks])).drop("n")
        done.append(waiting.join(crowded, ["mask", "value"], "left_anti"))
        again = materialize(waiting.join(crowded, ["mask", "value"], "left_semi").select(*columns, "mask"))
        finer = [(_signed(m), [_signed(m | x) for x in _blocks(free(m), budget + 1)]) for m in masks]
        finer = F.broadcast(distinct.sparkSession.createDataFrame(finer, "mask long, finer array<long>"))
        waiting = again.join(finer, "mask").select(*columns, F.explode("finer").alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))

    names = [x.split()[0] for x in schema.split(", ")]

    def join(batches):
        import pyarrow as pa

        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        fps, masks, *others = (np.concatenate(x) for x in zip(*held, strict=True))
        fps, masks = fps.view(np.uint64), masks.view(np.uint64)
        for mask in np.unique(masks):
            here = masks == mask
            own, first = np.unique(fps[here], return_index=True)
            turned = _rotated(own, np.array([mask]))
            order = np.argsort(turned)
            columns = task(own[order].view(np.int64), turned[order], [x[here][first][order] for x in others], int(mask).bit_count(), int(mask))
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for rows in done:
        parts.append(rows.repartition("mask", F.col("fp").bitwiseAND(F.col("mask"))).select("fp", "mask", *[c for c in columns if c != "fp"]).mapInArrow(join, schema))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def near_edges(distinct: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges between distinct fingerprints (column fp of a table) that connect what lies within budget bits.

    Not all pairs: in each task a fingerprint is tied to the first, in the trie's order, of those that it reaches there,
    so that there are at most budget + 1 edges for each fingerprint at each round of dealing.
    """

    def tie(values, turned, others, fixed, mask):
        root = local_roots(len(turned), trie_pairs(turned, fixed, budget))
        tied = np.flatnonzero(root != np.arange(len(root)))
        return values[tied], values[root[tied]]

    return _trie_tasks(distinct.select("fp", F.lit(1).cast("long").alias("weight")), tie, "u long, v long", budget, bucket, 0).distinct()


def near_keys(distinct: DataFrame, budget: int, always: int, bucket: int = BUCKET) -> DataFrame:
    """(key, fp): fingerprints (fp, weight: how often, low: the least that has it) that reach one another within a task by
    steps of at most budget bits, under the least low among them. Any two that are that near share a key; what is under a
    key in a task stands for two at least, by weight."""

    def name(values, turned, others, fixed, mask):
        weights, lows = others
        root = local_roots(len(turned), trie_pairs(turned, fixed, budget))
        shared = np.flatnonzero(np.bincount(root, weights, len(root))[root] > 1)
        least = lows.copy()
        np.minimum.at(least, root, lows)
        return least[root[shared]], values[shared]

    return _trie_tasks(distinct.select("fp", "weight", "low"), name, "key long, fp long", budget, bucket, always)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable by links of at most budget bits.

    Texts without words share fingerprint zero and are linked like any other. Null texts count as empty; null ids never
    name a group unless it has no other. Repeated rows stay. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    marked = materialize(docs.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    distinct = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("low")))
    roots = connected_components(near_edges(distinct.select("fp"), budget))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(materialize(named), "fp").select(id_col, "fp", "component_id")


#: Wide fingerprints, for texts: so many parts, each the key of a trie join of its own.
PARTS = 60
#: (rows up to, bits of a part, differing bits): each finds a pair at a Jaccard similarity of 0.8 with a probability of
#: 0.12 or 0.13 (so that all parts miss it with 0.0006 at most, and at 0.82 with 0.0001), while a row has few strangers.
WIDTHS = ((2_000_000, 32, 2), (25_000_000, 40, 3), (300_000_000, 48, 4), (1 << 62, 56, 5))
#: Wide fingerprints exclude a pair only beyond so many standard deviations. Of a text with under FEW shingles and another the
#: expected share can be greater, by 1.24 at most (0.1875 for 4 shingles and 5 at a similarity of 0.8, by enumeration); and
#: they share a shingle of their prefixes (a fifth of each set, in the order of the hashes).
MARGIN, FEW, SMALL = 5, 64, 1.25
#: Texts, and shingles, that are compared with as many others at once.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Members and shingles of an array in which members travel to the blocks that compare them.
PACK, PACK_SHINGLES = 64, 1 << 16
#: Members of a key up to which keys are put together whatever their pairs.
HUB = 64
#: Of the candidates' keys one in so many goes first: near copies meet in dozens of keys, of which a few connect most.
SHARES = 8


_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: of its words, by their bytes, and of each run of these."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode().translate(_LOWER)
    data = np.frombuffer(raw + bytes(8), np.uint8)
    space = _SPACE[data[: len(raw)]]
    edges = np.diff(space, prepend=True, append=True).nonzero()[0]
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.empty(0, np.uint64)
    eight = np.ndarray(len(raw) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
    words = _mixed(size.astype(np.uint64) + np.uint64(seed))
    left, at = np.flatnonzero(size <= LONG_WORD), 0
    while len(left):
        words[left] = _mixed(words[left] ^ (eight[start[left] + at] & _MASKS[np.minimum(size[left] - at, 8)])) + np.uint64(at)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        words[k] = xxh64_intdigest(raw[start[k] : start[k] + size[k]], seed)
    width = min(shingle, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out + words[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(_mixed(out))


def wide_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of words * 64 bits as unsigned words: each hash is drawn out to as many bits."""
    counts, n = np.zeros(64 * words, np.int64), len(hashes)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for low in range(0, n, 4080):
        x = _mixed(hashes[low : low + 4080, None] + steps)
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # in bytes, which add up fastest
            counts += bits[k : k + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").astype(np.uint64)


def parts_of(wide: np.ndarray, bits: int) -> np.ndarray:
    """The fingerprint's parts of so many bits (a multiple of eight), each under its number."""
    rows = np.zeros((PARTS, 8), np.uint8)
    rows[:, : bits // 8] = wide.astype("<u8").view(np.uint8)[: PARTS * bits // 8].reshape(PARTS, -1)
    return (rows.view("<u8").ravel() | (np.arange(PARTS, dtype=np.uint64) << np.uint64(56))).view(np.int64)


def prefix_of(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Of sorted hashes those of which two sets of at least this similarity share one."""
    n = len(hashes)
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0]


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two SimHashes whose shingle sets (of one size) have this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def alike_prints(left: list[tuple], right: list[tuple], similarity: float, bits: int) -> np.ndarray:
    """Which pairs of (size, fingerprint) their sizes and fingerprints leave open, as a matrix."""
    share = differing_share(similarity)
    most = [int(bits * p + MARGIN * np.sqrt(bits * p * (1 - p))) for p in (share, SMALL * share)]
    s, t = (np.array([x[0] for x in side], float) for side in (left, right))
    a, b = (np.stack([np.frombuffer(x[1], "<u8") for x in side]) for side in (left, right))
    few, many = np.minimum(s[:, None], t), np.maximum(s[:, None], t)
    limit, near = np.where(few < FEW, most[1], most[0]), np.zeros(few.shape, bool)
    step = max(1, (1 << 20) // max(1, b.size))
    for i in range(0, len(a), step):
        near[i : i + step] = np.bitwise_count(a[i : i + step, None] ^ b).sum(2, dtype=np.int32) <= limit[i : i + step]
    return near & (few >= similarity * many - 1e-9)


def alike_sets(left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets (sorted distinct hashes) have at least this Jaccard similarity, as a matrix."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    both = np.zeros((len(left), len(right)))
    if len(left) * len(right) <= 16:
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                both[i, j] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum() if len(x) and len(y) else 0
    else:
        flat = [np.concatenate(side) for side in (left, right)]
        shared = np.intersect1d(*map(np.unique, flat), assume_unique=True)
        at = []
        for side, n in zip(flat, sizes, strict=True):
            place = np.searchsorted(shared, side)
            here = np.flatnonzero(shared[np.minimum(place, len(shared) - 1)] == side) if len(shared) else np.zeros(0, np.int64)
            column, row = place[here], np.repeat(np.arange(len(n)), n)[here]
            order = np.argsort(column, kind="stable")
            at.append((column[order], row[order]))
        for low in range(0, len(shared), 4096):
            slabs = []
            for (column, row), n in zip(at, sizes, strict=True):
                cut = slice(*np.searchsorted(column, (low, low + 4096)))
                slab = np.zeros((len(n), min(4096, len(shared) - low)), np.float32)
                slab[row[cut], column[cut] - low] = 1
                slabs.append(slab)
            both += slabs[0] @ slabs[1].T
    return both >= similarity * np.maximum(sizes[0][:, None] + sizes[1] - both, 1) - 1e-9


def _compared(dealt: DataFrame, prepare, alike) -> DataFrame:
    """(u, v) that tie each root of a block to the least that it reaches by the links found in the block.

    dealt: key, a, b (the block), side (1 left, 2 right, 3 both) and packs of members, as arrays of structs of n, its root
    so far, and the columns that prepare makes an item of; alike gives the matrix of links of two lists of items. A block
    has at most two chunks of members. What is connected before is not tied again.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    bounded_batches(dealt.sparkSession)

    def run(batches):
        import pyarrow as pa

        def links(ns, sides, items):
            names, own = np.unique(np.array(ns, np.int64), return_inverse=True)
            left, right = (np.array([k for k, side in enumerate(sides) if side & flag]) for flag in (1, 2))
            if len(names) < 2 or not len(left) or not len(right):
                return [], []
            i, j = np.nonzero(alike([items[k] for k in left], [items[k] for k in right]))
            root = local_roots(len(names), [(own[left[i]], own[right[j]])])
            tied = np.flatnonzero(root != np.arange(len(names)))
            return names[tied].tolist(), names[root[tied]].tolist()

        def blocks():
            key, ns, sides, items = None, [], [], []  # ns: the members' roots
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for k, a, b, side, pack in zip(*columns, strict=True):
                    if (k, a, b) != key:
                        yield ns, sides, items
                        key, ns, sides, items = (k, a, b), [], [], []
                    for member in pack:
                        _, root, *rest = member.values()
                        ns.append(root)
                        sides.append(side)
                        items.append(prepare(*rest))
            yield ns, sides, items

        u, v = [], []
        for block in blocks():
            x, y = links(*block)
            u += x
            v += y
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    together = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return together.mapInArrow(run, StructType([StructField("u", LongType()), StructField("v", LongType())]))


def linked(members: DataFrame, items: DataFrame, prepare, alike, scratch: Scratch, chunk: int = CHUNK, chunk_weight: int = CHUNK_SHINGLES, shares: int = 1) -> DataFrame | None:
    """(node, root) of what the links between members (key, n, weight) of one key connect, or None without links.

    items (n and columns): what prepare and alike need of a member. A key's members are cut into chunks. Those of the first
    chunk are compared with all; then those that are not yet connected with most of the key's members are compared with
    all of them. So every two members of a key are compared or known to be connected, and no pair is ever a row.

    shares: with more than one, that part of the keys goes first; keys whose members it has all connected are then left
    out, and of the others only what is not connected yet gives rows. For members that share many keys.
    """
    fields = [c for c in items.columns if c != "n"]
    chunks = F.ceil(F.greatest(F.count("*") / chunk, F.sum("weight") / chunk_weight)).cast("int").alias("chunks")
    packs = F.ceil(F.greatest(F.count("*") / PACK, F.sum("weight") / PACK_SHINGLES)).alias("packs")
    sizes = scratch.table(members.groupBy("key").agg(chunks, packs, F.count("*").alias("m")).where("m > 1"))
    own = F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int")

    def packed(rows: DataFrame, at: str, *others: str) -> DataFrame:
        """The rows (key, n, chunks, packs) of each chunk at in a few arrays: what several blocks need is repeated as these."""
        pack = F.pmod(F.xxhash64("n", F.lit(2)), F.ceil(F.col("packs") / F.col("chunks")).cast("int")).alias("part")
        full = rows.select("key", at, "chunks", *others, pack, "n", "root").join(items, "n")
        return full.groupBy("key", at, "chunks", *others, "part").agg(F.collect_list(F.struct("n", "root", *fields)).alias("pack"))

    deal = lambda x: scratch.table(_compared(x.select("key", "a", "b", "side", "pack"), prepare, alike))

    def rooted(keys: DataFrame, roots: DataFrame | None) -> DataFrame:
        """The members of keys, each with its root so far."""
        rows = members.join(keys, "key").select("key", "n", "chunks", "packs", own.alias("own"))
        if roots is None:
            return rows.withColumn("root", F.col("n"))
        return rows.join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))

    def connected(links: DataFrame, roots: DataFrame | None) -> DataFrame | None:
        """The roots by links as well."""
        if links.isEmpty():
            return roots
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        return connected_components(links, into=scratch)

    b = F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own")))
    early = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shares)) == 0
    roots = None
    for keys in [sizes] if shares == 1 else [sizes.where(early), sizes.where(~early)]:
        rows = rooted(keys, roots)
        if roots is not None:
            rows = scratch.table(rows)
            rows = rows.join(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), "key")
        star = packed(rows, "own").select("key", F.lit(0).alias("a"), b.alias("b"), "own", "pack")
        star = star.withColumn("side", F.when(F.col("own") > 0, 2).when(F.col("b") == 0, 3).otherwise(1))
        roots = connected(deal(star), roots)
    large = scratch.table(sizes.where("chunks > 1"))
    if large.isEmpty():
        return roots
    rows = scratch.table(rooted(large, roots))
    most = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.first("chunks").alias("chunks"))
    most = most.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("m"), F.first("chunks").alias("chunks"))
    left = F.col("m") - F.col("top.c")
    most = scratch.table(most.where(left > 0).select("key", F.col("top.root").alias("top"), F.least(F.col("chunks"), F.ceil(left * F.col("chunks") / F.col("m"))).cast("int").alias("leaders")))
    rows = rows.join(most, "key")
    right = packed(rows, "own", "leaders").select("key", F.explode(F.sequence(F.lit(0), F.col("leaders") - 1)).alias("a"), F.col("own").alias("b"), F.lit(2).alias("side"), "pack")
    lead = packed(rows.where("root <> top").withColumn("a", F.pmod(F.xxhash64("n", F.lit(1)), F.col("leaders")).cast("int")), "a")
    lead = lead.select("key", "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("b"), F.lit(1).alias("side"), "pack")
    return connected(deal(right.unionByName(lead)), roots)


def fewer_keys(members: DataFrame, scratch: Scratch, small: int = HUB) -> DataFrame:
    """(key, n) in fewer rows, for a table of distinct (key, n) with keys among the n: two members of a key still share one.

    Near copies meet in many keys with much the same members. The key of n goes into the least key that has n as a member,
    with all its members, where that makes no more pairs than the keys had, or at most small members.
    """
    tops = scratch.table(members.groupBy(F.col("n").alias("hub")).agg(F.min("key").alias("top")))
    m = F.count("*").cast("double")
    work = members.groupBy("key").agg(m.alias("m")).join(tops, F.col("key") == F.col("hub")).groupBy("top").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
    rows = scratch.table(members.join(tops, F.col("key") == F.col("hub")).groupBy("top", "n").agg(F.collect_set("key").alias("keys")))
    whole = rows.groupBy("top").agg(m.alias("m")).join(work, "top")
    whole = scratch.table(whole.where((F.col("m") <= small) | (F.col("m") * F.col("m") <= F.col("work"))).select("top", F.lit(True).alias("whole")))
    keys = F.when(F.col("whole"), F.array("top")).otherwise(F.col("keys"))
    return rows.join(whole, "top", "left").select(F.explode(keys).alias("key"), "n").distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, broadcast_limit: int = 64 << 20) -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest id; its columns stay as they are.

    Two texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8 or more; groups are
    closed under links. Wide SimHashes of the sets are cut into PARTS parts, and the distinct values of each part go
    through the trie join; candidates are near in some part, or in a prefix of small sets. Whole fingerprints then, with
    a margin, leave candidate groups, and in these every two texts that nothing connects yet are compared by their sets.
    Texts without words are copies of one another. Rows that share the id that stays all stay, and rows without an id are
    dropped only for a row with one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    key, sketch, digest, tag = unused(docs, "_key", "_sketch", "_digest", "_tag")
    count = docs.count()
    bits, budget = next((b, d) for most, b, d in WIDTHS if count <= most)
    words = -(-PARTS * bits // 64)

    @F.pandas_udf("digest binary, size long, wide binary, parts array<long>")
    def run(texts):
        import pandas as pd
        from xxhash import xxh3_128_digest

        out = []
        for text in texts:
            hashes = shingle_hashes(text, shingle)
            wide = wide_of(hashes, words)
            parts = parts_of(wide, bits) if len(hashes) else np.zeros(0, np.int64)
            if 0 < len(hashes) <= FEW / similarity:
                parts = np.concatenate([parts, (prefix_of(hashes, similarity) | np.uint64(1 << 63)).view(np.int64)])
            out.append((xxh3_128_digest(hashes.tobytes()), len(hashes), wide.astype("<u8").tobytes(), parts))
        return pd.DataFrame(out, columns=["digest", "size", "wide", "parts"])

    with Scratch(spark) as scratch:
        marked = docs.withColumn(sketch, run(F.col(text_col).cast("string")))
        marked = scratch.kept(marked.select(*docs.columns, sketch, F.col(f"{sketch}.digest").alias(digest), F.monotonically_increasing_id().alias(tag)))
        one = lambda name: F.first(f"{sketch}.{name}").alias(name)
        prints = marked.groupBy(F.col(digest).alias("digest")).agg(F.min(id_col).alias("low"), F.min(tag).alias("n"), one("size"), one("wide"), one("parts"))
        prints = scratch.table(prints)

        # candidates: near in a part of the fingerprint, or one shingle in common in the prefixes of small sets
        values = prints.select("n", F.explode("parts").alias("fp"))
        distinct = scratch.table(values.groupBy("fp").agg(F.count("*").alias("weight"), F.min("n").alias("low")))
        near = near_keys(distinct.where("fp >= 0"), budget, ((1 << 64) - (1 << bits)))
        keys = scratch.table(near.unionByName(distinct.where("fp < 0 AND weight > 1").select(F.col("low").alias("key"), "fp")).distinct())
        members = scratch.table(values.join(keys, "fp").select("key", "n").distinct())
        members = scratch.table(fewer_keys(members, scratch).withColumn("weight", F.lit(1)))
        roots = linked(members, prints.select("n", "size", "wide"), lambda size, wide: (size, wide), lambda x, y: alike_prints(x, y, similarity, 64 * words), scratch, shares=SHARES)

        # in the groups that this leaves: the sets themselves
        if roots is not None:
            group = roots.select(F.col("root").alias("key"), F.col("node").alias("n"))
            texts = marked.select(F.col(tag).alias("n"), F.col(text_col).cast("string").alias("text")).join(group.select("n"), "n")
            members = scratch.table(group.join(prints.select("n", F.col("size").alias("weight")), "n"))
            roots = linked(members, texts, lambda text: shingle_hashes(text, shingle), lambda x, y: alike_sets(x, y, similarity), scratch)

        named = prints.select("n", "digest", "low")
        if roots is None:
            named = named.withColumn("root", F.col("n"))
        else:
            named = named.join(roots.withColumnRenamed("node", "n"), "n", "left").withColumn("root", F.coalesce("root", "n"))
        least = scratch.table(named.groupBy("root").agg(F.min("low").alias("stays")))
        named = scratch.table(named.join(least, "root").select(F.col("digest").alias(digest), "stays"))
        drop = marked.select(F.col(id_col).alias(key), F.col(digest)).join(named, digest)
        drop = scratch.kept(drop.where(~F.col(key).eqNullSafe(F.col("stays"))).select(key, digest).distinct())
    small = drop.count() * 80 <= broadcast_limit
    gone = (F.broadcast(drop) if small else drop).withColumnRenamed(digest, f"{digest}2")
    return marked.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(f"{digest}2")), "left_anti").select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
