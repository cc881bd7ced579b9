"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured: a random rotation cuts a vector into blocks, each block has a small code of random unit
vectors, and a direction is one code word from every block. A vector is list-decoded to all directions whose cap it lies
in (inner product at least the cap's height), block by block, leaving out what cannot reach the height any more. Vectors
that share a direction are compared in double precision; a pair is counted at the lowest direction that both share.

The cap's height follows the number of vectors, so that a direction holds about BUCKET of them whatever that number is;
the number of directions follows from the recall wanted at the similarity threshold. A direction that holds far more (a
large group of near copies) is cut into chunks that are compared chunk by chunk in tasks of their own. Vectors that are
equal are compared once.

Vectors are decoded once. What is dealt out by direction are their numbers and sketches of SKETCH sign bits; only those
that have a vector with a like sketch beside them (with a margin of MARGIN standard deviations) are dealt out whole.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import Scratch, bounded_batches, connected_components, materialize
from bandweave.llm.simhash import local_roots

THRESHOLD = 0.9
#: Vectors that a direction's cap should hold, and those beyond which its vectors are cut into chunks.
BUCKET, CHUNK = 48, 1024
#: Chance, for a pair at the threshold, of sharing no direction, as the normal model has it.
MISSED = 0.0005
#: Product codes side by side.
CODES = 6
SEED = 17
SKETCH, MARGIN = 128, 5


class CapCode:
    """The filter directions for vectors of one length; the same for the same arguments on every machine.

    Several codes with rotations of their own are used side by side: within one product code the caps that a vector
    lies in vary much in number, over several codes far less.
    """

    def __init__(self, size: int, height: float, words: int, blocks: int, codes: int = CODES, seed: int = SEED):
        self.blocks, self.words, self.least = blocks, words, height * math.sqrt(blocks)
        edges = [round(i * size / blocks) for i in range(blocks + 1)]
        self.codes = []
        for k in range(codes):
            rng = np.random.default_rng([seed, size, words, k])
            rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
            parts = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                code = rng.standard_normal((words, b - a))
                parts.append(rotation[:, a:b] @ (code / np.linalg.norm(code, axis=1, keepdims=True)).T)
            self.codes.append(parts)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) pairs, ordered by row, of unit vectors; all caps that a vector lies in.

        A vector in no cap of a code is given that code's best direction, so that each is indexed.
        """
        rows, directions = [], []
        for k, parts in enumerate(self.codes):
            sums = [unit @ part for part in parts]
            rest = np.zeros((self.blocks + 1, len(unit)))
            for i in range(self.blocks - 1, -1, -1):
                rest[i] = rest[i + 1] + sums[i].max(1)
            least = np.minimum(self.least, rest[0] - 1e-12)
            row, direction, total = np.arange(len(unit)), np.full(len(unit), k, np.int64), np.zeros(len(unit))
            for i, own in enumerate(sums):
                reach = total[:, None] + own[row]
                at, word = np.nonzero(reach + rest[i + 1][row][:, None] >= least[row][:, None])
                row, direction, total = row[at], direction[at] * self.words + word, reach[at, word]
            rows.append(row)
            directions.append(direction)
        row, direction = np.concatenate(rows), np.concatenate(directions)
        order = np.argsort(row, kind="stable")
        return row[order], direction[order]


def _cap_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a unit vector with a random direction, descending, and the share of directions from there on."""
    u = np.linspace(1, -1, 4001)
    mass = np.maximum(1 - u * u, 1e-300) ** ((size - 3) / 2)
    share = np.cumsum(mass)
    return u, share / share[-1]


def plan(n: int, size: int, threshold: float = THRESHOLD) -> tuple[float, int, int]:
    """(height of the caps, code words of each block, blocks) for n vectors of a length."""
    u, share = _cap_table(size)
    least = min(0.02, BUCKET / max(n, 1))
    at = max(int(np.searchsorted(share, least)), int(np.searchsorted(-u, -threshold)))  # no cap narrower than a link
    height, least = float(u[at]), float(share[at])
    # of vectors in a cap, the share whose neighbour at the threshold is in it too
    inside = np.diff(share[: at + 1], prepend=0.0)
    needed = (height - threshold * u[: at + 1]) / np.sqrt((1 - threshold**2) * np.maximum(1 - u[: at + 1] ** 2, 1e-12))
    v, other = _cap_table(max(4, size - 1))
    both = float((inside * np.interp(-needed, -v, other)).sum() / inside.sum())
    directions = math.log(1 / MISSED) / max(both, 0.02) / least / CODES
    blocks = 1 if size < 8 else 2 if size < 32 or directions <= 1 << 28 else 4
    return height, max(3, math.ceil(directions ** (1 / blocks))), blocks


@lru_cache(maxsize=64)
def _code(n: int, size: int, threshold: float) -> CapCode:
    return CapCode(size, *plan(n, size, threshold))


@lru_cache(maxsize=64)
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, SKETCH))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Of each vector the signs of its products with fixed random vectors, as two words."""
    return np.packbits(unit @ _signs(unit.shape[1]) > 0, axis=1, bitorder="little").view("<i8")


def sketch_limit(threshold: float) -> int:
    """Differing bits of two sketches up to which their vectors may be linked."""
    share = math.acos(threshold) / math.pi
    return int(SKETCH * share + MARGIN * math.sqrt(SKETCH * share * (1 - share)))


def packed(v: np.ndarray) -> bytes:
    """A vector without loss: in single precision where that is exact, else in double."""
    low = v.astype("<f4")
    return b"\4" + low.tobytes() if (low == v).all() else b"\x08" + v.astype("<f8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[0] == 4 else "<f8", offset=1).astype(float)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _first_here(rows: list[np.ndarray], cols: list[np.ndarray], here: int) -> np.ndarray:
    """For each pair of direction lists, whether they share no direction lower than here."""
    flat = np.concatenate([*rows, *cols])
    who = np.repeat(np.arange(len(rows) + len(cols)), [len(x) for x in (*rows, *cols)])
    low = flat < here
    names, inverse, counts = np.unique(flat[low], return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    who, inverse = who[low][often], inverse[often]
    _, inverse = np.unique(inverse, return_inverse=True)
    shared, width = np.zeros((len(rows), len(cols)), bool), int(inverse.max()) + 1 if len(inverse) else 0
    for start in range(0, width, 1024):
        own = (inverse >= start) & (inverse < start + 1024)
        marks = np.zeros((len(rows) + len(cols), min(1024, width - start)), np.float32)
        marks[who[own], inverse[own] - start] = 1
        shared |= marks[: len(rows)] @ marks[len(rows) :].T > 0
    return ~shared


def _compare(here: int, left: list, right: list | None, threshold: float):
    """(n, n_links, root) of the vectors (n, copies, vector, directions) of a direction: all pairs, or those across."""
    both = left if right is None else [*left, *right]
    unit = _units(np.stack([unpacked(r[2]) for r in both]))
    copies = np.array([r[1] for r in both])
    at = len(left) if right is not None else 0
    close = (unit[: len(left)] @ unit[at:].T) >= threshold
    if right is None:
        close = np.triu(close, 1)
    if not close.any():
        return
    lists = [np.asarray(r[3], np.int64) for r in both]
    i, j = np.nonzero(close & _first_here(lists[: len(left)], lists[at:], here))
    j = j + at
    if not len(i):
        return
    links = np.bincount(i, copies[j], len(both)) + np.bincount(j, copies[i], len(both))
    order = np.argsort([r[0] for r in both])
    rank = np.empty(len(both), np.int64)
    rank[order] = np.arange(len(both))
    root = local_roots(len(both), [(rank[i], rank[j])])
    for k in np.flatnonzero(links):
        yield both[k][0], int(links[k]), both[order[root[rank[k]]]][0]


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of table.

    n_links: other rows linked directly, copies included; component_id: the smallest id reachable by links, itself
    included; kept: id = component_id. A vector that is null, empty, zero or has null or non-finite components links with
    nothing, nor do vectors of different lengths. Rows that repeat an id and vector link with each other; null ids are
    listed but never name a group that has another. Ids are of any type with an order; other columns are not passed on. An
    empty table gives an empty result.
    """
    spark = table.sparkSession
    bounded_batches(spark)
    x = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    usable = finite & F.exists(x, lambda v: v != 0)
    rows = table.select(F.col(id_col).alias("id"), F.when(usable, x).alias("x"))

    def pack(batches):
        """Vectors as bytes, halved or doubled by powers of two so that no square can overflow."""
        import pyarrow as pa

        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                if v is None:
                    out.append(None)
                    continue
                v = np.array(v) + 0.0
                out.append(packed(np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    rows = materialize(rows.mapInArrow(pack, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("v", T.BinaryType())])))
    alone = rows.where("v IS NULL")
    distinct = materialize(rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("id").alias("low")).withColumn("n", F.monotonically_increasing_id()))
    count = distinct.count()

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            ns, copies, data = (batch.column(i).to_pylist() for i in range(3))
            vectors = list(map(unpacked, data))
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(k)
            for size, own in by_size.items():
                for start in range(0, len(own), 512):
                    part = own[start : start + 512]
                    unit = _units(np.stack([vectors[k] for k in part]))
                    row, direction = _code(count, size, threshold).decode(unit)
                    direction = direction * 4096 + size % 4096
                    lists = np.split(direction, np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                    marks = sketches(unit)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ns[k] for k in part], pa.int64()),
                            pa.array([copies[k] for k in part], pa.int64()),
                            pa.array([data[k] for k in part], pa.binary()),
                            pa.array([np.sort(x) for x in lists], pa.list_(pa.int64())),
                            pa.array(marks[:, 0]),
                            pa.array(marks[:, 1]),
                        ],
                        names=["n", "copies", "v", "keys", "s", "t"],
                    )

    with Scratch(spark) as scratch:
        decoded = scratch.table(distinct.select("n", "copies", "v").mapInArrow(decode, "n long, copies long, v binary, keys array<long>, s long, t long"))
        coded = decoded.select("n", "s", "t", F.explode("keys").alias("direction"))
        sizes = decoded.select(F.explode("keys").alias("direction")).groupBy("direction").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK)
        chunks = scratch.table(sizes.select("direction", F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")))
        few = chunks.limit(100_001).count() <= 100_000  # at most a few MB
        coded = coded.join(F.broadcast(chunks) if few else chunks, "direction", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        coded = coded.withColumn("own", F.pmod(F.xxhash64("n"), F.col("chunks")).cast("int"))
        coded = coded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        coded = coded.select("direction", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "n", "s", "t")
        most = sketch_limit(threshold)

        def blocks(batches):
            """Columns of each block (direction, a, b), which comes sorted."""
            rest: list = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if rest:
                    columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
                new = np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])) + 1
                edges = [0, *new.tolist()]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    yield [c[x:y] for c in columns]
                rest = [c[edges[-1] :] for c in columns]
            if rest:
                yield rest

        def prune(batches):
            """The rows of a block that have one with a like sketch in it."""
            import pyarrow as pa

            held, size = [], 0
            for block in blocks(batches):
                direction, a, b, own, n, *marks = block
                if len(n) < 2:
                    continue
                words = np.stack(marks, 1).view(np.uint64)
                left = np.flatnonzero(own == a[0])
                right = left if a[0] == b[0] else np.flatnonzero(own == b[0])
                near = np.bitwise_count(words[left, None] ^ words[right]).sum(2, dtype=np.int16) <= most
                if a[0] == b[0]:
                    np.fill_diagonal(near, False)
                kept = np.union1d(left[near.any(1)], right[near.any(0)])
                if len(kept):
                    held.append([c[kept] for c in block[:5]])
                    size += len(kept)
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["direction", "a", "b", "own", "n"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=["direction", "a", "b", "own", "n"])

        def compare(batches):
            import pyarrow as pa

            out = []
            for block in blocks(batches):
                direction, a, b, own = (c[0] for c in block[:4])
                held = list(zip(block[3].tolist(), zip(*(c.tolist() for c in block[4:]), strict=True), strict=True))
                left = [r for own, r in held if own == a]
                right = None if a == b else [r for own, r in held if own == b]
                if left and (right is None or right):
                    out += _compare(direction, left, right, threshold)
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["n", "links", "root"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["n", "links", "root"])

        dealt = coded.repartition("direction", "a", "b").sortWithinPartitions("direction", "a", "b")
        left = scratch.table(dealt.mapInArrow(prune, "direction long, a int, b int, own int, n long"))
        whole = left.join(decoded.select("n", "copies", "v", "keys"), "n").select("direction", "a", "b", "own", "n", "copies", "v", "keys")
        whole = whole.repartition("direction", "a", "b").sortWithinPartitions("direction", "a", "b")
        found = materialize(whole.mapInArrow(compare, "n long, links long, root long"))
    links = found.groupBy("n").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("n").alias("u"), F.col("root").alias("v")))
    named = distinct.select("n", "v", "copies", "low").join(links, "n", "left").join(roots.withColumnRenamed("node", "n"), "n", "left")
    named = named.withColumn("root", F.coalesce("root", "n"))
    least = materialize(named.groupBy("root").agg(F.min("low").alias("component_id")))
    named = materialize(named.join(least, "root").select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.where("v IS NOT NULL").join(named, "v").select("id", "n_links", "component_id")
    whole = linked.unionByName(alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return whole.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_cap_filters(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs; the filters' recall is a little under one, so that tables with links at the threshold itself may differ.
ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.9
), r(vec_id, root) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id
), c AS (
  SELECT vec_id, min(root) AS component_id FROM r GROUP BY 1
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
