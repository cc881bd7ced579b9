"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A piece is a row of leaves. Leaf i holds the rank of the pair that starts at symbol i; each inner node holds the
lower rank of its children and, on a tie, the left one. The root therefore names the leftmost pair of lowest rank. A
merge changes two leaves (the pair before, the merged pair) and removes one, each a logarithmic update. It ends when
the root holds no rank.

Many short pieces are merged together as the rows of one array (the same tree, one numpy operation per level); a long
piece gets a tree of its own. Pieces repeat, so their ids are kept in a bounded table per Python worker.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import bounded_batches

#: The published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
#: Pieces over this many bytes get a tree of their own.
LONG = 128
#: Entries of the table of known chunks in each Python worker, and the bytes up to which a chunk is kept there.
KNOWN_CHUNKS, KNOWN_BYTES = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for the 256 bytes: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    found = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        found[chr(256 + n)] = b
    return found


class SegmentTreeBPE:
    """encode(text) and decode(ids) with the vocabulary of a tokenizers JSON file of byte-level BPE."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.first = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.first[byte] = vocab[char]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocab.items()}
        names |= {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.special.items()}
        self.names = [names.get(i, b"") for i in range(max(names) + 1)]
        self.pattern = regex.compile(PATTERN)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative symbol has no pair."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], NO_RANK).astype(np.int32)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most width bytes (a power of two): one tree per row of an array."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        data = np.full((n, width), -1, np.int32)
        data[np.arange(width) < sizes[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        after[after >= sizes[:, None]] = -1
        tree = np.full((n, 2 * width), NO_RANK, np.int32)
        if width > 1:
            tree[:, width : 2 * width - 1] = self._rank(data[:, :-1], data[:, 1:])
        for level in range(width.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        rows = np.flatnonzero(tree[:, 1] < NO_RANK)
        while len(rows):
            node = np.ones(len(rows), np.int64)
            low = tree[rows, 1]
            for _ in range(width.bit_length() - 1):  # down to the leftmost leaf that holds the root's rank
                node = 2 * node + (tree[rows, 2 * node] != low)
            i = node - width
            j = after[rows, i]
            k = after[rows, j]
            data[rows, i] = self.merged[low]
            data[rows, j] = -1
            after[rows, i] = k
            has_next, h = k >= 0, before[rows, i]
            before[rows[has_next], k[has_next]] = i[has_next]
            right = np.where(has_next, data[rows, np.maximum(k, 0)], -1)
            left = np.where(h >= 0, data[rows, np.maximum(h, 0)], -1)
            tree[rows, width + i] = self._rank(data[rows, i], right)
            tree[rows, width + j] = NO_RANK
            has_left = h >= 0
            tree[rows[has_left], width + h[has_left]] = self._rank(left, data[rows, i])[has_left]
            for leaf in (i, j, np.where(has_left, h, i)):
                up = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, up] = np.minimum(tree[rows, 2 * up], tree[rows, 2 * up + 1])
                    up >>= 1
            rows = rows[tree[rows, 1] < NO_RANK]
        kept = data >= 0
        return np.split(data[kept], np.cumsum(kept.sum(1))[:-1])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length: the tree in flat arrays, up to 28 bytes for each byte of the piece."""
        size, width = len(piece), 1
        while width < len(piece):
            width *= 2
        flat = lambda x: array("i", np.asarray(x, np.int32).tobytes())  # noqa: E731  scalars of these are read faster than numpy's
        data = flat(self.first[np.frombuffer(piece, np.uint8)])
        after, before = flat(np.arange(1, size + 1)), flat(np.arange(-1, size - 1))
        after[size - 1] = -1
        none, ranks, merged = int(NO_RANK), self.ranks, self.merged
        leaves = np.full(width, NO_RANK, np.int32)
        leaves[: size - 1] = self._rank(np.array(data, np.int32)[:-1], np.array(data, np.int32)[1:])
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = flat(np.concatenate([[none], *levels[::-1]]))

        def put(leaf: int, rank: int) -> None:
            node = width + leaf
            tree[node] = rank
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a <= b else b
                if tree[node] == low:
                    return
                tree[node] = low

        while tree[1] < none:
            low, node = tree[1], 1
            while node < width:
                node *= 2
                if tree[node] != low:
                    node += 1
            i = node - width
            j = after[i]
            k = after[j]
            data[i] = int(merged[low])
            data[j] = -1
            after[i] = k
            put(j, none)
            if k >= 0:
                before[k] = i
                put(i, ranks.get((data[i] << 32) | data[k], none))
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                put(h, ranks.get((data[h] << 32) | data[i], none))
        ids = np.array(data, np.int32)
        return ids[ids >= 0]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for n, piece in enumerate(pieces):
            if len(piece) > LONG:
                found[n] = self.merge_long(piece).astype("<u4").tobytes()
            elif piece:
                by_width.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(n)
        for width, own in by_width.items():
            for start in range(0, len(own), 1 << 14):
                part = own[start : start + (1 << 14)]
                for n, ids in zip(part, self.merge_rows([pieces[i] for i in part], width), strict=True):
                    found[n] = ids.astype("<u4").tobytes()
        return found

    def _chunks(self, text: str) -> list[str]:
        """Cuts where no piece can cross: before a single space that follows a character that is no space.

        Text with two spaces in a row is cut into pieces at once, since there the pieces depend on what follows.
        """
        if "  " in text:
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *(" " + x for x in rest)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; strings of special tokens give their ids."""
        known, cut, fresh = self.known, [], set()
        for text in texts:
            parts = [text] if self.splitter is None or not any(s in text for s in self.special) else self.splitter.split(text)
            chunks = []
            for part in parts:
                chunks += [part] if part in self.special else self._chunks(part)
            cut.append(chunks)
            fresh.update(chunks)
        fresh = [c for c in fresh if c not in known]
        pieces = [[] if c in self.special else self.pattern.findall(c) for c in fresh]
        distinct = list({p for own in pieces for p in own})
        ids = dict(zip(distinct, self.merge_all([p.encode() for p in distinct]), strict=True))
        now = {c: b"".join(map(ids.__getitem__, own)) for c, own in zip(fresh, pieces, strict=True)}
        for content, token in self.special.items():
            now[content] = np.array([token], "<u4").tobytes()
        if len(known) + len(now) > KNOWN_CHUNKS:
            out = [b"".join([now[c] if c in now else known[c] for c in chunks]) for chunks in cut]
            known.clear()
        else:
            known.update(now)
            out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
            for c in fresh:
                if len(c) > KNOWN_BYTES:
                    del known[c]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> str:
        """The text of ids given as little-endian unsigned 32-bit integers; broken UTF-8 gives replacement characters."""
        names = self.names
        return b"".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, SegmentTreeBPE] = {}


def loaded(path: str) -> SegmentTreeBPE:
    """One encoder for each vocabulary and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = SegmentTreeBPE(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", into: str = "bpe") -> DataFrame:
    """docs with a struct column: ids (little-endian unsigned 32-bit), and the text that they decode to.

    Whole texts are encoded; null counts as empty and gives no ids. vocabulary is a file that every executor has. A
    column of docs named as into is replaced; others stay.
    """
    bounded_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    @F.pandas_udf(kind)
    def both(texts):
        import pandas as pd

        bpe = loaded(vocabulary)
        ids = bpe.encode_batch([t or "" for t in texts])
        return pd.DataFrame({"ids": ids, "decoded": [bpe.decode_bytes(i) for i in ids]})

    return docs.withColumn(into, both(F.col(text_col).cast("string")))


def op4_bpe_segment_tree(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        (F.length("bpe.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("bpe.ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("bpe.decoded"), "UTF-8"), 256).alias("decoded_sha256"),
    )


def sha256_of_ids(ids: list[int]) -> str:
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
