"""Bounded-space online packing of token sequences into windows.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fits best; when none has
room, the fullest is emitted and a new one opened. A document longer than a window is cut into whole windows and a
remainder. Where the fullest window's gap is at least min_cut tokens, the piece's head fills the gap before the window
goes out. The windows still open at the end of the partitions are merged: those of MERGE_PARTITIONS partitions
at a time are packed once more, cut wherever a window fills up. Only these leftovers are shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandweave.llm.common import bounded_batches, materialize

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_CUT = 16
MERGE_PARTITIONS = 64
#: Entries of the table of known chunks in each Python worker, and the characters up to which a chunk outlives a clearing.
KNOWN_CHUNKS, KNOWN_CHARS = 600_000, 40
#: How many new chunks are encoded as one text, with a special token between them.
JOINED = 2048

SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("row_id", "start", "length", "doc_tokens", "sequence_id", "offset", "sequence_length")]
    + [T.StructField("ids", T.BinaryType()), T.StructField("open", T.BooleanType()), T.StructField("part", T.LongType())]
)


class Packer:
    """Bounded-space best fit. Pieces are (row_id, start, doc_tokens, ids); emitted windows are lists of such pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        self.window, self.limit, self.min_cut = window, open_windows, min_cut
        self.rooms: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.content: dict[int, list] = {}
        self.made = 0

    def _put(self, at: int, piece: tuple) -> tuple[int, list] | None:
        """Adds to an open window; gives it back when it is full."""
        free, key = self.rooms.pop(at)
        self.content[key].append(piece)
        free -= len(piece[3]) // 4
        if free == 0:
            return key, self.content.pop(key)
        bisect.insort(self.rooms, (free, key))
        return None

    def _open(self) -> None:
        bisect.insort(self.rooms, (self.window, self.made))
        self.content[self.made] = []
        self.made += 1

    def add(self, row_id, start: int, total: int, ids: bytes) -> Iterator[tuple[int, list]]:
        wide = 4 * self.window
        while len(ids) >= wide:  # whole windows of one document
            key, self.made = self.made, self.made + 1
            yield key, [(row_id, start, total, ids[:wide])]
            start, ids = start + self.window, ids[wide:]
        while ids:
            size = len(ids) // 4
            at = bisect.bisect_left(self.rooms, (size, -1))
            if at == len(self.rooms) and len(self.rooms) < self.limit:
                self._open()
                at = bisect.bisect_left(self.rooms, (size, -1))
            if at < len(self.rooms):
                full = self._put(at, (row_id, start, total, ids))
                ids = b""
            elif self.rooms[0][0] >= self.min_cut:  # none has room: the fullest goes out, filled up by a cut
                free = self.rooms[0][0]
                full = self._put(0, (row_id, start, total, ids[: 4 * free]))
                start, ids = start + free, ids[4 * free :]
            else:
                _, key = self.rooms.pop(0)
                full = key, self.content.pop(key)
            if full:
                yield full

    def leftovers(self) -> Iterator[tuple[int, list]]:
        for _, key in self.rooms:
            yield key, self.content[key]
        self.rooms, self.content = [], {}


def _byte_classes() -> tuple[bytes, bytes, np.ndarray]:
    """For Latin-1 bytes: the lower-case byte, the class (0 space, 1 letter, 2 digit, 3 ASCII punctuation, 4 other), and
    for two neighbours' classes (5 * left + right) whether the vocabulary's pattern always ends a piece between them.

    The apostrophe, on which contractions hang, and what is rare are of class 4: nothing is cut beside them.
    """
    lower = np.array([ord(c.lower()) if ord(c.lower()) < 256 and c.isalpha() else ord(c) for c in map(chr, range(256))], np.uint8)
    kind = np.full(256, 4, np.uint8)
    for b in range(256):
        c = chr(b)
        if c in " \t\n\x0b\f\r":
            kind[b] = 0
        elif "a" <= c <= "z" or (b >= 0xDF and c.isalpha()):
            kind[b] = 1
        elif "0" <= c <= "9":
            kind[b] = 2
        elif "!" <= c <= "~" and c != "'":
            kind[b] = 3
    cut = np.zeros((5, 5), bool)
    cut[0, 1:] = True
    for left, right in ((1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)):
        cut[left, right] = True
    return lower.tobytes(), kind.tobytes(), cut.ravel()


def _single(chunk: str) -> bool:
    """Whether a chunk is lower-case letters of Latin-1 only, so that it is normalised and a single piece."""
    return chunk.isalpha() and chunk.islower() and (chunk.isascii() or (max(chunk) <= "\xff" and not any(c in chunk for c in "\xaa\xb5\xba")))


#: By the number of bytes that count.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, whose work on each chunk of a text is kept and reused.

    The vocabulary's pattern drops white space, and no piece or normalisation crosses it, so that the ids of a text are
    those of its chunks in order. Texts within Latin-1, which lower-case byte by byte and are always composed, are cut by
    array operations, also between letters, digits and punctuation, where the pattern ends a piece; other texts between
    spaces; texts with a special token's string go to the library whole.
    """

    def __init__(self, path: str, known_chunks: int = KNOWN_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.tokenizer, self.plain):
            t.no_truncation()
            t.no_padding()
        # for chunks that are normalised single pieces: the same model, cut at spaces only
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = tuple(special)
        self.mark, self.mark_id = max(special.items(), key=lambda x: x[1])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.lower, self.kind, self.cut = _byte_classes()
        self.limit = known_chunks
        self._reset(np.zeros(0, np.uint64), np.zeros(0, np.uint64), {}, np.zeros(0, np.uint32), np.zeros(0, np.int32))

    # The known chunks: slots with ids; found by an open table of the chunk's bytes (up to 16), or else by a dictionary.

    def _reset(self, first: np.ndarray, second: np.ndarray, long: dict, ids: np.ndarray, sizes: np.ndarray) -> None:
        """first, second: the bytes of each slot's chunk as two numbers, both zero for those that long has."""
        self.first, self.second, self.long, self.ids, self.sizes = first, second, long, ids, sizes
        self.starts, self.seen = np.cumsum(sizes, dtype=np.int64) - sizes, np.zeros(len(sizes), np.int32)
        self._spread(max(16, (4 * len(sizes)).bit_length()))

    def _spread(self, bits: int) -> None:
        self.bits, self.table = bits, np.full(1 << bits, -1, np.int32)
        self._place(np.flatnonzero(self.first))

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, slots: np.ndarray) -> None:
        at, last = self._home(self.first[slots], self.second[slots]), len(self.table) - 1
        while len(slots):
            free = self.table[at] < 0
            self.table[at[free]] = slots[free]
            left = self.table[at] != slots
            slots, at = slots[left], (at[left] + 1) & last

    def _find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each chunk, -1 for new ones."""
        found, which, last = np.full(len(first), -1, np.int64), np.arange(len(first)), len(self.table) - 1
        at = self._home(first, second)
        while len(which):
            slot = self.table[at]
            there = slot >= 0
            same = there.copy()
            same[there] = (self.first[slot[there]] == first[which[there]]) & (self.second[slot[there]] == second[which[there]])
            found[which[same]] = slot[same]
            there &= ~same
            which, at = which[there], (at[there] + 1) & last
        return found

    def _add(self, chunks: list[str], first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Encodes new distinct chunks; their slots. Chunks that a table cannot hold have zeros."""
        ids, sizes = self._fresh(chunks)
        slots = len(self.sizes) + np.arange(len(chunks))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])
        self.seen = np.concatenate([self.seen, np.zeros(len(chunks), np.int32)])
        if 2 * len(self.sizes) > len(self.table):
            self._spread((4 * len(self.sizes)).bit_length())
        else:
            self._place(slots[first != 0])
        return slots

    def _mark(self, slots: np.ndarray) -> None:
        here = np.zeros(len(self.seen), bool)
        here[slots] = True
        self.seen += here

    def _shrink(self) -> None:
        """Where there are more known chunks than the limit, those met in the fewest batches are forgotten."""
        if len(self.sizes) <= self.limit:
            return
        least = 2
        while (self.seen >= least).sum() > self.limit // 2:
            least *= 2
        kept = self.seen >= least
        kept[[s for c, s in self.long.items() if len(c) > KNOWN_CHARS]] = False
        order, sizes = np.cumsum(kept) - 1, self.sizes[kept]
        self._reset(self.first[kept], self.second[kept], {c: int(order[s]) for c, s in self.long.items() if kept[s]}, self._gather(np.flatnonzero(kept)), sizes)

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        """The ids of the slots, one after the other."""
        sizes = self.sizes[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[slots] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def _ids_of(self, slots: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Ids of texts of so many chunks each, as bytes."""
        ends = np.r_[0, np.cumsum(self.sizes[slots], dtype=np.int64)][np.r_[0, np.cumsum(counts)]]
        data = self._gather(slots).astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size of each chunk's) by the library; chunks that are single pieces take the plain way."""
        simple = np.fromiter(map(_single, chunks), bool, len(chunks))
        found, sizes = [np.zeros(0, np.uint32)], np.zeros(len(chunks), np.int32)
        order = np.r_[np.flatnonzero(simple), np.flatnonzero(~simple)]
        for own, plain in ((np.flatnonzero(simple), True), (np.flatnonzero(~simple), False)):
            for start in range(0, len(own), JOINED):
                names = [chunks[n] for n in own[start : start + JOINED].tolist()]
                if plain:
                    ids = np.array(self.plain.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, np.uint32)
                    lengths = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
                else:
                    ids = self._whole([self.mark.join(names)])[0]
                    marks = ids == self.mark_id
                    lengths = np.diff(np.r_[-1, np.flatnonzero(marks), len(ids)]) - 1
                    ids = ids[~marks]
                if len(lengths) != len(names):  # a chunk's first character has composed with a mark
                    each = self._whole(names)
                    ids, lengths = np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))
                found.append(ids)
                sizes[own[start : start + JOINED]] = lengths
        ids, ordered = np.concatenate(found), sizes[order].astype(np.int64)
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(ordered) - ordered
        ends = np.cumsum(sizes, dtype=np.int64)
        return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(ids))], sizes

    def _narrow(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts without NUL."""
        raw = b"\n".join(texts).translate(self.lower)
        kind = np.frombuffer(raw.translate(self.kind), np.uint8)
        starts = np.empty(len(kind), bool)
        starts[:1] = kind[:1] > 0
        starts[1:] = self.cut[5 * kind[:-1] + kind[1:]]
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        ends = np.searchsorted(np.flatnonzero(starts), edges)
        kept = kind > 0
        data, at = np.frombuffer(raw, np.uint8)[kept], np.flatnonzero(starts[kept])
        if not len(at):
            return [b""] * len(texts)
        size = np.diff(at, append=len(data))
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        eight = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        first, second = eight[at] & _MASKS[np.minimum(size, 8)], np.zeros(len(at), np.uint64)
        more = np.flatnonzero(size > 8)
        second[more] = eight[at[more] + 8] & _MASKS[np.minimum(size[more] - 8, 8)]
        slots = self._find(first, second)
        slots[size > 16] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            data = data.tobytes()
            names = [data[a:b] for a, b in zip(at[new].tolist(), (at[new] + size[new]).tolist(), strict=True)]
            place = {c: k for k, c in zip(new[::-1].tolist(), reversed(names), strict=True)}  # where each is first
            fresh = {c: k for c, k in place.items() if c not in self.long}
            of = np.fromiter(fresh.values(), np.int64, len(fresh))
            short = size[of] <= 16
            added = self._add([c.decode("latin-1") for c in fresh], np.where(short, first[of], 0).astype(np.uint64), np.where(short, second[of], 0).astype(np.uint64)).tolist()
            got = dict(zip(fresh, added, strict=True))
            self.long.update((c, s) for c, s in got.items() if len(c) > 16)
            slots[new] = np.fromiter((got[c] if c in got else self.long[c] for c in names), np.int64, len(names))
        self._mark(slots)
        return self._ids_of(slots, np.diff(ends, prepend=0))

    def _wide(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of any characters, chunk by chunk between spaces."""
        import unicodedata

        cut = []
        for text in texts:
            low = text.lower()  # as the library's own lowering, save for a final sigma and characters that would compose
            if "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and (low == text or unicodedata.is_normalized("NFC", low)):
                text = low
            cut.append(text.replace("\n", " ").split(" "))
        known = self.long
        fresh = list({c: 0 for chunks in cut for c in chunks if c not in known})
        if fresh:
            none = np.zeros(len(fresh), np.uint64)
            known.update(zip(fresh, self._add(fresh, none, none).tolist(), strict=True))
        slots = np.fromiter((known[c] for chunks in cut for c in chunks), np.int64, sum(map(len, cut)))
        self._mark(slots)
        return self._ids_of(slots, np.fromiter(map(len, cut), np.int64, len(cut)))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        narrow, wide = {}, {}
        for n, text in enumerate(texts):
            if any(s in text for s in self.special):
                out[n] = self._whole([text])[0].astype("<u4").tobytes()
                continue
            try:
                narrow[n] = text.encode("latin-1")
            except UnicodeEncodeError:
                wide[n] = text
            else:
                if "\0" in text:
                    wide[n] = text
                    del narrow[n]
        self._shrink()
        for own, run in ((narrow, self._narrow), (wide, self._wide)):
            if own:
                for n, ids in zip(own, run(list(own.values())), strict=True):
                    out[n] = ids
        return out


_LOADED: dict[str, ChunkEncoder] = {}


def loaded(path: str) -> ChunkEncoder:
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def _rows(windows, base: int, is_open: bool, part: int) -> Iterator[tuple]:
    for key, pieces in windows:
        size, offset = sum(len(p[3]) // 4 for p in pieces), 0
        for row_id, start, total, ids in pieces:
            yield row_id, start, len(ids) // 4, total, base + key, offset, size, ids, is_open, part
            offset += len(ids) // 4


def _batches(rows: Iterator[tuple], kind: T.StructType, at_most: int = 4 << 20):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, held, size = to_arrow_schema(kind), [], 0
    for row in rows:
        held.append(row)
        size += len(row[7]) + 64
        if size > at_most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT) -> DataFrame:
    """One row per piece: row_id (the document's id), start, length, doc_tokens, ids, sequence_id, offset, sequence_length.

    Every id of every document, with end_id after its last, lies in exactly one piece; the pieces of a sequence follow
    one another without gaps from offset 0. A null text counts as empty, a document without ids (only where end_id is
    None) gives no row, and an empty table gives none. Ids are of any type; repeated and null ones are packed like others.
    Other columns of docs are not passed on. ids are little-endian unsigned 32-bit integers. A sequence shorter than the window is to be padded by its reader.
    """
    bounded_batches(docs.sparkSession)
    kind = T.StructType([T.StructField("row_id", docs.schema[id_col].dataType), *SCHEMA.fields[1:]])
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def first(batches):
        from pyspark import TaskContext

        part, encoder, packer = TaskContext.get().partitionId(), loaded(vocabulary), Packer(window, open_windows, min_cut)

        def rows():
            base = (part + 1) << 36
            for batch in batches:
                row_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for row_id, ids in zip(row_ids, encoder.encode_batch(texts), strict=True):
                    ids += tail
                    yield from _rows(packer.add(row_id, 0, len(ids) // 4, ids), base, False, part)
            yield from _rows(packer.leftovers(), base, True, part)

        yield from _batches(rows(), kind)

    def merge(batches):
        import pyarrow as pa

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).to_pylist()
        rows.sort(key=lambda r: (r["part"] // MERGE_PARTITIONS, r["sequence_length"], r["sequence_id"], r["offset"]))
        groups: dict[int, list] = {}
        for r in rows:
            groups.setdefault(r["part"] // MERGE_PARTITIONS, []).append(r)
        for group, own in groups.items():
            # one open window: what does not fit fills it up by a cut and goes on in the next
            packer = Packer(window, 1, 1)

            def again(own=own, group=group, packer=packer):
                for r in own:
                    yield from _rows(packer.add(r["row_id"], r["start"], r["doc_tokens"], r["ids"]), group << 20, True, group)
                yield from _rows(packer.leftovers(), group << 20, True, group)

            yield from _batches(again(), kind)

    pieces = materialize(docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(first, kind))
    leftovers = pieces.where("open").withColumn("group", F.floor(F.col("part") / MERGE_PARTITIONS))
    merged = leftovers.repartition("group").drop("group").mapInArrow(merge, kind)
    return pieces.where("NOT open").unionByName(merged).drop("open", "part")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(F.col("row_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")
