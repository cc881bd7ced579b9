"""Exact deduplication of texts by two-pass Bloom filtering, with native expressions only.

Pass one sets a cell of a bitmap for each text's hash and keeps the cells that were set more than once: one cell a row is
shuffled, added up where the rows are. Pass two probes that filter: a text whose cell is repeated may have a copy, and
only such rows are shuffled by their SHA-256. All other rows pass straight through. The filter is exact in one direction
(it never misses a copy), so the result is whole; a false hit (one row in CELLS_PER_ROW) only costs the shuffle of a row.

The filter grows with the rows (CELLS_PER_ROW bits each) and is broadcast. Where it would exceed broadcast_limit, the
rows are first written by ranges of their hash, as many as keep each range's filter within the limit, and both passes
run range by range: equal texts have equal hashes, so no copy is missed, and each row is written and read once more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import materialize, shared_dir, unused

CELLS_PER_ROW = 16
SEGMENT_BITS = 32768
BROADCAST_LIMIT = 128 << 20
#: Characters that do not count when texts are compared.
IGNORED = " \t\n\x0b\f\r"
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def normalized(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), IGNORED, F.coalesce(text, F.lit("")))


def _set(bits: Column, position: Column) -> Column:
    """Whether a bit of a segment is set; a missing segment has none."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.get(F.array(*[F.shiftright(byte, i).bitwiseAND(F.lit(1)) for i in range(8)]), position.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))


def repeated_cells(signatures: DataFrame, signature: str, cells: int) -> DataFrame:
    """Pass one: (segment, bits) of the filter's cells that more than one row set."""
    cell = F.pmod(F.col(signature), F.lit(cells)).alias("cell")
    often = signatures.groupBy(cell).agg(F.count("*").alias("n")).where("n > 1")
    segment = F.floor(F.col("cell") / SEGMENT_BITS).cast("long").alias("segment")
    return often.groupBy(segment).agg(F.bitmap_construct_agg(F.pmod("cell", F.lit(SEGMENT_BITS))).alias("bits"))


def _groups_of_range(docs: DataFrame, rows: int, id_col: str, text_col: str, carry: list[str], names: list[str]) -> DataFrame:
    """The groups of docs, whose filter is small enough to be broadcast. names: of the four results."""
    keep_id, group_size, kept, sha = names
    length, tag, cell, bits, segment, best = unused(docs, "_length", "_tag", "_cell", "_bits", "_segment", "_best")
    cells = SEGMENT_BITS
    while cells < CELLS_PER_ROW * rows:
        cells *= 2
    content = normalized(F.col(text_col))
    repeated = materialize(repeated_cells(docs.select(F.xxhash64(content).alias("s")), "s", cells))
    probed = docs.withColumn(cell, F.pmod(F.xxhash64(content), F.lit(cells)))
    side = F.broadcast(repeated.select(F.col("segment").alias(segment), F.col("bits").alias(bits)))  # at most cells / 8 bytes
    probed = probed.join(side, F.floor(F.col(cell) / SEGMENT_BITS).cast("long") == F.col(segment), "left")
    maybe = F.col(bits).isNotNull() & _set(F.col(bits), F.pmod(cell, F.lit(SEGMENT_BITS)))
    digest = F.sha2(content, 256)
    single = probed.where(~maybe).select(
        id_col, *carry, F.col(id_col).alias(keep_id), F.lit(1).cast("long").alias(group_size), F.lit(True).alias(kept), digest.alias(sha)
    )
    again = materialize(
        probed.where(maybe).select(
            id_col, *carry, F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias(length), F.monotonically_increasing_id().alias(tag), digest.alias(sha)
        )
    )
    order = F.struct((-F.col(length)).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col(tag).alias("d"))
    groups = again.groupBy(sha).agg(F.min(order).alias(best), F.count("*").alias(group_size))
    # read from a table, so that the join's sides are plain exchanges and a large group's rows can be split
    joined = again.join(materialize(groups), sha).select(
        id_col, *carry, F.col(f"{best}.c").alias(keep_id), group_size, (F.col(tag) == F.col(f"{best}.d")).alias(kept), sha
    )
    return single.unionByName(joined)


def _groups(docs: DataFrame, id_col: str, text_col: str, carry: list[str], names: list[str], broadcast_limit: int) -> DataFrame:
    spark, rows = docs.sparkSession, docs.count()
    # a filter has less than twice its cells, as their number is a power of two
    ranges = -(-(2 * CELLS_PER_ROW * rows // 8) // broadcast_limit)
    if ranges <= 1:
        return _groups_of_range(docs, rows, id_col, text_col, carry, names)
    (part,) = unused(docs, "_range")
    wanted = docs.select(*dict.fromkeys([id_col, text_col, *carry]))
    # by bits of the hash that the cells do not use
    path, number = shared_dir(spark), F.pmod(F.shiftrightunsigned(F.xxhash64(normalized(F.col(text_col))), 40), F.lit(ranges)).cast("int")
    wanted.withColumn(part, number).write.partitionBy(part).parquet(path)
    found = None
    for k in range(ranges):
        if _exists(spark, f"{path}/{part}={k}"):
            own = spark.read.schema(wanted.schema).parquet(f"{path}/{part}={k}")
            # copies share a cell, so that a range with a large group needs no larger filter
            own = _groups_of_range(own, -(-rows // ranges), id_col, text_col, carry, names)
            found = own if found is None else found.unionByName(own)
    return found


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Every row of docs (the id and the columns in carry, all by default) with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after deleting the IGNORED characters; a null text counts as empty. Of equal texts
    the row with the most code points stays, then the smallest id (null ids last), then any one: exactly one row of a
    group is kept, even where whole rows repeat. An empty table gives an empty result. Columns of docs that bear one of
    the result's names are left out.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != id_col and c.lower() not in RESULTS]
    names = unused(docs, *RESULTS)
    return _groups(docs, id_col, text_col, carry, names, broadcast_limit).withColumnsRenamed(dict(zip(names, RESULTS, strict=True)))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """docs without the rows that exact_groups does not keep; its columns, whatever their names, and their order stay."""
    names = unused(docs, *RESULTS)
    found = _groups(docs, id_col, text_col, [c for c in docs.columns if c != id_col], names, broadcast_limit)
    return found.where(F.col(names[2])).select(*docs.columns)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs, carry=[]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
