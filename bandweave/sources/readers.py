"""Readers: spectra from CSV and binary instrument files, responses, cached and landed tables.

Spectra come as (Sample_ID, spectrum array<double>); the shared axis and what else is known of the source go into the
metadata of the column spectrum.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Block types of the binary format (data and their parameters), and the order in which channels are tried.
CHANNELS = ("ab_no_atm_comp", "ab", "sc_sample", "sc_ref")
_HEADER, _FIRST_BLOCK, _BLOCK = 504, 24, 12
SPECTRUM_ROW = T.StructType(
    [
        T.StructField("Sample_ID", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("wavenumbers", T.ArrayType(T.DoubleType())),
        T.StructField("spectrum", T.ArrayType(T.DoubleType())),
        T.StructField("error", T.StringType()),
    ]
)


def with_metadata(df: DataFrame, **values) -> DataFrame:
    """Puts values into the metadata of spectrum, on top of what is there; re-attach after expressions."""
    kept = {**df.schema["spectrum"].metadata, **values}
    return df.withColumn("spectrum", F.col("spectrum").alias("spectrum", metadata=kept))


def axis(df: DataFrame) -> list[float]:
    found = df.schema["spectrum"].metadata.get("wavenumbers")
    if not found:
        raise ValueError("the column spectrum has no wavenumbers in its metadata")
    return list(found)


def _number(name: str) -> float | None:
    match = re.search(r"([0-9]+(?:\.[0-9]+)?)", name)
    return float(match[1]) if match else None


def read_csv_spectra(spark: SparkSession, path: str, spectra_type: str = "MIR") -> DataFrame:
    """One row per sample: the first column is the id, every other a band named after its wavenumber."""
    raw = spark.read.option("header", True).csv(path)
    if len(raw.columns) < 2:
        raise ValueError("a spectra CSV needs an id and at least one band")
    ident, *bands = raw.columns
    names = [_number(b) for b in bands]
    numeric = all(x is not None for x in names)
    values = F.array(*[F.expr(f"try_cast(`{b}` AS double)") for b in bands])
    rows = raw.select(F.col(f"`{ident}`").alias("Sample_ID"), values.alias("spectrum"))
    return with_metadata(rows, wavenumbers=names if numeric else [float(i) for i in range(len(bands))], source="csv", source_path=path, spectra_type=spectra_type, channel_used="csv", numeric_header=numeric)


def parse_opus(content: bytes) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """channel -> (wavenumbers, values) of a binary instrument file. A broken file raises ValueError."""
    if len(content) < _HEADER:
        raise ValueError("too short")
    blocks: list[tuple[int, int, int, int, int]] = []
    for at in range(_FIRST_BLOCK, _HEADER, _BLOCK):
        data_type, channel, text, _, words, offset = struct.unpack_from("<BBBBII", content, at)
        if offset == 0 or offset + 4 * words > len(content):
            break
        blocks.append((data_type, channel, text, words, offset))
    params = {}
    for data_type, channel, _, words, offset in blocks:
        if data_type in (23, 27, 31):
            params[data_type, channel] = _parameters(content[offset : offset + 4 * words])
    found = {}
    for data_type, channel, _, words, offset in blocks:
        name = {(15, 16): "ab_no_atm_comp", (15, 48): "ab", (7, 4): "sc_sample", (11, 4): "sc_ref"}.get((data_type, channel))
        own = params.get((data_type + 16, channel))
        if name is None or own is None or not {"NPT", "FXV", "LXV"} <= own.keys():
            continue
        points = min(int(own["NPT"]), words)
        values = np.frombuffer(content, "<f4", points, offset).astype(float)
        found[name] = (np.linspace(own["FXV"], own["LXV"], points), values)
    return found


def _parameters(block: bytes) -> dict[str, float | str]:
    found, at = {}, 0
    while at + 8 <= len(block):
        name = block[at : at + 3].decode("latin-1")
        if name == "END":
            break
        kind, words = struct.unpack_from("<HH", block, at + 4)
        value = block[at + 8 : at + 8 + 2 * words]
        if kind == 0 and len(value) >= 4:
            found[name] = struct.unpack_from("<i", value)[0]
        elif kind == 1 and len(value) >= 8:
            found[name] = struct.unpack_from("<d", value)[0]
        else:
            found[name] = value.split(b"\0")[0].decode("latin-1")
        at += 8 + 2 * words
    return found


def write_opus(wavenumbers, values, channel: str = "ab") -> bytes:
    """A minimal file that parse_opus() reads, for tests and fixtures."""
    data_type, code = {"ab_no_atm_comp": (15, 16), "ab": (15, 48), "sc_sample": (7, 4), "sc_ref": (11, 4)}[channel]
    data = np.asarray(values, "<f4").tobytes()
    params = b"".join(
        [
            b"NPT\0" + struct.pack("<HHi", 0, 2, len(values)),
            b"FXV\0" + struct.pack("<HHd", 1, 4, float(wavenumbers[0])),
            b"LXV\0" + struct.pack("<HHd", 1, 4, float(wavenumbers[-1])),
            b"END\0" + struct.pack("<HH", 0, 0),
        ]
    )
    head = bytearray(_HEADER)
    struct.pack_into("<BBBBII", head, _FIRST_BLOCK, data_type + 16, code, 0, 0, len(params) // 4, _HEADER)
    struct.pack_into("<BBBBII", head, _FIRST_BLOCK + _BLOCK, data_type, code, 0, 0, len(data) // 4, _HEADER + len(params))
    return bytes(head) + params + data


def read_opus(spark: SparkSession, path: str, spectra_type: str = "MIR") -> DataFrame:
    """A file, or all files of a folder whose extension is one digit. The best channel of each file is taken; files that
    hold none are left out. All spectra have to share an axis length; the first file's axis (by id) is the shared one."""

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                sample = re.sub(r"\.[0-9]$", "", os.path.basename(name))
                try:
                    found = parse_opus(bytes(content))
                    channel = next(c for c in CHANNELS if c in found)
                    wavenumbers, values = found[channel]
                    out.append((sample, channel, wavenumbers.tolist(), values.tolist(), None))
                except (ValueError, StopIteration, struct.error) as error:
                    out.append((sample, None, None, None, str(error) or "no channel"))
            yield pd.DataFrame(out, columns=SPECTRUM_ROW.names)

    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"\.[0-9]$"))
    rows = files.select("path", "content").mapInPandas(parse, SPECTRUM_ROW)
    first = rows.where("spectrum IS NOT NULL").agg(F.min_by(F.struct("wavenumbers", "channel"), "Sample_ID").alias("x")).first()["x"]
    if first is None:
        raise ValueError(f"no valid spectrum in {path}")
    good = rows.where(F.size("spectrum") == len(first["wavenumbers"])).select("Sample_ID", "spectrum")
    return with_metadata(good, wavenumbers=first["wavenumbers"], channel_used=first["channel"], source="opus", source_path=path, spectra_type=spectra_type)


def read_spectra(spark: SparkSession, source: str, spectra_path: str, spectra_type: str = "MIR") -> DataFrame:
    """source: opus or csv; spectra_type: MIR or NIR. An empty source is an error."""
    if source not in ("opus", "csv"):
        raise ValueError(f"source must be opus or csv, not {source!r}")
    if spectra_type not in ("MIR", "NIR"):
        raise ValueError(f"spectra_type must be MIR or NIR, not {spectra_type!r}")
    if source == "csv" and not re.search(r"\.csv(\.gz)?/?$", spectra_path):
        raise ValueError("a CSV source needs a path that ends in .csv")
    found = read_csv_spectra(spark, spectra_path, spectra_type) if source == "csv" else read_opus(spark, spectra_path, spectra_type)
    if found.isEmpty():
        raise ValueError(f"{spectra_path} holds no spectra")
    return found


def read_response(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """A response table from a CSV path, or the frame itself."""
    if isinstance(source, DataFrame):
        return source
    try:
        return spark.read.csv(source, header=True, inferSchema=True)
    except Exception as error:
        raise ValueError(f"the response table {source} cannot be read: {error}") from error


def from_long(long: DataFrame, id_col: str = "Sample_ID", axis_col: str = "wavenumber", value_col: str = "absorbance") -> DataFrame:
    """(id, wavenumber, absorbance) rows as one ordered array per id; a repeated band takes its mean."""
    one = long.groupBy(id_col, axis_col).agg(F.avg(value_col).alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(axis_col).alias("w"), "v")))
    return one.groupBy(id_col).agg(pairs.alias("p")).select(id_col, F.col("p.v").alias("spectrum"), F.col("p.w").alias("wavenumbers"))


def to_long(spectra: DataFrame, wavenumbers: list[float], id_col: str = "Sample_ID") -> DataFrame:
    band = F.posexplode("spectrum").alias("band", "absorbance")
    values = F.array(*[F.lit(float(w)) for w in wavenumbers])
    return spectra.select(id_col, band).select(id_col, F.get(values, F.col("band")).alias("wavenumber"), "absorbance")


def to_wide(spectra: DataFrame, wavenumbers: list[float], id_col: str = "Sample_ID") -> DataFrame:
    """One column per band, for exchange with other tools."""
    return spectra.select(id_col, *[F.get("spectrum", F.lit(i)).alias(f"{w:g}") for i, w in enumerate(wavenumbers)])


def cached_path(folder: str, name: str) -> str | None:
    """Path of a cached table in any store that Spark reaches, or None where it is missing."""
    spark, path = SparkSession.active(), f"{folder.rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def read_library(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The reference library's tables (location, lab, spectra) from a folder into which they were downloaded before."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("location", "lab", "spectra")}


def climate_rows(daily: DataFrame, cells: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """Landed daily climate rows of the wanted cells and years; only the partitions and columns needed are read."""
    wanted = daily.where(F.col("year").between(start_year, end_year))
    return wanted.join(cells.select("cell_x", "cell_y").distinct(), ["cell_x", "cell_y"], "left_semi")


def digest_of(df: DataFrame, *params: object) -> str:
    """A cache key of the table's rows, whatever their order, and of parameters: one aggregate, nothing is sorted."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    got = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    import hashlib

    return hashlib.md5(repr((tuple(got), df.columns, params)).encode()).hexdigest()
