"""Flow tables from CSV, exporter files, JSON text; packet tables."""

from __future__ import annotations

import csv
import logging
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.functions.scalars import q
from flowsift.operators.clean import column_differences, inf_to_null, union_flows
from flowsift.sources.schemas import (EXPORTER, EXPORTER_METADATA, PACKETS, RAW_TO_PRESPLIT_U, RAW_U, type_c,
                                      type_u)
from flowsift.session import materialise

# Workers get this module's functions with the task, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

log = logging.getLogger("flowsift.sources")

TypeOf = Callable[[str], T.DataType]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(target)
    return found is not None and len(found) > 0


def unique_names(names: Sequence[str]) -> list[str]:
    """Trimmed names; the second X becomes X.1, the third X.2."""
    seen: dict[str, int] = {}
    out = []
    for name in (n.strip() for n in names):
        count = seen.get(name, 0)
        seen[name] = count + 1
        out.append(name if count == 0 else f"{name}.{count}")
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


_PATTERN = set("*?[]{}\\")


def data_files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The files behind paths, folders and patterns, in the order given and by name within one, as {path: address}.

    The address is what Spark's file metadata says. A folder is listed once, however many of its files are named.
    A warning for each path that does not exist, an error if none does.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folders: dict[str, dict[str, object]] = {}

    def statuses(found) -> list:
        return sorted(((s.getPath(), s) for s in found or ()), key=lambda x: x[0].toString())

    def one(path: str) -> list:
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(conf)
        if _PATTERN & set(path) or target.getParent() is None:
            return statuses(system.globStatus(target))
        folder = target.getParent().toString()
        if folder not in folders:
            there = system.exists(target.getParent())
            folders[folder] = {p.getName(): (p, s) for p, s in statuses(system.listStatus(target.getParent()) if there else ())}
        return [folders[folder][target.getName()]] if target.getName() in folders[folder] else []

    out: dict[str, str] = {}
    for path in paths:
        found = one(path)
        if not found:
            log.warning("file not found: %s", path)
        for p, status in found:
            inside = [(p, status)] if status.isFile() else statuses(p.getFileSystem(conf).listStatus(p))
            for f, s in inside:
                if s.isFile() and f.getName()[0] not in "._":
                    out.setdefault(f.toString(), _one_spelling(f.toUri().toString()))
    if not out:
        raise FileNotFoundError(f"none of the input files exists: {list(paths)}")
    return out


def _one_spelling(address: str) -> str:
    """A file's address in one spelling: local ones come with one slash or three."""
    return "file:/" + address.removeprefix("file:").lstrip("/") if address.startswith("file:") else address


def _same_path(column: Column) -> Column:
    return F.regexp_replace(column, "^file:/+", "file:/")


def file_statistics(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """(file, head, utf8, lines) per file: its first line as bytes, whether it is valid UTF-8, and its lines.

    One pass over all files as lines of bytes. Each task gives a row per stretch of a file that it reads; a file's first line is that of
    the stretch at byte 0. Files without lines are absent.
    """
    lines = spark.read.text(list(files)).select(_same_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                                F.col("value").cast("binary").alias("line"), F.is_valid_utf8("value").alias("utf8"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            file, block = (pc.dictionary_encode(batch.column(c)).indices.to_numpy() for c in ("file", "block"))
            cuts = np.flatnonzero((np.diff(file, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
            ends = np.append(cuts[1:], batch.num_rows)
            good = np.add.reduceat(batch.column("utf8").to_numpy(zero_copy_only=False).astype(np.int64), cuts) if len(cuts) else cuts
            at = pa.array(cuts)
            yield pa.record_batch([batch.column("file").take(at), batch.column("block").take(at), batch.column("line").take(at), pa.array(good == ends - cuts),
                                   pa.array(ends - cuts)], ["file", "block", "line", "utf8", "lines"])

    parts = lines.mapInArrow(sum_up, "file string, block long, line binary, utf8 boolean, lines long")
    # A task's batches come in the order of the file, so the first row of the stretch at byte 0 has the first line.
    parts = parts.withColumn("at", F.struct("block", F.monotonically_increasing_id().alias("row")))
    return parts.groupBy("file").agg(F.min_by("line", "at").alias("head"), F.min("utf8").alias("utf8"), F.sum("lines").alias("lines"))


def _names_in(head: bytes, encoding: str) -> list[str]:
    """Column names in a first line."""
    line = head.decode(encoding, "ignore").lstrip("\ufeff").rstrip("\r")
    return next(csv.reader([line]), []) if line else []


def charset_of(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """UTF-8, or Latin-1 for the files that are no valid UTF-8. One pass over the files."""
    found = data_files(spark, files)
    latin = {r["file"] for r in file_statistics(spark, list(found)).where("not utf8").select("file").collect()}
    return {f: "ISO-8859-1" if address in latin else "UTF-8" for f, address in found.items()}


def with_file_order(df: DataFrame, order: dict[str, int], ordinal: str) -> DataFrame:
    """Number rows from 0 in the order of files, then of rows in a file; ``df`` is a scan with column ``_at``
    (file, block, row id).

    The scan is written first: row ids belong to one run of it. Spark's row id grows along a block of a file, and blocks
    are known by their start. One aggregate gives the span of row ids of each block, running sums over the blocks (not
    the rows) the number where each begins.
    """
    spark = df.sparkSession
    df = materialise(df, "scan")
    files = spark.createDataFrame(list(order.items()), "file string, nth long")
    spans = (df.select("_at").groupBy("_at.file", "_at.block")
             .agg(F.min("_at.row").alias("low"), (F.max("_at.row") - F.min("_at.row") + 1).alias("n")).join(files, "file"))
    before = F.sum("n").over(Window.orderBy("nth", "block")) - F.col("n")
    starts = spans.select(F.col("file").alias("_file"), F.col("block").alias("_block"), (before - F.col("low")).alias("_shift"))
    joined = df.join(starts, (F.col("_at.file") == F.col("_file")) & (F.col("_at.block") == F.col("_block")))
    number = (F.col("_at.row") + F.col("_shift")).alias(ordinal)
    return joined.select(*[number if c == "_at" else q(c) for c in df.columns])


def _scan(spark: SparkSession, files: Sequence[str], names: Sequence[str], type_of: TypeOf, encoding: str, header: bool,
          at: bool) -> DataFrame:
    """One scan of files with the same columns."""
    schema = T.StructType([T.StructField(f"c{i}", type_of(n)) for i, n in enumerate(names)])
    rows = spark.read.csv(list(files), header=header, schema=schema, encoding=encoding, mode="PERMISSIVE",
                          enforceSchema=True, ignoreLeadingWhiteSpace=header, ignoreTrailingWhiteSpace=False)
    columns = [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    if at:
        place = F.struct(_same_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("row"))
        columns.append(place.alias("_at"))
    return rows.select(*columns)


def _read_files(spark: SparkSession, paths: Sequence[str], type_of: TypeOf, encoding: str | dict[str, str] | None,
                ordinal: str | None, names: Sequence[str] | None = None) -> DataFrame:
    """All files, one scan per distinct header and charset, aligned by column name.

    Headers and charsets come from one pass over the files (none if names and charset are given), the rows from a second.
    The driver gets a file's name and the digest of its header, and each distinct header once.
    """
    files = data_files(spark, paths)
    if isinstance(encoding, dict):
        charsets = {f: encoding[p] for p in encoding for f in data_files(spark, [p])}
        charsets = {f: charsets.get(f, "UTF-8") for f in files}
    else:
        charsets = dict.fromkeys(files, encoding or "UTF-8")
    heads: dict[str, bytes] = {}
    known: dict[str, tuple] = {}
    if encoding is None or names is None:
        said = materialise(file_statistics(spark, list(files)).withColumn("digest", F.sha2("head", 256)), "files")
        known = {r["file"]: r for r in said.select("file", "digest", "utf8").collect()}
        heads = {r["digest"]: bytes(r["head"]) for r in said.dropDuplicates(["digest"]).select("digest", "head").collect()}
    groups: dict[tuple, list[str]] = {}
    for f, address in files.items():
        fact = known.get(address)
        charset = "ISO-8859-1" if encoding is None and fact is not None and not fact["utf8"] else charsets[f]
        head = tuple(names) if names else tuple(unique_names(_names_in(heads[fact["digest"]], charset))) if fact else ()
        groups.setdefault((head, charset), []).append(f)
    # A file without lines has no header and no rows.
    groups = {key: members for key, members in groups.items() if key[0]} or groups
    parts = [_scan(spark, members, head, type_of, charset, names is None, ordinal is not None)
             for (head, charset), members in groups.items()]
    for i, differing in enumerate(column_differences(parts), 2):
        if differing:
            log.warning("header %d differs in columns: %s", i, sorted(differing))
    whole = union_flows(parts, allow_missing=True)
    if ordinal is None:
        return whole
    order: dict[str, int] = {}
    for address in files.values():
        order.setdefault(address, len(order))
    return with_file_order(whole, order, ordinal)


def read_flow_csv(spark: SparkSession, path: str, type_of: TypeOf = type_c, encoding: str | None = None,
                  ordinal: str | None = None) -> DataFrame:
    """One headered CSV, columns typed by name. Without ``encoding`` it is read as UTF-8, or as Latin-1 where it
    is no valid UTF-8."""
    return _read_files(spark, [path], type_of, encoding, ordinal)


def read_flow_csvs(spark: SparkSession, paths: Sequence[str], type_of: TypeOf = type_c,
                   encoding: str | dict[str, str] | None = None, ordinal: str | None = None) -> DataFrame:
    """All files that exist, aligned by column name; absent columns are NULL, infinities too.

    Files with the same header share one scan, so thousands of files make a small plan. ``ordinal``
    numbers the rows by file, then by row.
    """
    return inf_to_null(_read_files(spark, paths, type_of, encoding, ordinal))


def feature_names_from(spark: SparkSession, path: str, column: str = "Name", encoding: str = "ISO-8859-1") -> list[str]:
    """Column names listed in a feature-dictionary CSV, in file order."""
    rows = read_flow_csv(spark, path, lambda _: T.StringType(), encoding, ordinal="_row")
    return [r[0].strip() for r in rows.orderBy("_row").select(q(column)).collect()]


def read_headerless(spark: SparkSession, paths: Sequence[str], names_path: str | None = None,
                    type_of: TypeOf = type_u, ordinal: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV without header, named by a feature dictionary if there is one, else by the default
    list."""
    names = RAW_U
    if names_path and path_exists(spark, names_path):
        names = feature_names_from(spark, names_path)
    elif names_path:
        log.warning("feature dictionary not found: %s; using the default names", names_path)
    return _read_files(spark, paths, type_of, encoding, ordinal, names)


def presplit_names(df: DataFrame) -> DataFrame:
    """Headerless names to the pre-split ones, so that the common mapping finds them."""
    return df.toDF(*[RAW_TO_PRESPLIT_U.get(c, c) for c in df.columns])


def read_presplit(spark: SparkSession, train: str, test: str, fallback: Callable[[], DataFrame] | None = None,
                  type_of: TypeOf = type_u, ordinal: str | None = None) -> DataFrame:
    """The pre-split pair if both files exist, else ``fallback()``."""
    if path_exists(spark, train) and path_exists(spark, test):
        return read_flow_csvs(spark, [train, test], type_of, ordinal=ordinal)
    if fallback is None:
        raise FileNotFoundError(f"pre-split files not found: {train}, {test}")
    log.info("pre-split files not found, reading raw files")
    return fallback()


def conform_exporter(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns, then exporter columns in model order under their profile C names, with the flow metadata the
    table has. All 71 sources must be present; the error lists every missing one."""
    missing = [c for c in EXPORTER if c not in df.columns]
    if missing:
        raise ValueError("exporter table lacks required columns: " + ", ".join(missing))

    def metadata(name: str) -> Column:
        c = q(name)
        return F.nanvl(c, F.lit(None).cast("double")).alias(name) if dict(df.dtypes)[name] == "double" else c

    kept = [metadata(c) for c in EXPORTER_METADATA if c in df.columns]
    return df.select(*[q(k) for k in keep], *[q(source).alias(name) for source, name in EXPORTER.items()], *kept)


def read_exporter_csv(spark: SparkSession, path: str, ordinal: str | None = None) -> DataFrame:
    def type_of(name: str) -> T.DataType:
        return T.StringType() if name in ("src_ip", "dst_ip", "protocol", "timestamp") else (
            T.IntegerType() if name == "src_port" else T.DoubleType())

    raw = read_flow_csv(spark, path, type_of, ordinal=ordinal)
    return conform_exporter(raw, [ordinal] if ordinal else [])


def parse_flow_json(df: DataFrame, column: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Flow records from JSON text: (rows with the parsed fields, rejected rows).

    Text that is no JSON object goes to the rejected table with its other columns.
    """
    is_object = F.coalesce(F.get_json_object(q(column), "$").startswith("{"), F.lit(False))
    others = [q(c) for c in df.columns if c != column]
    good = df.filter(is_object).withColumn("_flow", F.from_json(q(column), schema))
    return good.select(*others, "_flow.*"), df.filter(~is_object)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packet table in Parquet; see ``operators.packets`` for the columns."""
    return spark.read.schema(PACKETS).parquet(path)
