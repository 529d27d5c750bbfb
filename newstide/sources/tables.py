"""Readers: header resolution, all-text and typed files, mixed dates and volumes, file profiles."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newstide.functions.dates import parse_date
from newstide.operators.sets import union_all

log = logging.getLogger(__name__)

PRICE_TEXT = T.StructType([T.StructField(n, T.StringType()) for n in ("Date", "Close", "Open", "High", "Low", "Vol.")])
PRICE_TEXT_WITH_ENTITY = T.StructType([T.StructField("entity", T.StringType()), *PRICE_TEXT.fields])
SCORED_NEWS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("title", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)
LAUNCHES = T.StructType([T.StructField(n, T.StringType()) for n in ("Date", "Product", "Company", "Category", "Type")])


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType | None = None,
    encoding: str = "UTF-8",
    tolerant: bool = False,
    corrupt: str | None = None,
) -> DataFrame:
    """CSV files with a header as one table. Without a schema every column is text.

    Broken rows keep what parses; with a schema and ``corrupt`` their line is in a column of that name. Unreadable files
    are an error unless ``tolerant``. ``encoding='MS949'`` needs ``spark.sql.legacy.javaCharsets=true``.
    """
    reader = spark.read.options(
        header=True,
        encoding=encoding,
        mode="PERMISSIVE",
        quote='"',
        escape='"',
        ignoreCorruptFiles=tolerant,
        ignoreMissingFiles=tolerant,
    )
    if schema is not None:
        if corrupt:
            reader = reader.option("columnNameOfCorruptRecord", corrupt)
            schema = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
        reader = reader.schema(schema)
    return reader.csv(paths if isinstance(paths, str) else list(paths))


def with_file(df: DataFrame, name: str = "file", level: int = 1) -> DataFrame:
    """The name of each row's file (level 1), or of a folder above it (level 2 and up)."""
    return df.withColumn(name, F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -level)))


def file_part(name: Column, part: int = 2) -> Column:
    """The ``part``-th underscore-separated piece of a file name."""
    return F.split_part(name, F.lit("_"), F.lit(part))


def strip_headers(df: DataFrame) -> DataFrame:
    """Header names without space around them."""
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns])


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same rows, or an error that names the columns that are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing among {df.columns}")
    return df


def resolve_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rename by alias list, first alias present wins; absent ones are logged and left out."""
    found = {}
    for name, options in aliases.items():
        hit = next((o for o in options if o in df.columns), None)
        if hit is None:
            log.warning("no column for %s among %s", name, df.columns)
        else:
            found[name] = hit
    return df.select(*[F.col(f"`{src}`").alias(name) for name, src in found.items()])


def match_headers(columns: Sequence[str], fragments: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Assign each header to the first group one of whose fragments it contains; a later header replaces an earlier."""
    found: dict[str, str] = {}
    for header in columns:
        group = next((g for g, parts in fragments.items() if any(p in header.lower() for p in parts)), None)
        if group:
            found[group] = header
    return found


def resolve_names(df: DataFrame, fragments: Mapping[str, Sequence[str]], required: Sequence[str] = ("date", "title")) -> dict[str, str] | None:
    """New name to header of each column that is recognised; None, with a warning, if a required one is not among them."""
    found = match_headers(df.columns, fragments)
    if not set(required) <= set(found):
        log.warning("skipping files without %s: %s", required, df.columns)
        return None
    return found


def resolve_fuzzy(
    df: DataFrame, fragments: Mapping[str, Sequence[str]], required: Sequence[str] = ("date", "title")
) -> DataFrame | None:
    found = resolve_names(df, fragments, required)
    return None if found is None else df.select(*[F.col(f"`{src}`").alias(name) for name, src in found.items()])


def _plain(path: str) -> str:
    """A path without its scheme and escapes, to compare names as given with names as listed."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", unquote(path))


def _escaped(path: str) -> str:
    """A path whose characters all stand for themselves in a pattern."""
    return re.sub(r"([\\*?\[\]{},])", r"\\\1", path)


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """The files that Spark lists for a read; none where there is no such folder."""
    try:
        return spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).inputFiles()
    except AnalysisException:
        return []


def _file() -> Column:
    """The path of a row's file, without scheme and escapes."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def list_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path of each file, empty ones too, from the listing that Spark makes for any read."""
    return spark.createDataFrame([(_plain(p),) for p in _listed(spark, paths)], "path string")


def headers(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8", tolerant: bool = False) -> DataFrame:
    """path and first line of each file that has one.

    Lines are read by all tasks; the task with the start of a file returns that file's first line only.
    """
    reader = spark.read.schema("line string").options(sep="\x01", quote="", encoding=encoding, ignoreCorruptFiles=tolerant, ignoreMissingFiles=tolerant)
    lines = reader.csv(paths if isinstance(paths, str) else list(paths))
    starts = lines.where(F.col("_metadata.file_block_start") == 0)
    return starts.groupBy(_file().alias("path")).agg(F.first("line").alias("header"))


def read_each(spark: SparkSession, paths: Sequence[str], fragments: Mapping[str, Sequence[str]], encoding: str = "UTF-8", **options) -> DataFrame:
    """Files with headers of their own: resolve each, skip the unusable, stack the rest with ``file_idx``, the place in ``paths``.

    Files with the same header are one scan, so the plan grows with the kinds of headers and not with the number of files.
    Files that are not there, are empty or lack a required column are left out with a warning.
    """
    places = {_plain(p): i for i, p in enumerate(paths)}
    there = {_plain(f) for folder in {os.path.dirname(p) for p in paths} for f in _listed(spark, _escaped(folder))}
    present = {_plain(p): _escaped(p) for p in paths if _plain(p) in there}
    found: dict[str, list[str]] = {}
    for row in headers(spark, list(present.values()), encoding).collect() if present else []:  # one row a file, as many as names were given
        found.setdefault(row["header"], []).append(row["path"])
    for path in set(places).difference(*found.values()):
        log.warning("skipping %s: not there or empty", path)
    index = spark.createDataFrame([(p, places[p]) for listed in found.values() for p in listed], "_path string, file_idx int")
    parts = []
    for listed in found.values():
        part = strip_headers(read_csv(spark, [present[p] for p in listed], encoding=encoding, **options))
        names = resolve_names(part, fragments)
        if names is not None:
            parts.append(part.select(*[F.col(f"`{src}`").alias(name) for name, src in names.items()], _file().alias("_path")))
    if not parts:
        raise ValueError("none of the files is usable")
    return union_all(parts).join(index, "_path").drop("_path")


def tolerant_load(
    spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, required: Sequence[str], encoding: str = "UTF-8"
) -> tuple[DataFrame, DataFrame]:
    """What can be read of the files, with ``path`` and ``broken`` (a line that does not fit the schema), and a report by file.

    The report lists every file there is: ``status`` (read, no header: a required column is missing, nothing read: empty or
    unreadable), n_rows, n_broken and n_missing (rows without a value in the first required column). Files that are not ``read`` add no rows.
    """
    names = F.transform(F.split("header", ","), lambda h: F.btrim(h, F.lit(' "\ufeff')))
    first = headers(spark, paths, encoding, tolerant=True)
    usable = first.select("path", (F.size(F.array_except(F.array(*[F.lit(c) for c in required]), names)) == 0).alias("usable"))
    raw = read_csv(spark, paths, schema, encoding, tolerant=True, corrupt="broken").withColumn("path", _file())
    rows = raw.join(usable.where("usable").select("path"), "path", "left_semi")
    counts = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("broken").alias("n_broken"), F.count_if(F.col(required[0]).isNull()).alias("n_missing")
    )
    found = list_files(spark, paths).join(usable, "path", "left").join(counts, "path", "left")
    status = F.when(F.col("usable").isNull(), "nothing read").when(~F.col("usable"), "no header").otherwise("read")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows, found.select("path", status.alias("status"), *map(zero, ("n_rows", "n_broken", "n_missing")))


def parse_volume(c: Column) -> Column:
    """``64.06M``, ``1,234`` or ``12624702`` as a whole number."""
    text = F.upper(F.regexp_replace(c.cast("string"), r"[\s,]", ""))
    number = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 1).try_cast("decimal(20,6)")
    unit = F.regexp_extract(text, r"^([0-9]*\.?[0-9]+)([KMB]?)$", 2)
    factor = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.round(number * factor, 0).cast("long")


def parse_prices(raw: DataFrame) -> DataFrame:
    """Text prices of any of the known styles as date, open, high, low, close and volume."""

    def number(c: str) -> Column:
        return F.regexp_replace(F.col(c), ",", "").try_cast("double")

    return raw.select(
        *[c for c in raw.columns if c not in PRICE_TEXT.names],
        parse_date(F.col("Date")).alias("d"),
        *[number(c).alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        parse_volume(F.col("`Vol.`")).alias("volume"),
    )


def parse_launches(raw: DataFrame) -> DataFrame:
    """Launch calendar as d, entity, product, category, kind; rows without a readable date are dropped."""
    return raw.select(
        parse_date(F.col("Date")).alias("d"),
        F.lower("Company").alias("entity"),
        F.col("Product").alias("product"),
        F.col("Category").alias("category"),
        F.col("Type").alias("kind"),
    ).where(F.col("d").isNotNull())


def file_profile(df: DataFrame, d: str = "d", file: str = "file") -> DataFrame:
    """Rows and date span per file, and whether the year in its name differs from the year of its data."""
    named = F.regexp_extract(file, r"((?:19|20)\d\d)", 1).try_cast("int")
    return (
        df.groupBy(file)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(d).alias("first_day"), F.max(d).alias("last_day"))
        .withColumns(
            {
                "file_year": named,
                "year_mismatch": F.coalesce((named < F.year("first_day")) | (named > F.year("last_day")), F.lit(False)),
            }
        )
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Non-null and distinct-estimate counts per column, in one pass: (column, n_rows, n_present, n_distinct)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(F.col(f"`{c}`")).alias("n_present"),
                F.approx_count_distinct(F.col(f"`{c}`")).alias("n_distinct"),
            )
            for c in df.columns
        ]
    )
    return df.agg(cells.alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
