"""CSV and JSON files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldseam.operators.flatten import MATCH_DOCUMENT, SQUAD_ROW
from goldseam.operators.infer import retype
from goldseam.sources.records import json_documents, spanning_records

#: Files of more bytes than this, whose records or documents span lines, are cut by many tasks; smaller ones are a task each.
LARGE_FILE = 128 << 20
_CSV = {"header": "true", "quote": '"', "escape": '"', "encoding": "UTF-8", "mode": "PERMISSIVE"}


def _odd_quotes() -> Column:
    """Whether a line opens or closes a quoted value that goes on in another line: inside values, quotes are doubled."""
    return (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1


def has_spanning_records(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value of the files holds a line break."""
    return not spark.read.text(path).filter(_odd_quotes()).limit(1).isEmpty()


def csv_layouts(spark: SparkSession, path: str, multi_line: bool | None = None) -> list[tuple[list[str], bool, bool]]:
    """Files with the same header line, whether their records span lines, and whether they are large.

    One scan of the files. A file gives one row and a header one row, so what comes
    back is no more than a listing of the folder. With ``multi_line`` given, only
    first lines are looked at.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), at.alias("at"))
    odd = _odd_quotes() if multi_line is None else F.lit(multi_line)
    first = F.min_by("value", F.when(F.trim("value") != "", F.col("at")))
    large = F.first("size") > LARGE_FILE
    files = lines.groupBy("file").agg(
        F.regexp_replace(first, "^\ufeff", "").alias("header"), F.bool_or(odd).alias("spans"), large.alias("large")
    )
    kinds = ["header", "spans", "large"]
    groups = files.filter(F.col("header").isNotNull()).groupBy(*kinds).agg(F.array_sort(F.collect_list("file")).alias("files"))
    return [(r["files"], r["spans"], r["large"]) for r in groups.orderBy(*kinds).collect()]


def read_csv_text(
    spark: SparkSession,
    path: str,
    columns: list[str] | None = None,
    multi_line: bool | None = None,
    surplus: str | None = None,
    cut: bool | None = None,
) -> DataFrame:
    """Columns as text, found by their name in the header of their own file; one that a file lacks is null.

    Files are read in groups of one header each. Those whose records span lines are a task
    each up to LARGE_FILE bytes; larger ones have their records put together from lines
    that many tasks read (:mod:`goldseam.sources.records`), which gives the same rows, and
    so do all with ``cut``, or none without. ``multi_line`` says whether records span lines,
    of all files, without looking. A column named by
    ``surplus`` holds the first value beyond the header of a row that has more.
    """
    parts = []
    for files, spans, large in csv_layouts(spark, path, multi_line):
        names = spark.read.options(**_CSV, multiLine=str(spans).lower()).csv(files).columns
        # By place, as the header has no name for it; all files of the group share the header.
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, *([surplus] if surplus else [])]])
        if spans and (large if cut is None else cut):
            parsed = F.from_csv("record", _ddl(schema), {k: v for k, v in _CSV.items() if k != "header"})
            parts.append(spanning_records(spark, files).filter("not head").select(parsed.alias("r")).select("r.*"))
        else:
            parts.append(spark.read.options(**_CSV, multiLine=str(spans).lower()).schema(schema).csv(files))
    if not parts:
        raise ValueError(f"CSV has no header: {path}")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if columns is None:
        return df
    missing = F.lit(None).cast("string")
    wanted = [*columns, *([surplus] if surplus else [])]
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else missing).alias(c) for c in wanted])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_csv_typed(
    spark: SparkSession, path: str, types: dict[str, str], multi_line: bool | None = None, cut: bool | None = None
) -> DataFrame:
    """Every value coerced to its type; a value that does not parse is null."""
    return retype(read_csv_text(spark, path, list(types), multi_line, cut=cut), types)


def _cut(spark: SparkSession, path: str, cut: bool | None) -> bool:
    """Whether to cut files into documents: as asked for, or if any is large. Lengths come from the listing, no file is read."""
    if cut is not None:
        return cut
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return not files.filter(F.col("length") > LARGE_FILE).limit(1).isEmpty()


def _json_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool, cut: bool | None) -> DataFrame:
    if multi_line and _cut(spark, path, cut):
        # As a generator, so that filters on the fields do not parse the documents again.
        return json_documents(spark, path).select(F.inline(F.array(F.from_json("document", schema))))
    return spark.read.schema(schema).option("multiLine", str(multi_line).lower()).json(path)


def read_match_documents(spark: SparkSession, path: str, multi_line: bool = True, cut: bool | None = None) -> DataFrame:
    """One row per match document; with ``multi_line`` off, one document per line.

    A file may hold one document or an array of them. Large multi-line files are cut into
    documents by many tasks (``cut`` says so of all files, or of none); the rows are the same.
    """
    return _json_rows(spark, path, MATCH_DOCUMENT, multi_line, cut)


def read_variant_documents(
    spark: SparkSession, path: str, name: str = "doc", multi_line: bool = True, cut: bool = False
) -> DataFrame:
    """One VARIANT per file (or line), which keeps JSON nulls and unknown fields.

    With ``cut``, one per document: the objects of a file's array are rows of their own,
    and a file of any size is read by many tasks.
    """
    if multi_line and cut:
        return json_documents(spark, path).select(F.try_parse_json("document").alias(name))
    return (
        spark.read.schema(f"{name} variant")
        .option("singleVariantColumn", name)
        .option("multiLine", str(multi_line).lower())
        .json(path)
    )


def read_squads(spark: SparkSession, path: str, multi_line: bool = True, cut: bool | None = None) -> DataFrame:
    """One row per team of the squad documents; files are read as by :func:`read_match_documents`."""
    return _json_rows(spark, path, SQUAD_ROW, multi_line, cut)
