"""Readers for parallel text: header TSV, tab-separated lines, nested records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lingweave.sources.quoted import read_records

# Texts a table reader takes as missing.
NA_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
PAIR_COLUMNS = ("hi_en", "en")


def _in_order(read: Callable[[str], DataFrame], files: Sequence[str]) -> DataFrame:
    """Read every listed file or folder and add ``ordinal``: place in the list, file, block in
    the file, row in the block. One read per item, so that no path has to be recognised."""

    def numbered(place: int, item: str) -> DataFrame:
        return read(item).select(
            "*",
            F.struct(
                F.lit(place).alias("file"),
                F.col("_metadata.file_path").alias("path"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ordinal"),
        )

    return reduce(DataFrame.unionByName, [numbered(i, f) for i, f in enumerate(files)])


def _fields_present(raw: Column) -> Column:
    """Fields of a raw record: tabs outside quoted fields, plus one."""
    single = F.replace(raw, F.lit('""'), F.lit(""))
    bare = F.regexp_replace(single, '(^|\\t)"[^"]*"', "$1")
    return F.length(bare) - F.length(F.replace(bare, F.lit("\t"), F.lit(""))) + 1


def read_tsv_pairs(
    spark: SparkSession,
    files: Sequence[str],
    header: Sequence[str],
    source: str,
    columns: tuple[str, str] = ("en_query", "cs_query"),
    multiline: bool = False,
) -> DataFrame:
    """``hi_en, en, source, ordinal`` from TSV files with a header.

    ``header`` names the columns in file order; ``columns`` are target, then
    source text. Records with too many fields are skipped, short ones are padded
    with nulls, rows without one of the two texts are dropped. Files split between tasks,
    also with ``multiline``, which reads quoted line breaks.
    """
    fields = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "_extra", "_raw"]])
    options = {"sep": "\t", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw"}
    if multiline:
        records = read_records(spark, files)
        rows = records.select(
            F.from_csv("text", fields.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r"), F.struct("file", "path", "block", "row").alias("ordinal")
        ).select("r.*", "ordinal")
    else:
        # a pruned parse would not notice surplus fields
        rows = _in_order(spark.read.schema(fields).options(header=True, columnPruning=False, **options).csv, files)
    # A good record is one field short of the widened schema, so it has a raw copy.
    whole = rows.where(F.col("_raw").isNotNull() & (_fields_present(F.col("_raw")) <= len(header)))
    target, text = columns
    return drop_missing(
        whole.select(
            F.col(text).alias("hi_en"), F.col(target).alias("en"), F.lit(source).alias("source"), "ordinal"
        ),
        PAIR_COLUMNS,
    )


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows whose text is null or spelt as a missing value."""
    present = [F.col(c).isNotNull() & ~F.col(c).isin(NA_TEXTS) for c in columns]
    return df.where(reduce(lambda a, b: a & b, present))


def read_line_pairs(spark: SparkSession, files: Sequence[str], source: str, strict: bool = False) -> DataFrame:
    """``hi_en, en, source, ordinal`` from lines ``en<TAB>hi_en``; the line end is not part of a text.

    A line with more fields stops the job. A shorter one is padded with null and dropped,
    or stops the job as well when ``strict``.
    """
    rows = _in_order(spark.read.text, files).withColumn("fields", F.split("value", "\t"))
    good = F.size("fields") == 2 if strict else F.size("fields") <= 2
    problem = F.concat(F.lit("line without exactly two fields: "), F.col("value"))
    pairs = rows.withColumn("fields", F.when(good, F.col("fields")).otherwise(F.raise_error(problem))).select(
        F.get("fields", F.lit(1)).alias("hi_en"), F.get("fields", F.lit(0)).alias("en"), F.lit(source).alias("source"), "ordinal"
    )
    return pairs if strict else pairs.where("hi_en is not null")


def extract_translation(
    df: DataFrame, lang_keys: tuple[str, str] = ("en", "hi_en"), source: str = "nested", column: str = "translation"
) -> DataFrame:
    """Replace a struct or map of translations by ``hi_en, en, source``; other columns stay.

    ``lang_keys`` are the target and the source key.
    """
    target, text = lang_keys
    nested = F.col(column)
    if isinstance(df.schema[column].dataType, T.MapType):
        pick = lambda key: F.try_element_at(nested, F.lit(key))
    else:
        pick = nested.getField
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, pick(text).alias("hi_en"), pick(target).alias("en"), F.lit(source).alias("source"))


def load_nested(
    spark: SparkSession, path: str, lang_keys: tuple[str, str], source: str, split: str = "train", fmt: str = "parquet"
) -> DataFrame:
    """A stored nested dataset as pairs; without a ``split`` column it is one split."""
    df = extract_translation(spark.read.format(fmt).load(path), lang_keys, source)
    return df if "split" in df.columns else df.withColumn("split", F.lit(split))


def load_splits(reader, files: Mapping[str, Sequence[str]], splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Read the files of every configured split with ``reader(files)`` into one table."""
    parts = [reader(files[s]).withColumn("split", F.lit(s)) for s in splits if s in files]
    return reduce(DataFrame.unionByName, parts)


def merge_sources(datasets: Mapping[str, DataFrame]) -> DataFrame:
    """One long table of all datasets; ``dataset_ord`` keeps their order."""
    parts = [
        df.withColumn("dataset", F.lit(name)).withColumn("dataset_ord", F.lit(i))
        for i, (name, df) in enumerate(datasets.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pair_view(df: DataFrame, src: str = "hi_en", tgt: str = "en", denoise: bool = False, row: str = "row_id") -> DataFrame:
    """``row, src, tgt`` of a translation mode; denoising learns the source from itself."""
    return df.select(row, F.col(src).alias("src"), F.col(src if denoise else tgt).alias("tgt"))


def mode_view(df: DataFrame, mode: str, modes: Mapping[str, Mapping[str, str]], row: str = "row_id") -> DataFrame:
    """:func:`pair_view` with the source and target column that a mode table names."""
    return pair_view(df, modes[mode]["src"], modes[mode]["tgt"], row=row)


