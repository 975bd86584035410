"""Readers. A path may be a file, a folder or a pattern; compressed files are read as they are."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumage import schemas


def tweets(spark: SparkSession, path: str, schema: T.StructType = schemas.TWEET, spread: int | None = None) -> DataFrame:
    """JSON lines with an explicit schema, ``source_file`` and ``source_dir`` added; broken lines have nulls.

    ``spread`` repartitions afterwards, for gzip files, which can't be split.
    """
    df = spark.read.schema(schema).json(path)
    p = F.col("_metadata.file_path")
    df = df.select("*", F.element_at(F.split(p, "/"), -1).alias("source_file"), F.element_at(F.split(p, "/"), -2).alias("source_dir"))
    return df.repartition(spread) if spread else df


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, raw_line)."""
    return spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), F.col("value").alias("raw_line"))


def follows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FOLLOW).json(path)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight): a stored graph (Parquet). One with a missing end, a self-loop, or an edge whose way
    back is missing or weighs otherwise is refused; edges may repeat, each with as many ways back."""
    df = spark.read.schema(schemas.EDGE).parquet(path)
    loops = df.where("src IS NULL OR dst IS NULL OR src = dst").limit(1).count()
    # each edge counts for its pair of ends, once up and once down
    up = F.when(F.col("src") < F.col("dst"), 1).otherwise(-1)
    one_way = df.groupBy(F.least("src", "dst"), F.greatest("src", "dst"), "weight").agg(F.sum(up).alias("n")).where("n <> 0").limit(1).count()
    if loops or one_way:
        raise ValueError(f"inconsistent graph in {path}: {'a self-loop or a missing end' if loops else 'an edge without its way back'}")
    return df


def locations(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated user, latitude, longitude without header."""
    return spark.read.csv(path, sep="\t", schema=schemas.LOCATION)


def location_model(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, lat, lon) of a written model of locations, plain or compressed; a line that isn't one is an error.

    Of a user's several lines the one with the greatest values holds.
    """
    rows = spark.read.csv(path, sep="\t", schema=schemas.LOCATION, mode="FAILFAST").where("user_id IS NOT NULL")
    return rows.groupBy("user_id").agg(F.max(F.struct("lat", "lon")).alias("m")).select("user_id", "m.lat", "m.lon")


def id_set(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(id), distinct: the first column, trimmed, blanks skipped, as text."""
    return spark.read.text(path).select(F.trim(F.substring_index("value", sep, 1)).alias("id")).where("id != ''").distinct()


def labelled(spark: SparkSession, *paths: str) -> DataFrame:
    """Labelled texts from CSV with header; quoted texts may hold line breaks. Several files are joined."""
    return spark.read.csv(list(paths), header=True, schema=schemas.LABELLED, multiLine=True, escape='"')


def rater_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rater sheets (CSV) of a two-level folder: rater folder / sheet file, with file_name and rater."""
    df = spark.read.csv(path, header=True, schema=schemas.RATING, multiLine=True, escape='"')
    p = F.col("_metadata.file_path")
    return df.select("*", F.element_at(F.split(p, "/"), -1).alias("file_name"), F.element_at(F.split(p, "/"), -2).alias("rater"))


def paired_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, paths): files of the same name in exactly two folders; others are skipped."""
    files = spark.read.format("binaryFile").load(path).select("path")  # content isn't read
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path")
    return named.groupBy("file_name").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") == 2)


def ragged(spark: SparkSession, path: str, fixed: int) -> DataFrame:
    """(cols, rest): the first ``fixed`` fields of tab-separated lines and the remaining ones."""
    a = F.split("value", "\t")
    return spark.read.text(path).where("value != ''").select(F.slice(a, 1, fixed).alias("cols"), F.slice(a, fixed + 1, F.greatest(F.size(a) - fixed, F.lit(0))).alias("rest"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): lower-case lines, blanks dropped, distinct."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("term")).where("term != ''").distinct()


def titles(spark: SparkSession, path: str) -> DataFrame:
    """(title, tokens): lower-case titles without bracketed parts."""
    t = F.trim(F.regexp_replace(F.lower(F.trim("value")), r"[(\[].*?[)\]]", ""))
    return spark.read.text(path).select(t.alias("title")).where("title != ''").distinct().withColumn("tokens", F.split("title", " "))


class SheetSource(DataSource):
    """``sheet``: Excel workbooks through pandas, one partition a file; needs an Excel engine for pandas."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "file_name string, row_idx int, " + ", ".join(f"{f.name} string" for f in schemas.RATING.fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SheetReader(self.options)


class _SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pandas as pd

        pdf = pd.read_excel(partition.value, dtype=str)
        names = len(schemas.RATING.fields)
        for i, row in enumerate(pdf.itertuples(index=False)):
            cells = [None if pd.isna(v) else str(v) for v in row[:names]]
            yield (partition.value.rsplit("/", 1)[-1], i, *cells, *[None] * (names - len(cells)))


def sheets(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(SheetSource)
    return spark.read.format("sheet").load(",".join(paths))
