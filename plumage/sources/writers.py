"""Writers. The default refuses to overwrite; overwriting is asked for by ``mode``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFUSE = "errorifexists"


def json_lines(df: DataFrame, path: str, by: list[str] | None = None, mode: str = REFUSE, compression: str | None = None) -> None:
    """JSON lines, a folder for each value of ``by`` (source folder or file)."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).json(path, compression=compression)


def tsv(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """Tab-separated without header: locations, folds, id lists."""
    df.write.mode(mode).csv(path, sep="\t")


def ids_only(df: DataFrame, path: str, key: str = "id", by: list[str] | None = None, mode: str = REFUSE) -> None:
    """One id a line, mirroring the folders named by ``by``."""
    w = df.select(F.col(key).cast("string").alias("value"), *(by or [])).write.mode(mode)
    (w.partitionBy(*by) if by else w).text(path)


def append_ids(df: DataFrame, path: str, key: str = "id") -> None:
    """Ids appended to what is there; runs may repeat ids."""
    df.select(F.col(key).cast("string").alias("value")).write.mode("append").text(path)


def csv(df: DataFrame, path: str, mode: str = REFUSE) -> None:
    """CSV with header; quotes are doubled, so that line breaks in texts survive."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def ranked(df: DataFrame, path: str, key: str, values: str, mode: str = REFUSE) -> None:
    """Ragged tab-separated lines: the key and its values in order."""
    df.select(F.concat_ws("\t", F.col(key), F.concat_ws("\t", F.col(values))).alias("value")).write.mode(mode).text(path)
