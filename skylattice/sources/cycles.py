"""The reference table of a 28-day cycle: a CSV file in a ZIP archive."""

from __future__ import annotations

import csv
import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The archive's member, and the most bytes that it may hold unpacked.
MEMBER, MOST_BYTES = "NAV_BASE.csv", 64 << 20


def unpack(archives: DataFrame, member: str = MEMBER) -> DataFrame:
    """path, archive_checksum, and body of the member in each archive (from format binaryFile);
    archives without it, with it twice, or too large fail."""

    def run(batches):
        for batch in batches:
            texts = []
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    own = [i for i in z.infolist() if i.filename == member]
                    if len(own) != 1:
                        raise ValueError(f"{member} must be in the archive once")
                    if own[0].file_size > MOST_BYTES:
                        raise ValueError(f"{member} is larger than {MOST_BYTES} bytes")
                    with z.open(own[0]) as f:
                        body = f.read(MOST_BYTES + 1)
                    if len(body) > MOST_BYTES:
                        raise ValueError(f"{member} is larger than {MOST_BYTES} bytes")
                    texts.append(body.decode("utf-8-sig"))
            yield pd.DataFrame({"path": batch["path"], "archive_checksum": batch["archive_checksum"], "body": texts})

    hashed = archives.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("archive_checksum"), "content")
    return hashed.mapInPandas(run, "path string, archive_checksum string, body string")


def table_rows(body: str, columns: list[str]) -> list[list[str]]:
    """Rows of a CSV text below its header; other headers, header names that stand twice, and
    rows with more or fewer fields are errors. Empty lines don't count."""
    rows = [r for r in csv.reader(io.StringIO(body, newline=""), strict=True) if r]
    if not rows or rows[0] != columns or len(set(columns)) != len(columns):
        raise ValueError(f"unexpected header: {rows[0] if rows else []}")
    for i, r in enumerate(rows[1:], 2):
        if len(r) != len(columns):
            raise ValueError(f"row {i} has {len(r)} fields, not {len(columns)}")
    return rows[1:]


def parse(unpacked: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the CSV texts in ``body``, all columns text. A text is parsed by one task: it is the
    one member of an archive, of MOST_BYTES at most."""

    def run(batches):
        for batch in batches:
            for body in batch["body"]:
                yield pd.DataFrame(table_rows(body, columns), columns=columns, dtype=object)

    return unpacked.select("body").mapInPandas(run, StructType([StructField(c, StringType()) for c in columns]))


def read_cycle(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the CSV in the archives at ``path``."""
    return parse(unpack(spark.read.format("binaryFile").load(path)), columns)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of plain CSV files: quotes are doubled, line ends may stand in quotes, every row has
    all columns, the header is the given one."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="FAILFAST", enforceSchema=False, emptyValue="").na.fill("")
