"""Source files from directories, single files and archives."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.config import LANGUAGES, ScanConfig
from siltstone.functions.text import language_of, matches_glob, under_directory, universal_newlines

_LOCATION = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?")
_ARCHIVE_BATCH = 16 << 20


def _any_case_glob(suffixes) -> str:
    def letters(suffix: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)

    return "*{" + ",".join(letters(s) for s in suffixes) + "}"


ANY_SOURCE = _any_case_glob(LANGUAGES)  # path glob of all files of a known language


def _plain_root(root: str) -> str:
    bare = _LOCATION.sub("", root)
    return (bare if bare != root else os.path.abspath(root)).rstrip("/")


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, without scheme and host."""
    bare = F.regexp_replace(path, _LOCATION.pattern, "")
    return F.substr(bare, F.lit(len(_plain_root(root)) + 2))


def wanted(path: Column, config: ScanConfig) -> Column:
    """Whether a scan takes the file, judged by its path below the root."""
    keep = language_of(path).isNotNull()
    if config.dirs:
        keep &= ~under_directory(path, config.dirs)
    if config.patterns:
        keep &= ~matches_glob(path, config.patterns)
    return keep


def decoded(files: DataFrame) -> DataFrame:
    """FILES from (path, bytes); files that are not UTF-8 give no rows."""
    text = universal_newlines(F.decode("content", "UTF-8"))
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(
        "path", language_of(F.col("path")).alias("language"), text.alias("content")
    )


def scan_tree(spark: SparkSession, root: str, config: ScanConfig | None = None) -> DataFrame:
    """FILES below ``root``; paths are relative to it.

    Exclusions are tested on the file listing (``_metadata``), so an excluded
    file is never opened.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ANY_SOURCE)
        .load(root)
    )
    # The listing has the path percent-encoded.
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    kept = listed.where(wanted(relative_path(F.url_decode(encoded), root), config or ScanConfig()))
    return decoded(kept.select(relative_path(F.col("path"), root).alias("path"), "content"))


def scan_file(spark: SparkSession, path: str) -> DataFrame:
    """FILES of one file, whatever the exclusions say about it."""
    single = spark.read.format("binaryFile").load(path)
    named = single.select(F.lit(path).alias("path"), "content")
    return decoded(named.where(language_of(F.col("path")).isNotNull()))


def scan_archives(spark: SparkSession, path: str, config: ScanConfig | None = None) -> DataFrame:
    """FILES inside zip archives; paths are the names in the archive."""
    suffixes = tuple(LANGUAGES)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    rows, size = [], 0
                    for name in archive.namelist():
                        if name.lower().endswith(suffixes):
                            rows.append((name, archive.read(name)))
                            size += len(rows[-1][1])
                        if size >= _ARCHIVE_BATCH:
                            yield pd.DataFrame(rows, columns=["path", "content"])
                            rows, size = [], 0
                    yield pd.DataFrame(rows, columns=["path", "content"])

    archives = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("content")
    )
    unpacked = archives.mapInPandas(members, "path string, content binary")
    return decoded(unpacked.where(wanted(F.col("path"), config or ScanConfig())))
