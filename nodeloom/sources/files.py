"""Rows written as files of their own, in any store that ``pyarrow.fs`` knows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(files: DataFrame, path: str) -> int:
    """Write each row (``name``, ``content``: binary or string) as a file of the folder ``path``; returns how many.

    Tasks write the files; one that runs again writes the same names again.  Of equal names one file stays.
    """

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    return rows.mapInPandas(written, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
