"""NumPy archives as a data source: one row per file and position of its first axis.

``spark.read.format("npz").schema(...).load(glob)`` reads the named arrays; a column ``file`` holds the
path. Arrays shorter than the longest give nulls, missing ones too, so that layouts are told by which
columns are null. One file is one partition; more than one trailing axis is flattened.
"""

from __future__ import annotations

import glob
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType


class NpzSource(DataSource):
    """The 'npz' format."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        raise ValueError("an npz source needs a schema")

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, self.options)


class NpzReader(DataSourceReader):
    """Reads archives file by file."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields = [(f.name, isinstance(f.dataType, ArrayType)) for f in schema.fields]
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None or partition.value is None:
            return
        with np.load(partition.value, allow_pickle=False) as data:
            held = {n: np.atleast_1d(data[n]) for n, _ in self.fields if n in data.files}
        count = max((len(a) for a in held.values()), default=0)
        for k in range(count):
            row = []
            for name, many in self.fields:
                a = held.get(name)
                if name == "file":
                    row.append(partition.value)
                elif a is None or k >= len(a):
                    row.append(None)
                else:
                    row.append(np.asarray(a[k]).reshape(-1).tolist() if many else a[k].item())
            yield tuple(row)


def register(spark) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(NpzSource)
