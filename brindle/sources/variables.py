"""Variables kept for a while in the shared folder: tables, arrays, lists and dictionaries, told apart by their kind."""

from __future__ import annotations

import io
import json
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from brindle.sources.files import discard, scratch

#: Bytes of an array or a JSON text in one row.
PIECE = 1 << 24


class KeptVariables:
    """A folder of its own, below the one that all executors share. Tables, sparse matrices as rows among them, are written by the executors;
    the others are the driver's and are written in pieces."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, scratch(spark, "variables")

    def save(self, value: Any) -> str:
        """Where the value is kept; a type that isn't known is an error."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        if isinstance(value, DataFrame):
            kind, data = "table", b""
            value.write.parquet(f"{path}/table")
        elif isinstance(value, np.ndarray):
            held = io.BytesIO()
            np.save(held, value, allow_pickle=False)
            kind, data = "array", held.getvalue()
        elif isinstance(value, (list, dict)):
            kind, data = type(value).__name__, json.dumps(value).encode()
        else:
            raise TypeError(f"{type(value).__name__} can't be kept")
        pieces = [(kind, k, bytearray(data[at : at + PIECE])) for k, at in enumerate(range(0, max(1, len(data)), PIECE))]
        self.spark.createDataFrame(pieces, "kind string, piece int, data binary").write.parquet(f"{path}/value")
        return path

    def load(self, path: str) -> Any:
        pieces = sorted(self.spark.read.parquet(f"{path}/value").collect(), key=lambda r: r["piece"])
        if pieces[0]["kind"] == "table":
            return self.spark.read.parquet(f"{path}/table")
        data = b"".join(bytes(r["data"]) for r in pieces)
        return np.load(io.BytesIO(data), allow_pickle=False) if pieces[0]["kind"] == "array" else json.loads(data)

    def delete(self, path: str) -> None:
        """Nothing happens if it isn't there."""
        discard(self.spark, path)

    def delete_all(self) -> None:
        self.delete(self.folder)
