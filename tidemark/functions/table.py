"""Table functions for SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunking import cuts


@udtf(returnType="pos long, start_off long, size long, digest string")
class ChunkText:
    """chunk_text(data, average): the content-defined chunks of a value."""

    def eval(self, data: bytes, average: int) -> Iterator[tuple]:
        at, data = 0, bytes(data or b"")
        for pos, end in enumerate(cuts(data, average)):
            yield pos, at, end - at, hashlib.sha256(data[at:end]).hexdigest()
            at = end


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL."""
    spark.udtf.register("chunk_text", ChunkText)
