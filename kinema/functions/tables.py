"""Table functions for SQL users; explode(sequence(..)) gives the same rows without Python."""

from __future__ import annotations

from pyspark.sql.functions import udtf


@udtf(returnType="chunk_start: int, chunk_end: int")
class chunk_table:  # noqa: N801
    """UD3: windows of `size` frames inside [start, end) at every stride."""

    def eval(self, start: int, end: int, size: int, stride: int):
        for at in range(start, end - size + 1, stride):
            yield at, at + size
