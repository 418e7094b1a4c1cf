"""Arrow batches inside tasks, cut to bounded pieces: Spark hands over 10,000 rows at once, however long their texts are."""

from __future__ import annotations

from typing import Iterable, Iterator

import pyarrow as pa

PIECE_ROWS = 1000
PIECE_BYTES = 4 << 20


def pieces(batches: Iterable[pa.RecordBatch], rows: int = PIECE_ROWS, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, in batches of at most ``rows`` rows and ``size`` bytes (or one row)."""
    for batch in batches:
        left = [batch]
        while left:
            b = left.pop()
            if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
                half = b.num_rows // 2
                left += [b.slice(half), b.slice(0, half)]
            else:
                yield b
