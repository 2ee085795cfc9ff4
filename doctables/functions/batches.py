"""Output batches of Arrow functions, bounded by bytes because rows carry files or images."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

MAX_BYTES = 32 * 1024 * 1024
MAX_ROWS = 4096


def batched(rows: Iterable[tuple], columns: list[str], size_of) -> Iterator[pd.DataFrame]:
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size_of(row)
        if held_bytes >= MAX_BYTES or len(held) >= MAX_ROWS:
            yield pd.DataFrame(held, columns=columns)
            held, held_bytes = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
