"""Rows of one key in order, in bounded memory."""

from __future__ import annotations

import heapq
import os
import tempfile
from itertools import chain, islice

import pandas as pd
import pyarrow as pa

#: Rows of a key that are sorted in memory; more are sorted in runs, which are written to disk and merged.
RUN = 500_000


def in_order(frames, *by: str):
    """The rows of all `frames` as tuples, by the columns `by`, missing values last."""

    def rank(row):
        return tuple((True, 0) if pd.isna(v) else (False, v) for v in (getattr(row, c) for c in by))

    def read(path):
        with pa.memory_map(path) as f:
            run = pa.ipc.open_file(f)
            for i in range(run.num_record_batches):
                yield from run.get_batch(i).to_pandas().itertuples(index=False)

    with tempfile.TemporaryDirectory() as folder:
        runs, held, n = [], [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= RUN:
                path = os.path.join(folder, str(len(runs)))
                table = pa.Table.from_pandas(pd.concat(held).sort_values(list(by)), preserve_index=False)
                with pa.OSFile(path, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
                    out.write_table(table, max_chunksize=2000)
                runs.append(read(path))
                held, n = [], 0
        if held:
            runs.append(pd.concat(held).sort_values(list(by)).itertuples(index=False))
        yield from heapq.merge(*runs, key=rank) if len(runs) > 1 else iter(runs[0] if runs else ())


def rows_in_order(rows, *by: str):
    """The same for rows that come one by one: few are sorted as they are, without a frame or a folder."""
    rows = iter(rows)
    held = list(islice(rows, RUN))
    if len(held) < RUN:
        return iter(sorted(held, key=lambda row: tuple((True, 0) if row[c] is None else (False, row[c]) for c in by)))
    names = list(held[0].asDict())

    def frames():
        more = chain(held, rows)
        while part := list(islice(more, RUN)):
            yield pd.DataFrame([tuple(r) for r in part], columns=names)

    return in_order(frames(), *by)
