"""Scene maps kept up to date as scans arrive, also late and out of order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..grid import EVIDENCE, LIMIT

#: Frames behind the newest that a scan may arrive and still count.
LATE = 16
CELLS = np.dtype([("row", "<i4"), ("col", "<i4"), ("value", "<f8"), ("n_scans", "<i8")])
SCANS = np.dtype([("frame_idx", "<i4"), ("row", "<i4"), ("col", "<i4"), ("n_hits", "<i8"), ("is_free", "<i8")])


def _merged(scans: np.ndarray) -> np.ndarray:
    """One entry for each frame and cell, frames in order: rows of a scan may come apart."""
    keys = ["frame_idx", "row", "col"]
    scans = scans[np.lexsort([scans[k] for k in reversed(keys)])]
    if not len(scans):
        return scans
    first = np.flatnonzero(np.r_[True, np.any([scans[k][1:] != scans[k][:-1] for k in keys], axis=0)])
    out = scans[first].copy()
    out["n_hits"], out["is_free"] = np.add.reduceat(scans["n_hits"], first), np.maximum.reduceat(scans["is_free"], first)
    return out


def _folded(cells: np.ndarray, scans: np.ndarray) -> np.ndarray:
    """``cells`` after ``scans``, which are merged: scan by scan, all cells of a scan at once."""
    if not len(scans):
        return cells
    code = lambda a: a["row"].astype(np.int64) << 32 | a["col"]
    every, at = np.unique(np.r_[code(cells), code(scans)], return_index=True)
    out = np.zeros(len(every), dtype=CELLS)
    both = np.concatenate([cells[["row", "col"]], scans[["row", "col"]]])[at]
    out["row"], out["col"] = both["row"], both["col"]
    own = np.searchsorted(every, code(cells))
    out["value"][own], out["n_scans"][own] = cells["value"], cells["n_scans"]
    starts = np.flatnonzero(np.r_[True, scans["frame_idx"][1:] != scans["frame_idx"][:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(scans)], strict=True):
        hit = np.searchsorted(every, code(scans[a:b]))
        up = np.minimum(LIMIT, out["value"][hit] + scans["n_hits"][a:b] * EVIDENCE)
        out["value"][hit] = np.maximum(-LIMIT, up - scans["is_free"][a:b] * EVIDENCE)
        out["n_scans"][hit] += 1
    return out


def live_scene_map(evidence: DataFrame, late: int = LATE) -> DataFrame:
    """``dataset, scene_id, row, col, value, n_scans`` after each batch, for cells that the batch or a scan still open touched.

    ``evidence`` is a stream of (dataset, scene_id, frame_idx, row, col, n_hits, is_free). The clamp makes order matter, so scans
    count in the order of frame_idx however they arrive: a scene's state is its map up to ``late`` frames behind the
    newest, and the scans after that, which are folded anew in each batch. Scans that arrive further behind are left out, as what lies
    behind a watermark is. Rows of a scan may arrive apart.
    """
    schema = "dataset string, scene_id string, row int, col int, value double, n_scans long"

    def add(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, cells, waiting = state.get if state.exists else (None, b"", b"")
        cells, waiting = np.frombuffer(cells, dtype=CELLS), np.frombuffer(waiting, dtype=SCANS)
        new = [waiting]
        for pdf in frames:
            part = np.empty(len(pdf), dtype=SCANS)
            for name in SCANS.names:
                part[name] = pdf[name].to_numpy()
            new.append(part if done is None else part[part["frame_idx"] > done])
        scans = _merged(np.concatenate(new))
        if len(scans):
            newest = int(scans["frame_idx"][-1])
            done = newest - late if done is None else max(done, newest - late)
            cells = _folded(cells, scans[scans["frame_idx"] <= done])
        waiting = scans[scans["frame_idx"] > done] if len(scans) else scans
        state.update((done, cells.tobytes(), waiting.tobytes()))
        now, touched = _folded(cells, waiting), np.unique(scans[["row", "col"]])
        now = now[np.isin(now["row"].astype(np.int64) << 32 | now["col"], touched["row"].astype(np.int64) << 32 | touched["col"])]
        yield pd.DataFrame({"dataset": key[0], "scene_id": key[1], **{n: now[n] for n in CELLS.names}})

    return evidence.groupBy("dataset", "scene_id").applyInPandasWithState(add, schema, "done int, cells binary, waiting binary", "update", "NoTimeout")
