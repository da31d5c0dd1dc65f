"""Keyed state of streams, held by the engine's state store: the newest rows of a key, and its last alert."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS, ID = "started_us", "id"


def plain(value):
    """A value as a state can hold it: arrays as lists, missing numbers as null."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if value is None or (isinstance(value, float) and math.isnan(value)) else value


def newest_of(schema: T.StructType, n: int, idle_ms: int | None) -> Callable:
    """Keeps the newest ``n`` slim rows of a key and returns them whenever the key is touched."""
    names = schema.names
    us, name = names.index(MICROS), names.index(ID)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = [tuple(row) for row in state.get[0]] if state.exists else []
        # A key may bring any number of rows; only n are held.
        for part in parts:
            fresh = [tuple(map(plain, row)) for row in part[names].itertuples(index=False, name=None)]
            best = heapq.nlargest(n, [*best, *fresh], key=lambda row: (row[us], row[name]))
        state.update((best,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        columns = {f"key_{k}": [v] * len(best) for k, v in enumerate(key)}
        yield pd.DataFrame(columns | {c: pd.Series([row[k] for row in best], dtype=object) for k, c in enumerate(names)})

    return step


def changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last score of a key and returns the rows whose score differs from the one before, by batch."""
    told = pd.concat(list(parts)).sort_values("batch_id", kind="stable")  # one row per batch of the scoring stream
    before = state.get[0] if state.exists else None
    own = told["score"].tolist()
    state.update((own[-1],))
    yield told[[score != earlier for score, earlier in zip(own, [before, *own], strict=False)]]


def newest_rows(stream: DataFrame, by: Sequence[str], columns: Sequence[str], n: int, idle_ms: int | None = None) -> DataFrame:
    """The newest ``n`` rows (start, then id) of every key that a batch touches, from a stream with ``started_at`` and ``id``.

    ``columns`` are what is kept of a row. A batch reads and writes the state of its own keys only. Before rows are
    dealt by key each Arrow batch lets its newest ``n`` rows of a key pass, so a key that a third of all rows belong to
    sends few of them. With ``idle_ms``, keys without a row for so long are forgotten. Rows that repeat an id count each; a null id comes last.
    """
    by, kept = list(by), [MICROS, ID, *columns]
    slim = stream.select(*by, F.unix_micros(F.col("started_at").cast("timestamp")).alias(MICROS), F.coalesce(F.col(ID), F.lit("")).alias(ID), *columns)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_at", pa.array(range(batch.num_rows)))
            order = table.select([*by, MICROS, ID, "_at"]).sort_by([(MICROS, "descending"), (ID, "descending"), ("_at", "ascending")]).to_pandas()
            places = order.groupby(by, sort=False, dropna=False).head(n)["_at"].to_numpy()
            yield from table.take(pa.array(places)).drop_columns(["_at"]).to_batches()

    state = T.StructType([slim.schema[c] for c in kept])
    out = T.StructType([T.StructField(f"key_{k}", slim.schema[c].dataType) for k, c in enumerate(by)] + state.fields)
    trimmed = slim.mapInArrow(trim, slim.schema)
    clock = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    held = T.StructType([T.StructField("rows", T.ArrayType(state))])
    found = trimmed.groupBy(*by).applyInPandasWithState(newest_of(state, n, idle_ms), out, held, "update", clock)
    return found.withColumnsRenamed({f"key_{k}": c for k, c in enumerate(by)})


def changed_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of a stream of scores (key, ``score``, ``batch_id``) whose score differs from the key's last one."""
    return scores.groupBy(*by).applyInPandasWithState(changed, scores.schema, "score double", "update", GroupStateTimeout.NoTimeout)
