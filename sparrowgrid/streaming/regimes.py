"""The confirmation of regime changes as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.regime import confirm


def smoothed(stream: DataFrame, min_prob: float = 0.65, min_periods: int = 2) -> DataFrame:
    """(series, dt, regime, confidence) of a stream of the same columns, as ``operators.regime.smooth``.

    A series' state is three numbers. Rows of a series are taken in order of dt within a batch;
    batches must come in that order, as a daily run makes them: what is late cannot change what
    has been given out, and is left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting, seen, last = state.get if state.exists else (-1, -1, 0, "")
        rows = pd.concat(parts).sort_values("dt")
        rows = rows[rows["dt"].astype(str) > last]
        now = (None if held < 0 else held, None if waiting < 0 else waiting, seen)
        out, now = confirm(zip(rows["regime"], rows["confidence"]), min_prob, min_periods, now)
        if len(rows):
            last = str(rows["dt"].iloc[-1])
        held, waiting, seen = now
        state.update((-1 if held is None else int(held), -1 if waiting is None else int(waiting), int(seen), last))
        yield pd.DataFrame({"series": key[0], "dt": rows["dt"], "regime": [r for r, _ in out], "confidence": [c for _, c in out]})

    kind = dict(stream.dtypes)["series"]
    return stream.groupBy("series").applyInPandasWithState(
        step, f"series {kind}, dt date, regime int, confidence double", "held int, waiting int, seen int, last string", "append", GroupStateTimeout.NoTimeout
    )
