"""Score attribution over a stream of runs: the previous state of each key is the operator's state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, run_no long, delta double, cause string"
STATE = "run_no long, score double, model string, prompt string, data string"


def attribute_stream(runs: DataFrame, least: float = 0.2) -> DataFrame:
    """Append-mode rows for (key, run_no, score, model, prompt, data); runs that arrive behind a key's state are dropped."""

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(pdfs)).sort_values("run_no").itertuples():
            if last is not None and r.run_no <= last[0]:
                continue
            delta, cause = None, None
            if last is not None:
                delta = round(r.score - last[1], 4)
                if abs(delta) > least:
                    pairs = ((last[2], r.model, "model_change"), (last[3], r.prompt, "prompt_change"), (last[4], r.data, "data_change"))
                    cause = next((n for a, b, n in pairs if a and b and a != b), "external_noise")
            rows.append((key[0], int(r.run_no), delta, cause))
            last = (int(r.run_no), float(r.score), r.model, r.prompt, r.data)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(rows, columns=["key", "run_no", "delta", "cause"])

    return runs.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
