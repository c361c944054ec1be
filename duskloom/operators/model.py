"""The slot for a span model: batched, aligned with its rows, all or nothing. No model ships."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spans as S

#: texts -> for each text a list of (start, end, entity, score), in code points.
Model = Callable[[list[str]], list[list[tuple[int, int, str, float]]]]

_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("score", T.DoubleType())]))


@dataclass
class Slot:
    """disabled, loading, ready or failed. A load that a newer one has overtaken is dropped."""

    required: bool = False
    state: str = "disabled"
    generation: int = 0
    model: Model | None = None
    reason: str = ""

    def begin(self) -> int:
        self.generation += 1
        self.state, self.model, self.reason = "loading", None, ""
        return self.generation

    def finish(self, generation: int, model: Model | None, reason: str = "") -> bool:
        if generation != self.generation:
            return False
        self.state, self.model, self.reason = ("ready", model, "") if model is not None else ("failed", None, reason)
        return True

    def usable(self) -> Model | None:
        """The model; an error if one is required and isn't ready."""
        if self.required and self.state != "ready":
            raise RuntimeError(f"a model is required but it is {self.state}{': ' + self.reason if self.reason else ''}")
        return self.model


def model_spans(text: Column, slot: Slot, order: int = 1000) -> Column:
    """The model's spans, none without a model. A batch whose answer doesn't fit its texts fails the job, never yields no spans."""
    model = slot.usable()
    if model is None:
        return S.no_spans()

    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.Series:
        given = texts.fillna("").tolist()
        found = model(given)
        if len(found) != len(given):
            raise RuntimeError(f"the model gave {len(found)} answers for {len(given)} texts")
        for text, rows in zip(given, found, strict=True):
            if any(not 0 <= s < e <= len(text) for s, e, _, _ in rows):
                raise RuntimeError("a span of the model lies outside its text")
        return pd.Series([[{"start": s, "end": e, "entity": k, "score": float(x)} for s, e, k, x in rows] for rows in found])

    return F.transform(run(text), lambda m: S.span(m["start"], m["end"], m["entity"], m["score"], "ml", F.substring(text, m["start"] + 1, m["end"] - m["start"]), order=order))
