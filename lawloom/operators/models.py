"""Models as plug-ins: functions of lists of texts, called in batches, at a bounded rate and by a bounded number of tasks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawloom.functions.scalar import entity_text

#: Turns a series of texts into one of results (vectors, answers); a model is loaded once a task.
Model = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]
#: Turns a list of texts into a list of results of the same length.
Call = Callable[[Sequence[str]], Sequence[object]]
#: Finds entities in texts: of each a list of (surface form, label).
Tagger = Callable[[Sequence[str], Sequence[str]], Sequence[Sequence[tuple[str, str]]]]


def batched(load: Callable[[], Call], size: int = 8, per_second: float | None = None, attempts: int = 1) -> Model:
    """A model out of a function of lists.

    ``load`` runs once a task. The function gets ``size`` texts at a time, at most ``per_second`` calls a second in each
    task. Null and blank texts are not asked and have no result. A call that fails ``attempts`` times gives none for its
    texts; the others are not lost with it.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call, next_call = load(), 0.0
        for texts in batches:
            out: list[object] = [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            for a in range(0, len(asked), size):
                part = asked[a : a + size]
                for _ in range(attempts):
                    if per_second:
                        time.sleep(max(0.0, next_call - time.monotonic()))
                        next_call = time.monotonic() + 1 / per_second
                    try:
                        for i, r in zip(part, call([texts.iloc[i] for i in part]), strict=True):
                            out[i] = r
                        break
                    except Exception:  # noqa: BLE001  a model's errors are its own
                        continue
            yield pd.Series(out, dtype=object)

    return run


def apply_model(df: DataFrame, text: str, out: str, model: Model, kind: str, tasks: int | None = None) -> DataFrame:
    """Add a model's results for a text column. With ``tasks`` at most so many ask the model at once."""
    f = F.pandas_udf(model, kind)  # type: ignore[call-overload]
    return (df if tasks is None else df.coalesce(tasks)).withColumn(out, f(F.col(text)))


def chat_prompt(system: str, prompt: Column) -> Column:
    """What a chat model gets: a JSON list of the system's and the user's message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.to_json(F.array(message("system", F.lit(system)), message("user", prompt)))


def tag(units: DataFrame, labels: Sequence[str], load: Callable[[], Tagger], size: int = 8, tasks: int | None = None) -> DataFrame:
    """``surface_form, category_label, source_unit_id, ord``: the entities that a tagger finds in the units' content.

    The tagger is loaded once a task and gets ``size`` texts and the labels at a time. Forms are trimmed and lower-case;
    blank ones, and labels that were not asked for, fall away. A failed call gives nothing for its texts.
    """
    wanted = list(dict.fromkeys(labels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load()
        for b in batches:
            b = b[b["content"].map(lambda t: isinstance(t, str) and bool(t.strip()))]
            rows = []
            for a in range(0, len(b), size):
                part = b.iloc[a : a + size]
                try:
                    found = list(tagger(part["content"].tolist(), wanted))
                except Exception:  # noqa: BLE001
                    continue
                rows += [(f, k, i, n) for i, hits in zip(part["id"], found, strict=True) for n, (f, k) in enumerate(hits, 1) if k in wanted]
            yield pd.DataFrame(rows, columns=["surface_form", "category_label", "source_unit_id", "ord"])

    rows = units.select("id", "content")
    found = (rows if tasks is None else rows.coalesce(tasks)).mapInPandas(run, "surface_form string, category_label string, source_unit_id string, ord long")
    return found.withColumn("surface_form", entity_text(F.col("surface_form"))).where(F.col("surface_form").isNotNull())
