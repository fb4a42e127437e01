"""Metrics of users, by name and direction, and suites that run a target-free generator over control signals and score what it says.

A metric is written for one pair, with sums that add up over pairs, so that Spark sums them in every task before it shuffles; only a metric
that needs all pairs at once gathers those of a run and control in one task."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from evidara.operators import evaluation as E

KEYS = ("run_id", "control")


def _mean(sums: Sequence[float], n: int) -> float:
    return sums[0] / n if n else 0.0


@dataclass(frozen=True)
class Metric:
    """``parts(prediction, reference)`` gives ``width`` numbers of a pair; ``final(sums, pairs)`` makes the metric of their sums.

    With ``whole`` (all predictions, all references) the pairs of a run and control meet in one task instead; use it for small tables only."""

    name: str
    parts: Callable[[str, str], Sequence[float]] | None = None
    final: Callable[[Sequence[float], int], float] = _mean
    width: int = 1
    higher_is_better: bool = True
    whole: Callable[[list[str], list[str]], float] | None = None

    def __post_init__(self):
        if not self.name.strip():
            raise ValueError("a metric needs a name")
        if (self.parts is None) == (self.whole is None):
            raise ValueError(f"{self.name}: give either parts or whole")


def checked(metrics: Iterable[Metric]) -> list[Metric]:
    out = list(metrics)
    if not out:
        raise ValueError("at least one metric is required")
    if len({m.name for m in out}) < len(out):
        raise ValueError("metric names must be unique")
    return out


def directions(metrics: Iterable[Metric]) -> dict[str, bool]:
    """{name: whether more is better}, for ``grounding``, ``compare`` and ``occlusion_drop``."""
    return {m.name: m.higher_is_better for m in metrics}


def scores(predictions: DataFrame, metrics: Iterable[Metric]) -> DataFrame:
    """(run_id, control, metric, value, examples) of (run_id, control, prediction_text, reference_text); pairs that lack a text do not count."""
    metrics = checked(metrics)
    p = predictions.select(*KEYS, "prediction_text", "reference_text").where("prediction_text is not null and reference_text is not null")
    summed = [m for m in metrics if m.parts]
    out = None
    if summed:
        widths = np.cumsum([0, *(m.width for m in summed)]).tolist()

        @F.pandas_udf(ArrayType(DoubleType()))
        def parts(hyp: pd.Series, ref: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for m in summed for x in m.parts(h, r)] for h, r in zip(hyp, ref, strict=True)])

        def finish(frames):
            for f in frames:
                rows = [(*k, m.name, float(m.final(list(s[a:b]), int(n))), int(n)) for *k, n, s in f.itertuples(index=False) for m, a, b in zip(summed, widths[:-1], widths[1:], strict=True)]
                yield pd.DataFrame(rows, columns=[*KEYS, "metric", "value", "examples"])

        s = p.select(*KEYS, parts("prediction_text", "reference_text").alias("s")).groupBy(*KEYS)
        s = s.agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(widths[-1])]).alias("s"))
        out = s.mapInPandas(finish, "run_id string, control string, metric string, value double, examples long")
    for m in metrics:
        if m.whole:
            f = F.pandas_udf(lambda h, r, m=m: float(m.whole(h.tolist(), r.tolist())), DoubleType(), F.PandasUDFType.GROUPED_AGG)
            one = p.groupBy(*KEYS).agg(f("prediction_text", "reference_text").alias("value"))
            one = one.join(p.groupBy(*KEYS).agg(F.count("*").alias("examples")), list(KEYS)).select(*KEYS, F.lit(m.name).alias("metric"), "value", "examples")
            out = one if out is None else out.unionByName(one)
    return out


def forbidden_parameters(function: Callable) -> list[str]:
    """Parameters whose names say that a generator may see the answer."""
    return [p for p in inspect.signature(function).parameters if any(x in p.lower() for x in E.FORBIDDEN_PARTS)]


@dataclass
class Faithfulness:
    """What a suite gives: predictions of every control, scores, grounding, pairing findings, and the generator's forbidden parameters."""

    predictions: DataFrame
    scores: DataFrame
    grounding: DataFrame
    findings: DataFrame
    forbidden: list[str]


def faithfulness(signals: dict[str, DataFrame], generate: Callable, references: DataFrame, metrics: Iterable[Metric], run_id: str = "run") -> Faithfulness:
    """Run ``generate`` (for mapInPandas: batches of a signal table to (sample_id, prediction_text)) over the full signal and its controls, and score it by ``metrics``.

    ``signals`` maps control names to tables with a sample_id; 'full' and 'shuffled' have to be there, and no table may have a column whose name gives the answer
    away. ``references`` are (sample_id, reference_text). Samples that a control lacks, adds or repeats are findings and do not count."""
    metrics = checked(metrics)
    for need in ("full", "shuffled"):
        if need not in signals:
            raise ValueError(f"a faithfulness suite must include the {need} signal")
    for control, s in signals.items():
        if bad := [c for c in s.columns if any(x in c.lower() for x in E.FORBIDDEN_PARTS)]:
            raise ValueError(f"{control}: columns that give the answer away: {bad}")
    p = None
    for control, s in signals.items():
        kind = s.schema["sample_id"].dataType.simpleString()
        one = s.mapInPandas(generate, f"sample_id {kind}, prediction_text string").select(F.lit(run_id).alias("run_id"), F.lit(control).alias("control"), "sample_id", "prediction_text")
        p = one if p is None else p.unionByName(one)
    p = p.join(references.select("sample_id", "reference_text"), "sample_id", "left").select(*KEYS, "sample_id", "prediction_text", "reference_text")
    found = E.pairing_findings(p)
    lacking = references.select("sample_id").distinct().join(p.where("control = 'full'"), "sample_id", "left_anti").select(F.lit(run_id).alias("run_id"), F.lit("full").alias("control"), F.lit("missing").alias("code"), "sample_id")
    found = found.unionByName(lacking)
    s = scores(p.join(found.select("sample_id").distinct(), "sample_id", "left_anti"), metrics)
    return Faithfulness(p, s, E.grounding(s, directions(metrics)), found, forbidden_parameters(generate))
