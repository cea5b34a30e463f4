"""Plan checks: read a DataFrame's physical plan without running it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas")


def explain_text(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as ``df.explain(mode)`` prints it, as a string."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def has_python(df: DataFrame) -> bool:
    text = explain_text(df)
    return any(node in text for node in PYTHON_NODES)


_SPEC = "windowspecdefinition("


def unpartitioned_windows(df: DataFrame) -> list[str]:
    """Window specs with an empty PARTITION BY (all rows go to one task).

    In ``windowspecdefinition(...)`` partition keys come first; when the
    first argument is already an order key or the frame, there are none.
    """
    out = []
    for line in explain_text(df).splitlines():
        if not line.startswith("Arguments:") or _SPEC not in line:
            continue
        for spec in line.split(_SPEC)[1:]:
            first = spec.split(",", 1)[0]
            if first.startswith("specifiedwindowframe") or re.search(r" (ASC|DESC) NULLS", first):
                out.append(spec[:120])
    return out


def exchanges(df: DataFrame) -> int:
    return explain_text(df).count(" Exchange (")
