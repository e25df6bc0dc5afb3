"""Text stages by name: columns to columns, chained as asked; and the Python ones as functions of SQL."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from millrace.functions import boilerplate, markdown, rules, text

Stage = Callable[[Column], Column]

STAGES: dict[str, Stage] = {
    "references": text.without_references,
    "markdown": markdown.html_to_markdown,
    "plain": text.plain,
    "structure": text.structured,
    "boilerplate": boilerplate.without_boilerplate,
    "decode": boilerplate.decoded,
    "space": boilerplate.single_spaced,
    "polish": text.polished,
    "emphasis": text.without_emphasis,
    "fold": text.folded,
    "bullets": text.bullets_plain,
    "tidy": text.tidy,
    "remarks": rules.without_remarks,
}


def register(name: str, stage: Stage) -> None:
    """Adds a stage; a name stands for one stage only."""
    if name in STAGES:
        raise ValueError(f"stage {name} is there already")
    STAGES[name] = stage


def applied(df: DataFrame, column: str, stages: Iterable[str], into: str | None = None) -> DataFrame:
    """``df`` with a column taken through stages, in order; an unknown stage is an error."""
    out = F.col(column)
    for name in stages:
        if name not in STAGES:
            raise ValueError(f"unknown stage: {name}")
        out = STAGES[name](out)
    return df.withColumn(into or column, out)


def register_sql(spark: SparkSession) -> list[str]:
    """Registers html_to_markdown and text_likeness for SQL; gives their names."""
    from millrace.operators import similarity


    @arrow_udf("string")
    def to_markdown(html: pa.Array) -> pa.Array:
        return pa.array([None if x is None else markdown.to_markdown(x) for x in html.to_pylist()], pa.string())

    @arrow_udf("double")
    def likeness(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else similarity.likeness(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    spark.udf.register("html_to_markdown", to_markdown)
    spark.udf.register("text_likeness", likeness)
    return ["html_to_markdown", "text_likeness"]


def watched(df: DataFrame, callback: Callable[[dict], None], **metrics: Column) -> DataFrame:
    """``df``, of which a callback gets the metrics (aggregates by name) once it has run for the first time; the rows aren't read again."""
    seen = Observation()
    out = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    threading.Thread(target=lambda: callback(seen.get), daemon=True).start()
    return out


def execute(spark: SparkSession, sql: str, **values) -> DataFrame:
    """A parameterised statement: values are bound as :name, never put into the text."""
    return spark.sql(sql, args=values)
