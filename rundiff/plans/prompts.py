"""Prompt tables: a template filled per chunk. Nothing here calls a model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISON = """Compare two profiler runs. Noise lines are already removed or summarised.
{part}
File A: {file_a}
File B: {file_b}

Conflicts:
{text}

For each conflict state what changed, the likely cause, the impact, how to check it and how to fix it."""

STRUCTURED = """Line-by-line conflicts between {file_a} and {file_b}:

{text}

List each conflict as: row id, CSV line, method, change type, note, old time, new time, severity."""

CUSTOM = """Files: {file_a} and {file_b}

Conflict data:
{text}

Question: {question}"""

CODE = """Review this part of a Java class ({part}).
Kind: {type}
Description: {description}

{text}

Report performance problems, logic errors and risky dependencies."""

TEMPLATES = {"comparison": COMPARISON, "structured": STRUCTURED, "custom": CUSTOM, "code": CODE}


def _fill(template: str, values: dict[str, Column]) -> Column:
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        if name not in values:
            raise ValueError(f"no value for {name}")
        pieces += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


def prompt_table(chunks: DataFrame, template: str, keys: Sequence[str] = (), **values: str) -> DataFrame:
    """One filled template per chunk: ``keys, chunk_id, prompt``.

    ``template`` is a name of ``TEMPLATES`` or a text of its own. Columns of ``chunks``
    and keyword values fill it; ``part`` reads ``Part i of n`` from ``chunk_no``.
    """
    body = TEMPLATES.get(template, template)
    totals = chunks.groupBy(*keys).agg(F.count("*").alias("_parts"))
    counted = chunks.join(totals, list(keys)) if keys else chunks.withColumn("_parts", totals.scalar())
    part = F.concat(F.lit("Part "), F.col("chunk_no") + 1, F.lit(" of "), F.col("_parts"))
    filled = {**{c: F.col(c) for c in chunks.columns}, "part": part, **{k: F.lit(v) for k, v in values.items()}}
    return counted.select(*keys, (F.col("chunk_no") + 1).alias("chunk_id"), _fill(body, filled).alias("prompt"))
