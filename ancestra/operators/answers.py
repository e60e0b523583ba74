"""Structured answers of a model: JSON that fits a schema, or one more try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ancestra.plans.storage import checkpointed


class Unfit(ValueError):
    """Answers that do not fit after the repair."""


def strict_schema(schema: dict) -> dict:
    """A JSON schema in which objects take no other keys and need all of theirs, at every depth."""
    out = {}
    for key, value in schema.items():
        if isinstance(value, dict):
            out[key] = {k: strict_schema(v) if isinstance(v, dict) else v for k, v in value.items()} if key in ("properties", "$defs", "definitions") else strict_schema(value)
        elif isinstance(value, list):
            out[key] = [strict_schema(v) if isinstance(v, dict) else v for v in value]
        else:
            out[key] = value
    if out.get("type") == "object" or "properties" in out:
        out["additionalProperties"] = False
        out["required"] = list(out.get("properties", {}))
    return out


def _whole(kind: DataType, column):
    """Whether a parsed value has all its required parts."""
    if isinstance(kind, StructType):
        parts = [_whole(f.dataType, column[f.name]) for f in kind.fields]
        fit = column.isNotNull()
        for part in parts:
            fit = fit & part
        return fit
    if isinstance(kind, ArrayType):
        return column.isNotNull() & F.forall(column, lambda x: _whole(kind.elementType, x))
    if isinstance(kind, MapType):
        return column.isNotNull()
    return column.isNotNull()


def structured(prompts: DataFrame, schema: StructType, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """origin and answer (schema) of prompts (origin, prompt); ask gives (origin, text).

    Text that is no such object goes back once, with what was wrong; what fails again
    raises Unfit with the origins."""

    def parsed(told: DataFrame) -> DataFrame:
        answers = checkpointed(ask(told).withColumn("answer", F.from_json("text", schema, {"mode": "PERMISSIVE"})))
        joined = told.join(answers, "origin", "left")
        return checkpointed(joined.withColumn("fit", F.coalesce(_whole(schema, F.col("answer")), F.lit(False))))

    first = parsed(prompts.select("origin", "prompt"))
    wrong = first.where("not fit")
    done = first.where("fit").select("origin", "answer")
    if wrong.isEmpty():
        return done
    again = F.concat_ws("\n\n", "prompt", F.concat(F.lit("This answer does not fit the schema:\n"), F.coalesce("text", F.lit(""))), F.lit(f"Answer with one object of this form only: {schema.simpleString()}"))
    second = parsed(wrong.select("origin", again.alias("prompt")))
    failed = second.where("not fit").select("origin").limit(10).collect()
    if failed:
        raise Unfit(", ".join(str(r.origin) for r in failed))
    return done.union(second.select("origin", "answer"))
