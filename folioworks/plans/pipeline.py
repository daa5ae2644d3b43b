"""Named jobs and declarative pipelines over DataFrames."""

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T



@dataclass
class Operation:
    name: str
    job: Callable
    takes: str = "DataFrame"
    gives: str = "DataFrame"
    tags: list[str] = field(default_factory=list)


class Operations:
    """A registry of jobs; a name is given once."""

    def __init__(self):
        self.known: dict[str, Operation] = {}

    def register(self, name: str, job: Callable, **about) -> Operation:
        if name in self.known:
            raise ValueError(f"{name} is registered already")
        self.known[name] = op = Operation(name, job, **about)
        return op

    def get(self, name: str) -> Operation:
        if name not in self.known:
            raise KeyError(f"no operation {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name]

    def tagged(self, tag: str) -> list[str]:
        return sorted(n for n, op in self.known.items() if tag in op.tags)


def resolved(value, context: dict):
    """$name is a value of the context, {name} inside a text its text; lists and dicts are gone through."""
    if isinstance(value, str):
        if re.fullmatch(r"\$\w+", value):
            if value[1:] not in context:
                raise KeyError(f"{value} is not known")
            return context[value[1:]]
        return re.sub(r"\{(\w+)\}", lambda m: str(context.get(m[1], m[0])), value)
    if isinstance(value, dict):
        return {k: resolved(v, context) for k, v in value.items()}
    return [resolved(v, context) for v in value] if isinstance(value, list) else value


def run_pipeline(spec: dict, operations: Operations, context: dict | None = None, told: Callable[[dict], None] = lambda e: None) -> dict:
    """Runs steps (op, input, params, output) in order; stops at the first that fails and says which.

    Results are DataFrames, so a step only builds a plan unless it writes; the steps
    report (ok, steps, context) has a status for each.
    """
    context, steps = dict(spec.get("context", {})) | (context or {}), []
    total = len(spec["steps"])
    told({"kind": "pipeline_start", "total": total})
    for i, step in enumerate(spec["steps"]):
        told({"kind": "step_start", "index": i, "op": step["op"]})
        try:
            args = [resolved(step["input"], context)] if "input" in step else []
            out = operations.get(step["op"]).job(*args, **resolved(step.get("params", {}), context))
        except Exception as e:
            steps.append({"op": step["op"], "status": "failed", "error": f"{type(e).__name__}: {e}"})
            told({"kind": "step_failed", "index": i, "op": step["op"], "error": str(e)})
            return {"ok": False, "steps": steps, "context": context}
        if "output" in step:
            context[step["output"]] = out
        context["previous"] = out
        steps.append({"op": step["op"], "status": "done"})
        told({"kind": "step_done", "index": i, "op": step["op"]})
    told({"kind": "pipeline_done", "total": total})
    return {"ok": True, "steps": steps, "context": context}


def standard_operations(spark: SparkSession) -> Operations:
    from ..operators import corpus

    ops = Operations()
    ops.register("read", lambda path, **_: spark.read.parquet(path), takes="path", tags=["source"])
    ops.register("filter", lambda df, where: df.where(where), tags=["rows"])
    ops.register("emails", corpus.extract_emails, tags=["text"])
    ops.register("classify", corpus.classify, tags=["text"])
    ops.register("join", lambda df, other, on, how="inner": df.join(other, on, how), tags=["rows"])
    ops.register("keywords", lambda df, column="text": df.withColumn("keywords", T.keywords(T.normalize_text(F.col(column)))), tags=["text"])
    ops.register("count", lambda df, by: df.groupBy(*by).agg(F.count("*").alias("n")), tags=["rows"])
    return ops


PIPELINE = {
    "context": {"kind": "documents", "least": "src1"},
    "steps": [
        {"op": "read", "input": "{root}/{kind}.parquet", "output": "docs"},
        {"op": "filter", "input": "$docs", "params": {"where": "source >= '{least}' and lang <> 'de'"}, "output": "some"},
        {"op": "emails", "input": "$some", "output": "found"},
        {"op": "join", "input": "$found", "params": {"other": "$docs", "on": "doc_id"}},
        {"op": "count", "input": "$previous", "params": {"by": ["source", "lang"]}, "output": "result"},
    ],
}


def _run(s: SparkSession, d: str) -> DataFrame:
    report = run_pipeline(PIPELINE, standard_operations(s), {"root": d})
    if not report["ok"]:
        raise RuntimeError(report["steps"][-1]["error"])
    return report["context"]["result"]


def _emails_sql() -> str:
    from ..operators.corpus import SQL_EMAILS

    return f"SELECT source, lang, count(*) AS n FROM documents WHERE source >= 'src1' AND lang <> 'de' AND len({SQL_EMAILS}) > 0 GROUP BY ALL"


QUERIES = {"pipeline_run": _run}
SQL = {"pipeline_run": _emails_sql()}
