"""Tools on a text as table functions, each declared once by a name, a JSON schema of its arguments and the columns it returns.

A tool is called from SQL over a lateral join, where arguments are checked as the query is analysed, or by calls
that are rows themselves, where every call gets a verdict and no bad one fails the job.  Both work on whatever
partitions hold the texts; nothing is collected.
"""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeResult

from ..functions.text import normalize_text

KINDS = {"string": StringType, "integer": IntegralType}
DEFAULT = Path(__file__).parent.parent / "tools"
RESULT = "call_id long, n int, results array<string>, message string"


@dataclass(frozen=True)
class Tool:
    """A table function of a text: ``rows(text, **arguments)`` yields tuples of the columns in ``returns``."""

    name: str
    description: str
    parameters: dict
    returns: str
    rows: Callable[..., Iterable[tuple]]

    def __post_init__(self) -> None:
        if not (isinstance(self.name, str) and re.fullmatch("[A-Za-z][A-Za-z0-9_]*", self.name)):
            raise ValueError(f"tool {self.name!r}: the name must be an identifier")
        if not (isinstance(self.description, str) and isinstance(self.parameters, dict) and isinstance(self.returns, str) and callable(self.rows)):
            raise ValueError(f"tool {self.name}: description, parameters, returns and rows are needed")
        for key, spec in self.properties.items():
            if key == "text" or not re.fullmatch("[A-Za-z][A-Za-z0-9_]*", key) or spec.get("type") not in KINDS:
                raise ValueError(f"tool {self.name}: argument {key!r} must be an identifier other than text, of type {' or '.join(KINDS)}")
        if not set(self.required) <= set(self.properties):
            raise ValueError(f"tool {self.name}: required arguments must be declared")

    @property
    def properties(self) -> dict[str, dict]:
        return self.parameters.get("properties", {})

    @property
    def required(self) -> list[str]:
        return self.parameters.get("required", [])


def _normal(text: str | None) -> str:
    """As ``normalize_text``."""
    text = (text or "").removeprefix("﻿")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _table_function(tool: Tool, schema: StructType) -> type:
    class Function:
        @staticmethod
        def analyze(text, **given):
            if not isinstance(text.dataType, (StringType, NullType)):
                raise ValueError(f"{tool.name}: text must be a string")
            for key in given:
                if key not in tool.properties:
                    raise ValueError(f"{tool.name} has no argument {key}")
            for key in tool.required:
                if key not in given or isinstance(given[key].dataType, NullType):
                    raise ValueError(f"{tool.name}: argument {key} is required")
            for key, argument in given.items():
                if not isinstance(argument.dataType, (KINDS[tool.properties[key]["type"]], NullType)):
                    raise ValueError(f"{tool.name}: argument {key} must be of type {tool.properties[key]['type']}")
            return AnalyzeResult(schema)

        def eval(self, text, **given):
            if all(given[key] not in (None, "") for key in tool.required):
                yield from tool.rows(_normal(text), **{k: v for k, v in given.items() if v is not None})

    return Function


def _type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


class Tools:
    """A registry of tools."""

    def __init__(self, tools: Iterable[Tool] = ()) -> None:
        self.tools: dict[str, Tool] = {}
        for tool in tools:
            self.add(tool)

    def add(self, tool: Tool) -> None:
        """SQL knows functions without regard to case, so names that differ in case only are the same name."""
        if not isinstance(tool, Tool):
            raise ValueError(f"not a tool: {tool!r}")
        if tool.name.lower() in {n.lower() for n in self.tools}:
            raise ValueError(f"two tools are named {tool.name}")
        self.tools[tool.name] = tool

    @classmethod
    def load(cls, folder: str | Path = DEFAULT) -> Tools:
        """The tools of a folder: TOOL of each of its Python files, in the order of their names; those that begin with _ are helpers."""
        found = cls()
        for file in sorted(Path(folder).glob("[!_]*.py")):
            spec = importlib.util.spec_from_file_location(f"tool_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            found.add(getattr(module, "TOOL", None))
        return found

    def schemas(self) -> list[dict]:
        """The declarations as a chat model takes them."""
        return [{"type": "function", "function": {"name": t.name, "description": t.description, "parameters": t.parameters}} for t in self.tools.values()]

    def register(self, spark: SparkSession) -> None:
        """Make every tool a table function of the session: ``FROM docs d, LATERAL name(text => d.text, argument => ...)``.

        A required argument that is null or empty in a row gives no rows for it.
        """
        from pyspark.sql.functions import udtf

        for tool in self.tools.values():
            spark.udtf.register(tool.name, udtf(_table_function(tool, spark.createDataFrame([], tool.returns).schema)))

    def _problem(self, tool: Tool, args: Column, parsed: Column) -> Column:
        """Null, or what is wrong: a required argument missing, then the first argument of the call that has another type."""
        value = {k: F.try_variant_get(parsed, f"$.{k}", "variant") for k in tool.properties}
        missing, wrong = F.lit(None).cast("string"), []
        for key in reversed(tool.required):
            absent = F.coalesce(_type_of(value[key]), F.lit("VOID")) == "VOID"
            empty = F.coalesce(F.try_variant_get(parsed, f"$.{key}", "string") == "", F.lit(False))
            missing = F.when(absent | empty, F.lit(f"missing {key}")).otherwise(missing)
        for key, spec in tool.properties.items():
            kind, number = _type_of(value[key]), F.try_variant_get(parsed, f"$.{key}", "double")
            whole = (kind == "BIGINT") | ((kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")) & F.coalesce(number == F.floor(number), F.lit(False)))
            wrong.append(F.when(kind.isNotNull() & ~(kind == "STRING" if spec["type"] == "string" else whole), F.lit(key)))
        first = F.get(F.filter(F.json_object_keys(args), lambda k: F.array_contains(F.array_compact(F.array(*wrong)), k)), 0) if wrong else F.lit(None)
        kinds = F.create_map(*(F.lit(x) for k, s in tool.properties.items() for x in (k, s["type"]))) if wrong else None
        return F.coalesce(missing, F.when(first.isNotNull(), F.concat(F.lit("not "), kinds[first], F.lit(" "), first))) if wrong else missing

    def verdicts(self, calls: DataFrame) -> DataFrame:
        """``calls`` (call_id, doc_id, name, arguments as JSON) with code, null or UNKNOWN_TOOL or INVALID_TOOL_ARGS, and problem.

        Arguments must be an object (JSON that repeats a key is none); what a tool does not declare is not looked at.
        """
        parsed, args = F.try_parse_json("arguments"), F.col("arguments")
        known = F.col("name").isin(*self.tools)
        object_ = F.coalesce(_type_of(parsed).startswith("OBJECT"), F.lit(False))
        per_tool = F.lit(None).cast("string")
        for tool in self.tools.values():
            per_tool = F.when(F.col("name") == tool.name, self._problem(tool, args, parsed)).otherwise(per_tool)
        problem = F.when(F.coalesce(known, F.lit(False)), F.when(object_, per_tool).otherwise("not an object"))
        code = F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN_TOOL").when(F.col("problem").isNotNull(), "INVALID_TOOL_ARGS")
        return calls.withColumn("problem", problem).withColumn("code", code)

    def run(self, calls: DataFrame, docs: DataFrame) -> DataFrame:
        """call_id, status (ok, empty, error), code, problem, n and results (rows as JSON) of every call on the text of its document.

        A call on no document sees an empty text.  A tool that fails makes its call an error, TOOL_EXECUTION_FAILED with its message.
        """
        judged = self.verdicts(calls)
        spark, tools = calls.sparkSession, dict(self.tools)
        names = {t.name: spark.createDataFrame([], t.returns).columns for t in tools.values()}
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())

        def one(name: str, arguments: str, text: str) -> tuple:
            tool = tools[name]
            given = {k: (v if tool.properties[k]["type"] == "string" else int(v)) for k, v in json.loads(arguments).items() if k in tool.properties}
            try:
                rows = [json.dumps(dict(zip(names[name], r, strict=True)), ensure_ascii=False) for r in tool.rows(text, **given)]
            except Exception as failed:  # noqa: BLE001 - a tool's failure is the result of its call
                return None, None, str(failed)
            return len(rows), rows, None

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(c, *one(n, a, t)) for c, n, a, t in zip(*(col.to_pylist() for col in batch.columns), strict=True)]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["call_id", "n", "results", "message"])

        texts = docs.select("doc_id", normalize_text(F.col("text")).alias("text"))
        good = judged.filter("code IS NULL").select(F.col("call_id").cast("long").alias("call_id"), "doc_id", "name", "arguments")
        done = good.join(texts, "doc_id", "left").select("call_id", "name", "arguments", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, RESULT)
        failed = F.col("message").isNotNull()
        done = done.select("call_id", F.when(failed, "error").when(F.col("n") > 0, "ok").otherwise("empty").alias("status"), F.when(failed, "TOOL_EXECUTION_FAILED").alias("code"), F.col("message").alias("problem"), "n", "results")
        bad = judged.filter("code IS NOT NULL").select(F.col("call_id").cast("long").alias("call_id"), F.lit("error").alias("status"), "code", "problem", F.lit(None).cast("int").alias("n"), F.lit(None).cast("array<string>").alias("results"))
        return done.unionByName(bad)
