"""Model calls made once: their rows are written before anything reads the replies.

A step hands the rows that it asks a model about to answered(). The rows with their answers
are written under a key of run, place, step and settings, and read back; what is there
whole already is read without a call. So a prompt is asked once however many tables, counts
or actions read what follows from it, and a run that stopped goes on where it was.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a model's answer may carry beside its value.
USAGE = {"call_id": "string", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long", "error": "string"}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder in a local session alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="runs-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def whole(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, written to its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def said(value: Any) -> Any:
    """Settings as JSON can hold them: tables by their columns, functions by name and code."""
    if isinstance(value, dict):
        return {str(k): said(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [said(v) for v in value]
    if isinstance(value, DataFrame):
        return {"table": value.schema.simpleString()}
    if callable(value):
        code = getattr(value, "__code__", None)
        return {"function": getattr(value, "__qualname__", type(value).__name__), "code": hashlib.sha256(code.co_code + repr([c for c in code.co_consts if isinstance(c, (str, int, float, bytes, tuple, type(None)))]).encode()).hexdigest() if code else ""}
    return value if isinstance(value, (str, int, float, bool, type(None))) else repr(value)


def settings_key(*parts: Any) -> str:
    return hashlib.sha256(json.dumps(said(parts), sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Barrier:
    """The call tables of a run. run names it: the same name with the same config finds what
    was asked before, so it must name the input too. parts deals a step's rows, by hash, to
    tables written one after the other: a stop loses the part at work alone.
    """

    run: str = field(default_factory=lambda: uuid.uuid4().hex)
    folder: str | None = None
    parts: int = 1
    key: str = ""
    written: list[dict] = field(default_factory=list)

    def enter(self, place: str, step: str, settings: dict) -> None:
        """The key of a step: its own settings, and those of all before it."""
        self.key, self.at, self.calls = settings_key(self.key, place, step, settings), f"{place}-{step}", 0

    def path(self) -> str:
        return f"{self.folder}/runs/{hashlib.sha256(self.run.encode()).hexdigest()[:16]}/{self.at}-{self.key}-{self.calls}"

    def table(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """work(rows) as it was when this run first came here. rows, not what work makes of them, are dealt to parts."""
        spark, schema = rows.sparkSession, work(rows).schema
        self.folder = self.folder or shared_folder(spark)
        path = self.path()
        self.calls += 1
        deal = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(self.parts))
        for part in range(self.parts):
            if not whole(spark, f"{path}/part={part}"):
                work(rows if self.parts == 1 else rows.where(deal == part)).write.mode("overwrite").parquet(f"{path}/part={part}")
        self.written.append({"step": self.at, "path": path, "schema": schema})
        return spark.read.schema(schema).parquet(*[f"{path}/part={part}" for part in range(self.parts)])


def answered(state, rows: DataFrame, model: Callable[..., Column], value: str, **inputs: Column) -> DataFrame:
    """rows with answer, asked once, and call_id, prompt_tokens, completion_tokens, total_tokens, error.

    model makes a column of the inputs: the answer itself, or a struct of the answer (as `value`)
    and any of USAGE. An answer without a call id gets one; a null input isn't a call.
    """
    rows = rows.withColumns({f"in_{k}": c for k, c in inputs.items()})

    def ask(rows: DataFrame) -> DataFrame:
        out = rows.withColumn("asked", model(*[F.col(f"in_{k}") for k in inputs]))
        kind = out.schema["asked"].dataType
        named = kind.fieldNames() if isinstance(kind, StructType) and value in kind.fieldNames() else []
        usage = {c: (F.col("asked")[c] if c in named else F.lit(None)).cast(t) for c, t in USAGE.items()}
        made = F.col(f"in_{next(iter(inputs))}").isNotNull()
        usage["call_id"] = F.when(made, F.coalesce(usage["call_id"], F.expr("replace(uuid(), '-', '')")))
        return out.withColumns({"answer": F.col("asked")[value] if named else F.col("asked"), **usage}).drop("asked")

    held = state.barrier.table(rows, ask)
    tokens = held.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)), F.count("call_id")).first()
    state.barrier.written[-1] |= {"tokens": int(tokens[0]), "calls": int(tokens[1])}
    state.tell("artifact", {"label": "model calls", "step": state.barrier.at, "path": state.barrier.written[-1]["path"], "calls": int(tokens[1]), "tokens": int(tokens[0])})
    return held.drop(*[f"in_{k}" for k in inputs])


def calls(state) -> DataFrame:
    """(step, call_id, prompt, reply, prompt_tokens, completion_tokens, total_tokens, error) of a run's calls."""
    out = None
    for x in state.barrier.written:
        if "calls" not in x:
            continue
        inputs = [c for c in x["schema"].fieldNames() if c.startswith("in_")]
        one = state.spark.read.schema(x["schema"]).option("recursiveFileLookup", "true").parquet(x["path"]).where("call_id is not null")
        answer = F.col("answer") if x["schema"]["answer"].dataType.simpleString() == "string" else F.to_json(F.struct("answer"))
        one = one.select(F.lit(x["step"]).alias("step"), "call_id", F.concat_ws("\n\n", *inputs).alias("prompt"), answer.alias("reply"), *[c for c in USAGE if c != "call_id"])
        out = one if out is None else out.unionByName(one)
    kinds = "step string, call_id string, prompt string, reply string, " + ", ".join(f"{c} {t}" for c, t in USAGE.items() if c != "call_id")
    return out if out is not None else state.spark.createDataFrame([], kinds)
