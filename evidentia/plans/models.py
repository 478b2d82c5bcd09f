"""Calls of models given as functions: columns in, columns out, in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as T


def _checked(temperature: float, max_tokens: int | None, context: int | None) -> None:
    if temperature < 0:
        raise ValueError("temperature is under 0")
    for name, n in (("max_tokens", max_tokens), ("context", context)):
        if n is not None and n <= 0:
            raise ValueError(f"{name} isn't over 0")


def replies(call: Callable[..., str], model: str, temperature: float = 0.0, max_tokens: int | None = None, stop: list[str] | None = None, context: int | None = None) -> Callable[[Column], Column]:
    """A function from prompts to replies without space around them, for a step's settings.

    call takes prompt, model, temperature, max_tokens, stop and context by name. Raises on a
    temperature under 0, on max_tokens or context that isn't over 0. A call that fails gives
    null, on which each step falls back as it says. counted_replies() has the usage too.
    """
    _checked(temperature, max_tokens, context)
    given = {k: v for k, v in (("max_tokens", max_tokens), ("stop", stop), ("context", context)) if v is not None}

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str | None) -> str | None:
            try:
                return None if prompt is None else call(prompt=prompt, model=model, temperature=temperature, **given).strip()
            except Exception:  # noqa: BLE001  a failed call is a null reply
                return None

        for prompts in batches:
            yield prompts.map(one)

    return ask.asNondeterministic()


ANSWER = "text string, call_id string, prompt_tokens long, completion_tokens long, total_tokens long, error string"


def counted_replies(call: Callable[..., tuple[str, dict[str, int]]], model: str, temperature: float = 0.0, max_tokens: int | None = None, stop: list[str] | None = None, context: int | None = None) -> Callable[[Column], Column]:
    """As replies(), of a call that gives (reply, usage) with counts prompt, completion and total:
    structs of text, call_id (new for each call), the counts and, of a call that fails, the error.
    """
    _checked(temperature, max_tokens, context)
    given = {k: v for k, v in (("max_tokens", max_tokens), ("stop", stop), ("context", context)) if v is not None}
    names = [f.split()[0] for f in ANSWER.split(", ")]

    @F.pandas_udf(ANSWER)
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(prompt: str | None) -> tuple:
            if prompt is None:
                return (None,) * len(names)
            call_id = uuid.uuid4().hex
            try:
                text, usage = call(prompt=prompt, model=model, temperature=temperature, **given)
                return text.strip(), call_id, usage.get("prompt"), usage.get("completion"), usage.get("total"), None
            except Exception as e:  # noqa: BLE001  a failed call is a null reply
                return None, call_id, None, None, None, f"{type(e).__name__}: {e}"

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=names).astype({n: "Int64" for n in names if n.endswith("tokens")})

    return ask.asNondeterministic()


def embeddings(encode: Callable[[list[str]], list[list[float]]], batch: int = 16) -> Callable[[Column], Column]:
    """A function from texts to unit vectors, `batch` texts at a time; a null text has none."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = {}
            some = texts.dropna()
            for i in range(0, len(some), batch):
                for at, v in zip(some.index[i : i + batch], encode(some.iloc[i : i + batch].tolist()), strict=True):
                    size = sum(x * x for x in v) ** 0.5
                    found[at] = [x / size for x in v] if size else list(v)
            yield pd.Series([found.get(i) for i in texts.index], index=texts.index)

    return embed


def nli_places(labels: dict[int, str]) -> tuple[int, int, int]:
    """Places of (entailment, neutral, contradiction) among a model's labels; 0, 1, 2 where one isn't named."""
    found = {}
    for i, name in labels.items():
        for word in ("entail", "neutral", "contrad"):
            if word in str(name).strip().lower():
                found[word] = int(i)
                break
    return (found["entail"], found["neutral"], found["contrad"]) if len(found) == 3 else (0, 1, 2)


def stance_scorer(probabilities: Column, labels: dict[int, str]) -> Column:
    """Shares of support, neutrality and refutation of a model's probabilities by its labels."""
    return F.array(*[F.get(probabilities, i) for i in nli_places(labels)])


def rewritten(question: Column, reply: Callable[[Column], Column], template: str = "{question}") -> Column:
    """A question as a statement; by rule where the reply is empty."""
    return T.statement_of_answer(reply(T.filled(template, question=question)), question)


def summarised(claim: Column, abstract: Column, reply: Callable[[Column], Column], template: str = "{claim}\n{abstract}", limit: int = 4000) -> Column:
    """A short text about a claim's evidence; empty where there is no abstract or no reply."""
    body = T.clean_text(abstract, limit)
    return F.when(body == "", "").otherwise(F.coalesce(reply(T.filled(template, claim=T.clean_text(claim), abstract=body)), F.lit("")))
