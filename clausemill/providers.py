"""The boundary to models: requests in, raw texts or errors out.

A provider maps request_id, op, prompt, n to request_id, raw, error.  Its
output is written to a table before anything reads it, since recomputed
lineage would call the model again.  What a failed call leaves is an error in
its row, never the end of the run.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import classify as C

ANSWER = "request_id string, raw string, error string"


def request(op: str, prompt: Column, n: int = 1) -> list[Column]:
    """Columns of a request; equal prompts to one operation share an id."""
    return [F.sha1(F.concat(F.lit(op + "\x1f"), prompt).cast("binary")).alias("request_id"), F.lit(op).alias("op"), prompt.alias("prompt"), F.lit(n).alias("n")]


@dataclass
class Replay:
    """Answers from a table of recorded ones."""

    recorded: DataFrame

    def complete(self, requests: DataFrame) -> DataFrame:
        found = requests.select("request_id").distinct().join(self.recorded.select("request_id", F.col("raw")), "request_id", "left")
        return found.select("request_id", "raw", F.when(F.col("raw").isNull(), F.lit("not recorded")).alias("error"))


class Rules:
    """Deterministic answers by the engine's own checks and templates; the prompt is the clause itself."""

    def complete(self, requests: DataFrame) -> DataFrame:
        text = F.col("prompt")
        rule = F.struct(
            F.array(F.struct(
                F.lit(None).cast("string").alias("rule_id"), F.struct(F.array().cast("array<string>").alias("actor")).alias("scope"),
                F.lit("Unspecified hazard").alias("hazard"), F.array(text).alias("requirements"), C.clause_severity(text).alias("severity"),
            )).alias("rules")
        )
        tag = F.struct(C.testable(text).alias("testable"), F.lit("by rule").alias("reason"), C.evidence_signals(text).alias("evidence_signals"))
        number = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: i.cast("string"))
        examples = F.struct(
            F.transform(number, lambda i: F.concat(F.lit("Case "), i, F.lit(": please help within this rule. "), text)).alias("benign"),
            F.transform(number, lambda i: F.concat(F.lit("Case "), i, F.lit(": act against this rule. "), text)).alias("adversarial"),
        )
        raw = F.when(F.col("op") == "extract", F.to_json(rule)).when(F.col("op") == "testability", F.to_json(tag)).when(F.col("op") == "examples", F.to_json(examples))
        return requests.dropDuplicates(["request_id"]).select("request_id", raw.alias("raw"), F.when(raw.isNull(), F.lit("unknown operation")).alias("error"))


@dataclass
class Http:
    """Calls to a service, one client per task, a bounded number of attempts each; nothing is sent unless one is made and given.

    `call(op, prompt, n)` runs on the executors and returns the raw text.
    """

    call: Callable[[str, str, int], str]
    attempts: int = 4
    pause: float = 0.6

    def complete(self, requests: DataFrame) -> DataFrame:
        call, attempts, pause = self.call, self.attempts, self.pause

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for r in frame.itertuples():
                    raw = error = None
                    for attempt in range(attempts):
                        try:
                            raw, error = call(r.op, r.prompt, int(r.n)), None
                            break
                        except Exception as failure:
                            error = repr(failure)[:300]
                            time.sleep(min(8.0, pause * 2**attempt))
                    rows.append((r.request_id, raw, error))
                yield pd.DataFrame(rows, columns=["request_id", "raw", "error"])

        return requests.dropDuplicates(["request_id"]).select("request_id", "op", "prompt", "n").mapInPandas(ask, ANSWER)


@dataclass(frozen=True)
class Service:
    """A model service: where its key is, how to reach it, which models to take first.

    `connect(key)` gives a client with `models()` and `ask(model, text)`.
    """

    key_variable: str
    connect: Callable[[str], object]
    families: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()


class Registry:
    """Services by name; a name or key that is missing is an error, a model that does not answer is passed over."""

    def __init__(self, **services: Service) -> None:
        self.services = services

    def client(self, name: str, keys: Mapping[str, str] = os.environ) -> object:
        service = self.services.get(name.lower())
        if service is None:
            raise ValueError(f"Unknown provider '{name}'; there are {sorted(self.services)}")
        key = keys.get(service.key_variable, "")
        if not key:
            raise RuntimeError(f"{service.key_variable} is not set, which provider '{name}' needs")
        return service.connect(key)

    def model(self, name: str, client: object, wanted: str | None = None) -> str:
        """The wanted model if it answers; else the first that does of those listed (of the service's families if any is) and preferred; else the last preferred."""
        service = self.services[name.lower()]
        try:
            listed = list(client.models())
        except Exception:
            listed = []
        kin = [m for m in listed if any(f in m.lower() for f in service.families)]
        tried = dict.fromkeys([*([wanted] if wanted else []), *(kin or listed), *service.preferred])
        for model in tried:
            try:
                client.ask(model, "[1]")
                return model
            except Exception:
                continue
        if service.preferred:
            return service.preferred[-1]
        raise RuntimeError(f"no model of provider '{name}' answers")


def judge_verdict(raw: Column) -> Column:
    """struct(pass, reason) of a judge's answer; what can't be read passes, with the reason said."""
    found = F.from_json(raw, "pass string, reason string")
    said = F.lower(F.trim(found["pass"]))
    known = said.isin("true", "false", "pass", "fail")
    return F.struct(F.when(known, said.isin("true", "pass")).otherwise(True).alias("pass"), F.when(known, found["reason"]).otherwise("judge unavailable").alias("reason"))


def recorded(answers: list[tuple[str, str, dict | str]]) -> list[tuple[str, str]]:
    """Rows (request_id, raw) of a replay table from operation, prompt and answer."""
    import hashlib

    return [(hashlib.sha1(f"{op}\x1f{prompt}".encode()).hexdigest(), a if isinstance(a, str) else json.dumps(a)) for op, prompt, a in answers]
