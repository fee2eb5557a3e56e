"""Model and embedding providers.

Providers turn a table of prompts or texts into a table of answers or vectors. ``Replay`` joins recorded
answers, ``Rule`` computes them from an expression, and ``Http`` calls an OpenAI-compatible endpoint from
Arrow batches (never per row on the driver). Jobs name a provider; they do not depend on one.
"""

from __future__ import annotations

import json
import time
import urllib.request
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.vectors import hashing_vector


@dataclass(frozen=True)
class Replay:
    """Recorded answers keyed like the prompts: ``answers(key…, raw_output)``."""

    answers: DataFrame
    keys: tuple

    def complete(self, prompts: DataFrame) -> DataFrame:
        a = self.answers.select(*self.keys, "raw_output").withColumn("answered", F.lit(True))
        return prompts.join(a, list(self.keys), "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


@dataclass(frozen=True)
class Rule:
    """Answers from an expression over the prompt row."""

    expression: Callable[[], Column]

    def complete(self, prompts: DataFrame) -> DataFrame:
        return prompts.withColumn("raw_output", self.expression()).withColumn("answered", F.lit(True))


@dataclass(frozen=True)
class Http:
    """Chat completions over HTTP with retry and back-off; a failed call is ``answered = false``."""

    url: str
    model: str
    temperature: float = 0.0
    retries: int = 5
    delay: float = 1.0
    timeout: float = 120.0
    key: str = ""

    def complete(self, prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
        conf = self
        schema = prompts.withColumn("raw_output", F.lit("")).withColumn("answered", F.lit(True)).schema

        def run(batches):
            for pdf in batches:
                out = [conf._call(p) for p in pdf[prompt]]
                yield pdf.assign(raw_output=[o or "" for o in out], answered=[o is not None for o in out])

        return prompts.mapInPandas(run, schema)

    def _call(self, text):
        body = json.dumps({"model": self.model, "temperature": self.temperature, "max_tokens": answer_budget(text),
                           "messages": [{"role": "user", "content": text}]}).encode()
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        for attempt in range(self.retries):
            try:
                req = urllib.request.Request(self.url, body, head)
                with urllib.request.urlopen(req, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"]["content"]
            except Exception:  # noqa: BLE001 - network failures are retried, then reported
                time.sleep(self.delay * 2 ** attempt)
        return None


def answer_budget(text: str) -> int:
    """Answer length allowed for a prompt: a quarter of it, between 64 and 512 tokens."""
    return int(max(64, min(0.25 * len(text.split()), 512)))


def embed_table(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """Vectors from a stored table ``(text, vec)``; each distinct text is looked up once."""
    return texts.join(stored.select("text", "vec"), "text", "left")


def embed_distinct(df: DataFrame, column: str, embed=hashing_vector) -> DataFrame:
    """Add ``vec`` by embedding every distinct text once and joining it back."""
    vec = df.select(F.col(column).alias("_text")).distinct().withColumn("vec", embed(F.col("_text")))
    return df.join(vec, df[column] == vec["_text"], "left").drop("_text")


def pending(prompts: DataFrame, log: DataFrame, keys) -> DataFrame:
    """Prompts without a logged answer: resuming a run asks only for these."""
    return prompts.join(log.select(*keys).distinct(), list(keys), "left_anti")


def retry_missing(prompts: DataFrame, first: DataFrame, provider, keys) -> DataFrame:
    """Second pass over prompts whose first answer was unusable; good first answers are kept."""
    ok = first.filter("usable")
    again = provider.complete(prompts.join(ok.select(*keys), list(keys), "left_anti"))
    return ok.select(*again.columns).unionByName(again)

