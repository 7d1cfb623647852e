"""What is plugged in from outside: sources of vectors and generators of text, and stand-ins that need no network.

A plug is made in the task that uses it (``make()`` is sent there, once for each task), so that it may hold connections or models.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from athenaeum.functions.arrow import repair_json


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """A vector for each text, in their order."""


class Generator(Protocol):
    def answer(self, text: str) -> tuple[str, bool]:
        """What is said to a text, and whether the answer was cut short."""


class HashingEmbedder:
    """Words are dealt to signed components by their hash; vectors have length one."""

    dim = 64

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(self.dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = np.sqrt((v * v).sum())
            v = v / n if n else np.eye(1, self.dim)[0]
            out.append(v.tolist())
        return out


class CountingGenerator:
    """Answers with the number of words; is cut short by texts of more than ``most`` characters."""

    most = 6000

    def answer(self, text: str) -> tuple[str, bool]:
        made = json.dumps({"words": len(re.findall(r"[^ \n\t\r]+", text))})
        return f"Here it is:\n```json\n{made}\n```", len(text) > self.most


def embedded(column: Column | str, make: Callable[[], Embedder]) -> Column:
    """A vector for each text; blank texts have none and are not sent. Where a batch fails none of its texts has one."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        source = make()
        for part in parts:
            some = [i for i, t in enumerate(part) if t is not None and t.strip()]
            try:
                made = source.embed([part.iloc[i] for i in some])
            except (OSError, ValueError, RuntimeError):
                made = [None] * len(some)
            out: list = [None] * len(part)
            for i, v in zip(some, made, strict=True):
                out[i] = v
            yield pd.Series(out, dtype=object)

    return run(column)


def mapped(rows: DataFrame, key: str, column: str, make: Callable[[], Generator], least: int = 4000) -> DataFrame:
    """Every text through a generator: key, start, end, status and the answer's object.

    A text whose answer is cut short is halved and asked for again, until its parts are under twice ``least`` characters; such a
    part's status is "truncated". "unreadable" are answers without an object, "failed" calls that raised; both have no answer.
    """

    def parts(source: Generator, text: str) -> Iterator[tuple[int, int, str, str | None]]:
        todo = [(0, len(text))] if text else []
        while todo:
            a, b = todo.pop()
            try:
                said, short = source.answer(text[a:b])
            except (OSError, ValueError, RuntimeError):
                yield a, b, "failed", None
                continue
            if short and b - a >= 2 * least:
                middle = a + (b - a) // 2
                todo += [(middle, b), (a, middle)]
                continue
            made = repair_json(said)
            yield a, b, "truncated" if short else "ok" if made else "unreadable", made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = make()
        for batch in batches:
            found = [(k, *p) for k, t in zip(batch[key], batch[column], strict=True) for p in parts(source, t or "")]
            yield pd.DataFrame(found, columns=[key, "start", "end", "status", "answer"])

    fields = [rows.schema[key], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("answer", T.StringType())]
    return rows.select(key, column).mapInPandas(run, T.StructType(fields))
