"""Models as pluggable functions, with deterministic defaults that need no network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a model function takes and gives: texts to vectors, (query, texts) to scores, a prompt to a reply.
Embedder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[str, list[str]], list[float]]
Generator = Callable[[str, str], str]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed hashes of the words, at unit length; a text without words is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                row[h % dimensions] += 1 if h >> 31 else -1
            # in double precision: squares of a long text's counts add up to more than a float holds exactly
            length = np.float32(np.sqrt(np.square(row, dtype=np.float64).sum()))
            if length:
                row /= length
        return out

    return embed


def overlap_scorer(query: str, texts: list[str]) -> list[float]:
    """The share of the query's words that a text has."""
    wanted = set(query.lower().split())
    return [len(wanted & set(t.lower().split())) / len(wanted) if wanted else 0.0 for t in texts]


def echo_generator(prompt: str, system: str = "") -> str:
    """The first 200 characters of the prompt."""
    return prompt[:200]


def retried(function: Callable, tries: int = 3, wait: float = 3.0) -> Callable:
    """The function, called again after n * wait seconds when it fails."""

    def call(*args):
        for n in range(1, tries + 1):
            try:
                return function(*args)
            except Exception:
                if n == tries:
                    raise
                time.sleep(n * wait)
        return None

    return call


def embed(df: DataFrame, make: Callable[[], Embedder] = hashing_embedder, text: str = "text", batch: int = 64, prefix: str = "") -> DataFrame:
    """``df`` with an embedding; ``make`` builds the model once for each task."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = retried(make())
        for s in series:
            texts = [prefix + (x or "") for x in s]
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors])

    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def relevance(df: DataFrame, score: Scorer = overlap_scorer, query: str = "query", text: str = "text", batch: int = 8, most_chars: int | None = None) -> Column:
    """A column of scores of each row's whole text for its query; ``most_chars`` is for a scorer that has a length limit."""

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in series:
            out = pd.Series(0.0, index=queries.index)
            for q, own in texts.groupby(queries, sort=False):
                rows = [(x or "")[:most_chars] for x in own]
                out[own.index] = [s for i in range(0, len(rows), batch) for s in score(q, rows[i : i + batch])]
            yield out

    return F.pandas_udf(run, "double")(F.col(query), F.col(text))


RESULT = "content string, success boolean, error string, prompt_chars int, eval_count int"


def generate(df: DataFrame, make: Callable[[], Generator] = lambda: echo_generator, prompt: str = "prompt", system: str | None = None) -> DataFrame:
    """``df`` with result, a struct; a failing call gives an unsuccessful row and never stops the others."""

    def run(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = make()
        for prompts, systems in series:
            rows = []
            for p, s in zip(prompts, systems, strict=True):
                try:
                    reply = model(p or "", s or "")
                    rows.append((reply, True, "", len(p or ""), len(reply.split())))
                except Exception as e:  # what a model raises is part of the result
                    rows.append(("", False, f"{type(e).__name__}: {e}", len(p or ""), 0))
            yield pd.DataFrame(rows, columns=["content", "success", "error", "prompt_chars", "eval_count"])

    return df.withColumn("result", F.pandas_udf(run, RESULT)(F.col(prompt), F.lit(system or "") if system is None or system not in df.columns else F.col(system)))
