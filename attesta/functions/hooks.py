"""Caller-supplied services as Arrow-batched hooks: embedding and extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attesta.rules import EMBED_BATCH


def embed(
    df: DataFrame,
    make_client: Callable[[], Callable[[list[str]], list]],
    text: str = "chunk_text",
    vector: str = "vector",
    batch_size: int = EMBED_BATCH,
    partitions: int | None = None,
) -> DataFrame:
    """Add a vector per text. ``make_client`` runs once per task and returns texts -> vectors.

    Order is kept; a client that returns another number of vectors fails the task.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            vectors: list = []
            for start in range(0, len(frame), batch_size):
                texts = frame[text].iloc[start : start + batch_size].tolist()
                got = client(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                vectors.extend(np.asarray(v, dtype=np.float64) for v in got)
            yield frame.assign(**{vector: vectors})

    spread = df.repartition(partitions) if partitions else df
    return spread.mapInPandas(run, schema)


def extract_hook(
    df: DataFrame, make_parser: Callable[[], Callable[[bytes, str], str]], content: str = "content", mime: str = "mime"
) -> DataFrame:
    """Bytes to text with the caller's parser; a failure becomes a row with ``extract_error``."""
    fields = [f for f in df.schema.fields if f.name != content]
    schema = T.StructType(
        fields + [T.StructField("extracted_text", T.StringType()), T.StructField("extract_error", T.StringType())]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = make_parser()
        for frame in frames:
            texts, errors = [], []
            for payload, kind in zip(frame[content], frame[mime]):
                try:
                    text = parser(bytes(payload), kind)
                    empty = not text or not text.strip()
                    texts.append(None if empty else text)
                    errors.append("EMPTY_TEXT" if empty else None)
                except Exception as failure:  # the row carries the failure
                    texts.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield frame.drop(columns=[content]).assign(extracted_text=texts, extract_error=errors)

    return df.mapInPandas(run, schema)
