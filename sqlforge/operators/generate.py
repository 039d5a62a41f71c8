"""User model surfaces E9 and R3: generation and embedding through Arrow batches.

The model is user code: a zero-argument loader returning a callable. It is
loaded once per Python worker process (cached under the model's name) and called
on fixed-size batches, as the reference's batch size of 16 prescribes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import final_sql

_CACHE: dict = {}


def model_name(loader: Callable, name: str | None) -> str:
    """The cache key of a model: the given name, else the loader's import path."""
    if name:
        return name
    own = getattr(loader, "__qualname__", "<")
    if "<" in own:
        raise ValueError("give a name for a model whose loader is not a module-level function")
    return f"{loader.__module__}.{own}"


def _loaded(loader: Callable, name: str):
    if name not in _CACHE:
        _CACHE[name] = loader()
    return _CACHE[name]


def batch_generate(df: DataFrame, load_generator: Callable, prompt_col: str = "prompt",
                   batch_size: int = 16, id_col: str = "sample_id", name: str | None = None) -> DataFrame:
    """Output text for every prompt, then the final SQL parsed from it (summary first).

    ``load_generator()`` returns ``fn(list[str]) -> list[str]``.
    """
    name = model_name(load_generator, name)

    def gen(it):
        fn = _loaded(load_generator, name)
        for pdf in it:
            prompts = pdf[prompt_col].fillna("").tolist()
            outs = []
            for i in range(0, len(prompts), batch_size):
                outs.extend(fn(prompts[i:i + batch_size]))
            yield pd.DataFrame({id_col: pdf[id_col].values, "output": outs})

    schema = f"{id_col} {dict(df.dtypes)[id_col]}, output string"
    out = df.select(id_col, prompt_col).mapInPandas(gen, schema)
    return out.withColumn("pred_sql", final_sql(F.col("output")))


def embed(df: DataFrame, load_encoder: Callable, text_col: str = "question", out_col: str = "embedding",
          batch_size: int = 64, name: str | None = None) -> DataFrame:
    """Dense vectors from a user encoder (``load_encoder()`` -> ``fn(list[str]) -> 2-d array``)."""
    name = model_name(load_encoder, name)
    cols = [c for c in df.columns if c != out_col]

    def enc(batches):
        import pyarrow as pa
        fn = _loaded(load_encoder, name)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(text_col).to_pylist()]
            parts = [np.asarray(fn(texts[i:i + batch_size]), dtype=np.float32) for i in range(0, len(texts), batch_size)]
            mat = np.concatenate(parts) if parts else np.zeros((0, 1), dtype=np.float32)
            # One flat buffer of the batch: the vectors are never Python lists.
            vecs = pa.FixedSizeListArray.from_arrays(pa.array(mat.reshape(-1)), mat.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), vecs], names=[*cols, out_col])

    kind = df.select(*cols).withColumn(out_col, F.array().cast("array<float>")).schema
    return df.select(*cols).mapInArrow(enc, kind)


# ---------------------------------------------------------------- stubs for tests and checks
def length_generator():
    """Stub generator: answers every prompt with a summary 'SELECT <prompt length>'."""
    return lambda prompts: [f"<summary>\nSELECT {len(p)}\n</summary>" for p in prompts]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_encoder():
    """Stub encoder: counts of the 26 ASCII letters in the lower-cased text."""
    return lambda texts: [[float(t.lower().count(ch)) for ch in LETTERS] for t in texts]
