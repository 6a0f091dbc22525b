"""Embedder registry (E9, U1): DataFrame -> (key, vec ARRAY<FLOAT>) functions.

* `tfidf`   — TF-IDF + truncated SVD fitted on a corpus (LsaEmbedder);
* `table`   — precomputed vectors looked up by key (an equi-join);
* `callable`— a user batch function texts -> (N, d) float32, run on Arrow
              batches in `mapInPandas` (the hook for external encoders).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dualspace.functions import vectors as V


def table_embedder(vectors: DataFrame, key: str = "key", vec: str = "vec"):
    v = vectors.select(F.col(key).alias("_k"), F.col(vec).alias("vec"))

    def embed(docs: DataFrame, key_col: str = "doc_id", text: str = "text") -> DataFrame:
        return docs.join(v, docs[key_col] == v["_k"]).select(key_col, "vec")
    return embed


def callable_embedder(fn: Callable, dim: int):
    """fn(list[str], task) -> array (N, dim); rows are L2-normalised after the call."""

    def embed(docs: DataFrame, key: str = "doc_id", text: str = "text", task: str = "RETRIEVAL_DOCUMENT"):
        key_type = dict(docs.dtypes)[key]

        def run(batches):
            import numpy as np
            import pandas as pd
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                out = np.asarray(fn(pdf[text].tolist(), task), dtype=np.float64).reshape(len(pdf), dim)
                nrm = np.linalg.norm(out, axis=1, keepdims=True)
                out = np.divide(out, nrm, out=np.zeros_like(out), where=nrm != 0).astype(np.float32)
                yield pd.DataFrame({key: pdf[key].to_numpy(), "vec": list(out)})
        return docs.select(key, text).mapInPandas(run, f"{key} {key_type}, vec array<float>")
    return embed


def tfidf_embedder(fit_corpus: DataFrame, target_dim: int = 256, key: str = "doc_id", text: str = "text"):
    from dualspace.operators.tfidf import LsaEmbedder
    return LsaEmbedder(fit_corpus, target_dim, key, text).embed


REGISTRY = {"tfidf": tfidf_embedder, "table": table_embedder, "callable": callable_embedder}


def build_embedder(name: str, *args, **kwargs):
    if name not in REGISTRY:
        raise ValueError(f"no embedder is called {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](*args, **kwargs)


def normalized(df: DataFrame, vec: str = "vec") -> DataFrame:
    """E1 on any embedder output."""
    return df.withColumn(vec, V.l2_normalize(V.as_double_vector(vec)))
