"""Small driver-side inputs: configuration, word vectors, random forests."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Names of the configuration file, in the order they are tried, and its known keys.
CONFIG_NAMES = (".codeweft.json", "codeweft.json", ".codeweft.yaml", ".codeweft.yml")
CONFIG_KEYS = frozenset(("sources", "exclude", "reports", "requirements", "extensions", "compare"))
#: Bytes of trees that may be sent to the executors.
MODEL_BYTES = 64 << 20


def load_config(folder: str) -> tuple[dict, list[str]]:
    """The first configuration found, and a warning for each unknown key; ({}, []) without one."""
    for name in CONFIG_NAMES:
        path = Path(folder) / name
        if path.exists():
            text = path.read_text()
            if path.suffix == ".json":
                config = json.loads(text)
            else:
                import yaml  # optional

                config = yaml.safe_load(text) or {}
            return config, [f"unknown key: {k}" for k in sorted(set(config) - CONFIG_KEYS)]
    return {}, []


def read_vectors(path: str) -> tuple[dict[str, np.ndarray], int]:
    """Word vectors: magic W2V1, dimension and count (uint32), then (length uint16, word, floats)."""
    data = Path(path).read_bytes()
    if data[:4] != b"W2V1":
        raise ValueError("no W2V1 file")
    dim, count = struct.unpack_from("<II", data, 4)
    at, out = 12, {}
    for _ in range(count):
        (size,) = struct.unpack_from("<H", data, at)
        word = data[at + 2 : at + 2 + size].decode()
        at += 2 + size
        out[word] = np.frombuffer(data, dtype="<f4", count=dim, offset=at)
        at += 4 * dim
    return out, dim


def read_forest(path: str) -> dict:
    """A random forest as JSON, plain or gzipped: classes, and trees of feature, threshold, left, right, value."""
    raw = Path(path).read_bytes()
    return json.loads(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)


def train_forest(rows: DataFrame, words: str, numbers: list[str], label: str, bins: int = 4096, trees: int = 20, seed: int = 7):
    """A fitted pipeline: hashing TF-IDF of ``words`` and ``numbers`` into a random forest; ``transform`` adds ``guess``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer, VectorAssembler

    index = StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip").fit(rows)
    stages = [
        index, HashingTF(inputCol=words, outputCol="__tf", numFeatures=bins), IDF(inputCol="__tf", outputCol="__idf"), VectorAssembler(inputCols=["__idf", *numbers], outputCol="__features"),
        RandomForestClassifier(featuresCol="__features", labelCol="__label", predictionCol="__guess", numTrees=trees, maxDepth=8, seed=seed), IndexToString(inputCol="__guess", outputCol="guess", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(features: DataFrame, forest: dict, key: str, columns: list[str], top: int = 3, least: float = 0.01) -> DataFrame:
    """``(key, predictions)``: the ``top`` classes by mean leaf distribution with at least ``least`` probability."""
    if len(json.dumps(forest)) > MODEL_BYTES:
        raise ValueError("the forest is too large to send to the executors")
    shared = features.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names = model["classes"]
        for b in batches:
            x = b[columns].fillna(0).to_numpy(dtype=float)
            total = np.zeros((len(x), len(names)))
            for tree in model["trees"]:
                feature, threshold = np.array(tree["feature"]), np.array(tree["threshold"], dtype=float)
                left, right = np.array(tree["left"]), np.array(tree["right"])
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = left[at] >= 0
                    if not inner.any():
                        break
                    go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                leaf = np.array(tree["value"], dtype=float)[at]
                total += leaf / np.maximum(leaf.sum(axis=1, keepdims=True), 1e-12)
            total /= max(len(model["trees"]), 1)
            rows = [[{"label": names[j], "probability": float(p[j])} for j in sorted(range(len(names)), key=lambda j: (-p[j], names[j]))[:top] if p[j] >= least] for p in total]
            yield pd.DataFrame({key: b[key], "predictions": rows})

    kind = dict(features.dtypes)[key]
    return features.select(key, *columns).mapInPandas(run, f"{key} {kind}, predictions array<struct<label:string,probability:double>>")
