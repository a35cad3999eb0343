"""Speech features as vectorised functions over arrays of samples, and the interface for embedding models (V1-V8)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def preemphasis(x: np.ndarray, coeff: float = 0.97) -> np.ndarray:
    """V1: x[t] - coeff * x[t - 1]."""
    return np.append(x[:1], x[1:] - coeff * x[:-1])


def frames(x: np.ndarray, size: int, step: int, window: Callable[[int], np.ndarray] = np.ones) -> np.ndarray:
    """V2: overlapping frames, the last padded with zeros, times a window function."""
    n = 1 if len(x) <= size else 1 + -(-(len(x) - size) // step)
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * step + size - len(x)))])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::step][:n] * window(size)


def power_spectrum(f: np.ndarray, nfft: int = 512) -> np.ndarray:
    """V3: squared magnitude over nfft."""
    return np.abs(np.fft.rfft(f, nfft)) ** 2 / nfft


def hz_to_mel(hz: np.ndarray | float) -> np.ndarray | float:
    return 2595 * np.log10(1 + np.asarray(hz) / 700.0)


def mel_to_hz(mel: np.ndarray | float) -> np.ndarray | float:
    return 700 * (10 ** (np.asarray(mel) / 2595.0) - 1)


def mel_filters(n: int = 40, nfft: int = 512, rate: int = 16_000, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """V4: triangular filters with centres evenly spaced in mel (n x nfft / 2 + 1)."""
    edges = np.floor((nfft + 1) * mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high or rate / 2), n + 2)) / rate)
    k = np.arange(nfft // 2 + 1)
    up = (k - edges[:-2, None]) / np.maximum(edges[1:-1, None] - edges[:-2, None], 1e-12)
    down = (edges[2:, None] - k) / np.maximum(edges[2:, None] - edges[1:-1, None], 1e-12)
    inside = (k >= edges[:-2, None]) & (k < edges[2:, None])
    return np.where(inside, np.where(k < edges[1:-1, None], up, down), 0.0)


def filterbank(x: np.ndarray, rate: int = 16_000, size_s: float = 0.025, step_s: float = 0.010, n: int = 40, nfft: int = 512, pre: float = 0.97) -> np.ndarray:
    """V5: filterbank energies of each frame, never below the smallest float."""
    f = frames(preemphasis(x, pre), round(size_s * rate), round(step_s * rate), np.hamming)
    e = power_spectrum(f, nfft) @ mel_filters(n, nfft, rate).T
    return np.where(e == 0, np.finfo(float).eps, e)


def frame_energies(x: np.ndarray, rate: int = 16_000, size_s: float = 0.025, step_s: float = 0.010, nfft: int = 512, pre: float = 0.97) -> np.ndarray:
    """V5: total energy of each frame that `filterbank` looks at, never 0."""
    e = power_spectrum(frames(preemphasis(x, pre), round(size_s * rate), round(step_s * rate), np.hamming), nfft).sum(axis=1)
    return np.where(e == 0, np.finfo(float).eps, e)


def log_filterbank(x: np.ndarray, rate: int = 16_000, **how) -> np.ndarray:
    """V6: 20 log10(max(e, 1e-5)), each column less its mean."""
    v = 20 * np.log10(np.maximum(filterbank(x, rate, **how), 1e-5))
    return v - v.mean(axis=0)


def log_filterbanks(samples: Column, rate: int = 16_000) -> Column:
    """V6 over a column of sample arrays; null or empty samples give null."""

    @F.pandas_udf("array<array<double>>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or len(x) == 0 else [list(r) for r in log_filterbank(np.asarray(x, float), rate)])

    return run(samples)


def embed(df: DataFrame, model: Callable[[list], np.ndarray], id_col: str, input_col: str, batch: int = 32) -> DataFrame:
    """V7, P5: embeddings (id, vec, L2-normalised) by any model that maps a list of inputs to a matrix; null inputs give null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            has = [i for i, x in enumerate(pdf["x"]) if x is not None]
            for lo in range(0, len(has), batch):
                part = has[lo : lo + batch]
                m = np.asarray(model([pdf["x"].iloc[i] for i in part]), float)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                for i, v in zip(part, m, strict=True):
                    out[i] = v
            yield pd.DataFrame({"id": pdf["id"], "vec": out})

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(input_col).alias("x")).mapInPandas(run, "id string, vec array<double>")


def recomputed(segments: DataFrame, features: DataFrame, key: str, vec: str, label: str, width: int, placeholder: int = 77) -> DataFrame:
    """V8: features by segment: absent ones become a zero vector with label 0, unlabelled ones get the placeholder."""
    f = features.select(key, F.col(vec).alias("__v"), F.col(label).alias("__l"), F.lit(True).alias("__has"))
    rows = segments.select(key).join(f, key, "left")
    zero = F.array_repeat(F.lit(0.0), width)
    return rows.select(key, F.coalesce(F.col("__v").cast("array<double>"), zero).alias("vec"), F.when(F.col("__has"), F.coalesce("__l", F.lit(placeholder))).otherwise(0).alias("label"))
