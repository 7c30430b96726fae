"""Sound features: the log-mel spectrogram, vectorized over the samples of a clip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_FFT, HOP, MELS, RATE = 400, 160, 128, 16000


def mel_scale(hz):
    """Slaney's scale: linear to 1000 Hz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hz(mel):
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def filterbank(n_mels: int = MELS, n_fft: int = N_FFT, rate: int = RATE) -> np.ndarray:
    """Triangular filters of equal area, n_mels by n_fft // 2 + 1."""
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    edges = mel_to_hz(np.linspace(mel_scale(0), mel_scale(rate / 2), n_mels + 2))
    rise = (bins[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(samples: np.ndarray, n_mels: int = MELS) -> np.ndarray:
    """n_mels by frames: power spectra of Hann windows, mel filters, log10 held within 8 of its maximum, scaled."""
    x = np.asarray(samples, np.float64)
    if len(x) < 2:
        return np.zeros((n_mels, 0))
    x = np.pad(x, N_FFT // 2, mode="reflect" if len(x) > N_FFT // 2 else "symmetric")
    frames = 1 + (len(x) - N_FFT) // HOP
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(N_FFT) / N_FFT)
    at = np.arange(N_FFT)[None, :] + HOP * np.arange(frames)[:, None]
    power = np.abs(np.fft.rfft(x[at] * window, axis=1))[:-1] ** 2
    logs = np.log10(np.maximum(filterbank(n_mels) @ power.T, 1e-10))
    return (np.maximum(logs, logs.max() - 8) + 4) / 4 if logs.size else logs


@F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
def log_mel_udf(samples: pd.Series) -> pd.Series:
    return pd.Series([log_mel(np.asarray(x)).astype(np.float32).tolist() if x is not None else None for x in samples])
