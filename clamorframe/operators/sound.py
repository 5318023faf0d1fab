"""Reading recordings: PCM wav files to signals, other rates brought to one by a windowed-sinc filter."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import RATE

#: Zero crossings of the sinc on either side, counted at the lower of the two rates.
CROSSINGS = 16

_filters: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}


def _filter(up: int, down: int, crossings: int) -> tuple[np.ndarray, np.ndarray]:
    """For each phase of the output the offset of its first input sample, and its weights, which sum to 1."""
    key = (up, down, crossings)
    if key not in _filters:
        slower = max(1.0, down / up)  # input samples from one zero crossing to the next
        reach = int(np.ceil(crossings * slower))
        phase = np.arange(up) * down % up / up
        t = (np.arange(-reach, reach + 1)[None, :] - phase[:, None]) / slower
        weights = np.sinc(t) * np.where(np.abs(t) <= crossings, np.cos(np.pi * t / (2 * crossings)) ** 2, 0.0)
        _filters[key] = (np.arange(up) * down // up - reach, weights / weights.sum(axis=1, keepdims=True))
    return _filters[key]


def resample(signal: np.ndarray, rate: int, wanted: int = RATE, crossings: int = CROSSINGS) -> np.ndarray:
    """``signal`` at the wanted rate: a polyphase filter for the rational ratio, its sinc cut off by a squared cosine.

    Sample k of the result stands for the time k / wanted; there are as many as begin within the signal. Outside of it
    all is zero. Lowering the rate, the filter also takes away what the new rate cannot hold.
    """
    x = np.asarray(signal, np.float64)
    if rate == wanted or not len(x):
        return x.astype(np.float32)
    up, down = wanted // gcd(rate, wanted), rate // gcd(rate, wanted)
    first, weights = _filter(up, down, crossings)
    n, width = -(-len(x) * up // down), weights.shape[1]
    reach = width // 2
    padded = np.concatenate([np.zeros(reach), x, np.zeros(width + down)])
    out = np.empty(n)
    for phase in range(min(up, n)):
        at = first[phase] + reach + np.arange(len(out[phase::up])) * down
        out[phase::up] = np.lib.stride_tricks.sliding_window_view(padded, width)[at] @ weights[phase]
    return out.astype(np.float32)


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(signal, rate) of a PCM wav file of 8, 16, 24 or 32 bits or of floats, its channels averaged. ValueError for anything else."""
    data = bytes(data)
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no wav file")
    at, form, samples = 12, None, None
    while at + 8 <= len(data) and samples is None:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = body
        elif name == b"data":
            samples = body
        at += 8 + size + size % 2
    if form is None or len(form) < 16 or samples is None:
        raise ValueError("a wav file without its form or its samples")
    number = lambda a, b: int.from_bytes(form[a:b], "little")
    code, channels, rate, bits = number(0, 2), number(2, 4), number(4, 8), number(14, 16)
    if code == 0xFFFE and len(form) >= 26:  # an extended form names the code behind
        code = number(24, 26)
    if not channels or not rate:
        raise ValueError("a wav file without channels or rate")
    if code == 3 and bits in (32, 64):
        x = np.frombuffer(samples[: len(samples) // (bits // 8) * (bits // 8)], f"<f{bits // 8}").astype(np.float64)
    elif code == 1 and bits == 8:
        x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    elif code == 1 and bits in (16, 32):
        x = np.frombuffer(samples[: len(samples) // (bits // 8) * (bits // 8)], f"<i{bits // 8}") / float(1 << (bits - 1))
    elif code == 1 and bits == 24:
        three = np.frombuffer(samples[: len(samples) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / float(1 << 23)
    else:
        raise ValueError(f"samples of form {code} with {bits} bits")
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.float32), rate


def at_rate(rows: DataFrame, wanted: int = RATE, audio: str = "audio", rate: str = "sampling_rate") -> DataFrame:
    """``rows`` with their signals at the wanted rate; without a signal, or a rate above 0, both become null."""

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [None if x is None or pd.isna(r) or r <= 0 else resample(np.asarray(x, np.float64), int(r), wanted) for x, r in zip(frame[audio], frame[rate], strict=True)]
            known = pd.Series([None if x is None else wanted for x in made], index=frame.index, dtype="object")
            yield frame.assign(**{audio: pd.Series(made, index=frame.index, dtype="object"), rate: known})

    names = [c for c in rows.columns if c not in (audio, rate)]
    kinds = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in names), f"`{audio}` array<float>", f"`{rate}` int"])
    return rows.select(*names, audio, rate).mapInPandas(convert, kinds)


def recordings(spark: SparkSession, path: str, wanted: int = RATE) -> DataFrame:
    """(path, audio, sampling_rate, source_rate, error) of the wav files below a folder, one row a file, at the wanted rate; a file that cannot be read has its error and no signal."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, data in zip(frame["path"], frame["content"], strict=True):
                try:
                    signal, rate = decode_wav(data)
                    out.append((name, resample(signal, rate, wanted), wanted, rate, None))
                except ValueError as e:
                    out.append((name, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "audio", "sampling_rate", "source_rate", "error"], dtype="object")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(read, "path string, audio array<float>, sampling_rate int, source_rate int, error string")


def energy(signal: Column, rate: int) -> Column:
    """The sum of squares over the rate, which does not change with the rate."""
    return F.aggregate(signal, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / rate
