"""Signals: pools of noise clips, mixing at a signal-to-noise ratio, masking spans, quantising.

A signal is an array of floats, mono. Whatever is drawn comes from a hash of the row's key, so that
reruns and other partitionings give the same samples.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds, hertz and counts that results depend on.
RATE = 16_000
CLIP_SECONDS = 30
POOL_CLIPS = 300
POOL_CLIP_SECONDS = 10
POOL_LEAST_SECONDS = 1
SPEAKERS = 3
MASK_LEAST_SECONDS = 0.10
MASK_LEAST_LEVEL = 0.01
SLOT_SNR = {"answer": (8.0, 20.0), "repair": (0.0, 12.0), "repeat": (0.0, 4.0)}
SLOT_SNR_DISJOINT = {"answer": (12.0, 20.0), "repair": (5.0, 12.0), "repeat": (0.0, 5.0)}
SLOT_WEIGHTS = {"answer": 1, "repair": 2, "repeat": 2}
CLEAN_SHARE = 0.25
# End of fixed values.
#: Samples of noise that a task holds at a time.
NOISE_SAMPLES = 1 << 20


def power(signal: Column) -> Column:
    squares = F.aggregate(signal, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return squares / F.size(signal)


def peak(signal: Column) -> Column:
    return F.array_max(F.transform(signal, F.abs))


def downmix(channels: Column) -> Column:
    """The mean of equally long channels."""
    first = F.element_at(channels, 1)
    return F.transform(first, lambda _, i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i)) / F.size(channels))


def truncated(signal: Column, seconds: int = CLIP_SECONDS, rate: int = RATE) -> Column:
    return F.slice(signal, 1, seconds * rate)


def noise_pool(clips: DataFrame, order: str, clips_wanted: int = POOL_CLIPS, rate: int = RATE) -> DataFrame:
    """The first clips, in order, that are longer than a second once cut to ten."""
    short = clips.withColumn("audio", F.slice("audio", 1, POOL_CLIP_SECONDS * rate))
    return short.where(F.size("audio") > POOL_LEAST_SECONDS * rate).orderBy(order).limit(clips_wanted)


def generator(*key: object) -> np.random.Generator:
    digest = hashlib.md5(":".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "little")))


def mix(clean: np.ndarray, clips: list[np.ndarray], snr_db: float, rng: np.random.Generator) -> np.ndarray:
    """``clean`` plus the mean of the clips, scaled so that the ratio of their powers is ``snr_db``; at most 1 in size."""
    n = len(clean)
    fitted = []
    for clip in clips:
        if len(clip) < n:
            fitted.append(np.resize(clip, n))
        else:
            at = int(rng.integers(0, len(clip) - n + 1))
            fitted.append(clip[at : at + n])
    noise = np.mean(fitted, axis=0, dtype=np.float64)
    wanted = np.mean(np.square(clean, dtype=np.float64)) / 10 ** (snr_db / 10)
    have = np.mean(np.square(noise))
    out = clean + noise * np.sqrt(wanted / have) if have > 0 else clean.astype(np.float64)
    return (out / max(1.0, float(np.max(np.abs(out), initial=0.0)))).astype(np.float32)


def mixed(rows: DataFrame, pool: DataFrame, key: str = "id", snr: str = "snr_db", seed: int = 42) -> DataFrame:
    """``rows`` with the column ``noisy``: ``audio`` with three clips of other keys at ``snr``; a null ratio stays clean.

    The pool has at most POOL_CLIPS clips of ten seconds, 192 MB as floats: it alone is sent to every task.
    """
    held = [(r[0], np.asarray(r[1], np.float32)) for r in pool.select(key, "audio").limit(POOL_CLIPS).toLocalIterator()]
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clips = shared.value
        for frame in frames:
            noisy = []
            for k, audio, level in zip(frame[key], frame["audio"], frame[snr], strict=True):
                clean = np.asarray(audio, np.float32)
                if pd.isna(level) or not len(clean):
                    noisy.append(clean)
                    continue
                rng = generator(seed, k, level)
                others = [i for i, (owner, _) in enumerate(clips) if owner != k]
                if len(others) < SPEAKERS:
                    raise ValueError(f"the pool has {len(others)} clips of other keys than {k}, not {SPEAKERS}")
                picked = rng.choice(others, SPEAKERS, replace=False)
                noisy.append(mix(clean, [clips[i][1] for i in picked], float(level), rng))
            yield frame.assign(noisy=noisy)

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(add, f"{kinds}, noisy array<float>")


def mask(audio: np.ndarray, start: float, end: float, rng: np.random.Generator, rate: int = RATE, pad: float = 0.0) -> np.ndarray | None:
    """Noise as loud as the span [start, end) in place of it; short spans are widened about their middle. None where nothing is left of it."""
    a, b = int((start - pad) * rate), int((end + pad) * rate)
    least = int(MASK_LEAST_SECONDS * rate)
    if b - a < least:
        a = (a + b) // 2 - least // 2
        b = a + least
    a, b = max(a, 0), min(b, len(audio))
    if a >= b:
        return None
    out = np.array(audio, np.float32)
    out[a:b] = rng.normal(0, max(float(np.mean(np.abs(out[a:b]))), MASK_LEAST_LEVEL), b - a)
    return out


def masked(rows: DataFrame, key: str = "id", span: str = "span", seed: int = 42) -> DataFrame:
    """``rows`` with ``noisy``: ``audio`` with noise over ``span`` (start, end in seconds) as ``mask`` puts it; null where the span is empty.

    Signals stay in Spark's rows: Python gets a key, a length and a level for each, and returns noise in pieces of NOISE_SAMPLES
    samples, or one signal's, so that its memory does not follow the rows or the signals' lengths. Levels are means in double precision.
    """

    def noise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in frames:
            made, held = [], 0
            for k, n, level in zip(frame["key"], frame["n"], frame["level"], strict=True):
                n = 0 if pd.isna(n) else int(n)
                if made and held + n > NOISE_SAMPLES:
                    yield pd.Series(made, dtype="object")
                    made, held = [], 0
                made.append(generator(seed, "mask", k).normal(0, level, n).astype(np.float32) if n else None)
                held += n
            yield pd.Series(made, dtype="object")

    seconds, size, least = F.col(span), F.size("audio"), int(MASK_LEAST_SECONDS * RATE)
    first, last = ((seconds[c] * RATE).cast("long") for c in ("start", "end"))
    middle = F.shiftright(first + last, 1) - least // 2
    short = last - first < least
    a, b = F.greatest(F.when(short, middle).otherwise(first), F.lit(0)), F.least(F.when(short, middle + least).otherwise(last), size)
    known = F.when(seconds["start"].isNotNull() & seconds["end"].isNotNull() & (size >= 0) & (a < b), F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    at, n = F.col("_at"), F.col("_at.b") - F.col("_at.a")
    level = F.aggregate(F.slice("audio", at["a"] + 1, n), F.lit(0.0), lambda t, x: t + F.abs(x.cast("double"))) / n
    drawn = F.pandas_udf(noise, "array<float>")(F.struct(F.col(key).cast("string").alias("key"), n.alias("n"), F.greatest(level, F.lit(MASK_LEAST_LEVEL)).alias("level")))
    noisy = F.concat(F.slice("audio", F.lit(1), at["a"]), F.col("_noise"), F.slice("audio", at["b"] + 1, size - at["b"])).cast("array<float>")
    return rows.withColumn("_at", known).withColumn("_noise", drawn).withColumn("noisy", noisy).drop("_at", "_noise")


def pcm16(signal: np.ndarray) -> np.ndarray:
    """Samples as 16-bit integers; models hear and rows ship these."""
    return np.rint(np.clip(signal, -1.0, 1.0) * 32767).astype("<i2")


def _wav_bytes(signal: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes(pcm16(signal).tobytes())
    return out.getvalue()


def wav(signal: Column) -> Column:
    """A mono wav file of 16-bit samples; null for no signal."""

    def files(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else _wav_bytes(np.asarray(x, np.float64)))

    return F.pandas_udf(files, "binary")(signal)
