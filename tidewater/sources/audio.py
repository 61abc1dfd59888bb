"""WAV files as columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATS = "path string, sample_rate int, frames bigint, seconds double, peak double, rms double, clipping double, problem string"


def pcm16(content: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, samples) of a mono 16-bit PCM file; its chunks are walked, unknown ones are
    passed over."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if len(body) < size:
                raise ValueError("the data chunk is cut off")
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("a format or data chunk is missing")
    if form[0] != 1 or form[1] != 1 or form[5] != 16:
        raise ValueError("not mono 16-bit PCM")
    return form[2], np.frombuffer(data[: len(data) // 2 * 2], "<i2")


def wav_stats(spark: SparkSession, path: str) -> DataFrame:
    """Length, level and clipping of each file; a file that can't be read gets a ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rate, x = pcm16(c)
                except (ValueError, struct.error) as e:
                    out.append((p, None, None, None, None, None, None, str(e)))
                    continue
                y = x.astype(np.float64) / 32768
                n = len(y)
                out.append((p, rate, n, n / rate, float(np.abs(y).max()) if n else 0.0, float(np.sqrt((y * y).mean())) if n else 0.0, float((np.abs(x.astype(int)) >= 32767).mean()) if n else 0.0, None))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in STATS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, STATS)


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sample_rate, samples)``, samples between -1 and 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                rate, x = pcm16(c)
                yield pd.DataFrame({"path": [p], "sample_rate": [rate], "samples": [(x / 32768).astype(np.float32)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>")


def usable(stats: DataFrame, least_seconds: float = 0.2, most_seconds: float = 60, most_clipping: float = 0.001, least_rms: float = 0.001) -> DataFrame:
    """Files that pass the quality gates."""
    return stats.where(
        F.col("problem").isNull() & F.col("seconds").between(least_seconds, most_seconds) & (F.col("clipping") <= most_clipping) & (F.col("rms") >= least_rms)
    )
