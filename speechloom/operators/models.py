"""Scoring by outside models: a callable per Arrow batch, loaded once per task; energy islands and clip features.

No weights ship with the engine; a scorer is any callable that takes a list of clips and gives probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    def __call__(self, clips: list[np.ndarray], rate: int) -> list[float | None]: ...


def energy_scorer() -> Scorer:
    """A stand-in without weights: loudness against a clip's own peak, from 0 to 1; None for clips under 30 ms."""
    return lambda clips, rate: [None if len(c) < 0.03 * rate else float(np.sqrt(np.mean(c**2)) / max(float(np.max(np.abs(c))), 1e-12)) for c in clips]


def score(clips: DataFrame, column: str, rate: int, load: Callable[[], Scorer]) -> DataFrame:
    """clips with prob; load runs once per task. Cheap filters belong before this."""
    names = [f"{n} {t}" for n, t in clips.dtypes]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        for df in it:
            scorer = scorer or load()
            yield df.assign(prob=pd.Series(scorer([np.asarray(c, np.float32) for c in df[column]], rate), dtype="float64", index=df.index))

    return clips.mapInPandas(run, ", ".join([*names, "prob double"]))


def islands(samples: np.ndarray, rate: int, top_db: float = 30.0, least: float = 0.05, merge_gap: float = 0.03, frame: int = 1024, hop: int = 256) -> list[tuple[float, float]]:
    """Voiced stretches of a clip: frames within top_db of the loudest, short holes closed, short stretches left out."""
    if len(samples) == 0:
        return []
    padded = np.pad(np.asarray(samples, np.float64), frame // 2)
    starts = np.arange(0, len(padded) - frame + 1, hop)
    sums = np.concatenate(([0.0], np.cumsum(padded**2)))
    power = (sums[starts + frame] - sums[starts]) / frame
    loud = 10 * np.log10(np.maximum(power, 1e-10) / max(power.max(), 1e-10)) > -top_db
    edges = np.flatnonzero(np.diff(np.concatenate(([False], loud, [False])).astype(int)))
    spans = [(int(a * hop), int(min(b * hop, len(samples)))) for a, b in edges.reshape(-1, 2)]
    out: list[list[int]] = []
    for s, e in spans:
        if out and s - out[-1][1] <= int(merge_gap * rate):
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s / rate, e / rate) for s, e in out if (e - s) / rate >= least]


def log_mel(clip: np.ndarray, rate: int, bands: int = 64, frames: int = 101, window: float = 0.025, step: float = 0.010) -> np.ndarray:
    """Normalised log-mel energies, bands x frames, cut or padded to so many frames."""
    n, hop = int(window * rate), int(step * rate)
    size = 1 << (n - 1).bit_length()
    clip = np.pad(np.asarray(clip, np.float64), (size // 2, size // 2), mode="reflect" if len(clip) > size // 2 else "constant")
    at = np.arange(0, max(len(clip) - size, 0) + 1, hop)[:, None] + np.arange(size)
    taper = np.zeros(size)
    taper[(size - n) // 2 : (size - n) // 2 + n] = np.hanning(n)
    power = np.abs(np.fft.rfft(clip[at] * taper)) ** 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    freqs = np.fft.rfftfreq(size, 1 / rate)
    up, down = (freqs - points[:-2, None]) / np.diff(points)[:-1, None], (points[2:, None] - freqs) / np.diff(points)[1:, None]
    out = np.log(np.maximum(np.maximum(0, np.minimum(up, down)) @ power.T, 1e-10))
    out = (out - out.mean()) / (out.std() + 1e-6)
    return np.pad(out[:, :frames], ((0, 0), (0, max(0, frames - out.shape[1])))).astype(np.float32)


def sample_index(t: Column, rate: int, n: Column) -> Column:
    """Sample of a time, rounded half to even, within 0...n; null for null."""
    return F.when(t.isNotNull(), F.least(F.greatest(F.rint(t * rate).cast("bigint"), F.lit(0)), n))


def disfluency_labels(sentences: DataFrame, words: str, load: Callable[[], Callable[[list[list[str]]], list[list[int]]]]) -> DataFrame:
    """sentences with labels by a sentence labeller (batch of word lists -> 0/1 lists), and the words labelled 0."""
    names = [f"{n} {t}" for n, t in sentences.dtypes]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = None
        for df in it:
            labeller = labeller or load()
            ws = [list(w) if w is not None else [] for w in df[words]]
            labels = labeller(ws)
            yield df.assign(labels=labels, cleaned=[" ".join(w for w, x in zip(a, b) if not x) for a, b in zip(ws, labels)])

    return sentences.mapInPandas(run, ", ".join([*names, "labels array<int>, cleaned string"]))


def match_counts(events: DataFrame, audio: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_events, n_matched, n_unmatched events by their composite key, and n_keys matched. Audio columns beside
    the keys aren't read; a null in a key never matches."""
    there = audio.select(*keys).distinct().withColumn("_there", F.struct(*keys))
    m = events.select(*keys).join(there, keys, "left")
    return m.agg(F.count(F.lit(1)).alias("n_events"), F.count("_there").alias("n_matched"), F.count_if(F.col("_there").isNull()).alias("n_unmatched"), F.countDistinct("_there").alias("n_keys"))


#: Samples in a block of audio; a block is one value.
BLOCK = 8192


def audio_blocks(audio: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """Audio (keys, samples ARRAY<FLOAT>) in blocks: keys, block (from 0), samples, `size` in each but the last."""
    n = F.size("samples")
    return audio.select(*keys, "samples", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / size).cast("int"))).alias("block")).select(*keys, "block", F.slice("samples", F.col("block") * size + 1, size).alias("samples"))


def event_clips(events: DataFrame, blocks: DataFrame, lengths: DataFrame, keys: list[str], start: str, end: str, rate: int, least: float, size: int = BLOCK) -> DataFrame:
    """Events whose key has audio, with clip, the samples from start to end, and dropped: '', 'no time' (null or NaN) or
    'too short' (under `least` seconds); dropped events have no clip.

    Audio comes as audio_blocks (of `size`) and its lengths (keys, n samples), both once a key. An event meets the blocks it
    touches only, so that no row holds a whole recording and a long recording's events are many tasks' work. Events within
    a block are cut there; the others are put together from their pieces. Samples that lengths tell of and blocks lack
    raise an error."""
    given = F.col(start).isNotNull() & F.col(end).isNotNull() & ~F.isnan(start) & ~F.isnan(end)
    m = events.join(lengths.select(*keys, F.col("n").cast("bigint").alias("_n")), keys)
    m = m.withColumns({"_a": F.when(given, sample_index(F.col(start), rate, F.col("_n"))), "_b": F.when(given, sample_index(F.col(end), rate, F.col("_n")))})
    names, length = events.columns, F.col("_b") - F.col("_a")
    m = m.withColumn("dropped", F.when(~given, "no time").when(length < max(round(least * rate), 0), "too short").otherwise("")).drop("_n")
    none = F.array().cast("array<float>")
    short = m.filter((F.col("dropped") != "") | (length <= 0)).select(*names, "dropped", F.when(F.col("dropped") == "", none).alias("clip"))
    kept = m.filter((F.col("dropped") == "") & (length > 0)).withColumns({"_first": F.floor(F.col("_a") / size).cast("int"), "_last": F.floor((F.col("_b") - 1) / size).cast("int")})
    within = kept.filter(F.col("_first") == F.col("_last")).withColumn("block", F.col("_first"))
    across = kept.filter(F.col("_first") < F.col("_last")).withColumn("block", F.explode(F.sequence("_first", "_last")))

    def pieces(of: DataFrame) -> DataFrame:
        audio = blocks.select(*keys, "block", F.col("samples").alias("_samples"))
        begin = F.greatest(F.col("_a") - F.col("block") * F.lit(size).cast("bigint"), F.lit(0))
        stop = F.least(F.col("_b") - F.col("block") * F.lit(size).cast("bigint"), F.lit(size))
        # Spark takes an array for one element's size and would broadcast the audio.
        return of.join(audio.hint("merge"), [*keys, "block"], "left").withColumn("clip", F.slice("_samples", (begin + 1).cast("int"), (stop - begin).cast("int"))).drop("_samples")

    # Equal events have equal pieces: each block's pieces stand side by side, one an event.
    many = pieces(across).groupBy(*names, "dropped", "_a", "_b", "_first", "_last").agg(F.sort_array(F.collect_list(F.struct("block", "clip"))).alias("_p"))
    many = many.withColumn("_k", (F.size("_p") / (F.col("_last") - F.col("_first") + 1)).cast("int"))
    whole = F.flatten(F.transform(F.filter("_p", lambda p, i: i % F.col("_k") == 0), lambda p: p["clip"]))
    many = many.withColumn("clip", whole).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    columns = [*names, "dropped", "_a", "_b", "clip"]
    clips = pieces(within).select(*columns).unionByName(many.select(*columns))
    sure = F.when(F.size("clip") == F.col("_b") - F.col("_a"), F.col("clip")).otherwise(F.raise_error(F.lit("audio lacks samples of an event")).cast("array<float>"))
    return short.unionByName(clips.select(*names, "dropped", sure.alias("clip")))


def clip_features(clips: DataFrame, column: str, rate: int, load: Callable[[], Callable[[np.ndarray, int], np.ndarray]]) -> DataFrame:
    """clips with features ARRAY<DOUBLE> by an extractor that is loaded once per task; null clips have none."""
    names = [f"`{n}` {t}" for n, t in clips.dtypes if n != column]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = None
        for df in it:
            extract = extract or load()
            made = [None if c is None else [float(x) for x in extract(np.asarray(c, np.float64), rate)] for c in df[column]]
            yield df.drop(columns=[column]).assign(features=pd.Series(made, index=df.index, dtype="object"))

    return clips.mapInPandas(run, ", ".join([*names, "features array<double>"]))


def hand_features(clip: np.ndarray, rate: int, frame: float = 0.025, hop: float = 0.010) -> np.ndarray:
    """35 numbers of a clip: duration; mean and deviation over frames of loudness, zero crossings, spectral centroid and
    spectral spread; and of 13 cepstral coefficients of the log-mel energies. Clips under a frame are padded."""
    n, step = max(int(frame * rate), 2), max(int(hop * rate), 1)
    x = np.pad(np.asarray(clip, np.float64), (0, max(0, n - len(clip))))
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    power = np.abs(np.fft.rfft(frames * np.hanning(n))) ** 2
    freqs, total = np.fft.rfftfreq(n, 1 / rate), power.sum(1) + 1e-12
    centroid = power @ freqs / total
    spread = np.sqrt(np.maximum(power @ freqs**2 / total - centroid**2, 0))
    mel = log_mel(x, rate, 40, max(1, len(frames)))
    k = np.arange(40)
    cepstra = np.cos(np.pi / 40 * np.outer(np.arange(13), k + 0.5)) @ mel
    rows = [np.sqrt((frames**2).mean(1)), (np.diff(np.signbit(frames), axis=1)).mean(1), centroid, spread, *cepstra]
    return np.array([len(clip) / rate, *[f(r) for r in rows for f in (np.mean, np.std)]])
