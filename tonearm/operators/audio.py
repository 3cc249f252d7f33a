"""Audio jobs over frame tables (track_id, frame_no, sample_rate, samples of 2048)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.listenability import composite_quality

FRAME, HEAD_SECONDS, COEFFICIENTS = 2048, 30, 20
SPECTRA = "track_id long, frame_no int, has_power boolean, signal double, noise double, centroid double, chroma array<double>"
SPECTRA_ARROW = pa.schema([("track_id", pa.int64()), ("frame_no", pa.int32()), ("has_power", pa.bool_()), ("signal", pa.float64()), ("noise", pa.float64()), ("centroid", pa.float64()), ("chroma", pa.list_(pa.float64()))])


#: Frames and inputs of a model that a task holds as wide numbers at a time.
SLICE = 256


def frame_spectra(frames: DataFrame, seconds: int | None = HEAD_SECONDS) -> DataFrame:
    """Power, noise, centroid and twelve chroma sums of every full frame of the first seconds (None: of all), SLICE frames at a time."""
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(FRAME) / (FRAME - 1)))

    def told(part: pd.DataFrame, rate: int, x: np.ndarray) -> pd.DataFrame:
        power = np.abs(np.fft.rfft(x * hann)[:, : FRAME // 2]) ** 2
        mags, total = np.sqrt(power), power.sum(axis=1)
        noise = np.sort(power, axis=1)[:, : FRAME // 4].sum(axis=1)
        hz = np.arange(FRAME // 2) * rate / FRAME
        heard = hz > 20
        note = np.zeros(FRAME // 2, int)
        note[heard] = np.floor(12 * np.log2(hz[heard] / 440) + 69.5).astype(int) % 12
        chroma = np.stack([mags[:, heard & (note == n)].sum(axis=1) for n in range(12)], axis=1)
        size = mags.sum(axis=1)
        centroid = np.where(size > 1e-12, (mags @ hz) / np.maximum(size, 1e-300), np.nan)
        return pd.DataFrame({
            "track_id": part["track_id"].to_numpy(), "frame_no": part["frame_no"].to_numpy(), "has_power": total >= 1e-20,
            "signal": total - noise, "noise": noise, "centroid": centroid, "chroma": list(chroma),
        })

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                samples = b.column("samples")
                b = b.select(["track_id", "frame_no", "sample_rate"]).to_pandas()
                full = np.flatnonzero(pc.equal(pc.list_value_length(samples), FRAME).fill_null(False).to_numpy(zero_copy_only=False))
                x = samples.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).reshape(-1, FRAME).astype(float)
                b = b.iloc[full].reset_index(drop=True)
                for rate, part in b.groupby("sample_rate"):
                    yield pa.RecordBatch.from_pandas(told(part, rate, x[part.index]), SPECTRA_ARROW, preserve_index=False)

    head = frames if seconds is None else frames.where(F.col("frame_no") * FRAME < F.col("sample_rate") * seconds)
    return head.select("track_id", "frame_no", "sample_rate", "samples").mapInArrow(run, SPECTRA)


def crest_parts(frames: DataFrame) -> DataFrame:
    """Peak, sum of squares and number of all samples of a frame, in expressions."""
    s = F.transform("samples", lambda x: x.cast("double"))
    return frames.select(
        "track_id", F.array_max(F.transform(s, lambda x: F.abs(x))).alias("peak"),
        F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x).alias("squares"), F.size("samples").alias("n"),
    )


def pool_quality(spectra: DataFrame, crests: DataFrame) -> DataFrame:
    """Per track: signal-to-noise ratio, centroid, chroma, crest factor and the composite quality."""
    use = lambda c: F.when(F.col("has_power"), F.col(c))
    chroma = F.array(*(F.avg(F.col("chroma")[i]) for i in range(12)))
    g = spectra.groupBy("track_id").agg(
        F.sum(use("signal")).alias("signal"), F.sum(use("noise")).alias("noise"),
        F.avg(F.when(~F.isnan("centroid"), F.col("centroid"))).alias("centroid"), chroma.alias("chroma"),
    )
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(40.0), 10 * F.log10(F.col("signal") / F.col("noise"))))
    snr = F.when(F.col("noise").isNull() | (F.col("noise") < 1e-20), 40.0).when(F.col("signal") < 1e-20, 0.0).otherwise(ratio)
    c = crests.groupBy("track_id").agg(F.max("peak").alias("peak"), F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"))
    c = c.select("track_id", F.when(F.col("rms") < 1e-12, 1.0).otherwise(F.col("peak") / F.col("rms")).alias("crest"))
    q = c.join(g.select("track_id", snr.alias("snr"), F.coalesce("centroid", F.lit(0.0)).alias("centroid"), "chroma"), "track_id", "left")
    q = q.fillna(0.0, ["snr", "centroid"])
    return q.withColumn("quality", composite_quality(F.col("snr"), F.col("centroid"), F.col("crest")))


def pool_coefficients(frames: DataFrame) -> DataFrame:
    """Per track: means, then population deviations, of the frames' coefficients, as one array."""
    each = frames.select("track_id", F.posexplode("coef"))
    g = each.groupBy("track_id", "pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s"))
    rows = F.sort_array(F.collect_list(F.struct("pos", "m", "s")))  # one for each coefficient
    t = g.groupBy("track_id").agg(rows.alias("r"))
    return t.select("track_id", F.concat(F.transform("r", lambda x: x["m"]), F.transform("r", lambda x: x["s"])).alias("mfcc"))


def load_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """Little-endian half-float blobs as float arrays, a batch at a time."""

    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype(np.float32))

    return df.withColumns({c: unpack(F.col(c)) for c in columns})


def store_vectors(df: DataFrame, *columns: str) -> DataFrame:
    """Float arrays as little-endian half-float blobs."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f2").tobytes())

    return df.withColumns({c: pack(F.col(c)) for c in columns})


def _unit_vectors(model):
    """A function of a list of inputs: their unit vectors by the model, which gets SLICE of them at a time."""

    def unit(inputs: list) -> np.ndarray:
        m = np.concatenate([np.asarray(model(inputs[at : at + SLICE]), float) for at in range(0, len(inputs), SLICE)])
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(size > 0, m / np.where(size > 0, size, 1), m).astype(np.float32)

    return unit


def embed_column(df: DataFrame, column: str, model, out: str = "embedding") -> DataFrame:
    """Unit vectors of a column by a caller's model: a picklable function from a list of inputs to a matrix."""

    unit = _unit_vectors(model)

    @F.pandas_udf("array<float>")
    def embed(batch: pd.Series) -> pd.Series:
        return pd.Series(list(unit(batch.tolist())) if len(batch) else [], dtype=object)

    return df.withColumn(out, embed(F.col(column)))


#: Heads that wait for the model in a task; ten seconds of one are about two megabytes.
HEADS = 32


def embed_heads(frames: DataFrame, seconds: int, model, out: str = "embedding") -> DataFrame:
    """Per track (track_id, ``out``): the unit vector of its first seconds by a caller's model (see ``embed_column``).

    Frames come to a task in their order and HEADS heads are held at a time, so that tracks are never collected.
    """
    started = frames.where(F.col("frame_no") * FRAME < F.col("sample_rate") * seconds).select("track_id", "frame_no", "samples", "sample_rate")

    unit = _unit_vectors(model)

    def run(batches):
        kind, track, parts, rate, waiting = None, None, [], 0, []

        def head():
            return track, None if any(p is None for p in parts) else np.concatenate(parts)[: rate * seconds]

        def told():
            vectors = unit([h for _, h in waiting])
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in waiting], kind), pa.array(list(vectors), pa.list_(pa.float32()))], ["track_id", out])

        for b in batches:
            kind, samples = b.schema.field("track_id").type, b.column("samples")
            for i, (t, r) in enumerate(zip(b.column("track_id").to_pylist(), b.column("sample_rate").to_pylist(), strict=True)):
                if parts and t != track:
                    waiting.append(head())
                    parts, rate = [], 0
                    if len(waiting) == HEADS:
                        yield told()
                        waiting = []
                s = samples[i]
                parts.append(s.values.to_numpy(zero_copy_only=False).copy() if s.is_valid else None)
                track, rate = t, max(rate, r)
        if parts:
            waiting.append(head())
        if waiting:
            yield told()

    ordered = started.repartition("track_id").sortWithinPartitions("track_id", "frame_no", "samples")
    return ordered.mapInArrow(run, f"track_id {dict(frames.dtypes)['track_id']}, {out} array<float>")
