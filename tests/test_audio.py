import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.functions import audio, bands, transforms
from bandlake.sources import readers


def direct(x, rate, to, crossings=16):
    """Every output as a sum over all samples."""
    cut = min(1, to / rate)
    half = int(np.ceil(crossings / cut))
    n = -(-len(x) * to // rate)
    out = np.zeros(n)
    for j in range(n):
        t = j * rate / to - np.arange(len(x))
        some = np.abs(t) < half
        out[j] = (x[some] * cut * np.sinc(cut * t[some]) * (0.5 + 0.5 * np.cos(np.pi * t[some] / half))).sum()
    return out


@pytest.mark.parametrize(("rate", "to"), [(3, 2), (2, 3), (44100, 16000), (8000, 48000), (32000, 32000), (5, 1)])
def test_resampling_equals_direct_convolution(rate, to, monkeypatch):
    monkeypatch.setattr(audio, "CHUNK", 37)
    x = np.random.default_rng(1).normal(size=(2, 150))
    got = audio.resampled(x, rate, to)
    for a, b in zip(got, x):
        assert np.allclose(a, direct(b, rate, to) if rate != to else b)


def test_tones_keep_their_pitch(spark):
    t = np.arange(44100) / 44100
    low, high = np.sin(2 * np.pi * 440 * t), np.sin(2 * np.pi * 12000 * t)
    df = spark.createDataFrame([(1, (low + high).tolist()), (2, None), (3, [])], "id int, x array<double>")
    rows = {r["id"]: r["y"] for r in df.select("id", audio.resample(F.col("x"), 44100, 16000).alias("y")).collect()}
    y = np.array(rows[1])
    assert len(y) == 16000 and rows[2] is None and rows[3] == []
    want = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert np.abs(y - want)[200:-200].max() < 0.01
    with pytest.raises(ValueError):
        audio.resample(F.col("x"), 0, 1)


def test_files_are_resampled_and_cropped(spark, tmp_path):
    samples = (np.sin(np.arange(4000) / 20) * 20000).astype("<i2")
    sink = io.BytesIO()
    with wave.open(sink, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(samples.tobytes())
    (tmp_path / "a.wav").write_bytes(sink.getvalue())
    files = readers.read_files(spark, str(tmp_path))
    plain = np.array(readers.embed_files(files, "waveform").first()["series"])
    assert np.allclose(plain, samples / 2**15)
    cut = np.array(readers.embed_files(files, "waveform", "16000,0.25").first()["series"])
    whole = direct(plain, 8000, 16000)
    assert len(cut) == 4000 and np.allclose(cut, whole[2000:6000])


def clicks(bpm, rate=8000, seconds=12):
    x = np.zeros(rate * seconds)
    for beat in np.arange(0.3, seconds - 0.1, 60 / bpm):
        at = int(beat * rate)
        x[at : at + 200] += np.sin(np.arange(200) * 0.9) * np.exp(-np.arange(200) / 40)
    return x


def test_tempo_of_clicks(spark):
    rows = [(bpm, clicks(bpm).tolist()) for bpm in (72, 90, 120, 150)] + [(0, np.zeros(40000).tolist()), (1, [0.5] * 600), (2, None)]
    df = spark.createDataFrame(rows, "bpm int, x array<double>")
    got = {r["bpm"]: r["t"] for r in df.select("bpm", audio.tempo(F.col("x"), 8000, 512, 128, 40).alias("t")).collect()}
    for bpm in (72, 90, 120, 150):
        assert got[bpm] == pytest.approx(bpm, rel=0.02)
    assert got[0] is None and got[1] is None and got[2] is None


def test_spectrogram_has_a_time_axis(spark):
    x = np.concatenate([np.zeros(4000), np.sin(np.arange(4000) * 0.5)])
    df = spark.createDataFrame([(1, x.tolist())], "id int, x array<double>")
    rows = audio.spectrogram(df, ["id"], "x", 8000, 16, 256, 128).collect()
    table = np.full((max(r["frame"] for r in rows) + 1, 16), np.nan)
    for r in rows:
        table[r["frame"], r["mel"]] = r["db"]
        assert r["time"] == pytest.approx(r["frame"] * 128 / 8000)
    want = transforms.mel_decibels(x[None], bands.mel_filter_bank(129, 16, 8000), 256, 128)[0]
    assert np.allclose(table, want) and table[:25].max() == -80 and table[40:].max() > -1e-6
    onset = np.array(df.select(audio.onset_strength(F.col("x"), 8000, 256, 128, 16).alias("o")).first()["o"])
    assert abs(onset.argmax() - 4000 // 128) <= 1


def test_parts_of_series_sum_to_them(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=n).tolist()) for i, n in enumerate((1, 3, 4, 7, 16, 600))] + [(9, None), (10, [])]
    got = {r["id"]: r["d"] for r in spark.createDataFrame(rows, "id int, x array<double>").select("id", transforms.decomposed(F.col("x"), 4).alias("d")).collect()}
    assert got[9] is None and got[10] == [[]] * 5
    for i, x in rows[:6]:
        parts = np.array(got[i])
        assert np.allclose(parts[0], x) and np.allclose(parts[1:].sum(axis=0), x)
    x = np.array(rows[4][1])
    basis = transforms.dct_basis(16)
    assert np.allclose(got[4][2], (x @ basis.T * (np.arange(16) // 4 == 1)) @ basis)
    filtered = spark.createDataFrame(rows[4:5], "id int, x array<double>").select(transforms.decomposed(F.col("x"), 5, 64).alias("d")).first()["d"]
    w = bands.parse_filter("eqalloc(64, 5, 2)")
    assert np.allclose(filtered[3], (x @ basis.T * transforms.pooled_filter(w, 16)) @ basis)
