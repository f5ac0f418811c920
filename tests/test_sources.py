import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandlake.sources import readers, writers
from bandlake.streaming import series as streams


def npz(path, **data):
    np.savez(path, **data)
    return str(path)


def test_npz(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal((3, 4, 2, 8)).astype(np.float32)
    path = npz(tmp_path / "a.npz", embeddings=x, genres=np.array(["p", "q", "p"]))
    got = readers.read_npz(spark, path).orderBy("sample_id", "feature_idx").collect()
    assert len(got) == 24 and np.allclose([r.series for r in got], x.reshape(24, 8)) and [r.label for r in got[::8]] == ["p", "q", "p"]
    other = readers.read_npz(spark, path, layout="segment_major").orderBy("sample_id", "feature_idx").collect()
    assert np.allclose([r.series for r in other[:8]], x[0].transpose(1, 0, 2).reshape(8, 8))
    deep = npz(tmp_path / "b.npz", embeddings=np.zeros((2, 3, 4, 2, 8)), composers=np.array(["a", "b"]), layers=np.array([1, 5, 9]))
    assert {r.layer for r in readers.read_npz(spark, deep).select("layer").distinct().collect()} == {1, 5, 9}
    with pytest.raises(Exception, match="needs embeddings"):
        readers.read_npz(spark, npz(tmp_path / "c.npz", embeddings=np.zeros((2, 3, 4)))).collect()
    readers.register_config(readers.EmbeddingConfig("small", "p", 4, 2, 8))
    assert readers.get_config("small").features == 8 and readers.get_config("small").coefficients == 5
    with pytest.raises(KeyError, match="small"):
        readers.get_config("other")


def test_text_formats(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(",set,set,track\n,split,subset,genre_top\n1,training,small,Rock\n2,test,large,Pop\n")
    raw = readers.read_hierarchical_csv(spark, str(tmp_path / "raw.csv"))
    assert raw.columns == ["track_id", "set_split", "set_subset", "track_genre_top"] and raw.count() == 2
    (tmp_path / "a.jams").write_text(json.dumps({"annotations": [{"namespace": "beat", "data": []}, {"namespace": "chord", "data": [{"time": 0.5, "duration": 1.5, "value": "C:maj"}]}, {"namespace": "chord", "data": [{"time": 9, "duration": 9, "value": "N"}]}]}, indent=1))
    assert [(r.time, r.value) for r in readers.read_jams(spark, str(tmp_path / "a.jams")).collect()] == [(0.5, "C:maj")]
    tree = "# text = x\n1\tThe\tthe\tDET\tDT\t_\t2\tdet\t_\t_\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n2\tend\tend\tNOUN\tNN\t_\t0\troot:x\t_\t_\n"
    (tmp_path / "en_ewt-ud-dev.conllu").write_text(tree + "\n" + tree.replace("end", "cat") + "\n")
    found = readers.read_conllu(spark, str(tmp_path / "en_ewt-ud-dev.conllu"))
    assert sorted(r.words[1] for r in found.collect()) == ["cat", "end"] and found.select(readers.treebank_name(F.col("path"))).first()[0] == "en-ewt-dev"
    # equal sentences keep ids of their own, whatever the line ends and however files are split
    twice = (tree + "\n") * 2 + tree.replace("end", "cat") + "\n"
    (tmp_path / "fr_x-ud-dev.conllu").write_bytes(twice.replace("\n", "\r\n").encode())
    (tmp_path / "fr_y-ud-dev.conllu").write_text(twice)
    both = spark.read.text(str(tmp_path / "fr_y-ud-dev.conllu")).count()
    rows = [(r.path[-19:-16], r.sentence, tuple(r.words), tuple(r.relations)) for r in readers.read_conllu(spark, str(tmp_path / "fr_*")).collect()]
    assert both and len(rows) == 6 == len({r[:2] for r in rows}) and len({r[2:] for r in rows}) == 2
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        small = [(r.path[-19:-16], r.sentence, tuple(r.words), tuple(r.relations)) for r in readers.read_conllu(spark, str(tmp_path / "fr_*")).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(small) == sorted(rows)
    (tmp_path / "p.tsv").write_text('0\ta "b\tc\n1\td\te\n')
    assert readers.read_pairs_tsv(spark, str(tmp_path / "p.tsv")).count() == 2


def test_chords(spark, tmp_path):
    (tmp_path / "s.csv").write_text("track_id,chord_label\na,C:maj\nb,N\n")
    np.save(tmp_path / "e.npy", np.array([[1.0, 2.0], [3.0, 4.0]]))
    got = readers.read_chords(spark, str(tmp_path / "s.csv"), str(tmp_path / "e.npy")).collect()
    assert {(r.chord_label, tuple(r.features)) for r in got} == {("C:maj", (1.0, 2.0)), ("N", (3.0, 4.0))}


def test_files_and_sinks(spark, tmp_path):
    sound = io.BytesIO()
    with wave.open(sound, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000), f.writeframes(np.array([0, 16384, -16384], "<i2").tobytes())
    (tmp_path / "in").mkdir()
    for name, data in (("x_BN_comp_mix.wav", sound.getvalue()), ("y_SS_comp_mix.wav", b"bad"), ("x_BN_comp.jams", b"{}")):
        (tmp_path / "in" / name).write_bytes(data)
    audio, notes = (readers.read_files(spark, str(tmp_path / "in"), p) for p in ("*comp_mix.wav", "*.jams"))
    pairs, alone = readers.pair_annotations(audio, notes)
    assert pairs.count() == 1 and alone.first()["name"] == "y_SS_comp.jams"
    series = {r.path[-18:]: r.series for r in readers.embed_files(audio, "waveform").collect()}
    assert series["/x_BN_comp_mix.wav"] == [0.0, 0.5, -0.5] and series["/y_SS_comp_mix.wav"] is None
    with pytest.raises(ValueError, match="waveform"):
        readers.embed_files(audio, "nothing")
    corpus = spark.createDataFrame([("a \"q\"\nb", ["X", "Y"])], "text string, label array<string>")
    writers.write_corpus(corpus, str(tmp_path / "c"))
    assert tuple(readers.read_corpus_csv(spark, str(tmp_path / "c")).first()) == ('a "q"\nb', "X Y")
    writers.write_metrics(spark.createDataFrame([("p", 0.5)], "name string, value double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().value == 0.5
    assert writers.report_lines(spark.createDataFrame([("p", 0.123)], "n string, v double"), "%s: %.2f", "n", "v").first().value == "p: 0.12"
    writers.write_series(readers.random_series(spark, 4, 3).withColumn("model", F.lit("m")), str(tmp_path / "s"), ("model",))
    assert spark.read.parquet(str(tmp_path / "s")).where("model = 'm'").count() == 4


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for name, f in (("stats", lambda e: streams.windowed_stats(e, "ts", "value", ["event_type"])), ("spectra", lambda e: streams.windowed_spectra(e, "ts", "value", ["event_type"])), ("sessions", lambda e: streams.sessions(e, "ts", ["user_id"]))):
        live = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/", pathGlobFilter="events.parquet")
        run = f(live).writeStream.format("memory").queryName(name).outputMode("complete" if name != "sessions" else "complete").trigger(availableNow=True).start()
        run.awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, f(events).collect()))


def test_archives_and_sounds_of_any_size(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((7, 3, 5)).astype(np.float32)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "a.npz", embeddings=x, genres=np.array(list("abcabca")), file_paths=np.array([f"f{i}" for i in range(7)]))
        got = readers.read_large_npz(spark, str(tmp_path / "a.npz"), rows=2).orderBy("sample_id", "feature_idx").collect()
        assert np.allclose([r.series for r in got], x.reshape(21, 5)) and [r.label for r in got[::3]] == list("abcabca")
    assert {r.source_path for r in readers.read_npz(spark, str(tmp_path / "a.npz")).collect()} == {f"f{i}" for i in range(7)}
    np.savez(tmp_path / "c.npz", dct_coeffs=x, genres=np.array(list("abcabca")))
    assert readers.read_npz(spark, str(tmp_path / "c.npz"), data_key="dct_coeffs").count() == 21
    with pytest.raises(Exception, match="are not 2 x 2"):
        readers.read_npz(spark, str(tmp_path / "a.npz"), config=readers.EmbeddingConfig("s", "p", 2, 2, 5)).collect()
    for width in (1, 2, 3, 4):
        sink = io.BytesIO()
        with wave.open(sink, "wb") as f:
            f.setnchannels(2), f.setsampwidth(width), f.setframerate(8000)
            whole = [int(v * 2 ** (8 * width - 1)) for v in (0.5, 0.0, -0.5, -1.0)]
            f.writeframes(b"".join((v + 128).to_bytes(1, "little") if width == 1 else v.to_bytes(width, "little", signed=True) for v in whole))
        assert readers.decode_wav(sink.getvalue()).tolist() == [0.25, -0.75]


def test_chord_folder_and_curves(spark, tmp_path):
    (tmp_path / "segments.csv").write_text("track_id,chord_label\nb,N\n")
    np.save(tmp_path / "embeddings.npy", np.array([[1.0, 2.0]]))
    assert readers.read_chord_folder(spark, str(tmp_path)).first().track_id == "b"
    (tmp_path / "segments_aligned.csv").write_text("track_id,chord_label\na,C:maj\n")
    assert readers.read_chord_folder(spark, str(tmp_path)).first().track_id == "a"
    with pytest.raises(ValueError, match="several files"):
        readers.read_chords(spark, str(tmp_path / "*.csv"), str(tmp_path / "embeddings.npy"))
    curve = spark.createDataFrame([(1, 0.5), (0, 1.0)], "lag int, rho double")
    assert np.load(io.BytesIO(writers.curve_file(curve, "lag", "rho"))).tolist() == [1.0, 0.5]
    spectra = spark.createDataFrame([(2, 1, 1.0, 0.3), (2, 0, 0.0, 0.1), (1, 0, 0.0, 0.2)], "factor int, k int, frequency double, mean double")
    found = np.load(io.BytesIO(writers.spectra_archive(spectra)))
    assert found["factor_2"].tolist() == [0.1, 0.3] and found["freq_1"].tolist() == [0.0]
    assert writers.write_files(spark.createDataFrame([("x/y.bin", b"ab")], "name string, content binary"), str(tmp_path)) == 1 and (tmp_path / "x/y.bin").read_bytes() == b"ab"
    with pytest.raises(ValueError, match="mounted"):
        writers.write_files(spark.createDataFrame([("y", b"")], "name string, content binary"), "hdfs://host/x")


def test_lineitem_series_hold_every_row(spark):
    from bandlake.plans.series_queries import supplied

    sf = "/root/testdata/sf0.001"
    total = spark.read.parquet(f"{sf}/lineitem.parquet").agg(F.sum("l_quantity").cast("double"), F.countDistinct("l_suppkey")).first()
    got = supplied(spark, sf).agg(F.sum(F.aggregate("series", F.lit(0.0), lambda a, x: a + x)), F.count("*"), F.min(F.size("series")), F.max(F.size("series"))).first()
    assert abs(got[0] - total[0]) < 1e-6 and got[1] == total[1] and got[2] == got[3] == 32


def test_inference_corpora(spark, tmp_path):
    from bandlake.operators import corpus

    rows = [("en", "validation", "a", "b", 0), ("zh", "train", "c", "d", 2), ("sw", "train", "e", "f", 1)]
    shape = "lang string, split string, premise string, hypothesis string, label int"
    got = corpus.convert_inference_layout(spark.createDataFrame(rows, shape)).collect()
    assert {tuple(r) for r in got} == {("en", "dev", "a", "b", "entailment"), ("zh", "train", "c", "d", "contradiction")}
    for bad in (("en", "train", None, "x", 0), ("en", "other", "x", "y", 0), ("en", "train", "x", "y", 9)):
        with pytest.raises(ValueError, match="without a value"):
            corpus.convert_inference_layout(spark.createDataFrame([*rows, bad], shape))
    (tmp_path / "train_w_filtering.tsv").write_text("entailment\ta \"b\tc\nneutral\td\te\n")
    (tmp_path / "dev.tsv").write_text("neutral\tx\ty\n")
    found = readers.read_inference_folder(spark, str(tmp_path))
    assert {(r.split, r.label, r.premise) for r in found.collect()} == {("train", "entailment", 'a "b'), ("train", "neutral", "d"), ("dev", "neutral", "x")}
    (tmp_path / "dev.tsv").write_text("neutral\tx\n")
    with pytest.raises(ValueError, match="1 lines"):
        readers.read_inference_folder(spark, str(tmp_path))


def test_files_that_the_driver_does_not_see_are_an_error(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(f"d/{i}", b"x") for i in range(5)], "name string, content binary")
    assert writers.write_files(df, str(tmp_path / "a")) == 5
    monkeypatch.setattr(writers.os, "walk", lambda root: iter([(root, [], ["0"])]))
    with pytest.raises(OSError, match="mount it"):
        writers.write_files(df, str(tmp_path / "b"))
