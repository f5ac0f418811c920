import corpus_pipeline
import regex
from bandlake.llm import toxicity
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_ngram_join import brute as brute_groups

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(documents, labels).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in documents.collect() if r.doc_id not in toxic]
    # edit_within has its own tests; the plain distance is too slow for whole lines
    import tests.llm.test_line_dedup as lines

    monkeypatch.setattr(lines, "distance", lambda a, b: 0 if lines.edit_within(a, b, 2) else 9)
    rows = [(i, t) for i, n, gone, t in brute_lines(rows) if n == 0 or gone < n]
    rows = [(i, t) for i, t in rows if i in {d for d, _, c in brute_groups(rows) if d == c}]
    words = lambda t: regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower())
    leaks = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(max(1, len(w) - 12))}
    held = lambda w: any(tuple(w[i : i + 13]) in leaks for i in range(len(w)))
    want = {i: t for i, t in rows if not held(words(t))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    places = [r.mix_position for r in got if r.in_mix]
    assert sorted(places) == list(range(len(places))) and places and all(r.n_chars == len(r.text) for r in got)


def test_stages_keep_columns_and_bear_edges(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "some text here", "en", "a", 14), (1, "some text here", "en", "a", 14), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "other text", "en", "b", 10), (4, "w " * 30000, "en", "b", 60000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, columns)
        docs.write.mode("overwrite").parquet(str(tmp_path / "in"))
        docs = spark.read.parquet(str(tmp_path / "in"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns[:5] == docs.columns and (k == 4 or out.columns == docs.columns)
            out.write.mode("overwrite").parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert docs.count() == (5 if data else 0)


def test_null_and_repeated_ids_lose_nothing(spark, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    clean = ["a quiet river runs along the old mill and the children play there all day", "nobody knew why the red lamp was burning in the tower that cold night", "seven boats came back from the sea with more fish than ever seen before"]
    rows = [(None, clean[0], "en", "a", 1), (None, f"so {item} then", "en", "a", 1), (7, clean[1], "en", "a", 1), (7, item, "en", "a", 1), (7, clean[2], "en", "a", 1), (None, clean[2], "en", "a", 1), (9, clean[2], "en", "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    leaks = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in leaks) == sorted((str(i), t) for i, t, *_ in rows if item not in t)
    copies = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    gone = [(9, clean[2]), (None, clean[2]), (None, f"so {item} then")]  # copies of rows with a smaller id, or with one
    assert sorted((str(r.doc_id), r.text) for r in copies) == sorted((str(i), t) for i, t, *_ in rows if (i, t) not in gone)
