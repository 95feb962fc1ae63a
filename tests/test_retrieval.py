import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attestry.functions import plugins as pl
from attestry.operators import evaluation as ev
from attestry.operators import ingest as ig
from attestry.operators import reports as rp
from attestry.operators import retrieval as rt
from attestry.operators import vectors as vc
from attestry.operators.matching import contains_join
from attestry.streaming import streams as ss


def test_contains_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("ab c"), n))
    needles = [(i, word(int(rng.integers(1, 6)))) for i in range(40)]
    texts = [(i, word(int(rng.integers(0, 30)))) for i in range(60)]
    found = contains_join(
        spark.createDataFrame(needles, "nid int, needle string"), spark.createDataFrame(texts, "tid int, hay string"),
        needle="needle", hay="hay", needle_key="nid", hay_keys=["tid"],
    )
    assert sorted((r.nid, r.tid) for r in found.collect()) == sorted((n, t) for n, a in needles for t, b in texts if a in b)


def test_fulltext_needs_every_term(spark):
    sets = spark.createDataFrame(
        [("c1", "d1", "k1", 0, ["a", "b"]), ("c2", "d1", "k1", 1, ["a"]), ("c3", "d2", "k2", 0, ["a", "b", "c"])],
        "chunk_id string, doc_uid string, knowledge_base_id string, chunk_index int, terms array<string>",
    )
    q = spark.createDataFrame([("q1", 1, "A b", None), ("q2", 1, "a", "k1"), ("q3", 1, "a z", None)], "query_id string, variant_no int, text string, knowledge_base_id string")
    got = sorted((r.query_id, r.chunk_id) for r in rt.fulltext_match(q, sets).collect())
    assert got == [("q1", "c1"), ("q1", "c3"), ("q2", "c1"), ("q2", "c2")]


def vectors(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 4))
    points[n // 2 :] = points[0]  # half are copies
    return points, spark.createDataFrame([(f"c{i:03d}", "d", [float(x) for x in p]) for i, p in enumerate(points)], "chunk_id string, doc_uid string, embedding array<double>")


def test_vector_search_and_cells_equal_brute_force(spark):
    points, table = vectors(spark)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]]) for i in (0, 5, 17)], "query_id int, embedding array<double>")
    want = []
    for i in (0, 5, 17):
        d = np.round(((points - points[i]) ** 2).sum(axis=1), 6)
        want += [(i, r + 1, f"c{j:03d}") for r, j in enumerate(sorted(range(len(points)), key=lambda j: (d[j], j))[:7])]
    for search in (vc.vector_search, vc.vector_search_cells):
        got = sorted((r.query_id, r["rank"], r.chunk_id) for r in search(queries, table, 7).collect())
        assert got == sorted(want), search.__name__


def test_approximate_search_finds_copies(spark):
    points, table = vectors(spark)
    queries = spark.createDataFrame([(0, [float(x) for x in points[0]])], "query_id int, embedding array<double>")
    got = [r.chunk_id for r in vc.vector_search_approx(queries, table, 5).orderBy("rank").collect()]
    assert got == ["c000", "c060", "c061", "c062", "c063"]


def test_hash_vector_of_blank_text_is_zero(spark):
    row = spark.createDataFrame([(" ",)], "t string").select(vc.hash_vector(F.col("t")).alias("v")).first()
    assert row.v == [0.0] * 64


def test_hybrid_keeps_fulltext_order_and_marks_shared_hits(spark):
    schema = "query_id string, rank int, chunk_id string, doc_uid string, score double"
    f = spark.createDataFrame([("q", 1, "a", "d", None), ("q", 2, "b", "d", None)], schema)
    v = spark.createDataFrame([("q", 1, "b", "d", -0.5), ("q", 2, "c", "d", 0.2)], schema)
    rows = rt.hybrid_search(f, v, 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.retrieval_source, r.score) for r in rows] == [("a", "fulltext", None), ("b", "hybrid", 0.0), ("c", "vector", 0.2)]


def test_sample_rows_keeps_first_and_last(spark):
    df = spark.range(11).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("i"))
    assert sorted(r.i for r in rp.sample_rows(df, "g", "i", 5).collect()) == [0, 2, 5, 8, 10]


def test_thresholds_are_checked():
    assert rp.quality_thresholds({"max_chunk_chars": "900.0", "sample_limit": ""}).max_chunk_chars == 900
    for bad in ({"sample_limit": 0}, {"max_chunk_chars": "x"}, {"max_chunk_chars": 60, "short_chunk_chars": 60}):
        try:
            rp.quality_thresholds(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_last_row_of_a_case_counts(spark):
    cases = spark.createDataFrame([("1", "verified"), ("2", "rejected")], "case_id string, expected_verdict string")
    actual = spark.createDataFrame([("1", 1, "rejected", 1), ("1", 2, "verified", 0)], "case_id string, seq int, verdict string, evidence_count int")
    rows = {r.case_id: r for r in ev.eval_claim_results(cases, actual).collect()}
    assert rows["1"].verdict_matched and rows["1"].no_evidence_verified and not rows["2"].verdict_matched


def test_change_detection(spark):
    schema = "source_path string, source_hash string, knowledge_base_id string"
    a = spark.createDataFrame([("p1", "h", "k"), ("p2", "h", "k"), ("p3", "h2", "k"), ("p4", "h", "k")], schema)
    b = spark.createDataFrame([("p1", "h", "k"), ("p2", "h", "other"), ("p3", "h", "k"), ("p5", "h", "k")], schema)
    got = {r.source_path: r.change for r in ig.detect_changes(a, b).collect()}
    assert got == {"p1": "skipped", "p2": "moved", "p3": "changed", "p4": "new", "p5": "missing"}


def test_failing_batches_are_halved(spark):
    def embed(texts):
        if len(texts) > 1:
            raise RuntimeError("too many")
        return [[float(len(texts[0]))]]

    df = spark.createDataFrame([(str(i), "x" * i) for i in range(5)], "chunk_id string, content string")
    assert {r.chunk_id: r.embedding for r in pl.embed_with(df, embed).collect()} == {str(i): [float(i)] for i in range(5)}


def test_late_older_review_does_not_win(spark):
    df = spark.createDataFrame([(1, 2, "approved", "2024-01-02"), (1, 1, "rejected", "2024-01-01")], "claim_id int, review_id int, review_action string, d string")
    rows = ss.review_status(df.withColumn("created_at", F.to_timestamp("d"))).collect()
    assert [(r.claim_id, r.review_status) for r in rows] == [(1, "approved")]


def test_stream_ingest_follows_versions(spark, tmp_path):
    landing, folder = tmp_path / "in" / "kb", str(tmp_path / "out")
    landing.mkdir(parents=True)
    run = lambda: ss.stream_ingest(ss.landing_files(spark, str(tmp_path / "in")), folder, str(tmp_path / "cp")).awaitTermination()
    (landing / "a.md").write_text("# A\nfirst")
    (landing / "b.md").write_text("# B\nsame")
    run()
    (landing / "a@2.md").write_text("# A\nsecond")
    run()
    (landing / "a@3.md").write_text("# A\nfirst")
    run()
    version = ss.latest_version(spark, folder)
    texts = sorted(r.content for r in spark.read.parquet(f"{folder}/chunks/version={version}").collect())
    assert texts == ["first", "same"] and version == 2


def test_ingest_batches_count_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame([(*x, 1) for x in r], "path string, value string, at long").select("path", "value", F.timestamp_seconds("at").alias("modified"))
    ss.ingest_batch(rows(("kb/a.md", "# A\none")), folder, 0, "s1")
    ss.ingest_batch(rows(("kb/a.md", "# A\nother")), folder, 0, "s1")  # the same batch again
    ss.ingest_batch(rows(("kb/b.md", "# B\ntwo")), folder, 0, "s2")  # a new stream over the same store
    version = ss.latest_version(spark, folder)
    assert version == 1
    assert sorted(r.content for r in spark.read.parquet(f"{folder}/chunks/version={version}").collect()) == ["one", "two"]


def test_a_failed_read_is_no_empty_store(spark, tmp_path):
    import pytest

    folder = tmp_path / "out"
    (folder / "versions").mkdir(parents=True)
    (folder / "versions" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception):
        ss.latest_version(spark, str(folder))
    assert ss.latest_version(spark, str(tmp_path / "none")) == -1


def test_a_result_written_again_replaces_itself(spark, tmp_path):
    from attestry.sources import files as sf

    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "check_id string")
    for claims in (frame("a", "b"), frame("a", "b", "c")):
        sf.write_check_result(frame("a"), claims, frame("a"), str(tmp_path), "run/1")
    sf.write_check_result(frame("a"), frame("z"), frame("a"), str(tmp_path), "run-2")
    got = sorted((r.run_id, r.check_id) for r in sf.read_check_result(spark, str(tmp_path), "claims").collect())
    assert got == [("run-2", "z"), ("run/1", "a"), ("run/1", "b"), ("run/1", "c")]


def test_dictionaries_of_several_files_are_merged(spark, tmp_path):
    from attestry.sources import files as sf

    (tmp_path / "a.json").write_text('{"variants": {"x": "y"}, "entities": [{"canonical": "c", "aliases": ["d"]}]}')
    (tmp_path / "b.json").write_text('{"variants": {"p": "q"}}')
    found = sf.load_term_dictionary(spark, f"{tmp_path}/*.json")
    assert dict(found.variants) == {"x": "y", "p": "q"} and found.entities == (("c", ("d",)),)
    assert sf.load_term_dictionary(spark, f"{tmp_path}/none.json").variants == ()


def test_approximate_search_fills_filtered_queries_and_finds_most(spark):
    points, table = vectors(spark)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]]) for i in range(40)], "query_id int, embedding array<double>")
    exact = {(r.query_id, r.chunk_id) for r in vc.vector_search(queries, table, 6).collect()}
    near = {(r.query_id, r.chunk_id) for r in vc.vector_search_approx(queries, table, 6).collect()}
    assert len(near) == len(exact) and len(near & exact) >= 0.9 * len(exact)


# ------------------------------------------------------------------ n-gram index
def test_stored_grams_equal_brute_force(spark, tmp_path):
    from attestry.operators.grams import build_grams, find_needles

    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abä c😀"), n))
    texts = [(f"t{i}", word(int(rng.integers(0, 40)))) for i in range(150)] + [("null", None), ("empty", ""), ("same", "abab abab"), ("again", "abab abab"), ("long", word(5000))]
    needles = sorted({word(int(rng.integers(1, 7))) for _ in range(80)} | {"abab", "zzz", "c", "😀", "ä😀"})
    want = sorted((n, t) for n in needles for t, h in texts if n in (h or ""))
    frame = spark.createDataFrame(texts, "tid string, hay_in string").repartition(3)
    asked = spark.createDataFrame([(n,) for n in [*needles, ""]] + [(None,)], "needle string")
    for folder in (None, str(tmp_path / "grams")):
        index = build_grams(frame, F.col("hay_in"), folder, "hay_in")
        assert sorted((r.needle, r.tid) for r in find_needles(asked, index, ["tid"]).collect()) == want
    none = build_grams(frame.limit(0), F.col("hay_in"), None, "hay_in")
    assert find_needles(asked, none, ["tid"]).count() == 0 and find_needles(asked.limit(0), index, ["tid"]).count() == 0


def test_grams_are_read_by_ranges(spark, tmp_path):
    from attestry.operators.grams import build_grams, in_ranges, wanted_grams

    frame = spark.range(2000).select(F.col("id").cast("string").alias("tid"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    index = build_grams(frame, F.col("text"), str(tmp_path / "grams"), "text")
    some = wanted_grams(spark.createDataFrame([("abc1",)], "needle string"))
    read = in_ranges(index.grams, some)
    assert "GreaterThanOrEqual(gram" in read._jdf.queryExecution().executedPlan().toString()
    assert 0 < read.select("gram").distinct().count() < 0.2 * index.grams.select("gram").distinct().count()


# ------------------------------------------------------------------ vectors by cell and by block
def test_cells_are_pruned_and_exact_when_all_are_open(spark, monkeypatch):
    points, table = vectors(spark)
    index = vc.build_cells(table.withColumn("knowledge_base_id", F.when(F.col("chunk_id") < "c060", "k1").otherwise("k2")), cells=8)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]], None if i % 3 else "k1") for i in range(0, 120, 7)], "query_id int, embedding array<double>, knowledge_base_id string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    exact = rows(vc.vector_search(queries, index.vectors, 4))
    assert len(exact) == 4 * queries.count()
    for part in (50_000, 9):  # small parts: every block of vectors meets every block of queries
        monkeypatch.setattr(vc, "PART_ROWS", part)
        assert rows(vc.vector_search_approx(queries, index, 4, share=1.0)) == exact
        assert len(rows(vc.vector_search_approx(queries, index, 4, share=0.2))) == len(exact)
    one = queries.where("query_id = 7").drop("knowledge_base_id")
    plan = vc._by_cell(one, index, 4, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    points, table = vectors(spark)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]]) for i in range(0, 120, 3)], "query_id int, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    whole = rows(vc.vector_search(queries, table, 5))
    monkeypatch.setattr(vc, "QUERY_BYTES", 500)
    folder, blocks = vc.store_query_blocks(queries)
    assert blocks > 5
    assert rows(vc.vector_search(queries, table, 5)) == whole
    assert vc.vector_search(queries.limit(0), table, 5).count() == 0


def test_tasks_hold_bounded_vectors_and_send_bounded_batches(spark, monkeypatch):
    points, table = vectors(spark)
    queries = spark.createDataFrame([(i, [float(x) for x in points[i]]) for i in range(0, 120, 3)], "query_id int, embedding array<double>")
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())
    whole = rows(vc.vector_search(queries, table, 5))
    monkeypatch.setattr(vc, "QUERY_BYTES", 500)
    monkeypatch.setattr(vc, "HELD_BYTES", 300)
    monkeypatch.setattr(vc, "STEP_ROWS", 16)
    assert rows(vc.vector_search(queries, table, 5)) == whole
    index = vc.build_cells(table, cells=8)
    assert rows(vc.vector_search_approx(queries, index, 5, share=1.0)) == whole
    batch = pa.RecordBatch.from_pydict({"query_id": list(range(40)), "embedding": [[float(x) for x in points[i]] for i in range(40)]})
    sent = [len(b) for b in vc._opening(index.centroids, index.sizes, 1.0, 16)(iter([batch]))]
    assert sum(sent) == 40 * int((index.sizes > 0).sum()) and max(sent) <= 16


# ------------------------------------------------------------------ streams
def test_state_leaves_by_changed_keys_and_survives_a_new_checkpoint(spark, tmp_path):
    folder, landing = str(tmp_path / "state"), tmp_path / "in"
    schema = "claim_id long, review_id long, review_action string, created_at timestamp"
    event = lambda c, r, a, t: (c, r, a, t)

    def land(name, rows):
        frame = spark.createDataFrame(rows, "claim_id long, review_id long, review_action string, s long").withColumn("created_at", F.timestamp_seconds("s")).drop("s")
        frame.coalesce(1).write.parquet(str(landing / name))

    def run(checkpoint):
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(landing))
        ss.stream_to_folder(ss.review_status(source), folder, checkpoint, ["claim_id"]).awaitTermination()
        return {r.claim_id: r.review_status for r in ss.read_state(spark, folder, ["claim_id"], ["last"]).collect()}

    land("a", [event(k, k, "approved", 100) for k in range(30)])
    assert run(str(tmp_path / "one")) == {k: "approved" for k in range(30)}
    land("b", [event(3, 50, "rejected", 200), event(4, 51, "rejected", 50)])
    assert run(str(tmp_path / "one"))[3] == "rejected"
    folders = ss._state_folders(spark, folder)
    assert [spark.read.parquet(f[3]).count() for f in folders] == [30, 2]  # only the changed keys leave the second batch
    state = run(str(tmp_path / "two"))  # a stream that starts anew over the same table
    assert (state[3], state[4]) == ("rejected", "approved") and len(state) == 30
    ss.compact_state(spark, folder, ["claim_id"], ["last"])
    assert {r.claim_id: r.review_status for r in ss.read_state(spark, folder, ["claim_id"], ["last"]).collect()} == state
    assert run(str(tmp_path / "two")) == state


def test_runs_are_rewritten_at_once(spark, tmp_path):
    from attestry.sources import files as sf

    table = lambda n: spark.createDataFrame([(f"c{n}", n)], "check_id string, n int")
    sf.write_check_result(table(1), table(1), table(1), str(tmp_path), "r/1")
    sf.write_check_result(table(2), table(2), table(2), str(tmp_path), "r/2")
    table(9).withColumns({"run_id": F.lit("r/1"), "attempt": F.lit("half")}).write.parquet(f"{tmp_path}/claims/r%2F1/half")  # a rewrite that failed
    assert sorted(r.n for r in sf.read_check_result(spark, str(tmp_path), "claims").collect()) == [1, 2]
    sf.write_check_result(table(5), table(5), table(5), str(tmp_path), "r/1")
    assert sorted(r.n for r in sf.read_check_result(spark, str(tmp_path), "claims").collect()) == [2, 5]


# ------------------------------------------------------------------ stored corpus
def test_corpus_stores_what_is_read_and_indexes_without_a_shuffle(spark, tmp_path):
    from attestry.operators import grams
    from attestry.plans.corpus import derive, store

    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abc"), 2))
    rows = [(f"d{i}", f"k{i % 3}", f"t{i}", None, "# h\n" + "\n".join(" ".join(word() for _ in range(30)) for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_uid string, knowledge_base_id string, doc_title string, updated_at timestamp, content string").repartition(3)
    corpus = store(derive(docs), str(tmp_path / "corpus"))
    stored = lambda: sorted(p.name for p in (tmp_path / "corpus").iterdir())
    assert corpus.chunks.count() and "serial" not in corpus.chunks.columns and stored() == ["chunks"]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(rt.block_postings(corpus.word_sets)) and "Exchange" not in plan(corpus.chunk_grams.grams)
    q = spark.createDataFrame(
        [(f"q{i}", 1, f"{word()} {word()} {word()}", None if i % 2 else f"k{i % 3}", "d7" if i % 5 == 0 else None) for i in range(40)],
        "query_id string, variant_no int, text string, knowledge_base_id string, doc_uid string",
    )
    got, want = (
        sorted(map(tuple, f.collect()))
        for f in (rt.fulltext_match(q, corpus.word_sets, postings=corpus.postings, frequencies=corpus.frequencies), rt.fulltext_match(q, corpus.word_sets))
    )
    assert got == want and got
    assert sorted(map(tuple, corpus.frequencies.collect())) == sorted(map(tuple, rt.term_frequencies(rt.postings_of(corpus.word_sets)).collect()))
    needle = spark.createDataFrame([("ab ca",), ("b",)], "needle string")
    found = sorted((r.needle, r.chunk_id) for r in grams.find_needles(needle, corpus.chunk_grams, ["chunk_id"]).collect())
    assert found == sorted((n, c.chunk_id) for n in ("ab ca", "b") for c in corpus.chunks.collect() if n in c.content)
    assert not {"docs", "sections", "vectors", "section_grams"} & set(stored())


def test_written_texts_are_cut_by_size_and_complete(spark, tmp_path):
    from attestry.sources import files as sf

    rows = [(f"k{i % 10 // 9}", f"d{i}", f"line {i}" + "x" * 50) for i in range(400)]
    docs = spark.createDataFrame(rows, "knowledge_base_id string, doc_uid string, content string")
    sf.write_texts(docs, str(tmp_path / "one"))
    sf.write_texts(docs, str(tmp_path / "cut"), most=2_000)
    sizes = {name: sf.scan_documents(spark, str(tmp_path / name), "txt").collect() for name in ("one", "cut")}
    assert sorted(r.knowledge_base_id for r in sizes["one"]) == ["knowledge_base_id=k0", "knowledge_base_id=k1"]
    assert len(sizes["cut"]) > 8 and max(r.size_bytes for r in sizes["cut"]) < 6_000
    for name in sizes:
        assert sorted(r.value for r in spark.read.text(str(tmp_path / name)).select("value").collect()) == sorted(r[2] for r in rows)


def test_shelf_search_equals_the_search_by_indexes(spark, tmp_path, monkeypatch):
    """Queries that name a knowledge base find what the indexes find, without any index, in runs and pieces of any size."""
    from attestry.operators import shelves
    from attestry.plans import search
    from attestry.plans.corpus import derive, store

    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "Kappa"]
    sentence = lambda n: " ".join(rng.choices(words, [2 ** -k for k in range(10)], k=n))
    docs = [(f"d{k}", f"kb{k % 3}", f"Title {k}", None if k % 7 == 0 else k % 5, f"# Head {k}\n{sentence(12)}. {sentence(90)}\n# Tail\n{sentence(8)}") for k in range(24)]
    docs = spark.createDataFrame(docs, "doc_uid string, knowledge_base_id string, doc_title string, u int, content string").withColumn("updated_at", F.timestamp_seconds("u"))
    corpus = store(derive(docs), str(tmp_path / "stored"))
    held = [r["content"] for r in corpus.chunks.select("content").collect()]
    texts = [sentence(2), "Alpha", "a", "ta", "ppa", "...", "nowhere", "beta iota kappa", held[0][3:99], held[1][5:75], held[2], held[3][4:36], "eta th", "lph", *[sentence(n) for n in (1, 3, 5, 9, 40)]]
    asked = [(f"q{n:02d}-{b}", b, t, 3, 4, 3, False) for n, t in enumerate(texts) for b in ("kb0", "kb1", "none")]
    asked += [(f"r{n}", "kb2", t, 1 + n % 4, 1 + n % 3, 1 + n % 5, False) for n, t in enumerate(texts)]
    asked = spark.createDataFrame(asked, "query_id string, knowledge_base_id string, text string, k int, fulltext_k int, vector_k int, use_rerank boolean")
    found = {(r["query_id"], r["rank"]): r.asDict() for r in shelves.search_shelves(asked, corpus.shelves).collect()}
    assert {f.name for f in (tmp_path / "stored").iterdir()} == {"chunks", "shelves"}
    for name, value in (("RUN_ROWS", 3), ("PIECE_ROWS", 5), ("CANDIDATES", 2), ("HELD_ROWS", 4)):
        monkeypatch.setattr(shelves, name, value)
    rows = shelves.prepared(asked).toArrow()
    kinds = pa.schema([("query_id", pa.string()), ("rank", pa.int32()), ("chunk_id", pa.string()), ("doc_uid", pa.string()), ("retrieval_source", pa.string()), ("score", pa.float64())])
    small = [r for run in shelves._runs(iter(rows.to_batches())) for r in shelves._answers(run, corpus.shelves, True, ["query_id"], kinds).to_pylist()]
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"] or 0) for r in small) == sorted((q, n, r["chunk_id"], r["score"] or 0) for (q, n), r in found.items())
    near = search.search_vector(asked, corpus, 5).join(asked.select("query_id", "vector_k"), "query_id").where("rank <= vector_k").drop("vector_k")
    whole = rt.merged_hits(search.search_fulltext(asked, corpus, None), near).join(asked.select("query_id", "k"), "query_id").where("rank <= k")
    expected = {(r["query_id"], r["rank"]): r.asDict() for r in whole.drop("k").collect()}
    assert found.keys() == expected.keys() and len(found) > 100
    for key, row in expected.items():
        for c in ("chunk_id", "doc_uid", "score", "retrieval_source", "matched_sources", "rerank_score"):
            assert found[key][c] == row[c], (key, c)
    # The plan of the checks takes this way too, and adds queries that name no knowledge base by the indexes.
    free = asked.where("query_id = 'r0'").withColumns({"query_id": F.lit("free"), "knowledge_base_id": F.lit(None).cast("string")})
    both = search.search_by_limits(asked.unionByName(free), corpus, keep=["text"]).collect()
    assert {(r["query_id"], r["rank"]) for r in both if r["query_id"] != "free"} == expected.keys()
    assert any(r["query_id"] == "free" for r in both)
