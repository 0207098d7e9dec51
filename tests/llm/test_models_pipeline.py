"""Held-out accuracy of the two classifiers, edge cases, and the pipeline stage by stage."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clientele.llm.decontaminate import find_contamination, is_contaminated
from clientele.llm.queries import QUERIES
from clientele.llm.quality import STATISTICS, document_statistics, fit_discriminant, scored_quality, statistics_table, train_quality
from clientele.llm.secret_scan import base_spans
from clientele.llm.shared import stored
from clientele.llm.simhash import fingerprint, near_copies
from clientele.llm.toxicity import FtrlSettings, ftrl_weights, scored_toxicity, train_toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, modulus, rest, most", [("op2_quality", "quality", 3, 1, 0.03), ("op10_toxicity", "toxic", 4, 2, 0.08)])
def test_held_out_accuracy(spark, name, label, modulus, rest, most):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    out = QUERIES[name](spark, FOLDER).collect()
    assert len(out) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] != labels[r["doc_id"]] for r in held]) <= most


def test_statistics_are_finite_for_odd_texts():
    for text in ("", " ", "\n\n", "a", "é" * 5000, "|" * 100, "A!! " * 3000, "x" * 200_000, "0", "\x00"):
        values = document_statistics(text)
        assert len(values) == len(STATISTICS) and np.isfinite(values).all()


def test_discriminant_equals_the_plain_formula():
    rng = np.random.default_rng(0)
    width = len(STATISTICS)
    groups = {0: rng.normal(0, 2, (300, width)), 1: rng.normal(1, 1, (500, width))}
    model = fit_discriminant({c: (float(len(x)), x.sum(axis=0), x.T @ x) for c, x in groups.items()}, pooled=0.0, diagonal=0.0)
    point = rng.normal(0, 1, (5, width))
    z = (point - model.center) / model.spread
    logs = []
    for c in (0, 1):
        own = (groups[c] - model.center) / model.spread
        cov = np.cov(own.T, bias=True) + 1e-3 * np.eye(width)
        gap = z - own.mean(axis=0)
        logs.append(np.log(len(own) / 800) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(-(logs[1] - logs[0]) / model.temperature)))


def test_models_without_labels_are_constant(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = stored(statistics_table(docs, "doc_id", "text"))
    assert {r["score"] for r in scored_quality(table, train_quality(table, none, F.lit(True))).collect()} == {0.5}
    model = train_toxicity(docs, none, F.lit(True))
    assert all(r["score"] < 0.01 for r in scored_toxicity(docs, model).collect())
    bad = none.unionByName(spark.createDataFrame([(1, 0, 1), (2, None, None)], none.schema))
    assert all(r["score"] > 0.99 for r in scored_toxicity(docs, train_toxicity(docs, bad, F.lit(True))).collect())


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(3)
    documents, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        words = rng.integers(10, 5000, 80).astype(np.uint64)
        documents.append(np.unique(np.append(words, np.uint64(1)) if toxic else words))
        labels.append(float(toxic))
    names, weights, bias = ftrl_weights(documents, np.array(labels), FtrlSettings())
    assert names[np.argmax(weights)] == 1 and len(names) < 1500 and bias < 0


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("mark", F.lit("extra"))
    odd = [(None, None, None, None, None, "x"), (5000, "", "en", "src0", 0, "x"), (5001, "AKIA" + "Z9" * 9 + " words that stand alone here today", "en", "src1", 1, "x")]
    return stored(docs.unionByName(spark.createDataFrame(odd, docs.schema)))


def test_stages_keep_columns_and_do_their_work(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near copies", "benchmark decontamination", "secret scan", "best-fit packing"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = stored(corpus_pipeline.quality_stage(spark, corpus, FOLDER))
    assert good.columns == corpus.columns
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) > 0.97

    one = stored(corpus_pipeline.near_copy_stage(spark, good, FOLDER))
    groups = {}
    for r in near_copies(good).collect():
        groups.setdefault(r["mark"], set()).add(r["doc_id"])
    stay = [r["doc_id"] for r in one.collect()]
    assert one.columns == corpus.columns and len(stay) == len(set(stay)) <= len(groups)
    assert all(len(g & set(stay)) <= 1 for g in groups.values())
    assert corpus_pipeline.near_copy_stage(spark, one, FOLDER).count() == len(stay)

    clean = stored(corpus_pipeline.benchmark_stage(spark, one, FOLDER))
    found = find_contamination(one, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in found.filter(is_contaminated()).collect()}
    assert {r["doc_id"] for r in clean.collect()} == set(stay) - dirty and clean.columns == corpus.columns

    bare = stored(corpus_pipeline.secret_stage(spark, clean, FOLDER))
    assert bare.columns == clean.columns and bare.count() == clean.count()
    assert not any(base_spans(r["text"] or "") for r in bare.collect())
    before = {r["doc_id"]: r for r in clean.collect()}
    assert all(r["text"] == before[r["doc_id"]]["text"] or "[SECRET]" in r["text"] for r in bare.collect())

    packed = corpus_pipeline.packing_stage(spark, bare, FOLDER)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in bare.collect()}


def test_near_copies_of_dropped_members_go(spark):
    rng = np.random.default_rng(7)
    prose = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    for _ in range(200):  # the first two texts have one fingerprint, the third is similar to the second only
        base = prose(600)
        near = base[:-12] + prose(12)
        if (np.uint64(fingerprint(" ".join(base))) ^ np.uint64(fingerprint(" ".join(near)))).bit_count() <= 2:
            break
    far, other = near + prose(147), prose(300)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, near, far)]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert alike(sets[1], sets[2]) >= 0.8 > alike(sets[0], sets[2])
    rows = [(1, base), (2, near), (3, far), (1, far[::-1]), (4, far[::-1] + ["more"]), (5, other), (5, other)]
    docs = spark.createDataFrame([(i, " ".join(t), "en") for i, t in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_copy_stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted((i, " ".join(t), "en") for i, t in [rows[0], rows[3], rows[5]])


def test_run_over_whole_and_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 500
    for name in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        (frame.limit(0) if name == "documents" else frame).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_that_are_surely_clean_are_not_exchanged(spark, tmp_path):
    rng = np.random.default_rng(3)
    prose = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    passage = prose(20)
    spark.createDataFrame([("b1", " ".join(passage))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, " ".join(prose(40)), "x") for i in range(60)] + [(60, " ".join(passage), "x"), (61, " ".join(passage), "y"), (62, None, "x"), (62, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the contaminated texts are many
    try:
        clean = corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path))
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == [*range(60), 62, 62]
        plan = clean._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan and plan.count("Join LeftAnti") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prefix_rows_move_only_for_shingles_of_two_sets(spark):
    import pyarrow as pa

    from clientele.llm import near_text as N
    from clientele.llm.decontaminate import token_filter

    class Bits:
        value = token_filter(spark.createDataFrame([(7,), (7 + (5 << 33),)], "token long"))

    # All of these agree in their last 25 bits.
    heads = [[7, 7 + (1 << 33)], [7, 7 + (3 << 33)], [7 + (5 << 33)], [], [7 + (5 << 33), 7 + (7 << 33)]]
    batch = pa.RecordBatch.from_arrays([pa.array(heads, pa.list_(pa.int64())), pa.array(range(5), pa.int64())], ["tokens", "name"])
    moved = next(N._passing_rows(iter([batch]), Bits)).to_pylist()
    assert [(r["token"], r["name"]) for r in moved] == [(7, 0), (7, 1), (7 + (5 << 33), 2), (7 + (5 << 33), 4)]
