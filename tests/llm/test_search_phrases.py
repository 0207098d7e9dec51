"""Phrases, ranked search and nearest neighbours against plain versions, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientele.llm import collocations as C
from clientele.llm import cross_polytope as X
from clientele.llm.term_tree import ranked_documents
from clientele.llm.terms import packed, terms, unpacked
from clientele.llm.words import WORD_BYTE

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------------------------------------------ phrases


def plain_phrases(docs, limit, threshold):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        longer = Counter()
        for p, a in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        rows = []
        for p, a in frequent.items():
            if 100 * longer[p] < 80 * a:
                score, k = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


PHRASES = "text string, lang string, rank int, `phrase` string, f long"


def phrase_docs():
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 60}"
    docs = [(" ".join(word() + rng.choice(["", "", "", ".", ",", "\n", "\tX"]) for _ in range(rng.randrange(120))), rng.choice(["en", "fr", None])) for _ in range(150)]
    docs += [("New York City New York", "en")] * 40 + [("new york", "und")] * 35 + [(None, "en"), ("", None), (" \t ", "en"), ("...", "en"), ("été Été " * 50, "fr")]
    return docs + [("copy copy copy copy " * 3000, "en")]


@pytest.mark.parametrize("block_words,part_mass", [(C.BLOCK_WORDS, C.PART_MASS), (5000, 4000)])
def test_phrases_match_a_plain_count(spark, block_words, part_mass):
    docs = phrase_docs()
    table = spark.createDataFrame([(t, n, 1, "p", 2) for t, n in docs], PHRASES)
    found = C.collocations(table, limit=50, block_words=block_words, part_mass=part_mass)
    assert sorted(map(tuple, found.collect())) == plain_phrases(docs, 50, 30)


def test_phrases_of_nothing(spark):
    none = spark.createDataFrame([], PHRASES)
    assert C.collocations(none).count() == 0
    empty = spark.createDataFrame([(None, None, 1, "p", 2), ("", "en", 1, "p", 2)], PHRASES)
    assert C.collocations(empty).count() == 0


def test_block_ends_lose_no_phrase():
    docs = [(" ".join(f"a{i % 7}" for i in range(1000)), "en")]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([docs[0][0]])], ["lang", "text"])

    class Task:
        partitionId = staticmethod(lambda: 0)

    before, C.TaskContext = C.TaskContext, type("T", (), {"get": staticmethod(lambda: Task)})
    try:
        blocks = [r for b in C._block_rows(iter([batch]), 64) for r in b.to_pylist()]
    finally:
        C.TaskContext = before
    assert len(blocks) == 16 and sum(b["starts"] for b in blocks) == 1000
    assert sum(b["mass"] for b in blocks) == 1000 + 999 + 998 + 997
    grams = [C.Block(b["body"], b["vocabulary"], [x["lang"] for x in b["langs"]], b["starts"]).grams() for b in blocks]
    assert sum(len(h) for g in grams for _, _, h in g) == 1000 + 999 + 998 + 997


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(5)
    stream = np.concatenate([np.repeat(np.arange(40), 30), rng.integers(1000, 2**40, 20_000), np.full(3000, 7)])
    rng.shuffle(stream)
    parts = [C.squeezed(p, np.ones(len(p), dtype=np.int64)) for p in np.array_split(stream, 25)]
    true = Counter(stream.tolist())
    summary = C.Summary(len(stream) // 30 + 1)
    for values, counts in parts:
        summary.add(values, counts)
    summary.merge()
    held = dict(zip(summary.values.tolist(), summary.counts.tolist()))
    assert 0 < summary.error <= len(stream) / (summary.capacity + 1) < 30 and len(held) <= summary.capacity
    assert all(true[v] - summary.error <= held.get(v, 0) <= true[v] for v in true)
    alive = set(C.merged([C._coded(*p) for p in parts], 30).tolist())
    assert {v for v, n in true.items() if n >= 30} <= alive


def test_coding_and_packing_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 2**36, 5000))
    counts = np.arange(len(values)) + 1
    back = C._decoded(C._coded(values, counts))
    assert (back[0] == values).all() and (back[1] == counts).all()
    none = C._decoded(C._coded(values[:0], counts[:0]))
    assert not len(none[0]) and not len(none[1])
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "あ"])], ["x"])
    assert unpacked(packed(batch)).equals(batch)


# ------------------------------------------------------------------------------------------------- ranked search


def plain_search(docs, items, limit):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    wanted = defaultdict(set)
    for k, t in items:
        wanted[k] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for k, words in wanted.items():
        found = []
        for i, bag in bags:
            m = 50 + (50 * sum(bag.values()) * n) // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 20 * m)) for w in words & bag.keys())
            if score > 0:
                found.append((-score, i is None, i))
        out += [(k, r, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=str)


def test_terms_match_the_pattern():
    texts = ["", "Été über-alles 42X", "___", "a", "", "b c", "x" * 30]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    found, _, row = terms(np.frombuffer(data, np.uint8), offsets, WORD_BYTE)
    own = defaultdict(list)
    for r, w in zip(row.tolist(), found.to_pylist()):
        own[r].append(w.decode())
    assert [own[i] for i in range(len(texts))] == [TERM.findall(t.translate(LOWER)) for t in texts]


@pytest.mark.parametrize("block_terms", [1 << 17, 40])
def test_search_matches_a_plain_ranking(spark, block_terms):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 300}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(80)))) for i in range(600)]
    docs += [(1000 + i, docs[5][1]) for i in range(90)] + [(None, docs[5][1]), (7, docs[5][1]), (7, "w1 W2"), (8, None), (9, ""), (10, "w3 " * 20000), (11, "...")]
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 30])))) for k in range(25)] + [(90, None), (91, ""), (92, "w1"), (92, "W2 w2"), (None, "w5"), (93, "unseen"), (94, docs[5][1])]
    table = spark.createDataFrame([(i, t, 1, "r", 2.0) for i, t in docs], "doc_id long, text string, item int, `rank` string, score double")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, block string")
    found = ranked_documents(table, bench, 20, block_terms=block_terms)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items, 20)
    if block_terms > 40:
        assert ranked_documents(table.limit(0), bench).count() == 0
        assert ranked_documents(table, bench.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------ vectors


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, row int, node string, v int")


def recall(found, rows, limit):
    body = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows]
    ids, matrix = np.array([i for i, _ in body]), np.stack([v for _, v in body])
    lists = defaultdict(list)
    for r in found:
        lists[r["query_id"]].append(r)
    hits = total = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = matrix @ matrix[at]
        score[at] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[: min(limit, len(ids) - 1)]].tolist())
        mine = sorted(lists[ids[at]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        assert ids[at] not in {r["vec_id"] for r in mine}
        assert all(abs(r["score"] - score[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in mine)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(mine, mine[1:]))
        hits, total = hits + len(best & {r["vec_id"] for r in mine}), total + len(best)
    return hits / total


@pytest.mark.parametrize("lengths", [False, True])
def test_neighbours_reach_the_recall(spark, lengths):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 24))
    body = centres[rng.integers(20, size=3000)] + 0.7 * rng.normal(size=(3000, 24))
    body /= np.linalg.norm(body, axis=1)[:, None]
    if lengths:
        body *= rng.uniform(0.5, 3, 3000)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(body)]
    found = X.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, bucket=64).collect()
    assert recall(found, rows, 20) >= 0.9


def test_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    body = rng.normal(size=(60, 8)).tolist()
    rows = [(i, v) for i, v in enumerate(body)] + [(1000 + i, body[0]) for i in range(1500)]
    odd = [(9000, None), (9020, [0.0] * 8), (9040, [1.0] * 7 + [None]), (9060, [float("nan")] + [1.0] * 7), (9080, [float("inf")] + [1.0] * 7), (9100, [1.0] * 3), (None, body[1]), (9120, [])]
    found = X.nearest(vectors(spark, rows + odd), F.col("vec_id") % 20 == 0, recall=1.0).collect()
    assert recall(found, rows, 20) >= 0.9
    own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 1020)
    assert [v for _, v in own] == [0, *[1000 + i for i in range(20) if i != 20]][:20]  # copies tie: smaller ids first
    assert not {r["query_id"] for r in found} & {9000, 9020, 9040, 9060, 9080, 9100, 9120}
    few = X.nearest(vectors(spark, [(0, body[0]), (1, body[1]), (0, body[2])]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 1), (0, 2), (0, 2)]
    assert X.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert X.nearest(vectors(spark, rows[1:5]), F.col("vec_id") % 20 == 0).count() == 0


def test_rotations_keep_lengths_and_probes_start_with_the_own_bucket():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(50, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert np.allclose(np.linalg.norm(X.hadamard(unit), axis=1), 1)
    hashing = X.Hashing(16, 2, 2, 4, None)
    for t in range(2):
        probes = hashing.probes(unit, t, hashing.count)
        assert (probes[:, 0] == hashing.buckets(unit, t)).all()
        assert (np.sort(probes, axis=1) == np.arange(hashing.count)).all()
