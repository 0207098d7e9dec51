import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from clientele.llm.packing import PackSettings, pack_documents
from clientele.llm.sharding import MULTIPLIER, assign_shards, jump_shard, write_shards
from clientele.llm.urls import Rule, judge_urls, matched_rule, url_parts

DOCS = "doc_id long, text string, source string, shard int, `key` string, part int"


def jump(key, shards):
    key, at, after = key % 2**64, -1, 0
    while after < shards:
        at = after
        key = (key * MULTIPLIER + 1) % 2**64
        after = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_hash_is_the_published_one_and_moves_only_to_the_new_shard(spark):
    keys = [0, 1, 7, -1, -(2**63), 2**63 - 1, *range(1000, 1400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 16, 200):
        got = {r[0]: (r[1], r[2]) for r in frame.select("k", jump_shard("k", shards), jump_shard("k", shards + 1)).collect()}
        assert all(got[k] == (jump(k, shards), jump(k, shards + 1)) for k in keys)
        assert all(b in (a, shards) for a, b in got.values())


def test_slots_are_gapless_and_rows_complete(spark):
    rows = [(i, "x" * (i % 9), "s", 1, "k", 2) for i in range(500)] + [(None, None, None, 1, None, 0), (3, "again", "s", 1, "k", 2), (3, "again", "s", 1, "k", 2)]
    out = assign_shards(spark.createDataFrame(rows, DOCS), 16, rows_per_range=50).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for found in slots.values():
        found.sort()
        assert [s for s, _ in found] == list(range(len(found)))
        ids = [-1 if i is None else i for _, i in found]
        assert ids == sorted(ids)
    null = next(r for r in out if r["doc_id"] is None)
    assert (null["size"], null["text_crc32"]) == (1, 0)
    assert {r["text_crc32"] for r in out if r["doc_id"] == 8} == {zlib.crc32(b"x" * 8)}


def test_shards_of_an_empty_table_and_written_shards(spark, tmp_path):
    empty = spark.createDataFrame([], DOCS)
    assert assign_shards(empty, 16).count() == 0
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("shard"))
    write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and "shard" in back.columns and len(back.columns) == 4


def test_packs_hold_capacity_conflicts_and_whole_rows(spark):
    words = lambda n: " ".join(["w"] * n)
    rows = [(i, words(1 + i * 7 % 90), "hot" if i % 3 == 0 else f"s{i % 11}", 0, "", 0) for i in range(600)]
    rows += [(1000 + i, "same text here", "hot", 0, "", 0) for i in range(200)]  # one cluster
    rows += [(None, None, None, 0, None, 0), (5000, words(1050), "s1", 0, "", 0), (7, "", "s1", 0, "", 0)]
    settings = PackSettings(capacity=100, per_source=3, group_rows=10_000)
    docs = spark.createDataFrame(rows, DOCS)
    out = pack_documents(docs, settings=settings).collect()
    sizes = {(r[0], r[1]): len((r[1] or "").split()) for r in rows}
    covered, room, sources, clusters = Counter(), Counter(), Counter(), Counter()
    source_of = {r[0]: r[2] for r in rows}
    for r in out:
        covered[r["doc_id"]] += r["units"]
        room[r["pack"]] += r["units"]
        sources[(r["pack"], source_of[r["doc_id"]])] += 1
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1200:
            clusters[r["pack"]] += 1
    total = Counter()
    for (i, _), n in sizes.items():
        total[i] += n
    assert covered == total and len(out) == len(rows) + 10  # the long row is eleven pieces
    assert max(room.values()) <= 100 and max(sources.values()) <= 3 and max(clusters.values()) == 1
    assert {r["first_unit"] for r in out if r["doc_id"] == 5000} == set(range(0, 1050, 100))
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0
    again = pack_documents(docs, settings=settings).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_best_fit_takes_the_tightest_compatible_bin():
    from clientele.llm.packing import Bins

    bins = Bins(PackSettings(capacity=10, per_source=1))
    assert bins.place(7, 0, 0) == 0 and bins.place(6, 1, -1) == 1
    assert bins.place(3, 0, -1) == 1  # bin 0 is tighter but holds source 0
    assert bins.place(3, 2, 0) == 2  # bin 0 holds cluster 0, bin 1 has no room
    assert bins.place(3, 2, 5) == 0


RULES = [Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block")]


def test_url_parts_and_longest_rule(spark):
    cases = {
        "https://WWW.Example.com/en/1?q#f": ("www.example.com", "/en/1", "www.example.com/en/"),
        "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/"),
        "http://badexample.com/en/": ("badexample.com", "/en/", "com/"),
        "http://x.com": ("x.com", "", None),
        "x://h.net?a=/es/": ("h.net", "", None),
        "http://h.net/es/a#b?c": ("h.net", "/es/a", "net/es/"),
        "no scheme/en/": ("", "", None),
        "": ("", "", None),
        None: ("", "", None),
        "http://É.COM/en/": ("É.com", "/en/", "com/"),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    host, path = url_parts(F.col("url"))
    for r in frame.select("url", host.alias("h"), path.alias("p"), matched_rule(host, path, RULES).alias("r")).collect():
        assert (r["h"], r["p"], r["r"]) == cases[r["url"]], r


def test_trees_decide_the_rest_and_rules_stand(spark):
    rows = [(i, f"http://shop{i}.com/item/{i % 50}", "x") for i in range(300)]
    rows += [(1000 + i, f"http://h{i}.net/es/{'9' * 12}{i}?a=1&b=2&c=3", "x") for i in range(300)]
    rows += [(2000 + i, f"http://k{i}.org/es/{'9' * 12}{i}?a=1&b=2&c=3", "x") for i in range(20)]
    rows += [(3000 + i, f"http://k{i}.org/item/{i}", "x") for i in range(20)] + [(None, None, None), (5, rows[5][1], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    out = judge_urls(pages, RULES).collect()
    assert len(out) == len(rows)
    verdict = {r["page_id"]: r["verdict"] for r in out}
    assert all(verdict[i] == "allow" for i in range(300)) and all(verdict[1000 + i] == "block" for i in range(300))
    assert sum(verdict[2000 + i] == "block" for i in range(20)) >= 18 and sum(verdict[3000 + i] == "allow" for i in range(20)) >= 18
    assert judge_urls(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("shards", [0, -1])
def test_shards_must_be_positive(shards):
    with pytest.raises(ValueError):
        jump_shard("k", shards)
