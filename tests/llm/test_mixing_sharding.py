"""Mixing and sharding against their laws and against plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from contentgrade.llm import mixing, sharding
from contentgrade.llm.queries import QUERIES


def targets(sizes: dict, share: float = 1.5, epochs: int = 2) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    clamped: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weight[s] for s in names if s not in clamped)
        over = {s for s in names if weight[s] * level > epochs * sizes[s]} | clamped
        if over == clamped:
            return {s: min(epochs * sizes[s], weight[s] * level) for s in names}
        clamped = over


def unit(doc_id) -> int:
    return int(hashlib.md5(f"mix:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, ["a", "b", "é", "z", None][i % 7 % 5], "w " * (i * 37 % 23 + 1), "x") for i in range(900)]
    rows += [(None, "a", "only words", "x"), (1000, "a", None, "x"), (1001, "b", "", "x"), (1002, "q", " \t", "x")]
    rows += [(1003, "b", "long " * 400, "x"), (5, "a", "same id", "x"), (5, "a", "same id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string").repartition(5)
    return rows, docs


def mix(docs):
    return mixing.mix_sources(docs, size=F.regexp_count("text", F.lit(mixing_word())), key=F.col("doc_id"))


def mixing_word():
    from contentgrade.llm.common import WORD

    return WORD


def test_targets_and_taken_words(mixed):
    rows, docs = mixed
    found = mix(docs).collect()
    assert len(found) == len(rows)
    sizes: dict = {}
    for _, source, text, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    expected = targets(sizes)
    taken: dict = {}
    for r in found:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(expected[r["source"]])
        assert 0 <= r["mix_times"] <= 2 and r["size"] == "x"
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_size"] * r["mix_times"]
    for source, target in expected.items():
        assert taken[source] == pytest.approx(target, abs=max(30, 0.02 * target))


def test_small_documents_are_taken_by_their_hash(mixed):
    rows, docs = mixed
    found = [r for r in mix(docs).collect() if 20 * r["mix_size"] <= r["mix_source_size"]]
    for source in {r["source"] for r in found}:
        inside = [r for r in found if r["source"] == source]
        if len({r["mix_times"] for r in inside}) > 1:
            more = max(unit(r["doc_id"]) for r in inside if r["mix_times"] == max(x["mix_times"] for x in inside))
            assert all(unit(r["doc_id"]) > more for r in inside if r["mix_times"] == min(x["mix_times"] for x in inside))


def test_reruns_and_partitions_do_not_matter(mixed):
    _, docs = mixed
    key = lambda rows: sorted(map(str, rows))
    assert key(mix(docs).collect()) == key(mix(docs.repartition(2)).collect())


def test_repetitions_as_rows(mixed):
    _, docs = mixed
    copies = mixing.mixed(docs, size=F.regexp_count("text", F.lit(mixing_word())), key=F.col("doc_id"))
    assert copies.columns == docs.columns
    assert copies.count() == mix(docs).agg(F.sum("mix_times")).first()[0]


def test_mixing_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(docs).collect() == []
    only_empty = spark.createDataFrame([(1, "a", ""), (2, None, None)], "doc_id long, source string, text string")
    assert {(r["mix_times"], r["mix_target"]) for r in mix(only_empty).collect()} == {(1, 0.0)}


def test_mixing_plan_has_no_python(spark, sf_dir):
    plan = QUERIES["op10_mixing"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def shard(docs, shards=16):
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).alias("bytes"), "text", F.lit(9).alias("shard"))
    return sharding.shard_by_bytes(rows, F.col("bytes"), F.xxhash64("text"), ["doc_id"], shards)


def check_law(rows, shards):
    sizes, slots = {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target = sum(sizes.values()) / shards
    return sizes, target


def test_shards_are_nearly_equal(spark):
    rows = [(i, "é" * (i * 31 % 97)) for i in range(3000)] + [(None, "a"), (7, None), (7, None)]
    found = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(found) == len(rows)
    sizes, target = check_law(found, 16)
    assert max(abs(s - target) for s in sizes.values()) < 0.03 * target + 200


def test_groups_stay_together_unless_they_are_large(spark):
    rows = [(i, f"text {i % 700}") for i in range(2100)] + [(9000 + i, "one text of a third of all rows") for i in range(1000)]
    found = shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8).collect()
    sizes, target = check_law(found, 8)
    assert max(abs(s - target) for s in sizes.values()) < 0.03 * target
    places = {}
    for r in found:
        places.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(p) == 1 for t, p in places.items() if not t.startswith("one"))
    assert len(places["one text of a third of all rows"]) > 1


def test_fewer_rows_than_shards(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    found = shard(docs).collect()
    assert len(found) == 3 and all(0 <= r["shard"] < 16 for r in found)
    check_law(found, 16)
    assert shard(docs.limit(0)).collect() == []


def test_sharding_query(spark, sf_dir):
    found = QUERIES["op3_sharding"](spark, sf_dir).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(found) == len(docs)
    for r in found:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "bytes")
        assert r["grown_shard"] is None
    by_shard: dict[int, list] = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(r["doc_id"] for r in found) == sorted(docs) and set(by_shard) == set(range(16))
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    groups: dict[int, int] = {}
    for r in found:
        groups[r["text_crc32"]] = groups.get(r["text_crc32"], 0) + r["size"]
    # A cut moves by half a row or, for a group's end, by the slack of a shard at most.
    slack = max(largest, sharding.GROUP_SLACK * total / 16)
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        assert abs(sum(r["size"] for r in rows) - total / 16) <= 2 * slack
    # Shards are contiguous, so equal texts lie in one shard or in neighbours.
    places: dict[str | None, set[int]] = {}
    for r in found:
        places.setdefault(docs[r["doc_id"]], set()).add(r["shard"])
    for text, shards in places.items():
        assert max(shards) - min(shards) == len(shards) - 1
        assert len(shards) == 1 or groups[zlib.crc32((text or "").encode())] > slack
