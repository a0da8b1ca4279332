"""Packing, the quality classifier and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from contentgrade.llm import mixing, packing, quality
from contentgrade.llm.queries import QUERIES
from tests.llm.test_mixing_sharding import targets
from tests.llm.test_neardup_lines import brute_components, brute_lines

TOKENIZER = Tokenizer.from_file(packing.tokenizer_path())


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


def check_pieces(rows, texts, capacity):
    """texts: the number of times each (doc_id, text) was packed."""
    places, pieces = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for inside in places.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= capacity
    for key, text, times in texts:
        ids = ids_of(text)
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        expected = [
            (k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
        ]
        found = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key])
        assert found == sorted(expected * times)
    return len(places)


def test_fast_ids_equal_the_library():
    tokens = packing._tokens(packing.tokenizer_path())
    r = random.Random(4)
    signs = ["a", "Z", "é", "ñ", "ß", "漢", "ा", "١", "9", " ", "  ", "\n", "\t", " ", " ", "\x85", "\x1c", "'s", "'LL", ".", "—", "​", "İ", "ⅷ", "²"]
    for _ in range(400):
        text = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        assert tokens.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    for text in ("", "<|endoftext|> in a text", "emoji 😀 text", "x" * 5000):
        assert tokens.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_texts_are_tokenized_in_parts(monkeypatch):
    text = " ".join(f"word{i}\n\n  next" for i in range(500)) + "nospace" * 300
    tokens = packing._tokens(packing.tokenizer_path())
    whole = tokens.ids(text).tolist()
    monkeypatch.setattr(packing, "PART_CHARS", 37)
    assert tokens.ids(text).tolist() == whole == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,kind", [(20_000, "even"), (20_000, "long"), (500, "even"), (3, "even"), (1, "full")])
def test_plan_places_everything_in_few_sequences(n, kind):
    r = np.random.default_rng(6)
    lengths = {"even": r.integers(1, 257, n), "long": r.integers(129, 257, n), "full": np.full(n, 256)}[kind]
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.plan_packing(dict(zip(values.tolist(), counts.tolist(), strict=True)), 256)
    used = {}
    for value, count in zip(values.tolist(), counts.tolist(), strict=True):
        sequence, offset = plan.place(value, np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used.setdefault(s, []).append((o, value))
    for inside in used.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= 256
    least = max(-(-int(lengths.sum()) // 256), int((lengths > 128).sum()))
    assert len(used) == plan.total <= 1.01 * least + 1


def test_configurations_beat_or_match_best_fit():
    r = np.random.default_rng(9)
    counts = np.bincount(r.integers(90, 180, 30_000), minlength=513)
    fit = sum(packing.pack_rest({}, counts, 512).values())
    plan = packing.plan_packing({i: int(c) for i, c in enumerate(counts) if c}, 512)
    assert plan.total <= 1.002 * fit


def test_packing(spark):
    r = random.Random(1)
    texts = [(i, " ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(0, 90)))) for i in range(150)]
    texts += [(900, ""), (901, None), (902, "twice"), (902, "twice"), (None, "no id"), (903, "a " * 4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit("x")).repartition(4)
    rows = packing.pack_documents(docs, capacity=64).collect()
    times = {t: texts.count(t) for t in texts}
    sequences = check_pieces(rows, [(k, t, n) for (k, t), n in times.items()], 64)
    assert sequences <= 1.03 * sum(r["length"] for r in rows) / 64 + 1
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_packing_query(spark, sf_dir):
    rows = QUERIES["op7_packing"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sequences = check_pieces(rows, [(d["doc_id"], d["text"], 1) for d in docs], 1024)
    assert sequences <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = QUERIES["op8_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = scored.join(labels, "doc_id").filter("held_out").select("quality", "predicted", "score").collect()
    right = {y: np.mean([r["predicted"] == y for r in rows if r["quality"] == y]) for y in (0, 1)}
    assert right[1] > 0.98 and right[0] > 0.85
    good, bad = ([r["score"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert np.mean([np.mean(np.array(good) > b) for b in bad]) > 0.98
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_labels_of_held_out_rows_teach_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    hidden = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    turned = labels.withColumn("quality", F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.labelled_sample(docs, labels) == quality.labelled_sample(docs, turned)
    assert quality.held_out(1) == (zlib.crc32(b"1") % 3 == 1)


def test_odd_texts_and_labels(spark):
    rows = [(i, "good words in a row " * 9 if i % 2 else "### *** " * 20) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "good words"), (102, "z" * 300_000), (1, "good words in a row " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(7, 0, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    scores = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["text"] in (None, "")}) == 1
    for some in (labels.limit(0), labels.filter("quality = 1")):
        found = quality.score_quality(docs, quality.fit_quality(docs, some)).collect()
        assert all(0 <= r["score"] <= 1 for r in found)
    assert quality.keep_good(docs.limit(0), labels).collect() == []


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, sf_dir)
    assert kept.columns == columns
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = model.scores([d["text"].encode() for d in before]) >= 0.5
    assert {r["doc_id"] for r in kept.collect()} == {d["doc_id"] for d, g in zip(before, good, strict=True) if g}

    lines = stages["line_dedup"](spark, kept, sf_dir)
    assert lines.columns == columns
    expected = brute_lines([(d["doc_id"], d["text"]) for d in kept.collect()])
    for d in lines.collect():
        text = next(b["text"] for b in before if b["doc_id"] == d["doc_id"])
        left = [x for k, x in enumerate(text.split("\n")) if expected.get((d["doc_id"], k), ((d["doc_id"], k), 0))[0] == (d["doc_id"], k)]
        assert d["text"] == "\n".join(left) and d["n_chars"] == len(d["text"])

    near = stages["near_dedup"](spark, lines, sf_dir)
    assert near.columns == columns
    _, groups = brute_components([(d["doc_id"], d["text"]) for d in lines.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i, g in groups.items() if i == g}

    mix = stages["mixing"](spark, near, sf_dir)
    assert mix.columns == columns
    sizes, taken = {}, {}
    for table, out in ((near, sizes), (mix, taken)):
        for r in table.collect():
            out[r["source"]] = out.get(r["source"], 0) + len(r["text"].split())
    assert sum(taken.values()) == pytest.approx(sum(targets(sizes).values()), rel=0.1)

    packed = stages["packing"](spark, mix, sf_dir).collect()
    times = {}
    for r in mix.collect():
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    check_pieces(packed, [(k, t, n) for (k, t), n in times.items()], 1024)


def test_pipeline_runs_whole(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert "sequence_id" in found.columns and found.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert mixing.LARGE_PART == 20


def test_pipeline_of_odd_documents(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id at all here", "en", None, 17), (3, "word", "en", "a", 4), (3, "word", "en", "a", 4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    odd = ["a.b", "tick`ed", "with blank", "kept", "component_id", "size", "score", "shard"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = docs.select("*", *[F.col("doc_id").alias(name) for name in odd])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns, name
        for row in found.collect():
            assert all(row[n] == row["doc_id"] for n in odd), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0


def test_texts_of_a_dictionary_are_bounded():
    texts = [f"text {i} of its own words {i * 7919}".encode() for i in range(40)]
    labels = [i % 2 for i in range(40)]
    few, more = (quality.train(texts, labels, dictionary_texts=n) for n in (2, 20))
    assert few != more and more == quality.train(texts, labels)
