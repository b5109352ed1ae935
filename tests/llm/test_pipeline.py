"""The pipeline stage by stage against brute force, and the registered queries over the driver's smallest tables."""

from __future__ import annotations

import importlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import classifier, mixing, packing
from tessera.llm import queries as llm
from tessera.llm.shared import stored

from .common import corpus, words
from .test_dedup import components
from .test_native import repeated_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    junk = [(10_000 + k, " ".join(rng.choice(["$$$", "BUY!!", "#1", "||"]) for _ in range(rng.randint(20, 90))), "a") for k in range(40)]
    rows = [(i, t, s) for i, t, s in corpus(8, 240) if t is None or len(t) < 4000] + junk
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "more") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, stage string")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 10_000), 0) for i, t, _ in rows if t], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = [{r.doc_id: r.text for r in docs.collect()}]
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, folder), f"test-{k}")
        kept.append(docs)
        if k < 4:
            assert docs.columns == columns, name
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in kept[:5]]

    w = classifier.fit(kept[0], spark.read.parquet(f"{folder}/labels.parquet"))
    accepted = {i for i, t in rows[0] if classifier.scores([(t or "").encode()], w)[0] >= classifier.CUT}
    assert {i for i, _ in rows[1]} == accepted and len(accepted) < len(rows[0]) and all(dict(rows[0])[i] == t for i, t in rows[1])

    deduped = repeated_lines(rows[1])
    before = dict(rows[1])
    want = {i: t for i, t in deduped.items() if words(t) or not words(before[i])}
    assert {i: t or "" for i, t in rows[2]} == want and want != {i: t or "" for i, t in rows[1]}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept[2].collect())

    label = components(rows[2], 5, 80)
    assert sorted(rows[3], key=str) == sorted(((i, t) for i, t in rows[2] if label[i] == i), key=str) and len(rows[3]) < len(rows[2])

    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert Counter(i for i, _ in rows[4]) == Counter({i: n for i, n in copies.items() if n})

    encode = packing.encoder(packing.tokenizer_path(packing.BYTE_BPE))
    total = Counter()
    for i, t in rows[4]:
        total[i] += len(encode(t or "")) + 1
    packed = kept[5].collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == total
    sizes = Counter()
    for r in packed:
        sizes[r.sequence_id] += r.length
    assert all(n <= packing.WINDOW and n & (n - 1) == 0 for n in sizes.values())


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_null_ids(spark, tmp_path):
    rows = [(None, "no id here", "en", None, 10, "x"), (None, None, None, None, None, None), (5, "one two three", "en", "s", 13, "x"), (5, "one two three", "en", "s", 13, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, stage string"
    for k, own in enumerate((rows, [])):
        path = f"{tmp_path}/{k}"
        spark.createDataFrame(own, schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stored(stage(spark, docs, path), "test")
        assert docs.count() == (3 if own else 0)
        # an id's copies are one, the two null ids stay: their tokens are what is packed, as often as the mix takes them
        packed = corpus_pipeline.run(spark, path).collect()
        assert {r.doc_id for r in packed} == ({None, 5} if own else set()) or not own
        copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs).collect()} if own else {}
        encode = packing.encoder(packing.tokenizer_path(packing.BYTE_BPE))
        assert sum(r.length for r in packed) == sum((len(encode(r.text or "")) + 1) * copies[r.doc_id, len(words(r.text))] for r in docs.collect())


def test_unlike_texts_of_one_id_and_clashing_columns(spark, tmp_path):
    """Nothing unlike is lost, like texts go whatever their ids, and columns that bear inner names stay as they are."""
    rng = random.Random(2)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abc")
    rows = [(5, a), (5, b), (5, a), (6, a + " more"), (7, b), (8, c), (9, None), (9, ""), (9, " "), (None, c)]
    inner = ["text_before", "had_words", "stay_id", "tag", "row", "component", "component_id", "n_shingles"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *inner) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in inner))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got if r.text and r.text.strip()) == sorted([("5", a), ("5", b), ("8", c), ("None", c)])
    assert sorted(r.text or "" for r in got if not (r.text or "").strip()) == ["", " "]
    assert all([r[c] for c in inner] == inner for r in got)
    out = corpus_pipeline.lines(spark, docs.drop("n_chars").withColumn("n_chars", F.length("text").cast("long")), "")
    assert sorted(out.columns) == sorted(docs.columns) and all([r[c] for c in inner] == inner for r in out.collect())
    assert corpus_pipeline.mix(spark, docs, "").columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({llm.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not there")
def test_held_out_documents_are_told_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = classifier.score(docs, classifier.fit(docs, labels)).join(labels, "doc_id").where(classifier.remainder() == 0).select("score", "quality").collect()
    right = [(r.score >= classifier.CUT) == bool(r.quality) for r in scored]
    assert np.mean(right) > 0.85 and len(right) > 40


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {x[: x.index("_") + 1] for x in names if x.startswith("op") and x[2].isdigit()} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
