"""Classifier, packing, fingerprints, token counts and LM scoring."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import classifier, fingerprints, lm_scoring, packing, token_counts

from .common import corpus, odd, prose, very_long, words

LONG = [*corpus(), (10**6, very_long(), "a"), (10**6, very_long(), "a"), (None, "no id", None), (7, "", "x")]


# classifier


def labelled(spark, n=400):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "and", "ran"]) for _ in range(rng.randint(5, 200))) for _ in range(n)]
    bad = [" ".join(rng.choice(["$$$", "BUY", "NOW!!", "#1", "||", "%%"]) for _ in range(rng.randint(5, 200))) for _ in range(n)]
    rows = [(2 * k, t, "s") for k, t in enumerate(good)] + [(2 * k + 1, t, "s") for k, t in enumerate(bad)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _, _ in rows] + [(0, None), (None, 1), (5, 9)], "doc_id long, quality int")
    return rows, labels


def test_classifier_learns(spark):
    rows, labels = labelled(spark)
    docs = odd(spark, [*rows, (None, None, "s"), (10**7, "", "s"), (10**7 + 1, very_long(), "s"), (0, rows[0][1], "s")])
    w = classifier.fit(docs, labels, per_class=200)
    again = classifier.fit(docs.repartition(5), labels, per_class=200)
    assert all(np.array_equal(w[k], again[k]) for k in w)
    got = classifier.score(docs, w).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 10**6 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 0) for r in held]) > 0.97
    kept = classifier.accepted(docs, w)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= classifier.CUT for r in got)


def test_scores_are_the_trained_networks(spark):
    rows, labels = labelled(spark, 60)
    w = classifier.fit(odd(spark, rows), labels, per_class=50)
    texts = [b"", b"x", b"the cat " * 700, b"$$$ " * 127, b"a" * 512, b"b" * 513, b"c" * 960, b"d" * 961]
    together = classifier.scores(texts, w)
    for text, score in zip(texts, together, strict=True):
        x = classifier.cut_up(text)
        assert b"".join([x[0].tobytes(), *(row[classifier.CHUNK - classifier.HOP :].tobytes() for row in x[1:])]).startswith(text)
        h = np.maximum(classifier._responses(x, w)[1].max(1) + w["bias"], 0)
        u = np.concatenate([h.mean(0), h.max(0)])
        assert abs(score - 1 / (1 + math.exp(-float(u @ w["out"] + w["shift"][0])))) < 1e-5


def test_training_reads_whole_texts(spark):
    """What tells the classes apart lies in the last chunks of long texts only."""
    rng = random.Random(3)
    rows = []
    for k in range(240):
        own = [rng.choice(["the", "cat", "sat", "on", "mats"]) for _ in range(1500)]
        if k % 2:
            own[-60:] = ["$$$ ||"] * 60
        rows.append((k, " ".join(own), "s"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _, _ in rows], "doc_id long, quality int")
    w = classifier.fit(odd(spark, rows), labels)
    held = [(t.encode(), i % 2 == 0) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(s >= 0.5) == good for s, (_, good) in zip(classifier.scores([t for t, _ in held], w), held, strict=True)]
    assert len(held) > 30 and np.mean(right) > 0.9


def test_blocks_of_chunks_train_alike():
    rng = np.random.default_rng(4)
    texts, y = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (30, 700, 3000)], np.array([0, 1, 1.0])
    blocks = classifier.BLOCK
    a = classifier.train(texts, y, epochs=2)
    classifier.BLOCK = 2
    try:
        b = classifier.train(texts, y, epochs=2)
    finally:
        classifier.BLOCK = blocks
    assert all(np.allclose(a[k], b[k], atol=2e-3) for k in a)


def test_several_texts_of_one_id_and_the_bound_of_bytes(spark):
    rows, labels = labelled(spark, 100)
    docs = odd(spark, [*rows, *((i, t + " other", s) for i, t, s in rows)])
    one, two = (classifier.fit(d, labels, per_class=40) for d in (docs, docs.repartition(7)))
    assert all(np.array_equal(one[k], two[k]) for k in one)
    assert classifier.fit(docs, labels, sample_bytes=0) is None


def test_without_labels(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert classifier.fit(docs, none) is None and {r.score for r in classifier.score(docs, None).collect()} == {0.5}
    assert classifier.score(odd(spark, []), None).count() == 0


# packing


@pytest.mark.parametrize("window,shard", [(2048, 2048), (64, 16)])
def test_packing_is_an_exact_round_trip(spark, window, shard):
    from tokenizers import Tokenizer

    docs = odd(spark, LONG)
    rows = packing.pack(docs, window=window, shard_docs=shard).collect()
    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path(packing.BYTE_BPE))
    ids = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in LONG]
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window and at & (at - 1) == 0
    # ids that several rows share: their pieces are those of all the rows together
    pieces, want = Counter(), Counter()
    for r in rows:
        pieces[r.doc_id, r.doc_tokens] += r.length
    for i, own in ids:
        want[i, len(own)] += len(own)
    assert pieces == want
    unique = {i: own for i, own in ids if sum(i == j for j, _ in ids) == 1}
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: r.start):
        if r.doc_id in unique:
            own = unique[r.doc_id]
            assert r.start == ends[r.doc_id] and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
            ends[r.doc_id] += r.length
    assert all(ends[i] == len(own) for i, own in unique.items())


def test_neighbours_are_the_most_alike():
    rng = np.random.default_rng(2)
    topics = [rng.integers(1000 * k, 1000 * k + 60, 40) for k in range(5)]
    ids = [np.append(rng.permutation(topics[k % 5])[:30], 1).astype(np.uint32) for k in range(40)]
    order = packing.order_of(ids, window=8 * 31)
    assert sorted(order) == list(range(40))
    same = sum(a % 5 == b % 5 for a, b in zip(order, order[1:], strict=False))
    assert same >= 30


def test_copies_meet_whatever_their_ids(spark):
    """Near copies far apart in ids lie in one window, however many shards there are."""
    rng = random.Random(8)
    rows = []
    for k in range(60):
        own = [f"{x:x}" for x in rng.sample(range(16**5, 16**6), 40)]
        rows += [(k, " ".join(own), "s"), (k + 5000, " ".join([*own[:39], "changed"]), "s")]
    windows = defaultdict(set)
    for r in packing.pack(odd(spark, rows), shard_docs=16).collect():
        windows[r.doc_id].add(r.sequence_id)
    together = sum(bool(windows[k] & windows[k + 5000]) for k in range(60))
    assert together > 45


def test_all_neighbours_come_before_others():
    """More neighbours than are ranked at a time, which share only the seed's lightest term."""
    seed = np.repeat(np.arange(100, 130), 3)
    others = [np.full(2, 7) if k % 2 else np.full(2, 1000 + k % 40) for k in range(160)]
    marked = [np.repeat(np.arange(100, 130), 3) for _ in range(3)]
    ids = [np.append(seed, 7).astype(np.uint32), *(x.astype(np.uint32) for x in others + marked)]
    order = packing.order_of(ids, window=1 << 20, near=8)
    near = [k for k in range(1, len(ids)) if set(ids[k].tolist()) & set(ids[0].tolist())]
    assert sorted(order) == list(range(len(ids))) and set(order[1 : len(near) + 1]) == set(near)


def test_empty_packing(spark):
    assert packing.pack(odd(spark, [])).count() == 0


def test_encoder_is_the_tokenizers():
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path(packing.BYTE_BPE)
    encode, slow = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abZ'sdtÉßüé 0129½²_-—“€\t\n.ŉǅ日 \x1c\x85  ll re") for _ in range(80))
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids
    assert encode("x<|endoftext|>y") == slow.encode("x<|endoftext|>y", add_special_tokens=False).ids


# fingerprints


def wanted_fingerprints(rows):
    """doc_id, n_chars, edited_sha256 and the texts before and after, by brute force; rows with one id by a hash of their text."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    out = []
    for k, (i, text, _) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        out.append(((str(i), len(text), hashlib.sha256(edited.encode()).hexdigest()), text, edited, after))
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def likeness(a, b):
    x, y = (set(fingerprints.digests([t.encode()])[0].tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("parts", [3, 40])
def test_fingerprints(spark, parts):
    """Repeated ids and rows, null ids and very long texts among them."""
    rows = [*LONG, (0, "x" * 5, "s"), (-5, None, "s"), (None, "another", "s"), (None, "no id", "s"), (4, "two texts", "s"), (4, "of one id", "s")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = fingerprints.fingerprints(odd(spark, rows).repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = wanted_fingerprints(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(w[0] for w in want)
    near = defaultdict(list)
    for (key, text, edited, after) in want:
        near[key].append((likeness(text, edited), likeness(text, after)))
    same = defaultdict(set)
    for r in got:
        key = (str(r.doc_id), r.n_chars, r.edited_sha256)
        assert any(abs(r.near_edited - a) + abs(r.near_next - b) < 1e-9 for a, b in near[key])
        for (k, text, edited, _) in want:
            if k == key:
                same[text].add(r.fingerprint)
                same[edited].add(r.edited_fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.fingerprints(odd(spark, [])).count() == 0
    (r,) = fingerprints.fingerprints(odd(spark, [(1, "a b c d", "s")])).collect()
    assert (r.edited_sha256, r.n_chars) == (hashlib.sha256(b"a b a b").hexdigest(), 7)


def test_one_null_id_of_a_third_of_all_rows_fills_many_ranges(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 300 + [(k, f"text {k}") for k in range(600)], "doc_id long, text string")
    by = [F.desc_nulls_last("doc_id"), F.asc("hash"), F.asc("salt")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt")).repartitionByRange(12, *by)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 9 and max(sizes) < 200
    assert fingerprints.fingerprints(docs).where("near_next = 1").count() == 299


def test_fingerprints_tell_the_paragraphs_that_differ(spark):
    old = "\n".join(f"paragraph {k} of a text" for k in range(40))
    new = old.replace("paragraph 7 of", "paragraph seven of").replace("\nparagraph 20 of a text", "")
    rows = [(1, old, "s"), (2, new, "s"), (3, "\n".join(f"something else {k}" for k in range(60)), "s")]
    f = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(odd(spark, rows)).collect()}
    of = {i: set(fingerprints.digests([t.encode()])[0].tolist()) for i, t, _ in rows}
    assert fingerprints.difference(f[1], f[2]) == (of[1] - of[2], of[2] - of[1]) == fingerprints.differences(old, new) and of[1] != of[2]
    assert fingerprints.difference(f[1], f[1]) == (set(), set()) and fingerprints.difference(f[1], f[3]) is None
    assert fingerprints.differences(old, rows[2][1]) == (of[1], of[3])


def test_likeness_is_exact_whatever_the_first_size():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)).encode() for n in (0, 3, 50, 800, 6000)]
    other = [t[: len(t) // 2] + b" tail end" for t in texts]
    a, b = fingerprints.digests(texts), fingerprints.digests(other)
    want = []
    for k in range(len(texts)):
        x, y = set(a[0][a[1] == k].tolist()), set(b[0][b[1] == k].tolist())
        want.append(len(x & y) / len(x | y) if x | y else 1.0)
    for cells in (1, 8, 64):
        assert np.allclose(fingerprints.likeness(a, b, len(texts), cells), want)


# token counts


def test_token_counts(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, cache = odd(spark, LONG), f"file://{tmp_path}/cache"
    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path(token_counts.WORD_BPE))
    got = token_counts.token_counts(docs, cache=cache).collect()
    want = sorted((str(i), len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in LONG)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    kept = spark.read.parquet(cache)
    assert kept.count() == kept.select("digest").distinct().count() == len({re.sub("[ \t-\r]+", " ", t or "") for _, t, _ in LONG})
    before = kept.count()
    again = token_counts.token_counts(odd(spark, [*LONG, (77_777, "something new", "s")]), cache=cache)
    assert again.count() == len(LONG) + 1 and spark.read.parquet(cache).count() == before + 1


def test_count_cache_is_read(spark, tmp_path):
    docs, cache = spark.createDataFrame([(1, "a  b")], "doc_id long, text string"), f"file://{tmp_path}/cache"
    token_counts.token_counts(docs, cache=cache)
    row = spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("long"))
    row.write.parquet(f"{tmp_path}/other")
    other = spark.createDataFrame([(1, "a b"), (2, "a\tb")], "doc_id long, text string")
    assert {r.n_tokens for r in token_counts.token_counts(other, cache=f"file://{tmp_path}/other").collect()} == {99}
    assert token_counts.token_counts(odd(spark, [])).count() == 0


def test_a_lasting_cache_serves_the_query(spark, tmp_path):
    """With a cache that the session names, a second run encodes nothing."""
    docs = odd(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "a b", "s"), (2, "c", "s")])
    spark.conf.set(token_counts.CACHE_SETTING, f"file://{tmp_path}/lasting")
    try:
        first = sorted(map(str, token_counts.token_counts(docs).collect()))
        files = spark.read.parquet(f"{tmp_path}/lasting")
        assert files.count() == 2
        assert sorted(map(str, token_counts.token_counts(docs).collect())) == first
        assert spark.read.parquet(f"{tmp_path}/lasting").count() == 2
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)


def test_one_text_of_a_third_of_all_rows_is_spread(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 400 + [(k, f"text {k}") for k in range(800)], "doc_id long, text string")
    got = token_counts.token_counts(docs).withColumn("part", F.spark_partition_id())
    assert got.count() == 1200
    assert got.where("doc_id IS NULL").select("n_tokens").distinct().count() == 1


def test_counter_is_the_tokenizers():
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path(token_counts.WORD_BPE)
    slow, count = Tokenizer.from_file(path), token_counts.Counter(path, True, remembered=50)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abZ'sdtÉßüé 0129½²_-—“€\t\n.ŉǅ日 \x1c\x85  ll re") for _ in range(80)) for _ in range(300)] + ["<|startoftext|> a <|endoftext|>", ""]
    assert count(texts) == [len(slow.encode(t, add_special_tokens=False).ids) for t in texts]


# LM scoring


def naive_log10(counts: list[dict], data: bytes) -> float:
    """Prediction by partial matching from counts[k][context][symbol], one symbol at a time."""
    total, order = 0.0, len(counts) - 1
    for i in range(order, len(data)):
        excluded: set = set()
        for k in range(order, -1, -1):
            own = counts[k].get(data[i - k : i], {})
            rest = {s: n for s, n in own.items() if s not in excluded}
            if data[i] in rest:
                total += math.log10(rest[data[i]] / (sum(rest.values()) + len(rest)))
                break
            if rest:
                total += math.log10(len(rest) / (sum(rest.values()) + len(rest)))
                excluded |= set(rest)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("nodes", [None, 300])
def test_scores_by_hand(spark, nodes):
    long = prose(random.Random(4), 9000, 10**6)  # 60 kB
    rows = [(i, t) for i, t, _ in LONG if i != 10**6] + [(10**6, long), (10**6, long), (10**6 + 3, long), (777, None), (778, ""), (778, ""), (None, "no id"), (4, "another text of a shared id")]
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    held_out = F.coalesce(classifier.remainder() != 1, F.lit(True))
    got = lm_scoring.lm_scores(docs, docs.where(held_out), nodes=nodes, frequent=20).collect()
    assert len(got) == len(rows)
    order, pad = lm_scoring.ORDER, b"\n" * lm_scoring.ORDER
    strings: Counter = Counter()
    for t in train:
        data = pad + lm_scoring.canon((t or "").encode()) + b"\n"
        for i in range(order, len(data)):
            for k in range(order + 1):
                strings[data[i - k : i + 1]] += 1
    sizes = sorted(strings.values(), reverse=True)
    least = 1 if nodes is None or len(sizes) <= nodes else sizes[nodes] + 1
    counts: list[dict] = [{} for _ in range(order + 1)]
    for s, n in strings.items():
        if n >= least:
            counts[len(s) - 1].setdefault(s[:-1], {})[s[-1]] = n
    c: Counter = Counter()
    for t in train:
        c.update([*words(t, lower=True), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        own = [*words(t, lower=True), None]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        score = naive_log10(counts, pad + lm_scoring.canon((t or "").encode()) + b"\n")
        want.append((str(i), len(own), sum(c[w] > 0 for w in own), n, round(base, 4), round(score, 2)))
    have = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 2)) for r in got]
    for a, b in zip(sorted(have), sorted(want), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-3 and abs(a[5] - b[5]) < 0.02 + 1e-5 * abs(b[5])


def test_no_string_is_left_out(spark):
    """More than 2^20 different strings, most of which occur once, score as all of them together say."""
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(250))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs, docs.where("doc_id >= 3")).collect()}
    order, pad = lm_scoring.ORDER, b"\n" * lm_scoring.ORDER
    counts: list[dict] = [{} for _ in range(order + 1)]
    for _, t in rows[3:]:
        data = pad + t.encode() + b"\n"
        for i in range(order, len(data)):
            for k in range(order + 1):
                own = counts[k].setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1
    assert sum(len(own) for level in counts for own in level.values()) > 1 << 20
    for i, t in rows[:6]:
        want = naive_log10(counts, pad + t.encode() + b"\n")
        assert abs(got[i] - want) < 1e-5 * abs(want)


def test_what_is_learned_grows_with_the_texts(spark):
    """Twice as many training texts, all new: more strings, and a lower code length for texts like the new ones."""
    rng = random.Random(6)
    words_ = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(4000)]
    rows = [(k, " ".join(rng.choice(words_[:2000] if k < 60 else words_[2000:]) for _ in range(300))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half, whole = ({r.doc_id: r.score for r in lm_scoring.lm_scores(docs.where("doc_id >= 110"), docs.where(f"doc_id < {n}")).collect()} for n in (60, 110))
    assert all(whole[i] > 0.6 * half[i] and whole[i] > half[i] + 100 for i in half)


def test_probabilities_sum_to_one():
    texts = [b"the cat sat on the mat", b"the dog sat", b"a cat and a dog"]
    top = lm_scoring.tallied(lm_scoring.grams(texts)[0])
    trie = lm_scoring.Trie([lm_scoring.tallied(top[0] & lm_scoring._low(k), top[1]) for k in range(1, lm_scoring.ORDER + 2)])
    for code in lm_scoring.grams([b"the cat zzz sat"])[0]:
        every = (code & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-5


def test_adaptive_code_is_shorter_for_repeated_text():
    assert lm_scoring.adaptive_bits(b"") == 8
    assert lm_scoring.adaptive_bits(b"abc abc abc abc abc abc abc abc") < 0.6 * lm_scoring.adaptive_bits(b"q8z x0v m3k w7j p2r y9t l4f b6d")


def test_lm_without_training_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, docs.where("false")).collect()}
    assert abs(got[1].score + 3 * math.log10(256)) < 1e-9 and got[2].n_known == 0 and got[1].train_tokens == 0
    assert lm_scoring.lm_scores(docs.where("false"), docs).count() == 0


def test_hashed_words_are_the_words():
    from tessera.llm.words import Words

    texts = [(t or "").encode() for _, t, _ in corpus()]
    found = Words(texts, lower=True)
    seen: dict = {}
    for k, text in enumerate(texts):
        own = text.lower().split()
        assert found.first[k + 1] - found.first[k] == len(own)
        for w, h in zip(own, found.hashes[found.first[k] : found.first[k + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
