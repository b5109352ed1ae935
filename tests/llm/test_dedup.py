"""N-gram join and substring dedup."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ngram_join, substring_dedup
from tessera.llm.ngram_join import ngram_components, ranked_first, similar, tree_links
from tessera.llm.tidying import packed, squeezed, unpacked, unsqueezed

from .common import corpus, odd, very_long, words


def shingles(text, n):
    w = words(text, lower=True)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, percent):
    """The smallest id that each id's text reaches by links; rows with a null id are left out."""
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b in range(a):
            y = sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                label[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: least[find(k)] if x else i for k, (i, x) in enumerate(sets)}


@pytest.mark.parametrize("n,percent,seed", [(4, 85, 1), (5, 80, 2), (1, 80, 3)])
def test_components(spark, n, percent, seed):
    rows = corpus(seed, 150)
    got = ngram_components(odd(spark, rows), n, percent).collect()
    want = components([(i, t) for i, t, _ in rows], n, percent)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    size = {i: len(shingles(t, n)) for i, t, _ in rows}
    assert all(r.n_shingles == size[r.doc_id] for r in got)
    assert len(set(want.values())) < len(want)


def test_chains_of_near_copies_through_small_trees(spark):
    """Each text is near the next only; trees of few tokens make several parts of a block."""
    rng = random.Random(4)
    base = [f"t{rng.random()}" for _ in range(60)]
    rows = []
    for k in range(40):
        base = base.copy()
        base[rng.randrange(60)] = f"t{rng.random()}"
        rows.append((k, " ".join(base)))
    rng.shuffle(rows)
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    want = components(rows, 1, 80)
    for tokens in (4_000_000, 500):
        assert {r.doc_id: r.component_id for r in ngram_components(docs, 1, 80, tree_tokens=tokens).collect()} == want


def test_trees_decide(spark, monkeypatch):
    """Pairs that meet only in groups with a third set, like neither, which is often the group's first: only trees find them."""
    rng = random.Random(4)
    pool = [f"c{k}" for k in range(100)]
    rows = []
    for k in range(30):
        met, common = [f"t{k}", f"u{k}"], rng.sample(pool, 8)
        rows += [(3 * k, [f"a{k}", *met, *common]), (3 * k + 1, [f"b{k}", *met, *common]), (3 * k + 2, [*met, *rng.sample(pool, 9)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: r.component_id for r in ngram_components(docs, 1, 80).collect()}
    assert got == components(rows, 1, 80) == {i: i - (i % 3 == 1) for i, _ in rows}
    monkeypatch.setattr(ngram_join, "_trees", lambda percent: lambda batches: iter(()))
    lost = {r.doc_id: r.component_id for r in ngram_components(docs, 1, 80).collect()}
    assert sum(lost[i] != got[i] for i in got) > 3


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_just_at_the_threshold(spark, percent):
    """Pairs of sets whose similarity is the threshold exactly, or one token less, of many sizes, with common tokens that others have too."""
    rng = random.Random(percent)
    common = [f"common{k}" for k in range(50)]
    rows, want = [], {}
    for k in range(160):
        n = rng.randint(5, 120)
        union = rng.sample(common, min(n // 2, 30)) + [f"p{k}x{j}" for j in range(n)]
        shared = -(-percent * len(union) // 100)
        if k % 2:
            shared = (percent * len(union) - 1) // 100
        cut = rng.randint(0, len(union) - shared)
        rng.shuffle(union)
        a, b = union[: shared + cut], union[:shared] + union[shared + cut :]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want[2 * k], want[2 * k + 1] = 2 * k, 2 * k + (k % 2)
    got = {r.doc_id: r.component_id for r in ngram_components(odd(spark, [(i, t, "s") for i, t in rows]), 1, percent).collect()}
    assert got == want == components(rows, 1, percent)


def test_no_similar_set_does_without_its_first_shingles():
    for percent in (50, 80, 85, 100):
        for n in range(1, 300):
            least = -(-percent * n // 100)  # common tokens with any similar set
            assert ranked_first(n, percent) + least == n + 1


def test_a_third_of_all_rows_are_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(120):
        own = base.copy()
        own[rng.randrange(100)] = f"own{k}"
        rows.append((k + 1000, " ".join(own)))
    rows += [(k + 2000, rows[0][1]) for k in range(60)] + [(k, " ".join(f"z{k}x{j}" for j in range(60))) for k in range(200)]
    rows += [(5000, " ".join(base[:80] + [f"far{j}" for j in range(12)])), (5001, " ".join(base[:84] + [f"far{j}" for j in range(20)]))]
    got = {r.doc_id: r.component_id for r in ngram_components(odd(spark, [(i, t, "s") for i, t in rows]), 2, 80, tree_tokens=900).collect()}
    assert got == components(rows, 2, 80) and sum(c == 1000 for c in got.values()) >= 180


def test_odd_rows(spark):
    long = very_long()
    rows = [(5, long, "s"), (6, long + " more", "s"), (7, None, "s"), (8, "", "s"), (None, long, "s"), (5, long, "s"), (9, "a b", "s"), (3, "A B", "s"), (9, long, "s")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_components(odd(spark, rows), 5, 80).collect())
    # the two texts with id 9 are two documents
    assert got == [("3", "3"), ("5", "5"), ("5", "5"), ("6", "5"), ("7", "7"), ("8", "8"), ("9", "3"), ("9", "5"), ("None", "None")]
    assert ngram_components(odd(spark, []), 5, 80).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_trees_find_what_all_pairs_find(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(90):
        if sets and rng.random() < 0.6:
            old = sets[rng.integers(len(sets))]
            keep = old[rng.random(len(old)) < rng.choice([0.99, 0.93, 0.85])]
            new = rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64) * np.uint64(2)
            sets.append(np.unique(np.append(keep, new)))
        else:
            sets.append(np.unique(rng.integers(0, 2**64, rng.integers(1, 200), dtype=np.uint64)))
    sets = [s for s in sets if len(s)]
    for cut in (None, 40):
        groups = np.arange(len(sets)) if seed % 2 else rng.integers(0, len(sets) // 2, len(sets))
        links = tree_links(sets if cut is None else sets[:cut], None if cut is None else sets[cut:], groups, 80)

        def joined(pairs):
            label = groups.copy()
            for a, b in pairs:
                label[label == label[b]] = label[a]
            return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

        all_pairs = [(a, b) for a in range(len(sets)) for b in range(a) if (cut is None or (a >= cut) != (b >= cut)) and similar(sets[a], sets[b], 80)]
        assert joined(links) == joined(all_pairs) and all(similar(sets[a], sets[b], 80) for a, b in links)


def test_bitmaps_take_no_more_than_the_sets():
    """One very long set beside many short ones."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in [60_000, *[20] * 3000]]
    widths = []
    real = ngram_join.SignatureTree.__init__

    def noted(self, own, width, levels):
        widths.append((1 << width) // 8 * len(own) / sum(map(len, own)))
        real(self, own, width, levels)

    ngram_join.SignatureTree.__init__ = noted
    try:
        assert tree_links(sets, None, np.arange(len(sets)), 80) == []
    finally:
        ngram_join.SignatureTree.__init__ = real
    assert max(widths) <= 2  # bytes of bitmap for each token, of 8 bytes


def removed(rows, n=13):
    """(n_words, n_removed, digest) of each row, by brute force."""
    first: dict = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((str(i), len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return sorted(out)


@pytest.mark.parametrize("seed,window,most,hot", [(1, 13, 4000, 10_000), (2, 13, 3, 1), (3, 6, 50, 4), (4, 5, 2, 10_000)])
def test_substrings(spark, seed, window, most, hot):
    rows = [(i, t, s) for i, t, s in corpus(seed, 120)]
    rows += [(1, rows[20][1], "s"), (None, rows[3][1], "s"), (10**9, very_long() + " " + (rows[5][1] or ""), "s"), (10**9 + 1, very_long(), "s"), (10**9 + 1, very_long(), "s")]
    got = substring_dedup.substring_dedup(odd(spark, rows), window, shard_passages=most, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == removed([(i, t) for i, t, _ in rows], window)
    assert sum(r.n_removed for r in got) > 1000


def test_phrases_merge_windows_and_lose_none():
    texts = [("abcdefgh", 1, 5), ("xbcdefgy", 2, 2), ("bcde", 7, 7), ("aaaaaaa", 3, 4), ("zzzzz", 6, 6)]
    automaton = substring_dedup.phrases(texts, 3)
    found = {text: sorted({(end - n + 1 + k, low) for end, (n, low) in automaton.iter(text) for k in range(n - 2)}) for text, _, _ in texts}
    first, last = {}, {}
    for text, low, high in texts:
        for k in range(len(text) - 2):
            w = text[k : k + 3]
            first[w], last[w] = min(first.get(w, low), low), max(last.get(w, high), high)
    assert found == {t: [(k, first[t[k : k + 3]]) for k in range(len(t) - 2) if first[t[k : k + 3]] < last[t[k : k + 3]]] for t, _, _ in texts}


def test_empty(spark):
    assert substring_dedup.substring_dedup(odd(spark, [])).count() == 0


def test_ranks_of_blocks():
    """Shingles that several units have, some of them very often, get the quarter octave of all their sets."""
    rng = np.random.default_rng(3)
    blocks, total = [], {}
    for unit in range(60):
        own = np.unique(np.append(rng.integers(0, 2**32, 40, dtype=np.uint32), np.array([0, 7, 2**32 - 1], np.uint32)))
        n = rng.integers(1, 256, len(own)).astype(np.uint8)
        n[own == 7] = 255
        n[own == 0] = 1
        blocks.append((unit, own, n))
        for x, c in zip(own.tolist(), n.tolist(), strict=True):
            total[x] = total.get(x, 0) + c
    rows = ngram_join._rows(
        1, unit=pa.array([u for u, _, _ in blocks]), part=pa.array([5] * len(blocks)),
        shingles=pa.array([packed(x) for _, x, _ in blocks], pa.binary()), counts=pa.array([squeezed(n.tobytes()) for _, _, n in blocks], pa.binary()),
    )
    (out,) = ngram_join._ranks(iter([rows]))
    assert out.column("unit").to_pylist() == [u for u, _, _ in blocks] and total[7] > 4096
    for (_, own, _), blob in zip(blocks, out.column("counts").to_pylist(), strict=True):
        assert np.frombuffer(unsqueezed(blob), np.uint8).tolist() == [int(4 * np.log2(total[x])) for x in own.tolist()]
    for x in (np.zeros(0, np.uint32), np.array([0], np.uint32), np.sort(rng.integers(0, 2**32, 500, dtype=np.uint32))):
        assert np.array_equal(unpacked(packed(x)), x)
