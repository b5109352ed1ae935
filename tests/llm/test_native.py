"""Quality rules, line dedup and mixing."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, quality_rules

from .common import corpus, odd, very_long, words


def against_sql(df, docs, sql):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841
    con.register("documents", documents)
    con.execute("CREATE TABLE d AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM documents")
    con.unregister("documents")
    con.execute("ALTER TABLE d RENAME TO documents")
    names = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, want))


def test_ledger(spark):
    docs = odd(spark, [*corpus(), (10**6, very_long(), "a"), (10**6, very_long(), "a"), (None, "x y z", None)])
    rows = quality_rules.decide(quality_rules.ledger(docs))
    base = F.col("fail_bits").bitwiseAND(F.lit(3)) != 0
    got = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")
    against_sql(got, docs, quality_rules.OP3_SQL)
    against_sql(quality_rules.ablations(quality_rules.ledger(docs)), docs, quality_rules.OP3_ABLATIONS_SQL)


def test_repeated_words_by_hand(spark):
    texts = ["a b c a b c", "a b c d a b c", "a a a", "a a a a", "", "x y z", "a b a b a"]
    rows = quality_rules.ledger(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert [r.n_repeat_words for r in rows.orderBy("doc_id").collect()] == [6, 6, 0, 4, 0, 0, 5]


def test_policies(spark):
    rows = quality_rules.ledger(spark.createDataFrame([(1, "good words " * 2), (2, " ".join(f"w{k}!" for k in range(60)))], "doc_id long, text string"))
    kept = {p: [r.kept for r in quality_rules.decide(rows, p).orderBy("doc_id").collect()] for p in quality_rules.POLICIES}
    assert kept == {"base": [False, True], "v1": [False, True], "v2": [False, False]}


def test_empty_tables(spark):
    docs = odd(spark, [])
    assert quality_rules.ledger(docs).count() == 0 and line_dedup.line_dedup(docs).count() == 0 and mixing.mix(docs).count() == 0 and mixing.mixed_rows(docs).count() == 0


def test_a_stored_ledger_needs_no_texts(spark, tmp_path):
    docs, path = odd(spark, [(1, "good words " * 2, "s"), (2, " ".join(f"w{k}!" for k in range(60)), "s"), (3, None, None)]), f"file://{tmp_path}/ledger"
    kept = quality_rules.Ledger.write(docs, path)
    again = quality_rules.Ledger.open(spark, path)
    assert "text" not in again.rows.columns and {r.rules for r in again.rows.collect()} == {quality_rules.RULES_VERSION}
    for policy in quality_rules.POLICIES:
        assert sorted(map(str, again.decide(policy).collect())) == sorted(map(str, quality_rules.decide(quality_rules.ledger(docs), policy).collect()))
    assert sorted(map(str, again.ablations().collect())) == sorted(map(str, kept.ablations().collect()))
    # decisions are those of the stored bits, whatever the texts say
    changed = again.rows.withColumn("fail_bits", F.lit(0).cast("long"))
    changed.write.parquet(f"{tmp_path}/changed")
    assert all(r.kept for r in quality_rules.Ledger.open(spark, f"{tmp_path}/changed").decide().collect())
    again.rows.withColumn("rules", F.lit("other")).write.parquet(f"{tmp_path}/old")
    with pytest.raises(ValueError, match="other"):
        quality_rules.Ledger.open(spark, f"{tmp_path}/old")


def repeated_lines(rows, run=line_dedup.RUN, min_words=line_dedup.MIN_WORDS):
    """Texts after dedup, by brute force."""
    blank = " \t\x0b\x0c\r"
    split = {i: (t or "").split("\n") for i, t in rows}
    worded = {i: [(k, x.strip(blank)) for k, x in enumerate(lines) if words(x)] for i, lines in split.items()}
    seen, out = set(), {}
    for i in sorted(split):
        gone = set()
        for p in range(len(worded[i])):
            for n in range(1, run + 1):
                window = tuple(x for _, x in worded[i][p : p + n])
                if len(window) < n or (n < run and sum(len(words(x)) for x in window) < min_words):
                    continue
                if window in seen:
                    gone |= {k for k, _ in worded[i][p : p + n]}
                seen.add(window)
        out[i] = "\n".join(x for k, x in enumerate(split[i]) if k not in gone)
    return out


def test_line_dedup(spark):
    block = "one line\n  second line \r\n\nthird line\nfourth"
    long, half = " ".join(f"p{k}" for k in range(60)), " ".join(f"q{k}" for k in range(30))
    rows = [(1, f"intro\n{block}\noutro"), (2, f"other\n{block}"), (3, f"{block}\n{block}"), (4, None), (5, ""), (6, "one line\nsecond line"), (7, "\n".join(["same"] * 9)), (8, "\n".join(["same"] * 2)), (9, "\n".join(f"l{k % 400}" for k in range(3000)))]
    rows += [(10, f"a\n{long}\nb"), (11, long), (12, f"x {long}\n  {long}\t\ny"), (13, f"c\n{half}\n{half} d\ne"), (14, f"{half}\n \n{half} d"), (15, half), (16, f"e\n{half}\nf"), (17, " ".join(["w"] * 49)), (18, " ".join(["w"] * 49)), (19, " ".join(["w"] * 50)), (20, " ".join(["w"] * 50))]
    docs = odd(spark, [(i, t, "s") for i, t in rows])
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_deleted"]
    got = {r[0]: r[1] for r in line_dedup.line_dedup(docs, counts=False).select("doc_id", "text").collect()}
    assert {i: t or "" for i, t in got.items()} == repeated_lines(rows) and got[4] is None
    assert got[11] == got[14].strip() == got[20] == "" and got[15] == half and got[18] == rows[17][1]
    against_sql(line_dedup.line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")), docs, line_dedup.OP8_SQL)


@pytest.mark.parametrize("seed,run,min_words", [(1, 3, 50), (2, 2, 3), (3, 4, 6), (4, 1, 9)])
def test_random_lines(spark, seed, run, min_words):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(1, 4))) for _ in range(12)] + ["", " "]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(150)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(odd(spark, [(i, t, "s") for i, t in rows]), run, counts=False, min_words=min_words).select("doc_id", "text").collect()}
    assert got == repeated_lines(rows, run, min_words)


def test_only_selected_positions_are_joined(spark):
    """A row for each window minimum, and each window at one position only."""
    text = "\n".join(f"line {k * 7919 % 1000}" for k in range(400))
    rows = line_dedup.positions(odd(spark, [(1, text, "s")])).collect()
    assert sum(len(r.windows) for r in rows) == 398 and 150 < len(rows) < 260
    assert all(w.start <= r.pos < w.start + w.length for r in rows for w in r.windows)


def test_a_third_of_all_rows_share_a_line_and_a_null_id(spark):
    rows = [(k, f"own {k}\n" + "common\nof\nall", "s") for k in range(200)] + [(None, "common\nof\nall", "s")] * 100
    docs = odd(spark, rows)
    met = line_dedup.repeats(docs)
    assert met.count() == 199 and {len(r.gone) for r in met.collect()} == {1}
    got = line_dedup.line_dedup(docs, counts=False).groupBy("text").count().collect()
    assert {r.text: r["count"] for r in got} == {f"own {k}": 1 for k in range(1, 200)} | {rows[0][1]: 1, rows[-1][1]: 100}
    sizes = line_dedup.positions(docs).withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(4))).groupBy("part").count().collect()
    assert max(r["count"] for r in sizes) < 2 * min(r["count"] for r in sizes)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    text = "a a\nb b\nc c"
    docs = odd(spark, [(1, text, "s"), (1, text, "s"), (None, text, "s"), (2, text, "s"), (2, "z\n" + text, "s")])
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(docs, counts=False).select("doc_id", "text").collect())
    assert got == [("1", text), ("1", text), ("2", ""), ("2", "z"), ("None", text)]


def test_hot_keys_are_joined_without_being_dealt_by_key(spark):
    from tessera.llm.shared import repeated, spread_join, stored

    rows = [("hot", k) for k in range(400)] + [(f"k{k % 300}", 1000 + k) for k in range(600)] + [("once", -1)]
    df = stored(spark.createDataFrame(rows, "key string, v long"), "test")
    table = df.groupBy("key").agg(F.max("v").alias("most"))
    got = spread_join(df, table, ["key"])
    assert sorted(map(tuple, got.collect())) == sorted((k, v, max(w for x, w in rows if x == k)) for k, v in rows)
    met = repeated(df, ["key"], F.col("v"))
    assert sorted(map(tuple, met.select("key", "v", "first").collect())) == sorted((k, v, min(w for x, w in rows if x == k)) for k, v in rows if k != "once")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # the rows of the hot key come by the broadcast, from as many tasks as read the table
    hot = met.where("key = 'hot'").withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(hot) > 1 and sum(r["count"] for r in hot) == 400


def test_tables_on_the_way_are_deleted(spark):
    from tessera.llm import shared

    kept = shared.stored(spark.range(3), "kept")

    def make():
        way = shared.stored(kept.where("id > 0"), "way")
        make.way = way
        return way.where("id > 1")

    out = shared.settled(make, "out")
    assert out.count() == 1 and kept.count() == 3
    assert make.way.stored_at not in shared._places and {kept.stored_at, out.stored_at} <= shared._places
    shared.discard(kept, out)


def by_hand(total: dict, weights=(1, 2, 3), most=3):
    order = sorted((s for s in total if s is not None), key=str) + ([None] if None in total else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(total.values()) - sum(most * total[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: float(most * total[s]) for s in capped} | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > most * total[s] + 1e-9}
        if not over:
            return target
        capped |= over


def taken_by_hand(rows, target, most=3, tilt=mixing.TILT):
    """Copies by Pareto's order from rows of (source, size, u), each source sorted as a whole: copies of each row's key."""
    out = Counter()
    for source in {r[0] for r in rows}:
        own = [(size, u) for s, size, u in rows if s == source]
        words = defaultdict(int)
        for size, _ in own:
            words[max(size, 1)] += size
        octave = {size: math.floor(4 * math.log2(max(size, 1))) for size, _ in own}
        weight = {size: 2.0 ** (octave[size] * tilt / 4) for size in octave}
        capped: set = set()
        while True:
            rest = sum(size * weight[size] for size, _ in own if octave[size] not in capped)
            left = target[source] - sum(most * size for size, _ in own if octave[size] in capped)
            scale = left / rest if rest else 0.0
            over = {octave[size] for size, _ in own if octave[size] not in capped and scale * weight[size] > most}
            if not over:
                break
            capped |= over
        if not target[source]:
            continue
        expected = {size: most if octave[size] in capped else min(most, scale * weight[size]) for size in octave}
        whole = {size: math.floor(e + 1e-12) for size, e in expected.items()}
        left = target[source] - sum(whole[size] * size for size, _ in own)
        ranked = []
        for size, u in own:
            out[source, size, u] += whole[size]
            p = expected[size] - whole[size]
            if p > 1e-12:
                x = (u + 0.5) / 2**53
                ranked.append(((x / (1 - x)) * ((1 - p) / p), size, u))
        total = 0
        for _, size, u in sorted(ranked):
            if total + size / 2 <= left:
                out[source, size, u] += 1
            elif size:
                break
            total += size
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rows = [(i, t, s) for i, t, s in corpus(seed, 200)]
    if seed == 2:  # a small source in front, capped, and a hot one
        rows = [(i, t, "a" if i < 4 else "z" if i % 2 else s) for i, t, s in rows]
    docs = odd(spark, rows)
    got = mixing.mix(docs, seed=seed).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), seed=seed).collect()))
    total: dict = {}
    taken: dict = {}
    largest: dict = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r.size)
        assert 0 <= r.copies <= 3
    size = {i: len(words(t)) for i, t, _ in rows}
    assert all(r.size == size[r.doc_id] for r in got) and len(got) == len(rows)
    target = by_hand(total)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == total[r.source]
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    mixed = mixing.mixed_rows(docs, seed=seed)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})
    # the very rows that a whole sort of Pareto's ranks takes
    sized = mixing.sizes(docs, seed).collect()
    want = taken_by_hand([(r.source, r.size, r.u) for r in sized], target)
    key = {r.doc_id: (r.source, r.size, r.u) for r in sized}
    wrong = [r for r in got if r.size and r.copies != want[key[r.doc_id]]]
    assert not wrong


def test_longer_documents_have_better_chances(spark):
    rows = [(k, "w " * (4 if k % 2 else 64), "a" if k % 4 < 2 else "b") for k in range(4000)]
    got = mixing.mix(odd(spark, rows, clash=False), weights=(1, 3), tilt=0.5).where("source = 'a'").groupBy("size").agg(F.avg("copies").alias("p"), F.max("copies").alias("most")).collect()
    p = {r["size"]: r.p for r in got}
    assert {r.most for r in got} == {1} and abs(p[64] / p[4] - 4) < 1.2


def test_shared_ids_do_not_stay_together(spark):
    rows = [(None, "a b c d e", "s")] * 100 + [(k, "a b c d e", "t") for k in range(300)] + [(7, f"a b c d {k}", "u") for k in range(90)]
    for docs in (odd(spark, rows, clash=False), odd(spark, rows, clash=False).repartition(7)):
        for source, mixed in ((r.source, r) for r in mixing.mix(docs).groupBy("source").agg(F.sum(F.expr("size * copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.count(F.lit(1)).alias("n")).collect()):
            assert abs(mixed.taken - mixed.target) <= 2.5 and mixed.most <= 3 and mixed.n == Counter(s for _, _, s in rows)[source]
        assert abs(mixing.mixed_rows(docs).where("source = 's'").count() * 5 - mixing.mix(docs).where("source = 's'").first().target) <= 2.5


def test_mix_edge_cases(spark):
    assert [tuple(r) for r in mixing.mix(odd(spark, [(1, None, "a"), (2, "", None)])).orderBy("doc_id").collect()] == [(1, "a", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]
    (r,) = mixing.mix(odd(spark, [(1, "a b", None)])).collect()
    assert (r.target, r.copies) == (2.0, 1)
    twice = mixing.mix(odd(spark, [(1, "a b", "s")] * 4 + [(None, "c d", "s"), (2, very_long(), "t")])).collect()
    assert len(twice) == 6
