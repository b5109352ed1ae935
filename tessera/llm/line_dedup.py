"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A text's lines are its \\n-split pieces without white space at their ends; lines without a word are passed over. Windows are
all runs of `run` consecutive lines, and shorter runs that hold `min_words` words or more. Of each window the smallest line
hash is selected as its fingerprint: equal windows select equal fingerprints at equal places, so every repeat of a window has
one in common (Schleimer et al., 2003), and about every second line is selected.

1. Positions of fingerprints, a row for each, are joined by hash; those that no other position has go.
2. A position that is left is extended to both sides, to each window that selects it: up to run - 1 lines before and after.
   Equal extensions meet by a digest of 128 bits and are compared with the first of them only, by (doc_id, position), so no
   pairs are made, however frequent a line or a passage is.
3. Matches that overlap or continue each other on either side merge to runs, and the lines of all but the first go.

Thus a line goes exactly if it lies in a run of `run` lines or more, or of `min_words` words or more, that also starts at an
earlier position. Rows of a common line or passage are spread over all tasks: what they are joined with is broadcast.

Defined cases: a null text counts as an empty one. Rows with a null id stay as they are. Rows with the same id and text
are one document: both stay, or lose the same lines. Lines that go take their \\n with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import let
from .shared import WORD, documents, repeated, stored

RUN = 3
MIN_WORDS = 50
_BLANK = " \t\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _places(lines: Column) -> Column:
    """Places, from 0, of the lines that have a word."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())


def positions(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag (a hash of the text), print and pos of each selected fingerprint (a line's hash and its place among those
    with a word), and windows: first line, number of lines and two digests of each window that selects it."""
    text = F.coalesce("text", F.lit(""))

    def of(lines: Column) -> Column:
        at = F.filter(lines, lambda line: line.rlike(WORD))
        own = F.transform(at, lambda x: let(F.btrim(x, F.lit(_BLANK)), lambda t: F.struct(F.xxhash64(t).alias("h"), F.xxhash64(F.lit(1), t).alias("g"), F.regexp_count(t, F.lit(WORD)).alias("n"))))
        return let(own, lambda x: let(_windows(x), lambda w: selected(x, w)))

    def _windows(x: Column) -> Column:
        """All windows of 1, 2, ... run lines by their first line; null where too few words are in a short one."""

        def window(i: Column, k: int) -> Column:
            rows = [x[i + j] for j in range(k)]
            least = F.array_min(F.array(*(F.struct(r["h"], (i + j).alias("p")) for j, r in enumerate(rows))))["p"]
            out = F.struct(i.alias("start"), F.lit(k).alias("length"), least.alias("p"), F.xxhash64(F.lit(k), *(r["h"] for r in rows)).alias("d1"), F.xxhash64(F.lit(-k), *(r["g"] for r in rows)).alias("d2"))
            words = rows[0]["n"]
            for r in rows[1:]:
                words = words + r["n"]
            return out if k == run else F.when(words >= min_words, out)

        def every(k: int) -> Column:
            return F.when(F.size(x) >= k, F.transform(F.sequence(F.lit(0), F.size(x) - k), lambda i: window(i, k)))

        return F.struct(*(every(k).alias(f"w{k}") for k in range(1, run + 1)))

    def selected(x: Column, w: Column) -> Column:
        def position(line: Column, p: Column) -> Column:
            near = [F.get(w[f"w{k}"], p - j) for k in range(1, run + 1) for j in range(k)]
            return F.struct(line["h"].alias("print"), p.alias("pos"), F.transform(F.filter(F.array(*near), lambda v: v["p"] == p), lambda v: v.dropFields("p")).alias("windows"))

        return F.filter(F.transform(x, position), lambda r: F.size(r["windows"]) > 0)

    return docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text).alias("tag"), F.inline(let(_lines(text), of)))


def repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tag and the windows (first line and number of lines) that repeat earlier ones."""
    found = stored(positions(docs, run, min_words), "line-prints")
    met = repeated(found, ["print"], F.col("doc_id"))
    extended = stored(met.select("doc_id", "tag", F.inline("windows")), "line-windows")
    extended = repeated(extended, ["d1", "d2"], F.struct("doc_id", "start"))
    later = extended.where(F.struct("doc_id", "start") > F.col("first"))
    return later.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "length")).alias("gone"))  # of one text: a few for each of its lines


def line_dedup(docs: DataFrame, run: int = RUN, counts: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the lines of later runs deleted from text, and (with counts) n_lines and n_deleted after its columns."""
    gone = repeats(docs, run, min_words).select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag"), "gone")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")
    joined = rows.join(gone.hint("shuffle_hash"), (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64(text) == F.col("gone_tag")), "left")

    def kept(lines: Column) -> Column:
        covered = F.array_distinct(F.flatten(F.transform("gone", lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1))))
        out = let(_places(lines), lambda at: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(covered, lambda p: at[p])))
        return F.transform(out, lambda i: lines[i])

    lines = _lines(text)
    done = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), let(lines, kept)))
    done = done.withColumn("text", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")))
    out = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    if counts:
        n = F.size(_lines(F.coalesce("row.text", F.lit("")))).cast("long")
        out += [n.alias("n_lines"), F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long").alias("n_deleted")]
    return done.select(*out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH lines AS (SELECT doc_id, k, l FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents)),
worded AS (SELECT doc_id, k, trim(l, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS l, len(regexp_extract_all(l, '{WORD}')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS p FROM lines WHERE regexp_matches(l, '{WORD}')),
ahead AS ({" UNION ALL ".join(
    f"SELECT doc_id, p, {k} AS length, concat_ws(chr(10), {', '.join(f'lead(l, {j}) OVER d' for j in range(k))}) AS g, {' + '.join(f'lead(n, {j}) OVER d' for j in range(k))} AS words, lead(p, {k - 1}) OVER d AS last FROM worded WINDOW d AS (PARTITION BY doc_id ORDER BY p)"
    for k in range(1, RUN + 1))}),
ranked AS (SELECT doc_id, p, length, row_number() OVER (PARTITION BY length, g ORDER BY doc_id, p) AS n FROM ahead WHERE last IS NOT NULL AND (length = {RUN} OR words >= {MIN_WORDS})),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + length)) AS p FROM ranked WHERE n > 1),
kept AS (SELECT doc_id, k, l FROM lines WHERE (doc_id, k) NOT IN (SELECT (doc_id, k) FROM worded JOIN gone USING (doc_id, p)))
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(len(string_split(coalesce(d.text, ''), chr(10))) - coalesce(x.n, 0) AS BIGINT) AS n_deleted, sha256(coalesce(x.t, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(l, chr(10) ORDER BY k) AS t FROM kept GROUP BY doc_id) x USING (doc_id)"""
