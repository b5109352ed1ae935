"""Quality rules as a bitmask ledger, in DataFrame expressions of one row only: no shuffle, no Python.

ledger() evaluates every rule once: the measurements of a document with one bit for each rule that it fails. Ledger stores
these rows as a table with the version of its rules, and opens a table that another session has stored. A policy is a mask
of bits with a version; decide() applies one to stored rows and ablations() tells, by aggregates of bitwise tests, what each
rule of a policy rejects, alone or with others, without seeing a text again. Rows of a ledger of other rules are refused.

Defined cases: a null text counts as an empty one, which has no words and fails "few_words". Rows with the same id each
get a row. Repeated words are found by sorting a text's own window hashes (of 64 bits, taken for the windows) with their
places, so a very long text takes n log n steps.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, WORD, documents, stored


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _repeat_words(found: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more."""

    def of(x: Column) -> Column:
        n = F.size(x)
        placed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(x[i], x[i + 1], x[i + 2]).alias("h"), i.alias("i")))
        return F.when(n < 4, F.lit(0)).otherwise(let(F.sort_array(placed), repeated))

    def repeated(s: Column) -> Column:
        def twice(a: Column, b: Column) -> Column:
            p, q = a["i"], b["i"]
            return F.when(b.isNotNull() & (a["h"] == b["h"]), F.array(p, p + 1, p + 2, q, q + 1, q + 2))

        both = F.zip_with(s, F.slice(s, 2, F.size(s)), twice)
        return F.size(F.array_distinct(F.flatten(F.filter(both, lambda t: t.isNotNull()))))

    return let(found, of)


@dataclass(frozen=True)
class Rule:
    """A named test of measurements, true for a document that fails."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 3 * word_chars"),
    Rule("repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", "100 * n_upper > 40 * word_chars"),
    Rule("exclamation", "100 * n_exclamations > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)


def mask_of(*names: str) -> int:
    return sum(1 << k for k, rule in enumerate(RULES) if rule.name in names)


#: Policies by version; a rule that a policy leaves out is still in the ledger.
POLICIES = {
    "base": mask_of("few_words", "repeated_words"),
    "v1": mask_of("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
    "v2": mask_of(*(rule.name for rule in RULES)),
}
CURRENT = "v2"


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and fail_bits of each row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    found = words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    measured = docs.select(
        "doc_id",
        F.size(found).cast("long").alias("n_words"),
        F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("lines"),
        _repeat_words(found).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
    )
    measured = measured.withColumns({"n_lines": F.col("lines.n"), "n_dup_lines": F.col("lines.n") - F.col("lines.d")}).drop("lines")
    bits = [F.expr(f"CASE WHEN {rule.fails} THEN {1 << k}L ELSE 0L END") for k, rule in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("fail_bits", total)


#: Of the rules and their order; a stored ledger carries it in each row.
RULES_VERSION = hashlib.sha256(json.dumps([(rule.name, rule.fails) for rule in RULES]).encode()).hexdigest()[:16]


class Ledger:
    """A stored ledger: a Parquet table of ledger() rows with the version of their rules."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None) -> Ledger:
        """Evaluates all rules once over docs(doc_id, text). path: where the table stays; without it, it goes with the session."""
        rows = ledger(docs).withColumn("rules", F.lit(RULES_VERSION))
        if path is None:
            return cls(stored(rows, "rule-ledger"))
        rows.write.parquet(path)
        return cls.open(docs.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        rows = spark.read.parquet(path)
        other = rows.where(F.col("rules") != RULES_VERSION).select("rules").first()
        if other:
            raise ValueError(f"the ledger is one of rules {other.rules}, not of {RULES_VERSION}")
        return cls(rows)

    def decide(self, policy: str | None = None) -> DataFrame:
        return decide(self.rows, policy or CURRENT).drop("rules")

    def ablations(self, policies: tuple[str, ...] | None = None) -> DataFrame:
        return ablations(self.rows, policies or tuple(POLICIES))


def decide(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with policy and kept."""
    return rows.withColumns({"policy": F.lit(policy), "kept": F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0})


def ablations(rows: DataFrame, policies: tuple[str, ...] = tuple(POLICIES)) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, that fail it alone, and that the policy keeps without it."""
    tests = []
    for policy in policies:
        mask = POLICIES[policy]
        for k, rule in enumerate(RULES):
            if mask >> k & 1:
                own = F.col("fail_bits").bitwiseAND(F.lit(mask))
                hit = F.count_if(own.bitwiseAND(F.lit(1 << k)) != 0)
                tests.append(F.struct(F.lit(policy).alias("policy"), F.lit(rule.name).alias("rule"), hit.alias("failed"), F.count_if(own == 1 << k).alias("failed_alone"), F.count_if(own.bitwiseAND(F.lit(mask ^ (1 << k))) == 0).alias("kept_without")))
    return rows.agg(F.array(*tests).alias("t")).select(F.inline("t"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Ledger.write(documents(spark, sf_dir)).decide()
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits")


def op3_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Ledger.write(documents(spark, sf_dir)).ablations()


_LEDGER_SQL = rf"""
WITH text AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM text),
windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice WHERE n > 1) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM text) WHERE regexp_matches(l, '{WORD}') GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS word_chars0,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_lines,
    CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclamations, coalesce(word_chars0, 0) AS word_chars
  FROM text JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
ledger AS (SELECT *, CAST({" | ".join(f"(CASE WHEN {rule.fails} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES))} AS BIGINT) AS fail_bits FROM measured)
"""
OP3_SQL = _LEDGER_SQL + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES["base"]} <> 0 AS base_failed, fail_bits & {POLICIES["base"] | POLICIES[CURRENT]} = 0 AS kept, fail_bits
FROM ledger"""
OP3_ABLATIONS_SQL = _LEDGER_SQL + " UNION ALL ".join(
    f"SELECT '{policy}' AS policy, '{rule.name}' AS rule, count(*) FILTER (fail_bits & {1 << k} <> 0) AS failed, count(*) FILTER (fail_bits & {mask} = {1 << k}) AS failed_alone, count(*) FILTER (fail_bits & {mask ^ (1 << k)} = 0) AS kept_without FROM ledger"
    for policy, mask in POLICIES.items()
    for k, rule in enumerate(RULES)
    if mask >> k & 1
)
