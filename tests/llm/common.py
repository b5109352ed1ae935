from __future__ import annotations

import random

WS = b" \t\n\x0b\x0c\r"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose with exact and near copies, shared passages, short texts, nulls, odd characters."""
    rng = random.Random(seed)
    passage = prose(rng, 40, 10**6)
    out = []
    for k in range(n):
        kind = k % 12
        text: str | None = prose(rng, rng.randint(1, 120), 10**6)
        if kind == 3 and k > 12:
            text = out[rng.randrange(k)][1]
        elif kind in (4, 5) and k > 12:
            old = (out[rng.randrange(k)][1] or "").split(" ")
            for _ in range(max(1, len(old) // 60)):
                old[rng.randrange(len(old))] = "changed"
            text = " ".join(old)
        elif kind == 6:
            text = f"{text}\n{passage}\r\n{prose(rng, 10)}"
        elif kind == 7:
            text = [None, "", " \t\n ", "x", "Ünï ß 日本 😀\x0b\x0cend"][k // 12 % 5]
        elif kind == 8:
            text = "\n".join([prose(rng, 8, 10**6)] * 3 + ["a line of its own", "", "tail"])
        elif kind == 9:
            text = "The the THE " * 30
        elif kind == 10:
            text = f"it's <|endoftext|> {text} İstanbul 12½ — “q”"
        out.append((k * 3 + 1, text, rng.choice(["a", "b", "c", "é", "", None])))
    return out


def odd(spark, rows=None, clash=True):
    """The rows as a frame with further columns that have names which the operators use inside."""
    rows = corpus() if rows is None else rows
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if clash:
        from pyspark.sql import functions as F

        for name in ("n", "size", "u", "key", "keys", "row", "kept", "starts", "part", "score", "tokens", "hits", "rank", "whole", "digest", "id", "n_lines", "target", "copies", "low", "word"):
            df = df.withColumn(name, F.lit(f"own {name}"))
    return df


def very_long(rng: random.Random | None = None) -> str:
    rng = rng or random.Random(9)
    return prose(rng, 60_000, 10**6)
