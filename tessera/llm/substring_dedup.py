"""Substring dedup by repeated-phrase automata: every occurrence of a window of `window` words that also starts in an earlier
document is located, and the words it covers are removed.

1. Recurring anchors. A window's anchor is the smallest hash of its runs of ANCHOR words, so equal windows have equal
   anchors, and consecutive windows mostly share one. Anchors that two or more documents have are marked in a bit field of
   fixed size (`filter_bits`), which is broadcast. It only lets windows through that cannot recur, never the reverse.
2. Confirmed passages. Consecutive windows of one anchor are one passage: at most window + (window - ANCHOR) words.
   A batch's different passages come once, with the smallest and largest id of their documents (so that a frequent
   passage is one row of a batch), to the shard that their anchor belongs to. There all windows of an anchor meet; those of
   two or more documents are confirmed, each with its first document. Windows whose anchor `hot` or more documents have,
   as a common turn of words does, are passages of their own and meet by the hash of all their words instead, so that no
   shard grows with an anchor; these anchors are marked in a second bit field.
3. Automata. Each shard, of about `shard_passages` passages, writes its words as single characters. Confirmed windows that
   follow each other wherever they occur, and have one first document, are one phrase. The phrases are compiled into one
   Aho-Corasick automaton, which locates them in each of the shard's passages.
4. Occurrences. Where each document has a passage is joined to the phrases located in it (a join that adaptive execution
   may split for frequent passages) and gathered for each document, whose words are removed in one go. Only documents that
   may have any are shuffled for that; a bit field of their ids, of fixed size, tells.

Windows are judged on the input. Defined cases: a null text has no words. Rows with a null id stay whole and are nobody's
first document. Rows with the same id are one document: what they share with each other stays. Words are bytes between
ASCII white space; kept words are joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .idfield import id_field, maybe_in
from .shared import WORD, documents, parts, stored
from .tidying import tidied
from .words import Words, binary, chunks, mix

WINDOW = 13
ANCHOR = 4
FILTER_BITS = 27
SHARD_PASSAGES = 4000
HOT = 10_000
HOT_BITS = 22
_U = np.uint64


def anchors(found: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of the texts' words, and which windows lie in one text."""
    runs, _ = found.windows(ANCHOR)
    n = len(found.hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    span, have = window - ANCHOR + 1, 1
    while 2 * have <= span:
        runs = np.minimum(runs[:-have], runs[have:])
        have *= 2
    if have < span:
        runs = np.minimum(runs[: len(runs) - (span - have)], runs[span - have :])
    text = np.repeat(np.arange(found.size), np.diff(found.first))
    return runs, text[:n] == text[window - 1 :]


def _spread(window: int, n_parts: int):
    """A batch's different anchors as a block for each part: 32 bits of each, how many of the batch's documents have it, and
    whether two of these have different ids."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for begin, own in chunks(binary(batch.column("text"))):
                found = Words(own)
                anchor, inside = anchors(found, window)
                text = np.repeat(np.arange(found.size), np.diff(found.first))[: len(anchor)] + begin
                new = inside & np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[: len(anchor)]
                keys.append(anchor[new])
                docs.append(ids[text[new]].astype(np.int64))
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(key, kind="stable")
            key, doc = key[order], doc[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
            times = np.minimum(np.diff(np.append(first, len(key))), 2**16 - 1).astype(np.uint16)
            key = key[first]
            part = (key >> _U(32)) % _U(n_parts)
            order = np.argsort(part, kind="stable")
            used, start = np.unique(part[order], return_index=True)
            spans = np.split(order, start[1:]) if len(used) else []
            short = key.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int64)), *(pa.array([x.tobytes() for x in blocks], pa.binary()) for blocks in ([short[s] for s in spans], [times[s] for s in spans], [np.packbits(several[s]) for s in spans]))],
                ["part", "anchors", "times", "several"],
            )

    return run


def _bit(low: np.ndarray, part: np.ndarray | int, bits: int) -> np.ndarray:
    return mix(low.astype(np.uint64) + (np.asarray(part).astype(np.uint64) << _U(32))) >> _U(64 - bits)


def _marks(at: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of a bit field, from `base` on, that these bits set."""
    word, mask = (at >> _U(6)).astype(np.int64) + base, _U(1) << (at & _U(63))
    order = np.argsort(word, kind="stable")
    word, mask = word[order], mask[order]
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    return word[first], np.bitwise_or.reduceat(mask, first) if len(first) else mask


def _recurring(bits: int, hot: int):
    """Sorted by part: the words of the bit fields that a part's recurring and hot anchors set."""

    def of(part: int, blocks: list[tuple]) -> pa.RecordBatch:
        low, times, several = (np.concatenate([b[k] for b in blocks]) for k in range(3))
        order = np.argsort(low, kind="stable")
        low, times, several = low[order], times[order].astype(np.int64), several[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1])) if len(low) else np.zeros(0, np.int64)
        if not len(first):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["word", "bits"])
        again = (np.diff(np.append(first, len(low))) > 1) | np.logical_or.reduceat(several, first)
        many = np.add.reduceat(times, first) >= hot
        marks = [_marks(_bit(low[first[again]], part, bits), 0), _marks(_bit(low[first[many]], part, HOT_BITS), 1 << (bits - 6))]
        word, value = (np.concatenate([m[k] for m in marks]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in batches:
            for p, raw, times, flags in zip(*(batch.column(c).to_pylist() for c in ("part", "anchors", "times", "several")), strict=True):
                if p != part and blocks:
                    yield of(part, blocks)
                    blocks = []
                part = p
                low = np.frombuffer(raw, np.uint32)
                blocks.append((low, np.frombuffer(times, np.uint16), np.unpackbits(np.frombuffer(flags, np.uint8), count=len(low)).astype(bool)))
        if blocks:
            yield of(part, blocks)

    return run


def recurring_anchors(docs: DataFrame, window: int, bits: int, hot: int) -> np.ndarray:
    """The bit field of anchors that two or more documents have, and after it that of hot anchors."""
    n = parts(docs.sparkSession)
    spread = docs.mapInArrow(_spread(window, n), "part long, anchors binary, times binary, several binary")
    found = spread.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_recurring(bits, hot), "word long, bits long")
    # at most (2**bits + 2**HOT_BITS) / 64 rows come to the driver
    table = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros((1 << (bits - 6)) + (1 << (HOT_BITS - 6)), np.uint64)
    field[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return field


def _passages(field, n_parts: int, window: int, bits: int, with_text: bool):
    """anchor and key of each passage, with (with_text) low and high, the smallest and largest id of a batch's documents that
    have it, and its text, once, or (otherwise) each document, its text's tag and the place of the first word."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = field.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = binary(batch.column("text"))
            found_all: list[list] = [[], [], [], []]
            for begin, own in chunks(texts):
                found = Words(own)
                anchor, inside = anchors(found, window)
                if not len(anchor):
                    continue
                low, part = anchor.astype(np.uint32), (anchor >> _U(32)) % _U(n_parts)
                at = _bit(low, part, bits)
                inside &= (marked[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
                at = _bit(low, part, HOT_BITS)
                hot = (marked[(at >> _U(6)).astype(np.int64) + (1 << (bits - 6))] >> (at & _U(63)) & _U(1)).astype(bool)
                text = np.repeat(np.arange(found.size), np.diff(found.first))
                joined = inside[1:] & inside[:-1] & ~hot[1:] & (anchor[1:] == anchor[:-1]) & (text[1 : len(anchor)] == text[: len(anchor) - 1])
                first = np.flatnonzero(inside & ~np.append(False, joined))
                last = np.flatnonzero(inside & ~np.append(joined, False))
                # the key hashes all words of the passage: sums over prefixes of each word's hash by its place in the text
                length = last - first + window
                prefix = np.zeros(len(found.hashes) + 1, np.uint64)
                power, inverse = _key_powers(len(found.hashes))
                np.cumsum(found.hashes * power, out=prefix[1:])
                key = mix((prefix[first + length] - prefix[first]) * inverse[first] + length.astype(np.uint64))
                owner = text[first]
                doc = ids[owner + begin]
                meets = np.where(hot[first], key, anchor[first])
                if with_text:
                    raw = found.buf.tobytes()
                    begins, ends = found.starts[first], found.ends[last + window - 1]
                    order, group = _grouped(meets, key)
                    rep = order[group]
                    spans = zip(begins[rep].tolist(), ends[rep].tolist(), strict=True)
                    low, high = (f.reduceat(doc[order], group) if len(group) else doc for f in (np.minimum, np.maximum))
                    for part, new in zip(found_all, (meets[rep], key[rep], np.stack([low, high]), [b" ".join(raw[a:b].split()) for a, b in spans]), strict=True):
                        part.append(new)
                    continue
                tags = np.array([xxhash.xxh64_intdigest(t) for t in own], np.uint64).view(np.int64)
                start = (first - found.first[owner]).astype(np.int32)
                columns = [pa.array(x) for x in (meets.view(np.int64), key.view(np.int64), doc, tags[owner], start)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "doc_id", "tag", "start"])
            if found_all[0]:
                anchor, key, docs = np.concatenate(found_all[0]), np.concatenate(found_all[1]), np.concatenate(found_all[2], axis=1)
                passage = [x for part in found_all[3] for x in part]
                order, group = _grouped(anchor, key)
                rep = order[group]
                low, high = (f.reduceat(d[order], group) if len(group) else d for f, d in ((np.minimum, docs[0]), (np.maximum, docs[1])))
                columns = [pa.array(anchor[rep].view(np.int64)), pa.array(key[rep].view(np.int64)), pa.array(low), pa.array(high), pa.array([passage[k] for k in rep.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "key", "low", "high", "passage"])

    return run


def _grouped(anchor: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (anchor, key) together, and where each group begins."""
    order = np.lexsort((key, anchor))
    a, k = anchor[order], key[order]
    return order, np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (k[1:] != k[:-1]))) if len(a) else np.zeros(0, np.int64)


_powers: list[np.ndarray] = []


def _key_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        base = 0xD6E8FEB86659FD93
        _powers[:] = [np.cumprod(np.append(_U(1), np.full(max(n, 1 << 19), b, np.uint64))) for b in (base, pow(base, -1, 2**64))]
    return _powers[0][:n], _powers[1]


def phrases(passages: list[tuple[str, int, int]], window: int) -> ahocorasick.Automaton:
    """The automaton of the windows, written as characters, that two documents of passages(text, low, high) have.

    A phrase's value is its length and the smallest id that has it.
    """
    seen: dict[str, list] = {}
    for text, low, high in passages:
        before = ""
        for i in range(len(text) - window + 1):
            w, after = text[i : i + window], text[i + window : i + window + 1]
            own = seen.get(w)
            if own is None:
                seen[w] = [low, high, before, after]
            else:
                own[0], own[1] = min(own[0], low), max(own[1], high)
                if own[2] != before:
                    own[2] = ""
                if own[3] != after:
                    own[3] = ""
            before = text[i]
    out = ahocorasick.Automaton()
    for w, (low, high, before, after) in seen.items():
        if low >= high:
            continue
        if before:
            own = seen[before + w[:-1]]
            if own[3] == w[-1] and own[0] == low and own[1] > low:
                continue  # a phrase that begins before goes on here
        phrase = w
        while after:
            own = seen[phrase[1 - window :] + after]
            if own[0] != low or own[1] <= low or own[2] != phrase[-window]:
                break
            phrase, after = phrase + after, own[3]
        out.add_word(phrase, (len(phrase), low))
    if len(out):
        out.make_automaton()
    return out


def _locate(window: int, most: int):
    """Sorted by anchor and key: passages in shards of about `most`, to the phrases that an earlier document has, of each."""

    def shard(rows: list[list]) -> Iterator[tuple]:
        letters: dict[bytes, str] = {}  # surrogates are passed over: they are no characters
        coded = ["".join([letters.setdefault(w, chr(len(letters) + 1 if len(letters) < 0xD000 else len(letters) + 0x1000)) for w in row[4].split(b" ")]) for row in rows]
        automaton = phrases([(text, row[2], row[3]) for text, row in zip(coded, rows, strict=True)], window)
        if not len(automaton):
            return
        for (anchor, key, _, high, _), text in zip(rows, coded, strict=True):
            for end, (length, low) in automaton.iter(text):
                if low < high:
                    yield anchor, key, end - length + 1, length, low

    def out(rows: list[list]) -> pa.RecordBatch:
        found = list(zip(*shard(rows), strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, kinds, strict=True)], ["anchor", "key", "shift", "length", "first"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for anchor, key, low, high, passage in zip(*(batch.column(c).to_pylist() for c in ("anchor", "key", "low", "high", "passage")), strict=True):
                last = rows[-1] if rows else None
                if last and last[0] == anchor and last[1] == key and last[4] == passage:
                    last[2], last[3] = min(last[2], low), max(last[3], high)
                    continue
                if len(rows) >= most and last[0] != anchor:
                    yield out(rows)
                    rows = []
                rows.append([anchor, key, low, high, passage])
        if rows:
            yield out(rows)

    return run


def _remove(window: int, keep_text: bool, marked=None):
    """Words that stay, from the phrases located in each text; with `marked`, of rows whose id surely has none."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if marked is not None:
                batch = batch.filter(pa.array(~maybe_in(marked.value, batch.column("doc_id"))))
            n_words, n_removed, kept_texts, digests = [], [], [], []
            hits = batch.column("hits") if "hits" in batch.schema.names else pa.nulls(len(batch))
            for k, text in enumerate(binary(batch.column("text"))):
                words = text.split()
                n = len(words)
                removed = 0
                own = hits[k].as_py() if hits[k].is_valid and n >= window else None
                if own:
                    tag = int(np.array([xxhash.xxh64_intdigest(text)], np.uint64).view(np.int64)[0])
                    edge = np.zeros(n + 1, np.int64)
                    for hit in own:
                        if hit["tag"] == tag:
                            edge[hit["at"]] += 1
                            edge[hit["at"] + hit["length"]] -= 1
                    gone = np.cumsum(edge)[:n] > 0
                    removed = int(gone.sum())
                    if removed:
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
            )

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS, shard_passages: int = SHARD_PASSAGES, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and (with keep_text) the kept text of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    named = docs.where("doc_id IS NOT NULL")
    n = parts(spark)
    field = spark.sparkContext.broadcast(recurring_anchors(named, window, filter_bits, hot))
    passages = named.mapInArrow(_passages(field, n, window, filter_bits, True), "anchor long, key long, low long, high long, passage binary")
    passages = passages.repartition(n, "anchor").sortWithinPartitions("anchor", "key", "passage")
    located = stored(passages.mapInArrow(_locate(window, shard_passages), "anchor long, key long, shift int, length int, first long"), "located")
    places = named.mapInArrow(_passages(field, n, window, filter_bits, False), "anchor long, key long, doc_id long, tag long, start int")
    hits = places.join(located, ["anchor", "key"]).where("first < doc_id")
    hits = hits.select("doc_id", F.struct("tag", (F.col("start") + F.col("shift")).alias("at"), "length").alias("hit"))
    hits = stored(hits.groupBy(F.col("doc_id").alias("hit_id")).agg(F.collect_list("hit").alias("hits")), "hits")  # of one document: in all less than its text
    marked = spark.sparkContext.broadcast(id_field(hits.select("hit_id")))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"
    whole = docs.mapInArrow(_remove(window, keep_text, marked), schema)
    joined = docs.mapInArrow(_marked(marked), docs.schema).join(hits.hint("shuffle_hash"), F.col("doc_id") == F.col("hit_id"), "left")
    out = whole.union(joined.select("doc_id", "text", "hits").mapInArrow(_remove(window, keep_text), schema))
    return out if keep_text else out.drop("text")


def _marked(marked):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe_in(marked.value, batch.column("doc_id"))))

    return run


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), keep_text=False)


OP2_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM later),
single AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM single ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""
