"""LM scoring by prediction by partial matching over bytes, beside a word baseline.

A text is lower-cased (A-Z); its words, joined by one space, and an end byte are what is predicted. A byte's context is
the ORDER bytes before it. Training counts the (ORDER + 1)-byte strings of all training texts; the trie's shorter strings
are their sums, so counts at every depth are exact. A byte that the deepest known context has not seen before costs an
escape, of probability D / (N + D) for D different symbols among N (method C), and the next shorter context predicts it
with the longer one's symbols excluded. Below the empty context all bytes not seen are equally likely.

All counted strings are kept. They are dealt to parts by the last two bytes of their context, so that a part's trie has
all longer contexts that end in these bytes and answers alone for each string that has such a context; the strings of one
and two bytes, at most 2^16 + 2^8, are broadcast to all parts. A byte's probability depends on its string only: a unit of
texts of about `_UNIT` bytes sends its different strings, once each, as blocks to the parts that hold them, and gets their
log probabilities back as blocks (of 32 bits each), to where its texts are scored. Only where a caller gives `nodes`, strings that occur less
than `t` times are left out, with the smallest t that leaves no more than `nodes` of them; a string's suffix occurs no
less often, so that each node's shorter context stays, as exclusion needs. adaptive_bits() is the same model with counts
that start empty and grow along one text.

Words of the baseline are known by 64-bit hashes. Training texts' counts of the most frequent words, at most `frequent`,
are broadcast; other words go, as blocks of hashes and counts for each batch, to the partition that holds their part of
the vocabulary. So frequent words aren't shuffled and no partition grows with a word's frequency. A block's sums come back
as a block, to where its batch is put together.

Defined cases: a null text counts as an empty one: an end token only. Rows with the same id each get a row. A null id is
not held out. Without training texts every byte has probability 1/256.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import remainder
from .shared import documents, parts, stored
from .tidying import squeezed, tidied, unsqueezed
from .words import Words, binary, chunks

ORDER = 5
FREQUENT = 1 << 17
_U = np.uint64
_STEP = 1 << 20
_UNIT = 1 << 24
_SHARED = 2


def canon(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (ORDER + 1)-byte strings that end at each predicted byte, as numbers, and where each text's begin."""
    pad = b"\n" * ORDER
    buf = np.frombuffer(b"".join(pad + t + b"\n" for t in texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.zeros(len(buf) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        code <<= _U(8)
        code |= buf[j : len(buf) - ORDER + j]
    first = np.cumsum(length) - length
    whole = np.cumsum(length + ORDER) - (length + ORDER)
    keep = np.arange(int(length.sum())) + np.repeat(whole - first, length)
    return code[keep], first


def tallied(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of n (or 1) of each."""
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return tallied(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))


_built: dict[str, tuple] = {}
END_HASH = np.uint64(0x9B97_5CE1_0000_0001)


@tidied
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0: byte string, 1: word), key and n of each batch's training texts."""
    _built.clear()  # of a query before
    for batch in batches:
        found: list[list] = [[], []]
        texts = binary(batch.column("text"))
        for _, own in chunks(texts, _STEP):
            own = [canon(t) for t in own]
            found[0].append(tallied(grams(own)[0]))
            found[1].append(tallied(Words(own).hashes))
            for kind in (0, 1):
                if len(found[kind]) > 8:
                    found[kind] = [_merged(found[kind])]
        found[1].append((np.array([END_HASH]), np.array([len(texts)])))
        for kind in (0, 1):
            if found[kind]:
                keys, n = _merged(found[kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


class Lookup:
    """Numbers to their places in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.mask = (1 << self.bits) - 1
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.append(keys, _U(2**64 - 1))
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several the last is in
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is not there."""
        at = self._home(keys)
        out = self.slot[at]
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            now = self.slot[at[open_]]
            out[open_] = now
            open_ = open_[(now >= 0) & (self.keys[now] != keys[open_])]
        return out


def _low(k: int) -> np.uint64:
    return _U((1 << 8 * k) - 1)


class Trie:
    """Log probabilities of the model from levels[k - 1] = (k-byte strings, counts), k from 1 to ORDER + 1."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.gram: list[Lookup] = []
        self.context: list[Lookup] = []
        self.first, self.log_n, self.escape, self.less_total, self.less_escape = [], [], [], [], []
        with np.errstate(divide="ignore", invalid="ignore"):
            for k, (code, n) in enumerate(levels):  # contexts of k bytes
                order = np.argsort(code)
                code, n = code[order], n[order].astype(np.float64)
                gram = Lookup(code)
                start = np.flatnonzero(np.append(True, (code[1:] >> _U(8)) != (code[:-1] >> _U(8)))) if len(code) else np.zeros(0, np.int64)
                total = np.add.reduceat(n, start) if len(start) else n
                kinds = np.diff(np.append(start, len(code))).astype(np.float64)
                own = np.repeat(np.arange(len(start)), kinds.astype(np.int64))
                self.first.append((np.log10(n) - np.log10(total + kinds)[own]).astype(np.float32))
                self.log_n.append(np.log10(n).astype(np.float32))
                self.escape.append(np.log10(kinds) - np.log10(total + kinds))
                if k:
                    # what the shorter context has besides this context's symbols
                    up_n, up_total, up_kinds, up_context = before
                    parent = up_context(code[start] >> _U(8) & _low(k - 1)) if k > 1 else np.zeros(len(start), np.int64)
                    seen = np.add.reduceat(up_n[self.gram[k - 1](code & _low(k))], start) if len(start) else total
                    more, kinds_more = up_total[parent] - seen, up_kinds[parent] - kinds
                    self.less_total.append(np.where(kinds_more > 0, np.log10(more + kinds_more), 0.0))
                    self.less_escape.append(np.where(kinds_more > 0, np.log10(kinds_more) - np.log10(more + kinds_more), 0.0))
                else:
                    self.less_total.append(np.zeros(0))
                    self.less_escape.append(np.zeros(0))
                    self.unseen = -np.log10(np.maximum(256 - kinds.sum(), 1.0))
                    self.empty = not len(code)
                self.gram.append(gram)
                self.context.append(Lookup(code[start] >> _U(8)))
                before = (n, total, kinds, self.context[k])

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Of the probability of each string's last byte after the ones before it."""
        out = np.zeros(len(code))
        if self.empty:
            return out - np.log10(256.0)
        left = np.arange(len(code))
        longer = np.full(len(code), -1, np.int64)  # the context one byte longer, where it is known
        for k in range(ORDER, -1, -1):
            own = code[left] & _low(k + 1)
            at, longer_own = self.gram[k](own), longer[left]
            found, has = at >= 0, longer_own >= 0
            hit = found & ~has
            out[left[hit]] += self.first[k][at[hit]]
            hit = found & has
            out[left[hit]] += self.log_n[k][at[hit]] - (self.less_total[k + 1][longer_own[hit]] if k < ORDER else 0.0)
            miss = ~found
            left, own, longer_own = left[miss], own[miss], longer_own[miss]
            here = self.context[k](own >> _U(8))
            has = longer_own >= 0
            if k < ORDER:
                out[left[has]] += self.less_escape[k + 1][longer_own[has]]
            fresh = ~has & (here >= 0)
            out[left[fresh]] += self.escape[k][here[fresh]]
            longer[left] = here
        out[left] += self.unseen
        return out


def adaptive_bits(text: bytes) -> float:
    """Code length in bits of one text under counts that start empty and grow along it."""
    seen: list[dict[bytes, dict[int, int]]] = [{} for _ in range(ORDER + 1)]
    bits, data = 0.0, b"\n" * ORDER + canon(text) + b"\n"
    for i in range(ORDER, len(data)):
        excluded: set[int] = set()
        for k in range(ORDER, -1, -1):
            own = seen[k].get(data[i - k : i], {})
            rest = {s: n for s, n in own.items() if s not in excluded}
            total = sum(rest.values())
            if data[i] in rest:
                bits -= np.log2(rest[data[i]] / (total + len(rest)))
                break
            if rest:
                bits -= np.log2(len(rest) / (total + len(rest)))
                excluded |= set(rest)
        else:
            bits += np.log2(256 - len(excluded))
        for k in range(ORDER + 1):
            own = seen[k].setdefault(data[i - k : i], {})
            own[data[i]] = own.get(data[i], 0) + 1
    return float(bits)


#: kind 0: a part's vocabulary or strings; 1: a unit's rows; 2: a unit's words of one part; 3: sums of these; 4: a unit's
#: strings of one part; 5: log probabilities of these. `batch` numbers units.
_BLOCK = "kind int, part long, batch long, ids array<long>, hashes binary, rows binary, counts binary, sums binary, scores binary, texts binary"


def _model(name: str, frequent) -> tuple[Lookup, np.ndarray]:
    """Built once in each Python worker."""
    if name not in _built:
        _built.clear()
        common, common_n = frequent.value
        _built[name] = Lookup(common), np.log10(common_n + 0.5)
    return _built[name]


def _planes(code: np.ndarray) -> bytes:
    """Sorted strings byte by byte: the first bytes of all, then the second ones, and so on."""
    return squeezed(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T.tobytes())


def _of_planes(data: bytes) -> np.ndarray:
    own = np.frombuffer(unsqueezed(data), np.uint8).reshape(ORDER + 1, -1)
    code = np.zeros((own.shape[1], 8), np.uint8)
    code[:, : ORDER + 1] = own.T
    return code.view("<u8").ravel()


def _part_of(code: np.ndarray, n_parts: int) -> np.ndarray:
    """By the last bytes of the context; lm_scores() has the same in Spark."""
    return ((((code >> _U(8) & _low(_SHARED)) * _U(2654435761) & _low(4)) >> _U(8)) % _U(n_parts)).astype(np.int64)


def _score(frequent, n_parts: int, code_parts: int):
    """What frequent words give for each row of a unit, and its texts (kind 1), and other words (kind 2) and byte strings
    (kind 4) in blocks for each part; no byte strings without code_parts."""
    name = uuid.uuid4().hex

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, common_log = _model(name, frequent)
        end_log = float(common_log[lookup(np.array([END_HASH]))[0]]) if lookup(np.array([END_HASH]))[0] >= 0 else float(np.log10(0.5))
        end_known = int(lookup(np.array([END_HASH]))[0] >= 0)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for at_unit, texts in chunks(binary(batch.column("text")), _UNIT):
                n = len(texts)
                n_tokens, n_known, words = np.ones(n, np.int64), np.full(n, end_known), np.full(n, end_log)
                rare: list[tuple] = []
                codes: list[np.ndarray] = []
                canons: list[bytes] = []
                for begin, own in chunks(texts, _STEP // 4):
                    own = [canon(t) for t in own]
                    canons += own
                    codes.append(tallied(grams(own)[0])[0])
                    if len(codes) > 16:
                        codes = [tallied(np.concatenate(codes))[0]]
                    at = slice(begin, begin + len(own))
                    found = Words(own)
                    text = np.repeat(np.arange(len(own)), np.diff(found.first)) + begin
                    place = lookup(found.hashes)
                    hit = place >= 0
                    n_tokens[at] += np.diff(found.first)
                    n_known += np.bincount(text[hit], minlength=n)
                    words += np.bincount(text[hit], common_log[place[hit]], minlength=n)
                    h, t = found.hashes[~hit], text[~hit]
                    order = np.lexsort((t, h))
                    h, t = h[order], t[order]
                    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, np.int64)
                    rare.append((h[new], t[new], np.diff(np.append(new, len(h)))))
                # canonical texts have no newline
                yield _rows(1, 1, batch=pa.array([number]), ids=pa.array([ids[at_unit : at_unit + n]], pa.list_(pa.int64())), rows=_bytes(n_tokens), counts=_bytes(n_known.astype(np.int64)), sums=_bytes(words), texts=pa.array([squeezed(b"\n".join(canons))], pa.binary()))
                h, t, c = (np.concatenate([x[k] for x in rare]) for k in range(3))
                part = (h % _U(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                used, spans = _spans(part, order)
                blobs = {k: pa.array([x[s].astype(kind).tobytes() for s in spans], pa.binary()) for k, x, kind in (("hashes", h, "<u8"), ("rows", t, "<u4"), ("counts", c, "<u4"))}
                if len(used):
                    yield _rows(2, len(used), part=pa.array(used), batch=pa.array(np.full(len(used), number)), **blobs)
                if code_parts:
                    code = tallied(np.concatenate(codes))[0]
                    part = _part_of(code, code_parts)
                    used, spans = _spans(part, np.argsort(part, kind="stable"))
                    yield _rows(4, len(used), part=pa.array(used), batch=pa.array(np.full(len(used), number)), hashes=pa.array([_planes(code[s]) for s in spans], pa.binary()))
                number += 1

    return run


def _spans(part: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different parts, and which rows, in this order, are each part's."""
    used, start = np.unique(part[order], return_index=True)
    return used, np.split(order, start[1:]) if len(used) else []


def _rows(kind: int, n: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types["array<long>"] = pa.list_(pa.int64())
    fields = [x.split() for x in _BLOCK.split(", ")]
    arrays = [pa.array(np.full(n, kind, np.int32)) if name == "kind" else columns.get(name, pa.nulls(n, types[t])) for name, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


@tidied
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vocabulary rows (part, key, n) of one batch as a block for each part, kind 0."""
    for batch in batches:
        part, key, n = (batch.column(c).to_numpy() for c in ("part", "key", "n"))
        order = np.argsort(part, kind="stable")
        used, spans = _spans(part, order)
        if len(used):
            yield _rows(0, len(used), part=pa.array(used), hashes=pa.array([key[s].tobytes() for s in spans], pa.binary()), counts=pa.array([n[s].tobytes() for s in spans], pa.binary()))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


@tidied
def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part and kind: a part's vocabulary, then blocks of batches' words, each giving its rows' sums (kind 3)."""
    part, held, lookup, log = None, [], None, None
    for batch in batches:
        for p, kind, number, hashes, rows, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "batch", "hashes", "rows", "counts")), strict=True):
            if p != part:
                part, held, lookup = p, [], None
            if kind == 0:
                held.append((np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i8")))
                continue
            if lookup is None:
                keys = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in held)])
                lookup = Lookup(keys)
                log = np.log10(np.concatenate([np.zeros(0), *(n for _, n in held), np.zeros(1)]) + 0.5)  # the last: not known
            at = lookup(np.frombuffer(hashes, "<u8"))
            row, n = np.frombuffer(rows, "<u4"), np.frombuffer(counts, "<u4")
            used, own = np.unique(row, return_inverse=True)
            known = np.bincount(own, n * (at >= 0), len(used)).astype(np.int64)
            yield _rows(3, 1, batch=pa.array([number]), rows=_bytes(used), counts=_bytes(known), sums=_bytes(np.bincount(own, n * log[at], len(used))))


def _answer(shared, least: int):
    """Sorted by part and kind: a part's strings, then blocks of units' strings, each giving their log probabilities (kind 5)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, trie = None, [], None
        for batch in batches:
            for p, kind, number, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "batch", "hashes", "counts")), strict=True):
                if p != part:
                    part, held, trie = p, [], None
                if kind == 0:
                    held.append((np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i8")))
                    continue
                if trie is None:
                    trie, held = Trie(_levels(shared.value, held, least)), []
                yield _rows(5, 1, batch=pa.array([number]), hashes=pa.array([hashes], pa.binary()), scores=pa.array([squeezed(trie.log10(_of_planes(hashes)).astype("<f4").tobytes())], pa.binary()))

    return run


def _levels(shared: tuple[np.ndarray, np.ndarray], held: list[tuple], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A part's strings of each length: the shortest, which all parts have, and sums of its longest ones."""
    code, n = _merged(held) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    own = [tallied(shared[0] & _low(k), shared[1]) if k <= _SHARED else tallied(code & _low(k), n) for k in range(1, ORDER + 2)]
    return [(code[n >= least], n[n >= least]) for code, n in own]


@tidied
def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by batch and kind: a unit's rows, then sums of its other words and log probabilities of its strings."""
    now: list | None = None

    def out() -> pa.RecordBatch:
        ids, n_tokens, n_known, words, blob, codes, logs = now
        texts = unsqueezed(blob).split(b"\n")
        if not codes:  # nothing to learn from
            score = -np.log10(256.0) * np.array([len(t) + 1 for t in texts])
        else:
            lookup, log, score = Lookup(np.concatenate(codes)), np.concatenate(logs).astype(np.float64), np.zeros(len(ids))
            for begin, own in chunks(texts, _STEP // 4):
                code, first = grams(own)
                score[begin : begin + len(own)] = np.add.reduceat(log[lookup(code)], first)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, (n_tokens, n_known, words, score))], ["doc_id", "n_tokens", "n_known", "words", "score"])

    for batch in batches:
        columns = [batch.column(c) for c in ("kind", "ids", "rows", "counts", "sums", "scores", "hashes", "texts")]
        for row in zip(*columns, strict=True):
            kind, ids, rows, counts, sums, scores, hashes, blob = (x.as_py() for x in row)
            if kind == 1:
                if now:
                    yield out()
                now = [ids, np.frombuffer(rows, "<i8"), np.frombuffer(counts, "<i8").copy(), np.frombuffer(sums, "<f8").copy(), blob, [], []]
            elif kind == 3:
                at = np.frombuffer(rows, "<u4")
                now[2][at] += np.frombuffer(counts, "<i8")
                now[3][at] += np.frombuffer(sums, "<f8")
            else:
                now[5].append(_of_planes(hashes))
                now[6].append(np.frombuffer(unsqueezed(scores), "<f4"))
    if now:
        yield out()


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = rows.toArrow()
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _at_least(counted: DataFrame, most: int) -> int:
    """The smallest count that no more than `most` rows have or exceed."""
    left = most
    levels = counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") <= most).orderBy(F.desc("n"))
    # counts that many rows have are small: the largest `most` different counts are all that can matter
    biggest = counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).agg(F.max("n")).first()[0] or 0
    chosen = biggest + 1
    at = None
    for n, rows in levels.where(F.col("n") > biggest).limit(most).toLocalIterator():
        if rows > left:
            break
        left, at = left - rows, n
    return max(chosen, at) if at is not None else int(biggest) + 1


def lm_scores(docs: DataFrame, train: DataFrame | None = None, nodes: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text), learning from `train`."""
    spark = docs.sparkSession
    train = docs if train is None else train
    counted = stored(train.select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    vocabulary = counted.where("kind = 1").select("key", "n")
    train_tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()

    strings = counted.where("kind = 0").select("key", "n")
    least = 1
    if nodes is not None:
        low = F.array(*(F.lit((1 << 8 * k) - 1) for k in range(1, ORDER + 2)))
        every = strings.select(F.explode(F.sequence(F.lit(1), F.lit(ORDER + 1))).alias("k"), "key", "n")
        every = every.select("k", F.col("key").bitwiseAND(F.element_at(low, F.col("k"))).alias("key"), "n")
        least = _at_least(stored(every.groupBy("k", "key").agg(F.sum("n").alias("n")), "lm-strings"), nodes)
    shortest = strings.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * _SHARED) - 1)).alias("key")).agg(F.sum("n").alias("n"))
    # the end is looked up in the broadcast only
    often = (F.col("n") >= _at_least(vocabulary, frequent)) | (F.col("key") == F.lit(int(END_HASH.view(np.int64))))
    # both bounded: 2^16 and `frequent` + 1 rows at most
    known, common = _collected(shortest), _collected(vocabulary.where(often))
    shared, top = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(common)

    n_parts = max(parts(spark), int(distinct) // 500_000 + 1)
    code_parts = max(parts(spark), strings.count() // 250_000 + 1)
    scored = stored(docs.select("doc_id", "text").mapInArrow(_score(top, n_parts, code_parts if len(known[0]) else 0), _BLOCK), "lm-scores")
    lean = scored.withColumn("texts", F.lit(None).cast("binary"))
    ends = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * _SHARED) - 1))
    ends = F.pmod(F.shiftright((ends * F.lit(2654435761)).bitwiseAND(F.lit((1 << 32) - 1)), 8), F.lit(code_parts)).cast("long")
    asked = strings.select(ends.alias("part"), "key", "n").mapInArrow(_blocks, _BLOCK).union(lean.where("kind = 4"))
    answers = asked.repartition(code_parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_answer(shared, least), _BLOCK)
    part = F.pmod(F.col("key"), F.lit(n_parts))
    # the hash as an unsigned number modulo n_parts
    part = F.when(F.col("key") >= 0, part).otherwise(F.pmod(F.pmod(F.col("key"), F.lit(n_parts)) + F.lit(2**64 % n_parts), F.lit(n_parts)))
    blocks = vocabulary.where(~often).select(part.alias("part"), "key", "n").mapInArrow(_blocks, _BLOCK)
    both = blocks.union(lean.where("kind = 2"))
    sums = both.repartition(n_parts, "part").sortWithinPartitions("part", "kind").mapInArrow(_join, _BLOCK)
    own = scored.where("kind = 1").union(sums).union(answers).repartition(parts(spark), "batch").sortWithinPartitions("batch", "kind", "part")
    out = own.mapInArrow(_together, "doc_id long, n_tokens long, n_known long, words double, score double")
    base = F.col("words") - F.col("n_tokens") * F.log10(F.lit(train_tokens + 0.5 * (distinct + 1)))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(remainder() == 1, F.lit(False))
    out = lm_scores(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
