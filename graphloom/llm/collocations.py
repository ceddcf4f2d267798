"""Collocations of two to four words by a minimal perfect hash over frequent phrases.

Phrases grow by one word at a time (Apriori). A frequent phrase of k words has a slot, a
text is a stream of slots with -1 where none begins, and two slots that follow each
other name a phrase of k + 1 words, both parts of which are frequent, by one exact
64-bit key. For each length:

1. Tasks send the distinct keys of their streams with counts capped at the threshold.
   The sum of these reaches it for frequent phrases only, which are the candidates.
2. Candidates, in blocks of bounded size, get a minimal perfect hash: levels of bits with
   ranks below them, and the key of each slot, which rejects all other phrases.
3. A pass over the streams looks slots up, counts them in one array a task, and writes the
   streams of the next length in short rows that end at breaks. The arrays are added up as a
   tree, in chunks.

A task takes up a bounded number of bytes or slots at a time, whatever the size of its batches.

A slot's key holds the slots of its first and its last k words, so that the counts of
both parts of every cut are read by slot. Words are told apart by 64-bit hashes of language
and word (two words in 10**19 share one); longer phrases by their slots, exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import PIECE_ROWS, discard, durable, table
from graphloom.llm.shingles import _PIECE, _cut, _hash_piece, byte_classes, mix

LEAST = 30
LONGEST = 4
TOP = 2000
#: A candidate goes if a longer one that holds it has this percentage of its occurrences.
INSIDE = 80
#: Keys of one perfect hash; slots of a chunk of counts; keys that a task holds before it reports them.
BLOCK = 1 << 22
CHUNK = 8192
HELD = 1 << 19
#: Bytes of texts, and slots of streams, that a task takes up at a time; slots of a row of a stream.
BYTES = 1 << 21
SLOTS = 1 << 18
ROW = 256
#: Branches of the tree in which the tasks' counts are added up.
FAN = 8
_SALT = 64
_U = np.uint64
_BREAKS = b".,;:!?\n\v\f\r"
_CLASSES = byte_classes(b" \t" + _BREAKS)
_BREAK = np.isin(np.arange(256), np.frombuffer(_BREAKS, np.uint8))
_WORD = re.compile(b"[^ \t" + _BREAKS + b"]+")
_SLOTS = 31


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys; any other key has none."""

    def __init__(self, keys: np.ndarray):
        rest, base = keys.astype(np.uint64), 0
        self.levels = []
        while len(rest):
            size = -(-2 * len(rest) // 64) * 64
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            rank = base + np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
            self.levels.append((size, bits, rank.astype(np.int32)))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._slots(keys.astype(np.uint64))] = keys.astype(np.uint64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(size)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int32), np.arange(len(keys))
        for level, (size, bits, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = self._place(keys[left], level, size)
            word, bit = bits[at >> _U(6)], at & _U(63)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1)))
            out[left[hit]] = rank[at[hit] >> _U(6)] + below
            left = left[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        keys = keys.astype(np.uint64)
        out = self._slots(keys)
        return np.where((out >= 0) & (self.keys[out] == keys), out, np.int32(-1))


class _Words:
    """Words of a batch of texts: hashes with their language, pieces, and where they stand."""

    def __init__(self, texts: list[str | None], langs: list[str]):
        seeds = {x: int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in set(langs)}
        self.langs = langs
        self.buffers: list[bytes] = []
        found: list[list[np.ndarray]] = []
        self.pieces = 0
        pending: list[bytes] = []
        first, size = 0, 0

        def hashed(data: bytes, begin: list[int], doc: int) -> None:
            starts, h = _hash_piece(data, _CLASSES)
            breaks = np.cumsum(_BREAK[np.frombuffer(data, np.uint8)], dtype=np.int64)
            docs = doc + np.searchsorted(np.array(begin), starts, "right") - 1
            found.append([h, self.pieces + breaks[starts] if len(starts) else starts, docs, np.full(len(starts), len(self.buffers)), starts])
            self.pieces += int(breaks[-1]) if len(breaks) else 0
            self.buffers.append(data)

        def flush() -> None:
            nonlocal pending, size
            if pending:
                hashed(b"\n".join(pending) + b"\n", np.cumsum([0] + [len(x) + 1 for x in pending[:-1]]).tolist(), first)
            pending, size = [], 0

        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            if size + len(data) > _PIECE:
                flush()
            if len(data) > _PIECE:
                for part in _cut(data, _CLASSES):
                    hashed(part, [0], i)
                self.pieces += 1
                continue
            if not pending:
                first = i
            pending.append(data)
            size += len(data) + 1
        flush()
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
        self.piece, self.doc, self.buffer, self.start = cols[1:]
        seed = np.array([seeds[x] for x in langs] or [0], np.uint64)
        self.key = mix(cols[0].astype(np.uint64) ^ seed[self.doc])

    def word(self, i: int) -> str:
        raw = _WORD.match(self.buffers[self.buffer[i]], int(self.start[i]))[0]
        return raw.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).decode("utf-8", "surrogatepass")


class _Distinct:
    """Distinct keys of a task with counts capped at the threshold."""

    def __init__(self, least: int):
        self.least, self.held, self.size = least, [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.held.append((k, np.minimum(n, self.least).astype(np.int32)))
        self.size += len(k)
        if self.size > 2 * HELD:
            self.merge()

    def merge(self) -> None:
        if len(self.held) > 1:
            keys = np.concatenate([k for k, _ in self.held])
            counts = np.concatenate([n for _, n in self.held])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            begin = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
            self.held = [(keys[begin], np.minimum(np.add.reduceat(counts, begin), self.least).astype(np.int32))]
            self.size = len(begin)

    def report(self, force: bool) -> Iterator[pa.RecordBatch]:
        if force:
            self.merge()
        if self.held and (force or len(self.held) == 1 and self.size > HELD):
            [(keys, counts)] = self.held
            for low in range(0, len(keys), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(keys[part].view(np.int64)), pa.array(counts[part])], ["key", "n"])
            self.held, self.size = [], 0


_FIELDS = {"kind": pa.int32(), "s": pa.list_(pa.int32()), "key": pa.int64(), "n": pa.int64(), "chunk": pa.int32(), "fan": pa.int32(), "counts": pa.binary(), "lang": pa.string(), "word": pa.string()}
_OUT = "kind int, s array<int>, key long, n long, chunk int, fan int, counts binary, lang string, word string"


def _row(kind: int, **columns) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    made = {n: pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in _FIELDS.items()}
    made["kind"] = pa.array(np.full(size, kind, np.int32))
    return pa.RecordBatch.from_arrays([*made.values()], names=[*_FIELDS])


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, number) of rows, PIECE_ROWS at most and with ``most`` in all, but for single larger rows."""
    ends, low = np.cumsum(sizes, dtype=np.int64), 0
    while low < len(ends):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right"))
        high = min(max(high, low + 1), low + PIECE_ROWS)
        yield low, high - low
        low = high


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, pa.RecordBatch]]:
    for p in parts:
        for group in _groups(pc.fill_null(pc.binary_length(p["word"]), 0).to_numpy(zero_copy_only=False), BYTES):
            b = p.slice(*group)
            yield _Words(b["word"].to_pylist(), b["lang"].to_pylist()), b


def _streams(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    for p in parts:
        for group in _groups(np.diff(p["s"].offsets.to_numpy()), SLOTS):
            yield p["s"].slice(*group)


def _flat(s: pa.ListArray) -> np.ndarray:
    return s.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


def _pairs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which two slots follow each other, and their keys."""
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return at, s[at].astype(np.uint64) << _U(_SLOTS) | s[at + 1].astype(np.uint64)


def _dense(s: np.ndarray) -> np.ndarray:
    """A stream without repeated breaks, ending in one."""
    s = np.append(s, np.int32(-1))
    return s[(s >= 0) | (np.append(np.int32(-1), s[:-1]) >= 0)]


def _cut_rows(s: np.ndarray) -> pa.ListArray:
    """A dense stream in rows of about ROW slots that end at breaks; long rows would make large batches."""
    breaks = np.flatnonzero(s < 0) + 1
    last = np.append(breaks[1:] // ROW != breaks[:-1] // ROW, True)
    return pa.ListArray.from_arrays(np.append(0, breaks[last]).astype(np.int32), s)


def _beside(old: np.ndarray, new: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    """Rows of the old slots from ``starts`` on, each with the new ones after them."""
    at = np.arange(len(old))
    length = np.diff(starts)
    out = np.empty(2 * len(old), np.int32)
    out[at + np.repeat(starts[:-1], length)] = old
    out[at + np.repeat(starts[1:], length)] = new
    return pa.ListArray.from_arrays((2 * starts).astype(np.int32), out)


def _screened(source: DataFrame, least: int, words: bool) -> DataFrame:
    """(key, n): distinct keys of each task, of words or of slots that follow each other, with counts capped at ``least``."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Distinct(least)
        found = (w.key for w, _ in _texts(parts)) if words else (_pairs(_flat(s))[1] for s in _streams(parts))
        for keys in found:
            seen.add(keys)
            yield from seen.report(False)
        yield from seen.report(True)

    return source.mapInArrow(rows, "key long, n int")


def _counted(source: DataFrame, perfect, base: int, words: bool, first: bool, last: bool, longer: bool) -> DataFrame:
    """One pass of a block: streams (kind 0), counts (2), words (3), words in all of a language (4).

    Before the last block of a length, streams hold the old slots and then the new ones found
    so far, or are the new slots of a text beside it; the last pass leaves only new ones.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = perfect.value
        n = len(table_.keys)
        counts, held, size = np.zeros(n, np.int64), [], 0
        known, total = np.zeros(n, bool), {}
        fan = TaskContext.get().partitionId() % FAN

        def tally() -> None:
            nonlocal held, size
            if held:
                slots, many = np.unique(np.concatenate(held), return_counts=True)
                counts[slots] += many
                held, size = [], 0

        def streams() -> Iterator[tuple]:
            """Places, keys at them, new slots so far, old ones with the starts of their rows, words and texts."""
            if words:
                for w, b in _texts(parts):
                    ends = np.diff(w.piece) != 0
                    at = np.arange(len(w.key)) + np.concatenate([[0], np.cumsum(ends)])[: len(w.key)]
                    yield at, w.key, np.full(len(w.key) + int(ends.sum()), -1, np.int32) if first else _flat(b["s"]), None, w, b
                return
            for s in _streams(parts):
                flat, starts = _flat(s), s.offsets.to_numpy().astype(np.int64)
                starts -= starts[0]
                if first:
                    yield *_pairs(flat), np.full(len(flat), -1, np.int32), (flat, starts), None, None
                else:  # both halves of each row
                    length = np.diff(starts) // 2
                    half = np.repeat(np.tile([True, False], len(length)), np.repeat(length, 2))
                    yield *_pairs(flat[half]), flat[~half], (flat[half], starts // 2), None, None

        for at, keys, new, old, w, b in streams():
            slot = table_.find(keys)
            ok = slot >= 0
            held.append(slot[ok])
            size += int(ok.sum())
            if size > SLOTS:
                tally()
            new[at[ok]] = slot[ok] + base
            if words:
                for i, many in enumerate(np.bincount(w.doc, minlength=len(w.langs)).tolist() if first else ()):
                    total[w.langs[i]] = total.get(w.langs[i], 0) + many
                fresh, where = np.unique(slot[ok], return_index=True)
                pick = ~known[fresh]
                known[fresh[pick]] = True
                own = np.flatnonzero(ok)[where[pick]]
                if len(own):
                    yield _row(3, key=fresh[pick].astype(np.int64) + base, lang=[w.langs[w.doc[i]] for i in own], word=[w.word(i) for i in own])
            if last:
                new = _dense(new)
                if longer and len(new) > 1:
                    yield _row(0, s=_cut_rows(new))
            elif words:
                doc = np.full(len(new), -1)
                doc[at] = w.doc
                doc = np.maximum.accumulate(doc)
                yield _row(0, s=pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32), new), lang=b["lang"], word=b["word"])
            elif len(new):
                yield _row(0, s=_beside(old[0], new, old[1]))
        tally()
        if total:
            yield _row(4, lang=[*total], n=[*total.values()])
        for low in range(0, n, CHUNK):
            part = counts[low : low + CHUNK]
            if part.any():
                yield _row(2, chunk=[low // CHUNK], fan=[fan], counts=[_packed(part)])

    return source.mapInArrow(rows, _OUT)


def _packed(counts: np.ndarray) -> bytes:
    """Bytes of one count, and the counts: most are small, and the batches of Arrow with them."""
    size = next(x for x in (1, 2, 4, 8) if int(counts.max()) < 256**x)
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def _unpacked(raw) -> np.ndarray:
    size = np.frombuffer(raw, np.uint8, 1)[0]
    return np.frombuffer(raw, f"<u{size}", offset=1).astype(np.int64)


def _added_up(counts: DataFrame, keys: list[str], perfect=None, base: int = 0) -> DataFrame:
    """Arrays of equal ``keys`` added up, or (slot, a, key) of the sums by chunk; a task holds one array at a time.

    Both in one function: a second one on its rows would hold a Python worker more for each task.
    """
    schema = "slot long, a long, key long" if perfect else ", ".join(f"{k} int" for k in keys) + ", counts binary"

    def done(of: tuple, total: np.ndarray) -> pa.RecordBatch:
        if perfect:
            slot = np.arange(of[0] * CHUNK, of[0] * CHUNK + len(total))
            return pa.RecordBatch.from_arrays([pa.array(slot + base), pa.array(total), pa.array(perfect.value.keys[slot].view(np.int64))], ["slot", "a", "key"])
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int32()) for k in of), pa.array([_packed(total)], pa.binary())], [*keys, "counts"])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, None
        for p in parts:
            for i, key in enumerate(zip(*(p[k].to_pylist() for k in keys), strict=True)):
                array = _unpacked(p["counts"][i].as_buffer())
                if key == of:
                    total += array
                else:
                    if of is not None:
                        yield done(of, total)
                    of, total = key, array
        if of is not None:
            yield done(of, total)

    return counts.select(*keys, "counts").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, schema)


def _length(source: DataFrame, least: int, words: bool, longer: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Phrases (slot, a, key) of one length, their streams, and the tables of all passes."""
    spark = source.sparkSession
    # Tasks send a key once or a few times, so they needn't add up before the shuffle.
    frequent = durable(_screened(source, least, words).repartition("key").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key"), "frequent")
    n = frequent.count()
    if n >= 1 << _SLOTS:
        raise OverflowError("more frequent phrases of one length than slots")
    blocks = max(1, -(-4 * n // (3 * BLOCK)))
    phrases, passes, base = None, [], 0
    for b in range(blocks):
        keys = frequent.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).toArrow()["key"].to_numpy().view(np.uint64)
        perfect = spark.sparkContext.broadcast(PerfectHash(np.sort(keys)))
        made = durable(_counted(source, perfect, base, words, b == 0, b == blocks - 1, longer), "pass")
        own = durable(_added_up(_added_up(made.filter("kind = 2"), ["chunk", "fan"]), ["chunk"], perfect, base), "phrases")
        phrases = own if phrases is None else phrases.union(own)
        passes.append(made)
        base += len(keys)
        source = made.filter("kind = 0").select("s", "lang", "word")
    discard(frequent)
    return phrases, source.select("s"), passes


def _ranked(e: DataFrame, k: int) -> DataFrame:
    """Score of each phrase of ``k`` words: of its lowest cut, the first of equal ones."""
    cuts = []
    for j in range(1, k):
        left, right = F.element_at("heads", j), F.element_at("tails", k - j)
        score = F.expr(f"CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) div (CAST(element_at(heads, {j}) AS DECIMAL(20,0)) + element_at(tails, {k - j})) AS BIGINT)")
        cuts.append(F.struct(score.alias("score"), F.lit(j).alias("j"), left.alias("l"), right.alias("r")))
    return e.withColumn("cut", F.array_min(F.array(*cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "held")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?]`` and line ends, and these at
    blanks and tabs into words. Candidates are phrases of 2 to ``longest`` words with
    ``least`` or more occurrences in a language; a null language is ``und``. A cut into two
    parts with l and r occurrences scores floor(2000000 * a / (l + r)), the lowest counts. A
    candidate inside a longer one that has ``INSIDE`` percent of its occurrences is left out.
    Order: score and a descending, phrase by UTF-8 bytes. Null and empty texts have
    no words; repeated rows count each; other columns are ignored; no rows without words.
    """
    docs = docs.select(F.col("text").cast("string").alias("word"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    phrases, streams, passes = _length(docs, least, True, longest > 1)
    totals = durable(passes[0].filter("kind = 4").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    once = F.when(F.min(F.struct("lang", "word")) == F.max(F.struct("lang", "word")), F.min(F.struct("lang", "word"))).otherwise(F.raise_error(F.lit("two words share a hash")).cast("struct<lang:string,word:string>"))
    named = reduce(DataFrame.union, [p.filter("kind = 3").select(F.col("key").alias("slot"), "lang", "word") for p in passes])
    words = named.groupBy("slot").agg(once.alias("w")).select("slot", "w.lang", "w.word")
    e = phrases.join(words, "slot").select("slot", "a", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("a").alias("heads"), F.array("a").alias("tails"))
    e = durable(e, "length")
    out = None
    for k in range(2, longest + 1):
        earlier = passes
        phrases, streams, passes = _length(streams, least, False, k < longest)
        discard(*earlier)
        parts = phrases.select("slot", "a", F.shiftright("key", _SLOTS).alias("pre"), F.col("key").bitwiseAND(F.lit((1 << _SLOTS) - 1)).alias("suf"))
        held = parts.select(F.explode(F.array("pre", "suf")).alias("slot"), "a").groupBy("slot").agg(F.max("a").alias("held"))
        if k > 2:
            part = _ranked(e.join(held, "slot", "left"), k - 1)
            out = part if out is None else out.union(part)
        front = e.select(F.col("slot").alias("pre"), "lang", "phrase", "heads")
        back = e.select(F.col("slot").alias("suf"), "last", "tails")
        joined = parts.join(front, "pre").join(back, "suf")
        a = F.array("a")
        e = durable(joined.select("slot", "a", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.concat("heads", a).alias("heads"), F.concat("tails", a).alias("tails")), "length")
    part = _ranked(e.withColumn("held", F.lit(None).cast("long")), longest)
    out = (part if out is None else out.union(part)).filter(f"held IS NULL OR 100 * held < {INSIDE} * a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALT)))
    for by in (["lang", "salt"], ["lang"]):  # the first cut leaves a bounded number of rows to the second
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {LEAST}),
cut AS (SELECT lang, phrase, k, a, j, array_to_string(w[:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * cut.a) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score, j
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
left_ AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE sub.a IS NULL OR 100 * sub.a < {INSIDE} * best.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM left_ JOIN n USING (lang) QUALIFY rank <= {TOP}"""
