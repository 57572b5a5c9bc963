"""Best-fit packing with exact-complement hashing.

Texts are tokenised, closed with id 0, and cut into pieces of at most ``size`` tokens. How to fill sequences
depends on the number of pieces of each length only, so the plan is made from that table (at most ``size``
rows) and then laid over the pieces:

1. full pieces stand alone;
2. sums of one, two and three lengths are looked up by the complement that fills a gap exactly: from the
   longest length down, its gap is sought among single lengths, then pairs, then triples of those still
   available, and the combination is consumed as often as its counts allow;
3. the rest is packed best fit: lengths descending, each into the fullest open sequence with room.

A plan row says: pieces number ``first .. first + times - 1`` of a length stand at ``offset`` of sequences
``sequence .. sequence + times - 1``. Pieces are numbered within their length from counts per (length, hash
bucket), so a length that a third of all pieces has is spread over buckets.

Defined cases: a null or empty text is the single id 0; repeated rows are packed one by one; an
empty table gives no rows. Numbers within a length follow a hash of id and piece, so runs agree; pieces of one length are alike to the plan, so
ties among them don't matter. Very long texts are cut, whole, into pieces; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import bounded, slices, written

SEQUENCE, CLOSE = 2048, 0
#: Entries of a task's word cache; when there are more, those that the last slice didn't use are dropped.
CACHE = 400_000
ROWS_A_BUCKET = 4000

#: Words of these characters have the same pre-tokens by byte classes as by the tokenizer's pattern.
_PLAIN = re.compile(r"[!-&(-;=-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


class Encoder:
    """Ids of a text by a ``tokenizers`` file whose tokens never cross blanks, tabs and newlines; words are cached.

    The file's word merges are also loaded into a ``tiktoken`` table, in which a character stands for a byte,
    or for a byte at the end of a pre-token; its ranks are the file's ids. It encodes all new plain words of a
    slice in one call; words with other characters go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        alphabet = sorted(ByteLevel.alphabet())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these stand for themselves, the others follow from 256 on
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        assert sorted(byte) == alphabet
        ranks, self.ends = {}, np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            end = token.endswith("</w>") and len(token) > 4
            codes = [byte.get(c) for c in (token[:-4] if end else token)]
            if None in codes:
                continue
            text = "".join(chr(0x100 + b) for b in codes[:-1]) + chr((0x200 if end else 0x100) + codes[-1])
            ranks[text.encode()] = i
            self.ends[i] = end
        for b in range(256):  # single bytes of the characters are never left over
            ranks.setdefault(bytes([b]), len(self.ends) + b)
        self.table = Encoding("words", pat_str="[\u0100-\u01ff]*[\u0200-\u02ff]", mergeable_ranks=ranks, special_tokens={})

    def _plain(self, words: list[str]) -> None:
        data = np.frombuffer(("\n".join(words) + "\n").lower().encode(), np.uint8)
        kind = np.full(256, 3, np.uint8)
        kind[ord("a") : ord("z") + 1] = kind[128:] = 1
        kind[ord("0") : ord("9") + 1] = 2
        kind[10] = 0
        k = kind[data]
        last = np.empty(len(k), bool)
        last[:-1] = (k[1:] != k[:-1]) | (k[:-1] == 2)
        last[-1] = True
        ids = np.array(self.table.encode_ordinary((data.astype(np.uint32) + np.where(last, 0x200, 0x100).astype(np.uint32))[k > 0].tobytes().decode("utf-32-le")), "<u4")
        pieces = np.cumsum(last & (k > 0))[k == 0]  # pre-tokens up to the end of each word
        ends = np.flatnonzero(self.ends[ids]) + 1
        stop = ends[pieces - 1] * 4
        raw, at = ids.tobytes(), 0
        for w, e in zip(words, stop.tolist()):
            self.cache[w] = raw[at:e]
            at = e

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the closing id included."""
        cache, rows = self.cache, [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        cache[""] = b""
        used = set().union(*rows)
        new = used.difference(cache)
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        if plain:
            self._plain(plain)
        rest = list(new.difference(plain))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            cache[w] = np.array(e.ids, "<u4").tobytes()
        end = np.array([CLOSE], "<u4").tobytes()
        out = [b"".join([*map(cache.__getitem__, r), end]) for r in rows]
        if len(cache) > CACHE:
            self.cache = {w: cache[w] for w in used}
        return out


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every text."""
    bounded(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for part in slices(batches):
            out = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[a : a + 4 * size]
                    out.append((doc, k, k * size, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<i4") if with_ids else None))
            kinds = [part.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(counts: dict[int, int], size: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Sets of lengths that fill a sequence exactly and how often; takes them out of ``counts``."""
    for longest in sorted(counts, reverse=True):
        if not counts[longest]:
            continue
        gap = size - longest

        def take(*others: int, a: int = longest) -> int:
            need: dict[int, int] = {}
            for v in (a, *others):
                need[v] = need.get(v, 0) + 1
            times = min(counts.get(v, 0) // n for v, n in need.items())
            for v, n in need.items():
                if times:
                    counts[v] -= n * times
            return times

        if gap == 0:
            yield (longest,), take()
            continue
        if gap <= longest and (n := take(gap)):
            yield (longest, gap), n
        if not counts[longest]:
            continue
        lengths = [v for v in sorted(counts) if counts[v] and v <= longest and v < gap]
        for b in reversed(lengths):  # pairs whose sum is the gap
            c = gap - b
            if c > b:
                break
            if counts.get(c) and counts[longest] and (n := take(b, c)):
                yield (longest, b, c), n
        if not counts[longest]:
            continue
        sums: dict[int, list[int]] = {}  # pair sum -> larger lengths of such pairs; d is the third part
        lengths = [v for v in lengths if counts[v]]
        present = {v: True for v in lengths}
        for b in reversed(lengths):
            if not counts[longest]:
                break
            rest = gap - b
            if rest < 2 or not counts[b]:
                continue
            found = sums.get(rest)
            if found is None:
                found = sums[rest] = [c for c in lengths if 2 * c >= rest and c < rest and rest - c in present]
            for c in found:
                d = rest - c
                if c > b or not counts[longest]:
                    continue
                if counts.get(c) and counts.get(d) and (n := take(b, c, d)):
                    yield (longest, b, c, d), n


def best_fit(counts: dict[int, int], size: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Packs what ``counts`` holds: lengths descending, each into the open sequences with the least room that suffices."""
    rooms: list[int] = []
    open_by: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if room not in open_by:
            insort(rooms, room)
            open_by[room] = []
        open_by[room].append((lengths, n))

    for v in sorted((v for v in counts if counts[v]), reverse=True):
        left = counts[v]
        while left:
            i = bisect_left(rooms, v)
            if i == len(rooms):
                fits = size // v
                if left >= fits:
                    put(size - fits * v, (v,) * fits, left // fits)
                if left % fits:
                    put(size - (left % fits) * v, (v,) * (left % fits), 1)
                break
            room = rooms[i]
            lengths, n = open_by[room].pop()
            if not open_by[room]:
                del open_by[room], rooms[i]
            used = min(n, left)
            if n > used:
                put(room, lengths, n - used)
            put(room - v, (*lengths, v), used)
            left -= used
    for group in open_by.values():
        yield from group


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first, times, offset, sequence) that place every piece once."""
    left, rows, used, sequence = dict(counts), [], dict.fromkeys(counts, 0), 0
    for step in (combinations, best_fit):
        for lengths, times in step(left, size):
            offset = 0
            for v in lengths if times else ():
                rows.append((v, used[v], times, offset, sequence))
                used[v] += times
                offset += v
            sequence += times
    return rows


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``_n``, the 0-based number of a row within its length; ``rows`` must be stored, as they are read twice."""
    total = rows.groupBy("length").agg(F.ceil(F.count("*") / ROWS_A_BUCKET).alias("_buckets"))
    hashed = rows.withColumn("_hash", F.xxhash64("doc_id", "piece", "ids_crc32"))
    dealt = hashed.join(F.broadcast(total), "length").withColumn("_bucket", F.pmod("_hash", "_buckets"))  # a row per length
    sums = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_hash", "doc_id", "piece")) - 1
    return dealt.withColumn("_nth", nth).join(starts, ["length", "_bucket"]).withColumn("_n", F.col("_start") + F.col("_nth")).drop("_hash", "_bucket", "_buckets", "_start", "_nth")


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut.sparkSession
    cut = written(cut)
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, size) or [(0, 0, 0, 0, 0)], "length long, _first long, _times long, offset long, _sequence long")
    slots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_first", "_times", "offset", "_sequence"))).alias("_slots"))
    # the slot of number n: the last that starts at or before n, found by halving
    rows = numbered(cut).join(F.broadcast(slots), "length")  # a row per length, and the plan's few rows per length
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("_slots") + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.size("_slots").alias("b"))
    half = lambda s: ((s["a"] + s["b"]) / 2).cast("int")
    low = F.aggregate(steps, start, lambda s, _: F.when(s["b"] - s["a"] <= 1, s).when(F.get("_slots", half(s))["_first"] <= F.col("_n"), F.struct(half(s).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), half(s).alias("b"))))["a"]
    rows = rows.withColumn("_slot", F.get("_slots", low))
    extra = [c for c in cut.columns if c == "ids"]
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_slot._sequence") + F.col("_n") - F.col("_slot._first")).alias("sequence_id"), F.col("_slot.offset").alias("offset"), *extra)


def sequences(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids (in place order). A group holds ``size`` tokens at most."""
    placed = pack(pieces(docs, tokenizer_path, size, with_ids=True), size)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
