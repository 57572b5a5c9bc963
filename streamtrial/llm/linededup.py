"""Line deduplication by a segment-partition edit join.

Equal lines, and lines within the edits that the length of the shorter one allows, are one class (with all lines
that are so connected); only the first line of a class, by document id and place, stays. One edit is allowed
for each ``EDIT_CHARS`` characters, ``EDITS`` at most, so the shortest lines are linked only if they are equal.
Blank lines part paragraphs and stay.

A line that allows e edits is cut into e + 1 segments of even length. If two lines are within e edits, a segment
of the shorter one occurs unchanged in the other (pigeonhole), near its place: for a line and each length that
is at most e below its own, only the starts that the edits left and right of the segment allow are
probed (multi-match-aware selection of Pass-Join). Index and probe rows share buckets of (length,
segment, content). The lines of a bucket come to one task, in blocks of bounded size, which verifies pairs by a
banded bit-parallel edit distance if the lengths and the parities of character counts allow it, and gives
the links that connect what is connected: fewer than lines, whatever the bucket looks like. A bucket of more
than ``CHUNK`` lines is worked on as pairs of chunks; the work in them (not the rows that they give) grows with
the square of a bucket of lines that are not connected. Equal lines have one id (a 64-bit hash; the places are
grouped by 96 bits), so they are one class without a join.

Defined cases: a null text has no lines and stays null; an empty one has one empty line and stays; rows with
the same id and text count as one document, rows with the same id and different texts as documents of their own, in
the order of a hash of the text; lines of rows without an id come first and stay; very long texts and lines are
worked on whole; extra columns of any name are kept; an empty table gives no rows; ties can't occur, as a place
belongs to one line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamtrial.llm.common import BATCH_ROWS, SLICE_BYTES, Scratch, SubstringHash, bounded, mix64, slices, string_parts, written
from streamtrial.llm.linking import components, sized

EDITS, EDIT_CHARS = 2, 15
#: Shortest line that ``EDITS + 1`` segments can be cut from; below it no edit is allowed, whatever EDIT_CHARS is.
LEAST_CHARS = EDITS + 1
#: Lines, and bytes of lines, of a block; larger buckets are cut into chunks, and each two chunks are a block.
CHUNK, CHUNK_BYTES = 4096, 16 << 20
#: Lines of a bucket up to which all its pairs are looked at together with those of other buckets.
SMALL = 16
#: Ids of lines that a task remembers so as not to give the rows of a repeated line again.
REMEMBERED = 200_000
NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, line, id, of lines that aren't blank."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(NOT_BLANK))
    return rows.withColumn("id", F.xxhash64("line"))


def allowed_edits(length: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """Edits that the shorter line of a pair allows."""
    return np.where(length < LEAST_CHARS, 0, np.minimum(length // EDIT_CHARS, edits))


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and size of the edits + 1 segments of lines of such lengths; the last ones are longer by one."""
    k = edits + 1
    short, longer = length // k, length % k
    out, at = [], np.zeros_like(length)
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at = at + size
    return out


def keys(lines: list[str], edits: int = EDITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, line (place in the list) and whether it is an index row, of all lines."""
    length = np.array([len(v) for v in lines], np.int64)
    start = np.cumsum(length) - length
    hashed = SubstringHash(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32))
    place = np.arange(len(lines))
    bucket, own, index = [], [], []

    def add(mask: np.ndarray, i: int, of: np.ndarray, at: np.ndarray, size: np.ndarray, indexed: bool) -> None:
        label = mix64(of[mask].astype(np.uint64) * np.uint64(64) + np.uint64(i))
        bucket.append(mix64(hashed(start[mask] + at[mask], size[mask]) + label))
        own.append(place[mask])
        index.append(np.full(int(mask.sum()), indexed))

    for less in range(edits + 1):
        other = length - less
        may = allowed_edits(other, edits)
        for e in range(max(1, less), edits + 1):
            fits = may == e
            for i, (at, size) in enumerate(segments(other, e)):
                if not less:
                    add(fits, i, other, at, size, True)
                for shift in range(max(-i, less - (e - i)), min(i, less + e - i) + 1):
                    if less or shift:
                        to = at + shift
                        add(fits & (to >= 0) & (to + size <= length), i, other, to, size, False)
    return np.concatenate(bucket), np.concatenate(own), np.concatenate(index)


#: Characters that one block of pairs holds when padded to its longest.
BLOCK_CHARS = 1 << 21


def within(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within ``edits`` edits."""
    out = np.array([abs(len(x) - len(y)) <= edits for x, y in zip(a, b)], bool)
    todo = np.flatnonzero(out)
    rows = [_trimmed(a[i], b[i]) for i in todo]
    order = sorted(range(len(rows)), key=lambda r: -len(rows[r][1]))
    at = 0
    while at < len(order):
        some = order[at : at + max(1, BLOCK_CHARS // (len(rows[order[at]][1]) + 1))]
        out[todo[some]] = _banded([rows[r] for r in some], edits) <= edits
        at += len(some)
    return out


def linked(a: list[str], b: list[str], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within the edits that its shorter line allows."""
    may = allowed_edits(np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64), edits)
    out = np.zeros(len(a), bool)
    for e in range(edits + 1):
        some = np.flatnonzero(may == e)
        if len(some):
            out[some] = within([a[i] for i in some], [b[i] for i in some], e)
    return out


def _codes(texts: list[str], before: int, after: int, fill: int) -> np.ndarray:
    out = np.full((len(texts), before + max(map(len, texts)) + after), fill, np.int32)
    for row, t in zip(out, texts):
        row[before : before + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _banded(rows: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Edit distances up to ``edits`` (more: some larger number) of pairs whose lengths differ by no more; second
    strings descend in length.

    Bit-parallel in a band: in column j of the matrix bit k of a word stands for row j + k - edits, so the band
    moves down with the columns. All pairs take a column together, with a few operations on 64-bit words.
    """
    wide = 2 * edits + 1
    la, lb = np.array([len(x) for x, _ in rows]), np.array([len(y) for _, y in rows])
    left, right = _codes([x for x, _ in rows], wide, wide, -1), _codes([y for _, y in rows], 0, 1, -2)
    one, full, low = np.uint64(1), np.uint64((1 << wide) - 1), np.uint64(wide - 1)
    rise = np.full(len(rows), ((1 << (edits + 1)) - 1) << edits, np.uint64)  # rows from 1 on, in column 0
    fall = np.zeros(len(rows), np.uint64)
    score = np.minimum(la, edits)
    alive = len(rows) - np.searchsorted(lb[::-1], np.arange(int(lb[0])), side="right")
    for j, m in enumerate(alive):
        match = np.zeros(m, np.uint64)
        for k in range(wide):
            match |= (left[:m, wide + j + k - edits] == right[:m, j]).astype(np.uint64) << np.uint64(k)
        vp, vn = rise[:m], fall[:m]
        diagonal = ((((match & vp) + vp) & full) ^ vp) | match | vn
        hp, hn = vn | (full & ~(diagonal | vp)), diagonal & vp
        # along the lower border of the band while it is inside, then along the last row
        inside = j + 1 + edits <= la[:m]
        bit = np.clip(la[:m] - j - 1 + edits, 0, wide - 1).astype(np.uint64)
        step = np.where(inside, ~(diagonal >> low) & one, (hp >> bit) & one).astype(np.int64)
        score[:m] += step - np.where(inside, np.uint64(0), (hn >> bit) & one).astype(np.int64)
        down = diagonal >> one
        rise[:m], fall[:m] = hn | (full & ~(down | hp)), down & hp
    return score


def _trimmed(x: str, y: str) -> tuple[str, str]:
    """Without their common head and tail."""
    def common(most: int, part: Callable[[str, int], str]) -> int:
        low = 0
        while low < most:
            mid = (low + most + 1) // 2
            low, most = (mid, most) if part(x, mid) == part(y, mid) else (low, mid - 1)
        return low

    n = min(len(x), len(y))
    i = common(n, lambda t, k: t[:k])
    j = common(n - i, lambda t, k: t[len(t) - k :])
    return x[i : len(x) - j], y[i : len(y) - j]


def members_of(lines: DataFrame, edits: int) -> DataFrame:
    """bucket, id, mark of the index and probe rows of all lines; a task gives those of a line once, if it remembers it.

    ``mark``: twice the line's bytes, plus one for an index row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, "line"):
            ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
            new = np.array([v not in seen for v in ids.tolist()], bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(ids[new].tolist())
            part, ids = part.take(pa.array(first[new])), ids[new]
            if not len(ids):
                continue
            bucket, own, index = keys(part.column("line").to_pylist(), edits)
            mark = 2 * string_parts(part.column("line"))[2][own] + index
            for a in range(0, len(bucket), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a:b].view(np.int64)), pa.array(ids[own[a:b]]), pa.array(mark[a:b])], names=["bucket", "id", "mark"])

    return lines.select("id", "line").mapInArrow(run, "bucket long, id long, mark long")


def shared(members: DataFrame) -> DataFrame:
    """bucket, id, indexed and chunks, of the members of buckets with an index row and more than one line."""
    whole = Window.partitionBy("bucket")
    marked = members.withColumns({"lo": F.min("id").over(whole), "hi": F.max("id").over(whole), "any": F.max(F.col("mark") % 2).over(whole), "n": F.count("*").over(whole), "bytes": F.sum("mark").over(whole) / 2})
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int")
    several = marked.where("lo < hi and any = 1").groupBy("bucket", "id").agg(F.max(F.col("mark") % 2 == 1).alias("indexed"), F.max(chunks).alias("chunks"))
    return several.select("bucket", "id", "indexed", "chunks")


def parities(lines: list[str]) -> np.ndarray:
    """Per line (none is empty) a bit for each of 64 classes of characters: whether their number is odd. An edit changes two bits at most."""
    length = np.array([len(v) for v in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bitwise_xor.reduceat(np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), np.cumsum(length) - length)


def block_links(group: np.ndarray, side: np.ndarray, indexed: np.ndarray, lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of linked lines within the groups (sorted), enough to connect all that are connected.

    Of a block of two chunks (``side`` -1 and 1; 0: one chunk) only pairs across are looked at. Groups up to ``SMALL``
    lines are worked on together. In a larger one each line in turn is held against the later ones that aren't
    connected with it yet.
    """
    length, parity = np.array([len(v) for v in lines], np.int64), parities(lines)
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    starts = np.append(0, ends[:-1])
    size = np.repeat(ends - starts, ends - starts)

    def candidates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        may = allowed_edits(np.minimum(length[a], length[b]), edits)
        ok = (np.abs(length[a] - length[b]) <= may) & (indexed[a] | indexed[b]) & ((side[a] == 0) | (side[a] != side[b]))
        ok &= np.bitwise_count(parity[a] ^ parity[b]) <= 2 * may
        return a[ok], b[ok]

    def tested(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return linked([lines[i] for i in a], [lines[i] for i in b], edits)

    small = np.flatnonzero(size <= SMALL)
    found_a, found_b = [], []
    for d in range(1, SMALL):
        a = small[small + d < len(group)]
        a, b = candidates(*(lambda a: (a, a + d))(a[group[a] == group[a + d]]))
        found_a.append(a)
        found_b.append(b)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    ok = tested(a, b)
    out_a, out_b = [a[ok]], [b[ok]]
    for s, e in zip(starts, ends):
        if e - s <= SMALL:
            continue
        label, held = np.arange(e - s), []

        def join_up() -> None:
            a, b = (np.concatenate(v) for v in zip(*held))
            held.clear()
            ok = tested(a, b)
            for x, y in zip(a[ok], b[ok]):
                u, v = label[x - s], label[y - s]
                if u != v:
                    label[label == v] = u
                    out_a.append(np.array([x]))
                    out_b.append(np.array([y]))

        for k in range(e - s - 1):
            b = np.flatnonzero(label[k + 1 :] != label[k]) + (s + k + 1)
            held.append(candidates(np.full(len(b), s + k), b))
            if sum(len(x) for x, _ in held) >= 1024:
                join_up()
        join_up()
    return np.concatenate(out_a), np.concatenate(out_b)


def line_classes(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """id, component of the lines that are linked with others; ``lines``: id, line."""
    spark = bounded(lines.sparkSession)
    long = lines.where(F.length("line") >= EDIT_CHARS)
    names = ["bucket", "i", "j", "side", "id", "indexed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def worked(rest: pa.Table, to: int) -> pa.RecordBatch:
            x = {k: rest.column(k).slice(0, to).to_numpy() for k in names}
            change = np.zeros(to, np.int64)
            change[1:] = (x["bucket"][1:] != x["bucket"][:-1]) | (x["i"][1:] != x["i"][:-1]) | (x["j"][1:] != x["j"][:-1])
            a, b = block_links(np.cumsum(change), x["side"], x["indexed"], rest.column("line").slice(0, to).to_pylist(), edits)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x["id"][a], x["id"][b])), pa.array(np.maximum(x["id"][a], x["id"][b]))], names=["a", "b"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = [rest.column(k)[-1].as_py() for k in names[:3]]
            same = np.logical_and.reduce([rest.column(k).to_numpy() == v for k, v in zip(names[:3], last)])
            to = int(np.argmax(same))  # where the group begins that may go on in the next batch
            if to and (rest.nbytes > SLICE_BYTES or to >= 8 * BATCH_ROWS):
                yield worked(rest, to)
                rest = rest.slice(to).combine_chunks()
        if rest is not None:
            yield worked(rest, rest.num_rows)

    with Scratch(spark) as keep:
        rows = keep(shared(members_of(long, edits)))
        ids = keep(rows.select("id").distinct())
        text = keep(long.select("id", "line").join(sized(ids), "id", "left_semi").dropDuplicates(["id"]))
        own = F.pmod(F.xxhash64("id"), "chunks").cast("int")
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        rows = rows.select("id", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "indexed")
        rows = rows.join(text, "id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
        found = keep(rows.select(*names, "line").mapInArrow(run, "a long, b long").distinct())
        return written(components(found))


def duplicates(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, text_key, drop: the places of the lines of each document that repeat an earlier line; documents without any have no row."""
    lines = lines_of(docs)
    classes = line_classes(lines, edits)
    with Scratch(docs.sparkSession) as keep:
        found = keep(lines.select("doc_id", "text_key", "pos", "id", F.hash("line").alias("more")))
        # lines are equal if 96 bits of hashes are; linked ones have been compared themselves
        found = found.join(sized(classes), "id", "left").select("doc_id", "text_key", "pos", F.coalesce("component", "id").alias("c"), F.when(F.col("component").isNull(), F.col("more")).otherwise(0).alias("more"))
        place = F.struct("doc_id", "text_key", "pos")
        firsts = found.groupBy("c", "more").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
        later = found.join(firsts, ["c", "more"]).where(~place.eqNullSafe(F.col("first"))).where("doc_id is not null")
        return written(later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("drop")))


def without(text: Column, drop: Column) -> Column:
    """The text without the lines at the places ``drop``; the time grows with the lines only."""
    kept = lambda v: F.array_except(F.sequence(F.lit(0), F.size(v) - 1), drop)
    left = F.get(F.transform(F.array(F.split(text, "\n")), lambda v: F.transform(kept(v), lambda i: F.get(v, i))), F.lit(0))
    return F.when(drop.isNull(), text).otherwise(F.array_join(left, "\n"))


def _rows(docs: DataFrame, edits: int) -> DataFrame:
    """``r`` (a struct of all columns), the places dropped, and the text without them; no names of ``docs`` can clash."""
    drops = duplicates(docs, edits)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    drops = sized(drops, F.lit(24) + 4 * F.size("drop"))
    rows = rows.join(drops, (F.col("r.doc_id") == F.col("doc_id")) & (F.xxhash64("r.text") == F.col("text_key")), "left").select("r", "drop")
    return rows.withColumn("kept", without(F.col("r.text"), F.col("drop")))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """All columns of ``docs`` with the later lines taken out of ``text``; rows of which only blanks are left are taken out."""
    rows = _rows(docs, edits).where(F.col("drop").isNull() | F.col("kept").rlike(NOT_BLANK))
    return rows.select(*[F.col("kept").alias(c) if c == "text" else F.col(f"r.`{c}`").alias(c) for c in docs.columns])


def digest(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """Per row doc_id, n_lines, n_dropped, dropped (places), kept_md5 of the text that stays."""
    rows = _rows(docs, edits)
    total = F.when(F.col("r.text").isNull(), 0).otherwise(F.size(F.split("r.text", "\n"))).cast("long")
    gone = F.coalesce("drop", F.array().cast("array<int>"))
    return rows.select(F.col("r.doc_id").alias("doc_id"), total.alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), gone.alias("dropped"), F.md5(F.col("kept").cast("binary")).alias("kept_md5"))
