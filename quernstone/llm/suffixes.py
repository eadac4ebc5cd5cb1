"""Operator 1: exact-substring dedup by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Beside
these, bytes in repeated strings of another length can be counted in the same pass: strings
of the least length are found, and all lengths read off the same sort.

1. Anchors. Among the grams of ``GRAM`` bytes in a string of LENGTH bytes, the one of least
   polynomial hash (the leftmost of equals) is its anchor. Equal strings have equal
   anchors at equal offsets, so only strings with equal anchors need be compared. Strings
   that start one after another and share an anchor form a *run*; a run's bytes (and those
   after it that longer strings reach) are known by a 128-bit digest. Runs whose anchor occurs
   once in the corpus are done.
2. Equal runs are counted, not compared: all strings in a run that occurs twice repeat.
3. Distinct runs with one anchor gram are sorted as suffixes from the anchor on, and as
   reversed prefixes before it, in a mergesort. A comparison finds the common extension by
   binary search over prefix polynomial hashes, so it takes a logarithm of LENGTH steps;
   neighbours' extensions are then verified byte by byte, and a hash collision, if there
   is one, makes the sort start again with another multiplier. Two strings at offset o from
   the anchor are equal where both extensions reach that far: groups of rows between
   shorter extensions, in both orders, say which.
4. A gram with more than ``CLASS`` distinct runs (a passage that very many documents quote
   in other surroundings) is split: its strings go to blocks of 16 offsets that share their
   common bytes (known by a 128-bit digest, as equal runs are); equal blocks are counted
   first, and of those that differ, each string goes by its offset and all its bytes beyond
   the common ones. No task gets a class that grows with the corpus.

Defined cases: null text counts as empty; texts shorter than LENGTH lose nothing; repeated
rows are copies of each other and go wholly if they are long enough; very long texts are
read in slices; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, release, table

LENGTH = 400
#: Bytes of a repeated passage: fifty words of four letters and a space.
PASSAGE = 250
GRAM = 48
CLASS = 1024
BLOCK = 16
SLICE = 1 << 19
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5, 0xAF251AF3B0F025B5)
_NO_ID = -(1 << 63)


class _Hashes:
    """Prefix polynomial hashes mod 2**64 with mixed byte values."""

    def __init__(self, longest: int, base: int = _MULTIPLIERS[0]):
        steps = np.ones((2, longest + 1), np.uint64)
        steps[0, 1:], steps[1, 1:] = base, pow(base, -1, 1 << 64)
        self.power, self.inverse = np.cumprod(steps, axis=1)
        self.value = np.random.default_rng(base & 0xFFFF).integers(1, 1 << 63, 256, dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """data: one text, or a matrix with a text a row."""
        n = data.shape[-1]
        out = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.cumsum(self.value[data] * self.power[:n], axis=-1, out=out[..., 1:])
        return out

    def grams(self, data: np.ndarray, size: int) -> np.ndarray:
        p = self.prefixes(data)
        h = (p[size:] - p[:-size]) * self.inverse[: len(data) - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MULTIPLIERS[1])
        return h ^ (h >> np.uint64(29))


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least value of each window of size values."""
    span = 1
    while span * 2 <= size:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (size - span)], x[size - span :]) if span < size else x


def runs_of(data: np.ndarray, ends: np.ndarray, length: int, gram: int, hashes: _Hashes):
    """(first start, strings, anchor, anchor hash) of the runs of texts that lie one after
    another in data; ends: where each text ends."""
    if len(data) < length:
        return (np.array([], np.int64),) * 3 + (np.array([], np.uint64),)
    h = hashes.grams(data, gram)
    mask = np.uint64((1 << 20) - 1)
    at = _window_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & mask
    at = at.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    edges = np.zeros(len(at) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, ends[long] - length + 1, -1)
    valid = np.cumsum(edges[:-1]) > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    # a run ends before the next one or where its text has no string any more
    stop = np.append(first[1:], len(at))
    upto = ends[np.searchsorted(ends, first, side="right")] - length + 1
    return first, np.minimum(stop, upto) - first, at[first], h[at[first]]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column, and their offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _find_runs(length: int, reach: int, gram: int):
    """mapInArrow function: (k1, k2, bytes) -> the runs of strings of `length` bytes; size:
    bytes of a run, up to the end of its last string of `reach` bytes or of the text."""
    names = ["k1", "k2", "start", "many", "off", "size", "ah", "u1", "u2"]

    def pieces(offsets: np.ndarray):
        """(first text, one past the last, from byte, to byte): whole texts up to SLICE
        bytes, or a slice of one text."""
        i, n = 0, len(offsets) - 1
        while i < n:
            if offsets[i + 1] - offsets[i] > SLICE:
                for a in range(offsets[i], offsets[i + 1] - length + 1, SLICE):
                    yield i, i + 1, a, min(a + SLICE + length - 1, offsets[i + 1])
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
            yield i, j, offsets[i], offsets[j]
            i = j

    def run(batches):
        hashes = _Hashes(SLICE + length)
        for b in batches:
            data, offsets = _texts(b.column(2))
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            view, digest = memoryview(data), xxhash.xxh3_128_digest
            for i, j, a, z in pieces(offsets):
                ends = np.minimum(offsets[i + 1 : j + 1], z) - a
                first, many, at, ah = runs_of(data[a:z], ends, length, gram, hashes)
                if not len(first):
                    continue
                text = i + np.searchsorted(ends, first, side="right")
                begin = a + first
                size = np.minimum(many + reach - 1, offsets[text + 1] - begin)
                u = np.frombuffer(b"".join([digest(view[s : s + m]) for s, m in zip(begin.tolist(), size.tolist(), strict=True)]), "<i8").reshape(-1, 2)
                cols = [k1[text], k2[text], begin - offsets[text], many, at - first, size, ah.view(np.int64), u[:, 0], u[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    return run


# --- sorting the distinct runs of a class


class _Side:
    """One direction from the anchor: the members' bytes that way, in reading order."""

    def __init__(self, data: np.ndarray, size: np.ndarray, base: int):
        self.data, self.size = data, size
        self.prefix = _Hashes(data.shape[1], base).prefixes(data)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of members i and j, by binary search."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.prefix[i, mid] == self.prefix[j, mid]
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes after suffix j (a prefix comes first)."""
        n = self.extension(i, j)
        si, sj = self.size[i], self.size[j]
        ends = (n == si) | (n == sj)
        k = np.minimum(n, self.data.shape[1] - 1)
        return np.where(ends, si > sj, self.data[i, k] > self.data[j, k])

    def order(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of all classes at once; class of place p: [begin[p], end[p])."""
        n = len(begin)
        perm, place, width = np.arange(n), np.arange(n), 1
        while width < (end - begin).max(initial=0):
            q = place - begin
            left = (q // width) % 2 == 0
            block = begin + q // (2 * width) * (2 * width)
            lo = np.minimum(np.where(left, block + width, block), end)
            hi = np.minimum(lo + width, end)
            first = lo.copy()
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                x, y = perm[open_], perm[mid]
                goes = np.where(left[open_], self.after(x, y), ~self.after(y, x))
                lo[open_] = np.where(goes, mid + 1, lo[open_])
                hi[open_] = np.where(goes, hi[open_], mid)
            own = q % width
            sorted_ = np.empty_like(perm)
            sorted_[block + own + (lo - first)] = perm
            perm, width = sorted_, width * 2
        return perm

    def neighbours(self, perm: np.ndarray, begin: np.ndarray) -> np.ndarray | None:
        """Common extension of each place with the place before (-1 at a class's first);
        None if the bytes don't bear the hashes and the order out."""
        out = np.full(len(perm), -1, np.int64)
        p = np.flatnonzero(begin != np.arange(len(perm)))
        i, j = perm[p], perm[p - 1]
        out[p] = n = self.extension(i, j)
        for k in range(0, len(p), 1024):
            a, b, m = i[k : k + 1024], j[k : k + 1024], n[k : k + 1024]
            same = self.data[a] == self.data[b]
            agreed = np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
            si, sj = self.size[a], self.size[b]
            k_ = np.minimum(m, self.data.shape[1] - 1)
            ordered = np.where(m == np.minimum(si, sj), si >= sj, self.data[a, k_] > self.data[b, k_])
            if not ordered.all() or (np.minimum(agreed, np.minimum(si, sj)) != m).any():
                return None
        return out


def repeated(cls: np.ndarray, copies: np.ndarray, off: np.ndarray, many: np.ndarray, texts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Matrix of members x string starts: whether that string also starts elsewhere.
    Members of a class stand together; off: the anchor's place in a member's bytes."""
    return repeated_at(cls, copies, off, many, texts, (length,))[0]


def repeated_at(cls: np.ndarray, copies: np.ndarray, off: np.ndarray, many: np.ndarray, texts: list[bytes], lengths: tuple[int, ...]) -> list[np.ndarray]:
    """repeated() for strings of each of lengths, from one sort. A member's bytes may end
    before its last starts' longer strings do; these are no strings."""
    n, most_off, reach = len(cls), int(off.max()), max(lengths)
    right = np.zeros((n, reach), np.uint8)
    left = np.zeros((n, max(1, most_off)), np.uint8)
    right_size = np.zeros(n, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    for k, (t, o) in enumerate(zip(texts, off.tolist(), strict=True)):
        x = np.frombuffer(t, np.uint8)
        r = x[o : o + reach]
        right[k, : len(r)] = r
        right_size[k] = len(r)
        left[k, :o] = x[:o][::-1]
    new = np.append(True, cls[1:] != cls[:-1])
    firsts = np.flatnonzero(new)
    begin = firsts[np.cumsum(new) - 1]
    end = np.append(firsts[1:], n)[np.cumsum(new) - 1]
    for base in _MULTIPLIERS:
        sides = [_Side(right, right_size, base), _Side(left, off, base)]
        orders = [s.order(begin, end) for s in sides]
        near = [s.neighbours(p, begin) for s, p in zip(sides, orders, strict=True)]
        if all(x is not None for x in near):
            break
    else:
        raise RuntimeError("hash collisions with every multiplier")
    out = [np.zeros((n, int(many.max())), bool) for _ in lengths]
    group = np.empty((2, n), np.int64)
    for o in range(int((off - many + 1).min()), most_off + 1):
        starts = (off - many < o) & (o <= off)
        for marks, length in zip(out, lengths, strict=True):
            here = np.flatnonzero(starts & (off - o + length <= size))
            if not len(here):
                continue
            for g, perm, x, t in zip(group, orders, near, (length - o, o), strict=True):
                g[perm] = np.cumsum(x < t)  # t is 0 at the left for o = 0: classes still part at -1
            _, at, count = np.unique(group[0, here] * (n + 1) + group[1, here], return_inverse=True, return_counts=True)
            marks[here, off[here] - o] = (count[at] > 1) | (copies[here] > 1)
    return out


def _intervals(marks: np.ndarray):
    """Row, first and last column of each stretch of marked columns."""
    padded = np.zeros((marks.shape[0], marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    row, lo = np.nonzero(step == 1)
    _, hi = np.nonzero(step == -1)
    return row, lo, hi - 1


_CLASS_COLUMNS = ["ah", "u1", "u2", "n", "off", "many", "bytes"]


def _sort_classes(lengths: tuple[int, ...]):
    """mapInArrow function: rows sorted by class -> (ah, u1, u2, length, lo, hi) repeated starts."""

    def solve(t: pa.Table):
        ah, u1, u2, n, off, many = (t.column(c).to_numpy() for c in _CLASS_COLUMNS[:-1])
        found = repeated_at(ah, n, off.astype(np.int64), many.astype(np.int64), t.column("bytes").to_pylist(), lengths)
        parts = []
        for length, marks in zip(lengths, found, strict=True):
            row, lo, hi = _intervals(marks)
            parts.append([ah[row], u1[row], u2[row], np.full(len(row), length, np.int32), lo.astype(np.int32), hi.astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["ah", "u1", "u2", "length", "lo", "hi"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            for k in range(0, b.num_rows, 2048):
                part = b.slice(k, 2048)
                ah = part.column(0).to_numpy()
                # cut after the last class that surely ended
                cut = int(np.searchsorted(ah, ah[-1]))
                if cut == 0:
                    held.append(part)
                    continue
                yield solve(pa.Table.from_batches([*held, part.slice(0, cut)]))
                held = [part.slice(cut)]
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _split_classes(length: int):
    """mapInArrow function: rows of large classes -> one row for each block of offsets."""
    names = ["ah", "u1", "u2", "n", "block", "c1", "c2", "b1", "b2", "lo", "at", "ends"]

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in batches:
            out: list[list] = [[] for _ in names]
            for ah, u1, u2, n, off, many, data in zip(*(b.column(c).to_pylist() for c in _CLASS_COLUMNS), strict=True):
                view, many = memoryview(data), min(many, len(data) - length + 1)
                if many < 1:
                    continue
                for block in range((off - many + 1) // BLOCK, off // BLOCK + 1):
                    lo, hi = max(0, off - block * BLOCK - BLOCK + 1), min(many - 1, off - block * BLOCK)
                    common = off - block * BLOCK
                    after = common + length - BLOCK + 1
                    c = np.frombuffer(digest(view[common:after]), "<i8")
                    e = np.frombuffer(digest(view[lo : hi + length]), "<i8")
                    # what each string has besides the common bytes: BLOCK - 1 bytes, before and after
                    each = b"".join(data[i:common] + data[after : i + length] for i in range(lo, hi + 1))
                    for col, v in zip(out, (ah, u1, u2, n, block, c[0], c[1], e[0], e[1], lo, common, each), strict=True):
                        col.append(v)
            kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return run


_FOUND = "ah bigint, u1 bigint, u2 bigint, length int, lo int, hi int"


def _large_classes(rows: DataFrame, length: int) -> DataFrame:
    """Repeated starts (ah, u1, u2, length, lo, hi) in classes of many distinct runs."""
    schema = "ah bigint, u1 bigint, u2 bigint, n bigint, block int, c1 bigint, c2 bigint, b1 bigint, b2 bigint, lo int, at int, ends binary"
    blocks = materialize(rows.select(*_CLASS_COLUMNS).mapInArrow(_split_classes(length), schema), "suffix-blocks")
    width = BLOCK - 1
    size = F.floor(F.octet_length("ends") / width).cast("int")
    common = ["ah", "block", "c1", "c2"]
    same = blocks.groupBy(*common, "b1", "b2").agg(F.sum("n").alias("n"), F.min(F.struct("u1", "u2", "lo", "at", "ends")).alias("r"))
    same = materialize(same, "suffix-equal-blocks")
    twice = same.where("n > 1").select(*common, "b1", "b2")
    whole = blocks.join(twice, [*common, "b1", "b2"]).select("ah", "u1", "u2", "lo", (F.col("lo") + size - 1).alias("hi"))
    # blocks that differ, where others share their common bytes: each string by the rest of its bytes
    shared = same.groupBy(*common).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*common)
    differ = same.join(shared, common).select(*common, "n", "r.*")
    each = differ.select("*", F.posexplode(F.sequence(F.lit(0), size - 1)).alias("i", "_x"))
    start = (F.col("lo") + F.col("i")).cast("int")
    each = each.select(*common, "n", "u1", "u2", start.alias("start"), (F.col("at") - start).alias("l"), F.substring("ends", F.col("i") * width + 1, F.lit(width)).alias("e"))
    counts = each.groupBy(*common, "l", "e").agg(F.sum("n").alias("s")).where("s > 1").select(*common, "l", "e")
    single = each.where("n = 1").join(counts, [*common, "l", "e"]).select("ah", "u1", "u2", F.col("start").alias("lo"), F.col("start").alias("hi"))
    return whole.unionByName(single).withColumn("length", F.lit(length))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"_k1": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID).cast("bigint")), "_k2": F.xxhash64(text), "_bytes": text.cast("binary")})


def removed_ranges(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM) -> DataFrame:
    """(k1, k2, ranges) of each row that has repeated strings; ranges: array of (a, z, l),
    bytes from a to z in repeated strings of l bytes, which may overlap. k1, k2: _k1 and _k2
    of _keyed()."""
    bounded_batches(docs.sparkSession)
    least, reach = min(lengths), max(lengths)
    small = ("start", "many", "off", "size")
    found = _keyed(docs).select("_k1", "_k2", "_bytes").mapInArrow(_find_runs(least, reach, gram), "k1 bigint, k2 bigint, start bigint, many bigint, off bigint, size bigint, ah bigint, u1 bigint, u2 bigint")
    every = materialize(found.select("k1", "k2", *(F.col(c).cast("int").alias(c) for c in small), "ah", "u1", "u2"), "suffix-runs")
    # counts are tables of their own: joined to them, a frequent gram can be split over tasks
    again = materialize(every.groupBy("ah").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("ah"), "suffix-repeats")
    runs = materialize(every.join(again, "ah"), "suffix-candidates")
    for done in (every, again):  # most runs' anchors occur once: the disk they take is free again
        release(done)
    key = ["ah", "u1", "u2"]
    distinct = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", *small)).alias("r")).select(*key, "n", "r.*")
    distinct = materialize(distinct, "suffix-distinct")
    sizes = materialize(distinct.groupBy("ah").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")), "suffix-sizes")
    distinct = distinct.join(sizes, "ah")
    each = F.explode(F.array(*(F.lit(x) for x in lengths)))
    whole = distinct.where("n > 1").withColumn("length", each).withColumn("hi", F.least(F.col("many"), F.col("size") - F.col("length") + 1) - 1)
    whole = whole.where("hi >= 0").select(*key, "length", F.lit(0).alias("lo"), "hi")
    # runs that occur once, and those of their classes they are to be compared with
    open_ = distinct.where("m > 1 and least = 1")
    # rows that repeat id and text are one row here, made so before the shuffle
    own = _keyed(docs).groupBy("_k1", "_k2").agg(F.min("_bytes").alias("_bytes"))
    joined = open_.join(own, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    cut = F.substring("_bytes", F.col("start") + 1, F.col("size"))
    rows = materialize(joined.select(*key, "n", "off", "many", "m", cut.alias("bytes")), "suffix-classes")
    classes = rows.where(F.col("m") <= CLASS).select(*_CLASS_COLUMNS).repartition("ah").sortWithinPartitions("ah")
    starts = whole.unionByName(classes.mapInArrow(_sort_classes(lengths), _FOUND))
    large = rows.where(F.col("m") > CLASS)
    if not large.isEmpty():
        for length in lengths:
            starts = starts.unionByName(_large_classes(large, length))
    a = F.col("start") + F.col("lo")
    spans = runs.join(starts, key).select("k1", "k2", F.struct(a.alias("a"), (F.col("start") + F.col("hi") + F.col("length")).alias("z"), F.col("length").alias("l")).alias("s"))
    return spans.groupBy("k1", "k2").agg(F.collect_set("s").alias("ranges"))


def _cut(with_text: bool, length: int, passage: int | None):
    """mapInArrow function: drops the ranges of strings of `length` bytes from _bytes, and
    counts the bytes in those of `passage` bytes."""

    def covered(ranges: list[dict], of: int) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        for a, z in sorted((x["a"], x["z"]) for x in ranges if x["l"] == of):
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(z, spans[-1][1])
            else:
                spans.append((a, z))
        return spans

    def run(batches):
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            rest = [i for n, i in at.items() if n not in ("_bytes", "ranges")]
            out: list[list] = [[], [], [], [], [], []]
            for data, ranges in zip(b.column(at["_bytes"]), b.column(at["ranges"]), strict=True):
                data, ranges = data.as_py(), ranges.as_py() or []
                spans = covered(ranges, length)
                ends = [0, *(z for _, z in spans)]
                left = b"".join(data[a:z] for a, z in zip(ends, [*(a for a, _ in spans), len(data)], strict=True))
                inside = sum(z - a for a, z in covered(ranges, passage)) if passage else None
                row = (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None, inside)
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            arrays = [b.column(i) for i in rest] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[b.schema.names[i] for i in rest] + list(_NEW))

    return run


_NEW = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept_sha256": T.StringType(), "kept": T.StringType(), "n_passage_bytes": T.LongType()}


def dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """The columns of keep, n_bytes, n_removed, n_spans, kept_sha256, and kept (the text
    left, if with_text, without characters of which a part went). With passage, also
    n_passage_bytes: bytes in strings of that many bytes that start elsewhere as well."""
    ranges = removed_ranges(docs, tuple(sorted({length, passage or length})))
    own = _keyed(docs).select(*keep, "_k1", "_k2", "_bytes")
    joined = own.join(ranges, (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2")), "left").select(*keep, "_bytes", "ranges")
    schema = T.StructType([joined.schema[c] for c in keep] + [T.StructField(n, k) for n, k in _NEW.items()])
    out = joined.mapInArrow(_cut(with_text, length, passage), schema)
    return out if passage else out.drop("n_passage_bytes")


def deduped_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the text that is left, and their columns; no row goes."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*rest).alias("_row"))
    out = dedup(packed, keep=("_row",), with_text=True, length=length)
    cols = {c: F.col("_row").getField(c) for c in rest} | {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(cols[c].alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns at LENGTH, and the bytes in repeated passages of PASSAGE."""
    return dedup(table(spark, sf_dir, "documents"), passage=PASSAGE).drop("kept")
