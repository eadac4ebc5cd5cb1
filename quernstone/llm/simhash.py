"""Operator 10: SimHash near-dedup through a segment-popcount embedding.

A text's fingerprint takes the majority bit of the XXH64 hashes of its word shingles. The
64 bits are cut into 32 segments of two bits; a fingerprint is embedded as the vector of
its segments' bit counts. The Manhattan distance of two vectors never exceeds the Hamming
distance of the fingerprints. Writing a count in unary (0, 1, 2 as 00, 01, 11) makes the
vector one 64-bit word whose Hamming distance *is* the Manhattan distance.

Links are found by a range join on a grid over that space: the 32 dimensions are cut into
``GROUPS`` groups, and vectors at distance ``DISTANCE`` or less agree in all but
``DISTANCE`` groups. So each vector falls into one cell for each choice of the groups that
agree; those that share a cell are compared by Manhattan distance and then exactly.

Only distinct fingerprints are joined, so copies cost nothing. A cell that holds many
distinct fingerprints (near copies of one text) is dealt out once more by choices of
groups of the bits themselves, until its parts are small: nothing is dropped, and no task
gets a cell that grows with the corpus. Within a part, the links are reduced to a spanning
forest before they leave the task. Components come from alternating large-star and
small-star rounds over these edges.

With ``verify`` fingerprints only propose: within each component, distinct texts are
compared by exact Jaccard of their five-word shingles, and components are taken again from
the pairs at ``ALIKE`` (or what the caller states) or more. Most pairs of
a group of near copies need no comparison: the shingles' Jaccard distance is a metric.

Defined cases: null text counts as empty and has fingerprint zero, as has text without
words; a null id (and -2**63, which stands for it) gets a component like any other and
stands before all ids as smallest; different texts under one id, or without one, are
documents of their own; repeated rows are copies; very long texts are hashed in pieces of
65,536 shingles; a bit that half the hashes have is 0; an empty table gives no rows; extra
columns, whatever their names, are not read, and one_of_each gives them back.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, table

SHINGLE = 3
SEED = 42
DISTANCE = 3
GROUPS = 7
#: Distinct fingerprints up to which a cell is compared in one go.
CELL = 4096
#: Words of a shingle and least Jaccard similarity (4 / 5) at which near copies are verified.
VERIFY = 5
ALIKE = (4, 5)
#: Shingles up to which a component is verified in one go; larger ones by pairs of blocks.
BLOCK = 1_000_000
#: A null id, held as the smallest of all.
_NO_ID = -(1 << 63)


def _majority(hashes: list[int]) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):  # long texts in pieces
        bits = np.unpackbits(np.array(hashes[k : k + 65536], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _shingles(words: list[bytes], shingle: int, seed: int = SEED) -> list[int]:
    """Hashes of the shingles; fewer words than one takes are one shingle."""
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    line, at, starts = b" ".join(words), 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[shingle:]] + [len(line)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)]


def word_fingerprints(texts: list[str | None], seeds: tuple[int, ...]) -> np.ndarray:
    """64-bit SimHashes of the sets of the texts' words (texts x seeds). A word is hashed
    once; each seed mixes that hash anew, so more seeds cost no more hashing."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros((len(texts), len(seeds)), np.uint64)
    sizes, hashes = [], []
    for t in texts:
        words = set((t or "").encode().lower().split())
        sizes.append(len(words))
        hashes.append(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)))
    every, size = np.concatenate([np.array([], np.uint64), *hashes]), np.array(sizes, np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    ones = np.zeros((len(texts), 64), np.int64)
    for k, seed in enumerate(seeds):
        ones[:] = 0
        for a in range(0, len(every), 65536):  # long texts in pieces
            h = every[a : a + 65536] + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            own = owner[a : a + 65536]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(ones * 2 > size[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def word_fingerprint(text: str | None, seed: int = SEED) -> int:
    """64-bit SimHash of the set of a text's words."""
    return int(word_fingerprints([text], (seed,))[0, 0])


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of one text's word shingles."""
    hashes = _shingles((text or "").encode().lower().split(), shingle, seed)
    return _majority(hashes) if hashes else 0


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, word_seeds: tuple[int, ...] = (), keep: tuple[str, ...] = ("doc_id",), with_key: bool = False) -> DataFrame:
    """The columns of keep and fps, an array of bigints (64 bits as they are): that of the
    shingles, or one for each of word_seeds, of the words; with_key, key (of _key) too."""
    bounded_batches(docs.sparkSession)
    each = (lambda ts: word_fingerprints(ts, word_seeds)) if word_seeds else (lambda ts: [text_fingerprint(t, shingle) for t in ts])
    width = len(word_seeds) or 1
    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = T.StructType([f for f in rows.schema if f.name != "_text"] + [T.StructField("fps", T.ArrayType(T.LongType()))] + [T.StructField("key", T.BinaryType())] * with_key)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("_text")
            texts = b.column(at).to_pylist()
            fps = np.array(each(texts), "<u8").reshape(-1).view("<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, width, dtype=np.int32)), pa.array(fps))
            rest = [i for i in range(b.num_columns) if i != at]
            keys = [pa.array([_key((t or "").encode().lower().split()) for t in texts], pa.binary())] if with_key else []
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), lists, *keys], names=schema.names)

    return rows.mapInArrow(run, schema)


def embed(fp: Column) -> Column:
    """Bit counts of the 2-bit segments in unary: Hamming distance is Manhattan distance."""
    odd = F.lit(0x5555555555555555).cast("bigint")
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    low = fp.bitwiseAND(odd)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def masks(groups: int, apart: int, bits: int = 64, step: int = 2) -> list[int]:
    """Bit masks, one for each choice of groups - apart of the groups of segments."""
    cuts = [round(i * (bits // step) / groups) * step for i in range(groups + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, groups - apart)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cells(rows: DataFrame, value: Column, choices: list[int], over: tuple[str, ...] = ()) -> DataFrame:
    """One row for each choice of bits: its cell is a hash of (over, choice, those bits)."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.lit(_signed(m)).cast("bigint").alias("m")) for i, m in enumerate(choices))))
    dealt = rows.select("*", each.alias("_choice"))
    return dealt.withColumn("_cell", F.xxhash64(*over, F.col("_choice.c"), value.bitwiseAND(F.col("_choice.m")))).drop("_choice")


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest member, member) of the components of edges u - v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        was = top.copy()
        np.minimum.at(top, a, top[b])
        np.minimum.at(top, b, top[a])
        top = top[top]
        if np.array_equal(was, top):
            break
    far = top != np.arange(len(nodes))
    return nodes[top[far]], nodes[far]


def _links(distance: int):
    """mapInArrow function: rows (_cell, fp, id) sorted by cell -> edges of a forest."""

    odd = np.uint64(0x5555555555555555)

    def pairs(cell: np.ndarray, fp: np.ndarray, ids: np.ndarray):
        u, v, held = [], [], 0
        high, low = (fp >> np.uint64(1)) & odd, fp & odd
        unary = (low | high) | ((low & high) << np.uint64(1))  # as embed()
        d, here = 1, np.arange(len(cell))
        while True:
            here = here[here + d < len(cell)]
            here = here[cell[here] == cell[here + d]]
            if not len(here):
                break
            near = here[np.bitwise_count(unary[here] ^ unary[here + d]) <= distance]  # Manhattan distance: never above Hamming's
            near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= distance]
            u.append(ids[near])
            v.append(ids[near + d])
            held += len(near)
            d += 1
            if held > 1_000_000:
                u, v = ([x] for x in _forest(np.concatenate(u), np.concatenate(v)))
                held = 0
        return _forest(np.concatenate(u), np.concatenate(v)) if u else (np.array([], np.int64),) * 2

    def out(t: list[np.ndarray]):
        u, v = pairs(t[0], t[1].view(np.uint64), t[2])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        held = [np.array([], np.int64)] * 3
        for b in batches:
            t = [np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held)]
            if not len(t[0]):
                continue
            last = np.searchsorted(t[0], t[0][-1])  # the last cell may go on in the next batch
            held = [x[last:] for x in t]
            yield out([x[:last] for x in t])
        yield out(held)

    return run


def _compare(dealt: DataFrame, distance: int) -> DataFrame:
    rows = dealt.select("_cell", "fp", "id").repartition("_cell").sortWithinPartitions("_cell")
    return rows.mapInArrow(_links(distance), "u bigint, v bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (seed, fp, id) of each seed as
    all links do."""
    dealt = _cells(nodes.withColumn("_e", embed(F.col("fp"))), F.col("_e"), masks(groups, distance), ("seed",)).drop("_e", "seed")
    # large cells are dealt out again by 5 of 8, then 13 of 16 groups of bits; what has 52
    # bits in common has 4,096 members at most
    found: list[DataFrame] = []
    for level, finer in enumerate((masks(8, distance, step=1), masks(16, distance, step=1), None)):
        # a table of its own: joined to it, the rows of a large cell can be split over tasks
        counts = materialize(dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), f"simhash-counts{level}")
        dealt = materialize(dealt.join(counts, "_cell"), f"simhash-cells{level}")
        small = F.col("_n") <= CELL
        found.append(_compare(dealt if finer is None else dealt.where(small), distance))
        dealt = dealt.where(~small).drop("_n")
        if finer is None or dealt.isEmpty():
            break
        dealt = _cells(dealt, F.col("fp"), finer, ("_cell",))
    return reduce(DataFrame.unionByName, found)


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, root) of each id on an edge, root being the smallest id of its component."""
    up = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = materialize(up(edges), "edges")
    was = None
    for k in range(rounds):
        # large star: all larger neighbours of a node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (a table of its own, so that the edges of a node of very many can be split over tasks)
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"least{k}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(small.where("u <> v").distinct(), f"edges{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        was = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _keyed(docs: DataFrame) -> DataFrame:
    """id (null as the smallest of all), key (a digest of the text's words in their order)
    and shingles, sorted hashes of the distinct ones; no row for texts without words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            ids, keys, sets = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (t or "").encode().lower().split()
                if words:
                    ids.append(i)
                    keys.append(_key(words))
                    sets.append(np.unique(np.array(_shingles(words, VERIFY), "<u8")).view("<i8"))
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.array([], np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), lists], names=["id", "key", "shingles"])

    return docs.select("id", F.col("text").cast("string")).mapInArrow(run, "id bigint, key binary, shingles array<bigint>")


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def alike(sets: list[np.ndarray], alike_at: tuple[int, int] = ALIKE) -> np.ndarray:
    """For each set (of one hash or more) the first one of its component; two sets link if
    their Jaccard similarity is `alike_at` or more.

    A set that is not alike to an earlier leader becomes one and is compared with all. What
    is alike to a set near a leader is at twice that distance from the leader at most
    (Jaccard distance is a metric), so only sets in between are compared with all besides."""
    p, q = alike_at
    size = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(names), bool), np.arange(len(sets))

    def compare(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = at[starts[k] : starts[k] + size[k]]
        mark[own] = True
        both = np.add.reduceat(mark[at], starts, dtype=np.int64)
        mark[own] = False
        return both, size + size[k] - both

    def link(k: int, both: np.ndarray, union: np.ndarray) -> np.ndarray:
        near = both * q >= union * p
        found = np.unique(label[near])
        label[np.isin(label, found)] = found[0]
        return near

    free, between = np.ones(len(sets), bool), []
    while free.any():
        k = int(np.argmax(free))
        both, union = compare(k)
        near = link(k, both, union)
        free &= ~near
        between += [(k, x) for x in np.flatnonzero((both * q >= union * (2 * p - q)) & ~near)]
    done = set()
    for k, x in between:
        if x not in done and label[x] != label[k]:
            link(x, *compare(x))
            done.add(x)
    return label


def _verify(alike_at: tuple[int, int]):
    """mapInArrow function: rows (_group, node, shingles) sorted by group -> edges (u, v)."""

    def out(ids: list[int], sets: list[np.ndarray]):
        label = alike(sets, alike_at)
        ids = np.array(ids, np.int64)
        far = ids != ids[label]
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label][far])], names=["u", "v"])

    def run(batches):
        group, ids, sets = None, [], []
        for b in batches:
            at, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
            for k, (g, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if g != group and ids:
                    yield out(ids, sets)
                    ids, sets = [], []
                group = g
                ids.append(i)
                sets.append(values[at[k] : at[k + 1]].copy())
        if ids:
            yield out(ids, sets)

    return run


def verified(docs: DataFrame, keys: DataFrame, roots: DataFrame, alike_at: tuple[int, int] = ALIKE) -> DataFrame:
    """Edges (u, v) that connect the distinct texts (key, fps, node, and id and hash of a row
    that has it) of each component (fps, _root) as all their pairs at `alike_at` do."""
    members = keys.join(roots, "fps").select("id", "hash", "key", "node", "_root")
    several = materialize(members.groupBy("_root").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_root"), "simhash-several")
    members = materialize(members.join(several, "_root"), "simhash-members")
    own = docs.select("id", "hash", "text").join(members.select("id", "hash").distinct(), ["id", "hash"], "left_semi")
    sets = _keyed(own).groupBy("id", "key").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.join(members, ["id", "key"]).select("node", "key", "shingles", "_root"), "simhash-sets")
    blocks = sets.groupBy("_root").agg(F.ceil(F.sum(F.size("shingles")) / BLOCK).cast("int").alias("_b"))
    # a component of several blocks is compared by pairs of them, so each pair of texts meets
    one, b = F.pmod(F.xxhash64("key"), F.col("_b")).cast("int"), F.col("_b")
    mates = F.when(b == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), b - 1), lambda x: x != F.col("_one")))
    dealt = sets.join(materialize(blocks, "simhash-blocks"), "_root").withColumn("_one", one).withColumn("_two", F.explode(mates))
    group = F.xxhash64("_root", F.least("_one", "_two"), F.greatest("_one", "_two")).alias("_group")
    dealt = dealt.select(group, "node", "shingles").repartition("_group").sortWithinPartitions("_group")
    return dealt.mapInArrow(_verify(alike_at), "u bigint, v bigint")


def _grouped(docs: DataFrame, shingle: int, distance: int, groups: int, word_seeds: tuple[int, ...], verify: tuple[int, int] | None) -> DataFrame:
    """id (a null one as _NO_ID), hash (of the text), fps, group (a number) of each row, and
    least, the smallest id of its group.

    Fingerprints and texts are numbered, as ids may be null or repeated; the numbers are
    written with the table, so all who read it see the same."""
    text = F.col("text").cast("string")
    own = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID).cast("bigint")).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text"))
    rows = materialize(fingerprints(own, shingle=shingle, word_seeds=word_seeds, keep=("id", "hash"), with_key=verify is not None), "simhash")
    numbered = lambda df, node: df.withColumn(node, F.monotonically_increasing_id())
    vectors = materialize(numbered(rows.groupBy("fps").agg(F.min("id").alias("least")), "node"), "simhash-vectors")
    each = vectors.select("node", F.posexplode("fps").alias("seed", "fp"))
    nodes = materialize(each.groupBy("seed", "fp").agg(F.min("node").alias("id")), "simhash-nodes")
    edges = links(nodes, distance, groups)
    if len(word_seeds) > 1:  # vectors that share the fingerprint of one seed only
        shared = each.join(nodes.withColumnRenamed("id", "v"), ["seed", "fp"]).where("node <> v")
        edges = edges.unionByName(shared.select(F.col("node").alias("u"), "v"))
    by, tops = "fps", components(edges)
    if verify is not None:
        named = vectors.join(tops, vectors["node"] == tops["id"], "left").select("fps", F.coalesce("root", "node").alias("_root"))
        first = rows.groupBy("key", "fps").agg(F.min(F.struct("id", "hash")).alias("r")).select("key", "fps", "r.*", F.col("r.id").alias("least"))
        vectors = materialize(numbered(first, "node"), "simhash-keys")
        by, tops = "key", components(verified(own, vectors, named, verify))
    vectors = vectors.join(tops.withColumnRenamed("id", "node"), "node", "left").select(by, F.coalesce("root", "node").alias("group"), "least")
    vectors = materialize(vectors, "simhash-groups")
    least = vectors.groupBy("group").agg(F.min("least").alias("least"))
    return rows.join(vectors.drop("least").join(least, "group"), by).select("id", "hash", "fps", "group", "least")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, groups: int = GROUPS, word_seeds: tuple[int, ...] = (), verify: bool = False, alike_at: tuple[int, int] = ALIKE) -> DataFrame:
    """doc_id, fps, component_id. Documents link if a fingerprint of theirs, of one seed,
    differs in `distance` bits or fewer; with verify, if their shingles are alike too."""
    found = _grouped(docs, shingle, distance, groups, word_seeds, alike_at if verify else None)
    id_ = lambda c, name: F.when(F.col(c) != _NO_ID, F.col(c)).alias(name)
    return found.select(id_("id", "doc_id"), "fps", id_("least", "component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, groups: int = GROUPS, word_seeds: tuple[int, ...] = (), verify: bool = False, alike_at: tuple[int, int] = ALIKE) -> DataFrame:
    """The rows of docs without all but one of each component: the one of smallest id (of
    least hash of the text where several texts have it, null ids first). Rows are told
    apart by id and text, so texts that share an id, or have none, stay if not alike."""
    found = _grouped(docs, shingle, distance, groups, word_seeds, alike_at if verify else None)
    first = materialize(found.groupBy("group").agg(F.min(F.struct("id", "hash")).alias("r")).select(F.col("r.id").alias("__near_id"), F.col("r.hash").alias("__near_h")), "simhash-first")
    # of rows equal in both one stays; counted before the shuffle, so that a crowd of them doesn't travel
    key = {"__near_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID).cast("bigint")), "__near_h": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    row = F.struct(*docs.columns)
    rest = [c for c in docs.columns if c != "text"]
    single = docs.withColumns(key).groupBy(*key).agg(F.min_by(row, F.md5(F.to_json(F.struct(*rest)).cast("binary"))).alias("__near_row"))
    kept = single.join(first, list(key), "left_semi")
    return kept.select(*(F.col("__near_row").getField(c).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
