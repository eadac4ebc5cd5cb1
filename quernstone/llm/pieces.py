"""Operator 4: SentencePiece encoding and decoding by a batched numpy Viterbi.

Texts are cut into words at their spaces, which no piece crosses. Sorted words of any
lengths advance together, a letter at a time: prefixes of equal length are worked on at once,
and a prefix that several words share is worked on once. At each end position, the hashes of
the substrings that end there probe the sorted hashes of the pieces, and the backpointer is
the longest of the admissible pieces (sizes are tried in rising order, the greatest stays).

The vocabulary is a merge vocabulary: a segmentation isn't the one of greatest summed score
but the one that merging by priority ends in. What a Viterbi step may take is therefore
not weighed by scores: a piece may follow the best path of a prefix if merging the two
neighbouring pieces' characters gives just these two pieces again. A path all of whose
neighbours pass is the merged segmentation, and there is one for each prefix, so the path
found is the one the library gives. Whether two pieces may be neighbours is found for all
new pairs of a step at once, by merging them side by side in numpy, and kept.

Runs of two or more spaces, whose pieces tie for the lowest priority, are merged directly.
Characters outside the vocabulary become their UTF-8 bytes' pieces.

Defined cases: null and empty texts have no pieces and decode to the empty text; the
visible space U+2581 in a text is a space, as in the library; very long texts are encoded
whole, and very long words cut where no piece has the two characters side by side; pieces
that tie in priority are merged from the left, as in the library; repeated rows each give a
row; an empty table gives no rows; extra columns are kept where they are asked for, those
named as a new one (ids, decoded) give way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words kept encoded in a task; beyond, the store starts anew (results are the same).
STORE = 150_000
#: Characters beyond which a word is cut where no piece can stand.
LONG = 24
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def read_model(path: str = MODEL) -> list[tuple[str, float, str]]:
    """(piece, score, kind) in the order of ids; kind: piece, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


def _coder(pieces: list[tuple[str, float, str]]) -> Coder:
    """The coder of this worker process: tasks that it runs one after another share the
    words that are encoded already."""
    held = sys.modules.setdefault("_quernstone_coders", SimpleNamespace(of={})).of
    key = hashlib.sha256(repr(pieces).encode()).hexdigest()
    if key not in held:
        held.clear()
        held[key] = Coder(pieces)
    return held[key]


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _prefixes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _MULTIPLIER + codes[:, k] + np.uint64(1)
    return out


class Coder:
    """Encoder and decoder of one model. Built from the model's pieces in each task."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        self.size = len(pieces)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == "piece"}
        self.longest = max(map(len, self.ids))
        self.score = np.array([s for _, s, _ in pieces])
        # priority of a merge: the higher score first; equal scores tie
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(np.int64)
        #: Each piece's letters as ids of one-letter pieces, -1 after its end or without one.
        self.letters = np.full((self.size, self.longest), -1, np.int64)
        for p, i in self.ids.items():
            self.letters[i, : len(p)] = [self.ids.get(c, -1) for c in p]
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.raw = [bytes([int(p[3:5], 16)]) if kind == "byte" else p.encode() if kind == "piece" else b"" for p, _, kind in pieces]
        self.text = [p if kind == "piece" else "" for p, _, kind in pieces]
        self.power = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _MULTIPLIER)), dtype=np.uint64)
        self.bigrams = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        by_length: dict[int, list[str]] = {}
        for p in self.ids:
            by_length.setdefault(len(p), []).append(p)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ps in by_length.items():
            codes = _codes(ps)
            key = _prefixes(codes)[:, -1]
            at = np.argsort(key)
            self.keys[n] = key[at], np.array([self.ids[p] for p in ps])[at], codes[at]
        joins = sorted((self.ids[p[:k]] * self.size + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.join_key, self.join_id = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        #: Pairs known to pass or not: sorted keys, and the latest ones apart until they are many.
        self.pairs = [(np.array([-1], np.int64), np.array([False])), (np.array([-1], np.int64), np.array([False]))]
        self.store: dict[str, bytes] = {}
        # line ends and other controls outside the vocabulary are words of their own
        odd = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in self.ids)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{odd}]+|{SPACE}+" + (f"|[{odd}]" if odd else "")).findall

    # --- merging by priority

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the piece that a and b make, or -1."""
        key = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
        return np.where(self.join_key[at] == key, self.join_id[at], -1)

    def _merge(self, rows: np.ndarray) -> np.ndarray:
        """Merge rows of ids (padded with -1) until nothing merges."""
        rows = rows.copy()
        live = np.arange(len(rows))
        while len(live):
            t = rows[live]
            made = self._joined(t[:, :-1], t[:, 1:])
            rank = np.where(made >= 0, self.rank[made], np.iinfo(np.int64).max)
            best = rank.argmin(axis=1)
            able = made[np.arange(len(live)), best] >= 0
            live, t, best = live[able], t[able], best[able]
            made = made[able]
            k = np.arange(t.shape[1])[None, :]
            shifted = np.concatenate([t[:, 1:], np.full((len(t), 1), -1)], axis=1)
            t = np.where(k > best[:, None], shifted, t)
            t[np.arange(len(t)), best] = made[np.arange(len(t)), best]
            rows[live] = t
        return rows

    def _neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; unknown characters (-2) part anything."""
        free = (a < 0) | (b < 0)
        key = np.where(free, -1, a * self.size + b)
        out, open_ = free.copy(), np.flatnonzero(~free)
        for keys, oks in self.pairs:
            at = np.minimum(np.searchsorted(keys, key[open_]), len(keys) - 1)
            known = keys[at] == key[open_]
            out[open_[known]] = oks[at[known]]
            open_ = open_[~known]
        if len(open_):
            new, back = np.unique(key[open_], return_inverse=True)
            left, right = new // self.size, new % self.size
            rows = np.concatenate([self.letters[left], self.letters[right]], axis=1)
            # letters stand at the left of each half: close the gap
            rows = np.take_along_axis(rows, np.argsort(rows < 0, axis=1, kind="stable"), axis=1)
            rows = rows[:, : int((rows >= 0).sum(axis=1).max(initial=0)) + 1]
            merged = np.pad(self._merge(rows), ((0, 0), (0, 2)), constant_values=-1)
            ok = (merged[:, 0] == left) & (merged[:, 1] == right) & (merged[:, 2] == -1)
            out[open_] = ok[back]
            self._keep(1, new, ok)
            if len(self.pairs[1][0]) > 8192:
                self._keep(0, *self.pairs[1])
                self.pairs[1] = np.array([-1], np.int64), np.array([False])
        return out

    def _keep(self, level: int, keys: np.ndarray, oks: np.ndarray) -> None:
        keys, first = np.unique(np.concatenate([self.pairs[level][0], keys]), return_index=True)
        self.pairs[level] = keys, np.concatenate([self.pairs[level][1], oks])[first]

    # --- Viterbi

    def _viterbi(self, words: list[str]) -> list[bytes | None]:
        """Packed ids of sorted distinct words; None where a character is unknown.

        Words that begin alike share their paths: at each length, only prefixes that the
        word before doesn't have are worked on, all of them at once."""
        many, n = len(words), max(map(len, words))
        codes = np.array(words, f"<U{n}").view(np.uint32).reshape(many, n)
        size_of = np.array([len(w) for w in words])
        prefix = _prefixes(codes)
        alike = np.zeros(many, np.int64)  # letters in common with the word before
        differs = codes[1:] != codes[:-1]
        alike[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), n), np.minimum(size_of[1:], size_of[:-1]))
        rows = np.arange(many)
        own = np.zeros((many, n + 1), np.int64)  # the row that stands for a prefix
        last = np.full((many, n + 1), -2, np.int64)  # the piece that ends it
        step = np.ones((many, n + 1), np.int64)
        sizes = sorted(self.keys)
        for end in range(1, n + 1):
            new = (size_of >= end) & (alike < end)
            own[:, end] = np.maximum.accumulate(np.where(new, rows, 0))
            live = np.flatnonzero(new)
            for size in sizes:
                start = end - size
                if start < 0:
                    break
                key, ids, _ = self.keys[size]
                h = prefix[live, end] - prefix[live, start] * self.power[size]
                at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                hit = key[at] == h
                here, piece = live[hit], ids[at[hit]]
                if start and len(here):
                    fits = self._neighbours(last[own[here, start], start], piece)
                    here, piece = here[fits], piece[fits]
                step[here, end], last[here, end] = size, piece  # sizes rise: the greatest stays
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        at, live = size_of.copy(), rows[size_of > 0]
        while live.size:
            r = own[live, at[live]]
            steps.append((live, last[r, at[live]]))
            at[live] -= step[r, at[live]]
            live = live[at[live] > 0]
        which, piece = (np.concatenate([x[k] for x in reversed(steps)]) for k in (0, 1))
        order = np.argsort(which, kind="stable")
        which, piece = which[order], piece[order]
        odd = np.zeros(many, bool)
        odd[which[piece < 0]] = True
        ends = np.cumsum(np.bincount(which, minlength=many))
        packed = piece.astype("<i4").tobytes()
        out = [packed[4 * x : 4 * y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        # pieces were found by hash: a path that doesn't spell its word is done plainly
        if "".join(map(self.text.__getitem__, piece[~odd[which]].tolist())) != "".join(w for w, o in zip(words, odd.tolist(), strict=True) if not o):
            return [np.array(self._plain(w), "<i4").tobytes() if not o else None for w, o in zip(words, odd.tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = None
        return out

    def _plain(self, word: str) -> list[int]:
        """Merging by priority, one word: the leftmost of the best pairs first."""
        ids = [self.ids.get(c, -2) for c in word]
        after, before, gone = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], [False] * len(ids)
        heap: list = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0 and ids[i] >= 0 and ids[j] >= 0 and (p := self.ids.get(self.text[ids[i]] + self.text[ids[j]])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, j, ids[i], ids[j], p))

        for i in range(len(ids)):
            offer(i)
        while heap:
            _, i, j, a, b, p = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or (ids[i], ids[j]) != (a, b):
                continue
            ids[i], gone[j], after[i] = p, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x, g in zip(ids, gone, strict=True) if not g]

    def _cut(self, word: str) -> list[str]:
        """Parts of a long word between characters that no piece has side by side."""
        ends = [k + 1 for k in range(len(word) - 1) if word[k : k + 2] not in self.bigrams]
        return [word[a:b] for a, b in zip([0, *ends], [*ends, len(word)], strict=True)]

    def _bytes(self, word: str, ids: list[int]) -> bytes:
        """Packed ids, an unknown character (-2) being the pieces of its bytes."""
        out, at = [], 0
        for i in ids:
            if i >= 0:
                out.append(i)
                at += len(self.text[i])
            else:
                out += [self.byte[x] for x in word[at].encode()]
                at += 1
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Encode words and store them as packed int32."""
        if len(self.store) + len(words) > STORE:
            self.store.clear()
        long = {w: self._cut(w) for w in words if len(w) > LONG}
        units = {w for w in words if len(w) <= LONG}.union(*long.values())
        found = {u: self._bytes(u, self._plain(u)) for u in units if SPACE * 2 in u}
        rest = sorted(units - found.keys())
        for own in ([u for u in rest if len(u) <= LONG], sorted((u for u in rest if len(u) > LONG), key=len)):
            step = 16384 if own and len(own[-1]) <= LONG else 16
            for k in range(0, len(own), step):
                part = sorted(own[k : k + step])
                for u, ids in zip(part, self._viterbi(part), strict=True):
                    found[u] = self._bytes(u, self._plain(u)) if ids is None else ids
        self.store.update(found)
        self.store.update((w, b"".join(map(found.__getitem__, ps))) for w, ps in long.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian int32."""
        words = [self.split((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*words) - self.store.keys()
        if new:
            self._learn(new)
            if missing := set().union(*words) - self.store.keys():  # the store began anew
                self._learn(missing)
        return [b"".join(map(self.store.__getitem__, ws)) for ws in words]

    def decode(self, packed: bytes) -> str:
        """Text of packed ids."""
        data = b"".join(map(self.raw.__getitem__, np.frombuffer(packed, "<i4").tolist()))
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _batches(texts: list[str], most: int = 2_000_000):
    """Slices of texts of about most characters."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(first, k + 1)
            first, size = k + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _with_text(docs: DataFrame, column: str, keep: list[str], fields: list[T.StructField], work) -> DataFrame:
    """keep and new fields from work(list of values of column) -> list of Arrow arrays."""
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c not in {f.name for f in fields}]
    value = "_value" + "_" * max(map(len, keep), default=0)  # a name that no column has
    rows = docs.select(*keep, docs[column].alias(value))
    schema = T.StructType([rows.schema[c] for c in keep] + fields)

    def run(batches):
        state = work()
        for b in batches:
            values = b.column(b.num_columns - 1).to_pylist()
            for at in _batches([v or "" for v in values]) if values and not any(isinstance(v, list) for v in values) else [slice(0, len(values))]:
                part = b.slice(at.start, at.stop - at.start)
                arrays = [part.column(i) for i in range(b.num_columns - 1)] + state(values[at])
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or keep) and ids, an array of piece ids."""
    pieces = read_model(model)

    def work():
        coder = _coder(pieces)
        lists = lambda ps: pa.array([np.frombuffer(p, "<i4") for p in ps], pa.list_(pa.int32()))
        return lambda texts: [lists(coder.encode([t or "" for t in texts]))]

    return _with_text(docs, "text", keep or docs.columns, [T.StructField("ids", T.ArrayType(T.IntegerType()))], work)


def decode(rows: DataFrame, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """rows' columns (or keep) and decoded, the text of column ids."""
    pieces = read_model(model)

    def work():
        coder = _coder(pieces)
        return lambda ids: [pa.array([coder.decode(np.array(x or [], "<i4").tobytes()) for x in ids])]

    return _with_text(rows, "ids", keep or rows.columns, [T.StructField("decoded", T.StringType())], work)


def digests(docs: DataFrame, model: str = MODEL, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep, ids (if with_ids), n_pieces, ids_sha256 (of the ids as little-endian int32), decoded_sha256 and
    round_trip: whether decoding gives the text again (U+2581 being a space)."""
    pieces = read_model(model)
    kinds = {"ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    kinds |= {"n_pieces": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "round_trip": T.BooleanType()}

    def work():
        coder = _coder(pieces)
        sha = lambda x: hashlib.sha256(x).hexdigest()

        def run(texts):
            texts = [t or "" for t in texts]
            packed = coder.encode(texts)
            decoded = [coder.decode(p) for p in packed]
            same = [d == t.replace(SPACE, " ") for d, t in zip(decoded, texts, strict=True)]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))] if with_ids else []
            return [*ids, pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(map(sha, packed), pa.string()), pa.array((sha(d.encode()) for d in decoded), pa.string()), pa.array(same, pa.bool_())]

        return run

    return _with_text(docs, "text", list(keep), [T.StructField(n, k) for n, k in kinds.items()], work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
