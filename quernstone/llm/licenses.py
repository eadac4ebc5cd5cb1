"""Operator 2: license scans by fuzzy search for short notices.

Texts are lower-cased (A-Z) and cut into words; words are joined by one space. Base
phrases are found exactly at word boundaries. Notices are found with edits: a notice of m
characters may have k = m // ``PER_EDIT`` of them, so when it is split into k + 1 parts,
one part at least stands in the text unchanged (pigeonhole). One pass of an automaton over
all parts finds these seeds; around each, the regex library matches the whole notice with a
bounded number of insertions, deletions and substitutions, and gives the span and the edits;
what stands before and after a match is searched again.
Matches that overlap a better one (fewer edits for its length) are dropped.

Defined cases: null and empty texts have no words and no labels, score 0; a text that says
a notice several times has several spans; of matches that overlap and are equally good the
longer stays, then the first, then the one of the first label; repeated rows each give a row;
very long texts are searched whole, in windows around their seeds; an empty table gives no
rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, table

#: The contract's phrases and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Short notices in words, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international", "cc-by"),
    ("creative commons zero public domain dedication", "cc0"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
)
PER_EDIT = 10
_WORDS = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))

_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


class Scanner:
    def __init__(self, notices=NOTICES, base=BASE, per_edit: int = PER_EDIT):
        self.base = [(f" {p} ".encode(), label) for p, label in base]
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (text, label) in enumerate(notices):
            edits = max(1, len(text) // per_edit)
            cuts = [round(i * len(text) / (edits + 1)) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(text[a:b], []).append((n, a))
            pattern = regex.compile(f"(?b)(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}")
            self.notices.append((text, label, edits, pattern))
        for seed, where in at.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def base_places(self, line: bytes) -> list[tuple[int, str]]:
        """(first word, label) of each base phrase; line: words between single spaces."""
        out = []
        for phrase, label in self.base:
            k = line.find(phrase)
            while k >= 0:
                out.append((line.count(b" ", 0, k), label))
                k = line.find(phrase, k + 1)
        return out

    def matches(self, line: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of each notice's matches: the best of each
        window, and again of what stands before and after it."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, where) in self.seeds.iter(line):
            for n, offset in where:
                text, _, edits, _ = self.notices[n]
                start = last - size + 1 - offset
                windows.setdefault(n, []).append((max(0, start - edits), min(len(line), start + len(text) + edits)))
        found = []
        for n, spans in windows.items():
            text, label, most, pattern = self.notices[n]
            open_: list[list[int]] = []
            for a, b in sorted(spans):
                if open_ and a <= open_[-1][1]:
                    open_[-1][1] = max(open_[-1][1], b)
                else:
                    open_.append([a, b])
            while open_:
                a, b = open_.pop()
                if b - a < len(text) - most:  # no match is shorter
                    continue
                if (m := pattern.search(line, a, b)) is not None:
                    edits = sum(m.fuzzy_counts)
                    found.append((m.start(), m.end(), label, edits, 1 - edits / len(text)))
                    open_ += [[a, m.start()], [m.end(), b]]
        return found

    def fuzzy(self, line: str) -> list[tuple[int, int, str, int, float]]:
        """(start, end, label, edits, similarity) of the best matches without overlap."""
        found = self.matches(line)
        kept: list[tuple[int, int, str, int, float]] = []
        for f in sorted(found, key=lambda f: (-f[4], f[0] - f[1], f[0], f[2])):
            if all(f[1] <= k[0] or f[0] >= k[1] for k in kept):
                kept.append(f)
        return sorted(kept)

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(_WORDS).split()
        line = b" " + b" ".join(words) + b" "
        base = self.base_places(line)
        plain = line.decode("latin-1")
        spans = []
        for a, b, label, edits, similarity in self.fuzzy(plain):
            first = max(0, plain.count(" ", 0, a + 1) - 1)
            spans.append({"label": label, "first_word": first, "last_word": max(first, plain.count(" ", 0, b) - 1), "edits": edits, "similarity": similarity})
        names = {label for _, label in base}
        starts = [w for w, _ in base]
        score = max([s["similarity"] for s in spans] + [1.0] * bool(base), default=0.0)
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | {s["label"] for s in spans})), score, spans


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), notices=NOTICES, base=BASE) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*keep, docs["text"].alias("_text"))
    fields = [(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", T.ArrayType(_SPAN))]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches):
        scanner = Scanner(notices, base)
        for b in batches:
            found = [scanner.scan(t.as_py()) for t in b.column(b.num_columns - 1)]
            new = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *new], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
