"""License scans by conditional compression.

A text is read as its words, so line breaks, blank lines and comment signs don't part a notice. Candidate blocks (stretches of
words around those that licenses use) are compressed plainly and with each template as a raw zstandard dictionary. A template that tells much about a block saves many bytes; templates are ranked
by what they save, and the winner is confirmed by its exact differences in wording from the best-fitting stretch of the
block: words of the template that are missing or changed, and words put between. What a confirmed notice leaves over is
judged again, until no template is confirmed. All blocks are judged in windows that overlap by more than the longest template
of their group, the long templates first, then the short ones in what is left.

Defined cases: null and empty texts have no findings; each place of a repeated notice is a finding; templates that save
equally many bytes are taken by fewer differences, then by name; a changed word is one difference. Ids are of any type. Extra columns are not read. Whole texts are
searched; what is remembered of blocks already judged is bounded.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed wordings of notices by which licenses are told.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: Words of which a notice holds some even where a few of its words are changed.
HINT = re.compile(r"licen[sc]e|permission (?:is|to)\b|hereby granted|documentation files|redistribut|source and binary|any purpose with|free software|creative commons|\bCC BY|Mozilla Public|Source Code Form", re.I)
#: A word of each hint: without any of these a text has no hint.
QUICK = re.compile(r"licen[sc]e|permission|granted|documentation|redistribut|source|purpose|software|creative|\bCC\b|mozilla", re.I)
WORDS = re.compile(r"[\w.+-]*\w", re.A)
MAX_DIFF = 0.15
#: Least share of the plain size that a winner saves.
LEAST_SAVED = 0.25
#: Words up to which a template is short: it is looked for in windows of its own, as its bytes hardly count in long ones.
SHORT = 12
SCHEMA = "start long, end long, license string, plain_bytes int, saved_bytes int, saved_share double, differences int, wording string"


def blocks(words: list[str], reach: int) -> Iterator[tuple[int, int]]:
    """First word and end of each stretch of at most reach words before and after a hint. Line breaks and comment signs are no words, so they don't part a notice."""
    text = " ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    begin, end = None, 0
    for hint in HINT.finditer(text):
        first, last = bisect_right(starts, hint.start()) - 1, bisect_right(starts, hint.end() - 1)
        if begin is not None and first - reach > end:
            yield begin, end
            begin = None
        begin = max(0, first - reach) if begin is None else begin
        end = min(len(words), last + reach)
    if begin is not None:
        yield begin, end


class Judge:
    """Confirms the licenses of blocks; remembers as many verdicts as cache says."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, max_diff: float = MAX_DIFF, least_saved: float = LEAST_SAVED, cache: int = 20_000):
        self.max_diff, self.least_saved = max_diff, least_saved
        self.plain = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False)
        self.all = []
        for name, forms in sorted(templates.items()):
            for form in forms:
                want = [w.lower() for w in WORDS.findall(form)]
                raw = zstandard.ZstdCompressionDict(" ".join(want).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.all.append((name, form, want, zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)))
        every = range(len(self.all))
        long, short = [i for i in every if len(self.all[i][2]) > SHORT], [i for i in every if len(self.all[i][2]) <= SHORT]
        #: Templates that are judged together, long ones first.
        self.groups = [g for g in (long, short) if g]
        # Words in which any confirmed notice of a group fits; a window is two of these and moves on by one.
        self.reach = [math.ceil((1 + max_diff) * max((len(self.all[i][2]) for i in g), default=0)) + 1 for g in self.groups]
        self.of = lru_cache(cache)(self._of)

    def _of(self, stretch: str, group: int) -> tuple | None:
        """license, first word, end, plain, saved, differences, wording of the best template of a group for words joined by spaces."""
        low, words = stretch.encode(), stretch.split(" ")
        plain = len(self.plain.compress(low))
        ranked = sorted(((plain - len(c.compress(low)), name, form, want) for name, form, want, c in map(self.all.__getitem__, self.groups[group])), key=lambda x: (-x[0], x[1], x[2]))
        best = None
        for saved, name, _, want in ranked:
            if best is not None and saved < best[4]:
                break
            if saved < self.least_saved * min(plain, 8 + sum(map(len, want))):
                continue
            same = [b for b in difflib.SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks() if b.size]
            if not same:
                continue
            first, last = same[0], same[-1]
            # Words before the first match and after the last that the template lacks belong to the text around.
            lost = len(want) - sum(b.size for b in same)
            put = sum(max(0, (n.b - (m.b + m.size)) - (n.a - (m.a + m.size))) for m, n in zip(same, same[1:]))
            if (diff := lost + put) <= self.max_diff * len(want):
                wording = [("-", want[i]) for m, n in zip(same, same[1:]) for i in range(m.a + m.size, n.a)] + [("+", words[i]) for m, n in zip(same, same[1:]) for i in range(m.b + m.size, n.b)]
                got = (name, first.b, last.b + last.size, plain, saved, diff, " ".join(a + w for a, w in wording))
                if best is None or (-saved, diff, name) < (-best[4], best[5], best[0]):
                    best = got
        return best

    def within(self, words: list[str], begin: int, end: int, group: int) -> Iterator[tuple]:
        """The best notice of a stretch of words, and those of what it leaves over, in order."""
        stretch = " ".join(words[begin:end])
        if HINT.search(stretch) and (f := self.of(stretch, group)):
            yield from self.within(words, begin, begin + f[1], group)
            yield f[0], begin + f[1], begin + f[2], *f[3:]
            yield from self.within(words, begin + f[2], end, group)

    def windows(self, words: list[str], begin: int, end: int, group: int) -> Iterator[tuple]:
        """Notices of a stretch by windows; one that starts in the second half of a window is left to the next."""
        k, reach = begin, self.reach[group]
        while k < end:
            stop, done = min(end, k + 2 * reach), 0
            for f in self.within(words, k, stop, group):
                if stop == end or f[1] < k + reach:
                    yield f
                    done = f[2]
            k = end if stop == end else max(k + reach, done)

    def findings(self, text: str) -> Iterator[tuple]:
        """license, start, end, plain, saved, differences, wording of each notice of a text, in order."""
        if not QUICK.search(text):
            return
        spans = [m.span() for m in WORDS.finditer(text)]
        words = [text[b:e].lower() for b, e in spans]
        for begin, end in blocks(words, max(self.reach, default=0)):
            found: list[tuple] = []
            for group in range(len(self.groups)):
                found = sorted([*found, *(f for b, e in gaps(found, begin, end) for f in self.windows(words, b, e, group))], key=lambda f: f[1])
            for f in found:
                yield f[0], spans[f[1]][0], spans[f[2] - 1][1], *f[3:]


def gaps(found: list[tuple], begin: int, end: int) -> list[tuple[int, int]]:
    """The stretches from begin to end between notices in order."""
    return list(zip([begin, *(f[2] for f in found)], [*(f[1] for f in found), end], strict=True))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, max_diff: float = MAX_DIFF, least_saved: float = LEAST_SAVED) -> DataFrame:
    """A row for each confirmed notice: doc_id, start and end in code points, license, bytes plain and saved, differences and their wording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(templates, max_diff, least_saved)
        names = ["doc_id", "start", "end", "license", "plain_bytes", "saved_bytes", "saved_share", "differences", "wording"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                rows += [(i.as_py(), b, e, name, plain, saved, saved / plain, diff, wording) for name, b, e, plain, saved, diff, wording in judge.findings(t.as_py() or "")]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [batch.schema.field(0).type, *types], strict=True)], names=names)

    kind = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`")).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
