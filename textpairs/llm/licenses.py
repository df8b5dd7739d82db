"""Licence notices in documents: ranked by how much a template helps to compress them, confirmed word by word."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpairs.llm.common import col

# The wording of public licence notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words of a cue may be on two lines, with comment signs between them.
CUES = r"licen[cs]e|copyright|redistribut|permission|public[\W_]+domain|creative[\W_]+commons|warrant|free[\W_]+software"
GAP = 3
NEAR = 0.8
FOUND = (
    "array<struct<first_line:bigint,n_lines:bigint,license:string,reduction:bigint,missing:bigint,extra:bigint,"
    "verdict:string,wording:string>>"
)
WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


class Notice(NamedTuple):
    """A template in a text: differences, template words, bytes saved, name, its words and their kinds."""

    wrong: int
    minus_size: int
    minus_saved: int
    name: str
    start: int
    end: int
    missing: int
    extra: int


def wording(text: str) -> list[str]:
    return [word.lower() for word in WORD.findall(text)]


def joined(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Closed spans in order of their starts, those at most ``gap`` apart made one."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if out and first - out[-1][1] <= gap:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


class Page:
    """The words of a text, their places, and the cues in it as ``(first word, last word, first line, last line)``."""

    def __init__(self, text: str, cues: re.Pattern):
        self.text = text
        spans = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.words = [text[a:b].lower() for a, b in spans]
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.cues = [
            (self.word_at(m.start()), self.word_at(m.end() - 1), self.line_at(m.start()), self.line_at(m.end() - 1))
            for m in cues.finditer(text)
        ]

    def word_at(self, place: int) -> int:
        return bisect_right(self.starts, place) - 1

    def line_at(self, place: int) -> int:
        return bisect_right(self.lines, place) - 1

    def between(self, first: int, last: int) -> str:
        """Whole lines."""
        return self.text[self.lines[first] : self.lines[last + 1] - 1 if last + 1 < len(self.lines) else None]


def own_cues(templates: dict[str, str]) -> str:
    """Pattern of the words that stand in for cues in templates without one, empty if there are none such.

    Of each the longest words, one more than a notice may lack, so every notice has one of them.
    """
    found: set[str] = set()
    for text in templates.values():
        words = wording(text)
        if not re.search(CUES, text, re.IGNORECASE):
            found.update(sorted(set(words), key=lambda w: (-len(w), w))[: int((1 - NEAR) * len(words)) + 1])
    return rf"(?<![^\W_])(?:{'|'.join(map(re.escape, sorted(found)))})(?![^\W_])" if found else ""


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.cues = re.compile(CUES, re.IGNORECASE)
        own = own_cues(templates)
        self.own = re.compile(own, re.IGNORECASE) if own else None
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.words = {name: wording(text) for name, text in templates.items()}
        self.allowed = {name: int((1 - NEAR) * len(words)) for name, words in self.words.items()}
        # No notice has more words, so one with a cue in it lies within so many words of the cue.
        self.reach = max((len(words) + self.allowed[name] for name, words in self.words.items()), default=0)
        # Words in a row that a notice with all the differences that are allowed still shares with its template.
        self.seeds: dict[int, dict[tuple[str, ...], list[tuple[str, int]]]] = {}
        for name, words in self.words.items():
            k = self.allowed[name]
            size = -(-(len(words) - k) // (k + 1))
            for at in range(len(words) - size + 1 if size else 0):
                self.seeds.setdefault(size, {}).setdefault(tuple(words[at : at + size]), []).append((name, at))
        self.primed = {
            name: zstandard.ZstdCompressor(
                level=3,
                write_content_size=False,
                dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for name, text in templates.items()
        }

    def reduction(self, name: str, wording: str) -> int:
        """Bytes saved by the template."""
        raw = wording.encode()
        return len(self.plain.compress(raw)) - len(self.primed[name].compress(raw))

    def laid(self, words: list[str], low: int, high: int) -> dict[str, list[int]]:
        """Where templates would begin that share a seed with ``words[low:high]``."""
        out: dict[str, set[int]] = {}
        for size, seeds in self.seeds.items():
            for at in range(low, high - size + 1):
                for name, place in seeds.get(tuple(words[at : at + size]), ()):
                    out.setdefault(name, set()).add(at - place)
        return {name: sorted(starts) for name, starts in out.items()}

    def aligned(self, name: str, words: list[str], low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
        """``start, end, missing, extra`` of the template with the fewest differences for each end that allows it.

        Missing are template words that the notice lacks, extra are words between its first and last that the template lacks.
        """
        template, k = self.words[name], self.allowed[name]
        # By length of the template's beginning: differences, extra words, minus the start.
        column = [(i, 0, -low) for i in range(len(template) + 1)]
        for at in range(low, high):
            word, before = words[at], column
            column = [(0, 0, -at - 1)]
            for i, own in enumerate(template):
                lacking, longer = column[i], before[i + 1]
                best = min((lacking[0] + 1, *lacking[1:]), (longer[0] + 1, longer[1] + 1, longer[2]))
                column.append(min(best, before[i]) if own == word else best)
            wrong, extra, start = column[-1]
            if wrong <= k and -start <= at:
                yield -start, at + 1, wrong - extra, extra

    def ranked(self, block: str) -> list[str]:
        """Every template, by the bytes it saves in the block as raw dictionary, then by length and name."""
        raw = block.encode()
        plain = len(self.plain.compress(raw))
        saved = {name: plain - len(primed.compress(raw)) for name, primed in self.primed.items()}
        return sorted(saved, key=lambda name: (-saved[name], -len(self.words[name]), name))

    def notices(self, page: Page, low: int, high: int) -> list[Notice]:
        """The notices among the words from ``low`` to ``high``, none of which share a word, the best ones first."""

        def notice(name: str, start: int, end: int, missing: int, extra: int) -> Notice:
            saved = self.reduction(name, page.text[page.starts[start] : page.ends[end - 1]])
            return Notice(missing + extra, -len(self.words[name]), -saved, name, start, end, missing, extra)

        def exact(name: str, starts: list[int], low: int, high: int) -> Iterator[Notice]:
            size = len(self.words[name])
            for start in starts:
                if low <= start <= high - size and words[start : start + size] == self.words[name]:
                    yield notice(name, start, start + size, 0, 0)

        def near(name: str, starts: list[int], low: int, high: int) -> Iterator[Notice]:
            k, size = self.allowed[name], len(self.words[name])
            for first, last in joined([(s - k, s + size + k) for s in starts], 0) if k else ():
                for found in self.aligned(name, words, max(first, low), min(last, high)):
                    yield notice(name, *found)

        words, out = page.words, []
        for search in (exact, near):
            # The template that ranks first of those confirmed takes its words; the parts between are ranked anew.
            taken = sorted((n.start, n.end) for n in out)
            parts = list(zip([low, *(e for _, e in taken)], [*(s for s, _ in taken), high], strict=True))
            while parts:
                first, last = parts.pop()
                if first >= last:
                    continue
                laid = self.laid(words, first, last)
                for name in self.ranked(page.text[page.starts[first] : page.ends[last - 1]]):
                    chosen: list[Notice] = []
                    for one in sorted(search(name, laid.get(name, []), first, last)):
                        at = bisect_left(chosen, one.start, key=lambda n: n.start)
                        if not (at and chosen[at - 1].end > one.start or at < len(chosen) and chosen[at].start < one.end):
                            chosen.insert(at, one)
                    if chosen:
                        out += chosen
                        parts += zip([first, *(n.end for n in chosen)], [*(n.start for n in chosen), last], strict=True)
                        break
        return sorted(out)

    def scan(self, text: str) -> list[dict]:
        page = Page(text, self.cues)
        own = Page(text, self.own).cues if self.own else []
        near = [(max(a - self.reach, 0), min(b + self.reach + 1, len(page.words))) for a, b, _, _ in sorted(page.cues + own)]
        found = [n for low, high in joined(near, 0) for n in self.notices(page, low, high)]
        out = [(page.starts[n.start], self.row(page, n)) for n in found]
        # A cue that a notice lacks at its edge is settled by it, too.
        settled = joined(sorted((n.start - n.missing, n.end - 1 + n.missing) for n in found), 0)
        starts = [a for a, _ in settled]
        rest = []
        for first_word, last_word, *lines in page.cues:
            at = bisect_right(starts, last_word) - 1
            if at < 0 or settled[at][1] < first_word:
                rest.append(tuple(lines))
        for a, b in joined(rest, GAP):
            row = {"first_line": a, "n_lines": b - a + 1, "wording": page.between(a, b), "verdict": "none"}
            out.append((page.lines[a], row))
        return [row for _, row in sorted(out, key=lambda x: x[0])]

    def row(self, page: Page, n: Notice) -> dict:
        start, end = page.starts[n.start], page.ends[n.end - 1]
        first, last = page.line_at(start), page.line_at(end - 1)
        return {
            "first_line": first,
            "n_lines": last - first + 1,
            "license": n.name,
            "reduction": -n.minus_saved,
            "missing": n.missing,
            "extra": n.extra,
            "verdict": "near" if n.wrong else "exact",
            "wording": page.text[start:end],
        }


@lru_cache(maxsize=2)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One per Python worker."""
    return Scanner(dict(templates))


def scanned(text: Column, templates: dict[str, str]) -> Column:
    given = tuple(templates.items())
    kind = pa.list_(
        pa.struct(
            [
                ("first_line", pa.int64()),
                ("n_lines", pa.int64()),
                ("license", pa.string()),
                ("reduction", pa.int64()),
                ("missing", pa.int64()),
                ("extra", pa.int64()),
                ("verdict", pa.string()),
                ("wording", pa.string()),
            ]
        )
    )

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        found = scanner(given)
        return pa.array([found.scan(t.as_py() or "") for t in texts], kind)

    return scan(text)


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per licence notice or unknown block: place, template, bytes saved, differences in wording, verdict.

    Words of the templates without a cue word are looked for as well, so notices of any templates are found. A block is a line with a cue word or several that are close together. Every template is compared word by word (case
    and punctuation apart) with the words around each cue, on both sides as many as a notice can have, so neither the
    length of a line nor line breaks within a notice matter. A notice differs from its template by less than a
    fifth of the template's words. The words around a cue are compressed with each template as raw dictionary; templates are
    confirmed in the order of the bytes they save, first for equal wording, then for near wording. The first one confirmed
    takes its words away, and what is left is ranked again until none is confirmed, so all notices of a block are found.
    ``reduction`` is what the template saves on the notice alone. ``wording`` is the notice from its first to its last word, ``verdict`` is ``exact``
    or ``near``. Cues that no notice holds give one row per block, whole lines without template, ``none``.

    Texts without a cue are left out before Python sees them; null and empty ones have none. Rows are independent: null
    and repeated keys stay, an empty table gives no rows, other columns are left out. Texts are scanned whole.
    """
    templates = TEMPLATES if templates is None else templates
    rows = docs.select(col(key).alias("doc_id"), col(text).alias("text"))
    # Words outside A-Z fold otherwise in the JVM, so then Python sees every text.
    own = own_cues(templates)
    if own.isascii():
        rows = rows.where(F.col("text").rlike(f"(?i)(?:{CUES})" + (f"|{own}" if own else "")))
    found = rows.select("doc_id", F.explode(scanned(F.col("text"), templates)).alias("f"))
    return found.select("doc_id", "f.*")
