"""License scans: exact license phrases, and fuzzy ones found by exact seeds and verified with bounded edits.

Base phrases give the base columns; they allow an edit for each 8 characters. The other notices, each with an edit bound
of its own, add labels and spans only. A phrase is cut into one more piece than it allows edits, so each fuzzy place
holds one piece unchanged (pigeonhole); places of pieces are candidates, and regex's bounded-error matching verifies the
characters around them and gives span and edits. Every step looks at one text only: one pass, nothing is shuffled.

Defined results: null or empty text: no words, no label, score 0; rows with a null doc_id are left out; repeated rows
each give a row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ALNUM, documents, rows

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices of public licenses (in words as scanned), their labels and the edits they allow.
NOTICES = {
    "gnu lesser general public license": ("lgpl", 4),
    "gnu affero general public license": ("agpl", 4),
    "mozilla public license": ("mpl", 2),
    "eclipse public license": ("epl", 2),
    "boost software license": ("boost", 2),
    "isc license": ("isc", 0),
    "bsd license": ("bsd", 0),
    "bsd 2 clause": ("bsd", 0),
    "bsd 3 clause": ("bsd", 0),
    "redistribution and use in source and binary forms": ("bsd", 5),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 6),
    "free and unencumbered software released into the public domain": ("unlicense", 5),
    "creative commons attribution": ("cc-by", 3),
    "creative commons attribution sharealike": ("cc-by-sa", 3),
    "creative commons attribution noncommercial": ("cc-by-nc", 3),
    "cc by sa": ("cc-by-sa", 0),
    "cc by nc": ("cc-by-nc", 0),
    "cc0 1 0 universal": ("cc0", 0),
    "spdx license identifier": ("spdx", 2),
}
CHARACTERS_AN_EDIT = 8
_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, first_word: long, end_word: long, edits: int>>"
)


class Notice:
    def __init__(self, phrase: str, label: str, edits: int, base: bool) -> None:
        self.phrase, self.label, self.edits, self.base = phrase.encode(), label, edits, base
        cuts = [len(phrase) * i // (self.edits + 1) for i in range(self.edits + 2)]
        self.pieces = [(a, self.phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)] if self.edits else []
        self.fuzzy = regex.compile(f"(?be)(?<![^ ])(?:{phrase}){{e<={self.edits}}}(?![^ ])")

    def exact(self, line: bytes) -> list[int]:
        """Byte places of the phrase as whole words in words joined and enclosed by single spaces."""
        found, whole, at = [], b" " + self.phrase + b" ", -1
        while (at := line.find(whole, at + 1)) >= 0:
            found.append(at + 1)
        return found

    def near(self, line: bytes) -> list[tuple[int, int, int]]:
        """(from, to, edits) of the verified fuzzy places, exact ones with 0 edits."""
        spans: list[tuple[int, int]] = []
        for offset, piece in self.pieces:
            at = -1
            while (at := line.find(piece, at + 1)) >= 0:
                # Edits may each take up to four bytes of UTF-8; one byte more on either side shows the word's edge.
                spans.append((max(0, at - offset - 4 * self.edits - 1), min(len(line), at - offset + len(self.phrase) + 4 * self.edits + 1)))
        spans.sort()
        joined: list[list[int]] = []
        for a, b in spans:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        found = []
        for a, b in joined:
            while a and 0x80 <= line[a] < 0xC0:  # not within a character
                a -= 1
            while b < len(line) and 0x80 <= line[b] < 0xC0:
                b += 1
            cut = line[a:b].decode()
            for m in self._matches(cut):
                start, end = a + len(cut[: m.start()].encode()), a + len(cut[: m.end()].encode())
                if m.group().strip() and end > start:
                    # An end inside the slice only: the slice's own edge is not a word's edge unless the text ends there.
                    found.append((start, end, sum(m.fuzzy_counts)))
        return [(s, e, k) for s, e, k in found if (s == 0 or line[s - 1 : s] == b" " or line[s : s + 1] == b" ") and (e == len(line) or line[e : e + 1] == b" " or line[e - 1 : e] == b" ")]


    def _matches(self, cut: str) -> list[regex.Match]:
        """All places that don't overlap a better one: BESTMATCH gives the best first, so both sides of it are searched."""
        out, parts = [], [(0, len(cut))]
        while parts:
            a, b = parts.pop()
            m = self.fuzzy.search(cut, a, b) if a < b else None
            if m:
                out.append(m)
                if m.end() > m.start():
                    parts += [(a, m.start()), (m.end(), b)]
        return sorted(out, key=lambda m: m.start())


def compiled(phrases: dict[str, str], notices: dict[str, tuple[str, int]]) -> list[Notice]:
    base = [Notice(p, label, len(p) // CHARACTERS_AN_EDIT, True) for p, label in phrases.items()]
    return base + [Notice(p, label, edits, False) for p, (label, edits) in notices.items() if p not in phrases]


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, int]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every document.

    score: 1 for an exact place, else 1 - edits / phrase length of the best fuzzy one, else 0. spans: all places of
    either kind, words counted from 0, end_word exclusive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = compiled(phrases, notices)
        for keys, texts in rows(batches):
            out: dict[str, list] = {x.split()[0]: [] for x in _SCHEMA.split(", ")[:8]} | {"spans": []}
            for key, text in zip(keys, texts, strict=True):
                words = text.translate(ALNUM).split()
                line = b" " + b" ".join(words) + b" "
                starts, base, labels, score, spans = [], set(), set(), 0.0, []
                for notice in wanted:
                    exact = notice.exact(line)
                    for at in exact:
                        first = line.count(b" ", 0, at) - 1
                        if notice.base:
                            starts.append(first)
                        spans.append((notice.label, first, first + notice.phrase.count(b" ") + 1, 0))
                    if exact:
                        (base if notice.base else labels).add(notice.label)
                        score = 1.0
                    for a, b, edits in notice.near(line):
                        if edits:
                            labels.add(notice.label)
                            score = max(score, 1 - edits / len(notice.phrase))
                            a += line[a : a + 1] == b" "
                            first = line.count(b" ", 0, a) - 1
                            spans.append((notice.label, first, first + line[a:b].strip().count(b" ") + 1, edits))
                for k, v in (("doc_id", key), ("n_words", len(words)), ("n_base", len(starts)), ("first_word", min(starts, default=None)), ("last_word", max(starts, default=None)), ("base_labels", ",".join(sorted(base))), ("labels", ",".join(sorted(base | labels))), ("score", score)):
                    out[k].append(v)
                out["spans"].append([dict(zip(("label", "first_word", "end_word", "edits"), s, strict=True)) for s in sorted(spans, key=lambda s: s[1:])])
            span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32())])
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return documents(docs).mapInArrow(run, _SCHEMA)
