"""License scans: short notices found with a bounded number of typing errors."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from panelwright.llm.common import pack, unpack


@dataclass(frozen=True)
class Notice:
    """A phrase of lower-case words, its label, and words of it in which no error is allowed."""

    label: str
    phrase: str
    firm: tuple[str, ...] = ()

    @cached_property
    def edits(self) -> int:
        """One error for every ten characters, three at most, none in phrases of fewer than twelve."""
        return min(3, len(self.phrase) // 10) if len(self.phrase) >= 12 else 0

    @cached_property
    def pieces(self) -> list[tuple[int, str]]:
        """Offsets and texts of edits + 1 parts; ``edits`` errors leave one of them as it is."""
        n = self.edits + 1
        cut = [k * len(self.phrase) // n for k in range(n + 1)]
        return [(a, self.phrase[a:b]) for a, b in zip(cut, cut[1:], strict=False)]

    @cached_property
    def pattern(self) -> regex.Pattern:
        """The best match of whole words; firm words stand as they are between fuzzy parts."""
        parts, loose = [], []
        for k, w in enumerate(self.phrase.split(" ")):
            space = " " if k else ""
            if w in self.firm:
                parts += ["".join(loose) + space, None, w]
                loose = []
            else:
                loose.append(space + w)
        parts.append("".join(loose))
        out, firm = "", False
        for p in parts:
            if p is None:
                firm = True
            elif firm or not p:
                out, firm = out + regex.escape(p, special_only=True), False
            else:
                out += f"(?:{regex.escape(p, special_only=True)}){{e<={self.edits}}}" if self.edits else p
        return regex.compile(f"(?b)(?<= ){out}(?= )")


# The three phrases every scan looks for, and their labels.
BASE = (
    Notice("mit", "under the mit license", ("mit",)),
    Notice("apache-2", "apache license version 2", ("2",)),
    Notice("cc-by-nc", "cc by nc"),
)
# Usual opening words of other notices.
NOTICES = BASE + (
    Notice("agpl-3", "gnu affero general public license version 3", ("3",)),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("cc-by-sa", "creative commons attribution sharealike"),
    Notice("gpl-2", "gnu general public license version 2", ("2",)),
    Notice("gpl-3", "gnu general public license version 3", ("3",)),
    Notice("lgpl-3", "gnu lesser general public license version 3", ("3",)),
    Notice("mit", "permission is hereby granted free of charge to any person"),
    Notice("mpl-2", "mozilla public license version 2", ("2",)),
    Notice("public-domain", "free and unencumbered software released into the public domain"),
)

#: Letters small, digits and bytes beyond ASCII as they are, all else between words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """The words of a text, each between single spaces."""
    return b" ".join([b"", *text.translate(_PLAIN).split(), b""])


def _whole(text: str, at: int, phrase: str) -> bool:
    return text.startswith(phrase, at) and text[at - 1] == " " and text[at + len(phrase)] == " "


def spans(text: str, notice: Notice) -> list[tuple[int, int, int]]:
    """(start, end, errors) of a notice in a plain text: exact ones all, others where they overlap nothing better.

    Every stretch within ``notice.edits`` errors holds a piece of the phrase as it
    is, so a window around each piece that is found is searched for its best match.
    """
    size, k = len(notice.phrase), notice.edits
    exact, close, seen = set(), set(), set()
    for offset, piece in notice.pieces:
        hit = text.find(piece)
        while hit >= 0:
            at = hit - offset
            if at > 0 and _whole(text, at, notice.phrase):
                exact.add((at, at + size, 0))
            elif k and at not in seen:
                seen.add(at)
                low = max(0, at - k - 1)
                window = text[low : at + size + k + 1]
                if all(w in window for w in notice.firm):
                    m = notice.pattern.search(window)
                    if m is not None and sum(m.fuzzy_counts) <= k:
                        close.add((low + m.start(), low + m.end(), sum(m.fuzzy_counts)))
            hit = text.find(piece, hit + 1)
    out, ends = sorted(exact), []
    taken = [(a, b) for a, b, _ in out]
    for a, b, e in sorted(close, key=lambda s: (s[2], s[0], s[1])):
        if e == 0:
            continue  # told by its pieces already
        if all(b <= c or d <= a for c, d in _near(taken, a, b, size + 2 * k)):
            ends.append((a, b, e))
            insort(taken, (a, b))
    return sorted(out + ends)


def _near(taken: list[tuple[int, int]], a: int, b: int, reach: int) -> list[tuple[int, int]]:
    """Those of the sorted stretches that can overlap [a, b); none is longer than ``reach``."""
    return taken[bisect_left(taken, (a - reach,)) : bisect_left(taken, (b,))]


_MATCH = pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])


def _found(line: bytes, notices: Sequence[Notice], seeds: list[list[bytes]]) -> list[dict]:
    """Matches of all notices in a plain text, by place."""
    some = [n for n, parts in zip(notices, seeds, strict=True) if any(p in line for p in parts)]
    if not some:
        return []
    text = line.decode()
    places = sorted((a, b, n.label, n.phrase, e) for n in some for a, b, e in spans(text, n))
    out, at, word = [], 0, -1
    for a, b, label, phrase, e in places:
        word += text.count(" ", at, a)
        at = a
        out.append({"label": label, "phrase": phrase, "first_word": word, "n_words": text.count(" ", a, b) + 1, "edits": e})
    return out


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES, text: str = "text") -> DataFrame:
    """``docs`` with the license notices of every whole text.

    Added columns (they replace columns of these names): ``n_words`` and
    ``notices``, an array of (label, phrase, first_word, n_words, edits) by place:
    every exact occurrence of a phrase as consecutive words, and every stretch of
    whole words within the phrase's number of errors (insertions, deletions,
    substitutions of characters; none in its firm words) that overlaps no better
    match of the same phrase.

    A text is lower-cased (A-Z) and its words are runs of letters, digits and
    anything beyond ASCII; words are numbered from 0.  A null text has no words and
    no notices.  Rows are independent: ids may be null or repeated, and there is no
    shuffle.
    """
    notices = tuple(notices)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [[p.encode() for _, p in n.pieces] for n in notices]
        for b in batches:
            n, found = [], []
            for t in b.column("_t"):
                line = plain(t.as_buffer().to_pybytes()) if t.is_valid else b" "
                n.append(line.count(b" ") - 1)
                found.append(_found(line, notices, seeds))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(n, pa.int64()), pa.array(found, pa.list_(_MATCH))], ["_row", "n_words", "notices"])

    packed = pack(docs, _t=F.col(text))
    row = packed.schema["_row"].dataType.simpleString()
    match = "struct<label:string,phrase:string,first_word:bigint,n_words:bigint,edits:int>"
    out = packed.mapInArrow(fn, f"_row {row}, n_words bigint, notices array<{match}>")
    return unpack(out, docs.columns, "n_words", "notices")
