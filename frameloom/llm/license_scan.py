"""License scans: fuzzy short-notice search.

A notice of n letters with at most k edits, cut into k + 1 pieces, holds one piece unchanged (pigeonhole). Each
text, reduced to lower-case words with one blank between them, is searched for the pieces exactly; around each find the
regex library matches the whole notice with bounded errors, which verifies the edits and gives the span. Words that tell
licenses apart are matched without errors, and of notices that claim the same words the closest one wins. The base
phrases are also counted word by word, without errors and overlapping ones included.

Defined results: a null text counts as empty and has no words, places or labels and a score of 0; nothing is found
twice at one place; repeated rows give repeated rows; an empty table gives an empty result; columns of the
input that bear an output name give way.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_columns, documents


@dataclass(frozen=True)
class Notice:
    label: str
    words: str
    edits: int
    base: bool = False
    #: Words that must be there unchanged, and words that may be edited between their first and last letter only.
    tell: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()


# Base phrases and labels of the contract (edits are ours).
BASE = (
    Notice("mit", "under the mit license", 2, True, tell=("mit",)),
    Notice("apache-2", "apache license version 2", 3, True, tell=("2",), ends=("apache",)),
    Notice("cc-by-nc", "cc by nc", 0, True),
)

#: Further short notices, as lower-case words.
MORE = (
    Notice("gpl", "gnu general public license", 3, ends=("gnu", "general")),
    Notice("lgpl", "gnu lesser general public license", 3, ends=("gnu", "lesser")),
    Notice("agpl", "gnu affero general public license", 3, ends=("gnu", "affero")),
    Notice("mpl", "mozilla public license", 2, ends=("mozilla",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("mit", "permission is hereby granted free of charge to any person", 5),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3, ends=("sharealike",)),
    Notice("cc0", "cc0 1 0 universal", 1, tell=("1", "0"), ends=("cc0",)),
    Notice("all-rights-reserved", "all rights reserved", 2),
)

#: A-Z to lower case; white space and all ASCII signs but letters and digits to a blank.
_REDUCE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def reduced(text: bytes) -> list[bytes]:
    return text.translate(_REDUCE).split()


def pieces(words: bytes, edits: int) -> list[tuple[int, bytes]]:
    """edits + 1 pieces of a notice, and where each begins."""
    n, k = len(words), edits + 1
    cuts = [n * j // k for j in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def fuzzy(notice: Notice) -> bytes:
    """The notice as a pattern: stretches with bounded errors between the letters that stay. The errors of all stretches are summed by who matches.

    A number that tells versions apart is no other number's part, and no digit comes or goes beside it.
    """
    numbers = any(w.isdigit() for w in notice.tell)
    bound = b"{e<=%d%s}" % (notice.edits, b":[^0-9]" if numbers else b"")
    out, run = b"", ""

    def stay(letters: str, before: bytes = b"", after: bytes = b"") -> bytes:
        nonlocal run
        edited = b"(?:%s)%s" % (regex.escape(run.encode(), special_only=True), bound) if run else b""
        run = ""
        return edited + before + letters.encode() + after

    for k, word in enumerate(notice.words.split()):
        run += " " * (k > 0)
        if word in notice.tell:
            out += stay(word, b"(?<![0-9])", b"(?![0-9])") if word.isdigit() else stay(word, b"(?<![^ ])", b"(?![^ ])")
        elif word in notice.ends:
            out += stay(word[0], b"(?<![^ ])")
            run = word[1:-1]
            out += stay(word[-1], after=b"(?![^ ])")
        else:
            run += word
    return out + stay("")


class Scanner:
    """The compiled notices; made once a Python worker."""

    def __init__(self, notices: Sequence[Notice]) -> None:
        self.notices = list(notices)
        self.pieces = [pieces(n.words.encode(), n.edits) for n in notices]
        self.regexes = [regex.compile(rb"(?b)(?<![^ ])%s(?![^ ])" % fuzzy(n)) for n in notices]

    def exact(self, text: bytes, starts: list[int]) -> list[tuple[int, int]]:
        """(notice, first word) of every place of a base phrase, overlapping ones included."""
        found = []
        for k, notice in enumerate(self.notices):
            if notice.base:
                phrase = b" %s " % notice.words.encode()
                at = text.find(phrase)
                while at >= 0:
                    found.append((k, bisect_left(starts, at + 1)))
                    at = text.find(phrase, at + 1)
        return found

    def finds(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(notice, begin, end, edits), in bytes of the reduced text, of all verified finds."""
        found = set()
        for k, (notice, seeds, pattern) in enumerate(zip(self.notices, self.pieces, self.regexes, strict=True)):
            n, windows = len(notice.words), set()
            for offset, seed in seeds:
                at = text.find(seed)
                while at >= 0:
                    windows.add(max(0, at - offset - notice.edits))
                    at = text.find(seed, at + 1)
            last = -1
            for low in sorted(windows):
                if low <= last:  # another piece of the find before
                    continue
                # Up to a blank, so that the end of what is searched is no end of a word by itself.
                high = text.find(b" ", low + n + 3 * notice.edits + 2)
                got = pattern.search(text, low, high + 1 or len(text))
                if got and sum(got.fuzzy_counts) <= notice.edits:
                    found.add((k, got.start(), got.end(), sum(got.fuzzy_counts)))
                    last = got.start()
        return sorted(found)

    def spans(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """The finds, less those that share a word with a find of another label that has fewer edits (or as many, and is longer)."""
        taken: list[tuple[int, int, int, int]] = []
        for find in sorted(self.finds(text), key=lambda f: (f[3], f[1] - f[2], f)):
            k, begin, end, _ = find
            if not any(begin < e and b < end and self.notices[o].label != self.notices[k].label for o, b, e, _ in taken):
                taken.append(find)
        return sorted(taken)


def scan(docs: DataFrame, notices: Sequence[Notice] = (*BASE, *MORE), *, text_col: str = "text", prefix: str = "", back: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns, ``back``: all) with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans: ``label:first word-last word:edits`` of every verified find, joined by commas. score: 1 less the share of
    edited letters of the best find.
    """
    notices = tuple(notices)
    holder: list[Scanner] = []

    def score(texts: list[bytes]) -> list:
        if not holder:
            holder.append(Scanner(notices))
        scanner, rows = holder[0], []
        for raw in texts:
            words = reduced(raw)
            text = b" %s " % b" ".join(words)
            spans = scanner.spans(text)
            exact: list[tuple[int, int]] = []
            starts: list[int] = []
            if spans:
                at = 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
                exact = scanner.exact(text, starts)
            base = {notices[k].label for k, _ in exact}
            best = max((1 - e / len(notices[k].words) for k, _, _, e in spans), default=0.0)
            told = [f"{notices[k].label}:{bisect_left(starts, s)}-{bisect_left(starts, e) - 1}:{n}" for k, s, e, n in spans]
            places = [w for _, w in exact]
            rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {notices[k].label for k, *_ in spans})), best, ",".join(told)))
        return list(zip(*rows, strict=True))

    longs = [T.StructField(prefix + n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    strings = [T.StructField(prefix + n, T.StringType()) for n in ("base_labels", "labels")]
    return add_columns(docs, text_col, [*longs, *strings, T.StructField(prefix + "score", T.DoubleType()), T.StructField(prefix + "spans", T.StringType())], score, back)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text"), back=["doc_id"])
