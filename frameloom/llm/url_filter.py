"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Glob rules are packed one after the other into Shift-And masks of as many 64-bit words as they need; every pattern is
simulated at once, one step a byte, for a whole Arrow batch of URLs side by side. In a rule ``?`` is one byte,
``*`` any run without a slash and ``**`` any run. A canonical URL is ``.`` + host + path, so ``**.net/de/**``
with a host rule's stars kept off slashes reads: the host net or a subdomain, a path that starts with /de/.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; very
long URLs are read whole (batches are walked in order of length, so they cost only their own steps); repeated
rows are judged alike; an empty table gives an empty result; columns of the input that bear an output
name give way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import add_columns

ALLOW, BLOCK = "allow", "block"
#: Words of 64 bits that the states of the URLs walked at once take: 8 MB, a few times over.
SLICE_WORDS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A glob over ``.host/path``; the rule of the highest rank that fits decides."""

    glob: str
    verdict: str
    name: str
    rank: int
    base: bool = False


def host_rule(text: str, verdict: str) -> Rule:
    """``net/de/``: the host net and its subdomains, paths from /de/ on; longer rules win."""
    host, slash, path = text.partition("/")
    return Rule(f"*.{escaped(host)}{slash}{escaped(path)}**", verdict, text, 1_000_000 + len(text), True)


def escaped(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


# The host rules of the contract.
BASE_RULES = (
    host_rule("com/en/", BLOCK),
    host_rule("example.com/en/7", ALLOW),
    host_rule("net/de/", ALLOW),
    host_rule("example.net/de/8", BLOCK),
    host_rule("org/es/", BLOCK),
)

#: Globs for all other URLs; an allow stands above a block.
GLOBS = tuple(
    [Rule(g, BLOCK, g, 1) for g in ("*.*spam*/**", "*.*pills*/**", "*.*casino*/**", "*.*poker*/**", "*.*porn*/**", "*.*xxx*/**", "*.*torrent*/**", "*.*malware*/**", "*.*phish*/**", "*.ads.*/**", "*.adserver*/**", "**/wp-login**", "**/ads/**", "**.exe", "**.apk")]
    + [Rule(g, ALLOW, g, 2) for g in ("*.edu/**", "*.gov/**", "*.edu", "*.gov")]
)

#: The blocking host globs without a path, for URLs that have none.
BARE_HOSTS = tuple(Rule(g, BLOCK, g, 1) for g in (r.glob.removesuffix("/**") for r in GLOBS if r.verdict == BLOCK and r.glob.startswith("*.") and r.glob.endswith("/**")))


class Automaton:
    """Shift-And masks of several globs: bit k is the state before a pattern's k-th sign (one more for its end)."""

    def __init__(self, globs: Sequence[str]) -> None:
        signs = [self._signs(g) for g in globs]
        bits = sum(len(own) + 1 for own, _ in signs)
        words = max(1, -(-bits // 64))
        match = np.zeros((256, bits), bool)  # state k moves on to k + 1
        stay = np.zeros((256, bits), bool)  # state k stays
        begin, final, at = np.zeros(bits, bool), [], 0
        for own, loops in signs:
            begin[at] = True
            for k, sign in enumerate(own):
                match[slice(None) if sign is None else sign, at + k] = True
            for k, slashes in loops.items():
                stay[:, at + k] = True
                stay[ord("/"), at + k] = slashes
            at += len(own) + 1
            final.append(at - 1)
        self.final = final
        self.match, self.stay = self._packed(match, words), self._packed(stay, words)
        self.begin = self._packed(begin[None, :], words)[0]

    @staticmethod
    def _signs(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        """Bytes to match (None: any), and the states that loop: with True on every byte, else on all but a slash."""
        own: list[int | None] = []
        loops: dict[int, bool] = {}
        data, k = glob.encode(), 0
        while k < len(data):
            c = data[k : k + 1]
            if c == b"*":
                double = data[k : k + 2] == b"**"
                loops[len(own)] = loops.get(len(own), False) or double
                k += 2 if double else 1
                continue
            if c == b"\\" and k + 1 < len(data):
                k += 1
            own.append(None if c == b"?" else data[k])
            k += 1
        return own, loops

    @staticmethod
    def _packed(rows: np.ndarray, words: int) -> np.ndarray:
        wide = np.zeros((len(rows), words * 64), bool)
        wide[:, : rows.shape[1]] = rows
        return np.packbits(wide, axis=1, bitorder="little").view("<u8")

    def fits(self, texts: Sequence[bytes]) -> np.ndarray:
        """A row a text, a column a pattern: whether the whole text fits. Texts are walked in slices, so that states stay small whatever the number of patterns."""
        return np.concatenate([self._fits(part) for part in self._slices(texts)]) if texts else np.empty((0, len(self.final)), bool)

    def first(self, texts: Sequence[bytes]) -> list[int]:
        """The first pattern that each whole text fits, or -1."""
        found = []
        for part in self._slices(texts):
            fits = self._fits(part)
            found += np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist() if self.final else [-1] * len(part)
        return found

    def _slices(self, texts: Sequence[bytes]) -> Iterator[Sequence[bytes]]:
        step = max(1, SLICE_WORDS // self.match.shape[1])  # a pattern has a sign at least, so words bound the patterns too
        return (texts[at : at + step] for at in range(0, len(texts), step))

    def _fits(self, texts: Sequence[bytes]) -> np.ndarray:
        n, words = len(texts), self.match.shape[1]
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # those still running come first
        joined = np.frombuffer(b"".join(texts), np.uint8)
        first = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        state = np.repeat(self.begin[None, :], n, axis=0)
        running = n
        for step in range(int(sizes[0]) if n else 0):
            while sizes[running - 1] <= step:
                running -= 1
            byte = joined[first[:running] + step]
            now = state[:running]
            go = now & self.match[byte]
            moved = go << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= go[:, :-1] >> np.uint64(63)
            state[:running] = moved | (now & self.stay[byte])
        out = np.empty((n, len(self.final)), bool)
        for k, bit in enumerate(self.final):
            out[order, k] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        return out


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    """The host, with A-Z in lower case, and the path up to the query or fragment; both empty without ``://``."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.lower(), slash + path


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table (glob, verdict, rank), whatever their number; names are the globs. Null or other verdicts are refused.

    Rules are the query of the operator, not its corpus: they are held by the driver and by each worker, at some 4 kB a glob of 35 signs
    (two masks for each byte value).
    """
    rows = table.select("glob", "verdict", "rank").distinct().orderBy("rank", "glob", "verdict").collect()
    if any(r["glob"] is None or r["rank"] is None or r["verdict"] not in (ALLOW, BLOCK) for r in rows):
        raise ValueError("a rule needs a glob, a rank and a verdict of allow or block")
    return [Rule(r["glob"], r["verdict"], r["glob"], r["rank"]) for r in rows]


def judge(pages: DataFrame, rules: Iterable[Rule] = (*BASE_RULES, *GLOBS, *BARE_HOSTS), *, url_col: str = "url", prefix: str = "", back: list[str] | None = None) -> DataFrame:
    """``pages`` (of its columns, ``back``: all) with host, path, rule (a base rule's name, else null), verdict and pattern (the glob that decided, else null)."""
    rules = sorted(rules, key=lambda r: -r.rank)
    automaton = Automaton([r.glob for r in rules])

    def score(urls: list[bytes]) -> list:
        parts = [host_and_path(u) for u in urls]
        chosen = [rules[k] if k >= 0 else None for k in automaton.first([b"." + h + p if h or p else b"" for h, p in parts])]
        return [
            [h.decode() for h, _ in parts],
            [p.decode() for _, p in parts],
            [r.name if r and r.base else None for r in chosen],
            [r.verdict if r else ALLOW for r in chosen],
            [r.glob if r else None for r in chosen],
        ]

    return add_columns(pages, url_col, [T.StructField(prefix + n, T.StringType()) for n in ("host", "path", "rule", "verdict", "pattern")], score, back)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, back=["page_id"]).select("page_id", "host", "path", "rule", "verdict", "pattern")


def _sql() -> str:
    """The same verdicts by comparisons and regular expressions over host and path, of all rules."""
    globs = sorted((*GLOBS, *BARE_HOSTS), key=lambda r: -r.rank)
    cases = "".join(f"\n            WHEN regexp_full_match(u, '{_regex(r.glob)}') THEN {k}" for k, r in enumerate(globs))
    table = ", ".join(f"({k}, '{r.glob}', '{r.verdict}')" for k, r in enumerate(globs))
    base = sorted(BASE_RULES, key=lambda r: -r.rank)
    fits = "".join(f"\n            WHEN (host = '{r.name.partition('/')[0]}' OR ends_with(host, '.{r.name.partition('/')[0]}')) AND starts_with(path, '/{r.name.partition('/')[2]}') THEN {k}" for k, r in enumerate(base))
    rules = ", ".join(f"({k}, '{r.name}', '{r.verdict}', '{r.glob}')" for k, r in enumerate(base))
    return rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') AS h, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
q AS (SELECT page_id, translate(coalesce(h, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(path, '') AS path FROM p),
u AS (SELECT *, CASE WHEN host || path = '' THEN '' ELSE '.' || host || path END AS u FROM q),
f AS (SELECT *, CASE{fits} END AS b, CASE{cases} END AS g FROM u)
SELECT page_id, host, path, bases.name AS rule, coalesce(bases.verdict, globs.verdict, 'allow') AS verdict, coalesce(bases.pattern, globs.pattern) AS pattern
FROM f LEFT JOIN (VALUES {rules}) bases(k, name, verdict, pattern) ON f.b = bases.k LEFT JOIN (VALUES {table}) globs(k, pattern, verdict) ON f.g = globs.k
"""


def _regex(glob: str) -> str:
    out, k = "", 0
    while k < len(glob):
        if glob[k] == "*":
            double = glob[k : k + 2] == "**"
            out += "(?s:.)*" if double else "[^/]*"
            k += 1 + double
        else:
            out += "\\" + glob[k] if glob[k] in ".-" else glob[k]
            k += 1
    return out


OP5_SQL = _sql()
