"""URL filters by a bit-parallel wildcard automaton.

Globs become Shift-And masks: one bit for each state (a place in a glob), packed
into 64-bit words, glob after glob. A step moves all states of all globs over
one byte of a URL at once: ``states = (states << 1) & enter[byte] | states &
stay[byte]``, with the top bit of a word carried into the next. Tasks step the
URLs of a batch side by side, the longest last.

In a glob ``*`` stands for any run of signs but ``/``, ``**`` for any run, ``?``
for one sign but ``/``, ``[a-z]`` and ``[!a-z]`` for one ASCII sign in or
outside a set (but ``/``), and a backslash takes the sign after it as it is.

A URL's canonical form is its host (after the first ``://`` up to ``/``, ``?``,
``#`` or the end, A-Z lower-cased) and its path (from there up to ``?``, ``#``
or the end). It is matched with a dot before it, so that a host's rule, ``*.``
and the host, fits the host as well as its subdomains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that are stepped together; globs beyond them follow in further rounds, so memory does not grow with their number.
BLOCK_WORDS = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{escape(self.host)}{escape(self.path)}**"


#: Verdicts for URLs that no rule fits: files that hold no text, and pages to log in or to buy.
GLOBS = [("**.exe", "block"), ("**.zip", "block"), ("**.jpg", "block"), ("**.png", "block"), ("**.mp4", "block"), ("**.css", "block"), ("**.js", "block"), ("**/wp-login.php", "block"), ("**/cart/**", "block")]


def escape(text: str) -> str:
    return "".join("\\" + c if c in "*?[]\\" else c for c in text)


def _any_but(*out: int) -> np.ndarray:
    s = np.ones(256, bool)
    s[list(out)] = False
    return s


_SLASH = ord("/")
_FOLLOW = np.zeros(256, bool)  # the later bytes of a sign in UTF-8
_FOLLOW[0x80:0xC0] = True


def states_of(glob: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each state after the first the bytes that enter it, and for each state the bytes that it stays on."""
    enter, stay = [], [np.zeros(256, bool)]
    raw, i = glob.encode("utf-8", "surrogatepass"), 0
    while i < len(raw):
        c = raw[i:i + 1]
        if raw[i:i + 2] == b"**":
            stay[-1] = np.ones(256, bool)
            i += 2
            continue
        if c == b"*":
            stay[-1] = stay[-1] | _any_but(_SLASH)
            i += 1
            continue
        loop = np.zeros(256, bool)
        if c == b"?":
            into, loop = _any_but(_SLASH) & ~_FOLLOW, _FOLLOW.copy()
        elif c == b"[":
            end = raw.find(b"]", i + 2 + (raw[i + 1:i + 2] == b"!"))
            if end < 0:
                raise ValueError(f"no end of a set in {glob!r}")
            part, into, j = raw[i + 1:end], np.zeros(256, bool), 0
            out = part.startswith(b"!")
            part = part[out:]
            while j < len(part):
                to = part[j + 2] if part[j + 1:j + 2] == b"-" and j + 2 < len(part) else part[j]
                into[part[j]:to + 1] = True
                j += 3 if part[j + 1:j + 2] == b"-" and j + 2 < len(part) else 1
            if out:
                into, loop = ~into & ~_FOLLOW, _FOLLOW.copy()
            into[_SLASH] = False
            i = end
        else:
            if c == b"\\":
                i += 1
                if i == len(raw):
                    raise ValueError(f"nothing after the backslash of {glob!r}")
            into = np.zeros(256, bool)
            into[raw[i]] = True
        enter.append(into)
        stay.append(loop)
        i += 1
    return enter, stay


@dataclass
class Block:
    """Masks of some globs: ``enter`` and ``stay`` by byte and word, first and last states, and the globs' numbers."""

    enter: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: list[tuple[int, np.uint64]]
    numbers: list[int]


def compiled(globs: list[str], words: int = BLOCK_WORDS) -> list[Block]:
    """The globs in blocks of at most ``words`` words; a glob longer than that has a block of its own."""
    blocks: list[list[tuple[int, list, list]]] = []
    used = 0
    for k, g in enumerate(globs):
        enter, stay = states_of(g)
        if not blocks or used + len(stay) > 64 * words:
            blocks.append([])
            used = 0
        blocks[-1].append((k, enter, stay))
        used += len(stay)
    out = []
    for parts in blocks:
        n = sum(len(stay) for _, _, stay in parts)
        into, loop, start, last, at = np.zeros((n, 256), bool), np.zeros((n, 256), bool), np.zeros(n, bool), [], 0
        for _, enter, stay in parts:
            start[at] = True
            if enter:
                into[at + 1:at + len(stay)] = enter
            loop[at:at + len(stay)] = stay
            at += len(stay)
            last.append(((at - 1) // 64, np.uint64(1 << (at - 1) % 64)))
        out.append(Block(_packed(into), _packed(loop), _packed(start[:, None])[0], last, [k for k, _, _ in parts]))
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """States by bytes to bytes by 64-bit words."""
    n = -(-len(bits) // 64)
    wide = np.zeros((64 * n, bits.shape[1]), bool)
    wide[:len(bits)] = bits
    return np.ascontiguousarray(np.packbits(wide.T, axis=1, bitorder="little")).view("<u8")


def matches(block: Block, text: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """``(glob number, rows that it fits)`` for the globs of a block that fit any."""
    size = np.fromiter(map(len, text), np.int64, len(text))
    order = np.argsort(-size, kind="stable")  # the rows that go on stand first
    start = (np.cumsum(size) - size)[order]
    sign, shorter = np.frombuffer(b"".join(text) + b"\0", np.uint8), -size[order]
    states = np.repeat(block.first[None, :], len(text), axis=0)
    alive = len(text)
    for j in range(-int(shorter[0]) if len(text) else 0):
        alive = int(np.searchsorted(shorter[:alive], -j, side="left"))  # rows longer than j
        byte, now = sign[start[:alive] + j], states[:alive]
        moved = now << np.uint64(1)
        moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
        states[:alive] = moved & block.enter[byte] | now & block.stay[byte]
    for k, (word, bit) in zip(block.numbers, block.last):
        hit = np.flatnonzero(states[:, word] & bit)
        if len(hit):
            yield k, order[hit]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``."""
    pattern, text = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def filter_urls(df: DataFrame, rules: list[Rule], globs: list[tuple[str, str]] = GLOBS, default: str = "allow", url_col: str = "url", nested: bool = False) -> DataFrame:
    """All rows of ``df`` with ``host, path, rule, glob, verdict``.

    ``rule`` is the longest rule that fits (ties: the least name) and gives the
    verdict. Where none fits, the first of ``globs`` (over host and path) that
    fits gives it and stands in ``glob``, else ``default`` holds. A null URL or
    one without ``://`` has an empty host and path. Repeated rows each get a
    row. There is no shuffle; the masks are those of the declared lists.
    Columns of ``df`` with the names added here give way to them; with
    ``nested`` the row of ``df`` comes whole, as a struct ``row``.
    """
    first = sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict))
    if len({r.name for r in first}) < len(first):
        raise ValueError("two verdicts for one rule")
    blocks = compiled([r.glob for r in first] + [escape(".") + g for g, _ in globs])
    names, verdicts, n_rules = [r.name for r in first] + [g for g, _ in globs], [r.verdict for r in first] + [v for _, v in globs], len(first)

    @F.pandas_udf("rule string, glob string, verdict string")
    def judged(canonical: pd.Series) -> pd.DataFrame:
        text = canonical.tolist()
        best = np.full(len(text), len(names))
        for block in blocks if text else []:
            for k, rows in matches(block, text):
                best[rows] = np.minimum(best[rows], k)
        return pd.DataFrame({
            "rule": [names[k] if k < n_rules else None for k in best],
            "glob": [names[k] if n_rules <= k < len(names) else None for k in best],
            "verdict": [verdicts[k] if k < len(names) else default for k in best],
        }, dtype=object)

    host, path = host_and_path(F.col(url_col))
    d = df.select(F.struct("*").alias("row"), host.alias("host"), path.alias("path"))
    d = d.withColumn("found", judged(F.concat(F.lit("."), "host", "path").cast("binary"))).select("row", "host", "path", "found.*")
    made = ["host", "path", "rule", "glob", "verdict"]
    return d if nested else d.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in made], *made)


def oracle(rules: list[Rule], patterns: list[tuple[str, str]], default: str = "allow", table: str = "pages") -> str:
    """The contract's rows over ``table`` as SQL; ``patterns`` says each glob as a regular expression over host and path, with its verdict."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(r.host)}, {q(r.path)}, {q(r.verdict)})" for r in rules)
    more = "".join(f" WHEN regexp_full_match(s.host || s.path, {q(p)}, 's') THEN {q(v)}" for p, v in patterns)
    return f"""
WITH r AS (SELECT col0 h, col1 p, col2 v FROM (VALUES {values}) t(col0, col1, col2)),
u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS x FROM {table}),
s AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM s),
b AS (SELECT host, path, arg_max(struct_pack(n := h || p, v := v), length(h || p)) f FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT page_id, s.host, s.path, f.n AS rule, CASE WHEN f IS NOT NULL THEN f.v{more} ELSE {q(default)} END AS verdict
FROM s LEFT JOIN b ON b.host = s.host AND b.path = s.path"""
