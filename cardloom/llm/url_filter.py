"""URL filters: all glob rules as one bit-parallel Shift-And automaton over canonical URLs.

A canonical URL is host + path (scheme, query and fragment are cut). In a glob, ``*`` is any run of bytes other than
``/`` and ``**`` any run at all; everything else stands for itself. The states of all globs are packed side by side
into 64-bit words. State j of a glob means that its first j literals are matched; a star is a loop on the state where
it stands. A byte c moves every state of every glob at once: ((D & step[c]) << 1) | (D & loop[c]).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

#: The rules of the query's contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Globs that block a URL no rule fits; all others are allowed.
BLOCK = ("ads.*/**", "*.ads.*/**", "**/ads/**", "**/adserver/**", "**/banner/**", "track.*/**", "*.track.*/**", "**/login", "**/login/**", "**/wp-admin/**", "**/cgi-bin/**", "**.exe", "**.zip")
_CELLS = 1 << 22


class Automaton(NamedTuple):
    step: np.ndarray  # 256 x words
    loop: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, int]]  # word and bit of each glob's last state


def compile_globs(globs: Sequence[str]) -> Automaton:
    """Pack the globs' states; repeated or adjoining stars merge into the wider one."""
    states, accept, begin = [], [], []
    for glob in globs:
        begin.append(len(states))
        now = [None, 0]  # the literal that leads on, the loop's kind
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i] == 0x2A:
                wide = raw[i : i + 2] == b"**"
                now[1] = max(now[1], 2 if wide else 1)
                i += 2 if wide else 1
            else:
                now[0] = raw[i]
                states.append(now)
                now = [None, 0]
                i += 1
        accept.append(divmod(len(states), 64))
        states.append(now)
    words = (len(states) + 63) // 64
    step, loop, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    for s, (literal, star) in enumerate(states):
        at, bit = s // 64, np.uint64(1 << s % 64)
        if literal is not None:
            step[literal, at] |= bit
        if star:
            loop[:, at] |= bit
        if star == 1:
            loop[0x2F, at] &= ~bit
    for s in begin:
        start[s // 64] |= np.uint64(1 << s % 64)
    return Automaton(step, loop, start, accept)


def matches(a: Automaton, texts: Sequence[bytes]) -> np.ndarray:
    """texts x globs, True where the glob matches the whole text."""
    n, words = len(texts), len(a.start)
    out = np.zeros((n, len(a.accept)), bool)
    size = np.fromiter(map(len, texts), np.int64, n)
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < n:
        longest = int(size[order[at]])
        rows = order[at : at + max(1, _CELLS // max(1, longest))]
        at += len(rows)
        grid = np.frombuffer(b"".join(texts[r].ljust(longest, b"\0") for r in rows), np.uint8).reshape(len(rows), longest)
        live = np.searchsorted(-size[rows], -np.arange(longest), side="left")
        d = np.tile(a.start, (len(rows), 1))
        for i in range(longest):
            c = grid[: live[i], i]
            now = d[: live[i]]
            moved = now & a.step[c]
            shifted = moved << np.uint64(1)
            if words > 1:
                shifted[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            d[: live[i]] = shifted | (now & a.loop[c])
        for g, (word, bit) in enumerate(a.accept):
            out[rows, g] = (d[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
    return out


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def canonical(url: bytes) -> tuple[bytes, bytes]:
    """host and path; both empty without ://."""
    _, sep, rest = url.partition(b"://")
    if not sep:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_LOWER), slash + path


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block: Sequence[str] = BLOCK) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url, ...); other columns are not read.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule (host and
    path together, the earlier one on ties) wins. With no rule, a URL that any block glob matches is blocked. A null
    URL, or one without ://, has an empty host and path, fits nothing and is allowed. Repeated rows are each judged.
    """

    def make():
        ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
        globs = [g for _, host, path in ranked for g in (f"{host}{path}**", f"*.{host}{path}**")]
        a = compile_globs([*globs, *block])
        names = [f"{host}{path}" for _, host, path in ranked]

        def step(batch: pa.RecordBatch) -> dict:
            parts = [canonical(u.as_py() or b"") for u in batch.column(1).cast(pa.large_binary())]
            hit = matches(a, [h + p for h, p in parts])
            by_rule = hit[:, : len(globs)].reshape(len(parts), len(names), 2).any(axis=2)
            first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1) if names else 0, -1)
            blocked = hit[:, len(globs) :].any(axis=1)
            return {
                "page_id": batch.column(0),
                "host": pa.array([h.decode() for h, _ in parts], pa.string()),
                "path": pa.array([p.decode() for _, p in parts], pa.string()),
                "rule": pa.array([names[k] if k >= 0 else None for k in first], pa.string()),
                "verdict": pa.array([ranked[k][0] if k >= 0 else "block" if b else "allow" for k, b in zip(first, blocked)], pa.string()),
            }

        return step

    return per_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), "page_id long, host string, path string, rule string, verdict string", make)


def _like(glob: str) -> str:
    import re

    return "^" + "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", glob)) + "$"


def oracle_sql(rules: Sequence[tuple[str, str, str]] = RULES, block: Sequence[str] = BLOCK) -> str:
    """The same verdicts in DuckDB SQL."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked) + " WHEN " + " OR ".join(f"regexp_matches(host || path, '{_like(g)}', 's')" for g in block) + " THEN 'block' ELSE 'allow' END"
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM cut)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM parts"""
