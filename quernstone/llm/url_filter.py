"""URL filter by a bit-parallel wildcard automaton.

All glob rules are packed one after the other into the bits of a few 64-bit words. A URL's canonical form (a dot,
the lower-cased host, the path) is read byte by byte; one shift, two masks and an OR advance every rule at once
(Shift-And), the second mask keeping states that stand on a wildcard. URLs of a batch are read side by side.

Globs match the whole canonical form: ``*`` is any run without a slash, ``**`` any run. A host rule also
covers subdomains: ``com/en/`` is ``*.com/en/**`` here.

Defined cases: a null URL, or one without ``://``, has empty host and path, the form ``.``; ports and
user names are part of the host; a URL of any length is read whole; repeated rows each keep their verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii

#: The base rules (verdict, host, path); the longest that fits wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: What URLs are blocked by where no base rule fits: tracking hosts, downloads, session pages.
BLOCKED = ("*.ads.**", "*.ads-*.**", "*.track.**", "*.tracker.**", "*-track.**", "**/login", "**/login/**", "**/logout**", "**/cgi-bin/**", "**.exe", "**.zip", "**.iso", "**/wp-admin/**", "*.casino*/**", "**/cart/**")


class Automaton:
    """Globs as Shift-And masks of several words; a state's bit says that the glob's beginning up to there has been read."""

    def __init__(self, globs: list[str]):
        self.accept, bits, moves, stays = [], 0, [[] for _ in range(256)], [[] for _ in range(256)]
        start = []
        for g in globs:
            start.append(bits)
            data, i = g.encode(), 0
            while i < len(data):
                if data[i : i + 1] == b"*":
                    deep = data[i : i + 2] == b"**"
                    for c in range(256):
                        if deep or c != ord("/"):
                            stays[c].append(bits)
                    i += 1 + deep
                else:
                    bits += 1
                    moves[data[i]].append(bits)
                    i += 1
            self.accept.append(bits)
            bits += 1
        self.words = (bits + 63) // 64 or 1
        self.start, self.move, self.stay = self._mask(start), np.array([self._mask(m) for m in moves]), np.array([self._mask(s) for s in stays])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def run(self, texts: list[bytes]) -> np.ndarray:
        """For each text and glob whether the glob matches the whole text; texts of like length are read side by side."""
        out, order = np.zeros((len(texts), self.words), np.uint64), sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = max(len(texts[order[at]]), 1)
            group = order[at : at + max(1, min(8192, 4_000_000 // longest))]
            out[group] = self._side_by_side([texts[i] for i in group])
            at += len(group)
        found = np.zeros((len(texts), len(self.accept)), bool)
        for k, b in enumerate(self.accept):
            found[:, k] = out[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)
        return found

    def _side_by_side(self, texts: list[bytes]) -> np.ndarray:
        """texts: longest first, so that those still being read are the first ones."""
        sizes = np.array([len(t) for t in texts])
        letters = np.zeros((len(texts), int(sizes[0])), np.uint8)
        for i, t in enumerate(texts):
            letters[i, : len(t)] = np.frombuffer(t, np.uint8)
        states = np.tile(self.start, (len(texts), 1))
        for j in range(letters.shape[1]):
            n = int(np.searchsorted(-sizes, -j, "left"))
            d, c = states[:n], letters[:n, j]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            states[:n] = moved & self.move[c] | d & self.stay[c]
        return states


def parts(url) -> tuple:
    """Host and path of a URL column."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple = RULES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """The columns ``keep`` with host, path, rule (the longest fitting base rule, or null) and verdict."""
    host, path = parts(F.col(url))
    own = pages.select(*keep, host.alias("host"), path.alias("path"))
    schema = T.StructType([*own.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    globs = [f"*.{h}{p}**" for _, h, p in longest_first] + list(blocked)
    names, verdicts, n = [h + p for _, h, p in longest_first], [v for v, _, _ in longest_first], len(rules)

    def work(batches):
        automaton = Automaton(globs)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = automaton.run([f".{h}{p}".encode() for h, p in zip(hosts, paths)])
            fits, other = found[:, :n], found[:, n:].any(axis=1)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            rule = [names[k] if k >= 0 else None for k in first]
            verdict = [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(first, other)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return own.mapInArrow(work, schema)


def regex_of(glob: str) -> str:
    """The glob as a regular expression, for the SQL that checks the automaton."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "[\\s\\S]*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_" else "\\" + glob[i]), i + 1
    return f"^{out}$"


def oracle() -> str:
    longest_first = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{}}'".format(h + p) for _, h, p in longest_first)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in longest_first)
    other = " OR ".join(f"regexp_matches(concat('.', host, path), '{regex_of(g)}')" for g in BLOCKED)
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {fits} END AS rule FROM u)
SELECT page_id, host, path, rule, CASE {verdict} WHEN {other} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
