"""URL filter by a bit-parallel wildcard automaton.

All glob patterns are packed side by side into one state vector of 64-bit
words (Shift-And with self-loops for the wildcards).  A batch of URLs is
simulated together: one step per byte position moves every pattern of every
URL with a few word operations, so the work is (bytes of URL) x (words of the
pattern set) and does not depend on which patterns fit.

Globs, over the UTF-8 bytes of the canonical URL (lower-cased host followed by
the path): ``*`` any run of bytes but ``/``, ``**`` any run of bytes, ``?``
one byte but ``/``; anything else stands for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the longest rule that fits a URL decides.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Without a fitting rule, a host that fits one of these globs is blocked.
BAD_HOSTS = ("*casino*", "*free-bets*", "*ads-track*", "*spam-farm*", "*cheap-pills*", "*adult-*")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased.  Path: from there up to ``?``, ``#`` or the end.  Both empty
    for a null URL or one without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_globs(host: str, path: str) -> list[str]:
    """A rule fits its host and all subdomains where the path starts with its path."""
    return [f"{host}{path}**", f"*.{host}{path}**"]


def host_globs(glob: str) -> list[str]:
    """A host glob, whatever the path."""
    return [glob, f"{glob}/**"]


@dataclass
class Automaton:
    """``step[c]``: states that byte ``c`` enters from the state before;
    ``loop[c]``: states that byte ``c`` keeps; one bit per state, ``words``
    64-bit words; ``final[p]``: bit number of pattern ``p``'s last state."""

    step: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    final: np.ndarray

    @staticmethod
    def compile(globs: Sequence[str]) -> Automaton:
        any_byte = np.ones(256, bool)
        no_slash = any_byte.copy()
        no_slash[ord("/")] = False
        enters, loops, starts, finals = [], [], [], []  # one entry per state
        for glob in globs:
            starts.append(len(enters))
            enters.append(np.zeros(256, bool))
            loops.append(np.zeros(256, bool))
            b, i = glob.encode(), 0
            while i < len(b):
                if b[i : i + 2] == b"**":
                    loops[-1] = any_byte
                    i += 2
                    continue
                if b[i] == ord("*"):
                    loops[-1] = loops[-1] | no_slash
                    i += 1
                    continue
                accept = no_slash if b[i] == ord("?") else np.arange(256) == b[i]
                enters.append(accept)
                loops.append(np.zeros(256, bool))
                i += 1
            finals.append(len(enters) - 1)
        n = len(enters)
        words = max(1, -(-n // 64))

        def packed(table) -> np.ndarray:
            bits = np.zeros((256, words * 64), bool)
            if n:
                bits[:, :n] = np.array(table).T
            return np.packbits(bits, axis=1, bitorder="little").view("<u8")

        start = np.zeros(words, np.uint64)
        for s in starts:
            start[s // 64] |= np.uint64(1) << np.uint64(s % 64)
        return Automaton(packed(enters), packed(loops), start, np.array(finals, np.int64))

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: does pattern ``p`` (column) fit text ``t`` (row)?"""
        n, words = len(texts), len(self.start)
        state = np.tile(self.start, (n, 1))
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")  # the active texts are a prefix
        flat = np.frombuffer(b"".join(texts), np.uint8)
        offsets = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = lengths[order]
        active = n
        for at in range(int(sorted_lengths[0]) if n else 0):
            while active and sorted_lengths[active - 1] <= at:
                active -= 1
            c = flat[offsets[:active] + at]
            d = state[:active]
            moved = d << np.uint64(1)
            if words > 1:
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.step[c]) | (d & self.loop[c])
        hit = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, len(self.final)), bool)
        out[order] = hit.astype(bool)
        return out


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, bad_hosts=BAD_HOSTS,
               batch: int = 4096) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    The longest fitting rule decides (of equally long ones that with the longer
    host, then the earlier); without one, ``bad_hosts`` block and the rest is
    allowed.  A null, empty or odd URL has an empty host and path, no rule and
    is allowed.  Every row is kept, repeated ones included; a column that
    already has the name of an output column is replaced.
    """
    globs, owner = [], []
    for i, (_, host, path) in enumerate(rules):
        for g in rule_globs(host, path):
            globs.append(g)
            owner.append(i)
    n_rule = len(globs)
    for g in bad_hosts:
        globs += host_globs(g)
    auto = Automaton.compile(globs)
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), -len(rules[i][1]), i))
    owners = np.array(owner, np.int64)
    names = [h + p for _, h, p in rules]
    verdicts = [v for v, _, _ in rules]

    @F.pandas_udf("rule string, verdict string")
    def judge(canonical: pd.Series) -> pd.DataFrame:
        texts = [t.encode() for t in canonical]
        got_rule: list = []
        got_verdict: list = []
        for i in range(0, len(texts), batch):
            hit = auto.run(texts[i : i + batch])
            best = np.full(len(hit), -1)
            for r in reversed(rank):  # the strongest rule is written last
                best[hit[:, :n_rule][:, owners == r].any(axis=1)] = r
            bad = hit[:, n_rule:].any(axis=1)
            got_rule += [names[r] if r >= 0 else None for r in best]
            got_verdict += [verdicts[r] if r >= 0 else ("block" if b else "allow")
                            for r, b in zip(best, bad)]
        return pd.DataFrame({"rule": pd.Series(got_rule, dtype=object),
                             "verdict": pd.Series(got_verdict, dtype=object)})

    host, path = host_and_path(F.col(f"`{url}`"))
    out = df.withColumns({"host": host, "path": path})
    out = out.withColumn("_judged", judge(F.concat("host", "path")))
    return out.withColumns({"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}).drop("_judged")


def oracle(rules=RULES, bad_hosts=BAD_HOSTS) -> str:
    """The same in DuckDB SQL over ``pages``."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ranked)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ranked)
    bad = " OR ".join(f"host LIKE '{g.replace('*', '%')}'" for g in bad_hosts)
    return f"""
    WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3)
                                    ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM r),
    u AS (SELECT page_id, translate(h0, '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM h)
    SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
           CASE {verdict} WHEN {bad} THEN 'block' ELSE 'allow' END AS verdict
    FROM u"""
