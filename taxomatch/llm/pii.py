"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
plus signs, digits, ``://`` and the cue words of identifiers.  From each anchor
a deterministic local parser expands to the left and right and validates what
it has read; no pattern is searched over the whole text.

Base kinds: email, ip, card, phone.  The method adds, where they touch no base
span: ``url`` (an address with a user name in it), ``account`` (an identifier
after a cue such as IBAN, SSN or account), ``secret`` (a value after a cue
such as password or token, or an access key id) and ``number`` (a card or phone
number that runs into other digits, so that the base kinds drop the whole run).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxomatch.llm.common import parts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret", "number")
ORDER = {k: i for i, k in enumerate(KINDS)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

#: Cue words (any case of the forms below) and the kind that they announce.
CUES = {"account": ("iban", "ssn", "account", "acct", "passport", "tax id"),
        "secret": ("password", "passwd", "token", "api_key", "apikey", "secret")}

# Local parsers: each is matched at one place and never searched for.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT_GROUPS = re.compile(r"[0-9]+(?:[ -]?[0-9]+)*")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CALL = re.compile(r"[0-9][ ().0-9-]+")
GROUP = re.compile(r"[0-9]+")
#: Sizes of the groups in which card numbers are printed.
PRINTED = ((4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 6, 4))
USER_INFO = re.compile(r"[^\s/?#@\"'<>]+@[^\s/?#@\"'<>]+[^\s\"'<>]*")
ASSIGNED = re.compile(r"[ \t]{0,3}[=:][ \t]{0,3}[\"']?")
SECRET = re.compile(r"[A-Za-z0-9_/+.=-]{8,}")
ACCESS_KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
AFTER_CUE = re.compile(r"(?:[ \t]{1,3}(?:no|number|nr|num)\b\.?)?[ \t]{0,3}[:#=]?[ \t]{0,3}", re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IDENTIFIER = re.compile(r"[A-Z]{0,3}[0-9][A-Z0-9-]{4,18}[0-9](?![A-Za-z0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


class Finder:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for c in "0123456789":
            self.automaton.add_word(c, ("digit", 1))
        for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("AKIA", "key")):
            self.automaton.add_word(word, (kind, len(word)))
        for kind, words in CUES.items():
            for w in words:
                for form in {w, w.upper(), w.capitalize()}:
                    self.automaton.add_word(form, (kind, len(w)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        base: list[tuple[str, int, int]] = []
        more: list[tuple[str, int, int]] = []
        mail_end = groups_end = dotted_end = call_end = 0
        for end, (what, size) in self.automaton.iter(text):
            at = end - size + 1
            if what == "digit":
                if at >= groups_end:
                    m = DIGIT_GROUPS.match(text, at)
                    groups_end = m.end()
                    self._card(m, base, more)
                if at >= dotted_end:
                    m = DOTTED.match(text, at)
                    dotted_end = m.end()
                    self._ips(m, base)
            elif what == "at":
                start = at
                while start > mail_end and text[start - 1] in LOCAL:
                    start -= 1
                m = DOMAIN.match(text, at + 1) if start < at else None
                if m:
                    mail_end = m.end()
                    base.append(("email", start, mail_end))
            elif what == "plus":
                if at >= call_end:
                    call_end = self._phone(text, at, base, more)
            elif what == "scheme":
                start = at
                while start > 0 and text[start - 1] in SCHEME and at - start < 32:
                    start -= 1
                m = USER_INFO.match(text, end + 1)
                if m and start < at and text[start].isalpha():
                    more.append(("url", start, m.end()))
            elif what == "key":
                m = ACCESS_KEY.match(text, end + 1)
                if m and not self._inside(text, at):
                    more.append(("secret", at, m.end()))
            elif not self._inside(text, at):
                m = ASSIGNED.match(text, end + 1) if what == "secret" else AFTER_CUE.match(text, end + 1)
                if m:
                    self._value(text, what, m.end(), more)
        base.sort(key=lambda s: (s[1], ORDER[s[0]]))
        return sorted(base + self._free(base, more), key=lambda s: (s[1], ORDER[s[0]]))

    @staticmethod
    def _inside(text: str, at: int) -> bool:
        """Is the anchor the tail of a longer word?"""
        return at > 0 and text[at - 1] in WORD

    @staticmethod
    def _card(m: re.Match, out: list, more: list) -> None:
        if m.end() - m.start() < 12:
            return
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
        else:
            more += [("number", m.start() + i, m.start() + j) for i, j in Finder._cards(m[0])]

    @staticmethod
    def _cards(run: str) -> list[tuple[int, int]]:
        """Card numbers that run into other digits: from the left, an unbroken group
        or groups as they are printed on cards; no group is used twice."""
        groups = [(g.start(), g.end()) for g in GROUP.finditer(run)]
        sizes = [j - i for i, j in groups]
        out, k = [], 0
        while k < len(groups):
            n = 0
            if len(groups) > 1 or sizes[0] > 19:
                n = int(12 <= sizes[k] <= 19 and luhn(run[groups[k][0] : groups[k][1]]))
            for form in () if n else PRINTED:
                if tuple(sizes[k : k + len(form)]) == form:
                    i, j = groups[k][0], groups[k + len(form) - 1][1]
                    if luhn(run[i:j].replace(" ", "").replace("-", "")):
                        n = len(form)
                        break
            if n:
                out.append((groups[k][0], groups[k + n - 1][1]))
            k += n or 1
        return out

    @staticmethod
    def _ips(m: re.Match, out: list) -> None:
        """Four numbers at a time from the left; a group that fails is dropped."""
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1

    @staticmethod
    def _phone(text: str, at: int, out: list, more: list) -> int:
        """Up to the last digit of the run; returns where the next may start."""
        m = CALL.match(text, at + 1)
        if not m:
            return at
        number = m[0].rstrip(" ().-")
        if len(number) < 3:
            return at
        end = at + 1 + len(number)
        digits = sum(map(number.count, "0123456789"))
        if 9 <= digits <= 15:
            out.append(("phone", at, end))
        elif digits > 15:  # whole groups of digits, as long as they may be one number
            n = cut = 0
            for g in GROUP.finditer(number):
                if n + len(g[0]) > 15:
                    break
                n, cut = n + len(g[0]), g.end()
            if n >= 9:
                more.append(("number", at, at + 1 + cut))
        return end

    @staticmethod
    def _value(text: str, what: str, at: int, out: list) -> None:
        if what == "secret":
            m = SECRET.match(text, at)
            if m and any(c.isdigit() for c in m[0]):
                out.append(("secret", at, m.end()))
            return
        m = IBAN.match(text, at)
        if m:
            # the longest reading that passes its check digits
            end = m.end()
            while end - at >= 15:
                if text[end - 1] != " " and iban(text[at:end]):
                    out.append(("account", at, end))
                    return
                end -= 1
        m = SSN.match(text, at) or IDENTIFIER.match(text, at)
        if m:
            out.append(("account", at, m.end()))

    @staticmethod
    def _free(base: list, more: list) -> list:
        """The added spans that touch no base span and no earlier added one."""
        out: list = []
        reach, i, last = 0, 0, 0
        for s in sorted(more, key=lambda s: (s[1], ORDER[s[0]])):
            while i < len(base) and base[i][1] < s[2]:
                reach = max(reach, base[i][2])
                i += 1
            if s[1] >= max(reach, last):
                out.append(s)
                last = s[2]
        return out


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of touching spans becomes ``<KIND>`` of its first span."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, text: str = "text", spans: str = "pii", redact: bool = False) -> DataFrame:
    """Add ``spans``: array of (kind, start, end), code points, end exclusive,
    by start, then kind as listed.  With ``redact`` the text column is replaced
    by the text with ``<KIND>`` in place of each span (a null text stays null).

    A null text counts as empty (no spans); every row is kept, repeated ones
    included; an existing column with the name of ``spans`` is replaced.
    """
    rest = [c for c in df.columns if c.lower() != spans.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_pii_text"))
    schema = T.StructType(source.schema.fields[:-1]).add(spans, SPANS)
    place = rest.index(text) if text in rest else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder().spans
        for b in parts(batches):
            texts = b.column(len(rest)).to_pylist()
            found = [find(t) if t else [] for t in texts]
            cols = list(b.columns[: len(rest)])
            if redact:
                cols[place] = pa.array([t if not s else redacted(t, s) for t, s in zip(texts, found)], pa.string())
            cols.append(pa.array([[{"kind": k, "start": i, "end": j} for k, i, j in s] for s in found], _ARROW))
            yield pa.RecordBatch.from_arrays(cols, names=[*rest, spans])

    return source.mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, spans: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    s = F.col(spans)
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")
    return df.withColumns(
        {f"n_{k}": count(k) for k in BASE}
        | {"base_sha256": F.sha2(span_text(base), 256), "spans": span_text(s)})
