"""Secret scan with multipart credential linking.

Base findings (assignments, access ids, long hex strings) are reported wherever
they stand. Weak candidates are not: a user or client id, a short assigned value, a
long mixed token and a URL or host are common in clean texts. They are collected as
intervals with a role (identifier, secret, endpoint), and an interval join within a
scope (a stretch of ``scope`` code points of one text) links them. A weak identifier
or secret is reported only where a secret and an identifier, or a secret and an
endpoint, lie in one scope; an endpoint only together with a reported secret. Base
access ids count as identifiers, base assignments and hex strings as secrets.

The join is a sweep over the sorted intervals of one text, so its cost is linear in
the intervals and no rows are shuffled.

Defined cases: null text counts as empty; repeated rows give repeated results; other
columns of the input pass through untouched (a column with the output name is
replaced); an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
#: Base kinds in the order that breaks ties, then the linked kinds.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
SCOPE = 200


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _one_of(*words: str) -> str:
    return "(?:" + "|".join(map(_either_case, words)) + ")"


_SET = r"""["']?\x20*[:=]\x20*["']?"""
_NAMES = "(?:" + "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                           _either_case("api") + "_?" + _either_case("key")]) + ")"
_ASSIGN = re.compile(rf"{_NAMES}{_SET}([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK_ID = re.compile(rf"\b{_one_of('username', 'user', 'login', 'client_id', 'access_key_id', 'account')}{_SET}"
                      r"([A-Za-z0-9._@-]{3,})")
_WEAK_SECRET = re.compile(rf"\b{_one_of('pwd', 'pass', 'passphrase', 'secret', 'token', 'password', 'passwd', 'auth')}"
                          rf"{_SET}([A-Za-z0-9+/_.=-]{{4,}})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_ENDPOINT = re.compile(rf"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{{1,15}}://[A-Za-z0-9._-]+(?::[0-9]+)?|\b{_one_of('host', 'endpoint', 'server')}{_SET}"
                       r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HINTS = ("password", "passwd", "secret", "token", "api")


def _mixed(token: str) -> bool:
    return (any(c.isdigit() for c in token) and any(c.isupper() for c in token)
            and any(c.islower() for c in token))


def _weak_parts(text: str, low: str, has_id: bool) -> list[tuple[int, int, str]]:
    """Weak intervals of a text; none if no identifier or endpoint could link them.
    The word lists only skip patterns that can't match."""
    has = lambda *words: any(w in low for w in words)
    found = []
    if has("user", "login", "client_id", "access_key_id", "account"):
        found += [(m.start(), m.end(), "weak_id") for m in _WEAK_ID.finditer(text)]
    if has("://", "host", "endpoint", "server"):
        found += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if not found and not has_id:
        return []
    if has("pwd", "pass", "secret", "token", "auth"):
        found += [(m.start(), m.end(), "weak_secret") for m in _WEAK_SECRET.finditer(text)]
    return found + [(m.start(), m.end(), "weak_secret") for m in _TOKEN.finditer(text) if _mixed(m[0])]


class _Cover:
    """Sorted intervals of one role: is one within ``scope`` of a given interval?"""

    def __init__(self, spans: list[tuple[int, int]], scope: int) -> None:
        self.spans, self.scope = sorted(set(spans)), scope
        self.starts = [s for s, _ in self.spans]
        self.ends, top = [], 0                   # running maximum of the ends
        for _, e in self.spans:
            self.ends.append(top := max(top, e))

    def near(self, start: int, end: int) -> bool:
        last = bisect_right(self.starts, end + self.scope) - 1
        return last >= 0 and self.ends[last] >= start - self.scope


def find_spans(text: str, scope: int = SCOPE) -> list[tuple[str, int, int, bool]]:
    """All findings of one text by start, then kind: (kind, start, end, base)."""
    low = text.lower()
    base = []
    if any(h in low for h in _HINTS):            # else no assignment can match
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in _HEX.finditer(text)]
    weak = _weak_parts(text, low, any(k == "access" for k, _, _ in base))
    if weak:
        taken = _Cover([(s, e) for _, s, e in base], 0)

        def free(s: int, e: int) -> bool:        # shares no character with a base finding
            k = bisect_left(taken.starts, e) - 1
            return k < 0 or taken.ends[k] <= s

        weak = [w for w in weak if free(w[0], w[1])]
    if weak:
        strong = {"id": [(s, e) for k, s, e in base if k == "access"],
                  "secret": [(s, e) for k, s, e in base if k != "access"]}
        ids = _Cover(strong["id"] + [w[:2] for w in weak if w[2] == "weak_id"], scope)
        secrets = _Cover(strong["secret"] + [w[:2] for w in weak if w[2] == "weak_secret"], scope)
        ends = _Cover([w[:2] for w in weak if w[2] == "endpoint"], scope)
        linked = []
        for s, e, kind in weak:
            if kind == "weak_secret":
                ok = ids.near(s, e) or ends.near(s, e)
            else:
                ok = secrets.near(s, e)
            if ok:
                linked.append((kind, s, e))
    else:
        linked = []
    out = {(k, s, e, True) for k, s, e in base} | {(k, s, e, False) for k, s, e in linked}
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spans_column(scope: int = SCOPE):
    """Column function: text -> array of (kind, start, end, base)."""
    @F.pandas_udf(SPANS)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"kind": k, "start": s, "end": e, "base": b}
                              for k, s, e, b in find_spans(t or "", scope)] for t in batch], dtype=object)
    return spans


def redact_column(scope: int = SCOPE):
    """Column function: text -> text with every finding replaced by ``[KIND]``."""
    @F.pandas_udf("string")
    def redact(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([None if t is None else redact_text(t, scope) for t in batch], dtype=object)
    return redact


def redact_text(text: str, scope: int = SCOPE) -> str:
    out, at = [], 0
    for kind, s, e, _ in find_spans(text, scope):
        if e <= at:
            continue                             # inside the span before it
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans", scope: int = SCOPE) -> DataFrame:
    """Add ``out``: the findings of each row's whole text."""
    return docs.withColumn(out, spans_column(scope)(F.col(text)))


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
