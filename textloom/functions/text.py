"""Row-local string operators as ``Column -> Column`` functions.

Every function here is a built-in Spark expression (regexp / replace /
higher-order array functions), so a chain of them fuses into one
whole-stage-codegen projection with no Python on the hot path.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's defaults for equal results.
# ---------------------------------------------------------------------------

# Ordered literal replacements applied to report text (original, replacement).
REPLACEMENT_MAP: list[tuple[str, str]] = [
    ("\n", " "),
    ("\r\n\r", " "),
    ("\r", " "),
    ("\t", " "),
    ("w/", "with"),
    ("_", " "),
    ("*", " "),
    ("  ", " "),
    ('"', ""),
    ("-", " "),
    ("pt", "patient"),
]

# Administrative phrases replaced by a space (case-sensitive), in this order.
ADMIN_LANGUAGE: list[str] = [
    "FINAL REPORT",
    "Date/Time",
    "Phone",
    "Date of Birth",
    "DoB",
    "Completed by",
    "Dictated by",
    "name of assessor:",
    "assessed by",
    "private and confidential",
    "\t",
]

# Python's string.punctuation (tokens that are a substring of it are dropped).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# HTML / escape sequences that become a newline, in this order (after lower-casing).
HTML_NEWLINES: list[str] = ["<br />", "<br>", "\\n", "&#xd;"]

# ---------------------------------------------------------------------------
# Regex building blocks. Written so the same pattern text is valid in Java
# regex (Spark) and RE2 (DuckDB oracle): no look-around, \x{...} escapes.
# ---------------------------------------------------------------------------

# Characters Python's str.isspace() accepts (str.strip()/str.split() use them).
WS_CLASS = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS_RUN = f"[{WS_CLASS}]+"
STRIP_PATTERN = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
WORD_CHARS = r"\p{L}\p{N}_"
TOKEN_PATTERN = f"[{WORD_CHARS}]+|[^{WORD_CHARS}{WS_CLASS}]"
BRACKET_PATTERN = r"\[.*?\]"
# Python line boundaries used by str.splitlines().
LINE_BREAK_PATTERN = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_brackets(c) -> Column:
    """Remove ``[...]`` spans, non-greedy; like Python ``.``, only ``\\n`` stops a span."""
    return F.regexp_replace(_col(c), "(?d)" + BRACKET_PATTERN, "")


def replace_chain(c, pairs: Sequence[tuple[str, str]] = REPLACEMENT_MAP) -> Column:
    """Ordered literal replacements folded into one nested expression."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


def remove_admin(c, tokens: Iterable[str] = ADMIN_LANGUAGE) -> Column:
    """Replace administrative phrases by a space, case-sensitive, in order."""
    return reduce(lambda acc, t: F.replace(acc, F.lit(t), F.lit(" ")), tokens, _col(c))


# The same white-space set as single characters, for a character-set trim.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Strip Unicode white space (Python ``str.strip()``) from both ends
    (``btrim`` with a character set: a scan, no regex)."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def strip_lower(c) -> Column:
    return F.lower(strip_ws(c))


def backslash_s(c, collapse_ws: bool = False) -> Column:
    """Strict mode reproduces ``re.sub(r"\\\\s+", " ", x)``: a literal backslash
    followed by ``s`` characters becomes a space. ``collapse_ws`` gives the intent
    (collapse white-space runs)."""
    if collapse_ws:
        return F.regexp_replace(_col(c), WS_RUN, " ")
    return F.regexp_replace(_col(c), r"\\s+", " ")


def clean_note(c, remove_brackets: bool = True,
               replacement_map: Sequence[tuple[str, str]] = REPLACEMENT_MAP,
               admin_language: Iterable[str] | None = ADMIN_LANGUAGE,
               collapse_ws: bool = False) -> Column:
    """The whole report cleaner: brackets, replacement chain, admin phrases,
    strip + lower, then the backslash-s rule. Null stays null."""
    out = _col(c)
    if remove_brackets:
        out = strip_brackets(out)
    out = replace_chain(out, replacement_map)
    if admin_language is not None:
        out = remove_admin(out, admin_language)
    out = strip_lower(out)
    return backslash_s(out, collapse_ws)


def alpha_only(c) -> Column:
    """Squash every run outside ``A-Za-z'`` to one space, then lower."""
    return F.lower(F.regexp_replace(_col(c), "[^A-Za-z']+", " "))


def alpha_words(c) -> Column:
    """The words that ``alpha_only`` leaves, in their own case: found in the text, which is many
    times faster than a replacement of all that lies between them."""
    return F.regexp_extract_all(_col(c), F.lit("[A-Za-z']++"), 0)


def html_newlines(c) -> Column:
    """Lower, then HTML breaks / escaped newlines to ``\\n``; null gives ''."""
    out = F.lower(_col(c))
    out = reduce(lambda acc, s: F.replace(acc, F.lit(s), F.lit("\n")), HTML_NEWLINES, out)
    return F.coalesce(out, F.lit(""))


def sanitize(c, lowercase: bool = False) -> Column:
    """Trim and collapse all white space to one space; optional lower."""
    out = strip_ws(F.regexp_replace(_col(c), WS_RUN, " "))
    return F.lower(out) if lowercase else out


def char_chunks(c, k: int) -> Column:
    """Fixed-size character chunks of a string, as an array (one regex pass)."""
    return F.regexp_extract_all(_col(c), F.lit("(?s).{1,%d}" % k), 0)


def split_lines(c) -> Column:
    """``str.splitlines()``: split on Python line boundaries, no trailing empty line."""
    parts = F.split(_col(c), LINE_BREAK_PATTERN)
    return F.when(F.size(parts) > 0, F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts))


def tokenize_ws(c) -> Column:
    """``text.split()``: white-space tokens, empties removed."""
    return F.filter(F.split(_col(c), WS_RUN), lambda x: x != "")


def tokenize_words(c, word_limit: int | None = None, lower: bool = False) -> Column:
    """Word tokens with punctuation split off (one token per punctuation char)."""
    s = F.lower(_col(c)) if lower else _col(c)
    toks = F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), 0)
    toks = F.coalesce(toks, F.array().cast("array<string>"))
    return F.slice(toks, 1, word_limit) if word_limit else toks


def remove_stopwords(tokens, stop_words: Sequence[str], punctuation: str = PUNCTUATION) -> Column:
    """Lower tokens, drop stop words and any token that is a substring of the
    punctuation string (so ``()`` goes too)."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(F.transform(_col(tokens), lambda t: F.lower(t)),
                    lambda t: (~F.array_contains(stop, t)) & (F.instr(F.lit(punctuation), t) == 0))


def ngrams(tokens, n_max: int = 2) -> Column:
    """1..n_max word n-grams, joined by a space, in order of n then position.

    Built from shifted slices with ``zip_with`` so no lambda captures the
    token expression (a captured expression is re-evaluated per element)."""
    toks = _col(tokens)
    out = toks
    for n in range(2, n_max + 1):
        width = F.greatest(F.size(toks) - n + 1, F.lit(0))
        grams = F.slice(toks, 1, width)
        for k in range(2, n + 1):
            grams = F.zip_with(grams, F.slice(toks, k, width), lambda a, b: F.concat_ws(" ", a, b))
        out = F.concat(out, F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return out


def pad_truncate(arr, length: int, pad: int = 0) -> Column:
    """Truncate to ``length`` and right-pad with ``pad``."""
    a = F.slice(_col(arr), 1, length)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def token_labels(token, sent_id) -> Column:
    """``token_sentenceNo`` label of a token occurrence."""
    return F.concat_ws("_", _col(token), _col(sent_id).cast("string"))


def strip_special(mask) -> Column:
    """Zero the first and last (special-token) positions of an attention mask."""
    m = _col(mask)
    return F.when(F.size(m) <= 2, F.array_repeat(F.lit(0), F.size(m))).otherwise(
        F.concat(F.array(F.lit(0)), F.slice(m, 2, F.size(m) - 2), F.array(F.lit(0))))


def format_prediction(category, probability) -> Column:
    """``Category: c, Probability: p%`` with p = probability x 100, 2 decimals."""
    return F.format_string("Category: %s, Probability: %.2f%%", _col(category),
                           (_col(probability) * 100).cast("double"))
