"""DuckDB SQL fragments mirroring ``textloom.functions.text`` for the oracles."""

from __future__ import annotations

from textloom.functions import text as T
from textloom.functions.lexicon import stop_words


def lit(s: str) -> str:
    """DuckDB string literal; control characters via chr()."""
    out, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            if buf:
                out.append("'" + buf.replace("'", "''") + "'")
                buf = ""
            out.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not out:
        out.append("'" + buf.replace("'", "''") + "'")
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def replace_chain(expr: str, pairs=T.REPLACEMENT_MAP) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    return expr


def admin(expr: str, tokens=T.ADMIN_LANGUAGE) -> str:
    for a in tokens:
        expr = f"replace({expr}, {lit(a)}, ' ')"
    return expr


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{T.STRIP_PATTERN}', '', 'g')"


def brackets(expr: str) -> str:
    return f"regexp_replace({expr}, '{T.BRACKET_PATTERN}', '', 'g')"


def backslash_s(expr: str) -> str:
    return f"regexp_replace({expr}, '\\\\s+', ' ', 'g')"


def clean_note(expr: str) -> str:
    return backslash_s(f"lower({strip(admin(replace_chain(brackets(expr))))})")


def tokens(expr: str) -> str:
    return f"coalesce(regexp_extract_all({expr}, '{T.TOKEN_PATTERN}'), [])"


def tokens_ws(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{T.WS_RUN}'), lambda x: x <> '')"


def sanitize(expr: str, lower: bool = False) -> str:
    e = strip(f"regexp_replace({expr}, '{T.WS_RUN}', ' ', 'g')")
    return f"lower({e})" if lower else e


def stop_list() -> str:
    return "[" + ", ".join(lit(w) for w in stop_words()) + "]"


def remove_stopwords(tok_expr: str) -> str:
    return (f"list_filter(list_transform({tok_expr}, lambda t: lower(t)), "
            f"lambda t: NOT list_contains({stop_list()}, t) AND instr({lit(T.PUNCTUATION)}, t) = 0)")


def ngrams2(tok_expr: str) -> str:
    return (f"list_concat({tok_expr}, CASE WHEN len({tok_expr}) >= 2 THEN "
            f"list_transform(generate_series(1, len({tok_expr}) - 1), "
            f"lambda i: {tok_expr}[i] || ' ' || {tok_expr}[i + 1]) ELSE [] END)")


def hkey(seed, col: str) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({col} AS VARCHAR)))"


def split_lines(expr: str) -> str:
    """Lines without the trailing empty one; the supplied texts break lines with \\n only."""
    x = f"string_split({expr}, chr(10))"
    return f"(CASE WHEN {x}[-1] = '' THEN {x}[1:len({x}) - 1] ELSE {x} END)"
