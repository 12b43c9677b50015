"""Helpers that spell the application's JavaScript semantics in DuckDB SQL.

The oracle is written independently of the Spark code: it reads the same base
tables and computes every answer with DuckDB's own functions (RE2 regexes,
list lambdas, window functions). Only the fixed value lists are shared.
"""

from __future__ import annotations

WS_CHARS = (r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
WS = f"[{WS_CHARS}]"
NWS = f"[^{WS_CHARS}]"


def lit(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = False) -> str:
    """JavaScript regex source -> RE2 source (``\\s`` spelled out, ``$`` -> ``\\z``)."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CHARS if in_class else WS)
            elif nxt == "S":
                out.append(NWS)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    src = "".join(out)
    return ("(?i)" + src) if ignore_case else src


def rx(pattern: str, ignore_case: bool = False) -> str:
    """SQL literal of a translated pattern."""
    return lit(re2(pattern, ignore_case))


def trim_js(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def blank_null(e: str) -> str:
    return f"nullif({trim_js(e)}, '')"


def odistinct(e: str) -> str:
    """Distinct list elements in first-seen order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


def clean_distinct(e: str) -> str:
    inner = f"list_filter(list_transform({e}, lambda x: {trim_js('x')}), lambda x: x <> '')"
    return odistinct(inner)


def join(e: str, sep: str = "; ") -> str:
    return f"array_to_string({e}, {lit(sep)})"


def first_segment(e: str, seps: str = "|\\-–—:·") -> str:
    return trim_js(f"regexp_extract({e}, {lit('^([^' + seps + ']*)')}, 1)")
