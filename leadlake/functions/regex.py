"""JavaScript-regex semantics on the JVM regex engine.

The application's patterns are JavaScript regexes. Java's engine differs in a
few places that matter on accented, multi-language text:

* ``\\s``: JavaScript includes NBSP, BOM and the Unicode spaces; Java does not.
  We always write one explicit class (``WS``).
* ``\\b``: on the JDK it is Unicode-aware (``écheap`` has no boundary before
  ``c``); JavaScript's is ASCII. We expand it to ASCII look-arounds.
* ``$``: Java also matches before a final newline; JavaScript does not -> ``\\z``.
* ``String.prototype.trim`` strips the same whitespace set; Spark ``trim``
  strips only U+0020.

``js_regex`` rewrites a JavaScript pattern into an equivalent Java pattern, so
every regex in the library goes through one place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JavaScript's whitespace set, spelled out (usable inside and outside classes).
WS_CHARS = (r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
            r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
WS = f"[{WS_CHARS}]"
NWS = f"[^{WS_CHARS}]"
WORD = "[A-Za-z0-9_]"
NOT_WORD = "[^A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def js_regex(pattern: str, ignore_case: bool = False) -> str:
    """Translate a JavaScript regex source into Java syntax with the same meaning."""
    out = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "s":
                out.append(WS_CHARS if in_class else WS)
            elif nxt == "S":
                out.append(NWS if not in_class else r"\S")
            elif nxt == "w":
                out.append("A-Za-z0-9_" if in_class else WORD)
            elif nxt == "W":
                out.append(NOT_WORD if not in_class else r"\W")
            elif nxt == "d":
                out.append("0-9" if in_class else "[0-9]")
            elif nxt == "b" and not in_class:
                out.append(BOUNDARY)
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
            out.append(ch)
        elif ch == "[":
            in_class = True
            out.append(ch)
            # a leading ']' or '^]' is literal in JS as well
        elif ch == "$":
            out.append(r"\z")
        else:
            out.append(ch)
        i += 1
    src = "".join(out)
    return ("(?i)" + src) if ignore_case else src


def js_trim(col: Column) -> Column:
    """``String.prototype.trim``: strip JavaScript whitespace at both ends."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+\\z", "")


def blank_to_null(col: Column) -> Column:
    """Trimmed string, or null when it is null or blank (the ``str()`` helper).
    ``nullif`` evaluates its argument once (no re-evaluation of the trim regex)."""
    return F.nullif(js_trim(col), F.lit(""))


def first_segment(col: Column, separators: str) -> Column:
    """``s.split(/[seps]/)[0].trim()`` -- text before the first separator, trimmed."""
    cls = "".join("\\" + c if c in "\\^]-[" else c for c in separators)
    return js_trim(F.regexp_extract(col, f"^([^{cls}]*)", 1))


def clean_distinct(arr: Column) -> Column:
    """``[...new Set(arr.map(trim).filter(Boolean))]``."""
    return F.array_distinct(F.filter(F.transform(arr, js_trim), lambda x: x != ""))
