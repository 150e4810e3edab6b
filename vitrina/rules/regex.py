"""One portable notation for patterns, turned into the Java dialect Spark runs.

Rule patterns are written with ``\\b``, ``\\w`` and ``\\s`` in their web meaning: ASCII word edges, but every
Unicode blank counts as white space. Java's own ``\\b`` is Unicode-aware and its ``\\s`` is not, so both are
spelled out here.
"""

from __future__ import annotations

from .patterns import FIRST

# --- fixed values: the characters that count as white space ----------------------------------
BLANKS = r"\t\n\x{0b}\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
# --- end of fixed values ---------------------------------------------------------------------

EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _expand(pattern: str, edge: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(BLANKS if in_class else f"[{BLANKS}]")
            i += 2
        elif two == r"\S" and not in_class:
            out.append(f"[^{BLANKS}]")
            i += 2
        elif two == r"\b" and not in_class:
            out.append(edge)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[":
                in_class = True
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def starting(chars: str) -> str:
    """Guard for the front of a pattern: any other ASCII character is passed over by one look into a table.

    Without it each place of a text runs through all alternatives. Characters beyond ASCII are left to the pattern, since some
    of them equal ASCII letters when case is ignored.
    """
    return "(?![" + "".join(f"\\x{c:02x}" for c in range(128) if chr(c).lower() not in chars) + "])"


def java(pattern: str, ignore_case: bool = True) -> str:
    """Pattern for Spark's regex functions."""
    guard = starting(FIRST[pattern]) if pattern in FIRST else ""
    return guard + ("(?iu)" if ignore_case else "") + _expand(pattern, EDGE)


def ansi(pattern: str, ignore_case: bool = True) -> str:
    """Same pattern for an engine with RE2 syntax (used by the SQL checks), as a quoted SQL string."""
    text = ("(?i)" if ignore_case else "") + _expand(pattern, r"\b")
    return "'" + text.replace("'", "''") + "'"
