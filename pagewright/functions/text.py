"""SQL fragments for tokens and characters, all JVM-side.

A fragment is a string over the name of a column or lambda variable. Regular
expressions stay within what both Java and RE2 understand where an oracle needs
them, and use look-around only where the meaning does.
"""

from __future__ import annotations

from pagewright import config as C


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(values) -> str:
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


def char_class(chars: str, negate: bool = False) -> str:
    """A regular-expression class of these characters, as a SQL literal."""
    body = "".join("\\" + c if c in "\\]^-[&" else c for c in chars)
    return quoted(f"[{'^' if negate else ''}{body}]")


def count(text: str, pattern: str) -> str:
    """How often a pattern (a SQL literal) matches."""
    return f"regexp_count({text}, {pattern})"


def letters(text: str) -> str:
    return count(text, r"'\\p{L}'")


def digits(text: str) -> str:
    return count(text, r"'\\p{Nd}'")


def alnum(text: str) -> str:
    return count(text, r"'[\\p{L}\\p{N}]'")


def ratio(a: str, b: str, empty: str = "0D") -> str:
    return f"CASE WHEN {b} = 0 THEN {empty} ELSE {a} / cast({b} AS double) END"


def tokens(text: str) -> str:
    return rf"filter(split(trim({text}), '\\s+'), t -> t <> '')"


def core(word: str) -> str:
    """A word without the punctuation round it."""
    return f"trim(BOTH {quoted(C.STRIP)} FROM {word})"


def strange(text: str) -> str:
    """Symbols that words don't have inside."""
    body = "".join("\\" + c if c in "\\]^-[&" else c for c in C.ALLOWED_INTERNAL)
    return count(text, quoted(rf"[^\p{{L}}\p{{N}}{body}]"))
