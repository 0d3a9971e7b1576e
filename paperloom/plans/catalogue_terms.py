"""Terms of the boolean language in SQL."""

from __future__ import annotations


def term_sql(term: str) -> str:
    """A term's pattern for an engine without look-around, tested on a column named body."""
    bare = term.strip().strip('"').lower()
    words = r"[\s-]+".join(bare.rstrip("*").split())
    edge = r"[^\p{L}\p{N}_]"
    tail = "" if bare.endswith("*") else rf"(s|es)?({edge}|$)"
    return rf"regexp_matches(body, '(?i)(^|{edge}){words}{tail}')"
