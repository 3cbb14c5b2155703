"""Pieces of DuckDB SQL that several checks share."""


def clean(x: str) -> str:
    """A text on one line, without tags; null if blank. The tables' texts hold no character references."""
    return rf"nullif(trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[\s\p{{Z}}]+', ' ', 'g')), '')"


def any_of(x: str, words) -> str:
    """Whether a text holds one of the words."""
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
