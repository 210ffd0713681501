"""Case folding one code point at a time: every character stands for the lowest one of its folding class."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dotted capital and dotless small i have no simple folding.
_ALONE = {0x130, 0x131}


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """{character: lowest member of its class} for the characters that change; classes come from the one-character
    upper and lower case mappings."""
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or code in _ALONE:
            continue
        c = chr(code)
        for other in (c.lower(), c.upper()):
            if len(other) == 1 and other != c and ord(other) not in _ALONE:
                a, b = find(c), find(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return {c: find(c) for c in parent if find(c) != c}


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str]:
    items = sorted(classes().items())
    return "".join(c for c, _ in items), "".join(t for _, t in items)


def fold_text(s: str) -> str:
    return s.translate(_python_table())


@lru_cache(maxsize=1)
def _python_table() -> dict[int, str]:
    return {ord(c): t for c, t in classes().items()}


def fold(column: Column) -> Column:
    """The folded column, by translate: stays in the JVM."""
    source, target = _tables()
    return F.translate(column, source, target)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased one code point at a time, and for every boundary between a lower and an
    upper case letter the run's whole prefix and whole suffix as well."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))

    def forms(w: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(2)).rlike(r"^\p{Ll}\p{Lu}$"))
        parts = F.flatten(F.transform(cuts, lambda i: F.array(F.substr(w, F.lit(1), i), F.substr(w, i + 1))))
        return F.when(w.rlike(r"\p{Ll}\p{Lu}"), F.concat(F.array(w), parts)).otherwise(F.array(w))

    # A final capital sigma lower-cases by context in the JVM; one code point at a time it is always σ.
    return F.transform(F.flatten(F.transform(runs, forms)), lambda t: F.lower(F.translate(t, "Σ", "σ")))
