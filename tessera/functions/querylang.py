"""The boolean search language: text → tree → Column.

expression := and (OR and)*; and := unary ([AND] unary)*; unary := NOT unary | '(' expression ')' | [field:] term,
where a term is a bare word, a quoted string, or /a regular expression/.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folding import basename, fold, fold_text

FIELDS = {"content", "project", "repo", "file", "lang", "path", "symbol", "kind", "test", "generated"}
#: Fields searched by substring; the others are compared as a whole.
PARTIAL = {"content", "path", "file", "symbol"}
MAX_QUERY_BYTES = 64 * 1024
_ESCAPES = {"\\": "\\", '"': '"', "'": "'", "n": "\n", "r": "\r", "t": "\t"}


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Term:
    field: str
    value: str
    mode: str  # word, quoted or regex


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, value) pairs; kinds: '(', ')', field, word, quoted, regex."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c in "\"'":
            i, value = _quoted(text, i)
            out.append(("quoted", value))
        elif c == "/":
            i, value = _regex(text, i)
            out.append(("regex", value))
        else:
            m = re.compile(r"[^\s()\"'/:]+|.").match(text, i)
            word, i = m.group(), m.end()
            if i < len(text) and text[i] == ":" and re.fullmatch(r"[A-Za-z_]+", word):
                out.append(("field", word.lower()))
                i += 1
                continue
            while i < len(text) and not text[i].isspace() and text[i] not in "()\"'":
                word += text[i]
                i += 1
            if i < len(text) and text[i] in "\"'":
                raise QueryError("a quote inside a word")
            out.append(("word", word))
    return out


def _ended(text: str, i: int) -> int:
    if i < len(text) and not text[i].isspace() and text[i] not in "()":
        raise QueryError("text directly after a closing quote or slash")
    return i


def _quoted(text: str, i: int) -> tuple[int, str]:
    quote, out, i = text[i], [], i + 1
    while i < len(text):
        c = text[i]
        if c == quote:
            return _ended(text, i + 1), "".join(out)
        if c == "\\":
            i += 1
            if i >= len(text) or text[i] not in _ESCAPES:
                raise QueryError("unknown escape")
            c = _ESCAPES[text[i]]
        out.append(c)
        i += 1
    raise QueryError("a quote is not closed")


def _regex(text: str, i: int) -> tuple[int, str]:
    out, i = [], i + 1
    while i < len(text):
        if text[i] == "/":
            return _ended(text, i + 1), "".join(out)
        if text[i] == "\\" and i + 1 < len(text):
            out.append("/" if text[i + 1] == "/" else text[i : i + 2])
            i += 2
            continue
        out.append(text[i])
        i += 1
    raise QueryError("a regular expression is not closed")


def parse(text: str, max_bytes: int = MAX_QUERY_BYTES):
    if len(text.encode()) > max_bytes:
        raise QueryError("query too long")
    items, at = lex(text), 0

    def peek():
        return items[at] if at < len(items) else (None, None)

    def is_op(name):
        return peek() == ("word", name)

    def either():
        nonlocal at
        left = both()
        while is_op("OR"):
            at += 1
            left = Or(left, both())
        return left

    def both():
        nonlocal at
        left = unary()
        while peek()[0] is not None and peek()[0] != ")" and not is_op("OR"):
            if is_op("AND"):
                at += 1
            left = And(left, unary())
        return left

    def unary():
        nonlocal at
        kind, value = peek()
        if kind is None or kind == ")" or is_op("AND") or is_op("OR"):
            raise QueryError("a term is missing")
        at += 1
        if (kind, value) == ("word", "NOT"):
            return Not(unary())
        if kind == "(":
            inner = either()
            if peek()[0] != ")":
                raise QueryError("a parenthesis is not closed")
            at += 1
            return inner
        field = "content"
        if kind == "field":
            field = value
            if field not in FIELDS:
                raise QueryError(f"unknown field {field}")
            kind, value = peek()
            if kind not in ("word", "quoted", "regex"):
                raise QueryError("a field has no value")
            at += 1
        if not value:
            raise QueryError("an empty term")
        if field in ("test", "generated") and value.lower() not in ("true", "false"):
            raise QueryError("a boolean field takes true or false")
        if kind == "regex":
            check_regex(value)
        return Term(field, value, kind)

    tree = either()
    if at != len(items):
        raise QueryError("unexpected text")
    return tree


def check_regex(pattern: str) -> None:
    """Only what a linear-time matcher has: no look-around, no back-references, no possessive or atomic groups."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!>]|<[=!])", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or re.search(r"[*+?}]\+", pattern):
        raise QueryError("unsupported regular expression")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(str(e)) from e


def java_regex(pattern: str, case_sensitive: bool) -> str:
    """The pattern for the JVM: line ends are \\n only, and a final $ is the end of the text."""
    if re.search(r"(?<!\\)(?:\\\\)*\$$", pattern):
        pattern = pattern[:-1] + r"\z"
    return ("(?d)" if case_sensitive else "(?iud)") + pattern


def predicate(tree, case_sensitive: bool = False, mode: str | None = None) -> Column:
    """The truth of a tree for a row of the file schema. mode: exact or regex for all content terms; by default
    substring, whole value for the fields that name things, and regex for /…/."""
    if isinstance(tree, Not):
        return ~predicate(tree.of, case_sensitive, mode)
    if isinstance(tree, And):
        return predicate(tree.left, case_sensitive, mode) & predicate(tree.right, case_sensitive, mode)
    if isinstance(tree, Or):
        return predicate(tree.left, case_sensitive, mode) | predicate(tree.right, case_sensitive, mode)
    t, how = tree, "regex" if tree.mode == "regex" else mode if mode and tree.field in PARTIAL else "part" if tree.field in PARTIAL else "exact"

    def test(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        if how == "regex":
            return c.rlike(java_regex(t.value, case_sensitive))
        f, v = (c, t.value) if case_sensitive else (fold(c), fold_text(t.value))
        return f == v if how == "exact" else F.contains(f, F.lit(v))

    if t.field in ("test", "generated"):
        return F.col(t.field) == (t.value.lower() == "true")
    if t.field == "project":
        return F.exists("project_ids", test)
    if t.field in ("symbol", "kind"):
        part = "name" if t.field == "symbol" else "kind"
        return F.exists("symbols", lambda s: test(s[part]))
    simple = {"content": F.col("content"), "path": F.col("path"), "file": basename(F.col("path")), "repo": F.col("repository_id"), "lang": F.col("language")}
    return test(simple[t.field])


def content_terms(tree) -> list[Term]:
    if isinstance(tree, Term):
        return [tree] if tree.field == "content" else []
    if isinstance(tree, Not):
        return []
    return content_terms(tree.left) + content_terms(tree.right)
