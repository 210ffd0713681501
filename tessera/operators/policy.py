"""What may be captured: sensitive names, suspicious content, ignore rules, portable paths, languages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folding import basename

# Extensions, directories and words that make a path sensitive.
SENSITIVE_EXTENSIONS = ["pem", "key", "p12", "pfx", "crt", "cer", "cert", "csr", "der", "p7b", "p7c", "p8", "keystore", "jks", "kdbx", "sqlite", "sqlite3", "db"]
SENSITIVE_DIRECTORIES = [".ssh", ".aws", ".azure", ".gnupg"]
SENSITIVE_WORDS = ["credential", "secret", "private_key", "private-key", "id_rsa", "id_ed25519", "id_ecdsa", ".netrc", ".npmrc", ".pypirc", ".git-credentials", "token"]
# Patterns of content that must not be captured.
SUSPICIOUS = [
    r"-----BEGIN (?:[A-Z ]*PRIVATE KEY(?: BLOCK)?|CERTIFICATE)-----",
    r"""(?i)(?:password|passwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|bearer|credential)["']?\s*[=:]\s*["']?[^\s"'{}$][^\r\n]{3,}""",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b|\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{12,}\b|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|https?)://[^\s/@:]+:[^\s/@]+@",
]
# Languages by extension.
LANGUAGES = {
    "go": ["go"], "typescript": ["ts", "tsx", "mts", "cts"], "javascript": ["js", "jsx", "mjs", "cjs"], "python": ["py"], "rust": ["rs"], "java": ["java"],
    "csharp": ["cs"], "c": ["c", "h"], "cpp": ["cpp", "hpp", "cc", "cxx", "hxx", "hh"], "markdown": ["md"],
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    out = F.lit("text")
    for name, exts in LANGUAGES.items():
        out = F.when(extension(path).isin(exts), name).otherwise(out)
    return out


def sensitive_path(path: Column) -> Column:
    low = F.lower(path)
    words = reduce(lambda a, b: a | b, [F.contains(basename(low), F.lit(w)) for w in SENSITIVE_WORDS])
    return extension(path).isin(SENSITIVE_EXTENSIONS) | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, SENSITIVE_DIRECTORIES))) | words


def suspicious(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in SUSPICIOUS])


def portable_path(path: Column) -> Column:
    """A clean relative path that every platform can hold."""
    names = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"
    return F.coalesce(
        (F.length(path) > 0) & ~path.rlike(r'^/|/$|//|[\\:\x00-\x1f<>"|?*]|(^|/)\.{1,2}(/|$)|[. ](/|$)|(^|/)\s*(/|$)') & ~path.rlike(names), F.lit(False)
    )


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression, keeps) of each rule of an ignore file, in order."""
    out = []
    for line in text.split("\n"):
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        keeps = p.startswith("!")
        p = p[keeps:]
        if not p or re.search(r"[\\\[\]\x00]", p):
            raise ValueError(f"unsupported pattern {line!r}")
        rooted = p.startswith("/")
        p = p.removeprefix("/")
        folder = p.endswith("/")
        p = p.removesuffix("/")
        body = re.sub(r"\*\*/|\*\*|\*|\?|[^*?]+", lambda m: {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(m[0]) or re.escape(m[0]), p)
        out.append((("^" if rooted or "/" in p else "(?:^|/)") + body + ("/.*$" if folder else "(?:/.*)?$"), keeps))
    return out


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for pattern, keeps in rules:
        out = F.when(path.rlike(pattern), F.lit(not keeps)).otherwise(out)
    return out


def exclusion(path: Column, content: Column, size: Column, rules: list[tuple[str, bool]] = (), max_bytes: int = 2 << 20) -> Column:
    """Why a file isn't captured, the first reason that applies; null for a file that is."""
    return (
        F.when(~portable_path(path), "unsafe_path")
        .when(path.rlike(r"(^|/)\.git(/|$)"), "git")
        .when(ignored(path, list(rules)), "ignored")
        .when(sensitive_path(path), "sensitive_name")
        .when(size > max_bytes, "oversize")
        .when(F.contains(content, F.char(F.lit(0))), "binary")
        .when(suspicious(content), "secret")
    )


def revalidated(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """(path, problem) of a captured snapshot's files (path, content, size, language, blob_id) that a publisher must refuse,
    the first reason of each: paths that are unsafe, repeated, sensitive or in a hidden store; configuration files; sizes,
    content, language or digest that are not what the file says."""
    from .projects import config_kind

    low = F.col("path")
    n = files.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length(F.coalesce("content", F.lit("")))
    problem = (
        F.when(~portable_path(low), "unsafe_path").when(F.col("n") > 1, "repeated").when(sensitive_path(low), "sensitive_name").when(config_kind(low) != "", "config").when(low.rlike(r"^\.git/"), "git")
        .when((size > max_bytes) | (F.col("size") != size), "size").when(F.contains(F.col("content"), F.char(F.lit(0))), "binary").when(suspicious(F.col("content")), "secret")
        .when(F.col("language") != language(low), "language").when(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256) != F.col("blob_id"), "digest")
    )
    return files.join(n, "path").select("path", problem.alias("problem")).filter("problem is not null").distinct()
