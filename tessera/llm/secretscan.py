"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is analysed once on the driver into a Boolean query over trigrams that any
match must contain, folded to lower case. The index holds, for every trigram that some rule asks for, the
documents containing it, as posting lists cut into blocks of documents; a rule's query intersects and unites
postings block by block, and only its candidates are verified with the regular expression. A rule whose
expression has no mandatory trigram is run over every document.

Scale: postings are made where the text is read. The number of blocks follows the number of documents, so
a trigram that stands in a third of all documents is a third of each block's keys, never one list. Keys
hash the whole row (id and text), so a null or repeated id is no hot key. Candidates meet the texts by
that key once: a broadcast where Spark finds the candidates small enough, else one shuffle of the texts
against few small rows, which AQE may split. Texts are scanned whole, however long.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_keys, saved

#: Keys of one block of the index.
BLOCK_KEYS = 32_768
#: Strings an expression may stand for before its analysis goes on without them.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # what Java's and Python's expressions read alike
    group: int  # the group whose length counts
    least: int  # that length at least, in code points


#: The base rules, in their order; then the rules this operator adds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # The same spans as of [0-9a-f]+ with 16 or more characters: a run is one match either way.
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    Rule("live_key", r"[sr]k_live_[0-9A-Za-z]{16,}", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 35),
)

# --- Boolean trigram queries ------------------------------------------------------------------------

#: A query is True (no constraint), a trigram, ("and", ...) or ("or", ...).
Query = bool | str | tuple


def _and(parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        for q in p[1:] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if q is not True and q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def _or(parts: list[Query]) -> Query:
    if not parts or any(p is True for p in parts):
        return True
    flat: list[Query] = []
    for p in parts:
        for q in p[1:] if isinstance(p, tuple) and p[0] == "or" else [p]:
            if q not in flat:
                flat.append(q)
    terms = {q: frozenset(q[1:]) if isinstance(q, tuple) and q[0] == "and" else frozenset([q]) for q in flat}
    flat = [q for q in flat if not any(terms[o] < terms[q] for o in flat)]  # A or (A and B) is A
    return flat[0] if len(flat) == 1 else ("or", *flat)


def _strings_query(strings: set[str]) -> Query:
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(codes: set[int]) -> set[str] | None:
    """Characters as folded strings; None where folding to ASCII lower case isn't certain to hold."""
    if any(c > 127 for c in codes):
        return None
    return {chr(c).lower() for c in codes}


def _class(items) -> set[str] | None:
    codes: set[int] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            codes.add(arg)
        elif op is rc.RANGE and arg[1] - arg[0] < 128:
            codes.update(range(arg[0], arg[1] + 1))
        else:
            return None
    found = _fold(codes)
    return found if found and len(found) <= 8 else None


def _analyse(parsed) -> tuple[set[str] | None, Query]:
    """(the only strings a match can be, or None; what every match contains) of a parsed expression."""
    found: list[Query] = []
    run: set[str] = {""}
    exact = True

    def end_run():
        nonlocal run, exact
        found.append(_strings_query(run))
        run, exact = {""}, False

    for op, arg in parsed:
        strings, query = None, True
        if op is rc.LITERAL:
            strings = _fold({arg})
        elif op is rc.IN:
            strings = _class(arg)
        elif op is rc.SUBPATTERN:
            strings, query = _analyse(arg[3])
        elif op is rc.BRANCH:
            each = [_analyse(p) for p in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            query = _or([q if s is None else _strings_query(s) for s, q in each])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, body = arg
            inner, inner_query = _analyse(body)
            if inner is not None and high <= 3 and high != rc.MAXREPEAT:
                strings = {"".join(p) for k in range(low, high + 1) for p in product(inner, repeat=k)}
            elif low:
                query = inner_query if inner is None else _strings_query(inner)
        if strings is None or len(run) * len(strings) > MOST_STRINGS:
            end_run()
            if strings is None:
                found.append(query)
            else:
                run = strings if len(strings) <= MOST_STRINGS else {""}
        else:
            run = {a + b for a, b in product(run, strings)}
    if exact:
        return run, _strings_query(run)
    found.append(_strings_query(run))
    return None, _and(found)


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text of any match must contain; True where nothing is mandatory."""
    return _analyse(rp.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*map(trigrams, query[1:])) if isinstance(query, tuple) else set()


# --- index and candidates ---------------------------------------------------------------------------


def document_key() -> Column:
    """A key that is never null; rows that share one are candidates together, which verification sorts out."""
    return row_keys()[0]


def build_index(docs: DataFrame, vocabulary: list[str], blocks: int) -> DataFrame:
    """(block, trigram, keys): for the trigrams of the vocabulary the sorted keys of the documents containing them."""
    if not vocabulary:
        return docs.sparkSession.createDataFrame([], "block int, trigram string, keys array<long>")
    low = F.lower(F.coalesce("text", F.lit("")))
    present = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in vocabulary]))
    rows = docs.select(document_key().alias("key"), low.alias("low")).select("key", F.explode(present).alias("trigram"))
    rows = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    return saved(rows.groupBy("block", "trigram").agg(F.array_sort(F.collect_set("key")).alias("keys")))


def _postings(query: Query) -> Column:
    """The keys that satisfy a query, from the block's map of postings."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("postings", query), F.array().cast("array<long>"))
    combine = F.array_intersect if query[0] == "and" else F.array_union
    # In a conjunction single trigrams come first: lists are cut down before unions are formed.
    parts = sorted(query[1:], key=lambda q: isinstance(q, tuple))
    out = _postings(parts[0])
    for p in parts[1:]:
        out = combine(out, _postings(p))
    return out


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, rules): the rules whose query a document's postings satisfy; rules without a query are not listed."""
    asked = {k: q for k, q in queries.items() if q is not True}
    if not asked:
        return index.sparkSession.createDataFrame([], "key long, rules array<string>")
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))

    def hit(kind: str):
        return lambda k: F.struct(k.alias("key"), F.lit(kind).alias("rule"))

    hits = [F.transform(_postings(q), hit(kind)) for kind, q in asked.items()]
    return by_block.select(F.explode(F.concat(*hits)).alias("h")).groupBy("h.key").agg(F.collect_set("h.rule").alias("rules"))


# --- verification -----------------------------------------------------------------------------------

SPAN = "array<struct<start:bigint,rank:int,end:bigint>>"


def _spans(rule: Rule, rank: int) -> Column:
    """The rule's spans in column body, leftmost and non-overlapping, then those with a long enough group. Offsets come
    from the lengths of the matches and of the text between them; the group is read from the match alone."""
    zipped = F.arrays_zip(F.split("body", rule.pattern, -1).alias("p"), F.regexp_extract_all("body", F.lit(rule.pattern), F.lit(0)).alias("m"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a, x):
        start = a["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))).cast(SPAN)
        value = F.regexp_extract(x["m"], rule.pattern, rule.group) if rule.group else x["m"]
        return F.struct(end.alias("at"), F.when(F.length(value) >= rule.least, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    return F.aggregate(zipped, zero, step, lambda a: a["out"])


def _listed(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """(r, spans): each row of docs as a struct, whatever its columns are called, with all spans (start, rank of the rule,
    end), ordered so, in code points, end exclusive."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    vocabulary = sorted(set().union(*map(trigrams, queries.values())))
    blocks = max(1, -(-docs.count() // BLOCK_KEYS))
    index = build_index(docs.select("doc_id", "text"), vocabulary, blocks)
    chosen = candidates(index, queries)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), document_key().alias("key"))
    joined = packed.join(chosen, "key", "left").withColumn("body", F.coalesce("r.text", F.lit("")))
    none = F.array().cast(SPAN)
    found = []
    for rank, r in enumerate(rules):
        asked = F.array_contains("rules", r.kind) if queries[r.kind] is not True else F.col("body").rlike(r.pattern)
        found.append(F.when(F.coalesce(asked, F.lit(False)), _spans(r, rank)).otherwise(none))
    return joined.select("r", F.array_sort(F.concat(*found)).alias("spans"))


def secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    A null text is empty and has no spans; a very long one is scanned whole. Rows that repeat, or share an id or a null id, keep a row each. Spans of
    different kinds may overlap; equal starts are ordered by kind as listed. Other columns are ignored; an empty table
    gives no rows.
    """
    kinds = [r.kind for r in BASE + added]
    out = with_spans(docs.select("doc_id", "text"), BASE + added)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def of(rank: int):
        return lambda s: s["rank"] == rank

    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return out.select(
        F.col("r.doc_id").alias("doc_id"),
        *counts,
        F.sha2(_listed(base, kinds).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans"), kinds).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )


def masked(docs: DataFrame, mark: str = "[SECRET]", added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """docs with every found span, overlapping ones as one, replaced by a mark and n_chars set to the new length.
    Rows without spans, null and empty texts among them, stay as they are; rows that repeat, or share an id or a null id,
    keep a row each; columns may have any names; an empty table gives no rows."""
    found = with_spans(docs, BASE + added)
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    text = F.col("r.text")

    def step(a, s):
        before = F.substr(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        out = F.when(s["start"] >= a["at"], F.concat(a["out"], before, F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))))
    out = found.select("r", "spans", F.when(F.size("spans") > 0, done).otherwise(text).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast("bigint")).otherwise(F.col("r.n_chars"))
    return out.select(*[new.get(c, F.col(f"r.`{c}`")).alias(c) for c in docs.columns])


def reference_spans(text: str | None, rules: tuple[Rule, ...] = BASE) -> list[tuple[int, int, int]]:
    """The same spans by Python's expressions, for tests."""
    out = []
    for rank, r in enumerate(rules):
        out += [(m.start(), rank, m.end()) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.least]
    return sorted(out)
