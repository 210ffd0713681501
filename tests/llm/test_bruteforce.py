"""Operators against brute force on small tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tessera.llm import boosting, compression, editcount, iblt, katz, packing, positional, queries, rans, secretscan, simhash, tokens
from tessera.llm.common import LOWER


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


# --- 1 secrets


def test_trigram_queries():
    assert secretscan.trigram_query(r"[0-9a-f]{16,}") is True
    assert secretscan.trigram_query(r"AKIA[A-Z0-9]+") == ("and", "aki", "kia")
    assert secretscan.trigram_query(r"(?:foo|bar)x*") == ("or", "bar", "foo")
    assert secretscan.trigram_query(r"(?:foo|b)x") is True
    assert secretscan.trigram_query(r"(?:abcd)+") == ("and", "abc", "bcd")
    assert secretscan.trigram_query(r"(?:abcd)*") is True


SECRETS = [
    "token=secret: abcdefghijkl", "password=PASSWORD=abcdefghijklm", "api_key: 'abcdefghijkl'", "ApiKey=short", "AKIAABCDEFGHIJKLMN AKIAXAKIA", "é deadbeefdeadbeef0 \U0001f600 deadbeefdeadbeef",
    "token==abcdefghijkl token:  \"x/y+z=abcdefgh", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "nothing", "", None, "secret='" + "0123456789abcdef" * 3, "xoxb-1234567890ab AIza" + "b" * 35,
]


def test_secrets(prepared, small):
    rows = [(k, t) for k, t in enumerate(SECRETS)] + [(1000 + i, t) for i, t in texts(small).items()]
    got = {r["doc_id"]: r for r in secretscan.secrets(prepared.createDataFrame(rows, "doc_id long, text string")).collect()}
    kinds = [r.kind for r in secretscan.BASE + secretscan.ADDED]
    for i, t in rows:
        base = secretscan.reference_spans(t)
        every = secretscan.reference_spans(t, secretscan.BASE + secretscan.ADDED)
        show = lambda spans: ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in spans)
        assert got[i]["spans"] == show(every), t
        assert got[i]["base_sha256"] == hashlib.sha256(show(base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in kinds[:3]] == [sum(s[1] == n for s in base) for n in range(3)]


def test_every_match_satisfies_its_query(prepared):
    def holds(query, text):
        if query is True:
            return True
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(q, text) for q in query[1:])

    for rule in secretscan.BASE + secretscan.ADDED:
        for t in SECRETS:
            for m in re.finditer(rule.pattern, t or ""):
                assert holds(secretscan.trigram_query(rule.pattern), m.group().lower())


# --- 2, 4 classifiers


def labelled(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    return d, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxicity_on_held_out_rows(prepared):
    d, l = labelled(prepared)
    got = compression.toxicity(d, l).join(l, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    tally = Counter((r["predicted"], r["toxic"]) for r in got)
    assert tally[1, 0] <= 0.01 * (tally[0, 0] + tally[1, 0])  # clean documents are left alone
    assert tally[1, 1] >= 0.4 * (tally[0, 1] + tally[1, 1])


def test_quality_on_held_out_rows(prepared):
    d, l = labelled(prepared)
    got = boosting.quality(d, l).join(l, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.98 * len(got)


def test_forest_arrays_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    f = boosting.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float), trees=10)

    def walk(row):
        out = f.base
        for at in f.roots:
            while f.left[at] != at:
                at = f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at]
            out += f.value[at]
        return out

    assert np.allclose(f.raw(x), [walk(r) for r in x])


# --- 3 language model


def brute_katz(rows, order):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]

    def grams(ws, k):
        """(context, word) of each token that has k - 1 words before it, the start among them."""
        line = ["\t", *ws] if k > 1 else ws
        return [(tuple(line[i - k + 1 : i]), line[i]) for i in range(k - 1, len(line))]

    train = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {k: Counter(g for ws in train for g in grams(ws, k)) for k in range(1, order + 1)}
    uni = Counter({w: c for (_, w), c in seen[1].items()})
    total, types = sum(uni.values()), len(uni)
    tally = lambda c: [sum(1 for x in c.values() if x == r) for r in range(1, 7)]
    low, d = katz.Unigrams(tally(uni), total), {k: katz.discounts(tally(seen[k])) for k in range(2, order + 1)}
    after = {k: defaultdict(list) for k in range(2, order + 1)}
    for k in after:
        for (h, w), c in seen[k].items():
            after[k][h].append((w, c))
    weight = {}

    def p(h, w):
        if not h:
            return float(low.probability(np.array([uni[w]]))[0])
        k = len(h) + 1
        c = seen[k].get((h, w), 0)
        if not c:
            return weight.get(h, (1,))[0] * p(h[1:], w)
        return (d[k][c - 1] if c <= 5 else 1) * c / weight[h][1]

    for k in after:
        for h, found in after[k].items():
            div, freed = sum(c for _, c in found), sum((1 - d[k][c - 1]) * c for _, c in found if c <= 5)
            if freed <= 1e-9:
                div, freed = div + 1, 1
            weight[h] = freed / div / (1 - sum(p(h[1:], w) for w, _ in found)), div
        for h in list(after[k])[:10]:
            assert sum(p(h, w) for w in [*uni, "never seen"]) == pytest.approx(1)
    assert sum(p((), w) for w in uni) + low.unknown == pytest.approx(1)
    out = {}
    for i, t in rows:
        ws = words(t)
        line = ["\t", *ws]
        logs = sum(math.log10(p(tuple(line[max(0, j - order + 1) : j]), line[j])) for j in range(1, len(line)))
        out[i] = (len(ws), sum(uni[w] > 0 for w in ws), total, sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws), logs)
    return out


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 4000, "bucket_words": 900, "bucket_grams": 3000, "hot": 60}])
def test_katz(small, order, sizes):
    want = brute_katz(sorted(texts(small).items()), order)
    for r in katz.scored(small, order, **sizes).collect():
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def test_katz_sends_no_lone_grams(small):
    """Grams after words that one block alone has stay there, and blocks are read where they lie."""
    docs = small.select("doc_id", F.lit(True).alias("train"), "text")
    one = katz.Model(docs, 3)
    assert {r["kind"] for r in one.answers.select("kind").distinct().collect()} <= {2, 6, 16}
    cut = katz.Model(docs, 3, block_tokens=4000, bucket_grams=3000)
    sent = [r["c"] for r in cut.answers.filter("kind = 15").collect()]
    blocks = [katz._get(r["a"])[0] for r in cut.blocks.collect()]
    assert len(blocks) > 1 and 0 < sum(len(katz._get(c)[0]) for c in sent) < sum(map(len, blocks)) / 2
    plan = one.scores()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_katz_sends_no_words_of_grams_alone_by_their_end(small):
    """Of a gram that one block alone can have only counts are sent, and no answer comes back; what weights need is whole numbers."""
    m = katz.Model(small.select("doc_id", F.lit(True).alias("train"), "text"), 3, block_tokens=4000, bucket_grams=3000)
    for k in (2, 3):
        sent = m._per_block(katz._send_grams(m.plan, k)).filter("kind = 0").collect()
        grams, named, lone = ([f(r) for r in sent] for f in (lambda r: katz._get(r["a"])[1].sum(), lambda r: len(katz._get(r["b"])[1]), lambda r: len(katz._get(r["c"])[2])))
        assert sum(grams) == sum(named) + sum(lone) and sum(lone) > 0
        back = m.answers.filter(f"kind = {katz._answer(k)}").collect()
        assert sum(8 * len(katz._get(r["c"])[1]) for r in back) < sum(named) + 8 * len(back)
    needs = m.answers.filter("kind in (6, 16)").collect()
    assert needs and all(x.dtype.kind == "u" for r in needs for x in katz._get(r["c"]))


def test_katz_words():
    """Words of odd texts, against Python's own splitting."""
    kinds = [*map(chr, range(40)), *"AZz", "Ä", "\u3000", "\xa0", "\x85", "日", "\U0001f600", "", " ", " ", "\n"]
    rng = random.Random(1)
    rows = ["".join(rng.choices(kinds, k=rng.randrange(30))) for _ in range(3000)] + [None, "", " \n ", "\x00"]
    lists, sizes = katz._words(pa.array(rows))
    for text, got, n in zip(rows, lists.to_pylist(), sizes.tolist()):
        want = (text or "").encode().translate(LOWER).split()
        assert n == len(want) and (got == [w.decode() for w in want] or got == [""] and not want)


# --- 5 sketches


CUT = re.compile(rf"[^\n]{{{iblt.PARAGRAPH},{4 * iblt.PARAGRAPH}}}?[.!?](?=\s|$)|[^\n]{{{iblt.PARAGRAPH}}}[^\n ]*|[^\n]+")


def digests(text):
    return {xxhash.xxh64_intdigest(p.encode(), 42) for p in CUT.findall(text) if p.strip(" ")}


def brute_cells(keys, width, salt):
    """Count, XOR and check of each cell; hashes of (key, number) as the engine chains them."""
    chained = lambda k, n: xxhash.xxh64_intdigest(n.to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42))
    cells = [[0, 0, 0] for _ in range(3 * width)]
    bits = width.bit_length() - 1
    for k in keys:
        for row in range(3):
            c = cells[row * width + (chained(k, salt) >> row * bits) % width]
            c[0], c[1], c[2] = c[0] + 1, c[1] ^ k, c[2] ^ chained(k, 7)
    return cells


def check_fingerprints(order, got):
    """order: (id, text) as documents follow each other, got: rows in the same order."""
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    show = lambda keys: ",".join(sorted(f"{k:016x}" for k in keys))
    prints = defaultdict(set)
    for k, ((i, text), r) in enumerate(zip(order, got)):
        after = order[(k + 1) % len(order)][1]
        f = len(text) // 3
        edited = text[: len(text) - f] + after[:f]
        own, ed, nx = digests(text), digests(edited), digests(after)
        assert r["doc_id"] == i
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["near_edited"] == pytest.approx(like(own, ed)) and r["near_next"] == pytest.approx(like(own, nx))
        assert r["differing_edited"] == len(own ^ ed) and r["differing_next"] == len(own ^ nx)
        assert (r["removed"], r["added"]) == (show(own - ed), show(ed - own))
        packed = b"".join(n.to_bytes(4, "big") + x.to_bytes(8, "big") + c.to_bytes(8, "big") for n, x, c in brute_cells(own, iblt.WIDTH, 3))
        assert base64.b64decode(r["fingerprint"]) == packed
        prints[text].add(r["fingerprint"])
        prints[edited].add(r["edited_fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints(small):
    got = {r["doc_id"]: r for r in iblt.fingerprints(small).collect()}
    order = sorted(texts(small).items(), reverse=True)
    check_fingerprints(order, [got[i] for i, _ in order])


@pytest.mark.parametrize("range_rows", [250_000, 10])
def test_fingerprints_of_hot_and_null_ids(prepared, range_rows, monkeypatch):
    """Two thirds of all rows share an id or have none; ranges of few rows."""
    kept = iblt.with_next
    monkeypatch.setattr(iblt, "with_next", lambda d: kept(d, range_rows))
    text = lambda k: f"text {k}. " + "It goes on for a while, and on, and on, as it does. " * (k % 5)
    rows = [(7 if k % 3 == 0 else None if k % 3 == 1 else k, text(k)) for k in range(240)]
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -signed(r[1])))
    out = iblt.fingerprints(prepared.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    sha = {(r["doc_id"], r["edited_sha256"]) for r in out}
    for k, (i, t) in enumerate(order):
        f = len(t) // 3
        assert (i, hashlib.sha256((t[: len(t) - f] + order[(k + 1) % len(order)][1][:f]).encode()).hexdigest()) in sha


def test_small_sketches_retry(prepared):
    """Parts of far more digests than they are meant for peel in a later, wider sketch."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-(1 << 62), 1 << 62, n).tolist() for n in (60, 45))
    d = prepared.createDataFrame([(a + b[:20], b)], "a array<long>, b array<long>").withColumn("p", F.struct("a", "b"))
    r = d.select(F.expr(iblt._part_difference("p")).alias("r")).first()["r"]
    assert r["ok"] and sorted(r["a"]) == sorted(a) and sorted(r["b"]) == sorted(b[20:])


# --- 6 token files


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=3000), st.integers(1, 8))
def test_rans_round_trip(ids, every):
    a = np.array(ids, np.uint32)
    freq = rans.frequencies(np.bincount(a))
    assert freq.sum() == 1 << rans.BITS
    block, table = rans.encode_block(a, freq, lanes=4, every=every), rans.open_table(rans.pack_table(freq))
    assert (rans.decode_block(block, table) == a).all()
    for k, (step, _, _) in enumerate(rans.checkpoints(block)):
        assert (rans.decode_block(block, table, k) == a[step * block["lanes"] :]).all()
    if len(block["stream"]) >= 4:
        broken = block | {"stream": bytes([block["stream"][0] ^ 1]) + block["stream"][1:]}
        with pytest.raises((ValueError, IndexError)):
            rans.decode_block(broken, table)


def whole(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_token_files(small):
    encode, start = whole(tokens.BYTE_BPE), 0
    got = {r["doc_id"]: r for r in rans.encoded(small).collect()}
    for i, t in sorted(texts(small).items()):
        ids = np.array([*encode(t), 2], "<u4")
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab cD.,!\n\t  éñß'’01-_<|>́İΣ日\x1c\xa0")), max_size=20))
def test_word_tables_are_exact(text):
    for name in (tokens.BYTE_BPE, tokens.WORD_BPE):
        assert tokens.encoder(tokens.default_path(name)).ids(text).tolist() == whole_cached(name)(text)


@lru_cache(maxsize=None)
def whole_cached(name):
    return whole(name)


def test_special_tokens_and_a_full_table():
    for name in (tokens.BYTE_BPE, tokens.WORD_BPE):
        e = tokens.Encoder(tokens.default_path(name), table_bytes=600)
        for t in ("x <|endoftext|> y", "a<|endoftext|>b", "<|ENDOFTEXT|>", "one two three four five one two", "it's John's"):
            assert e.ids(t).tolist() == whole_cached(name)(t)


def test_blocks_and_long_documents(prepared, small):
    """Documents over many blocks and segments, whose checksums come from pieces."""
    rows = [*texts(small).items(), (9000, "long words over many blocks. " * 500), (9001, None)]
    d = prepared.createDataFrame(rows, "doc_id long, text string")
    want = {r["doc_id"]: tuple(r) for r in rans.encoded(d).collect()}
    got = rans.read_ids(rans.write_ids(d, block=300, segment=5000))
    assert {r["doc_id"]: tuple(r) for r in got.collect()} == want


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=60), st.binary(max_size=300))
def test_combined_crc(a, b):
    assert rans.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# --- 7 edits


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab cD.\n é", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 20), st.text(alphabet="xy \n.", max_size=8)), max_size=4), st.sampled_from([1, 5, 20]))
def test_edits(text, edits, least):
    e = tokens.encoder(tokens.default_path(tokens.BYTE_BPE))
    count = lambda t: len(e.ids(t))
    tree = editcount.CountTree(text, count, least)
    for start, length, new in edits:
        tree.replace(start, start + length, new)
        text = text[:start] + new + text[start + length :]
        assert tree.text() == text and len(tree) == len(text) and tree.count() == count(text)


def test_edits_encode_little():
    text = "some words here and there " * 400
    e = tokens.encoder(tokens.default_path(tokens.BYTE_BPE))
    tree = editcount.CountTree(text, lambda t: len(e.ids(t)))
    before = tree.encoded
    tree.replace(5000, 5003, "new")
    assert tree.encoded - before < 500


def test_registered_edits(prepared):
    """The registered query on whole tables against whole encodings of texts edited by slices."""
    sf = "/root/testdata/sf0.001"
    encode = whole(tokens.BYTE_BPE)
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_edit_counts"](prepared, sf).collect()}
    for i, t in texts(prepared.read.parquet(f"{sf}/documents.parquet")).items():
        t = t or ""
        n = len(t)
        e = t[: n // 2] + "edited words here" + t[n // 2 + 10 :]
        e = e[: n // 4] + " inserted " + e[n // 4 :] + t[:20]
        assert (got[i]["n_tokens"], got[i]["edited_tokens"], got[i]["edited_chars"], got[i]["n_chars"]) == (len(encode(t)), len(encode(e)), len(e), n)


def test_kept_trees(prepared, small):
    """Trees written, edited, written and edited again: counts as of the whole text, little of it encoded."""
    encode = whole(tokens.BYTE_BPE)
    edit = lambda df, at: df.withColumn("edits", F.array(F.struct(F.lit(at).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), F.lit("new words").alias("text"))))
    trees = editcount.with_trees(small.limit(60)).cache()
    once = editcount.apply_edits(edit(trees, 200)).select("doc_id", "text", "lens", "counts").cache()
    for r in editcount.apply_edits(edit(once, 10)).collect():
        assert r["edited_tokens"] == sum(r["counts"]) == len(encode(r["text"])) and sum(r["lens"]) == len(r["text"])
        assert r["reencoded_chars"] <= 600 or r["n_chars"] < 700 or " " not in r["text"]


# --- 8 contamination


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x
        yield i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [200_000, 60])
def test_contamination(prepared, chunk):
    base = "a b c d e f g h i j k l".split()
    docs = [(1, " ".join(base)), (2, "x " + " ".join(base[:10]).upper() + "! y a b"), (3, "a b c"), (4, None), (5, "j k l a b c d e f g h i j k"), (6, "naïve café"), (7, "one two. " * 30)]
    items = [(10, " ".join(base)), (2, "Café"), (3, ""), (4, None), (10, "one two one"), (None, "b c"), (11, " ".join(f"w{k}" for k in range(90)))]
    d = prepared.createDataFrame(docs, "doc_id long, text string")
    got = positional.contaminated_words(d, prepared.createDataFrame(items, "item_id long, text string"), chunk=chunk)
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got.collect()) == sorted(brute_contamination(docs, items))


def test_proximity(prepared):
    d = prepared.createDataFrame([(1, "red x x green x blue"), (2, "red " + "x " * 20 + "green blue")], "doc_id long, text string")
    items = prepared.createDataFrame([(1, "green red blue")], "item_id long, text string")
    got = {r["key"]: r["items"] for r in positional.matches(positional.build_index(d), items, span=5).collect()}
    assert got == {1: ["1"], 2: []}


# --- 9 SimHash


def brute_print(text, size=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(simhash.LOWER))
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tree_nodes", [20_000, 2])
def test_near_duplicates(prepared, small, tree_nodes):
    t = texts(small) | {5000 + k: "one two three four five six seven" + " x" * k for k in range(6)} | {6000: None, 6001: "", 6002: "One  TWO"}
    df = prepared.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, tree_nodes=tree_nodes).collect()}
    prints = {i: brute_print(x) for i, x in t.items()}
    want = brute_classes(prints, simhash.RADIUS)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {r["doc_id"] for r in simhash.deduplicated(df, tree_nodes=tree_nodes).collect()} == set(want.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=60), st.integers(0, 3))
def test_bk_tree_finds_all(values, radius):
    tree = simhash.build_tree(values)
    queries = np.array(values, np.uint64)
    got = {(int(queries[i]), tree[0][node]) for node, near in simhash.search_tree(tree, queries, radius) for i in near}
    assert got == {(a, b) for a in values for b in values if (a ^ b).bit_count() <= radius}


def test_dense_groups_and_chains(prepared):
    """A cluster in which everything is near everything, and a chain whose ends are far apart."""
    rng = np.random.default_rng(3)
    cluster = [int(0x0F0F0F0F0F0F0F0F) ^ (1 << int(b)) for b in rng.choice(64, 40, replace=False)]
    chain = [((1 << k) - 1) << 2 for k in range(0, 40)]
    prints = dict(enumerate({*cluster, *chain}))
    df = prepared.createDataFrame([(i, int(np.uint64(p).view(np.int64))) for i, p in prints.items()], "doc_id long, fp long")
    for size in (20_000, 8, 1):
        got = {r["fp"]: r["component_id"] for r in simhash.classes(df, 2, size).collect()}
        want = brute_classes(prints, 2)
        assert {i: got[int(np.uint64(p).view(np.int64))] for i, p in prints.items()} == want


# --- 10 packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_fillings(counts):
    used = Counter()
    for filling, times in packing.fillings(counts, 40):
        assert sum(n * m for n, m in filling) <= 40 and times > 0
        for n, m in filling:
            used[n] += m * times
    assert used == Counter(counts)


def test_fillings_come_closest():
    """Each filling is the best that its longest piece allows, by brute force over what is left."""
    rng = np.random.default_rng(5)
    counts = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 50), 12, replace=False), rng.integers(1, 4, 12))}
    left = Counter(counts)
    for filling, times in packing.fillings(counts, 50):
        for _ in range(times):
            first = max(left)
            sums = {0}
            for n, c in left.items():
                for _ in range(c - (n == first)):
                    sums |= {s + n for s in sums if s + n <= 50 - first}
            assert sum(n * m for n, m in filling) == first + max(sums)
            left -= Counter(dict(filling))


def test_packing(small):
    encode = whole(tokens.WORD_BPE)
    got = packing.packed(small).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts(small).items():
        ids, at = np.array([*encode(t), 1], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * sum(r["length"] for r in got) + 2048
