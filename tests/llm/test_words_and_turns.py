"""Spelling variants, fingerprints and the prefix trie against brute force, with odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strandflow.llm import prefix_trie, registry, spelling, winnowing

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


# op11


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_by_hand(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    shorter = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for k, group in shorter.items():
        group = group | ({k} & n.keys())
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def grouped(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@needs_tables
def test_spelling_whole_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert grouped(registry.queries()["op11_spelling_variants"](spark, DIR)) == spelling_by_hand([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_spelling_of_dense_words(spark, crowd):
    """Words of three letters' alphabet, where most bigrams are shared, and chains of forms."""
    rng = random.Random(crowd)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))) for _ in range(300)]
    words += ["aaaaaaa", "aaaaaaaa", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(80)]
    chain = "kettles " * 2 + "kettlos " * 20 + "kettlas " * 200 + "Kattlas " * 2000 + " ".join(["x" * 3000, "x" * 2999] * 2)
    rows = [(i * 31, t) for i, t in enumerate([*texts, chain, None, "", texts[0], "12 ÷×"])] + [(None, texts[1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS word", "1 AS n").repartition(3)
    vocabulary = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    want = spelling_by_hand(rows)
    assert vocabulary == {w: n for w, _, _, n, _, _ in want}
    pairs = {(r.a, r.n_a, r.b, r.n_b) for r in spelling.near_pairs(spelling.vocabulary(df), crowd).collect()}
    assert pairs == {(a, vocabulary[a], b, vocabulary[b]) for a in vocabulary for b in vocabulary if a < b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    if crowd == 64:
        assert grouped(spelling.group(df)) == want
        assert {w: r for w, _, r, *_ in want}["kettles"] == "kattlas"


def test_rest_hashes():
    for rest in ("", "a", "abcabc", "zzzz"):
        found = spelling.rest_hashes(rest)
        assert (len(rest), sum(ord(c) * pow(spelling.BASE, i, spelling.PRIME) for i, c in enumerate(rest)) % spelling.PRIME) in found
        shorter = {rest[:i] + rest[i + 1 :] for i in range(len(rest))}
        assert found == {x for t in shorter | {rest} for x in spelling.rest_hashes(t) if x[0] == len(t)} and len(found) == 1 + len(shorter)


# op12


def pieces(text):
    return re.findall(winnowing.PIECE.replace(r"\x{2E80}", "⺀").replace(r"\x{10FFFF}", "\U0010ffff"), text.lower())


def kept_by_hand(text, spark_hashes):
    """Least hashes of windows, the rightmost of equal ones, from the pieces' hashes."""
    p = [spark_hashes[x] for x in pieces(text)]
    fold = lambda xs: sum(x * pow(winnowing.BASE, len(xs) - 1 - i, winnowing.PRIME) for i, x in enumerate(xs)) % winnowing.PRIME
    grams = [fold(p[i : i + winnowing.K]) for i in range(len(p) - winnowing.K + 1)] if len(p) >= winnowing.K else [fold(p)] if p else []
    out = []
    for i in range(max(len(grams) - winnowing.W, 0) + 1 if grams else 0):
        window = grams[i : i + winnowing.W]
        at = max(k for k, g in enumerate(window) if g == min(window))
        if (window[at], i + at) not in out:
            out.append((window[at], i + at))
    return out


def texts_for_prints():
    rng = random.Random(5)
    words = ["tion", "the", "é", "of", "stand", "a", "中文字", "😀x", "x" * 40]
    texts = [" ".join(rng.choices(words, k=k)) for k in (0, 1, 2, 5, 9, 30, 60, 400)]
    return [*texts, None, "", " \t\n", "same same same same same same same same same same same same", "Ab" * 500]


def test_winnowing(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts_for_prints())]
    rows += [(5, rows[7][1]), (3, None), (3, None), (None, "last of all"), (None, "last of all"), (None, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' AS hashes", "7 AS __n").repartition(3)
    known = {x for _, t in rows for x in pieces(t or "")}
    hashes = dict(spark.createDataFrame([(x,) for x in known], "p string").select("p", F.pmod(F.xxhash64("p"), F.lit(winnowing.PRIME))).collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, str([tuple(p) for p in r.prints])) for r in winnowing.fingerprints(df).collect())
    assert got == sorted((i is None, i or 0, str(kept_by_hand(t or "", hashes))) for i, t in rows)

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tuple(-b for b in hashlib.md5((r[1] or "").encode()).digest())), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 2
        edited = t[: len(t) - m] + nxt[:m]
        known |= set(pieces(edited))
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    found = winnowing.compare(df).collect()
    assert Counter((r.doc_id, r.n_chars, hashlib.sha256(r.edited.encode()).hexdigest()) for r in found) == want
    hashes = dict(spark.createDataFrame([(x,) for x in known], "p string").select("p", F.pmod(F.xxhash64("p"), F.lit(winnowing.PRIME))).collect())
    for r in found:
        a, b = ({h for h, _ in kept_by_hand(t, hashes)} for t in (dict(rows).get(r.doc_id) or "", r.edited))
        if r.doc_id not in (3, 5, None):  # their texts are several
            assert set(r.hashes) == a
            assert r.near_edited == (len(a & b) / len(a | b) if a | b else 1.0)
        assert r.edited_hashes == [h for h, _ in kept_by_hand(r.edited, hashes)]
    plain = winnowing.digests(df).collect()
    assert len(plain) == len(rows) and all(len(r.fingerprint) == max(9 * len(r.fingerprint.split()) - 1, 0) for r in plain)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert winnowing.digests(empty).count() == 0 and winnowing.fingerprints(empty).count() == 0
    alone = winnowing.compare(spark.createDataFrame([(9, "just one text here")], "doc_id long, text string")).first()
    assert alone.next_doc_id == 9 and alone.near_next == 1.0 and alone.edited == "just one just one "


def test_winnowing_guarantee(spark):
    """A passage of K + W - 1 whole pieces shared by two texts shares a kept hash."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    rows = []
    for i in range(40):
        passage = [word() for _ in range(winnowing.K + winnowing.W - 1)]
        for j in (0, 1):
            rows.append((2 * i + j, " ".join([word() for _ in range(rng.randrange(50))] + passage + [word() for _ in range(rng.randrange(50))])))
    kept = {r.doc_id: {p.hash for p in r.prints} for r in winnowing.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[2 * i] & kept[2 * i + 1] for i in range(40))


# op13


def trie_by_hand(rows, rebuild=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, prefix_key(role, text), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])
        built[c] = tuple(base[:h] + v[h:]) if rebuild else tuple(v)
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = Counter()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(k)))
        out[(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def prefix_key(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08X}"


def found_nodes(df):
    return Counter(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def conversations_for_tries():
    rng = random.Random(3)
    rows = []
    for c in [*range(150), 1000, 1003, 205, -7, -250, 10**12 + 5]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "system"]) if t else "user", rng.choice(["", "hi", "hello there", "é😀"])))
    for c in range(300, 340):  # copies, and one long chain with ways out of it
        rows += [(c, t, "user", f"turn {t}") for t in range(30 - (c % 3))]
    rows += [(7, None, None, None), (7, 1, "user", None), (8, 1, "b", "tie"), (8, 1, "a", "tie"), (8, 1, "a", "tie"), (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("limit, bucket", [(prefix_trie.LIMIT, prefix_trie.BUCKET), (4, 3), (1, 1)])
def test_prefix_trie(spark, limit, bucket):
    rows = conversations_for_tries()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS path", "1 AS n").repartition(3)
    whole = prefix_trie.paths(df)
    assert found_nodes(prefix_trie.trie(prefix_trie.rebuilt(whole), limit, bucket)) == trie_by_hand(rows)
    assert found_nodes(prefix_trie.trie(whole, limit, bucket)) == trie_by_hand(rows, rebuild=False)


def test_prefix_trie_odd_tables(spark, monkeypatch):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie.nodes(spark.createDataFrame([], kind)).count() == 0
    alone = [(c, 0, "user", "own") for c in range(1001, 1030)]  # some lose their only turn, and no first conversation gives one
    assert found_nodes(prefix_trie.nodes(spark.createDataFrame(alone, kind))) == trie_by_hand(alone)
    turnless = [(c, 0, "user", "x") for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6][:3]
    assert found_nodes(prefix_trie.nodes(spark.createDataFrame(turnless, kind))) == trie_by_hand(turnless)
    monkeypatch.setattr(prefix_trie, "PACK", 2)  # one path's conversations in many packs
    copies = [(c, 0, "user", "same") for c in range(100, 160)]
    assert found_nodes(prefix_trie.trie(prefix_trie.paths(spark.createDataFrame(copies, kind)))) == trie_by_hand(copies, rebuild=False)


@needs_tables
def test_prefix_trie_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found_nodes(registry.queries()["op13_prefix_trie"](spark, DIR)) == trie_by_hand(rows)
