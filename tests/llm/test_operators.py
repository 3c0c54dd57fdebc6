"""Document operators against brute force, exact round trips and held-out accuracy, with odd inputs."""

import hashlib
import html
import io
import math
import os
import random
import re
import struct
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from strandflow.llm import bpe_tree, decontaminate, html_text, licenses, line_dedup, media, ngram_jaccard, quality, range_coder, registry, substring_dedup, token_blocks
from strandflow.llm.components import components

DIR = "/root/testdata/sf0.001"
SPACE = "[^\x20\x09-\x0d]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def words_of(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, empty, null, short, tied and long texts."""
    base, passage = words_of(120, 1, 5000), words_of(30, 2, 5000)
    out = [None, "", "  \n\t ", "one", "One two", "one two", "É é x", "a" * 3000, " ".join(words_of(4000, 3))]
    for i in range(12):
        near = list(base)
        for k in range(i):
            near[(i * 17 + k * 9) % 120] = f"n{i}_{k}"
        out.append(" ".join(near))
    for i in range(10):
        own = words_of(60, 100 + i, 5000)
        out.append(" ".join(own[:30] + passage + own[30:]) + "\n" + " ".join(passage) + "\nshort line\n")
    return out + [" ".join(base)] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "clash", "clash") for i, t in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, tokens string, n string").repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    ours, theirs = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    plain = lambda d: sorted(tuple(str(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).itertuples(index=False))
    assert plain(ours) == plain(theirs)


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{i}" for i in range(1, 14)}


# op1


def shingles(text):
    w = re.findall(SPACE, (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components(docs, empty):
    sets = {i: shingles(t) for i, t in texts(docs).items()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.join(docs).collect()} == want
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert ngram_jaccard.join(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_loses_no_link_between_chains(spark, seed):
    """Chains of texts near the threshold, where pivots fail and groups must be opened."""
    rng = random.Random(seed)
    rows, text = [], words_of(80, seed, 10**6)
    for i in range(40):
        rows.append((rng.randrange(10**6) * 50 + i, " ".join(text)))
        for _ in range(rng.randrange(1, 4)):
            text[rng.randrange(80)] = f"x{i}_{rng.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in ngram_jaccard.join(df).collect()} == label


def test_jaccard_rows_of_one_document(spark):
    """Rows of equal or null doc_id join what their texts link to, and each has a row."""
    one, two, three = (" ".join(words_of(40, s, 10**6)) for s in (1, 2, 3))
    rows = [(9, one), (9, two), (4, one), (7, two), (None, three), (None, None), (12, three), (20, "own words of this text only")]
    got = sorted(map(str, map(tuple, ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(9, 36, 4), (9, 36, 4), (4, 36, 4), (7, 36, 4), (None, 36, None), (None, 0, None), (12, 36, None), (20, 2, 20)]))


def test_prefix_rule():
    rng = random.Random(1)
    for _ in range(500):
        n, m = rng.randrange(1, 60), rng.randrange(1, 60)
        common = set(range(rng.randrange(min(n, m) + 1)))
        x, y = common | {1000 + i for i in range(n - len(common))}, common | {2000 + i for i in range(m - len(common))}
        if 100 * len(common) < 75 * len(x | y):
            continue
        order = {t: rng.random() for t in x | y}
        head = lambda s: set(sorted(s, key=order.get)[: ngram_jaccard.prefix(len(s))])
        assert len(head(x) & head(y)) >= max(ngram_jaccard.needed(n), ngram_jaccard.needed(m))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 9: 5, 8: 5, 7: 5, 6: 5, 5: 5}


# op2


def test_substring(docs, empty):
    split = {i: re.findall(SPACE, t or "") for i, t in texts(docs).items()}
    least = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 12):
            least.setdefault(tuple(split[i][k : k + 13]), i)
    want = {}
    for i, w in split.items():
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove(docs).collect()} == want
    assert substring_dedup.remove(empty).count() == 0


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


# op3


def test_html_rules(spark):
    page = (
        '<html><head><title>T</title></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>wo<b>rd</b> x<br>y<p>two'
        '<script>var a="</p>";</script><div class="comments"><p>me too</p></div><aside>side</aside><ul><li>i<li>j</ul></article><footer>f</footer></body></html>'
    )
    assert html_text.Page(page).main_text(set()) == "A & B word x y two i j"
    assert html_text.Page("plain &lt;text&gt;").main_text(set()) == "plain <text>"
    assert html_text.Page("<p>a</i><b>b<p>c").main_text(set()) == "ab c"
    rows = [(i, f"http://h.org/{i}", f"<body><div>Same box on all</div><p>Own {i}</p></body>") for i in range(8)]
    rows += [(8, "http://other.org", "<body><div>Same box on all</div></body>"), (9, None, None), (10, "x", "")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: (f"Own {i}", 5) for i in range(8)}, 8: ("Same box on all", 15), 9: ("", 0), 10: ("", 0)}
    assert html_text.texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_templates_need_no_labels(spark):
    """Subtrees are hashed before any rule for labels; texts differ with and without templates."""
    page = '<body><nav><p>Menu</p></nav><div class="x1"><p>Shop news</p></div><main><p>Own {0}</p><section>Call us</section></main><div>Bye {0}</div></body>'
    first = html_text.Page(page.format(0))
    tags = [first.tags[e] for e in first.hashes()]
    assert tags == ["nav", "p", "div", "p", "section", "div"]
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.texts(pages).collect()} == {i: f"Own {i}" for i in range(8)}
    assert {r.page_id: r.text for r in html_text.extract(pages, min_pages=9).collect()} == {i: f"Own {i} Call us" for i in range(8)}
    bare = spark.createDataFrame([(i, u, h.replace("main", "b")) for i, u, h in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.texts(bare).collect()} == {i: f"Own {i} Bye {i}" for i in range(8)}
    assert {r.page_id: r.text for r in html_text.extract(bare, min_pages=9).collect()} == {i: f"Shop news Own {i} Call us Bye {i}" for i in range(8)}


def test_html_marked_up_alike(spark):
    """Comments, adverts and notices inside articles go by the mark-up that pages of a host share; what only one page has stays."""
    boxes = ['<div class="comment"><b>u{0}</b> first{0}!</div>', '<div id="comments">c{0} d{0}</div>', '<p class="notice">n{0}</p>', '<ul class="replies"><li>r{0}</ul>', '<p>a <span class="ad">buy{0}</span> b</p>', '<article class="comment">nested{0}</article>', '<p class="advert">x{0}</p>']
    pages = [(i, f"http://h.org/{i}", f"<html><body><article><h2>Same head</h2><p>own{i} words</p>" + "".join(b.format(i) for b in boxes) + "<p class='social-science'>kept</p></article></body></html>") for i in range(12)]
    pages += [(100, "http://h.org/100", "<article>one <div class='alert-related'>only here</div></article>"), (101, "http://other.org/", pages[0][2])]
    bare = [(200 + i, f"http://bare.org/{i}", f"<h1>A real heading</h1><p>Often said.</p><p>own{i}</p><ul><li>item</ul>" if i < 6 else f"<p>p{i}</p>") for i in range(40)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages + bare, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Same head own{i} words a b kept" for i in range(12))
    assert got[100] == "one only here" and "first0!" in got[101] and "buy0" in got[101]
    assert all(got[200 + i].startswith(f"A real heading Often said. own{i}") for i in range(6))


def test_html_generated_ids_stay():
    """Ids made from headings, common words as classes, and formulas are no reason to drop an article's text."""
    article = (
        '<article id="comment-policy"><h2 id="related-work">Related work</h2><section id="social-structure"><p>Social text</p></section><p><span id="Search_methods">Search</span> '
        '<span class="share">share</span> <math><mi>x</mi><annotation>tex</annotation></math></p><div class="alert">Mind</div>'
        '<div class="ad">buy</div><div class="comments-area">me</div><div role="navigation">next</div><div class="share-buttons">post</div></article>'
    )
    assert html_text.Page(f"<body>{article}</body>").main_text(set()) == "Related work Social text Search share x Mind"
    outside = '<body><div id="sidebar-left">side</div><div id="comments">me</div><div class="ad">buy</div><h2 id="related-work">Related</h2><section id="social-structure">Text</section></body>'
    assert html_text.Page(outside).main_text(set()) == "Related Text"


def test_html_copies_are_no_templates(spark):
    """Copies of a page, with one page_id or many, count as one page of their host."""
    page = "<body><h1>Title</h1><div>Own box</div><p>Own text</p></body>"
    rows = [(i // 2, f"http://copies.org/{i % 3}", page) for i in range(12)]
    rows += [(100, f"http://mixed.org/{i}", page) for i in range(9)] + [(200 + i, f"http://mixed.org/o{i}", f"<body><div>Same box</div><p>Own {i}</p></body>") for i in range(6)]
    got = [(r.page_id, r.text) for r in html_text.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted([(i, "Title Own box Own text") for i, _, h in rows if h == page] + [(200 + i, f"Own {i}") for i in range(6)])


@pytest.mark.parametrize("few", [html_text.BROADCAST_ROWS, 0])
def test_html_rotating_boxes(spark, monkeypatch, few):
    """Boxes that a host shows in turn are templates outside articles; inside, only what half of its pages hold."""
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", few)
    rows = [(i, f"http://turns.org/{i}", f"<body><div>Box {i % 3}</div><p>Own {i}</p></body>") for i in range(18)]
    rows += [(100 + i, f"http://articles.org/{i}", f"<article><div>Box {i % 3}</div><ul><li>On all</ul><p>Own {i}</p></article>") for i in range(18)]
    got = {r.page_id: r.text for r in html_text.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own {i}" for i in range(18)} | {100 + i: f"Box {i % 3} Own {i}" for i in range(18)}


@needs_tables
def test_html_whole_articles(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.texts(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)(</article>|$)", r.html, re.S)[1]
        body = re.sub("<[^>]*>", "", re.sub("</?(p|br|h1)>", " ", body))
        assert got[r.page_id] == " ".join(html.unescape(body).split())


# op4, op7


@pytest.mark.parametrize("leaf", [1, 3, 50])
def test_bpe_tree_is_the_direct_encoding(leaf):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec, rng = bpe_tree.codec(path, public_tokenizers.PATTERN, leaf), random.Random(leaf)
    kinds = ["abc def's  12 \n\n\t x", "aaaaaaaé", "été 'll !!?? ...  ", "中文字符很多", "  \n a", "thingation"]
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 60)))
        ids = codec.encode(s)
        assert ids == codec.coding.encode_ordinary(s) and codec.decode(ids) == s.encode()


def test_bpe_columns(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe_tree.digests(docs, path, public_tokenizers.PATTERN).collect()}
    direct = bpe_tree.codec(path, public_tokenizers.PATTERN).coding
    for i, t in texts(docs).items():
        ids = direct.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe_tree.digests(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 129, 5000, 70_000])
def test_range_coder(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50258, n), rng.zipf(1.3, n) % 50258, np.resize([7, 8, 9, 50257], n)):
        block = range_coder.encode(ids, 50258)
        assert (range_coder.decode(block, 50258) == ids).all()
    if n:
        with pytest.raises(ValueError):
            range_coder.decode(block[:-1] + bytes([block[-1] ^ 1]), 50258)


@pytest.mark.parametrize("memory", [5, token_blocks.MEMORY])
def test_piecewise_encoding_is_the_whole_one(memory):
    encoder, rng = token_blocks.Encoder(registry.TOKENIZER, memory), random.Random(6)
    kinds = ["ab 's  ", "\n \n\t", "\u2002\u2028 \u3000x", "\u1680 \x1c\x85\xa0\n\u205f\u202f", "é中 12!", "ñ×÷,'t._", "e\u0301 ' 'll,", "—… ,.x\x7f\x00", "<|endoftext|> "]
    for _ in range(400):
        rows = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        data = [x.encode() for x in rows]
        ids, n = encoder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]))
        assert [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] == [encoder.library.encode(x, add_special_tokens=False).ids for x in rows]


def test_token_blocks(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(registry.TOKENIZER)
    library.encode_special_tokens = True
    start, want = 0, {}
    for i, t in sorted(texts(docs).items()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_blocks.digests(docs, registry.TOKENIZER).collect()}
    assert got == want
    assert token_blocks.digests(empty, registry.TOKENIZER).count() == 0


def test_token_blocks_of_any_size(spark, docs, tmp_path):
    """Small blocks hold whole documents and give the same ids."""
    encoder = token_blocks._encoder(registry.TOKENIZER)
    want = {i: [*encoder.library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts(docs).items()}
    for k, block_ids in enumerate((1, 300)):
        folder = str(tmp_path / str(k))
        token_blocks.write(docs, registry.TOKENIZER, folder, 2, block_ids)
        rows = spark.read.parquet(folder).collect()
        assert all(r.n_ids <= block_ids or len(r.docs) == 8 for r in rows) and len(rows) > 10
        back = token_blocks.read(spark, folder, encoder.symbols).collect()
        assert {r["__key"]: np.frombuffer(r.ids, "<u4").tolist() for r in back} == want


# op5


def dhash_by_hand(samples):
    """Cell means pixel by pixel, without integral images."""
    grey = samples.astype(int) @ [299, 587, 114] // 1000
    tall = np.repeat(np.repeat(grey, 8, 0), 9, 1)  # each cell is a whole number of these
    h, w = grey.shape
    means = (2 * tall.reshape(8, h, 9, w).sum((1, 3)) + h * w) // (2 * h * w)
    bits = "".join(str(int(means[i, j] < means[i, j + 1])) for i in range(8) for j in range(8))
    return f"{int(bits, 2):016x}", means.astype(np.uint8)


def test_media_round_trip(spark, docs, empty):
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    forms = set()
    for i, t in texts(docs).items():
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        samples = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
        if zlib.crc32(payload) & 1:
            stored = b"BM" + (54 + len(payload)).to_bytes(4, "little") + bytes(4) + b"\x36\0\0\0\x28\0\0\0\x40\0\0\0" + len(samples).to_bytes(4, "little") + b"\1\0\x18\0\0\0\0\0"
            stored += len(payload).to_bytes(4, "little") + b"\x13\x0b\0\0" * 2 + bytes(8) + samples[::-1, :, ::-1].tobytes()
        else:
            stored = b"P6\n64 %d\n255\n" % len(samples) + payload
        forms.add(stored[:2])
        feature, means = dhash_by_hand(samples)
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature)
        tile = np.lib.format.header_data_from_array_1_0(means)
        assert tile["shape"] == (8, 9) and len(got[i].npy_sha256) == 64
    assert forms == {b"BM", b"P6"}
    stored = media.tiles(media.store_texts(docs)).collect()
    assert all(bytes(r.pixels).startswith((texts(docs)[r.doc_id] or "").encode()) for r in stored)
    for r in stored:
        pixels = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3)
        assert (np.load(io.BytesIO(r.npy)) == dhash_by_hand(pixels)[1]).all() and got[r.doc_id].npy_sha256 == hashlib.sha256(r.npy).hexdigest()
    assert media.digests(empty).count() == 0
    odd = spark.createDataFrame([(None, b"P6 1 1 255 abc", "x"), (None, b"GIF89a", "y"), (1, b"P6 9 9 255 a", "z"), (1, None, "z"), (2, b"P5 0 0 255 ", "z")], "doc_id long, media binary, npy string")
    assert sorted((str(r.doc_id), r.problem or "", r.npy is None) for r in media.tiles(odd).collect()) == [("1", "", True), ("1", "broken", True), ("2", "", True), ("None", "", False), ("None", "of a kind not read here", True)]


def test_media_formats():
    grey, colour = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7, np.random.default_rng(0).integers(0, 256, (5, 7, 3), np.uint8)
    for x in (grey, colour):
        assert (media.decode(media.encode_ppm(x)) == x).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P2 # c\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P1\n3 2\n101\n010") == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 255, 0], [255, 0, 255]]).all()
    assert (media.decode(b"P5 2 1 65535 " + bytes([255, 255, 128, 0])) == [[255, 127]]).all()
    bmp = lambda bits, packed, extra, body: struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 0, 0, 0, 54 + len(extra), 40, 3, 1, 1, bits, packed, 0, 0, 0, 0, 0) + extra + body
    assert (media.decode(bmp(1, 0, bytes([1, 2, 3, 0, 7, 8, 9, 0]), bytes([0b01000000, 0, 0, 0]))) == [[[3, 2, 1], [9, 8, 7], [3, 2, 1]]]).all()
    assert (media.decode(bmp(4, 0, bytes(range(64)), bytes([0x21, 0xF0, 0, 0]))) == [[[10, 9, 8], [6, 5, 4], [62, 61, 60]]]).all()
    assert (media.decode(bmp(8, 0, bytes(range(256)) * 4, bytes([1, 2, 3, 0]))) == [[[6, 5, 4], [10, 9, 8], [14, 13, 12]]]).all()
    assert (media.decode(bmp(16, 0, b"", struct.pack("<4H", 31 << 10, 31 << 5, 31, 0))) == [[[255, 0, 0], [0, 255, 0], [0, 0, 255]]]).all()
    assert (media.decode(bmp(32, 0, b"", struct.pack("<3I", 0x010203, 0x040506, 0x070809))) == [[[1, 2, 3], [4, 5, 6], [7, 8, 9]]]).all()
    assert (media.decode(bmp(32, 3, struct.pack("<3I", 0xFF, 0xFF00, 0xFF0000), struct.pack("<3I", 0x010203, 0x040506, 0x070809))) == [[[3, 2, 1], [6, 5, 4], [9, 8, 7]]]).all()
    brute = np.kron(grey.astype(float), np.ones((4, 3))).reshape(4, 5, 3, 7).mean((1, 3))
    assert np.allclose(media.area_sums(grey, 4, 3) / grey.size, brute)
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


# op6


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(1, 2**63, 3000).astype(np.uint64)
    f = line_dedup.CuckooFilter.of(keys)
    assert f.holds(keys).all() and f.holds(keys + np.uint64(12345)).mean() < 0.05
    assert all(f.delete(int(k)) for k in keys[:1500]) and f.holds(keys[1500:]).all() and f.holds(keys[:1500]).mean() < 0.05


def brute_lines(rows, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= min_docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i) for i, t in rows.items()}


def test_line_dedup_is_reversible(spark, docs, empty):
    rows = texts(docs)
    out = line_dedup.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert {r.doc_id: r.text or "" for r in out.collect()} == brute_lines(rows)
    some, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = line_dedup.LineIndex.build(some, shards=4).insert(rest)
    assert {r.doc_id: r.text or "" for r in index.dedup(docs).collect()} == brute_lines(rows)
    back = index.insert(some).delete(rest.select("doc_id")).delete(spark.createDataFrame([(987654,)], "doc_id long"))
    assert {r.doc_id: r.text or "" for r in back.dedup(some).collect()} == brute_lines({i: t for i, t in rows.items() if i % 2 == 0})
    assert line_dedup.dedup(empty).count() == 0


@pytest.mark.parametrize("salts", [1, 16])
def test_filters_by_shard_change_nothing(spark, docs, monkeypatch, salts):
    """Filters that are not broadcast screen the same keys, and let few others pass."""
    rows = texts(docs)
    index = line_dedup.LineIndex.build(docs, shards=5, min_docs=3)
    want = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in index.dedup(docs).collect()}
    asked = line_dedup._pairs(docs, index.min_chars)
    hot = index.keys.where("n >= 3")
    monkeypatch.setattr(line_dedup, "SALTS", salts)
    passed = index._screened(asked)
    exact = asked.join(hot, line_dedup.DIGEST, "left_semi")
    assert exact.exceptAll(passed).count() == 0 and passed.count() <= exact.count() + 2 < asked.count()
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in index.dedup(docs).collect()} == want and set(want) == set(rows)


def test_line_index_lives_on(spark, docs, tmp_path):
    """Deletions and insertions after a save; keys cross the threshold both ways."""
    rows = texts(docs)
    line_dedup.LineIndex.build(docs, shards=2).save(str(tmp_path / "index"))
    ids, state = sorted(rows), set(rows)
    index, rng = line_dedup.LineIndex.load(spark, str(tmp_path / "index")), random.Random(5)
    for _ in range(4):
        some = docs.where(docs.doc_id.isin(rng.sample(ids, 12)))
        here = {r.doc_id for r in some.select("doc_id").collect()}
        index, state = (index.delete(some), state - here) if rng.random() < 0.5 else (index.insert(some), state | here)
        left = docs.where(docs.doc_id.isin(sorted(state)))
        assert {r.doc_id: r.text or "" for r in index.dedup(left).collect()} == brute_lines({i: rows[i] for i in state})


def thue_morse(n):
    """A line of n letters a and b, and its complement: equal under any polynomial hash modulo 2**64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_no_text_collides(spark, n):
    """Different lines and words stay different in line dedup, substring dedup and the Jaccard join."""
    one, two = thue_morse(n)
    lines = spark.createDataFrame([(i, one if i < 3 else two) for i in range(5)], "doc_id long, text string")
    assert {r.n_dropped for r in line_dedup.digests(lines).collect()} == {0}
    same = " ".join(f"w{i}" for i in range(12))
    tails = spark.createDataFrame([(0, f"{same} {one}"), (1, f"{same} {two}")], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.digests(tails).collect()} == {0}
    pair = spark.createDataFrame([(0, f"{one} a b c d"), (1, f"{two} a b c d")], "doc_id long, text string")
    assert {r.component_id for r in ngram_jaccard.join(pair).collect()} == {0, 1}


# op8


def test_quality_held_out(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "was", "calm", "and", "cold.", "we", "walked"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 200)))
    poor = lambda: " ".join(rng.choice(["BUY", "NOW", "FREE"]) + "!!" for _ in range(rng.randint(20, 200)))
    rows = [(i, good() if i % 4 else poor(), int(i % 4 > 0)) for i in range(1200)] + [(1200, None, 0), (1201, "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.scores(df.select("doc_id", "text"), df.select("doc_id", "quality").where("doc_id % 3 > 0")).join(df, "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.text]
    assert min(r.score for r in held if r.quality) > max(r.score for r in held if not r.quality)
    none = quality.scores(df.select("doc_id", "text"), df.select("doc_id", "quality").where("false"))
    assert {round(r.score, 6) for r in none.collect()} == {0.5}


def test_class_prior():
    """The share of positives comes back from scores of positives and unlabelled rows alone, whatever the negatives' are."""
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        positive, negative = rng.beta(8, 2, 20_000), rng.beta(2, 8, 20_000)
        mixed = np.concatenate([positive[: int(20_000 * share)], negative[: 20_000 - int(20_000 * share)]])
        levels = lambda x: np.histogram(x, 1000, (0, 1))[0]
        assert abs(quality.estimate_prior(levels(mixed), levels(rng.beta(8, 2, 5_000))) - share) < 0.05


def test_quality_is_the_least_risk(spark):
    """The fitted weights against the risk as written in the docstring, summed row by row: no step lowers it."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["a", "tree", "Sun", "moon.", "go!", "1"][i % 3 :]) for _ in range(rng.randint(5, 40)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    data = [t.encode() for _, t in rows]
    x = quality.features(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(t) for t in data])).astype(np.float32)
    z = np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((400, 1))])
    trusted = [i for i in range(0, 400, 2) if i % 3 and zlib.crc32(str(i).encode()) % 5]
    loss = lambda g: math.log1p(math.exp(-g)) if g > 0 else -g + math.log1p(math.exp(g))

    def risk(w):
        part = lambda at, sign: sum(loss(sign * float(z[i] @ w)) for i in at) / len(at)
        ridge = np.full(len(w), quality.ridge_of(len(trusted)))
        ridge[-1] = 1e-6
        return model.prior * part(trusted, 1) + part(range(400), -1) - model.prior * part(trusted, -1) + (ridge * w * w).sum() / 2

    best = risk(model.weights)
    for k in range(0, len(model.weights), 7):
        for step in (-0.02, 0.02):
            moved = model.weights.copy()
            moved[k] += step
            assert risk(moved) > best - 1e-6
    again = [quality.scores(df, labels).orderBy("doc_id").collect() for _ in range(2)]
    assert again[0] == again[1]


# op9


def test_decontamination(spark, docs, empty):
    rows, item = texts(docs), " ".join(words_of(30, 2, 5000))
    bench = [(1, item.upper().replace(" ", ", ")), (2, "One, two!"), (10, None), (3, "..."), (4, "nothing of this kind stands anywhere in these documents at all today friends")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall((t or "").translate(LOWER))
    want = {}
    for d, t in rows.items():
        w, hit, items = split(t), set(), set()
        for i, x in bench:
            p = split(x)
            n = min(13, len(p))
            windows = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    items.add(str(i))
        want[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    judge = lambda: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(docs, benchmark).collect()}
    assert judge() == want
    kept = {d for d, v in want.items() if not v[4]}
    assert {r.doc_id for r in decontaminate.remove(docs, benchmark).collect()} == kept
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, benchmark, whole=False).collect()}
    assert all(len(split(cut[d])) == v[0] - v[1] for d, v in want.items())
    old = decontaminate.BLOCK_ITEMS
    decontaminate.BLOCK_ITEMS = 1  # blocks of one item give the same
    try:
        assert judge() == want and {r.doc_id for r in decontaminate.remove(docs, benchmark).collect()} == kept
    finally:
        decontaminate.BLOCK_ITEMS = old
    assert decontaminate.judge(empty, benchmark).count() == 0 and decontaminate.judge(docs, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_blocks_change_nothing(spark, monkeypatch):
    """Rows of equal or null doc_id, items of null id and windows that overlap across blocks, in one block or many."""
    w = words_of(60, 9, 10**6)
    rows = [(None, " ".join(w[:30]), "a"), (None, "clean words only", "b"), (7, " ".join(w[5:40]) + " end", "c"), (7, "other " * 50 + " ".join(w[10:24]), "d"), (7, "clean", "e"), (8, None, "f")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, __row string").repartition(3)
    benchmark = spark.createDataFrame([(1, " ".join(w[:20])), (2, " ".join(w[12:34])), (None, " ".join(w[8:26])), (None, " ".join(w[20:40]))], "item_id long, text string")

    def results():
        return [sorted(map(str, x.collect())) for x in (decontaminate.judge(documents, benchmark), decontaminate.remove(documents, benchmark), decontaminate.remove(documents, benchmark, whole=False))]

    one = results()
    assert len(one[0]) == len(one[2]) == 6 and sorted(x[-3] for x in one[1]) == ["b", "e", "f"]
    assert any("n_words=30, n_hit=30, n_items=3," in x for x in one[0])
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 1)
    assert results() == one


# op10


def test_licenses(spark, empty):
    name, text = licenses.KNOWN[0]
    altered = "Copyright (c) 2020 Someone\n\n" + text.replace("sublicense", "sublicence").replace("\n\n", "\n") .replace("Software", "SOFTWARE")
    rows = [(1, altered), (2, "Some words.\nReleased under the MIT licence!\n"), (3, None), (4, ""), (5, "Copyright me"), (6, text + " and more")]
    got = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == name and got[2] == (None, "MIT", 1)
    assert all(got[i][0] is None and got[i][2] == 0 for i in (3, 4, 5)) and got[6][0] is None
    assert licenses.scan(empty).count() == 0


def test_every_known_license_is_found(spark):
    """Each shipped text and header, and each text of the list, gives its identifier, also reflowed, in capitals and under a copyright line."""
    files = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(licenses.TEXTS.glob("*.txt"))}
    known = [(n.removesuffix(".header"), t) for n, t in files.items()] + [(n, t) for n, t in licenses.KNOWN]
    altered = [(n, "  (c) 1999 Some Body, all rights\n" + re.sub(r"(?m)^[ \t]+", "", t).upper().replace(" AND ", "  and\n")) for n, t in known if "COPYRIGHT" not in t.upper()]
    rows = [(i, t) for i, (_, t) in enumerate(known + altered)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(files) >= 20 and altered and [got[i] for i in range(len(rows))] == [n for n, _ in known + altered]


HEADS = ["", "Copyright (c) 2020 Some One\n\n", "Copyright 2019-2021 A. Very Long Name of Some Institution,\nits branches and other contributors. All rights reserved.\n\n", "© 2001 X\nAll rights reserved.\n"]


@pytest.mark.parametrize("width", [60, 66, 72, 75, 79, 80, 88, 99])
def test_licenses_at_any_width(spark, width):
    """Every known text, its paragraphs or all of it filled to a width, under titles and statements; words changed are found no more."""
    files = [(f.name.removesuffix(".txt").removesuffix(".header"), f.read_text()) for f in sorted(licenses.TEXTS.glob("*.txt"))]
    rows, want = [], {}
    for k, (name, text) in enumerate(licenses.KNOWN[:5] + files):
        fill = lambda t: textwrap.fill(" ".join(t.split()), width, break_long_words=False, break_on_hyphens=False)
        filled = "\n\n".join(fill(p) for p in re.split(r"\n\s*\n", text.strip()))
        body = filled.partition("\n\n")[2] if name == "MIT" else filled
        titles = ["", "MIT License\n\n", "The MIT License (MIT)\n\n"] if name == "MIT" else [""]
        texts = [head + title + body for head in HEADS for title in titles] + [fill(text)] + [title + head + body for head in HEADS for title in titles]
        for t in texts + [body.replace("\n\n", "\n")]:
            want[len(rows)] = name
            rows.append((len(rows), t))
        words = body.split(" ")
        rows.append((len(rows), " ".join([*words[: len(words) // 2], "not", *words[len(words) // 2 :]])))
        want[len(rows) - 1] = None
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {i: (got[i], n) for i, n in want.items() if got[i] != n} == {}


@pytest.mark.parametrize(
    ("one", "two"),
    [
        ("The organisation licences its colour", "THE ORGANIZATION LICENSES ITS COLOR"), ("acknowledgement of a cancelled labelling", "acknowledgment of a canceled labeling"), ("a sub-license for non-commercial per cent", "a sublicense for noncommercial percent"),
        ("the copyright owner, whilst", "the copyright holder while"), ("see https://x.org/a", "see http x org a"), ("Copyright 2020 X\nfree  for all", "free for all\n * (C) someone"), ("one\n\n\ttwo", "One -- two."),
    ],
)
def test_equivalent_spellings(spark, one, two):
    df = spark.createDataFrame([(1, one), (2, two), (3, one + " other")], "doc_id long, text string")
    got = {r.doc_id: r.canonical_sha256 for r in licenses.scan(df).collect()}
    assert got[1] == got[2] != got[3]


def test_license_rows(spark):
    """Rows of equal or null doc_id have results of their own."""
    read = lambda name: (licenses.TEXTS / f"{name}.txt").read_text()
    rows = [(1, read("MPL-2.0")), (1, read("Zlib")), (None, read("GPL-3.0-only").split(licenses.TERMS_END)[0]), (None, read("GPL-3.0-or-later.header")), (None, "None"), (None, "None")]
    got = sorted(str(r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(["MPL-2.0", "Zlib", "GPL-3.0-only", "GPL-3.0-or-later", "None", "None"])


# all of them: null and equal ids, repeated rows, empty and very long texts, columns of clashing names


CLASH = "__key key packed spans grp __gone tokens n x positive row canon digest ids decoded media pixels npy file tie shard hash host hashes strict __row n_lines n_words score kept items place slice docs __one __two bucket".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Texts by row number, and the same rows with odd ids: null, repeated, and their own."""
    long = " ".join(words_of(60_000, 77, 20_000))
    some = corpus()[:18] + [long, long + " end", "x" * 200_000, "same text", "same text", "line of more than forty characters, which repeats\n" * 3]
    some += [f"line of more than forty characters, which repeats\nown {i}" for i in range(6)]
    ids = [None, None, 3, 3, 3, *range(100, 100 + len(some) - 5)]
    rows = list(zip(ids, some, strict=True)) + [(140, "added row"), (140, "added row"), (None, some[9]), (3, some[10])]
    return rows, spark.createDataFrame([(i, t, *["clash"] * len(CLASH)) for i, t in rows], ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in CLASH]])).repartition(5)


def per_row(rows, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in rows)


@pytest.mark.parametrize("name", ["op4", "op5", "op7", "op8", "op9", "op10"])
def test_odd_rows_are_judged_one_by_one(spark, odd, name):
    """Each row of odd ids has the result that it has under an id of its own."""
    rows, table = odd
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(0, 40, 3)] + [(None, 1), (101, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, " ".join(words_of(30, 2, 5000))), (2, "same text"), (None, None)], "item_id long, text string")
    run = {
        "op4": lambda d: bpe_tree.digests(d, registry.RANKS, public_tokenizers.PATTERN),
        "op5": media.digests,
        "op7": lambda d: token_blocks.digests(d, registry.TOKENIZER),
        "op8": lambda d: quality.scores(d, labels if d is table else own_labels),
        "op9": lambda d: decontaminate.judge(d, items),
        "op10": licenses.scan,
    }[name]
    own = spark.createDataFrame([(1000 + k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    own_labels = labels.where("false")
    got, want = run(table).collect(), run(own).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    if name == "op8":  # equal texts have equal scores, whatever their ids
        by_text = {}
        for r in got:
            by_text.setdefault(r.doc_id, set()).add(r.score)
        assert len(by_text[140]) == 1 and all(0 <= r.score <= 1 for r in got) and len(want) == len(rows)
        return
    columns = [c for c in got[0].asDict() if c not in ("doc_id", "start", "held_out")]
    at = {1000 + k: str(i) for k, (i, _) in enumerate(rows)}
    result = lambda r, i: str((i, *[r[c] for c in columns]))
    assert sorted(result(r, str(r.doc_id)) for r in got) == sorted(result(r, at[r.doc_id]) for r in want)
    if name == "op7":  # documents follow each other by id, null first, without gaps
        ordered = sorted(got, key=lambda r: r.start)
        assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
        assert [-1 if r.doc_id is None else r.doc_id for r in ordered] == sorted(-1 if i is None else i for i, _ in rows)


def by_document(rows):
    """The texts of each document, null as the smallest id."""
    out = {}
    for i, t in rows:
        out.setdefault(-1 if i is None else i, []).append(t or "")
    return out


def test_odd_rows_substring(odd):
    rows, table = odd
    least = {}
    for i, parts in sorted(by_document(rows).items()):
        for t in parts:
            w = re.findall(SPACE, t)
            for k in range(len(w) - 12):
                least.setdefault(tuple(w[k : k + 13]), i)
    want = []
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < (-1 if i is None else i) for j in range(13)}
        want.append(str((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))))
    assert per_row(substring_dedup.remove(table).collect(), ["doc_id", "n_words", "n_removed", "kept"]) == sorted(want)


def test_odd_rows_lines(odd):
    rows, table = odd
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = {}
    for i, parts in by_document(rows).items():
        for x in "\n".join(parts).split("\n"):
            held.setdefault(key(x), set()).add(i)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if hot.get(key(x), -1 if i is None else i) == (-1 if i is None else i)]
        want.append(str((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())))
    assert hot and per_row(line_dedup.digests(table).collect(), ["doc_id", "n_lines", "n_dropped", "kept_sha256"]) == sorted(want)
    assert line_dedup.dedup(table).columns == [*[c for c in table.columns if c != "n_lines"], "n_lines", "n_dropped"]


def test_odd_rows_jaccard(odd):
    rows, table = odd
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            linked = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
            if linked or (rows[a][0] == rows[b][0] and sets[a] and sets[b]):
                up = [up[b] if x == up[a] else x for x in up]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[up[k]] = min(least.get(up[k], 10**9), -1 if i is None else i)
    want = sorted(str((i, len(sets[k]), None if least[up[k]] < 0 else least[up[k]])) for k, (i, _) in enumerate(rows))
    assert per_row(ngram_jaccard.join(table).collect(), ["doc_id", "n_shingles", "component_id"]) == want
    kept = ngram_jaccard.keep_one(table)
    assert kept.columns == table.columns


def test_odd_rows_pages(spark, odd):
    rows, _ = odd
    pages = [(i, None if i is None else f"http://h.org/{i}", f"<p>{html.escape(t)}</p>" if t else t, *["clash"] * len(CLASH)) for i, t in rows]
    table = spark.createDataFrame(pages, ", ".join(["page_id long", "url string", "html string", *[f"`{c}` string" for c in CLASH]]))
    want = sorted(str((i, u, " ".join((t or "").split()))) for (i, u, *_), (_, t) in zip(pages, rows, strict=True))
    assert per_row(html_text.texts(table).collect(), ["page_id", "url", "text"]) == want


def test_odd_rows_filters(spark, odd):
    """What keeps rows keeps all their columns."""
    rows, table = odd
    items = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    assert decontaminate.remove(table, items).columns == table.columns and decontaminate.remove(table, items).count() == len(rows) - 2
    labels = spark.createDataFrame([], "doc_id long, quality int")
    good = quality.keep_good(table, quality.fit(table, labels))
    assert good.columns == table.columns and good.count() == len(rows)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.scores(empty, labels).count() == 0 and quality.scores(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0
    assert decontaminate.remove(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert ngram_jaccard.keep_one(empty).count() == 0 and media.tiles(media.store_texts(empty)).count() == 0
    index = line_dedup.LineIndex.build(empty)
    assert index.insert(empty).delete(empty).dedup(empty).count() == 0
