"""Operators on small inputs: against brute force, and nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runloom.llm import html_text, media, mixing, packing, simhash, suffix_dedup, token_files, toxicity, urls
from runloom.llm.components import stars
from runloom.llm.html_text import Page
from runloom.llm.queries import vocabulary

DOCS = "doc_id long, text string, source string, n_chars long, d long, size string, host string"


def docs_of(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), 7, "x", "h") for i, t, s in zip(ids, texts, sources, strict=True)], DOCS)


@pytest.fixture(scope="session")
def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts += [t[:200] + passage + t[200:] for t in texts[:15]] + texts[:5] + [texts[6][1:], "ab" * 300, "a" * 500, "", None, " \t\n", "word", "two words"]
    return texts


# token counts


def test_token_counts(spark, corpus):
    path = vocabulary("byte_bpe_50k.tiktoken")
    got = sorted(map(tuple, token_files.token_counts(docs_of(spark, corpus), path).collect()))
    plain = token_files._encoder(path)
    assert got == [(i, len(plain.encode_ordinary(t or ""))) for i, t in enumerate(corpus)]
    assert token_files.token_counts(docs_of(spark, []), path).count() == 0


def test_long_texts_are_encoded_in_parts(monkeypatch, corpus):
    path = vocabulary("byte_bpe_50k.tiktoken")
    text = " ".join(t for t in corpus if t)
    whole = token_files._encoder(path).encode_ordinary(text)
    monkeypatch.setattr(token_files, "PART", 100)
    assert token_files.encode(text, path).tolist() == whole


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_scan_stitches_blocks(spark, block):
    rng = random.Random(block)
    files = [[rng.choice([0, 1, 2, 9]) for _ in range(n)] for n in (0, 1, 5, 30, 31)] + [[9], [9, 9, 1], [1, 9]]
    rows = [(i, bytearray(np.array(f, "<u2").tobytes())) for i, f in enumerate(files)]
    got = sorted(map(tuple, token_files.scan_token_files(spark.createDataFrame(rows, "file long, content binary"), 9, 2, block).collect()))
    want = []
    for i, f in enumerate(files):
        start = k = 0
        for at, t in enumerate(f):
            if t == 9:
                want.append((i, k, start, at - start))
                start, k = at + 1, k + 1
        if start < len(f):
            want.append((i, k, start, len(f) - start))
    assert got == want


def test_real_files_are_read(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([1, 2, 9, 3], "<u2").tobytes())
    got = token_files.scan_token_files(token_files.read_token_files(spark, str(tmp_path)), 9).collect()
    assert sorted((r["ordinal"], r["n_tokens"]) for r in got) == [(0, 2), (1, 1)]


# pages


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><a href=/>menu</a></nav><div class="ad-box ad">buy</div><div class="post-{n}"><h2>H&eacute; {n}</h2><p>Some  <b>bo</b>ld text,<br>more &amp; more, long enough.
<p>Second one of the page.<ul><li>one<li>two</ul><div class="comments"><p>{c}</p></div><form><input>send</form></div>
<aside>side</aside><div id="cookie-notice">we use</div><footer>foot</footer></body></html>"""


def test_page_without_its_furniture():
    assert Page(PAGE.format(n=12, c="c" * 900)).text(None) == "Hé 12 Some bold text, more & more, long enough. Second one of the page. one two"
    assert Page("").text(None) == "" and Page("<nav>only</nav>").text(None) == ""
    assert Page("<nav>menu<article><p>text</p></article>").text(None) == "text"
    assert Page('<div class="siteHeader">h</div><div class="adBox-3">b</div><div class="main-content"><p>text here</p><div id="userComments">c</div></div>').text(None) == "text here"
    assert Page("plain <b>te").text(None) == "plain te"
    assert Page("<article><h1>T</h1><div><p>body text</p></div></article><p>after</p>").text(None) == "T body text"


def test_words_decide_nothing_inside_an_article():
    kept = '<p class="share-price">The price rose.</p><p class="search-results">What was found.</p><div class="related-work"><p>Others did it too.</p></div><p>Tail.</p>'
    gone = '<div class="related-links">x</div><div class="social-share">x</div><div id="comments">x</div><div class="adBox-2">x</div>'
    want = "The price rose. What was found. Others did it too. Tail."
    assert Page(f"<article>{kept}{gone}</article>").text(None) == want
    for around in ("content-with-sidebar", "post comments-open", "search-page"):
        assert Page(f'<div class="{around}"><article>{kept}</article></div>').text(None) == want
        assert Page(f'<article class="{around}">{kept}</article>').text(None) == want
    assert Page('<div hidden><article><p>no</p></article></div><p>yes</p>').text(None) == "yes"


def test_deep_containers_have_paths_of_their_own():
    page = Page("<div>" * 12 + "inner " * 20 + "</div>" * 11 + "outer</div>")
    assert len(set(page.paths)) == len(page.paths) == 13
    assert page.text(page.best()).startswith("inner") and "outer" not in page.text(page.paths[-1])


def test_long_page():
    body = "A sentence of the page. " * 100_000
    assert Page(f"<nav>menu</nav><article><p>{body}</p></article>").text(None) == body.strip()


def test_article_in_parts_is_whole():
    lead, body = "A lead of some words. " * 5, "The body goes on and on. " * 20
    source = f"<body><div class=top><a href=/>Home</a> <a href=/x>More of it</a></div><div class=post><h1>Headline</h1><div class=lead><p>{lead}</p></div><div class=body><p>{body}</p></div></div></body>"
    page = Page(source)
    whole = " ".join(f"Headline {lead} {body}".split())
    assert page.text(page.best()) == page.text(None) == whole
    # an empty container of the host's path doesn't stand for the page
    other = Page(f"<body><div class=story></div><div class=post><h1>Headline</h1><p>{body}</p></div></body>")
    assert other.text(next(p for p in other.paths if "div.story" in p)) == " ".join(f"Headline {body}".split())


def test_hosts_agree_on_a_path(spark):
    rows = [(i, f"http://h.com/{i}", PAGE.format(n=i, c="c")) for i in range(4)]
    # on this page another part is longer, yet the host's path wins
    rows.append((4, "http://h.com/4", '<body><div class="post-9"><p>short</p></div><div class="archive"><p>' + "z" * 500 + "</p></div>"))
    rows += [(5, None, None), (6, "nohost", "<p>x</p>"), (6, "nohost", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("text", F.lit("t"))
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    assert got[4]["text"] == "short" and got[5]["text"] == "" and got[6]["text"] == "x"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.main_text(pages).count() == 8 and html_text.main_text(pages.limit(0)).count() == 0
    assert html_text.main_text(pages, broadcast_bytes=0).count() == 8


# urls


def test_url_rules(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    asked = ["http://EXAMPLE.com/en/x?a#b", "https://www.example.com/en/", "http://m.www.example.com/en/1", "http://example.com", "http://example.com/", "http://a.net/es/q", "http://net/es/", "http://anet/es/", "x", None, "http://a.net/ES/", "ftp://É.com/en/", "http://h.org/p?://x"]
    want = ["example.com/en/", "www.example.com/en/", "www.example.com/en/", None, "com/", "net/es/", "net/es/", None, None, None, None, "com/", None]
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(asked)], "page_id long, url string, rule string")
    got = sorted(urls.judge_urls(df, rules).collect(), key=lambda r: r["page_id"])
    assert [r["rule"] for r in got] == want
    assert [r["verdict"] for r in got] == ["block" if w in ("example.com/en/", "net/es/") else "allow" for w in want]
    assert got[0]["host"] == "example.com" and got[0]["path"] == "/en/x" and got[9]["host"] == "" == got[9]["path"]
    long = urls.candidates("a." * 100_000 + "com", "/" * 100_000, [1], 3)
    assert long == ["a.a.com/", "a.com/", "com/"] and urls.candidates("com", "/x", [1], 3) == ["com/"]
    assert urls.judge_urls(df.limit(0), rules).count() == 0 and urls.judge_urls(df, []).where("verdict = 'allow'").count() == len(asked)


def test_equal_digests_are_told_apart():
    same = lambda s: 5
    array = urls.DigestArray.build([("a/", "allow"), ("b/", "block"), ("c/", "block")], same)
    array = urls.DigestArray.mapped(array.packed())
    assert [None if i < 0 else array.rule(i) for i in array.find(["b/", "x/", "c/", "a/"], same).tolist()] == ["b/", None, "c/", "a/"]


# media


def test_media_round_trip(spark, corpus, tmp_path):
    rows = {r["doc_id"]: r for r in media.media_columns(docs_of(spark, corpus), digests=True).collect()}
    real = {r["doc_id"]: r for r in media.media_columns(docs_of(spark, corpus)).collect()}
    for i, t in enumerate(corpus):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        (tmp_path / "x.wav").write_bytes(real[i]["media"])
        with wave.open(str(tmp_path / "x.wav")) as w:
            assert w.readframes(w.getnframes()) == payload and w.getsampwidth() == 1
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(real[i]["media"]), hashlib.sha256(real[i]["media"]).hexdigest())
        assert r["n_codes"] == len(real[i]["fingerprint"])
    assert rows[0]["feature"] == rows[75]["feature"] != rows[1]["feature"]  # row 75 is a copy of row 0
    assert media.media_columns(docs_of(spark, [])).count() == 0


def test_long_text_in_stretches(monkeypatch):
    data = media.payload_of(bytes(random.Random(1).randrange(256) for _ in range(20_000)))
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "AT_ONCE", 7)
    assert (media.fingerprint(data) == whole).all() and len(whole)


def test_short_texts_have_codes_of_their_own():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(n)).encode()[: media.BLOCK] for n in range(3, 83)]
    found = [media.fingerprint(media.payload_of(t)) for t in texts]
    assert all(map(len, found)) and len({f.tobytes() for f in found}) == len(set(texts))
    # one character at either end of a block, and the faintest lead byte
    assert all(len(media.fingerprint(x)) for x in (media.payload_of(b"a"), media.payload_of("\U00100000".encode()), b"\xff" * 575 + b"a"))
    assert not len(media.fingerprint(media.payload_of(b"")))  # a constant sound has no peaks


# fingerprints


def slow_fingerprint(text, k=4):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_near_duplicates(spark, corpus):
    texts = corpus + [None, "", "W1 W2 W3", "w1\tw2\vw3"] + [" ".join(corpus[0].split()[:-1])]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [slow_fingerprint(t or "") for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == prints
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = roots(links, range(len(texts)))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    same = docs_of(spark, ["a b c"] * 4, [5, 5, None, 6])
    assert {r["component_id"] for r in simhash.near_duplicates(same).collect()} == {5}

@pytest.mark.parametrize("component", [simhash.COMPONENT, 50])
def test_one_of_each(spark, corpus, component, monkeypatch):
    monkeypatch.setattr(simhash.leaders, "__defaults__", (component,))
    rng = random.Random(9)
    texts = [*corpus, None, "  ", "\xa0"]
    for t in [t for t in corpus[:40] if t and len(t.split()) > 80]:
        words = t.split()
        for _ in range(3):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    df = docs_of(spark, texts)
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    sets = [set(simhash.shingle_set(t or "", 5).tolist()) for t in texts]
    like = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    gone = [i for i in range(len(texts)) if i not in set(kept)]
    assert all(any(like(i, j) for j in kept if j < i) for i in gone)  # no clean document goes
    near = [i for i in range(len(texts)) if any(like(i, j) for j in range(i))]
    assert len(set(near) & set(gone)) >= 0.95 * len(near)
    same = docs_of(spark, ["a b c"] * 4, [5, 5, None, 6])
    assert sorted(str(r["doc_id"]) for r in simhash.one_of_each(same).collect()) == ["5", "None"]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_finds_texts_just_alike_enough(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(80):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts.append(" ".join(words))
        for at in range(20, 180, 40):  # each changes five shingles of 196: 176 of 216 are left in common
            words[at] = "changed"
        texts.append(" ".join(words))
    sets = [set(simhash.shingle_set(t, 5).tolist()) for t in texts]
    assert all(0.8 <= len(a & b) / len(a | b) < 0.85 for a, b in zip(sets[::2], sets[1::2], strict=True))
    kept = sorted(r["doc_id"] for r in simhash.one_of_each(docs_of(spark, texts)).collect())
    assert kept == list(range(0, 160, 2))


def test_one_of_each_judges_rows_by_their_own_text(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    df = docs_of(spark, [one, two, one, three, three, three + " d", three + " d", None], [1, 1, 2, None, None, None, None, 3])
    for x in (df, df.withColumn("doc_id", F.col("doc_id").cast("string"))):
        kept = [(None if r["doc_id"] is None else int(r["doc_id"]), r["text"]) for r in simhash.one_of_each(x).collect()]
        named, unnamed = [k for k in kept if k[0] is not None], [k for k in kept if k[0] is None]
        assert sorted(named, key=str) == sorted([(1, one), (1, two), (3, None)], key=str)
        assert len(unnamed) == 1 and unnamed[0][1].startswith(three)


@pytest.mark.parametrize(("radius", "slice_rows"), [(0, 100), (1, 5), (4, 3), (8, 16_384)])
def test_links_join_all_that_are_near(spark, radius, slice_rows):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    found = {0, (1 << 64) - 1}
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, radius + 2)).tolist():
                x ^= 1 << bit
            found.add(x)
    fps = sorted(found)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, radius, slice_rows).collect()]
    want = roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius], fps)
    assert roots(links, fps) == want


@pytest.mark.parametrize("radius", [4, 10])
def test_a_large_group_has_about_one_link_a_member(spark, radius):
    rng = np.random.default_rng(5)
    found = {0x123456789ABCDEF}
    while len(found) < 2000:
        x = 0x123456789ABCDEF
        for bit in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
            x ^= 1 << bit
        found.add(x)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in found], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.links(df, radius).collect()]
    assert len(links) <= 1.2 * len(found)
    assert len(set(roots(links, {x - (1 << 64) if x >> 63 else x for x in found}).values())) == 1


@pytest.mark.parametrize(("agree", "dealt", "slice_rows"), [(1, 1, 1 << 20), (3, 1, 1 << 20), (4, 1, 10), (4, 2, 1 << 20), (3, 3, 1 << 20)])
def test_choices_of_blocks_join_all_that_are_near(spark, agree, dealt, slice_rows):
    rng = np.random.default_rng(agree)
    found = set(rng.integers(0, 1 << 63, 200, np.uint64).tolist()) | {0, (1 << 64) - 1}
    for b in list(found)[:20]:
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 14), replace=False).tolist():
                x ^= 1 << bit
            found.add(x)
    fps = sorted(found)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, x) for x in signed], "fp long, label long")
    made = simhash.block_links(df, simhash.first_keys(agree, dealt, 10), simhash._by_choices(agree, dealt, 10), slice_rows, 1)
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in made.collect()]
    want = roots([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 10], fps)
    assert roots(links, fps) == want


def test_what_is_dealt_does_not_grow_with_the_fingerprints(spark):
    for n in (250_000, 2_800_000, 8_000_000):  # 0.5, 6 and 17 GB of check_l's documents; 66 and 286 keys before
        agree, dealt = simhash.choices(n, 10)
        assert len(simhash.first_keys(agree, dealt, 10)) == 11


def test_shards_meet_whatever_number_of_blocks_agrees():
    assert [simhash.agreeing(n, 4) for n in (1_000, 100_000_000)] == [1, 2]
    for agree in (1, 2, 3):
        blocks = simhash.bit_blocks(4 + agree)
        assert blocks[0][0] == 0 and sum(w for _, w in blocks) == 64


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)]
    nodes = sorted({x for ab in links for x in ab})
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(links, nodes)
    assert {n: got.get(n, n) for n in nodes} == want
    assert stars(spark.createDataFrame([], "a long, b long")).count() == 0


# packing


def test_packing(spark, corpus):
    path = vocabulary("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    texts = corpus + ["It's <|endoftext|> ÀÉß İstanbul 日本 x\x1cy\x85z", "word " * 9000]
    df = docs_of(spark, texts).unionByName(docs_of(spark, texts[:3]))
    rows = packing.pack(df, path, keep_ids=True).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for held in by.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        times = 2 if i < 3 else 1
        assert [x for r in mine[::times] for x in r["ids"]] == ids and len(mine) == times * -(-len(ids) // 4096)
        for r in mine:
            part = ids[r["start"] : r["start"] + 4096]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert packing.pack(docs_of(spark, []), path).count() == 0


def test_placing_leaves_ids_in_the_jvm(spark):
    cut = spark.createDataFrame([(i, 0, 0, 3, i, [7, 8, i]) for i in range(40)], "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")
    placed = packing.pack_pieces(cut, 8)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython ") == 1
    rows = placed.collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [7, 8, i] for i in range(40)}
    assert {(r.sequence_id, r.offset) for r in rows} == {(s, o) for s in range(20) for o in (0, 3)}


def fewest(sizes, capacity):
    """Exhaustive: bins needed."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + sizes[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    left = dict(counts)
    fixed = packing.reduce_dominated(left, capacity)
    rest = sorted((s for s, n in left.items() for _ in range(n)), reverse=True)
    assert sum(k[0] for k in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)
    packed = {}
    for many, held in packing.plan(counts, capacity):
        assert sum(s * n for s, n in held) <= capacity
        for s, n in held:
            packed[s] = packed.get(s, 0) + many * n
    assert packed == counts


# toxicity


def test_toxicity(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 120))]
        if i % 6 == 0:
            for _ in range(rng.randrange(1, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilex", "grossy", "zonkful"]))
        texts.append(" ".join(words))
        labels.append((i, int(i % 6 == 0)))
    df = docs_of(spark, texts + [None, ""])
    known = spark.createDataFrame([x for x in labels if x[0] < 400] + [(None, 1), (3, None), (9999, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, known)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 2
    got = {r["doc_id"]: r for r in toxicity.severity(df.withColumn("grade", F.lit("z")), model).collect()}
    held_out = [i for i in range(400, 600)]
    assert sum(got[i]["rejected"] == (i % 6 == 0) for i in held_out) >= 196
    assert not got[600]["rejected"] and not got[601]["rejected"]
    assert toxicity.severity(df.limit(0), model).count() == 0
    none = toxicity.train(df, known.where("toxic = 0"))
    assert toxicity.severity(df, none).where("rejected").count() == 0


def test_ordinal_shares_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    z = x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.logistic(size=3000)
    w, t = toxicity.fit_ordinal(x, (z > 0).astype(int) + (z > 2), 3)
    assert np.allclose(w, [2, -1, 0, 0.5], atol=0.25) and np.allclose(t, [0, 2], atol=0.3)


# repeated passages


def slow_removal(docs, length=100):
    """(bytes, covered) per document in order of id."""
    seen, out = set(), {}
    for key, data in sorted(docs.items()):
        cover = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                cover[i : i + length] = b"\1" * length
            seen.add(part)
        out[key] = bytes(cover)
    return out


def check_removal(spark, texts, **how):
    rows = suffix_dedup.removed_spans(docs_of(spark, texts), **how).collect()
    want = slow_removal({i: (t or "").encode() for i, t in enumerate(texts)}, how.get("length", 100))
    for r in rows:
        cover = bytearray(len(want[r["doc_id"]]))
        for s in r["spans"]:
            cover[s["start"] : s["stop"]] = b"\1" * (s["stop"] - s["start"])
        assert bytes(cover) == want[r["doc_id"]], r["doc_id"]


def test_removal_is_exact(spark, corpus):
    check_removal(spark, corpus)


@pytest.mark.parametrize("seed", range(3))
def test_removal_with_few_letters(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 50)
    monkeypatch.setattr(suffix_dedup, "SHARED", 3)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 200)
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab" if seed else "abé") for _ in range(rng.randrange(0, 90))) for _ in range(25)]
    texts += [rng.choice(texts) + rng.choice(texts) for _ in range(10)] + ["a" * 60]
    check_removal(spark, texts, length=12, trigger=5)


def test_removal_of_repeated_rows(spark):
    long, other = "x" + "abcdefghij" * 5 + "0123456789" * 7, "unlike " + "klmnopqrst" * 2 + "uvwxyz" * 20
    df = docs_of(spark, [long, long, other, long, None], [1, 1, 1, None, 2])
    got = {(r["doc_id"], r["text"]): r["spans"] for r in suffix_dedup.removed_spans(df).collect()}
    assert len(suffix_dedup.removed_spans(df).collect()) == 5
    assert [(s["start"], s["stop"]) for s in got[None, long]] == [(0, len(long.encode()))]
    left = suffix_dedup.without_repeats(df)
    assert left.columns == df.columns and {r["text"] for r in left.collect() if r["doc_id"] is None} == {""}
    assert suffix_dedup.digests(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize(("parts", "shared"), [(1, 20_000), (4, 20_000), (4, 1)])
def test_first_row_loses_nothing_to_its_own_repeats(spark, corpus, parts, shared, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARED", shared)
    texts = [t for t in dict.fromkeys(corpus) if t]
    want = slow_removal({i: t.encode() for i, t in enumerate(texts)})
    df = docs_of(spark, texts * 3, [*range(len(texts))] * 3).repartition(parts)
    rows = suffix_dedup.removed_spans(df).collect()
    assert len(rows) == 3 * len(texts)
    for r in rows:
        cover = bytearray(len(want[r["doc_id"]]))
        for x in r["spans"]:
            cover[x["start"] : x["stop"]] = b"\1" * (x["stop"] - x["start"])
        assert bytes(cover) == want[r["doc_id"]], r["doc_id"]
    assert all(r["spans"] == [] for r in rows if r["doc_id"] == 0)
    unnamed = suffix_dedup.without_repeats(docs_of(spark, [texts[0]] * 2, [None, None]))
    assert {r["text"] for r in unnamed.collect()} == {texts[0]}


def test_ranks_are_those_of_sorted_suffixes():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    ranks = suffix_dedup.suffix_ranks(data, 12)
    parts = [bytes(data[i : i + 12]).ljust(12, b"\0") for i in range(len(data))]
    order = sorted(set(parts))
    assert ranks.tolist() == [order.index(p) for p in parts]


# mixing


def test_mix(spark):
    texts = ["w " * n for n in (10, 20, 30, 5, 0, 7, 100)] + [None]
    sources = ["b", "a", "a", "c", "d", None, "é", "a"]
    rows = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    sizes = {"b": 10, "a": 50, "c": 5, "d": 0, None: 7, "é": 100}
    weights = dict(zip(["a", "b", "c", "d", "é", None], [3, 1, 2, 3, 1, 2], strict=True))
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["copies"] <= 2
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate) <= r["copies"] <= int(rate) + 1
    again = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    out = mixing.emit(docs_of(spark, texts, sources=sources))
    assert out.columns == docs_of(spark, []).columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs_of(spark, [])).count() == 0 == mixing.emit(docs_of(spark, [])).count()


def test_mix_comes_near_its_targets(spark):
    texts = ["w " * (i % 17) for i in range(6000)]
    rows = mixing.mix(docs_of(spark, texts, sources=[f"s{i % 5}" for i in range(6000)])).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r["n"] / r["t"] - 1) < 0.06 for r in rows)


def test_rows_without_id_draw_on_their_own(spark):
    rows = mixing.mix(docs_of(spark, [f"{i} " + "w " * 20 for i in range(400)] + ["x " * 20] * 3, [None] * 403, ["a"] * 400 + ["b"] * 3)).where("source = 'a'").collect()
    assert len({r["copies"] for r in rows}) == 2


# the stages, with columns that clash


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns_of_any_name(spark, tmp_path, empty):
    import corpus_pipeline as p

    words = [f"word{i}" for i in range(300)]
    rng = random.Random(1)
    texts = [None, "", "", " ", "same text here"] + ["same text here"] * 2 + [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 80, 200, 30_000)]
    ids = [1, 2, 3, 4, 5, 5, None, 7, 8, 9, 10]
    names = ["grade", "rejected", "severity", "_source", "_size", "_target", "draw", "row", "label", "node", "spans", "fp", "shard", "target", "path", "host"]
    df = docs_of(spark, texts, ids, [None, "a", "b", "b", "b", "b", "a", "a", "a", "b", "b"])
    df = df.select("*", *[F.lit(n).alias(n) for n in names if n not in df.columns])
    df = df.limit(0) if empty else df
    spark.createDataFrame([(8, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int").limit(0 if empty else 2).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, df, str(tmp_path))
        rows = out.collect()
        if empty:
            assert rows == []
        if name == "best_fit_packing":
            continue
        assert out.schema.names == df.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
        assert all(r["grade"] == "grade" and r["_source"] == "_source" and r["spans"] == "spans" for r in rows)
        if not empty:
            assert {r["doc_id"] for r in rows} >= {9, 10} if name != "source_mixing" else rows
