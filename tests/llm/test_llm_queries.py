"""Registered queries against SQL or brute force on the smallest tables, the pipeline, and the graph search."""

import hashlib
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from oracle import rows_of_spark, rows_of_sql

from conftest import SF
from runloom.llm import hnsw
from runloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    got, columns = rows_of_spark(QUERIES[name](spark, SF))
    want, names = rows_of_sql(ORACLES[name], SF)
    assert columns == names and got == want and got


class Article(HTMLParser):
    """The blocks of a page's article elements, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = 0, [""]
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag != "b":
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag != "b":
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_main_text_is_that_of_the_article(spark, sf):
    got = {r["page_id"]: r for r in QUERIES["op2_main_text"](spark, sf).collect()}
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for page in pages:
        want = " ".join(" ".join(b.split()) for b in Article(page["html"]).blocks if b.strip())
        r = got[page["page_id"]]
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), page["url"])


def documents():
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def test_near_duplicates_are_those_of_all_pairs(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_simhash_bk"](spark, SF).collect()}
    prints = {}
    for i, text in documents():
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    for _ in range(3):  # labels run through links until they rest
        for i in sorted(prints):
            for j in sorted(prints):
                if (prints[i] ^ prints[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_removed_bytes_are_those_of_a_set_of_all_strings(spark):
    got = {r["doc_id"]: r for r in QUERIES["op8_prefix_free_dedup"](spark, SF).collect()}
    seen = set()
    for i, text in sorted(documents()):
        data = text.encode()
        cover = bytearray(len(data))
        for at in range(len(data) - 99):
            part = data[at : at + 100]
            if part in seen:
                cover[at : at + 100] = b"\1" * 100
            seen.add(part)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        runs = len(re.findall(b"\1+", bytes(cover)))
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())


def test_severity_is_that_of_the_model(spark):
    """Every row of the registered query from the fitted weights by plain sums; and held-out labels."""
    from runloom.llm import toxicity

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_toxicity_ordinal"](spark, sf).collect()}
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    weight = dict(zip(model.names, model.weights, strict=True))
    for row in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\W\d_]+", (row["text"] or "").lower())
        counts = Counter(words) + Counter("^" + w[:k] for w in words for k in (4, 5, 6, 7) if len(w) > k)
        score = sum(w * np.log1p(1000 * counts[f] / max(len(words), 150)) for f, w in weight.items() if counts[f])
        chances = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        r = got[row["doc_id"]]
        assert abs(r["severity"] - sum(chances)) < 2e-6
        assert (r["grade"], r["rejected"]) == (sum(c >= 0.5 for c in chances), chances[0] >= 0.5)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    part = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    told = {r["doc_id"]: r["rejected"] for r in toxicity.severity(docs.where("doc_id % 3 = 0"), part).collect() if r["doc_id"] in known}
    clean = [told[i] for i in told if not known[i]]
    assert sum(clean) <= 0.02 * len(clean)


def exact(ids, vectors, every, k):
    found = {}
    for i, q in zip(ids, vectors, strict=True):
        if i % every == 0:
            score = vectors @ q
            order = np.lexsort((ids, -score))
            found[i] = [int(ids[j]) for j in order if ids[j] != i][:k]
    return found


def test_nearest(spark):
    got = QUERIES["op9_hnsw_shards"](spark, SF).collect()
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    want, mine = exact(ids, x, 20, 20), {}
    for r in got:
        mine.setdefault(r["query_id"], []).append(r)
    assert set(mine) == set(want)
    place = {int(i): j for j, i in enumerate(ids)}
    for q, rows in mine.items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in [r["vec_id"] for r in rows]
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        assert all(abs(r["score"] - x[place[q]] @ x[place[r["vec_id"]]]) < 1e-12 for r in rows)
    assert np.mean([len(set(want[q]) & {r["vec_id"] for r in mine[q]}) / 20 for q in want]) >= 0.9


def test_nearest_over_many_shards_of_uneven_norms(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in hnsw.nearest(df, every=20, k=20, shard_rows=300).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(np.arange(1500), x, 20, 20)
    assert np.mean([len(set(want[q]) & got[q]) / 20 for q in want]) >= 0.9


def test_nearest_takes_no_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(df).collect())
    assert got == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 7, 1.0)]
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        rows = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(rows) <= before and rows
        if name != "source_mixing":
            assert len(rows) == len(set(rows)), name
    whole = p.run(spark, SF)
    assert whole.count() >= docs.count() > 0
    assert whole.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0


def test_pipeline_packs_tokens(spark):
    import zlib

    import numpy as np

    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    rows = sorted(p.packed(spark, docs, SF).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
    at = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
