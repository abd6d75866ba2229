import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from editloom.llm import mixing, queries, url_filter, vector_dedup, warc
from editloom.llm.records import open_store
from tests.llm.helpers import WORD, empty_documents, frame, odd_documents, plain_mix

RULES = "verdict string, host string, path string"


def test_mix_equals_its_sql_and_meets_targets(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 40, 300])), "en", draw.choice(["a", "a", "a", "b", "c", "d", None]), 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed(docs).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "int64"}))
    want = con.execute(queries.ORACLE["op5_mixing"]).df()
    a, b = (d.sort_values("doc_id").reset_index(drop=True)[sorted(d.columns)].astype("float64") for d in (got, want))
    assert np.allclose(a, b, equal_nan=True)
    assert (got.taken <= 2 * got["size"]).all() and got["size"].tolist() == [len(WORD.findall(r[1])) for r in sorted(rows, key=lambda r: got.doc_id.tolist().index(r[0]))]
    names = {r[0]: r[3] for r in rows}
    sums = got.assign(source=got.doc_id.map(lambda i: str(names[i]))).groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(sums.taken - sums.target) <= mixing.PACKET).all() and sums.taken.sum() == int(1.5 * got["size"].sum()) and abs(sums.target.sum() - 1.5 * got["size"].sum()) < 1e-6
    assert (sums.target <= 2 * sums.source_size + 1e-9).all()
    share = sums.target / got["size"].sum()
    free = sums.target < 2 * sums.source_size - 1e-9
    level = [t / w for (s, t), w in zip(sums.target.items(), [{"a": 3, "b": 1, "c": 2, "d": 3, "None": 1}[s] for s in sums.index]) if free[s]]
    assert len(share) == 5 and max(level) - min(level) < 1e-6


def test_mix_positions_run_through_the_whole_mix(spark):
    docs = frame(spark, [(i, "w " * (i % 9), ) for i in range(200)])
    rows = mixing.mixed(docs, epochs=1, budget=0.5).where("taken > 0").orderBy("position").collect()
    at = 0
    for r in rows:
        assert r.position == at
        at += r.taken


@pytest.mark.parametrize("packet", [7, 128])
def test_mix_is_the_merged_order_cut_at_the_budget(spark, packet):
    draw = random.Random(5)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 40, 300])), draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.taken for r in mixing.mixed(docs, packet=packet).collect()}
    assert got == plain_mix(rows, packet)
    other = {r.doc_id: r.taken for r in mixing.mixed(docs, packet=packet, seed="another").collect()}
    assert other == plain_mix(rows, packet, seed="another") and other != got
    copies = {}
    for r in mixing.mix_copies(docs, packet=packet).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    sizes = {i: len(WORD.findall(t)) for i, t, _ in rows}
    assert all(abs(copies.get(i, 0) - got[i] / sizes[i]) <= 1 for i in sizes if sizes[i]) and all(copies[i] == 1 for i in sizes if not sizes[i])
    served = sum(sizes[i] * n for i, n in copies.items())
    assert abs(served - sum(got.values())) < 5 * 300


def test_mix_copies_and_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mixed(docs).collect()
    assert len(rows) == 9 and {r.taken for r in rows if r["size"] == 0} == {0} and {r.position for r in rows if r["size"] == 0} == {None}
    copies = mixing.mix_copies(docs)
    assert copies.columns == docs.columns and {r.doc_id for r in copies.collect()} >= {2, 3, 4}
    assert mixing.mixed(empty_documents(spark)).count() == 0 and mixing.mix_copies(empty_documents(spark)).count() == 0


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fit = [(len(h) + len(p), len(h), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[4], max(fit)[3]) if fit else (host, path, None, default)


@pytest.mark.parametrize("broadcast", [100, 0])
def test_urls_against_a_plain_judge(spark, broadcast):
    draw = random.Random(1)
    rules = [*url_filter.RULES, ("block", "org", ""), ("allow", "a.org", "/p"), ("block", "b.a.org", "/p/q"), ("block", "x.y.z.com", "/1/2/3/4/")]
    hosts = ["com", "Example.com", "www.example.com", "a.www.example.com", "net", "m.net", "xnet", "a..com", ".com", "b.a.org", "a.org", "org.", "x.y.z.com", "w.x.y.z.com", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/1", "/p", "/pq", "/p/q", "/p/q/r", "//", "/1/2/3/4/5", "/é"]
    urls = [f"{draw.choice(['http://', 'HTTPS://', '', 'x://'])}{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '?a=/en/', '#/en/', '?x#y'])}" for _ in range(500)]
    urls += [None, "", "no scheme/en/", "http://", "http://a://b/en/", "http://exa\nmple.com/\nen/", "http://" + "a." * 300 + "com/" + "b/" * 300]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.unionByName(pages.where("page_id < 5")).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    found = url_filter.judged(pages, spark.createDataFrame(rules, RULES), broadcast_rules=broadcast).collect()
    assert len(found) == len(urls) + 5
    for r in found:
        assert (r.host, r.path, r.rule, r.verdict) == judge(urls[r.page_id], rules)


def test_urls_of_an_empty_table_or_without_rules(spark):
    rules = spark.createDataFrame([], RULES)
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judged(pages, rules, "block").collect()[0].verdict == "block"
    assert url_filter.judged(pages.limit(0), rules).count() == 0


PAGES = [
    (7, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "http://b\r\nX: y/", "é" * 5000), (2, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "x" * 100_001), (3, "http://a/2", "same"),
]


@pytest.mark.parametrize("chunk", [7000, 1 << 18])
def test_archives_give_the_pages_back(spark, chunk):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("number", F.lit(0)).repartition(3)
    manifest = warc.archived(pages, chunk=chunk)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest).collect()), key=str)
    first = {"same": 3, "": 2}
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        refers = first.get(html or "")
        refers = refers if refers is not None and refers != page else None
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)
    for row in manifest.collect():
        store, path = open_store(row.file)
        with store.open_input_stream(path) as f:
            text = gzip.decompress(f.read())
        assert text.count(b"WARC/1.1\r\n") == row.records and b"X: y/" not in [line.strip() for line in text.split(b"\r\n")]


def test_small_payloads_are_never_revisits_and_damage_is_found(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.archived(pages, least_bytes=10)
    assert {r.record_type for r in warc.read_archives(manifest).collect()} == {"response"}
    assert warc.read_archives(warc.archived(pages.limit(0))).count() == 0
    import io

    record = warc.header({"name": "<urn:loom:page:1:0-0>", "url": "u", "bytes": 4, "sha1": hashlib.sha1(b"same").hexdigest(), "refers": None}) + b"sane\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(record))))


def test_record_names_are_unique_and_revisits_are_held_against_their_response(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    found = warc.read_records(warc.archived(pages)).collect()
    assert len({r.name for r in found}) == len(PAGES) and {r.refers for r in found if r.refers} <= {r.name for r in found if not r.refers}
    wrong = warc.decided(warc.write_chunks(pages)).withColumn("refers", F.when(F.col("page_id") == 5, "<urn:loom:page:1:0-0>").otherwise(F.col("refers")))
    with pytest.raises(Exception, match="no response with the payload"):
        warc.read_archives(warc.write_archives(wrong)).collect()


def test_chunks_carry_digests_and_a_payload_of_200_mb_passes(spark):
    rows = list(warc.chunk_rows(memoryview(b"abcdefgh"), 3, 3))
    assert [(r[1], bytes(r[5]), r[4]) for r in rows] == [(0, b"abc", False), (1, b"def", False), (2, b"gh", True)]
    assert [r[3] for r in rows] == [hashlib.sha1(b"abcdefgh"[:n]).digest() for n in (3, 6, 8)] and rows[-1][2] == 8
    pages = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat('0123456789abcdefghij', 10000000)").alias("html"))
    row = warc.read_archives(warc.archived(pages)).first()
    seen = hashlib.sha1()
    for _ in range(100):
        seen.update(b"0123456789abcdefghij" * 100_000)
    assert row.payload_bytes == 200_000_000 and row.payload_digest == base64.b32encode(seen.digest()).decode()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_vectors_against_brute_force(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((1500, 32))
    x[100:130] = x[100] + 0.25 * draw.standard_normal((30, 32))
    x[200:1100] = x[200] + 0.15 * draw.standard_normal((900, 32))  # a dense group beyond a leaf
    x[1200:1203] = x[1200]
    x[1203] = 2 * x[1200]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in vector_dedup.vector_components(vectors(spark, rows), leaf=64).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.9 * near.sum()
    assert [found[i] for i in (1200, 1201, 1202, 1203)] == [3, 3, 3, 3] and got[1203].component_id == 1200
    assert all(got[i].component_id == 100 for i in range(100, 130) if near[i, 100])
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (2, [1.0, 0.0], None), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [None, 1.0], 0),
        (9, [1.0, 0.1], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0), (12, [-0.0, 1.0], 0), (13, [0.0, 1.0], 0),
        (14, [1.0, 0.1, 0.0], 0), (15, [1e200, 0.0, 1e200], 0), (16, [1e200, 1e199, 1e200], 0), (17, [1e-300, 0.0, -1e-300, 0.0], 0), (18, [2e-320, 0.0, -2e-320, 0.0], 0),
        (20, [0.0, 1.0], 0), (20, [5.0, 5.0], 0), (19, [5.0, 5.1], 0),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_components(vectors(spark, rows).withColumn("digest", F.lit(1))).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (9, 3, 1, False), (12, 2, 12, True), (13, 2, 12, False), (20, 2, 12, False), (None, 0, None, True)]
    # Vectors of each length link among themselves, however large or small; of a vec_id given twice each vector is judged.
    want += [(10, 1, 10, True), (14, 1, 10, False), (15, 1, 15, True), (16, 1, 15, False), (17, 1, 17, True), (18, 1, 17, False), (19, 1, 19, True), (20, 1, 19, False)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 11)]
    assert got == sorted(want, key=str)
    assert vector_dedup.vector_components(vectors(spark, [])).count() == 0
