import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from editloom.llm import merkle
from tests.llm.helpers import LOWER, empty_documents, frame, odd_documents


def plain_leaf(r, change=lambda t: t):
    out = ""
    for name in merkle.FIELDS:
        v = r[name] if name != "text" or r[name] is None else change(r[name])
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return hashlib.sha256(out.encode()).hexdigest()


def plain_tree(nodes, arity=8):
    """The levels of a tree as lists."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashlib.sha256("".join(last[i : i + arity]).encode()).hexdigest() for i in range(0, len(last), arity)])
    return levels


def plain_path(levels, at, arity=8):
    out = []
    for level in levels[:-1]:
        run = level[at // arity * arity : at // arity * arity + arity]
        out.append((at % arity, run[: at % arity] + run[at % arity + 1 :]))
        at //= arity
    return out


def plain_manifest(rows, arity=8):
    """(doc_id, leaf, subroot, root, path) of every row."""
    groups = {}
    for r in rows:
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
    trees = {g: (sorted(v), plain_tree([d for *_, d in sorted(v)], arity)) for g, v in groups.items()}
    names = sorted(trees)
    top = plain_tree([trees[g][1][-1][0] for g in names], arity)
    return sorted(
        ((i if has else None, d, levels[-1][0], top[-1][0], plain_path(levels, at, arity) + plain_path(top, names.index(g), arity)) for g, (leaves, levels) in trees.items() for at, (has, i, d) in enumerate(leaves)), key=str
    )


def collected(table):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.place, s.siblings) for s in r.path]) for r in table.collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_witnesses_against_a_plain_tree(spark, n):
    """More rows than a block, so that block roots are appended further; one language alone, and many."""
    texts = [(3 * i, f"Text {i % 7} É") for i in range(n)]
    docs = frame(spark, texts).repartition(3)
    many = docs.withColumn("lang", F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("l"), (F.col("doc_id") % 23).cast("string"))))
    for table in (docs, many):
        assert collected(merkle.witnesses(table)) == plain_manifest(table.collect())


def test_small_blocks_give_the_same_tree(spark):
    docs = frame(spark, [(i, f"t{i}") for i in range(300)])

    def row(m, witness):
        return m["doc_id"], merkle.fold(m["digest"].encode(), witness).decode(), merkle.packed(witness)

    told = {levels: sorted(map(tuple, merkle.witnessed(docs, "doc_id long, root string, path string", row, levels=levels).collect())) for levels in (1, 2, 5)}
    assert told[1] == told[2] == told[5]
    other = merkle.witnessed(docs, "doc_id long, root string, path string", row, arity=3, levels=2).collect()
    assert {r.root for r in other} == {plain_manifest(docs.collect(), 3)[0][3]}


def test_paths_fold_to_the_root_and_tampered_leaves_do_not(spark):
    docs = odd_documents(spark)
    table = merkle.witnesses(docs)
    assert collected(table) == plain_manifest(docs.select("doc_id", "source", "lang", "n_chars", "text").collect())
    told = table.select("root", merkle.folded(F.col("leaf"), F.col("path")).alias("good"), merkle.folded(F.sha2("leaf", 256), F.col("path")).alias("bad")).collect()
    assert all(r.good == r.root and r.bad != r.root for r in told)
    assert merkle.witnesses(empty_documents(spark)).count() == 0


def test_an_appender_extends_the_witnesses_of_earlier_leaves():
    tree = merkle.Appender(2, 3)
    first = tree.append(b"a")
    assert first.witness() == []
    tree.append(b"b"), tree.append(b"c")
    assert first.witness() == [(0, [b"b", b"c"])]
    for d in (b"d", b"e", b"f", b"g"):
        tree.append(d)
    assert len(first.witness()) == 1  # the run above is still open
    root = tree.close()
    assert len(first.witness()) == 2 and merkle.fold(b"a", first.witness()) == root.digest
    assert merkle.unpacked(merkle.packed([(1, [b"0" * 64, b"f" * 64]), (0, [])])) == [(1, [b"0" * 64, b"f" * 64]), (0, [])]


def test_the_query_against_a_plain_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    by_id = {r.doc_id: r for r in docs}
    got = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, leaf, subroot, root, path in plain_manifest(docs):
        hit = zlib.crc32(str(i).encode()) % 3 == 0
        digest = plain_leaf(by_id[i], lambda t: t.translate(LOWER)) if hit else leaf
        for place, siblings in path:
            digest = hashlib.sha256("".join([*siblings[:place], digest, *siblings[place:]]).encode()).hexdigest()
        proof = hashlib.sha256("".join(s for _, siblings in path for s in siblings).encode()).hexdigest()
        assert tuple(got[i][c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) == (leaf, subroot, root, proof, digest, digest == root)
