"""Merkle manifest of a table: one tree a group over its rows in an order, a tree over the groups' roots, and for each
row the witness that leads from it to the root.

Nodes are lowercase hex SHA-256; a parent hashes its children's digests one after another as text, ``ARITY``
consecutive ones, at the end of a level fewer. A group's tree ends when one node remains.

Witnesses grow with appends (``Appender``): nodes are appended from left to right, each level holds one open run, and
when a run is complete its members learn their siblings and get their parent. All leaves below share that parent,
so what is learned above extends the witness of each of them at once and nothing is copied.

Spark deals the appends out. Rows are numbered within their group by ranges, and each aligned block of
``ARITY**LEVELS`` of them is appended by one task. Block roots are nodes of the next stage and appended there in the
same way, until each group has one node; group roots are appended likewise. On the way back a block gets one row
with the witness of its root, which ends the witnesses of its leaves. A task holds one block; texts are hashed where
they are read and never shuffled.

Defined cases: a null in any column is written ``-``, unlike an empty text (``0:``); a null group is a group of its own,
first among the groups; a null doc_id comes first in its group; rows that repeat a doc_id are leaves each, in the order
of their digests; a group of one row has its leaf as root, and so a table of one group its root; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from editloom.llm.base import drop, save, ship, width
from editloom.llm.graph import stream_groups

ARITY, LEVELS = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE, _PATH = "grp string, pos long, n long, digest string", "grp string, pos long, path string"
Witness = list[tuple[int, list[bytes]]]


def digest_of(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(values: list[Column]) -> Column:
    """The digest of a row's values, each as ``-`` or its byte count, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


class Node:
    __slots__ = ("digest", "place", "run", "parent")

    def __init__(self, digest: bytes) -> None:
        self.digest, self.place, self.run, self.parent = digest, 0, None, None

    def witness(self) -> Witness:
        """Place among its run and siblings, level by level, as far as runs are complete."""
        out, node = [], self
        while node.parent is not None:
            out.append((node.place, [m.digest for m in node.run if m is not node]))
            node = node.parent
        return out


class Appender:
    """Aligned appends to one tree of at most ``levels`` levels."""

    def __init__(self, levels: int, arity: int = ARITY) -> None:
        self.arity, self.levels, self.open = arity, levels, [[] for _ in range(levels + 1)]

    def append(self, digest: bytes) -> Node:
        node = Node(digest)
        self._put(0, node)
        return node

    def _put(self, level: int, node: Node) -> None:
        run = self.open[level]
        node.place = len(run)
        run.append(node)
        if len(run) == self.arity and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = Node(digest_of([m.digest for m in run]))
        for m in run:
            m.run, m.parent = run, parent
        self._put(level + 1, parent)

    def close(self) -> Node:
        """The root, after the runs that are still open were completed as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0]


def depth(n: int, arity: int = ARITY) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def fold(digest: bytes, witness: Witness) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, siblings in witness:
        digest = digest_of([*siblings[:place], digest, *siblings[place:]])
    return digest


def packed(witness: Witness) -> str:
    return ",".join(f"{place}:" + b"".join(siblings).decode() for place, siblings in witness)


def unpacked(text: str) -> Witness:
    out = []
    for level in text.split(",") if text else []:
        place, siblings = level.split(":")
        out.append((int(place), [siblings[i : i + 64].encode() for i in range(0, len(siblings), 64)]))
    return out


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos``, the place of a row within its group, and ``n``, the group's rows: ranges are sorted by a
    task each and begin after the rows that earlier ranges hold of the group."""
    ranged = df.repartitionByRange(width(df.sparkSession), group, *order).sortWithinPartitions(group, *order)
    rows = save(ranged.withColumn("__at", F.monotonically_increasing_id()), name).withColumn("__range", F.shiftright("__at", 33))
    sizes = rows.groupBy(group, "__range").agg(F.count("*").alias("__size"), F.min("__at").alias("__first"))  # ranges and groups
    earlier, whole = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(group)
    base = sizes.select(group, "__range", (F.col("__first") - F.coalesce(F.sum("__size").over(earlier), F.lit(0))).alias("__base"), F.sum("__size").over(whole).alias("n"))
    return rows.join(base, [group, "__range"]).withColumn("pos", F.col("__at") - F.col("__base")).drop("__at", "__range", "__base")


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    """Rows dealt to tasks by block, a block's rows in order, blocks of a group spread from a place of its own."""
    parts = width(nodes.sparkSession)
    key = F.xxhash64("grp")
    rows = nodes.withColumns({"__grp": key, "__block": F.col("block") if "block" in nodes.columns else F.floor(F.col("pos") / size)})
    dealt = rows.repartitionById(parts, F.pmod(F.col("__grp") + F.col("__block"), F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("__grp", "grp", "__block", "pos")


def climb(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The block roots of ``nodes`` (grp, pos, n, digest), as nodes of the next stage; saved."""
    size = arity**levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            n, pos = table.column("n")[0].as_py(), table.column("pos")[0].as_py()
            tree = Appender(min(levels, depth(n, arity)), arity)
            for d in table.column("digest").to_pylist():
                tree.append(d.encode())
            row = [table.column("grp")[0].as_py()], [pos // size], [-(-n // size)], [tree.close().digest.decode()]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.string()), *(pa.array(c, pa.int64()) for c in row[1:3]), pa.array(row[3])], names=["grp", "pos", "n", "digest"])

    return save(_blocks(nodes.select("grp", "pos", "n", "digest"), size).mapInArrow(run, _NODE), "merkle-nodes")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table a block; groups whose hashes are equal are told apart by name."""
    for table in stream_groups(batches, ["__grp", "__block"]):
        names = table.column("grp").unique().to_pylist()
        for name in names:
            yield table if len(names) == 1 else table.filter(pa.compute.equal(table.column("grp"), name))


def descend(nodes: DataFrame, above: DataFrame, schema: str, rows: Callable[[dict, Witness], tuple], arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``rows`` makes an output row of each node's columns and its whole witness. ``above`` (grp, pos, path) has the
    witnesses of the nodes' block roots."""
    from pyspark.sql.pandas.types import to_arrow_schema

    size, arrow = arity**levels, to_arrow_schema(T._parse_datatype_string(schema))
    told = above.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path")
    both = nodes.withColumns({"block": F.floor(F.col("pos") / size), "path": F.lit(None).cast("string")}).unionByName(told, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            held = table.to_pylist()  # one block
            outer, members = unpacked(held[0]["path"]), held[1:]
            tree = Appender(min(levels, depth(members[0]["n"], arity)), arity)
            leaves = [tree.append(m["digest"].encode()) for m in members]
            tree.close()
            out = [rows(m, node.witness() + outer) for m, node in zip(members, leaves)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return _blocks(both, size).mapInArrow(run, schema)


def grown(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """The stages of the trees over ``nodes`` (grp, pos, n, digest): block roots, their block roots and so on, the last with
    one node a group."""
    stages = [nodes]
    most = nodes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while most > 1:
        stages.append(climb(stages[-1], arity, levels))
        most = -(-most // arity**levels)
    return stages


def root_paths(stages: list[DataFrame], above: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The witnesses (grp, pos, path) of the block roots of the first of ``stages``, from those of the last one's nodes."""
    for stage in stages[-2:0:-1]:
        then = save(descend(stage, above, _PATH, lambda m, witness: (m["grp"], m["pos"], packed(witness)), arity, levels), "merkle-paths")
        drop(above)
        above = then
    drop(*stages[1:])
    return above


def witnessed(docs: DataFrame, schema: str, rows: Callable[[dict, Witness], tuple], carried: dict[str, Column] | None = None, group: str = "lang", order: str = "doc_id", fields: list[str] = FIELDS, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs``: ``rows`` makes an output row of a leaf's columns (doc_id, which is the ``order`` column, grp,
    pos, n, digest and those ``carried``) and the witness that leads from it to the root."""
    ship(docs.sparkSession)
    # Null first, the others by code point.
    name = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = docs.select(name.alias("grp"), F.col(order).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("digest"), *[c.alias(n) for n, c in (carried or {}).items()])
    leaves = numbered(leaves, "grp", ["doc_id", "digest"], "merkle-leaves")
    stages = grown(leaves, arity, levels)
    ends = stages[-1].select(F.lit("").alias("top"), F.col("grp").alias("of"), "digest")
    roots = numbered(ends, "top", ["of"], "merkle-roots").withColumnRenamed("top", "grp")
    upper = grown(roots, arity, levels)
    root = save(upper[-1].select("grp", "pos", F.lit("").alias("path")), "merkle-paths")
    above = save(descend(roots, root_paths(upper, root, arity, levels), _PATH, lambda m, witness: (m["of"], 0, packed(witness)), arity, levels), "merkle-paths")
    return descend(leaves, root_paths(stages, above, arity, levels), schema, rows, arity, levels)


def subroot(m: dict, witness: Witness) -> bytes:
    """The root of the row's group."""
    return fold(m["digest"].encode(), witness[: depth(m["n"])])


def witnesses(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and path: the witness as (place, siblings) a level, from the leaf up."""

    def row(m: dict, witness: Witness) -> tuple:
        path = [{"place": place, "siblings": [s.decode() for s in siblings]} for place, siblings in witness]
        return m["doc_id"], m["digest"], subroot(m, witness).decode(), fold(m["digest"].encode(), witness).decode(), path

    return witnessed(docs, "doc_id long, leaf string, subroot string, root string, path array<struct<place: int, siblings: array<string>>>", row)


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to, to hold against a known root."""
    join = lambda s, a, n: F.array_join(F.slice(s["siblings"], a, n), "")
    return F.aggregate(path, leaf_digest, lambda d, s: F.sha2(F.concat(join(s, F.lit(1), s["place"]), d, join(s, s["place"] + 1, F.size(s["siblings"]))), 256))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0, F.lit(False))
    changed = F.when(hit, leaf([F.col(f) if f != "text" else F.translate("text", UPPER, LOWER) for f in FIELDS]))

    def row(m: dict, witness: Witness) -> tuple:
        own = m["digest"].encode()
        proof = sha256(b"".join(s for _, siblings in witness for s in siblings)).hexdigest()
        under = subroot(m, witness)
        root = fold(under, witness[depth(m["n"]) :])
        again = root if m["tampered"] in (None, m["digest"]) else fold(m["tampered"].encode(), witness)
        return m["doc_id"], own.decode(), under.decode(), root.decode(), proof, again.decode(), again == root

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return witnessed(docs, schema, row, {"tampered": changed})


def _op11_sql(levels: int = 12, tops: int = 8) -> str:
    """All levels written out: as many as 8**12 rows a group and 8**8 groups need."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda text: "sha256(" + " || ".join(field(text if f == "text" else f) for f in FIELDS) + ")"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {step})), 4294967295)"
    out = [
        f"leaf AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, {row('text')} AS d,"
        f" CASE WHEN coalesce({crc} % 3 = 0, false) THEN {row(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS t FROM documents) x)",
        "run0 AS MATERIALIZED (SELECT grp, pos // 8 AS run, n, string_agg(d, '' ORDER BY pos) AS joined FROM leaf GROUP BY ALL)",
    ]
    out.append("w0 AS (SELECT doc_id, grp, pos, n, d AS leaf, d AS own, coalesce(t, d) AS bent, '' AS proof, pos AS at, n AS m FROM leaf)")
    climbed = lambda n, own: f"CASE WHEN w.m > 1 THEN sha256(substr(joined, 1, 64 * (w.at % 8)) || {own} || substr(joined, 64 * (w.at % 8) + 65)) ELSE {own} END"
    for i in range(levels):
        out.append(
            f"w{i + 1} AS MATERIALIZED (SELECT doc_id, w.grp, w.pos, w.n, leaf, {climbed(i, 'own')} AS own, {climbed(i, 'bent')} AS bent,"
            f" CASE WHEN w.m > 1 THEN proof || substr(joined, 1, 64 * (w.at % 8)) || substr(joined, 64 * (w.at % 8) + 65) ELSE proof END AS proof, w.at // 8 AS at, (w.m + 7) // 8 AS m FROM w{i} w JOIN run{i} r ON w.grp = r.grp AND w.at // 8 = r.run)"
        )
        up = f"SELECT grp, run AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(joined) ELSE joined END AS d FROM run{i}"
        if i + 1 < levels:
            out.append(f"run{i + 1} AS MATERIALIZED (SELECT grp, pos // 8 AS run, n, string_agg(d, '' ORDER BY pos) AS joined FROM ({up}) x GROUP BY ALL)")
        else:
            out.append(f"root AS MATERIALIZED (SELECT grp, d, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM ({up}) x)")
    out.append("top0 AS MATERIALIZED (SELECT pos // 8 AS run, n, string_agg(d, '' ORDER BY pos) AS joined FROM root GROUP BY ALL)")
    out.append(f"v0 AS (SELECT doc_id, leaf, own AS subroot, own, bent, proof, root.pos AS at, root.n AS m FROM w{levels} w JOIN root USING (grp))")
    for i in range(tops):
        out.append(
            f"v{i + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, {climbed(i, 'own')} AS own, {climbed(i, 'bent')} AS bent,"
            f" CASE WHEN w.m > 1 THEN proof || substr(joined, 1, 64 * (w.at % 8)) || substr(joined, 64 * (w.at % 8) + 65) ELSE proof END AS proof, w.at // 8 AS at, (w.m + 7) // 8 AS m FROM v{i} w JOIN top{i} r ON w.at // 8 = r.run)"
        )
        if i + 1 < tops:
            out.append(f"top{i + 1} AS MATERIALIZED (SELECT pos // 8 AS run, n, string_agg(d, '' ORDER BY pos) AS joined FROM (SELECT run AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(joined) ELSE joined END AS d FROM top{i}) x GROUP BY ALL)")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, bent AS folded_root, bent = own AS verified FROM v{tops}"


OP11_SQL = _op11_sql()
