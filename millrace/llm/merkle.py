"""Merkle manifest of a dataset: a root over all rows, and for each row the path that proves it.

Each row is a leaf: H of its fields, where H is the lowercase hex sha256 of its inputs one after another and digests go in as hex text. A null field
is "-", another its UTF-8 length in bytes, ":" and its value. Leaves of a source ascend by doc_id (null first; then by leaf, so the manifest doesn't depend on the
order of rows). While a source has several nodes, every ``FAN`` consecutive ones become their H, the last run with fewer or one;
what remains is its subroot. Subroots by source (null first, then by bytes) make the root in the same way. A path is all
siblings, level by level to the root, left to right.

Work is by aligned blocks of ``FAN ** HEIGHT`` nodes, whatever the source, so a source of any size is many blocks. A
task reads its blocks one after another. Block roots are the nodes of the next round, until
each source has one; paths of a round's nodes go down as rows for each block, not as copies for each leaf. Within a block, paths are made by fractal traversal:
for each level the existing subtree, which is the run of siblings that the current leaf needs, and the desired one, which
grows by one leaf for each leaf that is passed, so that it is whole when the traversal steps over. At most 2 * FAN digests a level are kept, beside the
block's own leaves.

Repeated rows are leaves of their own. Empty texts aren't null ones. An empty table has no root and gives no rows. Columns other than
doc_id, source, lang, n_chars and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import drop_staged, staged, trimmed, tuned
from millrace.llm.order import numbered

FAN, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A tree's name: of the source, so that null isn't the empty one; the tree of subroots has a name that no source has.
SOURCES = "sources"


def H(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, with another text if given."""

    def field(name: str) -> Column:
        value = (F.col(name) if name != "text" or text is None else text).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(n) for n in FIELDS]), 256)


def levels(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


class Traversal:
    """The paths of a block's leaves, in order. A path is a list of (place among the siblings, siblings before, siblings after)."""

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height = leaves, height
        self.existing: list[list[str]] = []
        self.desired = [Growing(level) for level in range(height)]
        # The first run of each level is made before the start; the last level has no other.
        for level in range(height):
            first = Growing(level)
            for at in range(min(len(leaves), FAN ** (level + 1))):
                first.add(leaves[at])
            self.existing.append(first.close())
        self.fed = [min(len(leaves), FAN ** (level + 1)) for level in range(height)]

    def root(self) -> str:
        return H(*self.existing[-1]) if self.height else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[int, list[str]]]]:
        """For each leaf, level by level, its place in its run and the run."""
        for at in range(len(self.leaves)):
            for level in range(self.height):
                span = FAN ** (level + 1)
                if at and at % span == 0:
                    self.existing[level] = self.desired[level].close()
                    self.desired[level] = Growing(level)
            yield [(at // FAN**level % FAN, self.existing[level]) for level in range(self.height)]
            for level in range(self.height):
                if self.fed[level] < len(self.leaves):
                    self.desired[level].add(self.leaves[self.fed[level]])
                    self.fed[level] += 1


class Growing:
    """A run of nodes of one level, made of leaves that come one by one; a stack has at most FAN - 1 nodes a level."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, digest: str) -> None:
        for level, nodes in enumerate(self.stack):
            nodes.append(digest)
            if level == len(self.stack) - 1 or len(nodes) < FAN:
                return
            digest = H(*nodes)
            nodes.clear()

    def close(self) -> list[str]:
        """The run's nodes; what isn't full is closed level by level."""
        for level in range(len(self.stack) - 1):
            if self.stack[level]:
                self.stack[level + 1].append(H(*self.stack[level]))
        return self.stack[-1]


def _blocks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[str, int, int, list]]:
    """(tree, block, nodes of the tree, rows) from sorted rows; rows are tuples of the columns. Blocks don't end where batches do."""
    key, held, n = None, [], 0
    for batch in batches:
        names = batch.schema.names
        trees, blocks, numbers = (batch.column(names.index(c)).to_pylist() for c in ("tree", "block", "nodes"))
        rows = list(zip(*[batch.column(names.index(c)).to_pylist() for c in columns]))
        for tree, block, number, row in zip(trees, blocks, numbers, rows):
            if (tree, block) != key:
                if held:
                    yield *key, n, held
                key, held, n = (tree, block), [], 0
            held.append(row)
            n = max(n, number or 0)
    if held:
        yield *key, n, held


def _dealt(own: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """Nodes dealt out by blocks, and before those of each block the row of its path, if there is one."""
    own = own.withColumn("block", F.floor(F.col("place") / FAN**height))
    if above is not None:
        heads = above.withColumn("block", F.col("place")).withColumn("place", F.lit(-1).cast("long"))
        own = own.unionByName(heads, allowMissingColumns=True)
    return own.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def block_roots(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """tree, place, nodes, digest: the roots of the blocks of (tree, place, nodes, digest), which are the next round's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, n, rows in _blocks(batches, ["digest"]):
            root = Traversal([d for (d,) in rows], min(height, levels(n))).root()
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block], pa.int64()), pa.array([-(-n // FAN**height)], pa.int64()), pa.array([root])], ["tree", "place", "nodes", "digest"])

    return _dealt(nodes.select("tree", "place", "nodes", "digest"), None, height).mapInArrow(trimmed(run), "tree string, place long, nodes long, digest string")


PATH = "array<struct<place: int, siblings: string>>"


def _path(path: list[tuple[int, list[str]]]) -> list[dict]:
    return [{"place": k, "siblings": "".join(run[:k] + run[k + 1 :])} for k, run in path]


def node_paths(nodes: DataFrame, above: DataFrame | None, height: int = HEIGHT) -> DataFrame:
    """tree, place, path, root of all nodes; ``above`` has path and root of their blocks (tree, place), None where each tree is one block."""
    own = nodes.select("tree", "place", "nodes", "digest")
    headed = above is not None
    wanted = ["place", "digest", "path", "root"] if headed else ["place", "digest"]
    kind = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, n, rows in _blocks(batches, wanted):
            upper = rows.pop(0) if headed else None
            walk = Traversal([r[1] for r in rows], min(height, levels(n)))
            top, root = (upper[2], upper[3]) if upper else ([], walk.root())
            found = [_path(p) + top for p in walk.paths()]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(rows)), pa.array([r[0] for r in rows], pa.int64()), pa.array(found, kind), pa.array([root] * len(rows))], ["tree", "place", "path", "root"])

    return _dealt(own, above, height).mapInArrow(trimmed(run), f"tree string, place long, path {PATH}, root string")


def climb(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame | None]:
    """(roots of the trees, paths of the blocks) of nodes (tree, place, nodes, digest); the paths are None where each tree is one block."""
    rounds = [staged(block_roots(nodes, height), "merkle-blocks")]
    while not rounds[-1].where("nodes > 1").isEmpty():
        rounds.append(staged(block_roots(rounds[-1], height), "merkle-blocks"))
    above = None
    for blocks in reversed(rounds[:-1]):
        found = staged(node_paths(blocks, above, height), "merkle-paths")
        drop_staged(*[x for x in (above, blocks) if x is not None])
        above = found
    return rounds[-1], above


def manifest(docs: DataFrame, changed: Column | None = None, changed_where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    Where ``changed_where`` is true, the path is folded with the leaf of the text ``changed`` instead of the row's own, to tell whether the manifest notices.
    """
    tuned(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    other = F.when(changed_where, leaf(text=changed)) if changed is not None and changed_where is not None else F.lit(None).cast("string")
    leaves = staged(docs.select("doc_id", tree.alias("tree"), leaf().alias("digest"), other.alias("changed")), "merkle-leaves")
    placed = numbered(leaves, [F.col("doc_id"), F.col("digest")], "tree", "merkle-order")
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("nodes"))
    nodes = staged(placed.join(sizes, "tree"), "merkle-nodes")
    drop_staged(leaves)
    subroots, above = climb(nodes, height)
    # The tree of the subroots: sources in order are its nodes.
    sources = numbered(subroots.select(F.col("tree").alias("source_tree"), F.col("digest")), [F.col("source_tree")], None, "merkle-sources")
    total = subroots.agg(F.count("*").alias("nodes"))
    sources = staged(sources.crossJoin(F.broadcast(total)).withColumn("tree", F.lit(SOURCES)), "merkle-sources")
    _, above_sources = climb(sources, height)
    upper = node_paths(sources, above_sources, height).join(sources.select("source_tree", "place", F.col("digest").alias("subroot")), "place")
    upper = staged(upper.select("source_tree", "subroot", "path", "root"), "merkle-upper")
    # Above each block of leaves: its path within the source, and from the subroot on.
    blocks = above.select("tree", "place", "path") if above is not None else nodes.select("tree").distinct().select("tree", F.lit(0).cast("long").alias("place"), F.array().cast(PATH).alias("path"))
    heads = blocks.join(upper.withColumnRenamed("path", "rest"), F.col("tree") == F.col("source_tree"))
    heads = heads.select("tree", "place", F.concat("path", "rest").alias("path"), "root", "subroot")

    ids = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n, rows in _blocks(batches, ["doc_id", "digest", "changed", "path", "root", "subroot"]):
            (*_, top, root, subroot), *rows = rows
            walk = Traversal([r[1] for r in rows], min(height, levels(n)))
            proofs, folded = zip(*[_proven(r[2] or r[1], path, top) for r, path in zip(rows, walk.paths())])
            columns = [[r[1] for r in rows], [subroot] * len(rows), [root] * len(rows), proofs, folded, [x == root for x in folded]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], ids), *map(pa.array, columns)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    rows = _dealt(nodes.select("tree", "place", "nodes", "doc_id", "digest", "changed"), heads, height)
    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _proven(node: str, path: list[tuple[int, list[str]]], top: list[dict]) -> tuple[str, str]:
    """The digest of a path, and the root that it leads to from a leaf."""
    proof = sha256()
    for place, siblings in path:
        before, after = "".join(siblings[:place]), "".join(siblings[place + 1 :])
        proof.update((before + after).encode())
        node = H(before, node, after)
    for step in top:
        cut = 64 * step["place"]
        proof.update(step["siblings"].encode())
        node = H(step["siblings"][:cut], node, step["siblings"][cut:])
    return proof.hexdigest(), node



def lowered_text() -> Column:
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chosen() -> Column:
    """Whether 5 divides the crc32 of the decimal doc_id; of none it doesn't."""
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def oracle() -> str:
    """The manifest of documents in DuckDB, with texts lower-cased where 5 divides the crc32 of the decimal doc_id."""
    table = "(SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(0, 256) AS r(i))"
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')"
    of = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = f"PARTITION BY tree, place // {FAN}"
    climb = f"""SELECT level + 1, tree, place // {FAN}, sha256(string_agg(digest, '' ORDER BY place)), (nodes + {FAN - 1}) // {FAN} FROM {{}} WHERE nodes > 1 GROUP BY level, tree, place // {FAN}, nodes"""
    steps = f"SELECT level, tree, place, nodes, string_agg(digest, '') OVER ({run}, level ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, string_agg(digest, '') OVER ({run}, level ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM {{}} WHERE nodes > 1"
    return f"""WITH RECURSIVE crcs AS {table},
leaves AS (SELECT doc_id, source, {of("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {of(lowered)} ELSE {of("text")} END AS held FROM documents, crcs),
rows AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS nodes FROM leaves),
inner_nodes(level, tree, place, digest, nodes) AS (SELECT 0, tree, place, leaf, nodes FROM rows UNION ALL {climb.format("inner_nodes")}),
subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS nodes FROM inner_nodes WHERE nodes = 1),
upper_nodes(level, tree, place, digest, nodes) AS (SELECT 1000, '', place, subroot, nodes FROM subroots UNION ALL {climb.format("upper_nodes")}),
inner_steps AS MATERIALIZED ({steps.format("inner_nodes")}),
upper_steps AS MATERIALIZED ({steps.format("upper_nodes")}),
tops AS (SELECT digest AS root FROM upper_nodes WHERE nodes = 1),
folding(doc_id, leaf, tree, place, top, level, node, siblings) AS (
  SELECT doc_id, leaf, rows.tree, rows.place, subroots.place, 0, held, '' FROM rows JOIN subroots USING (tree)
  UNION ALL SELECT doc_id, leaf, f.tree, CASE WHEN s.level IS NULL THEN top ELSE f.place // {FAN} END, top, CASE WHEN s.level IS NULL AND f.level < 1000 THEN 1000 ELSE f.level + 1 END,
    CASE WHEN s.level IS NULL THEN node ELSE sha256(coalesce(before, '') || node || coalesce(after, '')) END, CASE WHEN s.level IS NULL THEN siblings ELSE siblings || coalesce(before, '') || coalesce(after, '') END
  FROM folding f LEFT JOIN (SELECT * FROM inner_steps UNION ALL SELECT * FROM upper_steps) s ON s.level = f.level AND s.place = f.place AND s.tree = CASE WHEN f.level < 1000 THEN f.tree ELSE '' END
  WHERE f.level < 1000 OR s.level IS NOT NULL)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified
FROM (SELECT * FROM folding QUALIFY row_number() OVER (PARTITION BY doc_id, leaf, tree ORDER BY level DESC) = 1) JOIN subroots USING (tree), tops"""
