"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, a proof for each row.

1. Leaves are hashed natively in one scan and written; from there on only digests move.
2. A range shuffle by (source, id, digest) puts the leaves in order; counts by range and source (as many rows as ranges and sources) turn
   places within a range into places within the source. A source of any size is spread over many ranges.
3. Trees grow by events: a node that arrives joins its parent, which gathers the digests of its children by their index until it
   has as many as the size of its level says, and then is an event itself (``_grown``). Each task grows what it can from its own leaves, in any
   order, and passes on its frontier, the children of parents that lack others. The frontier is shuffled by an ancestor that at most
   ``3 ** BAND`` nodes share, until nothing is open: a few rows for each task and level.
4. Nodes at every ``BAND``-th level are kept as links. Going back down, each gives its nodes below the digests beside their way to the root; blocks of
   at most ``3 ** BAND`` nodes are handled at once, so a proof takes one shuffle a band and no join a level.

Results that only repeat digests (links, tops, paths) are written into the shared folder, so a lost executor costs no tree.

Edge cases: null fields enter as ``-``; a null source is a source of its own that comes first; rows without id come first in their source, rows that
share an id follow by their digest, and equal rows are interchangeable (each has a place and a proof). Empty and very long texts are hashed like any
other, natively. One row alone is its own root, with an empty proof. An empty table gives an empty manifest. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.runtime import small_enough, written

ARITY = 3
#: Levels handled by one shuffle: a block has at most 3 ** 7 = 2187 nodes.
BAND = 7
BLOCK = ARITY**BAND
OPEN, LINK, TOP = 0, 1, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = pa.schema([("kind", pa.int32()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())])
_NODE_SQL = "kind int, tree string, n long, level int, idx long, digest string"


def joined_hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes at a level of a tree over n leaves."""
    return -(-n // ARITY**level)


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the values, each as its length in bytes and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place within ``tree`` by ``order``, and ``n``, the size of their tree."""
    keys = ["tree", *order]
    ordered = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "ranges")
    return ordered.withColumn("part", part).join(small_enough(ranges), ["tree", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grows trees from the nodes (tree, n, level, idx, digest) that arrive, in any order; gives tops, links and the open frontier."""
    parents: dict[tuple[str, int, int], dict[int, str]] = {}
    sizes: dict[str, int] = {}

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)

    for batch in batches:
        out = []
        for tree, n, level, idx, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
            while True:
                wide = width(n, level)
                if wide == 1:
                    out.append((TOP, tree, n, level, idx, digest))
                    break
                up = (tree, level + 1, idx // ARITY)
                children = parents.setdefault(up, {})
                children[idx] = digest
                if len(children) < min(ARITY, wide - up[2] * ARITY):
                    sizes[tree] = n
                    break
                digest = joined_hash([children[i] for i in sorted(children)])
                del parents[up]
                level, idx = level + 1, up[2]
                # where it is made: a link that waits for others arrives again
                if level % BAND == 0:
                    out.append((LINK, tree, n, level, idx, digest))
        if out:
            yield packed(out)
    frontier = [(OPEN, tree, sizes[tree], level - 1, i, d) for (tree, level, _), children in parents.items() for i, d in children.items()]
    for lo in range(0, len(frontier), 10_000):
        yield packed(frontier[lo : lo + 10_000])


def _raised(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tops, links) of the trees over placed leaves."""
    nodes, found, level = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest"), [], 0
    while True:
        grown = written(nodes.mapInArrow(_grown, _NODE_SQL), "grown")
        found.append(grown)
        frontier = grown.where(F.col("kind") == OPEN)
        if frontier.isEmpty():
            break
        level += BAND
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.greatest(F.lit(level) - F.col("level"), F.lit(1))))
        nodes = frontier.withColumn("ancestor", ancestor).repartition("tree", "ancestor").drop("ancestor")
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return done.where(F.col("kind") == TOP).drop("kind", "level", "idx"), done.where(F.col("kind") == LINK).drop("kind")


def _siblings(digests: dict[int, str], n: int, level: int) -> tuple[dict[int, list[str]], int]:
    """For every node of a block the digests beside its way up to the block's top, level by level, and the level of that top."""
    beside: dict[int, list[str]] = {i: [] for i in digests}
    at, end = {i: i for i in digests}, level + BAND
    while level < end and width(n, level) > 1:
        runs: dict[int, list[int]] = {}
        for i in sorted(digests):
            runs.setdefault(i // ARITY, []).append(i)
        for leaf, node in at.items():
            beside[leaf] += [digests[i] for i in runs[node // ARITY] if i != node]
            at[leaf] = node // ARITY
        digests = {up: joined_hash([digests[i] for i in run]) for up, run in runs.items()}
        level += 1
    return beside, level


def folded(digest: str, siblings: list[str], places: list[tuple[int, int]]) -> str:
    """The root that a leaf's digest and its siblings give; ``places`` has its (place, size) in each tree on the way up."""
    at = 0
    for idx, n in places:
        while n > 1:
            lo = idx // ARITY * ARITY
            more = min(ARITY, n - lo) - 1
            run = siblings[at : at + more]
            digest = joined_hash([*run[: idx - lo], digest, *run[idx - lo :]])
            at, idx, n = at + more, idx // ARITY, -(-n // ARITY)
    return digest


def _blocks(nodes: DataFrame, level: int, paths: DataFrame | None, tops: DataFrame) -> DataFrame:
    """Nodes of one level with ``path``, the siblings above their block: those of the link over it, or those of the tree where the block reaches its top."""
    nodes = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long"))
    whole = F.col("n") <= ARITY ** (level + BAND)
    out = nodes.where(whole).join(small_enough(tops), "tree")
    if paths is not None:
        above = paths.select("tree", F.col("idx").alias("block"), "path", "top_idx", "top_n")
        out = out.unionByName(nodes.where(~whole).join(small_enough(above), ["tree", "block"]))
    return out


def _lowered(leaves: DataFrame, links: DataFrame, tops: DataFrame) -> DataFrame:
    """Leaves (tree, n, idx, digest, offered, doc_id) with ``proof`` and ``folded_root``; ``tops`` has the siblings above each tree: (tree, path, top_idx, top_n)."""
    top_level = links.agg(F.max("level")).first()[0] or 0
    paths = None

    def down(table: pa.Table) -> pa.Table:
        idx, digest = table.column("idx").to_pylist(), table.column("digest").to_pylist()
        first = table.slice(0, 1).to_pylist()[0]
        beside, _ = _siblings(dict(zip(idx, digest, strict=True)), first["n"], first["level"])
        out = [(first["tree"], first["n"], i, "".join(beside[i]) + first["path"], first["top_idx"], first["top_n"]) for i in idx]
        return pa.table(dict(zip(("tree", "n", "idx", "path", "top_idx", "top_n"), (pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)), strict=True)))

    for level in range(top_level, 0, -BAND):
        blocks = _blocks(links.where(F.col("level") == level), level, paths, tops)
        paths = written(blocks.groupBy("tree", "block").applyInArrow(down, "tree string, n long, idx long, path string, top_idx long, top_n long"), "paths")

    def proven(table: pa.Table) -> pa.Table:
        idx, digest, offered = (table.column(c).to_pylist() for c in ("idx", "digest", "offered"))
        first = table.slice(0, 1).to_pylist()[0]
        beside, _ = _siblings(dict(zip(idx, digest, strict=True)), first["n"], 0)
        above, size = first["path"], len(digest[0])
        above = [above[i : i + size] for i in range(0, len(above), size)]
        proofs = [beside[i] + above for i in idx]
        roots = [folded(o or d, p, [(i, first["n"]), (first["top_idx"], first["top_n"])]) for i, d, o, p in zip(idx, digest, offered, proofs, strict=True)]
        return pa.table({"tree": table.column("tree").cast(pa.string()), "doc_id": table.column("doc_id"), "leaf": pa.array(digest, pa.string()), "proof": pa.array(["".join(p) for p in proofs], pa.string()), "folded_root": pa.array(roots, pa.string())})

    blocks = _blocks(leaves, 0, paths, tops)
    return blocks.groupBy("tree", "block").applyInArrow(proven, "tree string, doc_id long, leaf string, proof string, folded_root string")


def merkle_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", offered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) for every row.

    ``proof`` has the siblings of the row's way to the root as hexadecimal digests, one after the other. ``folded_root`` is the root that they give together with
    the row as it is, or with the fields that ``offered`` puts in place of its own: it equals ``root`` only if these are unchanged.
    """
    given = [F.col(c) for c in fields]
    changed = [(offered or {}).get(c, F.col(c)) for c in fields]
    own, other = leaf_digest(given), leaf_digest(changed) if offered else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("/"), F.col(group).cast("string")), F.lit(""))
    hashed = docs.select(tree.alias("tree"), F.col(key).cast("long").alias("doc_id"), own.alias("digest"), other.alias("offered"), F.monotonically_increasing_id().alias("tie"))
    leaves = _placed(written(hashed, "leaves"), ["doc_id", "digest", "tie"])
    tops, links = _raised(leaves)
    tops = written(tops, "tops")

    sources = _placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.lit(None).cast("string").alias("offered"), F.lit(None).cast("long").alias("doc_id")), ["name"])
    over, over_links = _raised(sources)
    top = over.select("digest").first()
    root = top[0] if top else None
    nothing = docs.sparkSession.createDataFrame([("", "", 0, 1)], "tree string, path string, top_idx long, top_n long")
    # the path of each source from the tree over the sources: one leaf a source, found again by its place
    ways = _lowered(sources.withColumn("doc_id", F.col("idx")), over_links, nothing).select(F.col("doc_id").alias("idx"), F.col("proof").alias("path"))
    above = written(sources.join(ways, "idx").select(F.col("name").alias("tree"), "path", F.col("idx").alias("top_idx"), F.col("n").alias("top_n")), "above")
    out = _lowered(leaves, links, above).join(small_enough(tops.select("tree", F.col("digest").alias("subroot"))), "tree")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    m = merkle_manifest(docs, offered={"text": tampered})
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_CRC32 = "list_reduce([4294967295]::BIGINT[] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"

#: The CRC register before its final inversion is odd where the CRC is even. Trees by level; level 100 and up is the tree over the sources.
OP11_SQL = rf"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf,
         CASE WHEN ({_CRC32}) % 2 = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS offered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
t AS (SELECT 0 AS level, source, pos AS idx, leaf AS digest, n FROM p
      UNION ALL
      SELECT any_value(level) + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY source, idx // 3),
s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 100 AS level, pos AS idx, subroot AS digest, n FROM s
      UNION ALL
      SELECT any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY idx // 3),
w AS (SELECT p.doc_id, p.source, p.pos AS leaf_pos, t.level, p.pos // power(3, t.level)::BIGINT AS spot, t.n, list(t.digest ORDER BY t.idx) AS run, list(t.idx ORDER BY t.idx) AS ids
      FROM p JOIN t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.idx // 3 = p.pos // power(3, t.level + 1)::BIGINT GROUP BY ALL
      UNION ALL
      SELECT p.doc_id, p.source, p.pos, u.level, s.pos // power(3, u.level - 100)::BIGINT, u.n, list(u.digest ORDER BY u.idx), list(u.idx ORDER BY u.idx)
      FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN u ON u.n > 1 AND u.idx // 3 = s.pos // power(3, u.level - 99)::BIGINT GROUP BY ALL),
b AS (SELECT source, leaf_pos, string_agg(array_to_string(list_filter(run, lambda x, i: ids[i] <> spot), ''), '' ORDER BY level) AS proof,
             list({{'run': run, 'slot': spot - ids[1] + 1}} ORDER BY level) AS steps FROM w GROUP BY ALL),
f AS (SELECT b.source, leaf_pos, 1 AS k, offered AS digest, steps FROM b JOIN p ON p.source IS NOT DISTINCT FROM b.source AND p.pos = b.leaf_pos
      UNION ALL
      SELECT source, leaf_pos, k + 1, sha256(array_to_string(list_transform(steps[k].run, lambda x, i: CASE WHEN i = steps[k].slot THEN digest ELSE x END), '')), steps FROM f WHERE k <= len(steps)),
g AS (SELECT source, leaf_pos, digest AS folded FROM f WHERE k > len(steps))
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(b.proof, '')) AS proof_sha256, coalesce(g.folded, p.offered) AS folded_root, coalesce(g.folded, p.offered) = r.root AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source, (SELECT digest AS root FROM u WHERE n = 1) r
LEFT JOIN b ON b.source IS NOT DISTINCT FROM p.source AND b.leaf_pos = p.pos LEFT JOIN g ON g.source IS NOT DISTINCT FROM p.source AND g.leaf_pos = p.pos
"""
