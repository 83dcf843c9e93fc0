"""Merkle manifest of a dataset by superblocks: leaves, a tree for each part, a tree over the parts, audit paths, folding.

A part's nodes are numbered in order; a superblock is a run of fanout**levels of them. One pass of applyInPandas collapses
each superblock to its root, the roots are numbered by their block and are reduced in the same way, until every part has
one node. On the way back each superblock meets the path of its root (a cogroup), and a member's path is its lower part and
that upper part in one. Numbers come from range partitions and their offsets, so a part of any size is spread over all tasks, and
no task holds more than a superblock.

A node's digest is sha256 of its members' digests (hexadecimal text), in order; the last of a level may have fewer members,
even one. A part of one leaf has that leaf as its root. An audit path is text: for each level, upwards, the digests before and
after the node in its run, as `before.after`, levels parted by `/`; path "" is that of a root. fold() recomputes the root.

Cases: a null value is told apart from every text. A null part comes first among parts and is one of its own. Leaves of a
part ascend by id (null first), rows of one id by digest; rows that repeat are leaves each and may take each other's place.
Empty and very long texts are hashed whole, in the engine. An empty table has no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import discard, read, written
from quaymark.operators.ranks import running

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """sha256 of the fields, each `-` if null, else its number of bytes, `:` and itself as text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def node_digest(members: Sequence[str]) -> str:
    return hashlib.sha256("".join(members).encode()).hexdigest()


def collapse(digests: list[str], whole: bool, fanout: int, levels: int) -> list[list[str]]:
    """A superblock's nodes, level by level: up to one node if the block is a whole tree, else so many levels."""
    found = [digests]
    while len(found[-1]) > 1 if whole else len(found) <= levels:
        last = found[-1]
        found.append([node_digest(last[k : k + fanout]) for k in range(0, len(last), fanout)])
    return found


def lower_paths(tree: list[list[str]], fanout: int, upper: str) -> list[str]:
    """The path of each of a superblock's members, which ends in that of its root."""
    paths = [upper]
    for nodes in reversed(tree[:-1]):
        above, paths = paths, []
        for k in range(len(nodes)):
            start = k - k % fanout
            step = f"{''.join(nodes[start:k])}.{''.join(nodes[k + 1 : start + fanout])}"
            paths.append(f"{step}/{above[k // fanout]}" if above[k // fanout] else step)
    return paths


def _in_blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))


def _whole(block: int, rows: int, size: int) -> bool:
    """Whether a block is all of its part's nodes. A full first block has one root after its levels, whether others follow or not."""
    return block == 0 and rows < size


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> list[DataFrame]:
    """Tables (part, pos, digest) from nodes upwards, each with the roots of the superblocks of the one before, until each part has one node. digest is binary."""
    size = fanout**levels

    def root(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        digests = [d.hex() for d in block.sort_values("pos")["digest"]]
        top = collapse(digests, _whole(key[1], len(digests), size), fanout, levels)[-1][0]
        return pd.DataFrame({"part": [key[0]], "pos": [key[1]], "digest": [bytes.fromhex(top)]})

    tables = [nodes]
    while (tables[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        blocks = _in_blocks(tables[-1].select("part", "pos", "digest"), size).groupBy("part", "block")
        tables.append(written(blocks.applyInPandas(root, "part string, pos bigint, digest binary"), "superblocks"))
    return tables


def with_paths(nodes: DataFrame, uppers: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes (part, pos, digest and more) with path, subroot and root. uppers (part, pos, path, subroot, root) has those of their superblocks' roots."""
    size = fanout**levels

    def placed(key: tuple, block: pa.Table, upper: pa.Table) -> pa.Table:
        block = block.sort_by("pos").drop_columns("block")
        digests = [d.hex() for d in block.column("digest").to_pylist()]
        tree = collapse(digests, _whole(key[1].as_py(), len(digests), size), fanout, levels)
        block = block.append_column("path", pa.array(lower_paths(tree, fanout, upper.column("path")[0].as_py()), pa.string()))
        for name in ("subroot", "root"):
            block = block.append_column(name, pa.repeat(upper.column(name)[0], len(digests)))
        return block

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), "path string", "subroot string", "root string"])
    above = uppers.select("part", F.col("pos").alias("block"), "path", "subroot", "root")
    return _in_blocks(nodes, size).groupBy("part", "block").cogroup(above.groupBy("part", "block")).applyInArrow(placed, schema)


def _proved(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first of the tables with paths; tops (part, pos 0, path, subroot, root) has those of the parts' roots."""
    uppers = tops
    for table in reversed(tables[1:]):
        found = written(with_paths(table, uppers, fanout, levels).drop("digest"), "paths")
        discard(uppers, table)
        uppers = found
    return with_paths(tables[0], uppers, fanout, levels)


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves (id, part, leaf and more; leaf is hexadecimal text) with pos, path, subroot and root."""
    more = [c for c in leaves.columns if c not in ("part", "leaf")]
    hexed = F.lower(F.hex("digest"))
    # A null part gets the least name, other names a letter before them.
    keyed = leaves.select(*more, F.coalesce(F.concat(F.lit("="), F.col("part")), F.lit("")).alias("part"), F.unhex("leaf").alias("digest"))
    numbered = running(keyed, ["part"], ["id", "digest"], "pos")
    tables = reduced(written(numbered.withColumn("pos", F.col("pos") - 1), "leaves"), fanout, levels)
    # The parts, in order, are the leaves of one more tree.
    over = running(tables[-1].select(F.lit("").alias("part"), F.col("part").alias("name"), "digest"), ["part"], ["name"], "pos")
    uppers = reduced(written(over.withColumn("pos", F.col("pos") - 1), "parts"), fanout, levels)
    top = uppers[-1].select("part", "pos", F.lit("").alias("path"), hexed.alias("subroot"), hexed.alias("root"))
    parts = _proved(uppers, top, fanout, levels)
    tops = written(parts.select(F.col("name").alias("part"), F.lit(0).cast("bigint").alias("pos"), "path", hexed.alias("subroot"), "root"), "parts")
    found = _proved(tables, tops, fanout, levels)
    return found.select(*more, F.when(F.col("part") != "", F.expr("substring(part, 2)")).alias("part"), hexed.alias("leaf"), "pos", "path", "subroot", "root")


def fold(digest: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(F.substring_index(s, ".", 1), d, F.substring_index(s, ".", -1)), 256))


def document_leaves(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, part, leaf, other): other is the binary leaf digest of a document that is tampered with, null for the rest. Where crc32 of the id as text is even, tampering deletes the text's line breaks."""
    tampered = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text_col else F.col(c) for c in fields]
    other = F.when(tampered & F.contains(F.col(text_col), F.lit("\n")), F.unhex(leaf_digest(*changed)))
    return docs.select(F.col(id_col).alias("id"), F.col(part_col).cast("string").alias("part"), leaf_digest(*[F.col(c) for c in fields]).alias("leaf"), other.alias("other"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = manifest(document_leaves(read(spark, sf_dir, "documents")))
    folded = fold(F.coalesce(F.lower(F.hex("other")), F.col("leaf")), F.col("path"))
    rows = proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.translate("path", "./", ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_TOLD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_TOLD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"


def _tree(name: str, nodes: str) -> str:
    """SQL of all nodes above (part, idx, digest), level by level, and of the digests before and after each in its run."""
    return f"""
{name}(part, level, idx, digest, n) AS (
  SELECT part, 0, idx, digest, count(*) OVER (PARTITION BY part) FROM {nodes}
  UNION ALL
  SELECT part, level, idx, digest, count(*) OVER (PARTITION BY part) FROM (
    SELECT part, level + 1 AS level, idx // 3 AS idx, sha256(string_agg(digest, '' ORDER BY idx)) AS digest FROM {name} WHERE n > 1 GROUP BY part, level, idx // 3)),
{name}_near AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (PARTITION BY part, level, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(digest, '') OVER (PARTITION BY part, level, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM {name})"""


def _walk(name: str, tree: str, start: str) -> str:
    """SQL of what each row of start (part, at, digest, proof and more as key) folds to on its way up a tree."""
    return f"""
{name}(key, part, level, idx, digest, proof, ended) AS (
  SELECT key, part, 0, idx, digest, proof, false FROM {start}
  UNION ALL
  SELECT w.key, w.part, w.level + 1, w.idx // 3, CASE WHEN t.n = 1 THEN w.digest ELSE sha256(before || w.digest || after) END, CASE WHEN t.n = 1 THEN proof ELSE proof || before || after END, t.n = 1
  FROM {name} w JOIN {tree}_near t ON w.part = t.part AND w.level = t.level AND w.idx = t.idx WHERE NOT ended)"""


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC} AS crcs),
d AS (
  SELECT doc_id, coalesce('=' || source, '') AS part, {_LEAF.format("text")} AS leaf, {_LEAF.format("replace(text, chr(10), '')")} AS other,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: ascii(substr(CAST(doc_id AS VARCHAR), k, 1))::BIGINT)), lambda c, b: xor(crcs[(xor(c, b) % 256 + 1)::INT], c // 256))) % 2 = 0 AS tampered
  FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS key FROM d),
leaf_nodes AS (SELECT part, idx, leaf AS digest FROM l),
{_tree("low", "leaf_nodes")},
part_nodes AS (SELECT '' AS part, part AS name, digest, row_number() OVER (ORDER BY part) - 1 AS idx FROM low WHERE n = 1),
{_tree("high", "part_nodes")},
begun AS (SELECT key, part, idx, CASE WHEN tampered THEN coalesce(other, leaf) ELSE leaf END AS digest, '' AS proof FROM l),
{_walk("up", "low", "begun")},
halfway AS (SELECT key, '' AS part, p.idx, up.digest, proof FROM up JOIN part_nodes p ON up.part = p.name WHERE ended),
{_walk("on_", "high", "halfway")}
SELECT l.doc_id, l.leaf, p.digest AS subroot, h.digest AS root, sha256(o.proof) AS proof_sha256, o.digest AS folded_root, o.digest = h.digest AS verified
FROM l JOIN on_ o ON l.key = o.key AND o.ended JOIN part_nodes p ON p.name = l.part, (SELECT digest FROM high WHERE n = 1) h
"""
