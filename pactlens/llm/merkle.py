"""Merkle manifest of a table: a digest for each row, a root for each language and for all, and a proof for each row.

Incremental witnesses: the leaves of an aligned block are appended one after another. An append opens
a subtree of one leaf and, as long as the last two open subtrees are of one height, completes their parent: each
side's leaves extend their partial witnesses by the other side's digest. A block's root is then a further append to
the next level, in blocks of its own, up to the languages' roots and the root of all. Blocks are
independent tasks; the witness of a leaf is its own block's, followed by those of the blocks above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.order import numbered
from pactlens.operators.sizing import broadcast_if_small
from pactlens.sources.scratch import store

HEIGHT = 12  # a block holds 2 ** HEIGHT nodes
LEFT, RIGHT, ALONE = b"L", b"R", b"-"  # how a witness marks the side of the digest that follows; ALONE has none
_DIGEST = 32


def digest(*inputs: bytes) -> bytes:
    """Digest of digests: SHA-256 of their lowercase hex, concatenated."""
    return hashlib.sha256("".join(i.hex() for i in inputs).encode()).digest()


class Block:
    """Leaves appended so far, their partial witnesses and the open subtrees (height, first leaf, digest)."""

    def __init__(self):
        self.open: list[tuple[int, int, bytes]] = []
        self.witnesses: list[bytearray] = []

    def append(self, node: bytes) -> None:
        self.witnesses.append(bytearray())
        self.open.append((0, len(self.witnesses) - 1, node))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._complete()

    def _complete(self) -> None:
        """The last two open subtrees, of one height, become one."""
        _, right_at, right = self.open.pop()
        height, left_at, left = self.open.pop()
        for w in self.witnesses[left_at:right_at]:
            w += RIGHT + right
        for w in self.witnesses[right_at:]:
            w += LEFT + left
        self.open.append((height + 1, left_at, digest(left, right)))

    def root(self, height: int | None = None) -> bytes:
        """Root of what was appended: the last subtree rises alone until it meets its left sibling, or to `height`."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._complete()
                continue
            level, at, node = self.open.pop()
            for w in self.witnesses[at:]:
                w += ALONE
            self.open.append((level + 1, at, digest(node)))
        return self.open[0][2]


def siblings(witness: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, digest) from the leaf to the root; no digest where the node was alone."""
    at = 0
    while at < len(witness):
        side = witness[at:at + 1]
        at += 1
        yield side, b"" if side == ALONE else witness[at:at + _DIGEST]
        at += 0 if side == ALONE else _DIGEST


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness give."""
    for side, other in siblings(witness):
        leaf = digest(leaf) if side == ALONE else digest(other, leaf) if side == LEFT else digest(leaf, other)
    return leaf


def _append(batches: Iterator[pa.RecordBatch], height: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tree, block, pos), one block after another, with witness; a block's first row has its root."""
    held: list[pa.RecordBatch] = []
    block, open_key, alone = Block(), None, True

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            root = block.root(None if alone else height)
            rows = pa.Table.from_batches(held).combine_chunks()
            roots = pa.array([root] + [None] * (rows.num_rows - 1), pa.binary())
            out = rows.append_column("witness", pa.array([bytes(w) for w in block.witnesses], pa.binary())).append_column("root", roots)
            yield from out.to_batches()

    for batch in batches:
        trees, blocks, counts = (batch.column(c).to_pylist() for c in ("tree", "block", "n"))
        nodes = batch.column("digest").to_pylist()
        first = 0
        for i in range(batch.num_rows + 1):
            key = (trees[i], blocks[i]) if i < batch.num_rows else None
            if i == batch.num_rows or key != open_key:
                if i > first:
                    held.append(batch.slice(first, i - first))
                first = i
                if i == batch.num_rows:
                    break
                yield from close()
                held, block, open_key = [], Block(), key
                alone = counts[i] <= 1 << height
            block.append(nodes[i])
    yield from close()


def _blocks(nodes: DataFrame, height: int, name: str) -> DataFrame:
    """nodes (tree, pos, n, digest, ...) + block, witness, root."""
    rows = nodes.withColumn("block", F.shiftright("pos", height))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return store(dealt.mapInArrow(lambda b: _append(b, height), f"{kinds}, witness binary, root binary"), name)


def grow(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Trees over nodes (tree, pos, n, digest, ...): (nodes with their whole `witness`, (tree, digest) of the roots).

    `pos` counts from 0 in each tree, `n` is the tree's size. Each level has 2 ** height times fewer rows than
    the one below; what a level adds to the witnesses below it comes by a join on (tree, block).
    """
    levels, tops = [], []
    while True:
        level = _blocks(nodes, height, "merkle")
        levels.append(level)
        ends = level.filter("root IS NOT NULL").select("tree", "block", "n", F.col("root").alias("digest"))
        tops.append(ends.filter(F.col("n") <= 1 << height).select("tree", "digest"))
        over = ends.filter(F.col("n") > 1 << height)
        if over.isEmpty():
            break
        up = F.shiftright(F.col("n") + F.lit((1 << height) - 1), height)
        nodes = over.select("tree", F.col("block").alias("pos"), up.alias("n"), "digest")
    above = None
    for level in reversed(levels):
        level = level.drop("root")
        if above is not None:
            ends = broadcast_if_small(above.select(F.col("tree").alias("_t"), F.col("pos").alias("_b"), F.col("witness").alias("_w")))
            level = level.join(ends, (F.col("tree") == F.col("_t")) & (F.col("block") == F.col("_b")), "left")
            level = level.withColumn("witness", F.concat("witness", F.coalesce("_w", F.lit(b"")))).drop("_t", "_b", "_w")
        above = level.drop("block")
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.union(t)
    return above, roots


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _prove(batches: Iterator[pa.RecordBatch], root: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for leaf, bent, witness in zip(*(batch.column(c).to_pylist() for c in ("digest", "bent", "witness"))):
            proof = hashlib.sha256("".join(d.hex() for _, d in siblings(witness)).encode()).hexdigest()
            folded = fold(bent or leaf, witness)
            out.append((leaf.hex(), proof, folded.hex(), folded == root))
        leaves, proofs, folded, same = (list(c) for c in zip(*out)) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(leaves, pa.string()), batch.column("subroot"),
             pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())],
            ["key", "leaf", "subroot", "proof_sha256", "folded_root", "verified"])


def witnesses(docs: DataFrame, key: str = "doc_id", tree: str = "lang", count: str = "n_chars",
              fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None,
              height: int = HEIGHT) -> tuple[DataFrame, bytes | None]:
    """((key, digest, bent, tree, subroot, witness) of every row, root of all).

    Trees are the values of column `tree` by UTF-8 bytes, NULL first; in a tree rows ascend by key, NULL first, equal keys by
    digest, so equal rows may change places but not results. `bent` is the digest with 1 added to `count` in
    rows where `tampered` holds, else NULL. An empty table has no root.
    """
    bent = [F.try_add(F.col(f), F.lit(1)) if f == count else F.col(f) for f in fields]
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("="), F.col(tree)), F.lit("")).alias("tree"),
        _leaf(*[F.col(f) for f in fields]).alias("digest"),
        (F.when(tampered, _leaf(*bent)) if tampered is not None else F.lit(None).cast("binary")).alias("bent"))
    leaves, subroots = grow(numbered(rows, ("key", "digest"), "tree", "leaves"), height)
    ordered = numbered(subroots.withColumnRenamed("tree", "name"), ("name",), None, "subroots")
    tops, root = grow(ordered.withColumn("tree", F.lit("")), height)
    last = root.first()
    ends = broadcast_if_small(tops.select(F.col("name").alias("_t"), F.lower(F.hex("digest")).alias("subroot"), F.col("witness").alias("_w")))
    whole = leaves.join(ends, F.col("tree") == F.col("_t"))
    return (whole.select("key", "tree", "digest", "bent", "subroot", F.concat("witness", "_w").alias("witness")),
            bytes(last["digest"]) if last else None)


def manifest(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    Where 7 divides the CRC-32 of the key's decimal digits, the proof is tried on the row with 1 added to n_chars; a
    NULL n_chars stays, so such a row is verified. A NULL key is not tampered with. NULL fields, empty and very
    long texts are leaves like others; equal rows are leaves of their own; an empty table gives no rows; other
    columns of `docs` are not read.
    """
    tampered = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows, root = witnesses(docs, key, tampered=tampered, **how)
    kind = docs.schema[key].dataType.simpleString()
    end = root or b""
    proved = rows.select("key", "digest", "bent", "subroot", "witness").mapInArrow(
        lambda b: _prove(b, end), f"key {kind}, leaf string, subroot string, proof_sha256 string, folded_root string, verified boolean")
    return proved.select(F.col("key").alias(key), "leaf", "subroot", F.lit(end.hex()).alias("root"), "proof_sha256", "folded_root", "verified")
