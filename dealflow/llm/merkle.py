"""A Merkle manifest of a dataset, folded from retained hash states.

Each row is a leaf; each source has a tree over its leaves in order of doc_id, whose root is the subroot, and the
subroots have a tree of their own. A parent is the SHA-256 of its children, at most 16, one after another. While it is
hashed, the state before each child's slot is copied and kept. To fold a replaced child, the state before its slot is
resumed with the replacement and the siblings to its right only; those to its left are in the state already.

Rows are never gathered by source: leaves get their place from a sort by ranges, and 256 consecutive ones (two levels)
are the most a group holds. Trees are climbed group by group, and what a group stands for is a node of the next round,
of which there are 1/256 as many. Going down again, each group meets one row: the runs of siblings from its node up
to the root. hashlib cannot write its states down, so states of the levels above a group are made again from their left
siblings, once a group, and resumed from there by all its rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

FAN, DIGEST = 16, 64
#: Levels that one group climbs; it holds at most FAN ** LEVELS nodes.
LEVELS = 2
GROUP = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def counted(x: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(counted, cols)), 256)


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    d = 0
    while FAN**d < n:
        d += 1
    return d


def climb(nodes: list[bytes], levels: int) -> tuple[list[list[bytes]], list[list]]:
    """Digests of each level from the nodes up, and of each level above them the states before each child's slot."""
    digests, states = [nodes], []
    for _ in range(levels):
        above, kept = [], []
        for i in range(0, len(digests[-1]), FAN):
            h = hashlib.sha256()
            for child in digests[-1][i : i + FAN]:
                kept.append(h.copy())
                h.update(child)
            above.append(h.hexdigest().encode())
        digests.append(above)
        states.append(kept)
    return digests, states


def _runs_above(digests: list[list[bytes]], at: int, levels: int) -> bytes:
    """From a node up, level by level: its slot, the size of its run, and the digests of the run."""
    out = []
    for level in digests[:levels]:
        first = at - at % FAN
        run = level[first : first + FAN]
        out += [bytes([at - first, len(run)]), *run]
        at //= FAN
    return b"".join(out)


def _read_runs(path: bytes) -> list[tuple[bytes, bytes]]:
    """Siblings to the left and to the right, level by level."""
    out, at = [], 0
    while at < len(path):
        slot, size = path[at], path[at + 1]
        run = path[at + 2 : at + 2 + size * DIGEST]
        out.append((run[: slot * DIGEST], run[(slot + 1) * DIGEST :]))
        at += 2 + size * DIGEST
    return out


class Path:
    """The way from a node to the root, with a hash state for each level that has taken in the siblings to the left."""

    def __init__(self, path: bytes):
        self.levels = []
        for left, right in _read_runs(path):
            self.levels.append((hashlib.sha256(left), left, right))
        self.siblings = b"".join(left + right for _, left, right in self.levels)

    def fold(self, digest: bytes) -> bytes:
        for state, _, right in self.levels:
            h = state.copy()
            h.update(digest)
            h.update(right)
            digest = h.hexdigest().encode()
        return digest


def _group_levels(n: int, base: int) -> int:
    """Levels that a group whose nodes stand base levels above the leaves of a tree of n still has to climb."""
    return max(0, min(LEVELS, depth(n) - base))


def _up(nodes: DataFrame, tree_type: str, base: int) -> DataFrame:
    """The node of each group. nodes: (tree, idx, n, digest), base levels above their tree's leaves."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows["idx"]))
        digests, _ = climb([d.encode() for d in rows["digest"].take(pa.array(order)).to_pylist()], _group_levels(rows["n"][0].as_py(), base))
        one = {"tree": rows["tree"].slice(0, 1), "idx": pa.array([int(np.asarray(rows["idx"])[0]) // GROUP], pa.int64()), "n": rows["n"].slice(0, 1)}
        return pa.table(one | {"digest": pa.array([digests[-1][0].decode()], pa.string())})

    groups = nodes.select("tree", "idx", "n", "digest", F.shiftright("idx", 4 * LEVELS).alias("g")).groupBy("tree", "g")
    return groups.applyInArrow(C.lean(run), f"tree {tree_type}, idx long, n long, digest string")


def _renamed(above: DataFrame):
    """Paths grouped under names of their own, as they stem from the nodes that they meet."""
    return above.select(F.col("tree").alias("t"), F.col("idx").alias("i"), F.col("path").alias("path"), F.col("top").alias("top")).groupBy("t", "i")


def _paths(nodes: DataFrame, above: DataFrame, tree_type: str, base: int) -> DataFrame:
    """(tree, idx, path, top) of nodes, from the paths of the nodes that their groups stand for."""

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows["idx"]))
        rows = rows.take(pa.array(order))
        levels, rest = _group_levels(rows["n"][0].as_py(), base), up["path"][0].as_py()
        digests, _ = climb([d.encode() for d in rows["digest"].to_pylist()], levels)
        paths = [_runs_above(digests, i, levels) + rest for i in range(rows.num_rows)]
        return pa.table({"tree": rows["tree"], "idx": rows["idx"], "path": pa.array(paths, pa.binary()), "top": pa.array([up["top"][0].as_py()] * len(paths), pa.string())})

    left = nodes.select("tree", "idx", "n", "digest", F.shiftright("idx", 4 * LEVELS).alias("g")).groupBy("tree", "g")
    return left.cogroup(_renamed(above)).applyInArrow(C.lean_pair(run), f"tree {tree_type}, idx long, path binary, top string")


class _Forest:
    """Trees over nodes (tree, idx, n, digest): rounds of groups up to (tree, digest) of the roots, and paths down again."""

    def __init__(self, nodes: DataFrame):
        self.tree_type = nodes.schema["tree"].dataType.simpleString()
        self.rounds = [nodes]
        deepest = depth(nodes.agg(F.max("n")).first()[0] or 0)
        base, roots = 0, None
        while True:
            last = C.saved(_up(self.rounds[-1], self.tree_type, base))
            base += LEVELS
            done = last.where(F.col("n") <= FAN**base)
            roots = done if roots is None else roots.union(done)
            if base >= deepest:
                break
            self.rounds.append(last.where(F.col("n") > FAN**base))
        self.roots = roots.select("tree", "digest")

    def down(self, roots: DataFrame) -> DataFrame:
        """(tree, idx, path, top) of the groups of the leaves. roots: (tree, path, top), the way from each root on and its digest."""
        paths = None
        for k in range(len(self.rounds) - 1, -1, -1):
            # Trees whose root is a node of this round join with their own paths.
            base = k * LEVELS
            ends = self.rounds[k].where((F.col("n") <= FAN ** (base + LEVELS)) & (F.col("idx") == 0)).select("tree", "idx")
            ends = ends.join(roots.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).select("tree", "idx", "path", "top")
            above = ends if paths is None else paths.union(ends)
            if k == 0:
                return above
            paths = C.saved(_paths(self.rounds[k], above, self.tree_type, base))


def manifest(docs: DataFrame, replaced: dict[str, Column] | None = None, where: Column | None = None, cols: tuple[str, ...] = COLUMNS, with_proof: bool = True) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified), with proof (array of siblings) if with_proof.

    cols: the id, the source and the further columns that a leaf is made of. replaced: columns to put in place of others
    where the condition holds; folded_root is what the replaced leaf folds to, from states that the tree keeps, and verified
    whether that is the root. Other rows fold their own leaf.

    A null takes part as "-"; a null source is a source of its own and the first, a null id is the least of its source. Rows
    of one id and source are ordered by their leaf, so equal rows take neighbouring places and the root does not depend on
    how the table is read. An empty text is a value, a very long one is hashed in the JVM. An empty table gives
    an empty result. Other columns are left out, whatever their names.
    """
    id_col, source_col = cols[:2]
    id_type = docs.schema[id_col].dataType.simpleString()
    at = lambda c: F.col(f"`{c}`")
    changed = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    new = F.when(changed, leaf(*((replaced or {}).get(c, at(c)) for c in cols)))
    leaves = docs.select(at(id_col).alias("id"), at(source_col).alias("tree"), leaf(*map(at, cols)).alias("digest"), new.alias("new"))
    # Equal rows are told apart by their place in the file, so that ranges of the sort can part them.
    leaves = C.ranked(leaves.withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "tree", ["id", "digest", "place"])
    leaves = C.saved(leaves.select("id", "tree", "idx", "n", "digest", "new"))
    sources = _Forest(leaves.select("tree", "idx", "n", "digest"))
    subroots = C.ranked(sources.roots.select(F.lit(0).alias("all"), F.col("tree").alias("source"), "digest"), "all", ["source"])
    subroots = C.saved(subroots.select(F.col("all").alias("tree"), "source", "idx", "n", "digest"))
    top = _Forest(subroots.select("tree", "idx", "n", "digest"))
    root = top.roots.first()
    root = root["digest"] if root else ""
    # The paths of groups of subroots, then of subroots, then of groups of leaves.
    up = top.down(top.roots.select("tree", F.lit(b"").alias("path"), F.lit("").alias("top")))
    paths = _paths(subroots.select("tree", "idx", "n", "digest"), up, "int", 0).select("idx", "path")
    above = sources.down(C.saved(subroots.join(paths, "idx").select(F.col("source").alias("tree"), "path", F.col("digest").alias("top"))))

    def run(rows: pa.Table, up: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(np.asarray(rows["idx"]))))
        nodes = [d.encode() for d in rows["digest"].to_pylist()]
        levels = _group_levels(rows["n"][0].as_py(), 0)
        beyond, subroot = Path(up["path"][0].as_py()), up["top"][0].as_py()
        digests, states = climb(nodes, levels)
        runs = [[b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)] for level in digests[:levels]]
        cols_ = {c: [] for c in ("proof_sha256", "folded_root", "proof")}
        for i, new in enumerate(rows["new"].to_pylist()):
            digest, at, siblings = new.encode() if new else nodes[i], i, []
            for level in range(levels):
                parent, slot = divmod(at, FAN)
                siblings.append(runs[level][parent][: slot * DIGEST])
                right = runs[level][parent][(slot + 1) * DIGEST :]
                siblings.append(right)
                h = states[level][at].copy()
                h.update(digest)
                h.update(right)
                digest, at = h.hexdigest().encode(), parent
            proof = b"".join(siblings) + beyond.siblings
            cols_["proof_sha256"].append(hashlib.sha256(proof).hexdigest())
            cols_["folded_root"].append(beyond.fold(digest).decode())
            if with_proof:
                cols_["proof"].append([proof[k : k + DIGEST].decode() for k in range(0, len(proof), DIGEST)])
        out = {"id": rows["id"], "leaf": rows["digest"], "subroot": pa.array([subroot] * len(nodes), pa.string()), "root": pa.array([root] * len(nodes), pa.string())}
        out |= {c: pa.array(cols_[c], pa.string()) for c in ("proof_sha256", "folded_root")}
        out["verified"] = pa.array([f == root for f in cols_["folded_root"]], pa.bool_())
        if with_proof:
            out["proof"] = pa.array(cols_["proof"], pa.list_(pa.string()))
        return pa.table(out)

    groups = leaves.withColumn("g", F.shiftright("idx", 4 * LEVELS)).groupBy("tree", "g")
    schema = f"id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<string>" * with_proof
    return groups.cogroup(_renamed(above)).applyInArrow(C.lean_pair(run), schema).withColumnRenamed("id", id_col)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest() of all documents, where texts of a fifth of the ids are lower-cased (A-Z); see there for nulls, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, {"text": lower}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, with_proof=False)


_ENCODED = ", ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in COLUMNS)
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)"
_SIDES = "coalesce(string_agg(h, '') OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft, coalesce(string_agg(h, '') OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt"
SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents),
l AS (SELECT doc_id, source, sha256(concat({_ENCODED})) AS leaf, sha256(concat({_ENCODED.replace('text', 'other')})) AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, lv, i, h, n) AS (SELECT source, 0, i, leaf, n FROM l UNION ALL SELECT source, lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16 FROM t WHERE n > 1 GROUP BY source, lv, i // 16),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, i, h, n) AS (SELECT 0, i, subroot, n FROM sub UNION ALL SELECT lv + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 15) // 16 FROM u WHERE n > 1 GROUP BY lv, i // 16),
p AS (SELECT source, lv, i, {_SIDES.format(by="source, lv, i // 16")} FROM t WHERE n > 1),
q AS (SELECT lv, i, {_SIDES.format(by="lv, i // 16")} FROM u WHERE n > 1),
steps AS (SELECT l.source, l.i, p.lv, p.lft, p.rgt FROM l JOIN p ON p.source IS NOT DISTINCT FROM l.source AND p.i = l.i >> (4 * p.lv)
  UNION ALL SELECT l.source, l.i, 100 + q.lv, q.lft, q.rgt FROM l JOIN sub ON sub.source IS NOT DISTINCT FROM l.source JOIN q ON q.i = sub.i >> (4 * q.lv)),
way AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY lv) AS k FROM steps),
f(source, i, k, h) AS (SELECT source, i, 0::BIGINT, other FROM l UNION ALL SELECT f.source, f.i, w.k, sha256(w.lft || f.h || w.rgt) FROM f JOIN way w ON w.source IS NOT DISTINCT FROM f.source AND w.i = f.i AND w.k = f.k + 1),
folded AS (SELECT source, i, arg_max(h, k) AS folded_root FROM f GROUP BY source, i),
proofs AS (SELECT source, i, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof_sha256 FROM way GROUP BY source, i)
SELECT l.doc_id, l.leaf, sub.subroot, r.h AS root, coalesce(proofs.proof_sha256, sha256('')) AS proof_sha256, folded.folded_root, folded.folded_root = r.h AS verified
FROM l JOIN sub ON sub.source IS NOT DISTINCT FROM l.source JOIN folded ON folded.source IS NOT DISTINCT FROM l.source AND folded.i = l.i
LEFT JOIN proofs ON proofs.source IS NOT DISTINCT FROM l.source AND proofs.i = l.i, (SELECT h FROM u WHERE n = 1) r
"""
