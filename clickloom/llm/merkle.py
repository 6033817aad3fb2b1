"""A Merkle manifest of a dataset: one digest for all, and for each document a proof that it is in it.

Documents are leaves. Each language has a tree over its leaves in order of id,
and the trees' roots are the leaves of one more tree. Levels are built one by
one: nodes are joined with their siblings, whose places follow from their own
(the lowest bit flipped in binary trees, else offsets within the run of slots),
and the node in slot zero emits the parent. On the way down each node hands
its path to the root to its children, so a level costs what it has nodes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import pick, settle
from clickloom.llm.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
# Levels joined in one job on the way down.
_STRIDE = 6
_PATH = "array<struct<before:binary,after:binary>>"


def digest(value: Column) -> Column:
    """SHA-256, as 32 bytes, of a string in UTF-8."""
    return F.unhex(F.sha2(value, 256))


def spelled(binary: Column) -> Column:
    """Digests as lowercase hexadecimal text."""
    return F.lower(F.hex(binary))


def leaf_text(fields: Mapping[str, Column]) -> Column:
    """What a leaf is the digest of: each field as its byte count, a colon and itself; null as a hyphen."""

    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.concat(*[one(fields[name]) for name in FIELDS])


def _joined_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes with ``before`` and ``after``: the digests of their run's other nodes, left and right of them."""
    slot = F.pmod("idx", F.lit(arity))
    out = nodes
    before, after = [], []
    for offset in range(1, arity):
        place = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot + offset, F.lit(arity))
        others = nodes.select(
            F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_digest{offset}")
        )
        out = out.withColumn("_place", place)
        out = out.join(others, (F.col("tree") == F.col("_tree")) & (F.col("_place") == F.col("_idx")), "left")
        out = out.drop("_tree", "_idx", "_place")
        found = F.coalesce(f"_digest{offset}", F.lit(b""))
        before.append(F.when(slot + offset >= arity, found).otherwise(F.lit(b"")))
        after.append(F.when(slot + offset < arity, found).otherwise(F.lit(b"")))
    return out.select(*nodes.columns, F.concat(*before).alias("before"), F.concat(*after).alias("after"))


def _levels(nodes: DataFrame, arity: int, purpose: str) -> list[DataFrame]:
    """Each level of the trees of nodes (tree, idx, n, digest, …), settled, with siblings; leaves first.

    A tree's last level has its one node left, for which n is 1.
    """
    levels = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        level = settle(_joined_siblings(nodes, arity), f"{purpose}-{len(levels)}")
        levels.append(level)
        if most <= 1:
            return levels
        most = -(-most // arity)
        whole = F.concat(spelled(F.col("before")), spelled(F.col("digest")), spelled(F.col("after")))
        emitters = level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(arity)) == 0))
        nodes = emitters.select(
            "tree", F.expr(f"idx DIV {arity}").alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
            digest(whole).alias("digest"),
        )


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): what remains of each tree."""
    out = None
    for level in levels:
        top = level.where("n = 1").select("tree", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def _paths(levels: list[DataFrame], arity: int, purpose: str) -> DataFrame:
    """The first level with ``path``: its siblings, its parent's siblings, and so on to the top."""
    none = F.array().cast(_PATH)
    upper = None
    for at in range(len(levels) - 1, -1, -1):
        step = F.array(F.struct("before", "after"))
        if upper is None:
            # Here each tree that has come so far has its one node.
            paths = levels[at].withColumn("path", none)
        else:
            above = upper.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
            same = (F.col("tree") == F.col("_tree")) & (F.expr(f"idx DIV {arity}") == F.col("_idx")) & (F.col("n") > 1)
            own = F.when(F.col("n") > 1, F.concat(step, "_path")).otherwise(none)
            paths = levels[at].join(above, same, "left").withColumn("path", own)
        if at == 0:
            return paths.drop("before", "after", "_tree", "_idx", "_path")
        upper = paths.select("tree", "idx", "path")
        if at % _STRIDE == 0:
            upper = settle(upper, f"{purpose}-paths")
    raise AssertionError("no levels")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give, spelled."""
    return F.aggregate(
        path, spelled(leaf),
        lambda at, step: F.sha2(F.concat(spelled(step["before"]), at, spelled(step["after"])), 256),
    )


def manifest(docs: DataFrame, arity: int = ARITY, altered: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, path, folded_root, verified.

    ``path`` lists, from leaf to root, the digests that stand before and after
    the node in its run of ``arity``; a run's only node has neither. Digests
    are 32 bytes, ``folded_root`` is spelled. It is computed from the path and
    from a leaf made of the document's fields, of which ``altered`` replaces
    some, as if the document had been changed since; ``verified`` tells whether
    it equals the root.

    Leaves of a language are in order of id, null first, and of digest where
    ids are equal; a null language is the first of the trees. Repeated rows are
    leaves of their own. No documents, no rows and no root. Columns other than
    the five fields are read only if ``altered`` names them.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    fields = {name: F.col(name) for name in FIELDS}
    leaves = pick(docs, **{name: name for name in FIELDS}).select(
        "doc_id", "lang", digest(leaf_text(fields)).alias("digest"),
        digest(leaf_text({**fields, **(altered or {})})).alias("claimed"),
    )
    leaves = ranked(leaves, ["lang"], ["doc_id", "digest"], "leaves")
    leaves = settle(leaves, "ranked-leaves")
    trees = leaves.groupBy("lang").agg(F.first("n").alias("size")).withColumn("all", F.lit(0))
    trees = ranked(trees, ["all"], ["lang"], "trees").select(
        F.col("lang").alias("of_lang"), F.col("idx").alias("tree"), F.col("n").alias("trees")
    )
    trees = settle(trees, "numbered-trees")
    nodes = leaves.join(trees.drop("trees"), F.col("lang").eqNullSafe(F.col("of_lang"))).drop("lang", "of_lang")
    levels = _levels(settle(nodes, "leaf-nodes"), arity, "level")
    subroots = settle(_tops(levels), "subroots")
    heads = subroots.join(trees, "tree").select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), "digest"
    )
    upper = _levels(settle(heads, "heads"), arity, "head")
    top = _tops(upper).first()
    root = F.lit(bytes(top["digest"]) if top else None).cast("binary")
    heads = _paths(upper, arity, "head").select(
        F.col("idx").alias("tree"), F.col("digest").alias("subroot"), root.alias("root"), F.col("path").alias("head_path")
    )
    heads = settle(heads, "head-paths")
    done = _paths(levels, arity, "level").join(heads, "tree").withColumn("path", F.concat("path", "head_path"))
    done = done.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return done.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root",
        (F.col("folded_root") == spelled(F.col("root"))).alias("verified"),
    )


def proof_text(path: Column) -> Column:
    """The siblings of a path as one text, level by level, left to right."""
    steps = F.transform(path, lambda s: F.concat(spelled(s["before"]), spelled(s["after"])))
    return F.array_join(steps, "")
