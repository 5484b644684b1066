"""Merkle dataset manifest: built levels as parent-linked node rows, and a recursive query that climbs from each leaf.

A leaf is the digest of a row's fields; the leaves of a group (source), in order of the key, are the lowest level of its tree;
FAN consecutive nodes become one of the next level until one is left, the group's root; the groups' roots, in order of the group
(null first), make the manifest's tree in the same way. Digests are lower-case hex SHA-256 of digests as hex text, end to end.

manifest() writes every inner node once as a row: its own key (tree, level, place), its parent's key, its slot there, and
its children's digests in order (FAN at most). prove() is a recursive query: from a leaf's row it joins the parent's row, appends a
row that names it and so the siblings, folds the (maybe tampered) digest with them and goes on from the parent, until there is none. So each step joins by
equality on a key that FAN rows of the step before share at most per node below; only the highest nodes are shared by more rows, and
these are few rows, which Spark splits. Up to BROADCAST_NODES inner nodes are broadcast instead.

Places are numbered without a window over a group, which may hold a third of all rows: rows are sorted by ranges,
and a row's place is its place in its range plus the rows of its group in the ranges before (`placed`).

Nulls: a null field is digested as `-`, a null group is a group of its own and comes first, null keys come first in their
group; a null key's row is never tampered with by op11. Rows of one key and group are told apart by their digests, and equal rows
are leaves each; as their digests are equal, it doesn't matter which comes first. Empty and very long texts are digested whole.
An empty table has no nodes and gives no rows. Columns that aren't named as fields take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlens.llm.store import forget, keep, table

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels that a pass makes: of FAN ** STEPS digests, 256 kB, at a time.
STEPS = 3
#: The number of the tree above the groups' trees.
TOP = -1
#: Inner nodes (about 1.1 kB each) that are broadcast at most; more are joined by shuffles, with the same result.
BROADCAST_NODES = 1 << 16


def digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each `-` if null, else its byte count, `:` and its text."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def joined(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def lowered(c: Column) -> Column:
    """`c` with A-Z as a-z, and nothing else changed."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, group: str | None, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """`rows` with `place`, from 0 within their `group` by `order`, and the table it reads, to be forgotten."""
    lead = [F.col(group).asc_nulls_first()] if group else []
    # equal rows are dealt out by a number of their own, so that no range holds all of them
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id())
    by = [*lead, *order, F.col("__tie")]
    held = keep(ranged.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).drop("__tie"), "placed")
    part = F.shiftright("__at", 33)
    own = [F.col(group).alias("__group")] if group else [F.lit(0).alias("__group")]
    ranges = held.groupBy(*own, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    same = (part == F.col("__part")) & (F.col(group).eqNullSafe(F.col("__group")) if group else F.lit(True))
    out = held.join(ranges, same).withColumn("place", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__at", "__group", "__part", "__first", "__before"), held


@dataclass(frozen=True)
class Manifest:
    """leaves: the rows with leaf, parent (its key) and slot. nodes: inner nodes. roots: group, subroot. root: the manifest's."""

    leaves: DataFrame
    nodes: DataFrame
    roots: DataFrame
    root: str | None
    tables: tuple[DataFrame, ...]

    def forget(self) -> None:
        for held in self.tables:
            forget(held)


def key_of(tree: Column, level: Column | int, place: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), place.cast("long").alias("place"))


NO_KEY = "struct<tree:bigint,level:int,place:bigint>"


def levels(bottom: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The inner nodes over `bottom` (tree, place, n, digest; n: nodes of the tree): tree, level, place, n (nodes of its level), digest,
    children. A pass makes STEPS levels of each FAN ** STEPS consecutive nodes, so that few passes are made."""
    below, level, out = bottom, 0, []
    # behind a generator, so that what refers to an array doesn't make it again for each of its parts
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    while True:
        grown = below.filter("n > 1").groupBy("tree", F.floor(F.col("place") / FAN**STEPS).cast("long").alias("run")).agg(F.max("n").alias("n"), F.collect_list(F.struct("place", "digest")).alias("got"))
        grown = grown.select("tree", "run", "n", once(F.transform(F.array_sort("got"), lambda x: x["digest"]), "digests"))
        for step in range(1, STEPS + 1):
            part = lambda i: F.slice("digests", i * FAN + 1, FAN)
            wide = F.ceil(F.col("n") / FAN).cast("long")
            high, runs = F.lit(level + step), F.col("run") * FAN ** (STEPS - step)
            node = lambda i: F.struct(
                high.alias("level"), (runs + i).cast("long").alias("place"), wide.alias("n"), joined(part(i)).alias("digest"), part(i).alias("children"))
            # a tree that has come down to one node has no more levels
            nodes = F.transform(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.floor((F.size("digests") - 1) / FAN).cast("int"))).otherwise(F.array().cast("array<int>")), node)
            grown = grown.select("tree", "run", *[f"level{k}" for k in range(1, step)], "n", once(nodes, f"level{step}"))
            grown = grown.withColumns({"n": wide, "digests": F.transform(f"level{step}", lambda x: x["digest"])})
        grown = grown.select("tree", F.explode(F.concat(*[F.col(f"level{k}") for k in range(1, STEPS + 1)])).alias("node")).select("tree", "node.*")
        level += STEPS
        held = keep(grown, f"merkle-{level}")
        tables.append(held)
        out.append(held)
        below = held.filter(F.col("level") == level)
        if below.filter("n > 1").isEmpty():
            return _all(out)


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def manifest(rows: DataFrame, group: str = "source", key: str = "doc_id", leaf: str = "leaf") -> Manifest:
    """Builds the trees over `rows`, which hold a digest in column `leaf`. Columns of theirs should be few and short: they are kept."""
    tables: list[DataFrame] = []
    leaves, held = placed(rows, group, [F.col(key).asc_nulls_first(), F.col(leaf).asc()])
    tables.append(held)
    sizes = leaves.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("n"))
    numbered, held = placed(sizes, None, [F.col("__g").asc_nulls_first()])
    tables.append(held)
    numbered = numbered.withColumnRenamed("place", "tree")
    leaves = keep(leaves.join(numbered, F.col(group).eqNullSafe(F.col("__g"))).drop("__g"), "merkle-leaves")
    tables.append(leaves)
    inner = levels(leaves.select("tree", "place", "n", F.col(leaf).alias("digest")), tables)
    # a tree's root is its node on a level of one; of a tree of one leaf that leaf
    tops = inner.filter("n = 1").select("tree", "digest").unionByName(leaves.filter("n = 1").select("tree", F.col(leaf).alias("digest")))
    roots = keep(numbered.join(tops, "tree").select(F.col("__g").alias(group), "tree", F.col("digest").alias("subroot")), "merkle-roots")
    tables.append(roots)
    groups = roots.count()
    over = levels(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(groups).cast("long").alias("n"), F.col("subroot").alias("digest")), tables)
    peak = over.filter("n = 1") if groups > 1 else roots.withColumn("digest", F.col("subroot"))
    found = peak.select("digest").first()

    def linked(level: Column | int) -> tuple[Column, Column]:
        """The parent's key and the slot there, of a node (tree, place, n) at `level`."""
        higher = (F.lit(level) if isinstance(level, int) else level) + 1
        parent = F.when(F.col("n") > 1, key_of(F.col("tree"), higher, F.floor(F.col("place") / FAN)))
        if groups > 1:
            parent = parent.when(F.col("tree") != TOP, key_of(F.lit(TOP), 1, F.floor(F.col("tree") / FAN)))
        slot = F.when((F.col("n") == 1) & (F.col("tree") != TOP), F.col("tree") % FAN).otherwise(F.col("place") % FAN)
        return parent.otherwise(F.lit(None).cast(NO_KEY)).alias("parent"), slot.cast("int").alias("slot")

    nodes = inner.unionByName(over).select(key_of(F.col("tree"), F.col("level"), F.col("place")).alias("node"), *linked(F.col("level")), "digest", "children")
    linked_leaves = leaves.select(*rows.columns, "tree", "place", *linked(0))
    return Manifest(linked_leaves, nodes, roots, found[0] if found else None, tuple(tables))


def prove(leaves: DataFrame, nodes: DataFrame, digest: str = "leaf", carry: list[str] | None = None) -> DataFrame:
    """For each of `leaves` (tree, place, parent, slot and a digest, maybe a tampered one): `carry`, folded_root, and siblings, the
    digests met on the way up, from left to right and level by level.

    The climb is one recursive query over the stored nodes. A row of it names the node that its step met and the slot below it; the
    siblings are read from that node once more when a leaf's rows meet at the end, as bytes, so that the steps carry none of them. A
    recursion has a row for each leaf and level, so the session's limit on such rows (spark.sql.cteRecursionRowLimit) is
    lifted; the levels are as many as the trees are high.
    """
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    nodes = nodes.select("node", "parent", "slot", "children")
    nodes = F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes
    names = [f"`{c}`" for c in (carry or [])]
    kinds = [leaves.schema[c].dataType.simpleString() for c in (carry or [])]
    lead, none = "".join(f"{c}, " for c in names), "".join(f"CAST(NULL AS {k}), " for k in kinds)
    first = "".join(f"first(c.{c}, true) AS {c}, " for c in names)
    return spark.sql(
        f"""
        WITH RECURSIVE climb AS (
          SELECT {lead}tree, place, 0 AS step, parent, slot, `{digest}` AS folded, CAST(NULL AS {NO_KEY}) AS met, CAST(NULL AS int) AS seat FROM {{leaves}}
          UNION ALL
          SELECT {none}c.tree, c.place, c.step + 1, f.parent, f.slot,
            sha2(concat(array_join(slice(f.children, 1, c.slot), ''), c.folded, array_join(slice(f.children, c.slot + 2, {FAN}), '')), 256),
            f.node, c.slot
          FROM climb c JOIN {{nodes}} f ON c.parent.tree = f.node.tree AND c.parent.level = f.node.level AND c.parent.place = f.node.place
        ),
        path AS (
          SELECT {first}max_by(c.folded, c.step) AS folded_root,
            aggregate(array_sort(collect_list(struct(c.step AS step, unhex(concat(array_join(slice(f.children, 1, c.seat), ''), array_join(slice(f.children, c.seat + 2, {FAN}), ''))) AS met))),
              CAST('' AS binary), (a, x) -> concat(a, coalesce(x.met, CAST('' AS binary)))) AS met
          FROM climb c LEFT JOIN {{nodes}} f ON c.met.tree = f.node.tree AND c.met.level = f.node.level AND c.met.place = f.node.place
          GROUP BY c.tree, c.place
        )
        SELECT {lead}folded_root, CASE WHEN octet_length(met) = 0 THEN CAST(array() AS array<string>)
          ELSE transform(sequence(0, CAST(octet_length(met) DIV 32 AS int) - 1), i -> lower(hex(substring(met, i * 32 + 1, 32)))) END AS siblings FROM path
        """,
        leaves=leaves,
        nodes=nodes,
    )


def dataset_manifest(docs: DataFrame, tamper: Callable[[Column], Column] = lowered, due: Column | None = None, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> tuple[DataFrame, Manifest]:
    """Each row's key, leaf, subroot, folded_root and siblings, with the manifest. `due`: rows whose text is tampered with before folding."""
    due = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False)) if due is None else due
    own = [F.col(c) for c in fields]
    given = [F.when(due, tamper(F.col(c))).otherwise(F.col(c)) if c == text else F.col(c) for c in fields]
    built = manifest(docs.select(F.col(key), F.col(group), digest(own).alias("leaf"), digest(given).alias("given")), group, key)
    climbed = prove(built.leaves, built.nodes, "given", [key, group, "leaf"])
    named = built.roots.select(F.col(group).alias("__g"), "subroot")
    return climbed.join(named, climbed[group].eqNullSafe(F.col("__g"))).drop("__g", group), built


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    found, built = dataset_manifest(table(spark, sf_dir, "documents"))
    root = F.lit(built.root).cast("string")
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), joined(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


#: CRC-32 bit by bit; trees and climbs as recursive queries.
SQL = """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t FROM range(256) AS r(x)),
told AS (
  SELECT doc_id, source, lang, n_chars, text, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 5 = 0, false) AS due
  FROM documents, crc),
altered AS (
  SELECT *, CASE WHEN due THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM told),
leaves AS (
  SELECT doc_id, source, leaf, given, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS given FROM altered)),
low AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, max(level) + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY tree, place // 16),
subroots AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (
  SELECT -1::BIGINT AS tree, 0 AS level, tree AS place, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT -1, max(level) + 1, place // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY place // 16),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
kin AS (SELECT tree, level, place // 16 AS up, list(digest ORDER BY place) AS children FROM nodes WHERE n > 1 GROUP BY tree, level, place // 16),
at_levels AS (SELECT tree, level, max(n) AS n FROM nodes GROUP BY tree, level),
climb AS (
  SELECT doc_id, source, leaf, tree AS home, tree, 0 AS level, place, n, given AS folded, '' AS siblings, false AS done FROM leaves
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.home, CASE WHEN c.n = 1 THEN -1 ELSE c.tree END, CASE WHEN c.n = 1 THEN 0 ELSE c.level + 1 END, CASE WHEN c.n = 1 THEN c.tree ELSE c.place // 16 END,
    CASE WHEN c.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 15) // 16 END,
    CASE WHEN c.n = 1 THEN c.folded ELSE sha256(array_to_string(k.children[: c.place % 16], '') || c.folded || array_to_string(k.children[c.place % 16 + 2 :], '')) END,
    CASE WHEN c.n = 1 THEN c.siblings ELSE c.siblings || array_to_string(k.children[: c.place % 16], '') || array_to_string(k.children[c.place % 16 + 2 :], '') END,
    false
  FROM climb c LEFT JOIN kin k ON k.tree = c.tree AND k.level = c.level AND k.up = c.place // 16
  WHERE NOT (c.n = 1 AND c.tree = -1))
SELECT c.doc_id, c.leaf, s.digest AS subroot, r.digest AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = r.digest AS verified
FROM climb c JOIN subroots s ON s.tree = c.home, (SELECT digest FROM high WHERE n = 1) r
WHERE c.n = 1 AND c.tree = -1
"""
