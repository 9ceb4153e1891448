"""Merkle manifest of a table: a root per branch and over all, and a proof for every row.

The rows of a branch are numbered in order and cut into aligned blocks. A block keeps each of its
levels as one string of hex digests: fixed-width substrings of a level are hashed to the next one, and
the substrings that flank a node in its run are its siblings. The tops of the blocks are the nodes of
the next tier, and so on; the roots of the branches make a tree of their own in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadgrain.llm.shared import documents, stored

#: Nodes that are hashed to one, and levels that a block spans: a block has FANOUT ** LEVELS nodes at most.
FANOUT, LEVELS = 2, 10
#: Hex digits of a digest.
WIDTH = 64
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def told(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*[told(v) for v in values]), 256)


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``pos``, their place from 0 in their branch, and ``n``, the rows of the branch.

    ``order`` must tell all rows of a branch apart. The table is sorted by ranges, so that a branch
    with most rows is spread over many tasks; only one row per task and branch is summed up.
    """
    keys = [*by, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumns({"task": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    runs = ranged.groupBy("task", *by).agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("here"))
    branch = Window.partitionBy(*by)
    before = F.sum("here").over(branch.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("task", *by, "head", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(branch).alias("n"))
    placed = ranged.join(runs, ["task", *by])
    return placed.withColumn("pos", F.col("at") - F.col("head") + F.col("before")).drop("task", "at", "head", "before")


class Tree:
    """The tiers of blocks over numbered nodes: ``by``, ``pos``, ``n``, ``node`` and columns to ``carry``."""

    def __init__(
        self, nodes: DataFrame, by: Sequence[str], carry: Sequence[str] = (), *, fanout: int = FANOUT, levels: int = LEVELS
    ) -> None:
        self.by, self.carry, self.fanout = list(by), list(carry), fanout
        #: Nodes of a block under one node of each level; a level is needed where a branch has more nodes than that.
        self.spans = f"array({', '.join(f'{fanout**j}L' for j in range(levels))})"
        self.block = fanout**levels
        self.tiers = [self._blocks(nodes, self.carry)]
        while (self.tiers[-1].agg(F.max("n")).first()[0] or 0) > self.block:
            up = self.tiers[-1].select(
                *self.by, F.col("block").alias("pos"), F.ceil(F.col("n") / self.block).alias("n"), F.col("top").alias("node")
            )
            self.tiers.append(self._blocks(up, []))

    def _blocks(self, nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
        """One row per aligned block: members in order, its levels as strings, and its top node."""
        member = F.struct("pos", "node", *carry)
        block = F.expr(f"pos div {self.block}L").alias("block")
        blocks = nodes.groupBy(*self.by, "n", block).agg(F.sort_array(F.collect_list(member)).alias("members"))
        blocks = blocks.withColumn("base", F.expr("cast(array_join(transform(members, m -> m.node), '') as binary)"))
        run = self.fanout * WIDTH
        parents = (
            f"cast(array_join(transform(sequence(0, (length(element_at(acc, -1)) - 1) div {run}), "
            f"i -> sha2(substring(element_at(acc, -1), int(i) * {run} + 1, {run}), 256)), '') as binary)"
        )
        levels = f"aggregate(filter({self.spans}, s -> n > s), array(base), (acc, s) -> array_append(acc, {parents}))"
        blocks = blocks.withColumn("levels", F.expr(levels)).drop("base")
        return stored(blocks.withColumn("top", F.expr("cast(element_at(levels, -1) as string)")), "blocks")

    def roots(self) -> DataFrame:
        """``by`` and the root of each branch."""
        return self.tiers[-1].select(*self.by, F.col("top").alias("root"))

    def paths(self, above: DataFrame) -> DataFrame:
        """Every node with its way up: ``steps``, the left and right siblings of each level.

        ``above`` has one row per branch: ``by``, further columns to pass on, and ``steps`` that go on
        from the branch's root.
        """
        passed = [c for c in above.columns if c not in (*self.by, "steps")]
        up, on = above, self.by
        for tier, carry in [*[(t, []) for t in self.tiers[:0:-1]], (self.tiers[0], self.carry)]:
            up = up.withColumnRenamed("steps", "further")
            rows = tier.join(up, on).select(*self.by, *passed, "n", "block", "levels", "further", F.explode("members").alias("m"))
            at = f"int(m.pos - block * {self.block}L)"
            own = f"(({at}) div s)"  # place in the level
            head = f"({own} - {own} % {self.fanout})"  # place of the run's first node
            piece = f"levels[j], int({{start}}) * {WIDTH} + 1, int({{size}}) * {WIDTH}"
            left = piece.format(start=head, size=f"({own} - {head})")
            right = piece.format(start=f"({own} + 1)", size=f"({head} + {self.fanout} - {own} - 1)")
            steps = f"transform(filter({self.spans}, s -> n > s), (s, j) -> struct(substring({left}) as l, substring({right}) as r))"
            rows = rows.withColumn("steps", F.concat(F.expr(steps), F.col("further")))
            up = rows.select(*self.by, *passed, "steps", *[F.col(f"m.{c}").alias(c) for c in ("pos", "node", *carry)])
            if carry is not self.carry:
                up, on = up.drop("node").withColumnRenamed("pos", "block"), [*self.by, "block"]
        return up


NO_STEPS = "cast(array() as array<struct<l: binary, r: binary>>)"


def proof(steps: str = "steps") -> Column:
    """Digest of all siblings on the way up, left to right."""
    return F.expr(f"sha2(cast(array_join(transform({steps}, s -> cast(concat(s.l, s.r) as string)), '') as binary), 256)")


def folded(node: str, steps: str = "steps") -> Column:
    """The root that a node and the siblings on its way up make."""
    hashed = "sha2(concat(s.l, cast(acc as binary), s.r), 256)"
    return F.expr(f"aggregate({steps}, {node}, (acc, s) -> {hashed})")


def manifest(
    df: DataFrame,
    *,
    branch: str = "lang",
    order: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = LEVELS,
) -> DataFrame:
    """Every row of ``df`` with its leaf, subroot, root and ``steps`` from leaf to root.

    Columns: ``order``, leaf, those of ``carry``, subroot, root, steps. NULL is a branch of its own and
    comes first, as does a NULL in ``order``; rows that share an ``order`` are told apart by their leaf,
    and equal rows each have a place. Empty and very long texts are hashed like others. Other columns
    are not read. An empty table has no rows here.
    """
    carried = carry or {}
    # A branch's name sorts like its value, NULL first, and is never NULL.
    name = F.coalesce(F.concat(F.lit("="), F.col(branch).cast("string")), F.lit(""))
    leaves = df.select(
        name.alias("branch"), F.col(order).alias("key"), leaf([F.col(c) for c in fields]).alias("node"),
        *[c.alias(n) for n, c in carried.items()], F.monotonically_increasing_id().alias("row"),
    )
    placed = positions(stored(leaves, "leaves"), ["branch"], ["key", "node", "row"]).drop("row")
    tree = Tree(placed, ["branch"], ["key", *carried], fanout=fanout, levels=levels)
    subroots = tree.roots().withColumnRenamed("root", "node").withColumn("whole", F.lit(0))
    whole = Tree(positions(subroots, ["whole"], ["branch"]), ["whole"], ["branch"], fanout=fanout, levels=levels)
    start = whole.roots().withColumn("steps", F.expr(NO_STEPS))
    tops = whole.paths(start).select("branch", F.col("node").alias("subroot"), "root", "steps")
    rows = tree.paths(tops)
    return rows.select(
        F.col("key").alias(order), F.col("node").alias("leaf"), *carried, "subroot", "root", "steps",
    )


def tampered(df: DataFrame) -> Column:
    """The leaf of a row after one was added to its n_chars, where 7 divides the crc32 of its id; NULL elsewhere."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return F.when(chosen, leaf([changed.get(c, F.col(c)) for c in FIELDS]))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``, and what each proof makes of a row that may have been tampered with.

    A NULL id is never tampered with.
    """
    docs = documents(spark, sf_dir)
    rows = manifest(docs, carry={"other": tampered(docs)})
    rows = rows.withColumn("folded_root", folded("coalesce(other, leaf)"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _crc32(text: str) -> str:
    """SQL for the crc32 of an ASCII text: a list is folded byte by byte, and each byte bit by bit."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    chars = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, b: {bits}), 4294967295)"


def _sql_told(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def sql() -> str:
    """The manifest in SQL: levels by a recursive query, then one climb per row."""
    plain = " || ".join(_sql_told(c) for c in FIELDS)
    other = " || ".join(_sql_told("n_chars::HUGEINT + 1" if c == "n_chars" else c) for c in FIELDS)
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS branch, sha256({plain}) AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN sha256({other}) END AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY branch) AS n
  FROM leaves
), nodes AS (
  SELECT branch, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT a.branch, a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
  FROM nodes a LEFT JOIN nodes b ON a.branch = b.branch AND b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.n > 1
), branches AS (
  SELECT branch, node, row_number() OVER (ORDER BY branch) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, node FROM branches
  UNION ALL
  SELECT a.level + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.node || coalesce(b.node, ''))
  FROM tops a LEFT JOIN tops b ON b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.n > 1
), climb AS (
  SELECT doc_id, branch, pos AS row, leaf, other, 0 AS level, pos, n, coalesce(other, leaf) AS fold, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.branch, c.row, c.leaf, c.other, c.level + 1, c.pos // 2, (c.n + 1) // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.node || c.fold ELSE c.fold || coalesce(s.node, '') END), c.proof || coalesce(s.node, '')
  FROM climb c LEFT JOIN nodes s ON s.branch = c.branch AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
), arrived AS (
  SELECT c.doc_id, c.branch, c.row, c.leaf, b.node AS subroot, c.fold, c.proof, b.pos, b.n
  FROM climb c JOIN branches b USING (branch) WHERE c.n = 1
), further AS (
  SELECT *, 0 AS level FROM arrived
  UNION ALL
  SELECT c.doc_id, c.branch, c.row, c.leaf, c.subroot,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.node || c.fold ELSE c.fold || coalesce(s.node, '') END),
    c.proof || coalesce(s.node, ''), c.pos // 2, (c.n + 1) // 2, c.level + 1
  FROM further c LEFT JOIN tops s ON s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
)
SELECT f.doc_id, f.leaf, f.subroot, t.node AS root, sha256(f.proof) AS proof_sha256, f.fold AS folded_root,
  f.fold = t.node AS verified
FROM further f, (SELECT node FROM tops WHERE n = 1) t
WHERE f.n = 1
"""
