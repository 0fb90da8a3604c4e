"""Merkle manifest of a data set: leaves, roots of groups, one root, and the siblings that prove each leaf.

``H`` is the lowercase hex SHA-256 of its inputs, concatenated. Within a group
every ``FANOUT`` nodes in a row make a parent until one node is left; the
groups' roots make the root in the same way.

Rows are numbered within their groups once. Then ``LEVELS`` levels at a time are
worked out inside pieces of ``FANOUT ** LEVELS`` rows, which hold whole subtrees,
in one exchange by (group, piece): a node of level ``l`` stands in the row of its
first leaf, so its neighbours are ``FANOUT ** l`` rows before and after it.
Lags and leads by these fixed offsets, masked by the node's slot in its run and
by the run's length, give the siblings, and the first-child rows hash parents.
The pieces' tops are the rows of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.llm.common import cut

FANOUT, LEVELS = 3, 7
PIECE = FANOUT**LEVELS


def digest(*inputs: Column) -> Column:
    """H of the inputs; null inputs are left out."""
    return F.sha2(F.concat_ws("", *inputs), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    return digest(*map(encoded, fields))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _numbered(d: DataFrame, order: list[str], name: str) -> DataFrame:
    """``d`` with ``at`` (place from 0 within ``_g``, by ``order``) and ``n`` (rows of ``_g``).

    Rows are dealt to ranges of (group, order, a number), so that neither a hot
    group nor repeated rows are one task, sorted and written; a row's number
    less the first one of its group in the range, plus the group's rows in
    earlier ranges, is its place.
    """
    d = d.withColumn("_tie", F.monotonically_increasing_id())
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "_g", *order, "_tie").sortWithinPartitions("_g", *order, "_tie").drop("_tie")
    d = cut(d.withColumn("_row", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_row", 33))
    per = d.groupBy("_g", "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))  # a row for each range and group in it
    per = cut(per, f"{name}-ranges")
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(w).alias("n"))
    return d.join(per, ["_g", "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_part", "_shift")


def _climbed(d: DataFrame, prove: bool) -> DataFrame:
    """``LEVELS`` levels over rows ``_g, at, n, h``: with ``prove`` every row with ``steps`` (its siblings at each level), else the pieces' tops as ``_g, at, n, h``."""
    d = d.withColumn("_piece", F.floor(F.col("at") / PIECE).cast("long"))
    w = Window.partitionBy("_g", "_piece").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    node, steps = F.col("h"), []
    for level in range(LEVELS):
        far = FANOUT**level
        slot, more = F.floor(F.col("at") / far) % FANOUT, F.col("n") > far
        d = d.withColumns({"_node": node} | {f"_{s}{k}": f(node, k * far).over(w) for k in range(1, FANOUT) for s, f in (("lag", F.lag), ("lead", F.lead)) if prove or s == "lead"})
        first = (F.col("at") % far == 0) & more
        within = lambda s, k: F.when(slot >= k if s == "lag" else slot + k < FANOUT, F.col(f"_{s}{k}"))
        right = F.concat_ws("", *[within("lead", k) for k in range(1, FANOUT)])
        if prove:
            left = F.concat_ws("", *[within("lag", k) for k in range(FANOUT - 1, 0, -1)])
            d = d.withColumn(f"_step{level}", F.when(first, F.struct(left.alias("left"), right.alias("right"))))
            steps.append(F.last(f"_step{level}", ignorenulls=True).over(upto))
        parent = F.when(F.col("at") % (far * FANOUT) == 0, F.when(more, digest(F.col("_node"), right)).otherwise(F.col("_node")))
        d = d.withColumn(f"_h{level}", parent).drop("_node", *[f"_{s}{k}" for k in range(1, FANOUT) for s in ("lag", "lead")])
        node = F.col(f"_h{level}")
    if not prove:
        return d.where(F.col("at") % PIECE == 0).select("_g", F.col("_piece").alias("at"), F.ceil(F.col("n") / PIECE).cast("long").alias("n"), node.alias("h"))
    return d.withColumn("steps", F.array_compact(F.array(*steps))).drop(*[f"_{s}{k}" for k in range(LEVELS) for s in ("step", "h")])


def _trees(d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Trees over numbered rows ``_g, at, n, h``: the rows with ``steps`` to their group's root, and the roots as ``_g, h``."""
    layers = [d]
    while len(layers) == 1 or (layers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        layers.append(cut(_climbed(layers[-1].select("_g", "at", "n", "h"), False), f"{name}-{len(layers)}"))
    above = None
    for layer in reversed(layers[:-1]):
        found = _climbed(layer, True)
        if above is not None:
            upper = above.select("_g", F.col("at").alias("_piece"), F.col("steps").alias("_upper"))
            found = found.join(upper, ["_g", "_piece"]).withColumn("steps", F.concat("steps", "_upper")).drop("_upper")
        above = found.drop("_piece")
    return above, layers[-1].select("_g", "h")


def merkle_manifest(df: DataFrame, fields: list[str], group_col: str = "source", order_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``df``: ``order_col``, ``group_col``, ``leaf``, ``subroot``, ``root``, ``proof`` and the columns of ``carry``.

    A leaf is H of the encoded ``fields``. Leaves of a group ascend by
    ``order_col`` (null first), then by leaf, so that repeated keys have one
    order; repeated rows each have a place. Groups ascend as UTF-8 bytes, null
    first. ``proof`` is an array of ``left`` and ``right``: the siblings before
    and after the node on each level, as one text each, from the leaf up to
    the root; a level whose node is alone in its run has two empty texts.
    ``carry`` is worked out where the row is read; only digests and these
    columns travel. An empty table has no rows. Columns of ``df`` that are not
    named don't matter. Only one number comes to the driver for each round of
    ``LEVELS`` levels.
    """
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group_col).cast("string")))
    carry = carry or {}
    d = df.select(group.alias("_g"), F.col(order_col).alias("_order"), leaf_of(*map(F.col, fields)).alias("h"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in carry.items()]).alias("_carry"))
    rows, roots = _trees(_numbered(d, ["_order", "h"], "leaves"), "tree")
    # the groups' roots are the leaves of one more tree
    tops = _numbered(roots.select(F.lit("").alias("_g"), F.col("_g").alias("_group"), "h"), ["_group"], "roots")
    tops, root = _trees(tops, "top")
    tops = tops.select(F.col("_group").alias("_g"), F.col("h").alias("subroot"), F.col("steps").alias("_upper")).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))  # one row
    out = rows.join(tops, "_g")
    name = F.when(F.col("_g") != "", F.substring("_g", 2, 2**31 - 1)).cast(df.schema[group_col].dataType)
    return out.select(F.col("_order").alias(order_col), name.alias(group_col), F.col("h").alias("leaf"), "subroot", "root", F.concat("steps", "_upper").alias("proof"), *[F.col("_carry")[k].alias(k) for k in carry])


def oracle(fields: list[str], levels: int = 12, table: str = "documents") -> str:
    """The contract's rows over ``table`` as SQL, for groups of at most ``FANOUT ** levels`` rows."""
    enc = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda **new: f"sha256({' || '.join(enc(new.get(c, c)) for c in fields)})"
    run, slot = f"pos // {FANOUT}", f"pos % {FANOUT}"
    ctes = [f"""tab AS (SELECT list(c ORDER BY i) t FROM (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(i))),
leaves AS (SELECT doc_id, coalesce('+' || source, '') g, {leaf()} h, {leaf(text="replace(text, chr(10), '')")} bare,
 xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 2 = 0 AS even FROM {table}, tab),
a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) n, row_number() OVER () AS k FROM leaves),
n0 AS (SELECT g, pos, h, n FROM a0)"""]

    def climb(x: str, count: int) -> str:
        """Nodes of each level as ``x``0, ``x``1 ... and the siblings of each node as ``s``."""
        for i in range(count):
            ctes.append(f"{x}{i + 1} AS (SELECT g, pos // {FANOUT} AS pos, sha256(string_agg(h, '' ORDER BY pos)) h, (min(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {x}{i} WHERE n > 1 GROUP BY g, pos // {FANOUT})")
            ctes.append(f"{x}s{i} AS (SELECT a.g, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') r FROM {x}{i} a JOIN {x}{i} b ON a.g = b.g AND a.pos // {FANOUT} = b.pos // {FANOUT} WHERE a.n > 1 GROUP BY a.g, a.pos)")
        return " UNION ALL ".join(f"SELECT g, h FROM {x}{i} WHERE n = 1" for i in range(count + 1))

    ctes.append(f"roots AS ({climb('n', levels)})")
    ctes.append("t0 AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () n FROM roots)")
    tops = climb("t", levels)
    ctes.append(f"top AS ({tops})")
    last = "SELECT k, doc_id, g, pos, h AS leaf, CASE WHEN even THEN bare ELSE h END AS f, '' AS proof FROM a0"
    for x, place, group in (("n", "pos", "g"), ("t", "pos", "''")):
        for i in range(levels):
            ctes.append(f"{x}f{i} AS ({last})")
            prev = f"{x}f{i}"
            last = f"SELECT k, doc_id, p.g, p.pos // {FANOUT} AS pos, leaf, CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, proof || coalesce(s.l || s.r, '') AS proof FROM {prev} p LEFT JOIN {x}s{i} s ON s.g = {group if group != 'g' else 'p.g'} AND s.pos = p.pos"
        if x == "n":
            ctes.append(f"nf AS ({last})")
            last = "SELECT k, doc_id, nf.g, t0.pos, leaf, f, proof FROM nf JOIN t0 ON t0.name = nf.g"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, roots.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = top.h AS verified FROM ({last}) z JOIN roots ON roots.g = z.g, top"""
