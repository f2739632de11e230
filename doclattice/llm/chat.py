"""Reply trees to conversations: best root-to-leaf paths, formatted with a loss mask.

Only DataFrame functions. A node knows its parent; a self-join of the pointer table with itself
doubles the distance a pointer spans, so a tree of depth d takes log2(d) joins to find every node's
root, depth and path score, and as many again to list the nodes of the chosen paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclattice.llm.tables import text_or_empty, written

# Fixed values of the template. "<" and "[" never occur inside an escaped text, so neither these
# strings nor those of other templates can be forged by a text.
START, MIDDLE, END = "<|start|>", "<|text|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def clean_nodes(nodes: DataFrame) -> DataFrame:
    """One row for a (tree_id, node_id): of repeated ones the smallest (parent, role, text). NULL
    role and text are empty, a NULL score is 0, a parent that does not exist is none."""
    row = F.struct(
        F.col("parent_id").cast("long").alias("parent_id"), text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    return (
        nodes.filter(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull())
        .groupBy(F.col("tree_id").cast("long").alias("tree_id"), F.col("node_id").cast("long").alias("node_id"))
        .agg(F.min(row).alias("row"))
        .select("tree_id", "node_id", "row.*")
    )


def pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Jump tables (tree_id, node_id, up, steps) for 1, 2, 4 ... steps, and per node its depth and
    the sum of scores up to its root. Nodes on or below a cycle have no root and are left out."""
    known = nodes.select("tree_id", F.col("node_id").alias("parent_id"))
    links = nodes.filter(F.col("parent_id").isNotNull()).select("tree_id", "parent_id", "node_id")
    links = links.join(known, ["tree_id", "parent_id"], "left_semi")
    state = written(
        nodes.select("tree_id", "node_id", "score").join(
            links.select("tree_id", "node_id", F.col("parent_id").alias("up")), ["tree_id", "node_id"], "left"
        ).select("tree_id", "node_id", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("sum")),
        "chat-state",
    )
    # Only nodes whose pointer is not at a root yet are joined again; the others are looked up.
    done, jumps, span = state.filter(F.col("up").isNull()), [], 1
    opened = state.filter(F.col("up").isNotNull())
    most = opened.count()
    while span <= 2 * most and not opened.isEmpty():
        jumps.append(opened.select("tree_id", "node_id", "up"))
        above = done.unionByName(opened).select(
            "tree_id", F.col("node_id").alias("up"), F.col("up").alias("up2"),
            F.col("steps").alias("steps2"), F.col("sum").alias("sum2"),
        )
        state = written(
            opened.join(above, ["tree_id", "up"]).select(
                "tree_id", "node_id", F.col("up2").alias("up"),
                (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum"),
            ),
            "chat-state",
        )
        done, opened = done.unionByName(state.filter(F.col("up").isNull())), state.filter(F.col("up").isNotNull())
        span *= 2
    ends = done.select("tree_id", "node_id", F.col("steps").alias("depth"), F.col("sum").alias("path_score"))
    return jumps, ends


def best_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, path_score, node_id, depth) for every node of the chosen paths.

    Leaves are ranked in their tree by the sum of scores on their path (highest first, then the
    smaller leaf id); ``branches=None`` keeps all. Each ancestor is reached once: its distance is a
    unique sum of powers of two, and the jump tables are applied from the longest to the shortest.
    """
    jumps, ends = pointers(nodes)
    parents = nodes.select("tree_id", F.col("parent_id").alias("node_id")).filter("node_id is not null")
    leaves = ends.join(parents.distinct(), ["tree_id", "node_id"], "left_anti")
    order = W.partitionBy("tree_id").orderBy(F.desc("path_score"), "node_id")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        leaves = leaves.filter(F.col("rank") <= branches)
    listed = written(
        leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "rank", "path_score", "node_id", "depth"),
        "chat-paths",
    )
    for k in reversed(range(len(jumps))):
        step = F.lit(1 << k).cast("long")
        above = (
            listed.filter(F.col("depth") > step).join(jumps[k], ["tree_id", "node_id"])
            .select("tree_id", "leaf_id", "rank", "path_score", F.col("up").alias("node_id"),
                    (F.col("depth") - step).alias("depth"))
        )
        listed = written(listed.unionByName(above), "chat-paths")
    return listed


def conversations(nodes: DataFrame, branches: int | None = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: tree_id, leaf_id, rank, path_score, formatted, loss_spans.

    ``formatted`` holds the turns from root to leaf, ``loss_spans`` the code-point ranges (begin,
    end) of ``formatted`` that training learns from. Input: tree_id, node_id, parent_id, role, text,
    score (more columns are ignored); see :func:`clean_nodes` for NULLs and repeated rows. An empty
    table gives no rows. A conversation is one value, so its length bounds a row's size.
    """
    nodes = written(clean_nodes(nodes), "chat-nodes")
    turn = F.struct("depth", "role", "text")
    paths = (
        best_paths(nodes, branches)
        .join(nodes.select("tree_id", "node_id", "role", "text"), ["tree_id", "node_id"])
        .groupBy("tree_id", "leaf_id", "rank", "path_score")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    head = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE))
    parts = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*loss_roles).alias("loss")))
    paths = paths.withColumn("parts", parts).withColumn(
        "formatted", F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))))
    )
    ranges = F.aggregate(
        "parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["loss"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(p["head"])).cast("long").alias("begin"),
                (s["at"] + F.length(p["head"]) + F.length(p["body"])).cast("long").alias("end"),
            )))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return paths.select("tree_id", "leaf_id", "rank", "path_score", "formatted", ranges.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` again: turns array<struct<role,text>> and loss_text."""
    pattern = F.lit(r"<\|start\|>([^<]*)<\|text\|>([^<]*)<\|end\|>\n")
    turns = F.arrays_zip(
        F.transform(F.regexp_extract_all("formatted", pattern, F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all("formatted", pattern, F.lit(2)), unescape).alias("text"),
    )
    masked = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(
        F.substring(F.col("formatted"), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", masked)
