"""The parser's steps as relations, for tables of cross-references, objects and page trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_entries(entries: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the newest. order: columns from newest to oldest."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return entries.withColumn("_place", place).where("_place = 1").drop("_place")


def resolve_references(references: DataFrame, objects: DataFrame, key: str, target: str) -> DataFrame:
    """Each reference with the object that it names, or nulls: a left join."""
    return references.join(objects, references[key] == objects[target], "left")


def unvisited(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates that were not seen: a left anti join."""
    return candidates.join(seen, keys, "left_anti")


def first_per_document(rows: DataFrame, key: str, order: list, limit: int, name: str = "place") -> DataFrame:
    """The first rows of each document, numbered from 1: page and image limits."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= limit)


def join_texts(rows: DataFrame, key: str, order: str, text: str, between: str = "\n\n") -> DataFrame:
    """(key, text): the texts of a document in order."""
    quoted = between.replace("\n", "\\n")
    return rows.groupBy(key).agg(F.expr(f"listagg({text}, '{quoted}') WITHIN GROUP (ORDER BY {order})").alias("text"))


def walk_tree(edges: DataFrame, roots: DataFrame, max_depth: int = 30) -> DataFrame:
    """(node, depth, path) below the roots (node) over edges (parent, node, ordinal); path orders the nodes as a depth-first walk does.

    A recursive common table expression; a node that its own path already holds is not entered again.
    """
    spark = edges.sparkSession
    edges.createOrReplaceTempView("_tree_edges")
    roots.createOrReplaceTempView("_tree_roots")
    return spark.sql(f"""
        WITH RECURSIVE tree(node, depth, path, visited) AS (
          SELECT node, 0, CAST(array() AS array<bigint>), array(node) FROM _tree_roots
          UNION ALL
          SELECT e.node, t.depth + 1, concat(t.path, array(CAST(e.ordinal AS bigint))), concat(t.visited, array(e.node))
          FROM tree t JOIN _tree_edges e ON e.parent = t.node
          WHERE t.depth < {max_depth} AND NOT array_contains(t.visited, e.node))
        SELECT node, depth, path FROM tree""")  # noqa: S608 names are fixed


def inherit(nodes: DataFrame, key: str, attribute: str, value: str, depth: str) -> DataFrame:
    """(key, attribute, value): for each node and attribute, what the deepest of its ancestors says."""
    return nodes.groupBy(key, attribute).agg(F.max_by(value, depth).alias(value))
