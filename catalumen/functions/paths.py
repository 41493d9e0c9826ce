"""Category paths (``a>b>c``) and relative file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalumen.functions.text import strip_ends

# Fixed values.
PATH_SEPARATOR = ">"
IMAGE_EXTENSIONS = r"(?i)\.(jpg|jpeg|png)$"


def parse_path(path: Column) -> Column:
    """Node list, or null when a node is empty or not made of digits."""
    nodes = F.split(path, PATH_SEPARATOR)
    return F.when(F.forall(nodes, lambda node: node.rlike(r"^\p{Nd}+$")), nodes)


def path_parts(path: Column) -> Column:
    nodes = parse_path(path)
    return F.struct(
        nodes.alias("category_path"),
        F.size(nodes).alias("depth"),
        F.element_at(nodes, 1).alias("root_category_id"),
        F.element_at(nodes, -1).alias("leaf_category_id"),
    )


def path_errors(path: Column, nodes: Column, depth: Column, root: Column, leaf: Column) -> Column:
    """Names of the structural disagreements between a path and its derived fields.

    A root or leaf that is missing never agrees with anything.
    """
    has_path = path.isNotNull() & (F.trim(path) != "")
    parts = F.split(path, PATH_SEPARATOR)
    has_nodes = nodes.isNotNull() & (F.size(nodes) > 0)

    def flag(name: str, condition: Column) -> Column:
        return F.when(condition, F.lit(name))

    return F.array_compact(F.array(
        flag("category_id_path_not_string", ~has_path | path.isNull()),
        flag("category_path_not_list", nodes.isNull()),
        flag("depth_not_integer", depth.isNull()),
        flag("category_path_depth_mismatch", F.size(nodes) != depth),
        flag("category_id_path_depth_mismatch", has_path & (F.size(parts) != depth)),
        flag("root_category_id_mismatch", has_path & ~root.eqNullSafe(F.element_at(parts, 1))),
        flag("leaf_category_id_mismatch", has_path & ~leaf.eqNullSafe(F.element_at(parts, -1))),
        flag("root_category_id_path_mismatch",
             has_nodes & ~root.eqNullSafe(F.try_element_at(nodes, F.lit(1)))),
        flag("leaf_category_id_path_mismatch",
             has_nodes & ~leaf.eqNullSafe(F.try_element_at(nodes, F.lit(-1)))),
    ))


def path_prefixes(nodes: Column) -> Column:
    """``{node_id, parent, depth}`` for every prefix of a node list."""
    return F.transform(
        F.sequence(F.lit(1), F.size(nodes)),
        lambda i: F.struct(
            F.array_join(F.slice(nodes, F.lit(1), i), PATH_SEPARATOR).alias("node_id"),
            F.when(i > 1, F.array_join(F.slice(nodes, F.lit(1), i - 1), PATH_SEPARATOR)).alias("parent"),
            i.alias("depth"),
        ),
    )


def common_depth(a: Column, b: Column) -> Column:
    """Depth of the deepest common ancestor of two paths: their equal nodes from the root on; zero if one is missing."""
    left, right = F.split(a, PATH_SEPARATOR), F.split(b, PATH_SEPARATOR)
    shorter = F.least(F.size(left), F.size(right))
    same = F.zip_with(F.slice(left, F.lit(1), shorter), F.slice(right, F.lit(1), shorter), lambda x, y: x == y)
    first_other = F.array_position(same, F.lit(False))
    depth = F.when(first_other > 0, first_other - 1).otherwise(shorter)
    return F.when(a.isNotNull() & b.isNotNull(), depth).otherwise(0).cast("int")


def tree_distance(a: Column, b: Column) -> Column:
    """Steps from one node up to the deepest common ancestor and down to the other."""
    return (F.size(F.split(a, PATH_SEPARATOR)) + F.size(F.split(b, PATH_SEPARATOR)) - 2 * common_depth(a, b)).cast("int")


def relative_path(path: Column) -> Column:
    """Forward slashes, no surrounding space; null when empty or leaving the root."""
    value = F.regexp_replace(strip_ends(path), r"\\", "/")
    return F.when((value != "") & ~value.rlike(r"(^|/)\.\.(/|$)") & ~value.startswith("/"), value)


def has_image_extension(path: Column) -> Column:
    return path.rlike(IMAGE_EXTENSIONS)
