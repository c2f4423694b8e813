"""Nested records to related flat tables, by shared inlining.

The schema is analysed as a graph. Structs that occur once below their parent are inlined into its row. Arrays and
maps are repeated and get a table of their own; repeated fields of one parent with the same element type share a
table, told apart by a column ``branch``. Schemas are finite, those that Spark infers from JSON too, so an element that
contains itself can't occur: each level of such a record is a type of its own.

Every row bears its parent's whole key, which is the foreign key, and its own part: ``<table>_key`` for an entry of a
map, ``<table>_pos`` for one of an array. The root's key is made of its natural key and ``doc_no``, a
number of the record's content. Elements of one struct type
below different parents share a table too: ``parent`` names the parent's table, and key columns of other parents are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffloom.session import spool


@dataclass
class Node:
    """A table to be: where its elements are found below the parent's element, and what is inlined into its rows."""

    name: str
    branches: list[tuple[str, ...]]
    element: T.DataType
    is_map: bool = False
    inlined: list[tuple[str, ...]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)


def analyse(schema: T.StructType, root: str = "root", names: dict[tuple[str, ...], str] | None = None, skip: tuple[str, ...] = ()) -> Node:
    """The tables that ``schema`` needs. ``names`` gives a table's name by the path of field names to its (first)
    repeated field, where that of a map's or array's element goes on with the element's own fields."""
    node = Node(root, [()], T.StructType([f for f in schema.fields if f.name not in skip]))
    _grow(node, (), names or {}, set())
    return node


def _grow(node: Node, path: tuple[str, ...], names: dict, taken: set[str]) -> None:
    taken.add(node.name)
    repeated: list[tuple[tuple[str, ...], T.DataType]] = []

    def walk(kind: T.DataType, at: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, (*at, f.name))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            repeated.append((at, kind))
        else:
            node.inlined.append(at)

    walk(node.element, ())
    shared: dict[str, list[tuple[tuple[str, ...], T.DataType]]] = {}
    for at, kind in repeated:
        # only structs are shared: two lists of plain strings need not mean the same thing
        element = kind.elementType if isinstance(kind, T.ArrayType) else None
        key = element.json() if isinstance(element, T.StructType) else ".".join(at)
        shared.setdefault(key, []).append((at, kind))
    for group in shared.values():
        first, kind = group[0]
        is_map = isinstance(kind, T.MapType)
        name = names.get((*path, *first)) or "_".join(x if x.isidentifier() else f"f{i}" for i, x in enumerate((*path, *first)))
        while name in taken:
            name += "_"
        child = Node(name, [at for at, _ in group], kind.valueType if is_map else kind.elementType, is_map)
        node.children.append(child)
        _grow(child, (*path, *first), names, taken)


def _at(base: Column, path: tuple[str, ...]) -> Column:
    for name in path:
        base = base.getField(name)
    return base


#: Hex digits of a record's digest in its number: 60 bits tell the records of one key apart.
DIGITS = 15


def numbered(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` without repeated documents; ``doc_no`` tells the different ones of a key apart, and is the same in every run.

    The number is made of the record's own digest, so that no key, however often it occurs or whether it is null, is counted
    through in one task. Records are shuffled once, by digest; copies are dropped before. Nulls are keys too.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])), 256)
    marked = rows.withColumn("_digest", F.unhex(digest))
    marked = marked.withColumn("_copy", F.row_number().over(Window.partitionBy("_digest").orderBy(F.lit(1)))).filter("_copy = 1")
    number = F.conv(F.substring(F.hex("_digest"), 1, DIGITS), 16, 10).cast("bigint")
    return marked.withColumn("doc_no", number).drop("_digest", "_copy")


def shared_inline(
    rows: DataFrame,
    keys: tuple[str, ...],
    root: str = "root",
    names: dict[tuple[str, ...], str] | None = None,
    carry: dict[str, tuple[str, ...]] | None = None,
    materialise: bool = True,
) -> dict[str, DataFrame]:
    """All tables of nested ``rows``, by name.

    ``keys`` are root columns that identify a record; several different records of one key get different ``doc_no``,
    repeated ones appear once. ``carry`` names plain fields of a table's element that its descendants bear too, as
    ``<table>_<field>``. Each table has ``n_<child>`` for each child table: the number of its children, 0 for a null or
    empty one. A null element gives a row of nulls; a null or empty list or map gives no rows; an empty input gives
    empty tables. Inlined columns are named by their path joined with ``_``; a name that clashes, also with a key,
    gets ``_`` appended. With ``materialise`` the records are stored once in the shared folder, from where each table
    reads only its own fields.
    """
    if "doc_no" in rows.columns:
        rows = rows.withColumnRenamed("doc_no", "doc_no_")
    records = numbered(rows, keys)
    if materialise:
        records = spool(records, "records")
    node = analyse(rows.schema, root, names, skip=keys)
    tables: dict[str, DataFrame] = {}
    base = records.select(*keys, "doc_no", F.struct(*[F.col(f"`{f.name}`") for f in node.element.fields]).alias("_e"))
    _emit(base, [*keys, "doc_no"], node, tables, carry or {})
    return _share(node, tables)


def _share(root: Node, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` in which elements of one struct type below different parents have one table, named by the first."""
    found: dict[str, list[tuple[str, str]]] = {}

    def walk(node: Node) -> None:
        for child in node.children:
            if isinstance(child.element, T.StructType):
                found.setdefault(child.element.json(), []).append((child.name, node.name))
            walk(child)

    walk(root)
    out = dict(tables)
    for group in found.values():
        if len(group) < 2:
            continue
        union = None
        for name, parent in group:
            rows = out.pop(name)
            rows = rows.withColumn("parent_" if "parent" in rows.columns else "parent", F.lit(parent))
            union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
        out[group[0][0]] = union
    return out


def _emit(base: DataFrame, key: list[str], node: Node, tables: dict[str, DataFrame], carry: dict[str, tuple[str, ...]]) -> None:
    element = F.col("_e")
    used, columns = set(key), []
    for path in node.inlined:
        name = "_".join(path) or "value"
        while name in used:
            name += "_"
        used.add(name)
        columns.append(_at(element, path).alias(name))
    counts = []
    for child in node.children:
        sizes = [F.coalesce(F.greatest(F.size(_at(element, b)), F.lit(0)), F.lit(0)) for b in child.branches]
        counts.append(sum(sizes[1:], sizes[0]).alias(f"n_{child.name}"))
    tables[node.name] = base.select(*key, *columns, *counts)
    carried = [(f"{node.name}_{f}", element.getField(f)) for f in carry.get(node.name, ())]
    above = [*key, *[n for n, _ in carried]]
    for child in node.children:
        rows, own = base.select(*key, *[c.alias(n) for n, c in carried], "_e"), []
        if len(child.branches) > 1:
            lists = F.array(*[F.struct(F.lit(".".join(b)).alias("branch"), _at(element, b).alias("items")) for b in child.branches])
            rows = rows.select(*above, F.explode(lists).alias("_b"))
            items, own = F.col("_b.items"), ["branch"]
            above_, extra = [*above, F.col("_b.branch").alias("branch")], ["branch"]
        else:
            items, above_, extra = _at(element, child.branches[0]), above, []
        part = f"{child.name}_key" if child.is_map else f"{child.name}_pos"
        if child.is_map:
            rows = rows.select(*above_, F.explode(items).alias(part, "_e"))
        else:
            rows = rows.select(*above_, F.posexplode(items).alias(part, "_e"))
        _emit(rows, [*above, *extra, part], child, tables, carry)


#: Table names for annotation documents.
ANNOTATION_NAMES = {
    ("changes",): "files",
    ("changes", "+"): "lines",
    ("changes", "+", "tokens"): "tokens",
    ("changes", "+", "tokens", "type"): "token_types",
    ("commit_metadata", "parents"): "parents",
    ("diff_metadata",): "metrics",
}


def inline_annotations(annotations: DataFrame) -> dict[str, DataFrame]:
    """patches, files, lines, tokens, token_types, parents and metrics of annotation documents.

    files have files_key (the file's name); lines branch (side) and lines_pos; tokens also lines_id, their line's id.
    """
    kept = annotations.select("bug_id", "patch_id", "format_version", "commit_metadata", "changes", "diff_metadata")
    return shared_inline(kept, ("bug_id", "patch_id"), "patches", ANNOTATION_NAMES, {"lines": ("id",)})


def branch_ends(tables: dict[str, DataFrame]) -> DataFrame:
    """The ends of every branch of the tables of :func:`inline_annotations`, each once.

    A token gives its line's id and its own idx (-1 for null); a line without tokens token_idx -1; a file without
    lines, or null, side '' and -1 for both.
    """
    key = ["bug_id", "patch_id", F.col("files_key").alias("file_name")]
    none = F.lit(-1)
    tokens = tables["tokens"].select(*key, F.col("branch").alias("side"), F.coalesce("lines_id", none).alias("line_id"), F.coalesce("idx", none).alias("token_idx"))
    lines = tables["lines"].filter("n_tokens = 0").select(*key, F.col("branch").alias("side"), F.coalesce("id", none).alias("line_id"), none.alias("token_idx"))
    files = tables["files"].filter("n_lines = 0").select(*key, F.lit("").alias("side"), none.alias("line_id"), none.alias("token_idx"))
    return tokens.unionByName(lines).unionByName(files).distinct()
