"""Flow tables (src, dst, n) from paths through directories to kinds of lines, and their simplification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from diffloom.functions.scalars import adjusted_depth, ancestors, parent
from diffloom.session import cut


def summed(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def directory_rollup(counts: DataFrame, path: str = "file_name", kind: str = "kind") -> DataFrame:
    """Edges of counts (path, kind, n): directory to kind, and each directory's link to its parent with all it holds."""
    per_dir = counts.select(parent(F.col(path)).alias("dir"), F.col(kind).alias("kind"), "n").groupBy("dir", "kind").agg(F.sum("n").alias("n"))
    to_kind = per_dir.select(F.col("dir").alias("src"), F.col("kind").alias("dst"), "n")
    up = per_dir.filter("dir NOT IN ('.', '/')").select(F.explode(ancestors(F.col("dir"))).alias("e"), "n").select(F.col("e.parent").alias("src"), F.col("e.child").alias("dst"), "n")
    return summed(to_kind.unionByName(up))


def split_directories(counts: DataFrame, path: str = "file_name", kind: str = "kind") -> DataFrame:
    """Edges of counts (path, kind, n): every link of every path, and each file to its kinds."""
    links = counts.select(F.explode(ancestors(F.col(path))).alias("e"), "n").select(F.col("e.parent").alias("src"), F.col("e.child").alias("dst"), "n")
    return summed(links.unionByName(counts.select(F.col(path).alias("src"), F.col(kind).alias("dst"), "n")))


def kind_of_node(node: Column) -> Column:
    """Whether a node is a kind of line, which starts with ``type.`` or stands in brackets."""
    return node.rlike(r"^(type\.|\[)")


def files_to_directories(edges: DataFrame) -> DataFrame:
    """Edges in which every file, a node with edges to kinds, is the node ``dir/*`` of its directory (``./*`` at the top)."""
    files = edges.filter(kind_of_node(F.col("dst"))).select(F.col("src").alias("node")).distinct().withColumn("holder", F.concat(parent(F.col("node")), F.lit("/*")))
    named = lambda side: files.select(F.col("node").alias(side), F.col("holder").alias(f"{side}_holder"))
    joined = edges.join(named("src"), "src", "left").join(named("dst"), "dst", "left")
    return summed(joined.select(F.coalesce("src_holder", "src").alias("src"), F.coalesce("dst_holder", "dst").alias("dst"), "n"))


def own_node(directory: Column) -> Column:
    """The node of a directory's own files."""
    return F.concat(F.lit("__"), directory, F.lit("__"))


def own_files(edges: DataFrame) -> DataFrame:
    """Edges in which a directory with both sub-directories and kinds sends its kinds through a node of its own, ``__dir__``."""
    to_kind, same = kind_of_node(F.col("dst")), Window.partitionBy("src")
    marked = edges.withColumn("_both", F.bool_or(to_kind).over(same) & F.bool_or(~to_kind).over(same))
    moved = F.col("_both") & to_kind
    links = F.when(moved, F.array(F.struct("src", own_node(F.col("src")).alias("dst")), F.struct(own_node(F.col("src")).alias("src"), "dst"))).otherwise(F.array(F.struct("src", "dst")))
    return summed(marked.select(F.explode(links).alias("e"), "n").select("e.src", "e.dst", "n"))


def limit_depth(edges: DataFrame, most: int) -> DataFrame:
    """Edges between nodes of at most ``most`` parts: deeper nodes become ``.../**`` of their first parts, links among them vanish."""
    short = lambda c: F.when(F.size(F.split(c, "/")) > most, F.concat(F.array_join(F.slice(F.split(c, "/"), 1, most), "/"), F.lit("/**"))).otherwise(F.col(c))
    deep = lambda c: adjusted_depth(F.col(c)) > most
    to_kind = kind_of_node(F.col("dst"))
    kept = edges.filter(to_kind | ~(deep("src") & deep("dst")))
    return summed(kept.select(F.when(to_kind & deep("src"), short("src")).otherwise(F.col("src")).alias("src"), F.when(~to_kind & deep("dst"), short("dst")).otherwise(F.col("dst")).alias("dst"), "n"))


def limit_width(edges: DataFrame, most: float) -> DataFrame:
    """Edges without the nodes into which ``most`` lines or fewer flow: what they send to kinds goes through ``parent/**``.

    Of thin nodes below each other the topmost counts. Paths are compared by whole parts, so ``a/b`` doesn't hold ``a/bc``.
    """
    to_kind = kind_of_node(F.col("dst"))
    thin = edges.filter(~to_kind & (F.col("n") <= most)).select(F.col("dst").alias("thin")).distinct()
    nodes = edges.select("src").unionByName(edges.filter(~to_kind).select(F.col("dst").alias("src"))).distinct().filter("src <> '.'")
    above = nodes.select("src", F.explode(ancestors(F.col("src"))).alias("e")).select(F.col("src").alias("node"), F.col("e.child").alias("thin"))
    top = above.join(thin, "thin").groupBy("node").agg(F.min_by("thin", F.length("thin")).alias("thin"))
    of_dst = top.select(F.col("node").alias("dst"), F.lit(True).alias("dst_thin"))
    joined = edges.join(of_dst, "dst", "left").filter("dst_thin IS NULL").join(top.withColumnRenamed("node", "src"), "src", "left")
    over = F.concat(parent(F.col("thin")), F.lit("/**"))
    links = F.when(to_kind & F.col("thin").isNotNull(), F.array(F.struct(parent(F.col("thin")).alias("src"), over.alias("dst")), F.struct(over.alias("src"), "dst"))).otherwise(F.array(F.struct("src", "dst")))
    return summed(joined.select(F.explode(links).alias("e"), "n").select("e.src", "e.dst", "n"))


def contract(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the nodes of ``gone`` (node, into), each into its parent: what they send goes out from there."""
    left = edges.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    moved = left.join(gone.select(F.col("node").alias("src"), "into"), "src", "left")
    return summed(moved.select(F.coalesce("into", "src").alias("src"), "dst", "n"))


def _links(column: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit("/"), F.lit("")))


def reduce_tail(edges: DataFrame) -> DataFrame:
    """Edges without the deepest level of directories, and without own nodes of the directories above them; their kinds go out from there.

    Unchanged if a directory of that level sends to other than kinds, or if no directory has another in its path.
    """
    dirs = edges.filter(~kind_of_node(F.col("dst")))
    level = edges.select(F.max(_links("src"))).scalar()
    inner = dirs.select(F.coalesce(F.max(_links("src")), F.lit(-1))).scalar()
    last = dirs.filter((level > 0) & (inner < level) & (_links("dst") == level)).select(F.col("dst").alias("node"), F.col("src").alias("into"))
    own = dirs.filter(F.col("dst") == own_node(F.col("src"))).join(last.select(F.col("into").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("into"))
    return contract(edges, last.unionByName(own).distinct())


def thin_out(edges: DataFrame, share: float, root: str = ".") -> DataFrame:
    """Edges without directories of less than ``share`` of what leaves the root: their kinds go out from their parents.

    A directory goes if an edge from it is as thin as that, all its lines together are, it has no sub-directories, it isn't a
    node of own files, and it doesn't lie at the root. So what flows into each directory that stays also leaves it.
    """
    least = edges.filter(F.col("src") == root).select(F.coalesce(F.sum("n"), F.lit(0)) * share).scalar()
    leaves = edges.groupBy("src").agg(F.min("n").alias("thinnest"), F.sum("n").alias("every"), F.bool_and(kind_of_node(F.col("dst"))).alias("leaf"))
    thin = leaves.filter(F.col("leaf") & (F.col("thinnest") < least) & (F.col("every") < least)).select(F.col("src").alias("dst"))
    inner = edges.filter((F.col("src") != root) & (F.col("dst") != own_node(F.col("src"))))
    return contract(edges, inner.join(thin, "dst").select(F.col("dst").alias("node"), F.col("src").alias("into")))


def kind_totals(edges: DataFrame) -> DataFrame:
    """(dst, n) of the kinds of lines."""
    return edges.filter(kind_of_node(F.col("dst"))).groupBy("dst").agg(F.sum("n").alias("n"))


def process(counts: DataFrame, share: float = 0.0, most_files: int | None = None) -> DataFrame:
    """Roll-up with own files, thinned out if ``share`` lies between 0 and 1; of the ``most_files`` files with the most lines, if given.

    Files with as many lines are taken by name.
    """
    if most_files is not None:
        counts = cut(counts)
        top = counts.groupBy("file_name").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "file_name").limit(most_files)
        counts = counts.join(top.select("file_name"), "file_name", "left_semi")
    edges = own_files(directory_rollup(counts))
    # stored, as it is read four times
    return thin_out(cut(edges), share) if 0 < share < 1 else edges


def process_patches(counts: DataFrame, most_parts: int, most_thin: float) -> DataFrame:
    """Directories of split paths, limited in depth and then in width: the flow of a choice of patches, such as an author's."""
    split = cut(split_directories(counts))
    return limit_width(cut(limit_depth(files_to_directories(split), most_parts)), most_thin)


def labels(edges: DataFrame, root: str) -> DataFrame:
    """Edges with nodes as shown: ``.`` as ``{root}``, ``type.X`` as ``[X]``."""
    shown = lambda c: F.regexp_replace(F.when(F.col(c) == ".", "{" + root + "}").otherwise(F.col(c)), r"^type\.(.*)$", "[$1]")
    return edges.select(shown("src").alias("src"), shown("dst").alias("dst"), "n")


def mermaid(edges: DataFrame) -> DataFrame:
    """(line): the lines of a Sankey text, quoted where they need it."""
    cell = lambda c: F.when(F.col(c).rlike('[,"]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return edges.select(F.concat_ws(",", cell("src"), cell("dst"), F.col("n").cast("string")).alias("line"))
