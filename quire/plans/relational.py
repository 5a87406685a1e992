"""What is relational about a corpus, as plans that Catalyst sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel.content import OPERATOR_CLASS
from ..session import checkpointed


def latest(revisions: DataFrame) -> DataFrame:
    """The newest entry of each object: rev 0 is the newest section."""
    rest = [c for c in revisions.columns if c not in ("doc_id", "obj_id")]
    best = revisions.groupBy("doc_id", "obj_id").agg(F.min_by(F.struct(*rest), "rev").alias("e"))
    return best.select("doc_id", "obj_id", *(F.col(f"e.{c}").alias(c) for c in rest))


def oldest(revisions: DataFrame) -> DataFrame:
    """The entry that wins if every older section overwrites."""
    rest = [c for c in revisions.columns if c not in ("doc_id", "obj_id")]
    best = revisions.groupBy("doc_id", "obj_id").agg(F.max_by(F.struct(*rest), "rev").alias("e"))
    return best.select("doc_id", "obj_id", *(F.col(f"e.{c}").alias(c) for c in rest))


def references(object_kv: DataFrame) -> DataFrame:
    """Edges of the reference graph."""
    return object_kv.where("kind = 'ref'").select("doc_id", F.col("obj_id").alias("from_id"), "path", F.col("ref_id").alias("to_id"))


def dangling(object_kv: DataFrame, entries: DataFrame) -> DataFrame:
    """References to objects that no entry in use has."""
    known = entries.where("kind <> 'free'").select("doc_id", F.col("obj_id").alias("to_id"))
    return references(object_kv).join(known, ["doc_id", "to_id"], "left_anti")


def reachable(object_kv: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, obj_id) of what roots(doc_id, obj_id) lead to: frontier joins until nothing is new, which cycles come to as well."""
    checkpointed(object_kv.sparkSession)
    edges = references(object_kv).select("doc_id", F.col("from_id").alias("obj_id"), "to_id").distinct().checkpoint()
    seen = frontier = roots.select("doc_id", "obj_id").distinct().checkpoint()
    while not frontier.isEmpty():
        frontier = frontier.join(edges, ["doc_id", "obj_id"]).select("doc_id", F.col("to_id").alias("obj_id")).distinct().join(seen, ["doc_id", "obj_id"], "left_anti").checkpoint()
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def page_tree(object_kv: DataFrame, max_levels: int = 100) -> DataFrame:
    """(doc_id, page_no, page_obj_id) from kid edges, a join for each level of the trees, ordered by path and safe against cycles.

    The second way to the pages relation, which walks a document where it lies. A page met again counts where it is met first. Trees of more than
    max_levels levels are an error.
    """
    checkpointed(object_kv.sparkSession)
    # documents are parsed for it once: all that follows reads what is kept here
    wanted = "kind in ('name', 'ref') and (size(path) = 1 and path[0] in ('Type', 'Pages') or size(path) = 2 and path[0] = 'Kids')"
    object_kv = object_kv.where(wanted).select("doc_id", "obj_id", "path", "kind", "s", "ref_id").checkpoint()
    kind = object_kv.where("size(path) = 1 and path[0] = 'Type' and kind = 'name'").select("doc_id", "obj_id", F.col("s").alias("type")).checkpoint()
    kids = object_kv.where("size(path) = 2 and path[0] = 'Kids' and kind = 'ref'").select("doc_id", "obj_id", F.expr("cast(path[1] as int)").alias("ord"), F.col("ref_id").alias("kid")).checkpoint()
    top = object_kv.where("size(path) = 1 and path[0] = 'Pages' and kind = 'ref'").join(kind.where("type = 'Catalog'"), ["doc_id", "obj_id"]).select("doc_id", F.col("ref_id").alias("obj_id"))
    level = top.select("doc_id", "obj_id", F.array(F.lit(0)).alias("at"), F.array("obj_id").alias("seen")).checkpoint()
    nodes = level.drop("seen")
    while not level.isEmpty():
        if max_levels == 0:
            raise ValueError("a page tree has too many levels")
        max_levels -= 1
        below = level.join(kids, ["doc_id", "obj_id"]).where("not array_contains(seen, kid)")
        level = below.select("doc_id", F.col("kid").alias("obj_id"), F.expr("concat(at, array(ord))").alias("at"), F.expr("concat(seen, array(kid))").alias("seen")).checkpoint()
        nodes = nodes.unionByName(level.drop("seen"))
    pages = nodes.join(kind.where("type = 'Page'"), ["doc_id", "obj_id"]).groupBy("doc_id", "obj_id").agg(F.min("at").alias("at"))
    return pages.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")).cast("int").alias("page_no"), F.col("obj_id").alias("page_obj_id"))


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """df in range partitions by columns, numbered as part in their order; pinned, as ranges are drawn by sampling."""
    checkpointed(df.sparkSession)
    return df.repartitionByRange(*by).withColumn("part", F.spark_partition_id()).checkpoint()


def enclosing(starts: DataFrame, markers: DataFrame) -> DataFrame:
    """As-of: for each marker(doc_id, pos) the object of starts(doc_id, obj_id, offset) that begins last before it.

    Rows are range-partitioned by document and position, and the last object is carried down in each partition; what a partition hands to the next ones of
    a document is one row. So a document of any length is as many tasks as it needs, and no pairs are made.
    """
    none = F.lit(None).cast("bigint").alias("obj_id")
    both = starts.select("doc_id", F.col("offset").alias("pos"), F.lit(1).alias("rank"), "obj_id").unionByName(markers.select("doc_id", "pos", F.lit(0).alias("rank"), none))
    rows = ranged(both, "doc_id", "pos", "rank")
    carried = F.last("obj_id", ignorenulls=True)
    within = rows.withColumn("obj_id", carried.over(Window.partitionBy("doc_id", "part").orderBy("pos", "rank").rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("doc_id", "part").agg(F.max_by("obj_id", F.when(F.col("obj_id").isNotNull(), F.struct("pos", "rank"))).alias("end"))
    before = F.last("end", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    handed = ends.select("doc_id", "part", before.alias("handed"))
    return within.where("rank = 0").join(handed, ["doc_id", "part"]).select("doc_id", "pos", F.coalesce("obj_id", "handed").alias("obj_id"))


def codespace(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Range join of codes(code) to ranges(low, high), both ends in it: each code with each range around it, or none.

    A range is filed under its size's power of two, in the one or two buckets of that width that it touches; a code looks in its own bucket of every
    width in use, of which there are 64 at most. So the join is an equi-join, and the size of a range costs nothing.
    """
    width = F.expr("cast(ceil(log2(high - low + 1)) as int)")
    filed = ranges.where("low <= high").withColumn("width", width).withColumn("bucket", F.explode(F.expr("sequence(shiftright(cast(low as long), width), shiftright(cast(high as long), width))")))
    widths = F.array(*(F.lit(r.width) for r in filed.select("width").distinct().collect())).cast("array<int>")
    asked = codes.select("code").distinct().withColumn("width", F.explode(widths)).withColumn("bucket", F.expr("shiftright(cast(code as long), width)"))
    found = asked.join(filed, ["width", "bucket"]).where("code between low and high").drop("width", "bucket")
    return codes.join(found, "code", "left")


def operator_dimension(spark) -> DataFrame:
    """The 73 recognised operators and their classes."""
    return spark.createDataFrame(sorted(OPERATOR_CLASS.items()), "operator string, class string")


def operator_counts(ops: DataFrame) -> DataFrame:
    """Operations by class; the dimension has 73 rows."""
    dim = F.broadcast(operator_dimension(ops.sparkSession))
    counts = ops.where("operator is not null").groupBy("operator").agg(F.count("*").alias("n"))
    return counts.join(dim, "operator", "left").select("operator", F.coalesce("class", F.lit("other")).alias("class"), "n")


def predictor_sum(value: Column, group: list[str], *order: str) -> Column:
    """Undo a Sub, Up or TIFF predictor: a running sum modulo 256 along the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.pmod(F.sum(value).over(w), F.lit(256))


def write_offsets(chunks: DataFrame) -> DataFrame:
    """Where each chunk(doc_id, seq, size) of a document begins."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("offset", F.sum("size").over(w) - F.col("size"))


def text_by_windows(ops: DataFrame) -> DataFrame:
    """Text of pages of plain strings, lines and moves, without the fold: a cross-check of it.

    ops: doc_id, page_no, seq, operator, operands.
    """
    w = Window.partitionBy("doc_id", "page_no").orderBy("seq")
    breaks = F.expr("operator in ('T*', '''', '\"') or (operator in ('Td', 'TD') and cast(get_json_object(operands, '$[1]') as double) <> 0)")
    shown = F.when(F.col("operator").isin("Tj", "'"), F.decode(F.unhex(F.get_json_object("operands", "$[0].hex")), "ISO-8859-1"))
    lined = ops.select("doc_id", "page_no", "seq", shown.alias("piece"), F.sum(F.when(breaks, 1).otherwise(0)).over(w).alias("line"))
    lines = lined.where("piece is not null").groupBy("doc_id", "page_no", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x.piece), "").alias("text"))
    return lines.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n").alias("text"))
