"""Metadata as entity-attribute-value rows: pivots, typing, trees, parameters, dictionaries and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalar as fn

PARAM_TAGS = ("cvParam", "userParam", "referenceableParamGroupRef")


def flatten(table: DataFrame, key: str, columns: dict[str, int]) -> DataFrame:
    """A row (item_index, row_no, accession, value_kind, num, text) for each named column; text is typed by its spelling."""
    kinds = dict(table.dtypes)
    cells = []
    for i, (name, accession) in enumerate(columns.items()):
        number = kinds[name] != "string"
        text = F.lit(None).cast("string") if number else F.col(name)
        kind = F.when(F.col(name).isNull(), F.lit(S.VALUE_EMPTY)).otherwise(F.lit(S.VALUE_NUMBER)).cast("short") if number else fn.value_kind(F.col(name))
        num = F.col(name).cast("double") if number else F.when(kind == S.VALUE_NUMBER, F.col(name).cast("double"))
        cells.append(F.struct(F.lit(i).alias("row_no"), F.lit(accession).cast("long").alias("accession"), kind.alias("value_kind"), num.alias("num"), F.when(kind == S.VALUE_TEXT, text).alias("text")))
    return table.select(F.col(key).alias("item_index"), F.explode(F.array(*cells)).alias("c")).select("item_index", "c.*")


def pivot(rows: DataFrame, columns: dict[str, int], last: bool = True) -> DataFrame:
    """One row for each item; of several values of an accession the last one by row number (or the first)."""
    pick = F.max_by if last else F.min_by
    cells = []
    for name, accession in columns.items():
        mine = F.when(F.col("accession") == accession, F.col("row_no"))
        cells += [pick("num", mine).alias(f"{name}_num"), pick("text", mine).alias(f"{name}_text")]
    return rows.groupBy("item_index").agg(*cells)


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("value_kind") == 0).alias("n_numbers"), F.count_if(F.col("value_kind") == 1).alias("n_texts"))


def first_text(rows: DataFrame, accession: int) -> DataFrame:
    """The first row's value of an attribute for each item."""
    mine = rows.where(F.col("accession") == accession)
    return mine.groupBy("item_index").agg(F.min_by("text", "row_no").alias("text"), F.min_by("num", "row_no").alias("num"))


def children(nodes: DataFrame, tag: str | None = None) -> DataFrame:
    """Children of each parent in order of first appearance, without repeats, of nodes(node_id, parent_id, tag, row_no)."""
    rows = nodes if tag is None else nodes.where(F.col("tag") == tag)
    first = rows.groupBy("parent_id", "node_id").agg(F.min("row_no").alias("row_no"))
    kids = F.array_sort(F.collect_list(F.struct("row_no", "node_id")))
    return first.groupBy("parent_id").agg(F.transform(kids, lambda x: x["node_id"]).alias("children"))


def first_child(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.where(F.col("tag") == tag).groupBy("parent_id").agg(F.min_by("node_id", "row_no").alias("node_id"))


def remap_nodes(rows: DataFrame, by: str = "group_no") -> DataFrame:
    """Node numbers of joined groups: stride is one more than the largest number of the group, the root is shared."""
    top = rows.groupBy(by).agg((F.max(F.greatest("node_id", "parent_id")) + 1).alias("stride"))
    out = rows.join(top, by)
    return out.withColumn("new_id", fn.node_id(F.col("item_no"), F.col("stride"), F.col("node_id"))).drop("stride")


def params_only(rows: DataFrame) -> DataFrame:
    """Parameter rows, without attributes."""
    return rows.where(F.col("tag").isin(*PARAM_TAGS) & ~F.coalesce(F.col("accession").startswith("ATTR:"), F.lit(False)))


def known_vocabulary(accession: Column) -> Column:
    return F.coalesce(F.split(accession, ":")[0].isin("MS", "UO", "NCIT", "PEFF", "IMS"), F.lit(False))


def named_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """rows(accession, ...) with the names of terms(accession, name); without one the accession itself."""
    one = terms.groupBy("accession").agg(F.min("name").alias("term_name"))
    return rows.join(one, "accession", "left").withColumn("name", F.coalesce("term_name", "accession")).drop("term_name")


def effective_params(items: DataFrame, refs: DataFrame, groups: DataFrame) -> DataFrame:
    """Own parameters of items(item, accession, value) and those of the groups they refer to: refs(item, ref), groups(ref, accession, value)."""
    inherited = refs.join(groups, "ref").select("item", "accession", "value")
    return inherited.unionByName(items.select("item", "accession", "value"))


def dangling(refs: DataFrame, ids: DataFrame, ref: str = "ref", key: str = "id") -> DataFrame:
    """Rows of refs whose reference names nothing; null references are none."""
    return refs.where(F.col(ref).isNotNull()).join(ids.select(F.col(key).alias(ref)).distinct(), ref, "left_anti")


def resolved(refs: DataFrame, ids: DataFrame, ref: str = "ref", key: str = "id") -> DataFrame:
    """Rows of refs with the columns of what their reference names; others, and null references, are left out."""
    return refs.join(ids.withColumnRenamed(key, ref), ref)


def precursors(spectra: DataFrame) -> DataFrame:
    """Spectra with the index of the spectrum that their precursor reference names, if it exists."""
    ids = spectra.select("run_id", F.col("id").alias("precursor_ref"), F.col("spectrum_index").alias("precursor_index"))
    return spectra.join(ids, ["run_id", "precursor_ref"], "left")


# Accessions of a target's parameters where settings list them without an element of their own.
TARGET_MZ, TARGET_NAME, TARGET_START, TARGET_END = "MS:1000827", "MS:1001225", "MS:1000502", "MS:1000747"


def targets_of_params(params: DataFrame) -> DataFrame:
    """Targets that params(item, row_no, accession, value) list: a new one begins with each target m/z, in their order.

    Rows (item, target_no, row_no, accession, value); other parameters are left out.
    """
    own = params.where(F.col("accession").isin(TARGET_MZ, TARGET_NAME, TARGET_START, TARGET_END))
    w = Window.partitionBy("item").orderBy("row_no")
    begins = F.when((F.col("accession") == TARGET_MZ) | (F.row_number().over(w) == 1), 1).otherwise(0)
    return own.withColumn("begins", begins).select("item", (F.sum("begins").over(w) - 1).alias("target_no"), "row_no", "accession", "value")


def attach_arrays(stubs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Each decoded array with the first stub of its kind that has none yet: stubs(item, stub_no, accession) and
    arrays(item, array_no, accession), each with its columns. Arrays without a stub and stubs without an array stay."""
    nth = lambda by: F.row_number().over(Window.partitionBy("item", "accession").orderBy(by))
    return stubs.withColumn("__nth", nth("stub_no")).join(arrays.withColumn("__nth", nth("array_no")), ["item", "accession", "__nth"], "full").drop("__nth")


def without_described(own: DataFrame, described: DataFrame, key: str = "accession") -> DataFrame:
    """Parameters of items that their description does not have."""
    return own.join(described.select("item", key).distinct(), ["item", key], "left_anti")


def direct_or_described(direct: Column, described: Column) -> Column:
    return F.coalesce(direct, described)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, as often as it has them more, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def union_renumbered(groups: list[DataFrame], order: str, index: str | None = None) -> DataFrame:
    """Groups one after the other, items numbered on from 0; an item's own number, if it has one, goes first."""
    from . import order as O

    rows = None
    for i, g in enumerate(groups):
        g = g.withColumn("group_no", F.lit(i))
        rows = g if rows is None else rows.unionByName(g)
    out = O.global_ordinals(rows, ["group_no", order], "item_no")
    return out if index is None else out.withColumn("item_no", F.coalesce(F.col(index).cast("long"), "item_no"))
