"""References to records that do not exist, by signed reference and existence counts per key.

What is kept are the states of the facts (see facts.states) and, per key, how many references to it and
facts about it hold. A set of changes gives new states for the entities and attributes it touches; the
difference to their old ones is a signed delta, which is added to the counts. Nothing else is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.facts import facts, states
from tidelog.session import written

REF = 5


def count_deltas(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Signed deltas (key, refs, live, born, oldest) that lead from one set of states to another.

    A fact (e, a, v, decl, la, fa, holds) that holds counts +1 for the existence of its e and, if it is
    a reference, +1 for the references to its target; each counts -1 for what held before. born is the
    first tx that asserted anything about the key, oldest the least asserting tx of a reference to it.
    ``before`` is None at the start.
    """

    def side(rows: DataFrame, sign: int) -> DataFrame:
        one = F.when(F.col("holds"), F.lit(sign)).otherwise(F.lit(0))
        no = F.lit(None).cast("long")
        exists = F.struct(F.col("e").alias("key"), F.lit(0).alias("refs"), one.alias("live"), F.col("fa").alias("born"), no.alias("oldest"))
        refers = F.struct(F.col("v").try_cast("long").alias("key"), one.alias("refs"), F.lit(0).alias("live"), no.alias("born"), F.col("la").alias("oldest"))
        both = F.when((F.col("decl") == REF) & F.col("holds"), F.array(exists, refers)).otherwise(F.array(exists))
        return rows.select(F.inline(both))

    return side(after, 1) if before is None else side(after, 1).unionByName(side(before, -1))


def apply_changes(known: DataFrame | None, changes: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(states, deltas): all states after the facts ``changes``, and the signed deltas of the counts.

    ``known`` are the states before (None if there are none). Changes may come in any order, early ones
    late, and again; only those states are worked out anew, and compared with what they were, whose (e, a)
    the changes touch. A state goes into that as the two or three facts that it stands for.
    """
    if known is None:
        after = states(changes, keys=keys)
        return after, count_deltas(None, after)
    touched = changes.select("e", "a").distinct()
    before = known.join(touched, ["e", "a"], "left_semi")
    turns = F.array(*[F.struct(F.col(c).alias("tx"), F.lit(op).alias("op")) for c, op in (("la", 0), ("fa", 0), ("lr", 1))])
    old = before.select("e", "a", "v", "card", "decl", F.inline(turns)).where(F.col("tx").isNotNull())
    names = ["e", "a", "v", "tx", "op", "card", "decl"]
    after = states(old.select(*names).unionByName(changes.select(*names)))
    rest = known.join(touched, ["e", "a"], "left_anti")
    return rest.unionByName(after), count_deltas(before, after)


def _reduced(held: DataFrame) -> DataFrame:
    """Of states, what counts and references are made from: of a fact that is no reference that holds, only its e, when it began and whether it holds."""
    ref = (F.col("decl") == REF) & F.col("holds")
    only = lambda c: F.when(ref, c)
    return held.where(F.col("fa").isNotNull()).select("e", only(F.col("a")).alias("a"), only(F.col("v").try_cast("long")).alias("v"), only(F.col("la")).alias("la"), "fa", "holds", "decl")


def add_counts(deltas: DataFrame) -> DataFrame:
    """(key, refs, live, born, oldest) per key; deltas and earlier counts may be added in any order.

    oldest is a bound: it stays where the reference that set it has ended, so what it makes a candidate is
    looked at once more (orphan_references does).
    """
    return deltas.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("live").alias("live"), F.min("born").alias("born"), F.min("oldest").alias("oldest"))


def orphan_keys(counts: DataFrame) -> DataFrame:
    """Keys with references that are missing, no longer exist, or began after some reference to them."""
    return counts.where((F.col("refs") > 0) & (F.col("born").isNull() | (F.col("live") <= 0) | (F.col("born") > F.col("oldest"))))


def orphan_references(held: DataFrame, counts: DataFrame) -> DataFrame:
    """(e, a, v, la, kind) of each reference that holds and whose target is missing, deleted or later.

    ``held`` are the states of all facts (see facts.states), ``counts`` those of all keys. The target is
    missing if nothing was ever asserted about it, else deleted if nothing about it holds at the end,
    else later if its first assert has a greater tx than the reference's latest.
    """
    keys = orphan_keys(counts).select(F.col("key").alias("v"), "live", "born")
    refs = held.where((F.col("decl") == REF) & F.col("holds")).select("e", "a", F.col("v").try_cast("long").alias("v"), "la")
    kind = F.when(F.col("born").isNull(), "missing").when(F.col("live") <= 0, "deleted").when(F.col("born") > F.col("la"), "later")
    return refs.join(keys, "v").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("e", "a", "v", "la", "kind")


def attribute_orphans(rows: DataFrame, attrs: DataFrame) -> DataFrame:
    """``rows`` (e, a, tx, distinct) whose attribute is not declared, or is so by a later tx; with kind."""
    known = attrs.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("a")).agg(F.lit(True).alias("known"), F.min("attr_version").alias("since"))
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("tx") < F.col("since"), "later")
    return rows.join(known, "a", "left").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("e", "a", "tx", "kind").distinct()


def name_orphans(operations: DataFrame, attrs: DataFrame) -> DataFrame:
    """(op_id, tx, kind) of operations whose attribute name is unknown (a null too) or declared later."""
    known = attrs.where(F.col("ident").isNotNull()).groupBy(F.col("ident").alias("attr_ident")).agg(F.lit(True).alias("known"), F.min("attr_version").alias("since"))
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("tx") < F.col("since"), "later")
    return operations.join(known, "attr_ident", "left").withColumn("kind", kind).where(F.col("kind").isNotNull()).select("op_id", "tx", "kind").distinct()


def tx_months(datoms: DataFrame, time_attribute: int = 6) -> DataFrame:
    """(tx, ym): the UTC month of each transaction, by the latest assert of its time."""
    rows = datoms.where((F.col("a") == time_attribute) & (F.col("vt") == 2) & (F.col("op") == 0) & F.col("v_u64").isNotNull())
    last = rows.groupBy(F.col("e").alias("tx")).agg(F.max_by(F.col("v_u64").cast("long"), "tx").alias("s"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("s") / 86400).cast("int"))
    return last.select("tx", F.date_format(day, "yyyy-MM").alias("ym"))


def orphans(datoms: DataFrame, attrs: DataFrame, operations: DataFrame) -> DataFrame:
    """(src, rec, kind, ym): all references to absent entities and attributes, by table and month.

    ym is null for a tx without a time. Repeated rows count once. A row of datoms with a null attribute
    refers to nothing; an operation with a null attribute name refers to a name that does not exist.
    What the states say of references and existence is written once and read for both.
    """
    held = written(_reduced(apply_changes(None, facts(datoms, attrs), datoms.select("e", "a"))[0]))
    of_values = orphan_references(held, add_counts(count_deltas(None, held))).select(F.lit("datoms.v_ref").alias("src"), F.concat_ws(":", "e", "a", "v", "la").alias("rec"), "kind", F.col("la").alias("tx"))
    rows = datoms.where(F.col("a").isNotNull()).select("e", "a", "tx")
    of_ids = attribute_orphans(rows, attrs).select(F.lit("datoms.a").alias("src"), F.concat_ws(":", "e", "a", "tx").alias("rec"), "kind", "tx")
    of_names = name_orphans(operations, attrs).select(F.lit("operations.attr_ident").alias("src"), F.col("op_id").cast("string").alias("rec"), "kind", "tx")
    found = of_values.unionByName(of_ids).unionByName(of_names)
    return found.join(tx_months(datoms), "tx", "left").select("src", "rec", "kind", "ym")
