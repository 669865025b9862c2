"""References to records that do not exist.

``orphan_references`` is the general operator for composite keys with nulls; ``citation_orphans``
applies it, with the times of the records, to the citations of acts and their elements.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.ids import WHOLE_ACT, normal_id, range_ends
from statuta.operators.entities import act_nodes, current_acts, current_keywords, current_questions
from statuta.session import cut, hot_join

SIMPLE, PARTIAL, FULL = "simple", "partial", "full"
#: Tasks over which the references to one key are spread where a salt is named.
SALTS = 16


def orphan_references(
    references: DataFrame, targets: DataFrame, columns: Sequence[tuple[str, str]], match: str = PARTIAL, salt: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``references`` without a target, by SQL's rules for keys with nulls.

    ``columns`` pairs a referring with a referred column. References are grouped by which of their
    columns are null, and each group is anti-joined on the others:

    * ``simple``: a reference with any null is satisfied;
    * ``partial``: its non-null columns must equal those of some target;
    * ``full``: nulls in some columns but not in all are an orphan.

    A reference that is null throughout is satisfied under every rule. Targets are reduced to the
    distinct values of the columns in use, nulls in them match nothing. Repeated references stay
    repeated, no column is added, and clashing names on the two sides do no harm.

    ``salt`` names columns of the references by which those of a popular key are spread over SALTS tasks;
    the targets are then repeated as often.
    """
    if match not in (SIMPLE, PARTIAL, FULL):
        raise ValueError(f"unknown match rule: {match}")
    stem = "__key"
    while any(c.startswith(stem) for c in references.columns):
        stem += "_"
    n = len(columns)
    full = (1 << n) - 1
    # The mask of a reference: bit i is set where column i is not null. All masks that the rule looks up
    # share one join: references are read once, and targets give their distinct keys once for each mask.
    mask = sum((F.when(F.col(f"`{ref}`").isNotNull(), 1 << i).otherwise(0) for i, (ref, _) in enumerate(columns)), F.lit(0)).cast("int")
    masked = references.withColumn(f"{stem}m", mask).where(F.col(f"{stem}m") != 0)
    if match == SIMPLE:
        masked = masked.where(F.col(f"{stem}m") == full)
    asked = [full] if match in (SIMPLE, FULL) else list(range(1, full + 1))
    given = [F.col(f"`{t}`").alias(f"{stem}{i}") for i, (_, t) in enumerate(columns)]
    kept = [F.when(F.col(f"{stem}t").bitwiseAND(1 << i) != 0, F.col(f"{stem}{i}")).alias(f"{stem}{i}") for i in range(n)]
    there = reduce(lambda a, b: a & b, [(F.col(f"{stem}t").bitwiseAND(1 << i) == 0) | F.col(f"{stem}{i}").isNotNull() for i in range(n)])
    keys = targets.select(*given).distinct().withColumn(f"{stem}t", F.explode(F.array(*map(F.lit, asked)))).where(there)
    keys = keys.select(f"{stem}t", *kept).distinct()
    # Equal where the mask has a column; where it has none both sides are null. The salt spreads popular keys.
    salted = masked.withColumn(f"{stem}s", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt]), F.lit(SALTS)).cast("int")) if salt else masked
    if salt:
        keys = keys.withColumn(f"{stem}z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = [F.col(f"{stem}m") == F.col(f"{stem}t"), *[F.col(f"`{ref}`").eqNullSafe(F.col(f"{stem}{i}")) for i, (ref, _) in enumerate(columns)]]
    if salt:
        on.append(F.col(f"{stem}s") == F.col(f"{stem}z"))
    lost = salted.join(keys, reduce(lambda a, b: a & b, on), "left_anti")
    return lost.select(*[F.col(f"`{c}`") for c in references.columns])


def references(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every citation of current questions and keywords: ``tbl, field, owner, act_nro, ref_id, at``.

    An act as a whole is cited with the ``ref_id`` '' (related acts); a null act number cites
    nothing and gives no row.
    """
    q = current_questions(questions).select(
        F.col("nro").cast("string").alias("owner"), F.col("fetched_at").alias("at"), F.explode("relatedActs").alias("a")
    )
    acts = q.select(
        F.lit("raw_questions").alias("tbl"), F.lit("relatedact").alias("field"), "owner", F.col("a.nro").alias("act_nro"),
        F.lit("").alias("ref_id"), "at",
    )
    cited = q.select("owner", "at", F.col("a.nro").alias("act_nro"), F.explode("a.relationData").alias("c")).select(
        F.lit("raw_questions").alias("tbl"), F.lit("citation").alias("field"), "owner", "act_nro",
        F.col("c.id").alias("ref_id"), "at",
    )
    k = current_keywords(keywords).select(
        F.concat_ws("_", "conceptId", "instanceOfType").alias("owner"), F.col("fetched_at").alias("at"),
        F.explode("actRelations").alias("r"),
    )
    units = k.select("owner", "at", F.explode("r.relationData.units").alias("u")).select(
        F.lit("keywords").alias("tbl"), F.lit("unit").alias("field"), "owner", F.col("u.nro").alias("act_nro"),
        F.col("u.id").alias("ref_id"), "at",
    )
    return acts.unionByName(cited).unionByName(units).where("act_nro IS NOT NULL")


def citation_orphans(questions: DataFrame, keywords: DataFrame, acts: DataFrame) -> DataFrame:
    """Citations that lead nowhere, with the reason: ``tbl, field, owner, act_nro, ref_id, at, reason``.

    Reasons, the first that holds: 'missing' (no row of the act), 'deleted' (withdrawn at or before
    the citing row's time), 'later' (first seen after it), and 'missing' again for an element that
    the current act does not have. A null id and ``all()`` cite the whole act; both ends of ``a-b``
    must exist, either as written or both in normal form. A null time is never after another.
    """
    seen = acts.where("nro IS NOT NULL").groupBy("nro").agg(F.min("fetched_at").alias("first_seen"))
    now = cut(current_acts(acts).select("nro", "withdrawn_at", "elements"))
    known = seen.join(now.select("nro", "withdrawn_at"), "nro")
    # What can be referred to: (act, null) for an act as a whole, (act, element) for each of its elements.
    nodes = act_nodes(now.select("nro", "elements")).select("nro", "node_id")
    keys = cut(seen.select("nro", F.lit(None).cast("string").alias("node_id")).unionByName(nodes))

    # The key of a reference is (act, element); whole acts have no element, which is the mask (act, null).
    ids = F.col("ref_id")
    whole = (F.col("field") == "relatedact") | ids.isNull() | (ids == WHOLE_ACT) | (normal_id(ids) == WHOLE_ACT)
    refs = cut(references(questions, keywords).withColumn("element", F.when(whole, F.lit(None).cast("string")).otherwise(ids)))

    # Every distinct reference in both spellings; each end of a range is a composite reference of its own,
    # and so is the act alone, whose element is null. A popular act's elements are keys of their own; the
    # references to an act as a whole are distinct here, so no key is popular.
    both = F.array(
        F.struct(F.lit(0).alias("spelling"), range_ends(F.col("element")).alias("ids")),
        F.struct(F.lit(1).alias("spelling"), F.transform(range_ends(F.col("element")), normal_id).alias("ids")),
    )
    cited = refs.select("act_nro", "element").distinct()
    ends = cited.where("element IS NOT NULL").select("act_nro", "element", F.explode(both).alias("s")).select(
        "act_nro", "element", "s.spelling", F.explode("s.ids").alias("end")
    )
    alone = cited.select("act_nro").distinct().select(
        "act_nro", F.lit(None).cast("string").alias("element"), F.lit(0).alias("spelling"), F.lit(None).cast("string").alias("end")
    )
    lost = cut(orphan_references(ends.unionByName(alone), keys, [("act_nro", "nro"), ("end", "node_id")], PARTIAL))
    lost_acts = lost.where("end IS NULL").select("act_nro", F.lit(True).alias("lost_act"))
    lost_elements = (
        lost.where("end IS NOT NULL").groupBy("act_nro", "element").agg(F.count_distinct("spelling").alias("n")).where("n = 2")
        .select("act_nro", "element", F.lit(True).alias("lost_element"))
    )

    # References to one act may be a third of all.
    of_acts = cut(known.join(lost_acts.withColumnRenamed("act_nro", "nro"), "nro", "full").withColumnRenamed("nro", "act_nro"))
    by = ["owner", "ref_id", "at"]
    flagged = hot_join(hot_join(refs, of_acts, ["act_nro"], by), cut(lost_elements), ["act_nro", "element"], by)
    reason = (
        F.when(F.col("lost_act"), "missing")
        .when(F.col("withdrawn_at") <= F.col("at"), "deleted")
        .when(F.col("first_seen") > F.col("at"), "later")
        .when(F.col("lost_element"), "missing")
    )
    return (
        flagged.withColumn("reason", reason).where("reason IS NOT NULL")
        .select("tbl", "field", "owner", "act_nro", "ref_id", "at", "reason")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, UTC month of the citing row and reason."""
    month = F.date_format(F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM")
    return orphans.groupBy("tbl", "field", month.alias("month"), "reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("owner").alias("n_owners")
    )
