"""Evidence maths: Bayesian update, completion of unresolved references, correspondence of triples, merging annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrygraph.plans.space import Space

#: Fixed values: (evidence, chance if the claim holds, chance if not).
LIKELIHOODS = (("witnesses", 0.85, 0.25), ("intent", 0.70, 0.40), ("preconditions", 0.75, 0.35), ("side_effects", 0.75, 0.35))
PRIOR, HIGH, LOW = 0.5, 0.8, 0.4
REPLY = "intent STRING, behavior STRING, preconditions ARRAY<STRING>, postconditions ARRAY<STRING>, invariants ARRAY<STRING>, side_effects ARRAY<STRING>, error_behavior STRING, witnesses ARRAY<STRING>"
LISTS = ("preconditions", "postconditions", "invariants", "side_effects")


def posterior(present: dict[str, Column], prior: float = PRIOR) -> Column:
    """Chance after updating the odds by the ratio of each kind of evidence that is present."""
    odds = F.lit(prior / (1 - prior))
    for name, yes, no in LIKELIHOODS:
        if name in present:
            odds = odds * F.when(present[name], yes / no).otherwise(1.0)
    return odds / (odds + 1)


def has_content(row: dict[str, Column] | None = None) -> Column:
    """Whether any annotation field says something."""
    out = F.lit(False)
    for c in ("intent", "behavior", "error_behavior"):
        out = out | F.coalesce(F.col(c) != "", F.lit(False))
    for c in LISTS:
        out = out | F.coalesce(F.size(c) > 0, F.lit(False))
    return out


def parse_replies(replies: DataFrame) -> DataFrame:
    """replies(cell_id, json) as annotations with posterior and discrepancy; broken JSON gives empty fields.

    A reply may stand in prose or a code fence: the outermost braces count.
    """
    body = F.regexp_extract("json", r"(?s)(\{.*\})", 1)
    r = replies.select("cell_id", F.from_json(body, REPLY, {"mode": "PERMISSIVE"}).alias("r")).select("cell_id", "r.*")
    for c in (*LISTS, "witnesses"):
        r = r.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    seen = {"witnesses": F.size("witnesses") > 0, "intent": F.coalesce(F.col("intent") != "", F.lit(False)), "preconditions": F.size("preconditions") > 0, "side_effects": F.size("side_effects") > 0}
    return r.withColumn("posterior", posterior(seen)).withColumn("discrepancy", F.when(~seen["witnesses"], F.lit("no witness cited")))


def corroborate(space: Space, replies: DataFrame | None = None) -> DataFrame:
    """Annotations of all entities: empty ones, or what the replies say."""
    cells = space.entities.select("cell_id").distinct()
    if replies is None:
        return cells.select("cell_id", *(F.lit(None).cast("string").alias(c) for c in ("intent", "behavior", "error_behavior")), *(F.array().cast("array<string>").alias(c) for c in LISTS))
    return cells.join(parse_replies(replies), "cell_id")


def completion(unresolved: DataFrame, confidence: Column | None = None, high: float = HIGH, low: float = LOW) -> DataFrame:
    """unresolved with a confidence (0.5 unless given) and a status: accepted, rejected or pending."""
    c = confidence if confidence is not None else F.lit(0.5)
    return unresolved.withColumn("confidence", c).withColumn("status", F.when(F.col("confidence") >= high, "accepted").when(F.col("confidence") < low, "rejected").otherwise("pending"))


def completion_counts(completed: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return completed.agg(F.count("*").alias("total"), of("accepted"), of("rejected"), of("pending"))


def triples(space: Space) -> DataFrame:
    """(subject, relation, object) of all incidences by full names."""
    names = space.entities.groupBy("cell_id").agg(F.min("fqn").alias("fqn"))
    return (
        space.incidences.join(names.withColumnsRenamed({"cell_id": "from_cell_id", "fqn": "subject"}), "from_cell_id")
        .join(names.withColumnsRenamed({"cell_id": "to_cell_id", "fqn": "object"}), "to_cell_id")
        .select("subject", F.col("relation_type").alias("relation"), "object")
    )


def correspondence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per subject: how two sources of triples agree.

    none: nothing in common; agreeing: no difference; conflicting: a (subject, relation) with disjoint objects; else partial.
    """
    a = left.distinct().withColumn("l", F.lit(1))
    b = right.distinct().withColumn("r", F.lit(1))
    both = a.join(b, ["subject", "relation", "object"], "full")
    per = both.groupBy("subject", "relation").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count("l").alias("ls"), F.count("r").alias("rs"))
    out = per.groupBy("subject").agg(F.sum("both").alias("overlap"), F.sum(F.col("ls") + F.col("rs") - 2 * F.col("both")).alias("differences"), F.max((F.col("both") == 0) & (F.col("ls") > 0) & (F.col("rs") > 0)).alias("clash"))
    return out.select("subject", "overlap", "differences", F.when(F.col("clash"), "conflicting").when(F.col("overlap") == 0, "none").when(F.col("differences") == 0, "agreeing").otherwise("partial").alias("agreement"))


def merge_annotations(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """By cell: what the overlay says wins where it says something."""
    o = overlay.select(F.col("cell_id"), *(F.col(c).alias(f"o_{c}") for c in overlay.columns if c != "cell_id"))
    both = base.join(o, "cell_id", "full")
    text = [F.when(F.coalesce(F.col(f"o_{c}") != "", F.lit(False)), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in ("intent", "behavior", "error_behavior")]
    lists = [F.when(F.coalesce(F.size(f"o_{c}") > 0, F.lit(False)), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in LISTS]
    return both.select("cell_id", *text, *lists)
