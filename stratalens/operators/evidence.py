"""Evidence, findings, conflicts and verdicts as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.functions.text import is_specific, stable_id, topic_tokens


def register_evidence(rows: DataFrame) -> DataFrame:
    """Rows (type, target, location, ..., ord) with an id from type, target and location; the first of an id stays."""
    w = Window.partitionBy("id").orderBy("ord")
    with_id = rows.withColumn("id", F.concat(F.lit("evid:"), stable_id("type", "target", "location")))
    return with_id.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def unsupported(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id of findings (finding_id, evidence_ids) that cite evidence which isn't registered, or none at all."""
    cited = findings.select("finding_id", F.explode_outer("evidence_ids").alias("id"))
    return cited.join(evidence.select("id"), "id", "left_anti").select("finding_id").distinct()


def conflicts(findings: DataFrame) -> DataFrame:
    """a, b, topic: findings (finding_id, statement) about one specific subject with different sets of subjects.

    Only findings that share a specific token meet, so this is an equi-join; topic is the shared specific tokens.
    """
    t = findings.select("finding_id", topic_tokens("statement").alias("tokens"))
    specific = t.select("finding_id", "tokens", F.explode(F.filter("tokens", is_specific)).alias("k"))
    a, b = specific.select(F.col("finding_id").alias("a"), F.col("tokens").alias("ta"), "k"), specific.select(F.col("finding_id").alias("b"), F.col("tokens").alias("tb"), "k")
    pairs = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.col("ta") != F.col("tb")))
    return pairs.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("k")), " ").alias("topic"))


def verdicts(findings: DataFrame, evidence: DataFrame, open_conflicts: DataFrame | None = None) -> DataFrame:
    """finding_id, deterministic, semantic, status for findings (finding_id, evidence_ids).

    deterministic: SUPPORTED if all cited evidence is registered and one piece is of a deterministic type. semantic (null
    without semantic evidence): SUPPORTED with deterministic evidence besides, else PARTIALLY_SUPPORTED. A supported
    finding is verified unless it is in an open conflict.
    """
    cited = findings.select("finding_id", F.explode_outer("evidence_ids").alias("id")).join(evidence.select("id", "type"), "id", "left")
    det, sem = F.col("type").isin(fixed.DETERMINISTIC_EVIDENCE), F.col("type").isin(fixed.SEMANTIC_EVIDENCE)
    per = cited.groupBy("finding_id").agg(F.count("id").alias("n"), F.count_if(F.col("id").isNotNull() & F.col("type").isNull()).alias("missing"), F.count_if(det).alias("det"), F.count_if(sem).alias("sem"))
    out = per.withColumn("deterministic", F.when((F.col("n") > 0) & (F.col("missing") == 0) & (F.col("det") > 0), "SUPPORTED").otherwise("UNSUPPORTED"))
    out = out.withColumn("semantic", F.when(F.col("sem") > 0, F.when(F.col("det") > 0, "SUPPORTED").otherwise("PARTIALLY_SUPPORTED")))
    disputed = F.lit(False)
    if open_conflicts is not None:
        hot = open_conflicts.select(F.explode(F.array("a", "b")).alias("finding_id")).distinct().withColumn("_hot", F.lit(True))
        out, disputed = out.join(hot, "finding_id", "left"), F.coalesce("_hot", F.lit(False))
    status = F.when(F.col("deterministic") == "UNSUPPORTED", "unsupported").when(disputed, "supported").otherwise("verified")
    return out.withColumn("status", status).select("finding_id", "deterministic", "semantic", "status")


def resolve_conflicts(open_conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """finding_id, status, decision_id: losers of decided conflicts (a, b, winner, decision_id) are contradicted."""
    d = open_conflicts.join(decisions, ["a", "b"]).where("winner = a OR winner = b")
    return d.select(F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("finding_id"), F.lit("contradicted").alias("status"), "decision_id")


def evidence_of(evidence: DataFrame, target: str, type_: str | None = None) -> DataFrame:
    out = evidence.where(F.col("target") == target)
    return (out.where(F.col("type") == type_) if type_ else out).orderBy("timestamp", "id")


def precedents(decisions: DataFrame, category: str, target: str, query: str) -> DataFrame:
    """Decisions of a category whose target or text shares something with the query."""
    q = topic_tokens(F.lit(query))
    blob = F.concat_ws(" ", "target", "statement")
    return decisions.where((F.col("category") == category) & (F.contains("target", F.lit(target)) | F.arrays_overlap(q, topic_tokens(blob))))


def open_conflicts(found: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Conflicts (a, b, topic) without a decision (a, b)."""
    return found if decisions is None else found.join(decisions.select("a", "b").distinct(), ["a", "b"], "left_anti")


def conflicts_involving(found: DataFrame, findings: DataFrame) -> DataFrame:
    """finding_id, a, b, topic: conflicts on either side of which one of some findings (finding_id) stands."""
    sides = found.select(F.explode(F.array("a", "b")).alias("finding_id"), "a", "b", "topic")
    return sides.join(findings.select("finding_id").distinct(), "finding_id", "left_semi")


def conflict_decisions(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decision row (category, target, statement, risk, related, reason) for each decided conflict."""
    d = found.join(decisions, ["a", "b"])
    return d.select(F.lit("conflict_resolution").alias("category"), F.col("topic").alias("target"), F.col("decision_id").cast("string").alias("statement"), F.lit("medium").alias("risk"), F.array("a", "b").alias("related"), F.concat(F.lit("winner="), F.coalesce(F.col("winner").cast("string"), F.lit("none"))).alias("reason"))


def transition_findings(findings: DataFrame, requests: DataFrame, evidence: DataFrame, open_: DataFrame, strict: bool = False) -> DataFrame:
    """finding_id, status, error for requested states (finding_id, status) of findings (finding_id, evidence_ids, status).

    A state must be one of the known ones and the finding registered. verified needs evidence, all of it registered, and no
    open conflict (a, b). A refused request keeps the old state and says why; with ``strict`` it fails the job instead.
    """
    asked = requests.select("finding_id", F.col("status").alias("wanted"))
    missing = findings.select("finding_id", F.explode("evidence_ids").alias("id")).join(evidence.select("id"), "id", "left_anti").groupBy("finding_id").agg(F.count("*").alias("n_missing"))
    hot = open_.select(F.explode(F.array("a", "b")).alias("finding_id")).groupBy("finding_id").agg(F.count("*").alias("n_open"))
    j = asked.join(findings.select("finding_id", "evidence_ids", F.col("status").alias("old"), F.lit(True).alias("known")), "finding_id", "left").join(missing, "finding_id", "left").join(hot, "finding_id", "left")
    verifying = F.col("wanted") == "verified"
    error = (
        F.when(F.col("known").isNull(), "unknown finding").when(~F.col("wanted").isin(fixed.FINDING_STATES), "invalid status")
        .when(verifying & (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), "no evidence cited").when(verifying & F.col("n_missing").isNotNull(), "unregistered evidence").when(verifying & F.col("n_open").isNotNull(), "unresolved conflict")
    )
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(F.concat_ws(": ", error, F.col("finding_id").cast("string"))))
    return j.select("finding_id", F.when(error.isNull(), F.col("wanted")).otherwise(F.col("old")).alias("status"), error.cast("string").alias("error"))
