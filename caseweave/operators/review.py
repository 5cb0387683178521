"""Review decisions: validation, current status, routing and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .quality import not_blank, split_valid
from .scale import skew_safe_join


def check_decisions(requests: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with field errors): flag, decision and reason are required, the decision
    must be known and the flag must exist."""
    decision = F.upper(F.col("decision"))
    known = flags.select(F.col("flag_id").alias("_flag")).distinct().withColumn("_found", F.lit(True))
    checked = requests.join(known, F.col("flag_id") == F.col("_flag"), "left").drop("_flag")
    rules = [
        ("flag_id", F.col("flag_id").isNotNull(), "required"),
        ("decision", decision.isin(*labels.STATUS_AFTER), f"must be one of: {', '.join(labels.STATUS_AFTER)}"),
        ("reason", not_blank(F.col("reason")), "a reason is mandatory"),
        ("flag_id", F.col("flag_id").isNull() | F.col("_found"), "flag not found"),
    ]
    good, bad = split_valid(checked, rules)
    return good.drop("_found").withColumn("decision", decision), bad.drop("_found")


def decision_rows(accepted: DataFrame, now: Column) -> DataFrame:
    """Rows to append, with defaults and an id derived from the content."""
    def optional(name: str) -> Column:
        return F.col(name).cast("string") if name in accepted.columns else F.lit(None).cast("string")

    action = F.coalesce(optional("action_type"), F.when(F.col("decision") == "ACKNOWLEDGE", "PATROL_DEPLOYMENT"))
    key = F.xxhash64("flag_id", optional("reviewer_id"), "decision", "reason", now)
    return accepted.select(
        F.concat(F.lit("DEC_"), F.lower(F.hex(key))).alias("decision_id"),
        "flag_id",
        F.coalesce(optional("reviewer_id"), F.lit("UNKNOWN")).alias("reviewer_id"),
        F.coalesce(optional("reviewer_role"), F.lit("SHO")).alias("reviewer_role"),
        "decision",
        action.alias("action_type"),
        optional("assigned_to").alias("assigned_to"),
        "reason",
        now.alias("created_at"),
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision per flag. Partial aggregation keeps one row per flag and task."""
    columns = F.struct(*decisions.columns)
    return decisions.groupBy("flag_id").agg(F.max_by(columns, F.struct("created_at", "decision_id")).alias("d")).select("d.*")


def current_flags(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flags with the status of their latest decision; decisions themselves are only appended."""
    newest = decisions.groupBy("flag_id").agg(F.max_by(F.struct("decision", "reason"), F.struct("created_at", "decision_id")).alias("d"))
    last = newest.select("flag_id", labels.lookup(labels.STATUS_AFTER, F.upper("d.decision")).alias("_status"), F.col("d.reason").alias("review_reason"))
    return flags.join(last, "flag_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def route(decisions: DataFrame, flags: DataFrame) -> DataFrame:
    """Every decision with its follow-up action, recipient and end status."""
    titles = flags.select("flag_id", "title", F.col("target_id").alias("flag_target"))
    decision = F.upper(F.col("decision"))
    return decisions.join(titles, "flag_id").withColumns(
        {
            "action": labels.lookup(labels.ROUTE_ACTION, decision, "INVALID"),
            "recipient_role": F.when(decision == "ESCALATE", "DISTRICT_SP"),
            "end_status": labels.lookup(labels.ROUTE_END, decision, "INVALID"),
        }
    )


def ground_actions(routed: DataFrame) -> DataFrame:
    return routed.where("action = 'ASSIGN_GROUND_PATROL'").select("decision_id", "flag_id", "flag_target", "end_status")


def notifications(routed: DataFrame) -> DataFrame:
    return routed.where("action = 'SEND_MAIL_PUSH_NOTIF'").select(
        "decision_id", "flag_id", "recipient_role", F.concat(F.lit("Escalated: "), "title").alias("subject"), "reason", "end_status"
    )


def dismissals(routed: DataFrame) -> DataFrame:
    """Feedback rows for the models."""
    return routed.where("action = 'LOG_AUDIT_FEEDBACK'").select(
        "decision_id", "flag_id", F.col("reason").alias("rejection_reason"), F.lit(True).alias("model_feedback_entry"), "end_status"
    )


def feedback_statistics(flags: DataFrame, decisions: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Per flag type: decisions, dismissal rate in percent and mean hours to the first decision."""
    first = decisions.groupBy("flag_id").agg(F.min("created_at").alias("_first"))
    joined = decisions.join(flags.select("flag_id", "flag_type", F.col("created_at").alias("_raised")), "flag_id").join(first, "flag_id")
    hours = (F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("_raised").cast("timestamp"))) / 3.6e9
    stats = joined.groupBy("flag_type").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.round(100.0 * F.count_if(F.upper("decision") == "DISMISS") / F.count(F.lit(1)), 2).alias("dismissal_rate"),
        F.round(F.avg(F.when(F.col("created_at") == F.col("_first"), hours)), 3).alias("hours_to_first_decision"),
    )
    if outcomes is None:
        return stats
    typed = skew_safe_join(outcomes.select("decision_id", "outcome_type"), decisions.select("decision_id", "flag_id"), ["decision_id"]).join(
        flags.select("flag_id", "flag_type"), "flag_id"
    )
    per_type = typed.groupBy("flag_type", "outcome_type").agg(F.count(F.lit(1)).alias("n")).groupBy("flag_type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome_type", "n")))).alias("outcomes")
    )
    return stats.join(per_type, "flag_type", "left")


def latest_per_key(changes: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Newest row per key."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(stamp).desc()))
    return changes.withColumn("_r", newest).where("_r = 1").drop("_r")
