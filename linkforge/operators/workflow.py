"""Work on records: statuses and the moves between them, locks, conflicts, open work, the newest log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What an action makes of a report of a status.
LIFECYCLE = {
    "DRAFT": {"SUBMIT": "PENDING_AUTH", "SUPPRESS": "SUPPRESSED"},
    "PENDING_AUTH": {"AUTHORISE": "AUTHORISED", "REJECT": "REJECTED", "SUPPRESS": "SUPPRESSED"},
    "REJECTED": {"RETURN_TO_DRAFT": "DRAFT", "SUPPRESS": "SUPPRESSED"},
    "AUTHORISED": {"SUPPRESS": "SUPPRESSED"},
    "SUPPRESSED": {},
}
# The actions that need a reason, with its name in errors.
REASONED = {"REJECT": "Rejection", "SUPPRESS": "Suppression"}
# The statuses that a record of each kind may move to.
MOVES = {
    "enquiry": {
        "Requested": ["Awaiting result", "Result received", "Cancelled"],
        "Awaiting result": ["Result received", "Cancelled"],
        "Result received": ["Closed", "Awaiting result"],
        "Closed": ["Result received"],
    },
    "disclosure": {"Drafted": ["Added to CM", "Closed"], "Added to CM": ["Closed", "Drafted"], "Closed": ["Added to CM"]},
    "action": {
        "Open": ["In progress", "Complete", "Cancelled"],
        "In progress": ["Complete", "Cancelled", "Open"],
        "Complete": ["In progress"],
        "Cancelled": ["Open"],
    },
    "decision": {},
    "commsapp": {
        "Drafted": ["Sent", "Rejected"],
        "Sent": ["Returned", "Rejected"],
        "Returned": ["Closed", "Sent"],
        "Closed": ["Returned"],
        "Rejected": ["Drafted"],
    },
    "profile": {"Draft": ["In review"], "In review": ["Published", "Draft"], "Published": ["Draft", "In review"]},
}
# Statuses of records that are done with, and the seconds after which a lock may be taken over.
DONE = ["Closed", "Complete", "Published", "Cancelled", "Rejected", "Logged"]
LOCK_SECONDS = 1800


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def next_status(status: Column, action: Column) -> Column:
    """The status after an action; null where the action can't be taken."""
    steps = [F.lit(x) for s, moves in LIFECYCLE.items() for a, to in moves.items() for x in (f"{s}|{a}", to)]
    return F.create_map(*steps)[F.concat_ws("|", _known(status), _known(action))]


def apply_actions(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """(urn, action, ok, status, error) of each request: the status after it, or the old one and what stood against it.

    reports: urn, status, ready (valid and fully reviewed; null counts as not). requests: urn, action, reason.
    Requests are judged each against the status as it stands, so send one a report in a batch. A
    request for an unknown or null urn gets an error and no status.
    """
    there = reports.select("urn", F.col("status").alias("_old"), "ready", F.lit(True).alias("_there"))
    both = requests.select("urn", "action", "reason").join(there, "urn", "left")
    after = next_status(F.col("_old"), F.col("action"))
    reason = F.create_map(*[F.lit(x) for pair in REASONED.items() for x in pair])[F.col("action")]
    error = (
        F.when(F.col("_there").isNull(), "No such report.")
        .when(after.isNull(), F.concat(F.lit("Cannot "), _known(F.col("action")), F.lit(" from status "), _known(F.col("_old"))))
        .when((F.col("action") == "AUTHORISE") & ~F.coalesce(F.col("ready"), F.lit(False)), "Not ready to authorise.")
        .when(reason.isNotNull() & (F.trim(_known(F.col("reason"))) == ""), F.concat(reason, F.lit(" reason required.")))
    )
    return both.withColumn("error", error).select("urn", "action", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), after).otherwise(F.col("_old")).alias("status"), "error")


def can_move(kind: Column, before: Column, after: Column) -> Column:
    """Whether a record of a kind may move from one status to another; false for anything unknown or null."""
    allowed = [f"{k}|{a}|{b}" for k, moves in MOVES.items() for a, to in moves.items() for b in to]
    return F.concat_ws("|", _known(kind), _known(before), _known(after)).isin(allowed)


def is_done(status: Column) -> Column:
    return F.coalesce(status.isin(DONE), F.lit(False))


def open_items(records: DataFrame) -> DataFrame:
    """Records whose status isn't one of being done with; a null status is open."""
    return records.where(~is_done(F.col("status")))


def work_of(records: DataFrame, who: str) -> DataFrame:
    """Records that who owns or is assigned to, whatever their status, the last modified first."""
    return records.where((F.col("assignee") == who) | (F.col("owner") == who)).orderBy(F.col("modified_at").desc())


def can_lock(holder: Column, taken_at: Column, who: Column, at: Column, seconds: int = LOCK_SECONDS) -> Column:
    """Whether who may take a record's lock at a time: nobody or who holds it, or it is older than seconds or undated."""
    age = F.unix_micros(at) - F.unix_micros(taken_at)
    return holder.isNull() | F.coalesce(holder == who, F.lit(False)) | F.coalesce(age > seconds * 1_000_000, F.lit(True))


def conflict(base: Column, stored: Column) -> Column:
    """What saving over a stored version means for an edit that began from base: new, no-base, unchanged or conflict."""
    return F.when(stored.isNull(), "new").when(base.isNull(), "no-base").when(base == stored, "unchanged").otherwise("conflict")


def newest(log: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n entries of a log with the greatest keys, greatest first: an ordering with a limit, so tasks send n rows at most."""
    return log.orderBy(*[F.col(k).desc() for k in keys]).limit(n)
