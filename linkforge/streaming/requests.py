"""Requests on reports as a stream: each report's requests are judged one after another against the state that the ones before it left.

A report's state is its status, version and lock, kept by Spark's state store under its urn, so a batch with SUBMIT and then AUTHORISE of one report is judged in that
order, and so are requests that come in later batches or after a restart. What a batch judged is written under its number, so a batch that is run again replaces its own rows only.

Kinds of requests: ACT (action, reason, ready), LOCK and UNLOCK (who, at), SAVE (who, base: the version that the edit began from). A report without standing status is unknown,
and its requests fail. Requests of one urn in one batch are taken in order of seq; nulls in urn go. A SAVE moves the version on unless another's lock holds or the base is stale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkforge.operators.workflow import LIFECYCLE, LOCK_SECONDS, REASONED
from linkforge.session import shared_dir

REQUEST = "urn string, seq long, kind string, who string, at long, action string, reason string, ready boolean, base long"
STATE = "status string, version long, holder string, taken_at long"
VERDICT = "urn string, seq long, kind string, ok boolean, status string, version long, holder string, error string"


@dataclass(frozen=True)
class Report:
    """A report as requests find it; times are seconds."""

    status: str | None
    version: int = 0
    holder: str | None = None
    taken_at: int | None = None


def judged(report: Report, r: dict) -> tuple[Report, str | None]:
    """(the report after a request, what stood against it)."""
    if report.status is None:
        return report, "No such report."
    held = report.holder is not None and report.holder != r["who"] and (report.taken_at is not None and r["at"] is not None and r["at"] - report.taken_at <= LOCK_SECONDS)
    match r["kind"]:
        case "ACT":
            after = LIFECYCLE.get(report.status, {}).get(r["action"] or "")
            if after is None:
                return report, f"Cannot {r['action'] or ''} from status {report.status}"
            if r["action"] == "AUTHORISE" and not r["ready"]:
                return report, "Not ready to authorise."
            if r["action"] in REASONED and not (r["reason"] or "").strip():
                return report, f"{REASONED[r['action']]} reason required."
            return replace(report, status=after, version=report.version + 1), None
        case "LOCK":
            return (report, f"Locked by {report.holder}") if held else (replace(report, holder=r["who"], taken_at=r["at"]), None)
        case "UNLOCK":
            return (report, f"Locked by {report.holder}") if held else (replace(report, holder=None, taken_at=None), None)
        case "SAVE":
            if held:
                return report, f"Locked by {report.holder}"
            if r["base"] is not None and r["base"] != report.version:
                return report, f"Conflict: version {report.version}, edit of {r['base']}"
            return replace(report, version=report.version + 1), None
    return report, f"Unknown request {r['kind']}"


class Judge(StatefulProcessor):
    """Takes plain rows: a data frame for each report costs a hundred times what judging its requests does."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("report", STATE)
        self.begun: tuple[tuple, Report] | None = None  # the report whose standing state came last

    def _now(self, key: tuple) -> Report:
        if self.begun and self.begun[0] == key:
            return self.begun[1]
        return Report(*(self.state.get() or [None]))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: object) -> None:  # noqa: N802, N803
        report = Report(initialState["status"], initialState["version"] or 0, initialState["holder"], initialState["taken_at"])
        self.state.update(astuple(report))
        self.begun = key, report

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        before = report = self._now(key)
        self.begun = None
        for r in sorted((r.asDict() for r in rows), key=lambda r: (r["seq"] is None, r["seq"] or 0)):
            report, error = judged(report, r)
            yield Row(urn=key[0], seq=r["seq"], kind=r["kind"], ok=error is None, status=report.status, version=report.version, holder=report.holder, error=error)
        if report != before:
            self.state.update(astuple(report))

    def close(self) -> None:
        pass


def verdicts(requests: DataFrame, reports: DataFrame) -> DataFrame:
    """A stream of verdicts on a stream of requests (REQUEST). reports: urn with the columns of STATE, the standing state that the stream's first batch starts from."""
    seen = requests.where("urn is not null").groupBy("urn")
    start = reports.select("urn", "status", "version", "holder", "taken_at").groupBy("urn")
    return seen.transformWithState(statefulProcessor=Judge(), outputStructType=VERDICT, outputMode="append", timeMode="None", initialState=start)


def run(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Judge all that has arrived and read every verdict so far. path: a shared folder from which a later call goes on."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = path or shared_dir(spark, "verdicts")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    spark.createDataFrame([], VERDICT).write.mode("overwrite").parquet(f"{path}/data/batch=-1")
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(f"{path}/data").drop("batch")


def watched(signatures: DataFrame, watch: DataFrame, path: str | None = None) -> DataFrame:
    """(watch_id, urn, id) once for each entity of an arriving report that a watch list knows, of all that has arrived so far.

    signatures: a stream of (urn, id, type, rule, sig). watch: (watch_id, type, rule, sig), a table; what is on the list counts when a batch runs. A batch writes only hits
    that no batch before it wrote.
    """
    spark = signatures.sparkSession
    path = path or shared_dir(spark, "watched")
    kind = f"watch_id {watch.schema['watch_id'].dataType.simpleString()}, urn string, id {signatures.schema['id'].dataType.simpleString()}"
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{path}/data/batch=-1")

    def merge(batch: DataFrame, n: int) -> None:
        known = spark.read.parquet(f"{path}/data").where(F.col("batch") < n).drop("batch")
        new = batch.join(watch, ["type", "rule", "sig"]).select("watch_id", "urn", "id").distinct()
        new.join(known, ["watch_id", "urn", "id"], "left_anti").write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    signatures.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return spark.read.parquet(f"{path}/data").drop("batch")
