"""Structured Streaming versions of the job protocol and the transition audit.

State lives in RocksDB: small values per open job or package, which move to a state with an expiry when it has finished.  What a stream
keeps therefore follows the number of open jobs, and of those that finished within ``keep``, not its length.  A revision check decides
whether a response counts, never its event time: no watermark drops a late first delivery.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofline.functions import protocol
from proofline.functions.protocol import FIRST_PHASE, PACKAGE_FAILURES, PACKAGE_STATES, RESTING, answer

RESPONSE_SCHEMA = (
    "job bigint, event_id bigint, ts timestamp, kind string, gate string, decision string, return_to string, "
    "checkpoint_id string, job_revision bigint, context_sha256 string"
)
OUTCOME_SCHEMA = "job bigint, event_id bigint, status string, phase string, revision bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The worker that declares the state's variables gets no files that were added to the session, so processors travel with their code.
for module in (sys.modules[__name__], protocol):
    cloudpickle.register_pickle_by_value(module)
#: How long a finished job or package is remembered, in milliseconds of processing time: thirty days.
KEEP = 30 * 24 * 3_600_000


class Remembered(StatefulProcessor):
    """A value per key that lives without limit while its key is open, and for ``keep`` milliseconds once it has finished."""

    def __init__(self, schema: str, keep: int):
        self.schema, self.keep = schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", self.schema)
        self.finished = handle.getValueState("finished", self.schema, self.keep)

    def recall(self, first: tuple) -> tuple:
        for state in (self.open, self.finished):
            if state.exists():
                return tuple(state.get())
        return first

    def remember(self, value: tuple, ended: bool) -> None:
        if ended:
            self.open.clear()
            self.finished.update(value)
        else:
            self.open.update(value)

    def close(self) -> None:
        pass


class Protocol(Remembered):
    """One job's phase and revision; with ``once`` also the ids of its responses, so that repeats are told apart."""

    def __init__(self, version: str, keep: int, once: bool):
        super().__init__("phase string, revision bigint", keep)
        self.version, self.once, self.order = version, once, "delivery" if once else "event_id"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.once:
            self.ids = handle.getMapState("ids", "event_id bigint", "delivery bigint")
            self.old_ids = handle.getMapState("old_ids", "event_id bigint", "delivery bigint", self.keep)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (job,) = key
        before = phase, revision = self.recall((FIRST_PHASE, 1))
        was_over = before[0] in RESTING
        new_ids: dict[int, int] = {}
        for row in sorted(rows, key=lambda r: r[self.order]):
            event = row["event_id"]
            if self.once and (event in new_ids or self.ids.containsKey((event,)) or self.old_ids.containsKey((event,))):
                status = "duplicate"
            else:
                phase, revision, status = answer(self.version, job, phase, revision, row.asDict())
                new_ids[event] = row[self.order]
            place = {"delivery": row["delivery"]} if self.once else {}
            yield Row(job=job, event_id=event, **place, status=status, phase=phase, revision=revision)
        over = phase in RESTING
        if (phase, revision) != before:
            self.remember((phase, revision), over)
        if self.once:
            self.keep_ids(new_ids, over, ends=over and not was_over)

    def keep_ids(self, new_ids: dict[int, int], over: bool, ends: bool) -> None:
        if ends:
            for event, delivery in self.ids.iterator():
                self.old_ids.updateValue(tuple(event), tuple(delivery))
            self.ids.clear()
        for event, delivery in new_ids.items():
            (self.old_ids if over else self.ids).updateValue((event,), (delivery,))


def checkpoint_fold_stream(stream: DataFrame, version: str = "v1", keep: int = KEEP) -> DataFrame:
    """Status of each response as it arrives; state per job is its phase and revision.

    Rows of one job are ordered by ``event_id`` inside a micro-batch, whose size
    the source limits; across batches arrival order decides.  A response that is
    delivered again is judged again: after it was applied the revision has moved,
    so it is stale, and otherwise it is refused as before.  No ids are kept.  A column protocol in the
    input names the version of a job where it differs from ``version``.  ``keep`` milliseconds
    after it finished a job is forgotten, and an answer to its first revision would begin it anew.
    """
    return stream.groupBy("job").transformWithState(Protocol(version, keep, once=False), OUTCOME_SCHEMA, "append", "ProcessingTime")


def stale_responses_stream(stream: DataFrame, version: str = "v1", keep: int = KEEP) -> DataFrame:
    """The same for streams in which a response may be delivered again (column ``delivery``, its order): repeats have the status duplicate.

    The ids of an open job's responses are its state; they expire with the finished job.
    """
    schema = OUTCOME_SCHEMA.replace("status", "delivery bigint, status", 1)
    return stream.groupBy("job").transformWithState(Protocol(version, keep, once=True), schema, "append", "ProcessingTime")


class Transitions(Remembered):
    """The last state of a package."""

    def __init__(self, keep: int):
        super().__init__("state string", keep)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (before,) = first = self.recall((None,))
        for row in sorted(rows, key=lambda r: r["seq"]):
            now = row["state"]
            if now == before:
                yield Row(package=key[0], seq=row["seq"], code="collapsed")
                continue
            for code in (self.problem(before, now), "missing-time" if row["at"] is None else None):
                if code:
                    yield Row(package=key[0], seq=row["seq"], code=code)
            before = now
        if (before,) != first:
            self.remember((before,), before in (*PACKAGE_FAILURES, PACKAGE_STATES[-1]))

    def problem(self, before: str | None, now: str) -> str | None:
        failure = now in PACKAGE_FAILURES
        if now not in PACKAGE_STATES and not failure:
            return "unknown-state"
        if before is None:
            return None if now == PACKAGE_STATES[0] else "wrong-start"
        if before in PACKAGE_FAILURES or before == PACKAGE_STATES[-1]:
            return "after-terminal"
        if failure or (before in PACKAGE_STATES and PACKAGE_STATES.index(now) == PACKAGE_STATES.index(before) + 1):
            return None
        return "illegal-transition"


def transition_audit_stream(stream: DataFrame, keep: int = KEEP) -> DataFrame:
    """Findings per record of a transition stream (package, seq, state, at)."""
    return stream.groupBy("package").transformWithState(Transitions(keep), "package bigint, seq bigint, code string", "append", "ProcessingTime")


#: What a bounded run of these streams needs: the state store with expiry, and no batches without rows, as state with an expiry asks for one after another.
RUN_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and write it as a Parquet table; the session's own settings are put back."""
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in RUN_SETTINGS}
    try:
        for name, value in RUN_SETTINGS.items():
            conf.set(name, value)
        query = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    query.awaitTermination()
