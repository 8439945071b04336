"""Live clients as state of a stream: registration, latest rate, expiry by timer, change notices.

Each client of a cluster is one key with its own state, so a busy cluster spreads over all tasks: a value state
says since when the client is registered, when it was last heard of and its latest rate; each call of a state costs a
round trip between Python and the state store, so it is read and written once per micro-batch. A client that stays silent for longer than ``timeout`` of event time expires: a timer set
at its last message plus the timeout fires once the watermark has passed it. A silence that ends within a
micro-batch is seen by the next message, with the same result, so notices do not depend on how a stream in order is
cut into batches. Messages of earlier times that come in a later batch, within the watermark's delay, count as they
come. The first notice of a key is not sent on.

State of clients restored from a snapshot is the stream's initial state; it sends no notice. All state lives in the
checkpoint (RocksDB), and a restarted stream goes on where it stopped. Of one micro-batch, the messages of one client
are put in order in memory; the reader's ``files_per_batch`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pacemark.operators.telemetry import IN, OUT, UPDATE
from pacemark.session import runs_in_tasks

runs_in_tasks(__name__)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Session settings (`session.settings`) of streams with much state: a batch's changes are logged instead of whole
#: snapshots, and rows are not counted, which would read each key before it is written.
STATE_SETTINGS = {
    "streaming__stateStore__providerClass": STATE_STORE,
    "streaming__stateStore__rocksdb__changelogCheckpointing__enabled": "true",
    "streaming__stateStore__rocksdb__trackTotalNumberOfRows": "false",
}
REGISTERED, RESET, LEFT, EXPIRED = "registered", "reset", "left", "expired"
NOTICE = "cluster bigint, client bigint, us bigint, kind string, value bigint"


class LiveClients(StatefulProcessor):
    """One (cluster, client): messages in, notices out."""

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.client = handle.getValueState("client", "live boolean, since bigint, last bigint, told boolean, rate bigint")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        last = initialState["last_us"]
        self.client.update((True, last, last, False, initialState["latest"]))
        self._wake(last)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        live, since, before, told, rate = self.client.get() or (False, None, None, False, 0)
        last = before
        waiting = live
        messages = sorted((r["us"], r["event_id"], r["verb"], r["v"]) for r in rows)
        notices = []
        for us, _, verb, value in messages:
            if live and us > last + self.timeout:
                notices.append((last + self.timeout, EXPIRED, rate))
                live = False
            if verb == IN:
                notices.append((us, RESET if live else REGISTERED, rate if live else 0))
                live, since, rate = True, us, 0
            elif live and verb == OUT:
                notices.append((us, LEFT, rate))
                live = False
            elif live and verb == UPDATE:
                rate = int(value)
            last = max(us, last or us)
        self.client.update((live, since, last, told or bool(notices), rate))
        if not (waiting and live and last == before):
            if waiting:
                self.handle.deleteTimer(self._timer(before))
            if live:
                self._wake(last)
        return self._told(key, notices, told)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        live, since, last, told, rate = self.client.get()
        notices = [(last + self.timeout, EXPIRED, rate)] if live else []
        self.client.update((False, since, last, told or bool(notices), rate))
        return self._told(key, notices, told)

    def close(self) -> None:
        pass

    def _timer(self, last: int) -> int:
        return (last + self.timeout) // 1000

    def _wake(self, last: int) -> None:
        self.handle.registerTimer(self._timer(last))

    @staticmethod
    def _told(key: Any, notices: list[tuple[int, str, int]], told: bool) -> Iterator[Row]:
        sent = notices if told else notices[1:]
        return iter([Row(cluster=key[0], client=key[1], us=us, kind=kind, value=value) for us, kind, value in sent])


def notices(messages: DataFrame, timeout_us: int, delay: str, restored: DataFrame | None = None) -> DataFrame:
    """Notices ``cluster, client, us, kind, value`` of a message stream (``cluster``, ``client``, ``ts``, ``us``,
    ``event_id``, ``verb``, ``v``); ``restored`` has one row ``cluster, client, latest, last_us`` per known client.

    The session needs the RocksDB state store (`STATE_STORE`) when the stream starts.
    """
    columns = ["cluster", "client", "ts", "us", "event_id", "verb", "v"]
    known = messages.where(F.col("verb").isin(IN, OUT, UPDATE)).select(*columns).withWatermark("ts", delay)
    start = None if restored is None else restored.select("cluster", "client", "latest", "last_us")
    return known.groupBy("cluster", "client").transformWithState(
        LiveClients(timeout_us),
        StructType.fromDDL(NOTICE),
        "Append",
        "EventTime",
        initialState=None if start is None else start.groupBy("cluster", "client"),
    )
