"""A queue of promises for each loan, as keyed state of a stream.

Several promises of a loan may be open at once. A payment goes to the oldest first and what is left of it to the next; a promise is Kept once it is
covered, and Partial or Broken when its due time has passed. Each promise has a timer of its own. A row that is older than what its
loan has already handled is refused, so a source whose dates run backwards cannot change the past.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnlake.streaming.events import WATERMARK

#: Keyed state with lists and timers needs this store; set it before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_TURN = {"promise": 0, "payment": 1}


def _status(paid: int, amount: int) -> str:
    return "Kept" if paid >= amount else "Partial" if paid else "Broken"


def settle(queue: list[list], now: int) -> tuple[list[list], list[list]]:
    """(still open, closed) at a time: closed are the covered ones, and those that were due before it. An item is [id, amount, paid, due]."""
    open_, closed = [], []
    for item in queue:
        (closed if item[2] >= item[1] or item[3] < now else open_).append(item)
    return open_, closed


def pay(queue: list[list], amount: int) -> None:
    """Add a payment to the oldest promises, as far as each needs."""
    for item in queue:
        part = min(amount, item[1] - item[2])
        item[2] += part
        amount -= part


class PromiseQueue(StatefulProcessor):
    """A loan's state is one value, the clock and the queue laid flat, so a batch reads and writes it once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("loan", "at long, queue array<long>")

    def _held(self) -> tuple[int, list[list]]:
        held = self.state.get()
        if held is None:
            return 0, []
        return held[0], [list(held[1][k : k + 4]) for k in range(0, len(held[1]), 4)]

    def _keep(self, clock: int, queue: list[list]) -> None:
        self.state.update((clock, [x for item in queue for x in item]))

    def _rows(self, key, closed: list[list]) -> list[Row]:
        return [Row(loan_id=key[0], promise_id=i, status=_status(paid, amount), amount=amount, paid=paid) for i, amount, paid, _ in closed]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        (clock, queue), out, made = self._held(), [], set()
        # A payment and a promise of one time: the promise is made first.
        for r in sorted(rows, key=lambda r: (r._at, _TURN.get(r.kind, 2), r.promise_id)):
            now = r._at // 1000
            if now < clock:
                out.append(Row(loan_id=key[0], promise_id=r.promise_id, status="Refused", amount=r.amount, paid=0))
                continue
            clock = now
            queue, closed = settle(queue, now)
            if r.kind == "promise":
                queue.append([r.promise_id, r.amount, 0, r._due])
                made.add(r._due)
            else:
                pay(queue, r.amount)
                queue, kept = settle(queue, now)
                closed += kept
            out += self._rows(key, closed)
        # A promise that has closed by now needs no timer.
        for due in made & {item[3] for item in queue}:
            self.handle.registerTimer(due + 1)
        self._keep(clock, queue)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        clock, held = self._held()
        queue, closed = settle(held, expiredTimerInfo.getExpiryTimeInMs())
        if closed:
            self._keep(clock, queue)
        yield from self._rows(key, closed)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        """Promises that were open before the stream began."""
        clock, queue = self._held()
        queue.append([initialState.promise_id, initialState.amount, initialState.paid, initialState._due])
        self.handle.registerTimer(initialState._due + 1)
        self._keep(clock, sorted(queue, key=lambda x: (x[3], x[0])))

    def close(self) -> None:
        pass


def promise_queue(events: DataFrame, watermark: str = WATERMARK, open_promises: DataFrame | None = None) -> DataFrame:
    """(loan_id, promise_id, status, amount, paid) of every promise that closes, as a stream in append mode.

    ``events``: loan_id, kind (promise or payment), promise_id (a payment's own id for payments), amount in whole cents, event_time, due. ``open_promises``:
    loan_id, promise_id, amount, paid, due, as a batch table. A promise counts payments up to its due time, that included. Rows of other kinds count as payments; null amounts are not allowed.
    """
    number = lambda df: df.select("loan_id", "promise_id", F.col("amount").cast("long").alias("amount"), F.unix_millis("due").alias("_due"), *[c for c in df.columns if c in ("kind", "paid", "event_time", "_at")])
    keyed = number(events.withWatermark("event_time", watermark).withColumn("_at", F.unix_micros("event_time"))).groupBy("loan_id")
    start = None if open_promises is None else number(open_promises).groupBy("loan_id")
    return keyed.transformWithState(PromiseQueue(), "loan_id long, promise_id long, status string, amount long, paid long", "Append", "EventTime", start)


def use_store(spark: SparkSession) -> str | None:
    """Set the state store; returns what was set before."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    return before
