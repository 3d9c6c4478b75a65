"""State by key that outlives a batch: leases that run out by timers, and answers that expire.

Both are rows in and rows out: a frame for each key would cost more than its rows. They take their rows of a key in order of time within a batch, and what is due by a row's time happens before the row, so results
don't depend on how a stream is cut into batches. A batch that comes again after a failure meets the state of before it.
The session needs the RocksDB state store (``with_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMMANDS = ("enqueue", "lease", "heartbeat", "complete", "fail")


def with_state_store(spark: SparkSession) -> SparkSession:
    """``spark`` with the store that keyed state needs; queries that are started afterwards use it."""
    spark.conf.set(_STORE, _ROCKS)
    return spark


_Change = Row("item", "turn", "at", "command", "state", "attempts", "until")
_Answer = Row("url_hash", "id", "ok", "fetched_at")


def _ordered(rows: Iterator[Row]) -> list[Row]:
    """The rows of a key in this batch by time, then id; as many as a batch has."""
    return sorted(rows, key=lambda r: (r["at"], r["id"]))


class _Leases(StatefulProcessor):
    """A work item: QUEUED until it is leased, LEASED until it is settled or its time is up, QUEUED again after a pause, DONE or DEAD."""

    def __init__(self, lease: int, most: int, base: int, longest: int):
        self.lease, self.most, self.base, self.longest = lease, most, base, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "state string, attempts int, until long, turn long")

    def _expired(self, s: dict, now: int) -> bool:
        """Gives back what is leased no longer at ``now``."""
        if s["state"] == "LEASED" and s["until"] <= now:
            s["state"] = "QUEUED"
            return True
        return False

    def _applied(self, s: dict, command: str, at: int) -> bool:
        """Whether the command changes the item at this time."""
        state = s["state"]
        if command == "enqueue" and state in ("", "DEAD"):
            s.update(state="QUEUED", until=at)
        elif command == "lease" and state == "QUEUED" and s["until"] <= at:
            s.update(state="LEASED", until=at + self.lease, attempts=s["attempts"] + 1)
        elif command == "heartbeat" and state == "LEASED":
            s.update(until=at + self.lease)
        elif command == "complete" and state == "LEASED":
            s.update(state="DONE", until=at)
        elif command == "fail" and state == "LEASED":
            dead = s["attempts"] >= self.most
            s.update(state="DEAD" if dead else "QUEUED", until=at if dead else at + min(self.base * 2 ** (s["attempts"] - 1), self.longest))
        else:
            return False
        return True

    def _settled(self, key, s: dict, before: int | None, out: list[tuple]) -> Iterator[Row]:
        self.item.update((s["state"], s["attempts"], s["until"], s["turn"]))
        timer = s["until"] if s["state"] == "LEASED" else None
        if before != timer:
            if before is not None:
                self.handle.deleteTimer(before)
            if timer is not None:
                self.handle.registerTimer(timer)
        yield from (_Change(key[0], *r) for r in out)

    def _known(self) -> dict:
        return dict(zip(("state", "attempts", "until", "turn"), self.item.get() or ("", 0, 0, 0), strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, out = self._known(), []
        before = s["until"] if s["state"] == "LEASED" else None

        def note(at: int, command: str) -> None:
            s["turn"] += 1
            out.append((s["turn"], at, command, s["state"], s["attempts"], s["until"]))

        for r in _ordered(rows):
            if self._expired(s, r["at"]):
                note(s["until"], "expire")
            if self._applied(s, r["command"], r["at"]):
                note(r["at"], r["command"])
        if out:
            yield from self._settled(key, s, before, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, at = self._known(), expiredTimerInfo.getExpiryTimeInMs()
        if self._expired(s, at):
            s["turn"] += 1
            yield from self._settled(key, s, None, [(s["turn"], s["until"], "expire", s["state"], s["attempts"], s["until"])])


def leases(commands: DataFrame, late: str = "0 seconds", lease_seconds: int = 300, most_attempts: int = 3, base_seconds: int = 30, most_seconds: int = 3600) -> DataFrame:
    """The changes of a queue's items that a stream ``commands(item, id, command, ts)`` makes, and that time makes.

    command: one of enqueue, lease, heartbeat, complete, fail; what doesn't fit an item's state changes nothing. (item string, turn, at,
    command, state, attempts, until): ``turn`` counts an item's changes, times are milliseconds, ``until`` is when a lease runs out, or when a
    queued item can be leased. A lease that runs out is given back by a timer once the watermark, ``late`` behind the newest
    command, has passed it. Commands of null item or time are left out.
    """
    rows = commands.where("item is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("ts", F.col("item").cast("string").alias("item"), F.col("id").cast("long").alias("id"), "command", F.unix_millis("ts").alias("at"))
    return rows.groupBy("item").transformWithState(
        statefulProcessor=_Leases(lease_seconds * 1000, most_attempts, base_seconds * 1000, most_seconds * 1000),
        outputStructType="item string, turn long, at long, command string, state string, attempts int, until long", outputMode="Append", timeMode="EventTime",
    )


class _Answers(StatefulProcessor):
    """The newest answer of a key, which the store forgets by itself after its time to live."""

    def __init__(self, live: int):
        self.live = live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "at long, status int", self.live)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.answer.get()
        old, out = held, []
        for r in _ordered(rows):
            if r["status"] is None:
                live = held is not None and held[0] + self.live >= r["at"]
                out.append(_Answer(key[0], r["id"], live and held[1] == 200, held[0] if live else None))
            else:
                held = (r["at"], r["status"])
        if held != old:
            self.answer.update(held)
        yield from out


def cached_answers(fetches: DataFrame, hours: int = 72) -> DataFrame:
    """What a stream ``fetches(url_hash, id, status, ts)`` finds in a cache: rows with a status are answers that are kept, those without ask for one.

    (url_hash, id, ok, fetched_at): for each row that asks, whether there is an answer of status 200, and when the newest answer came, if not more than
    ``hours`` before; milliseconds. An answer's state goes by itself after that time.
    """
    rows = fetches.where("url_hash is not null and ts is not null").select("url_hash", F.col("id").cast("long").alias("id"), F.col("status").cast("int").alias("status"), F.unix_millis("ts").alias("at"))
    return rows.groupBy("url_hash").transformWithState(
        statefulProcessor=_Answers(hours * 3_600_000), outputStructType="url_hash string, id long, ok boolean, fetched_at long", outputMode="Append", timeMode="ProcessingTime",
    )
