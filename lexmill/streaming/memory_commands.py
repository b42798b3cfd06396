"""The command log of governed memory: one step function, folded over a stored log or run on a stream with keyed state.

A command is a row: user_id, seq (its number, ascending within the user), at (timestamp), op and what that op reads:

- ``apply``: a validated candidate (kind, scope_id, key, match_key, value, statement_type, stability, reopen), the message it
  comes from (order_id), the epoch it was read under, and force (said while memory was paused: it may only wait)
- ``edit`` (item_id, revision, value), ``confirm`` (item_id, revision, epoch), ``complete`` and ``delete`` (item_id, revision)
- ``clear`` (epoch) and ``enable`` (enabled, epoch)

All but ``apply`` are barriers: they raise the user's epoch, and what comes from messages up to their order_id is stale
afterwards.  The result is a log of changes; an item's number is the seq of the command that made it, ``n`` counts its changes.
Candidates live 30 days, active open questions 90: an item expires at that moment, whenever it is noticed.
Commands without user or number are left out; one at or below the user's last number is a replay and does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import CANDIDATE_DAYS, FAMILIES, QUESTION_DAYS, VALUES

DAY = 86_400_000
MANUAL = ("user_edit", "user_confirmation")
INPUT = {
    "user_id": "long", "seq": "long", "at": "long", "op": "string", "item_id": "long", "scope_id": "long", "kind": "string", "key": "string", "match_key": "string", "value": "string",
    "statement_type": "string", "stability": "string", "reopen": "boolean", "force": "boolean", "order_id": "long", "epoch": "long", "revision": "long", "enabled": "boolean",
}
ITEM = {"item_id": "long", "kind": "string", "status": "string", "value": "string", "revision": "long", "source_type": "string", "order_id": "long", "expires_ms": "long", "at_ms": "long", "n": "long"}
LOG = {"user_id": "long", "seq": "long", "scope_id": "long", "key": "string", **ITEM, "change": "string", "reason": "string"}
SLOT_KEY, ID_KEY = "scope_id long, key string", "item_id long"
_ddl = lambda columns: ", ".join(f"{c} {t}" for c, t in columns.items())
SLOT = f"items array<struct<{', '.join(f'{c}: {t}' for c, t in ITEM.items())}>>"
META = "seq long, epoch long, blocked long, enabled boolean"

Slot = tuple[int | None, str]


class Held:
    """The items of one user in memory: slots (scope, key) -> items, and item -> slot."""

    def __init__(self) -> None:
        self.meta = {"seq": None, "epoch": 0, "blocked": 0, "enabled": True}
        self.slots: dict[Slot, list[dict]] = {}
        self.ids: dict[int, Slot] = {}

    def slot(self, at: Slot) -> list[dict]:
        return self.slots.get(at, [])

    def put(self, at: Slot, items: list[dict]) -> None:
        if items:
            self.slots[at] = items
        else:
            self.slots.pop(at, None)

    def find(self, item_id: int) -> Slot | None:
        return self.ids.get(item_id)

    def name(self, item_id: int, at: Slot) -> None:
        self.ids[item_id] = at

    def forget(self, item_id: int) -> None:
        self.ids.pop(item_id, None)

    def places(self) -> list[Slot]:
        return list(self.slots)

    def empty(self) -> None:
        self.slots.clear()
        self.ids.clear()

    def due(self, ms: int) -> None:
        """Told when an item will expire."""


class Step:
    """One command, or the passing of time, on one user's items; ``out`` collects the changes."""

    def __init__(self, user_id: int, held: Held) -> None:
        self.user_id, self.held, self.out = user_id, held, []

    def _say(self, at: Slot, item: dict, change: str, seq: int | None, ms: int) -> None:
        item["n"], item["at_ms"] = item["n"] + 1, ms
        self.out.append({"user_id": self.user_id, "seq": seq, "scope_id": at[0], "key": at[1], **item, "change": change, "reason": None})

    def _refuse(self, c: dict, reason: str) -> None:
        row = dict.fromkeys(LOG) | {"user_id": self.user_id, "seq": c["seq"], "at_ms": c["at"], "scope_id": c["scope_id"], "key": c["key"], "item_id": c["item_id"], "change": "refused", "reason": reason}
        self.out.append(row)

    def _lasts(self, item: dict, ms: int) -> None:
        days = CANDIDATE_DAYS if item["status"] == "candidate" else QUESTION_DAYS if item["kind"] == "open_question" else None
        item["expires_ms"] = None if days is None else ms + days * DAY
        if days is not None:
            self.held.due(item["expires_ms"])

    def _aged(self, at: Slot, ms: int) -> list[dict]:
        """The items of a slot, those whose time is over by ``ms`` expired at the moment it was over."""
        items = self.held.slot(at)
        gone = [i for i in items if i["status"] in ("candidate", "active") and i["expires_ms"] is not None and i["expires_ms"] <= ms]
        for i in gone:
            i["status"], i["revision"] = "expired", i["revision"] + 1
            self._say(at, i, "expired", None, i["expires_ms"])
        if gone:
            self.held.put(at, items)
        return items

    def age(self, ms: int) -> None:
        for at in self.held.places():
            self._aged(at, ms)

    def run(self, c: dict) -> None:
        meta = self.held.meta
        if meta["seq"] is not None and c["seq"] <= meta["seq"]:
            return
        meta["seq"] = c["seq"]
        if c["op"] == "apply":
            return self._apply(c)
        if c["op"] in ("clear", "enable"):
            if c["epoch"] is None or c["epoch"] != meta["epoch"]:
                return self._refuse(c, "conflict")
            if c["op"] == "enable" and c["enabled"] is None:
                return self._refuse(c, "invalid")
            self.age(c["at"])
            if c["op"] == "clear":
                self.held.empty()
            else:
                meta["enabled"] = c["enabled"]
            self.out.append(dict.fromkeys(LOG) | {"user_id": self.user_id, "seq": c["seq"], "at_ms": c["at"], "change": "cleared" if c["op"] == "clear" else "enabled" if c["enabled"] else "paused"})
        elif c["op"] in ("edit", "confirm", "complete", "delete"):
            reason = self._change(c)
            if reason:
                return self._refuse(c, reason)
        else:
            return self._refuse(c, "invalid")
        meta["epoch"] += 1
        meta["blocked"] = max(meta["blocked"], c["order_id"] or 0)

    def _outdated(self, at: Slot, items: list[dict], c: dict) -> None:
        for i in items:
            if i["status"] == "candidate":
                i["status"], i["revision"] = "superseded", i["revision"] + 1
                self._say(at, i, "updated", c["seq"], c["at"])

    def _change(self, c: dict) -> str | None:
        """A person's command on one item: None when done, else why not."""
        at = None if c["item_id"] is None else self.held.find(c["item_id"])
        if at is None:
            return "not_found"
        items = self._aged(at, c["at"])
        item = next(i for i in items if i["item_id"] == c["item_id"])
        op, allowed = c["op"], VALUES.get(at[1])
        if op == "confirm" and item["status"] != "candidate":
            return "conflict"
        if op == "complete" and (item["status"] != "active" or item["kind"] not in ("reading_goal", "open_question")):
            return "invalid"
        if c["revision"] is None:
            return "invalid"
        if c["revision"] != item["revision"] or op == "confirm" and c["epoch"] != self.held.meta["epoch"]:
            return "conflict"
        value = c["value"] if op == "edit" else item["value"]
        if op in ("edit", "confirm") and (not value or allowed is not None and value not in allowed):
            return "invalid"
        if op == "delete":
            gone = [i for i in items if i is item or item["status"] == "active" and i["status"] == "candidate"]
            for i in gone:
                i["status"] = "deleted"
                self._say(at, i, "deleted", c["seq"], c["at"])
                self.held.forget(i["item_id"])
            self.held.put(at, [i for i in items if i["status"] != "deleted"])
            return None
        if op == "confirm":
            for i in items:
                if i["status"] == "active":
                    i["status"], i["revision"] = "superseded", i["revision"] + 1
                    self._say(at, i, "updated", c["seq"], c["at"])
        item["revision"] += 1
        if op == "complete":
            item["status"] = "completed"
        elif op == "edit":
            item["value"], item["source_type"] = value, "user_edit"
        else:
            item["status"], item["source_type"] = "active", "user_confirmation"
            self._lasts(item, c["at"])
        self._say(at, item, {"edit": "updated", "confirm": "confirmed", "complete": "completed"}[op], c["seq"], c["at"])
        if op == "edit" and item["status"] == "active":
            self._outdated(at, items, c)
        self.held.put(at, items)
        return None

    def _apply(self, c: dict) -> None:
        meta, order = self.held.meta, c["order_id"]
        if not meta["enabled"] and not c["force"]:
            return self._refuse(c, "paused")
        if order is None or c["epoch"] is not None and c["epoch"] != meta["epoch"] or order <= meta["blocked"]:
            return self._refuse(c, "stale")
        if c["key"] is None or c["kind"] is None or c["value"] is None:
            return self._refuse(c, "invalid")
        at, other = (c["scope_id"], c["key"]), c["match_key"]
        if other and other != c["key"] and other.startswith(FAMILIES.get(c["kind"], "\0")) and self.held.slot((c["scope_id"], other)):
            at = (c["scope_id"], other)
        items = self._aged(at, c["at"])
        explicit = c["statement_type"] == "explicit"
        sure = explicit and c["stability"] == "stable"
        active = next((i for i in items if i["status"] == "active"), None)
        closed = [i for i in items if i["status"] in ("completed", "expired")]
        if c["force"]:
            self._wait(at, items, c)
        elif active is not None:
            if active["value"] == c["value"]:
                self._refresh(at, active, c)
            elif order <= active["order_id"]:
                return self._refuse(c, "older")
            elif sure and active["source_type"] not in MANUAL:
                self._renew(at, active, c, "updated", lasts=False)
                self._outdated(at, items, c)
            else:
                self._wait(at, items, c)
        elif closed:
            if not (c["reopen"] and explicit):
                return self._refuse(c, "closed")
            self._renew(at, max(closed, key=lambda i: (i["at_ms"], i["item_id"])), c, "updated")
        elif sure:
            items.append(self._new(at, c))
            self._renew(at, items[-1], c, "created")
        else:
            self._wait(at, items, c)
        self.held.put(at, items)

    def _new(self, at: Slot, c: dict) -> dict:
        self.held.name(c["seq"], at)
        return dict.fromkeys(ITEM) | {"item_id": c["seq"], "kind": c["kind"], "value": c["value"], "revision": 0, "order_id": c["order_id"], "n": 0}

    def _refresh(self, at: Slot, item: dict, c: dict) -> None:
        item["order_id"] = max(item["order_id"], c["order_id"])
        if item["source_type"] not in MANUAL:
            item["source_type"] = "user_message"
        self._say(at, item, "refreshed", c["seq"], c["at"])

    def _renew(self, at: Slot, item: dict, c: dict, change: str, lasts: bool = True) -> None:
        item |= {"status": "active", "value": c["value"], "source_type": "user_message", "order_id": c["order_id"], "revision": item["revision"] + 1}
        if lasts:
            self._lasts(item, c["at"])
        self._say(at, item, change, c["seq"], c["at"])

    def _wait(self, at: Slot, items: list[dict], c: dict) -> None:
        same = next((i for i in items if i["status"] == "candidate" and i["value"] == c["value"]), None)
        if same is not None:
            return self._refresh(at, same, c)
        item = self._new(at, c) | {"status": "candidate", "source_type": "user_message", "revision": 1}
        self._lasts(item, c["at"])
        items.append(item)
        self._say(at, item, "candidate", c["seq"], c["at"])


def _typed(commands: DataFrame) -> DataFrame:
    """The commands in their types; columns that are not there are null, ``at`` is in milliseconds."""
    has = lambda c: F.col(c) if c in commands.columns else F.lit(None)
    ms = F.unix_millis(F.col("at").cast("timestamp"))
    return commands.select(*((ms if c == "at" else has(c).cast(t)).alias(c) for c, t in INPUT.items())).filter("user_id IS NOT NULL AND seq IS NOT NULL AND at IS NOT NULL")


def _timed(log: DataFrame) -> DataFrame:
    return log.select(*(F.timestamp_millis(c).alias(c.replace("_ms", "")) if c.endswith("_ms") else F.col(c) for c in LOG)).withColumnsRenamed({"at": "changed_at", "expires": "expires_at"})


def fold_commands(commands: DataFrame, now_ms: int | None = None) -> DataFrame:
    """The log of changes of a stored command log; with ``now_ms`` what has run out by then is expired at the end.

    A user's commands arrive sorted and stream through; one user's items are held, not the commands.
    """
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(c, kinds[t]) for c, t in LOG.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step: Step | None = None
        out: list[dict] = []
        for batch in batches:
            for c in batch.to_pylist():
                if step is None or step.user_id != c["user_id"]:
                    if step is not None and now_ms is not None:
                        step.age(now_ms)
                    step = Step(c["user_id"], Held())
                    step.out = out
                step.run(c)
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
        if step is not None and now_ms is not None:
            step.age(now_ms)
        yield pa.RecordBatch.from_pylist(out, schema)

    return _timed(_typed(commands).repartition("user_id").sortWithinPartitions("user_id", "seq").mapInArrow(run, _ddl(LOG)))


class _Keyed(Held):
    """The items of one user in the state store; nothing but the slots a command names is read."""

    def __init__(self, slots, ids, timers: StatefulProcessorHandle, meta: dict) -> None:
        self._slots, self._ids, self._timers, self.meta = slots, ids, timers, meta

    def slot(self, at: Slot) -> list[dict]:
        return [dict(zip(ITEM, i, strict=True)) for i in self._slots.getValue(at)[0]] if self._slots.containsKey(at) else []

    def put(self, at: Slot, items: list[dict]) -> None:
        if items:
            self._slots.updateValue(at, ([tuple(i[c] for c in ITEM) for i in items],))
        elif self._slots.containsKey(at):
            self._slots.removeKey(at)

    def find(self, item_id: int) -> Slot | None:
        return tuple(self._ids.getValue((item_id,))) if self._ids.containsKey((item_id,)) else None

    def name(self, item_id: int, at: Slot) -> None:
        self._ids.updateValue((item_id,), at)

    def forget(self, item_id: int) -> None:
        self._ids.removeKey((item_id,))

    def places(self) -> list[Slot]:
        return [tuple(k) for k in self._slots.keys()]  # noqa: SIM118

    def empty(self) -> None:
        self._slots.clear()
        self._ids.clear()

    def due(self, ms: int) -> None:
        self._timers.registerTimer(ms)


class MemoryCommands(StatefulProcessor):
    """Two maps of state and one row a user; timers by event time expire what nobody touches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._meta = handle.getValueState("meta", META)
        self._slots = handle.getMapState("slots", SLOT_KEY, SLOT)
        self._ids = handle.getMapState("ids", ID_KEY, SLOT_KEY)

    def _step(self, user_id: int) -> Step:
        meta = dict(zip(("seq", "epoch", "blocked", "enabled"), self._meta.get(), strict=True)) if self._meta.exists() else Held().meta
        return Step(user_id, _Keyed(self._slots, self._ids, self._handle, meta))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names that Spark calls
        step = self._step(key[0])
        for r in sorted(rows, key=lambda r: r["seq"]):
            step.run({c: r[c] for c in INPUT})
        self._meta.update(tuple(step.held.meta.values()))
        yield from (Row(**r) for r in step.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        step = self._step(key[0])
        step.age(expiredTimerInfo.getExpiryTimeInMs())
        yield from (Row(**r) for r in step.out)

    def close(self) -> None:
        pass


def stream_commands(commands: DataFrame, late: str = "1 hour") -> DataFrame:
    """The log of changes of a stream of commands: the rows of ``fold_commands`` as they happen.

    The commands of a user come in the order of their numbers, but for those of one micro-batch, which are sorted (their
    number is bounded by the source's rate options).  Items expire as the watermark, ``late`` behind the newest command, passes
    their time.  Needs the RocksDB state store.
    """
    stamped = _typed(commands).withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", late)
    log = stamped.groupBy("user_id").transformWithState(MemoryCommands(), _ddl(LOG), "append", "EventTime")
    return _timed(log)


def current_items(log: DataFrame) -> DataFrame:
    """The items that a log of changes leaves: the last change of each that was neither deleted nor cleared."""
    cleared = log.filter("change = 'cleared'").groupBy("user_id").agg(F.max("seq").alias("cleared"))
    columns = ["scope_id", "key", *(c for c in ("kind", "status", "value", "revision", "source_type", "order_id", "expires_at"))]
    last = log.filter("n IS NOT NULL").groupBy("user_id", "item_id").agg(F.max_by(F.struct(*columns), "n").alias("s"))
    kept = last.join(cleared, "user_id", "left").filter("s.status <> 'deleted' AND item_id > coalesce(cleared, item_id - 1)")
    return kept.select("user_id", "item_id", "s.*")
