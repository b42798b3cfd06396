"""The command log of memory: against a plain table scanned row by row, as a stream against the stored log, and by cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexmill.streaming import memory_commands as M

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
BIG = 9007199254740993
COLUMNS = [c for c in M.INPUT]


def command(user, seq, op, days=0.0, **fields):
    return dict.fromkeys(COLUMNS) | {"user_id": user, "seq": seq, "at": START + dt.timedelta(days=days), "op": op, "scope_id": None} | fields


def said(user, seq, value, days=0.0, key="fact.name", kind="fact", **fields):
    return command(user, seq, "apply", days, kind=kind, key=key, value=value, statement_type=fields.pop("statement_type", "explicit"), stability="stable", order_id=fields.pop("order_id", seq), **fields)


def frame(spark, rows):
    kinds = ", ".join(f"{c} {'timestamp' if c == 'at' else t}" for c, t in M.INPUT.items())
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], kinds)


def changes(df):
    return [(r.seq, r.item_id, r.change, r.reason or r.status) for r in df.orderBy(F.col("n").isNull(), "changed_at", "seq", "item_id", "n").collect()]


class Table:
    """All rows of all users in one list, every question a scan of it."""

    def __init__(self):
        self.rows, self.state = [], {}

    def open(self, user, **same):
        return [r for r in self.rows if r["user"] == user and all(r[k] == v for k, v in same.items())]

    def expire(self, user, ms):
        for r in self.open(user):
            if r["status"] in ("candidate", "active") and r["until"] is not None and r["until"] <= ms:
                r.update(status="expired", revision=r["revision"] + 1, touched=r["until"])

    def run(self, c):
        user, ms = c["user_id"], int(c["at"].timestamp() * 1000)
        s = self.state.setdefault(user, {"seq": 0, "epoch": 0, "blocked": 0, "on": True})
        if c["seq"] <= s["seq"]:
            return
        s["seq"] = c["seq"]
        self.expire(user, ms)
        if c["op"] == "apply":
            self.apply(c, s, ms)
        elif self.person(c, s, ms):
            s["epoch"] += 1
            s["blocked"] = max(s["blocked"], c["order_id"])

    def supersede(self, rows, ms):
        for r in rows:
            r.update(status="superseded", revision=r["revision"] + 1, touched=ms)

    def person(self, c, s, ms):
        user, op = c["user_id"], c["op"]
        if op == "clear" and c["epoch"] == s["epoch"]:
            self.rows = [r for r in self.rows if r["user"] != user]
            return True
        if op == "enable" and c["epoch"] == s["epoch"] and c["enabled"] is not None:
            s["on"] = c["enabled"]
            return True
        found = self.open(user, id=c["item_id"])
        if op not in ("edit", "confirm", "complete", "delete") or not found or c["revision"] != found[0]["revision"]:
            return False
        r = found[0]
        slot = self.open(user, scope=r["scope"], key=r["key"])
        waiting = [x for x in slot if x["status"] == "candidate"]
        known = lambda v: v and (r["key"] not in M.VALUES or v in M.VALUES[r["key"]])
        if op == "delete":
            self.rows = [x for x in self.rows if x is not r and not (r["status"] == "active" and any(x is w for w in waiting))]
        elif op == "complete":
            if r["status"] != "active" or r["kind"] != "open_question":
                return False
            r.update(status="completed", revision=r["revision"] + 1, touched=ms)
        elif op == "edit":
            if not known(c["value"]):
                return False
            r.update(value=c["value"], by="user_edit", revision=r["revision"] + 1, touched=ms)
            if r["status"] == "active":
                self.supersede(waiting, ms)
        else:
            if r["status"] != "candidate" or c["epoch"] != s["epoch"] or not known(r["value"]):
                return False
            self.supersede([x for x in slot if x["status"] == "active"], ms)
            r.update(status="active", by="user_confirmation", revision=r["revision"] + 1, touched=ms, until=ms + 90 * M.DAY if r["kind"] == "open_question" else None)
        return True

    def apply(self, c, s, ms):
        if (not s["on"] and not c["force"]) or (c["epoch"] is not None and c["epoch"] != s["epoch"]) or c["order_id"] <= s["blocked"]:
            return
        user, scope, key, order = c["user_id"], c["scope_id"], c["key"], c["order_id"]
        family = "open_question:" if c["kind"] == "open_question" else c["kind"] + "."
        if c["match_key"] and c["match_key"].startswith(family) and self.open(user, scope=scope, key=c["match_key"]):
            key = c["match_key"]
        slot = self.open(user, scope=scope, key=key)
        by_status = lambda *names: [r for r in slot if r["status"] in names]
        lasting = ms + 90 * M.DAY if c["kind"] == "open_question" else None
        sure = c["statement_type"] == "explicit" and c["stability"] == "stable"

        def insert(status, until):
            self.rows.append({"user": user, "id": c["seq"], "scope": scope, "key": key, "kind": c["kind"], "status": status, "value": c["value"], "revision": 1, "by": "user_message", "order": order, "until": until, "touched": ms})

        def refresh(r):
            r.update(order=max(r["order"], order), touched=ms)

        def wait():
            same = [r for r in by_status("candidate") if r["value"] == c["value"]]
            refresh(same[0]) if same else insert("candidate", ms + 30 * M.DAY)

        if c["force"]:
            wait()
        elif by_status("active"):
            a = by_status("active")[0]
            if a["value"] == c["value"]:
                refresh(a)
            elif order > a["order"]:
                if sure and a["by"] == "user_message":
                    a.update(value=c["value"], order=order, revision=a["revision"] + 1, touched=ms)
                    self.supersede(by_status("candidate"), ms)
                else:
                    wait()
        elif by_status("completed", "expired"):
            if c["reopen"] and c["statement_type"] == "explicit":
                r = sorted(by_status("completed", "expired"), key=lambda r: (r["touched"], r["id"]))[-1]
                # The kind of the item decides how long it lasts; keys of one family share it.
                r.update(status="active", value=c["value"], by="user_message", order=order, revision=r["revision"] + 1, until=lasting, touched=ms)
        elif sure:
            insert("active", lasting)
        else:
            wait()


def random_log(users=6, per_user=160, seed=3):
    """Commands that often meet: few keys and values, mostly items, revisions and epochs that exist, replays, gaps of weeks."""
    rng, rows, guide = random.Random(seed), [], Table()
    for user in range(users):
        days = 0.0
        for seq in range(1, per_user):
            days += rng.choice([0, 0, 0.5, 1, 9])
            epoch = guide.state.get(user, {"epoch": 0})["epoch"] - (rng.random() < 0.1)
            op = rng.choices(["apply", "edit", "confirm", "complete", "delete", "clear", "enable", "what"], [60, 6, 12, 9, 6, 1, 2, 1])[0]
            kind, keys = rng.choice([("fact", ["fact.a", "fact.b"]), ("open_question", ["open_question:x", "open_question:y"]), ("preference", ["preference.language"])])
            row = command(user, seq, op, days, scope_id=rng.choice([None, BIG, BIG - 1]), order_id=seq * 10 - rng.choice([0, 0, 0, 25]), epoch=rng.choice([None, epoch]) if op == "apply" else epoch)
            if op == "apply":
                row |= {"kind": kind, "key": rng.choice(keys), "match_key": rng.choice([None, *keys, "fact.zzz"]), "value": rng.choice(["en", "fr", "de", "xx"]), "statement_type": rng.choice(["explicit", "inferred"])}
                row |= {"stability": rng.choice(["stable", "stable", "unknown"]), "reopen": rng.random() < 0.4, "force": rng.random() < 0.1}
            else:
                state = {"confirm": ["candidate"], "complete": ["active"]}.get(op, ["active", "candidate", "completed"])
                there = [r for r in guide.open(user) if r["status"] in state] or [{"id": seq - 1, "revision": 1}]
                pick = rng.choice(there)
                row |= {"item_id": pick["id"], "revision": rng.choice([pick["revision"]] * 4 + [None, 9]), "value": rng.choice(["en", "fr", ""]), "enabled": rng.choice([True, True, False, None])}
            rows.append(row)
            guide.run(row)
            if rng.random() < 0.03:
                rows.append(dict(row))
    return rows


def as_tuples(items):
    ms = lambda t: None if t is None else int(t.replace(tzinfo=dt.UTC).timestamp() * 1000)
    return sorted(((r.user_id, r.item_id, r.scope_id or 0, r.key, r.status, r.value, r.revision, r.source_type, r.order_id, ms(r.expires_at)) for r in items.collect()), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_fold_equals_a_scanned_table(spark, seed):
    rows = random_log(seed=seed)
    last = max(r["at"] for r in rows)
    table = Table()
    for r in rows:
        table.run(r)
    for user in range(6):
        table.expire(user, int(last.timestamp() * 1000))
    log = M.fold_commands(frame(spark, rows), int(last.timestamp() * 1000))
    want = sorted(((r["user"], r["id"], r["scope"] or 0, r["key"], r["status"], r["value"], r["revision"], r["by"], r["order"], r["until"]) for r in table.rows), key=str)
    assert as_tuples(M.current_items(log)) == want
    seen = {r.change for r in log.select("change").distinct().collect()}
    assert {"created", "updated", "candidate", "confirmed", "completed", "deleted", "expired", "refreshed", "refused"} <= seen


def test_stream_equals_fold(spark, tmp_path):
    rows = random_log(users=4, per_user=90, seed=5)
    n, source = 5, f"file://{tmp_path}/in"
    for i in range(n):  # by number, so that every user's commands come in order
        part = [r for r in rows if r["seq"] * n // 90 == i]
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in range(2):  # stopped and started again from its checkpoint
            stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(source)
            query = M.stream_commands(stream, "30 days").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start(f"file://{tmp_path}/out")
            assert query.awaitTermination(240)
            if not part:
                extra = [command(0, 1000, "enable", 2000, enabled=True, epoch=-1)]
                frame(spark, extra).coalesce(1).write.mode("append").parquet(source)
    finally:
        spark.conf.unset(name)
    got = spark.read.parquet(f"file://{tmp_path}/out")
    want = M.fold_commands(frame(spark, rows + extra), int((extra[0]["at"] - dt.timedelta(days=30)).timestamp() * 1000))
    key = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert key(got.select(*want.columns)) == key(want)
    assert got.filter("change = 'expired'").count() > 3


def test_pause_barrier_and_merging(spark):
    rows = [
        said(1, 1, "Ann"),
        said(1, 2, "Anna", key="fact.call_name", match_key="fact.name"),  # the other key exists: merged into it
        said(1, 3, "Oslo", key="fact.town", match_key="fact.city"),  # it does not: its own key
        command(1, 4, "enable", enabled=False, epoch=0, order_id=50),
        said(1, 5, "Bo", order_id=60),  # paused
        said(1, 6, "Bo", order_id=61, force=True),  # said while paused: waits
        said(1, 7, "Cy", order_id=40, force=True),  # older than the barrier
        command(1, 8, "confirm", item_id=6, revision=1, epoch=1, order_id=70),
        command(1, 8, "confirm", item_id=6, revision=1, epoch=1, order_id=70),  # replay
        command(1, 9, "delete", item_id=6, revision=1),  # somebody else was faster
        command(1, 10, "clear", epoch=2, order_id=80),
        command(1, 11, "edit", item_id=6, revision=2, value="x"),
        said(2, 1, "x", key=None), said(2, 2, None), said(2, 3, "Zoe", order_id=None), command(2, 4, None), command(None, 1, "clear"), command(2, None, "clear"),
    ]
    log = M.fold_commands(frame(spark, rows))
    one = [x for x in changes(log.filter("user_id = 1"))]
    assert set(one) == {
        (1, 1, "created", "active"), (2, 1, "updated", "active"), (3, 3, "created", "active"), (4, None, "paused", None), (5, None, "refused", "paused"), (6, 6, "candidate", "candidate"),
        (7, None, "refused", "stale"), (8, 1, "updated", "superseded"), (8, 6, "confirmed", "active"), (9, 6, "refused", "conflict"), (10, None, "cleared", None), (11, 6, "refused", "not_found"),
    }
    assert [x[3] for x in sorted(changes(log.filter("user_id = 2")))] == ["invalid", "invalid", "stale", "invalid"]
    assert M.current_items(log).count() == 0
    assert M.fold_commands(frame(spark, [])).count() == 0


def test_query_equals_a_scanned_table(spark):
    from lexmill import records

    d = "/root/testdata/sf0.001"
    commands = records._input(spark, d, records._LOG).select(*(F.col(c).cast("timestamp" if c == "at" else t).alias(c) if c != "match_key" else F.lit(None).cast("string").alias(c) for c, t in M.INPUT.items()))
    rows = [r.asDict() | {"at": r["at"].replace(tzinfo=dt.UTC)} for r in commands.orderBy("user_id", "seq").collect()]
    table = Table()
    for r in rows:
        table.run(r)
    for user in {r["user_id"] for r in rows}:  # items that nobody touched any more stay as they are in the log
        table.expire(user, 0)
    want = {(r["user"], r["id"]): (r["value"], r["by"], r["order"]) for r in table.rows}
    log = records.memory_changes(spark, d)
    last = log.filter("n IS NOT NULL").groupBy("user_id", "item_id").agg(F.max_by(F.struct("status", "value", "source_type"), "n").alias("s")).filter("s.status <> 'deleted'").collect()
    assert {(r.user_id, r.item_id): (r.s.value, r.s.source_type) for r in last} == {k: v[:2] for k, v in want.items()}
    assert {"confirmed", "enabled"} <= {r.change for r in log.select("change").distinct().collect()}
