"""Migrations of stored tables: a ledger of steps, each written aside and swapped in whole by one exclusive file.

Under one base folder of the shared file system lie ``data/NAME-ID`` (Parquet, never rewritten) and ``ledger/N``, the N-th
change, created exclusively: it names the step and, for every table, the folders it consists of from then on.  So a step is
there with all its tables or not at all, of two migrators one wins and the other goes on from its result, and rolling back
is one more entry with earlier folders.  The driver handles names; rows are only touched by the steps' own jobs.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits

BUILD_SECONDS = 6 * 3600


class MigrationFailed(RuntimeError):
    """A step raised, or its check did; what was there before is untouched."""


@dataclass(frozen=True)
class Append:
    """Rows added to a table: its folders stay and one is added."""

    rows: DataFrame


Tables = dict[str, list[str]]
Result = dict[str, DataFrame | Append | None]


@dataclass(frozen=True)
class Step:
    """``up`` gets a reader of tables by name and returns the tables it makes anew, appends to, or (None) drops.

    ``check`` gets a reader of the result, before anybody else sees it, and raises to refuse it.
    """

    name: str
    up: Callable[[Callable[[str], DataFrame]], Result]
    check: Callable[[Callable[[str], DataFrame]], None] | None = None


def missing_rows(source: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``source`` whose keys (null equals null) ``backup`` lacks: what a backup still has to take."""
    named = backup.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_b{i}"))
    return source.join(named, same, "left_anti")


class Layout:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def history(self) -> list[dict]:
        """The entries of the ledger in their order."""
        found = (commits.read(self.spark, f"{self.base}/ledger/{n}") for n in commits.names(self.spark, f"{self.base}/ledger"))
        return [e for e in found if e is not None]

    def applied(self) -> list[str]:
        """Names of the steps that hold, oldest first: a rollback takes away those after its step."""
        past = self.history()
        return past[-1]["applied"] if past else []

    def tables(self) -> Tables:
        past = self.history()
        return past[-1]["tables"] if past else {}

    def read(self, name: str) -> DataFrame:
        return self._read(self.tables(), name)

    def _read(self, tables: Tables, name: str) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.base}/data/{folder}" for folder in tables[name]))

    def _enter(self, past: list[dict], entry: dict) -> bool:
        return commits.create_new(self.spark, f"{self.base}/ledger/{len(past) + 1:08d}", entry)

    def migrate(self, steps: list[Step]) -> list[str]:
        """Apply the steps that do not hold yet, in their order; the names of those that this call applied.

        Two steps of one name are refused.  The first that fails ends the call with MigrationFailed; those before it hold.
        """
        names = [s.name for s in steps]
        if len(set(names)) < len(names):
            raise ValueError(f"steps of one name: {sorted(n for n in set(names) if names.count(n) > 1)}")
        done = []
        for step in steps:
            while True:
                past = self.history()
                if past and step.name in past[-1]["applied"]:
                    break
                if self._apply(step, past):
                    done.append(step.name)
        return done

    def _apply(self, step: Step, past: list[dict]) -> bool:
        """Write a step's tables and enter it; False where another migrator entered something meanwhile."""
        before: Tables = past[-1]["tables"] if past else {}
        after, made = {k: list(v) for k, v in before.items()}, []
        try:
            for name, table in step.up(lambda t: self._read(before, t)).items():
                if table is None:
                    after.pop(name, None)
                    continue
                rows, kept = (table.rows, before.get(name, [])) if isinstance(table, Append) else (table, [])
                if kept and rows.schema.simpleString() != self._read(before, name).schema.simpleString():
                    raise ValueError(f"rows appended to {name} have other columns")
                folder = f"{name}-{uuid.uuid4().hex}"
                made.append(folder)
                commits.create_new(self.spark, f"{self.base}/building/{folder}", {"until": time.time() + BUILD_SECONDS})
                rows.write.parquet(f"{self.base}/data/{folder}")
                after[name] = [*kept, folder]
            if step.check is not None:
                step.check(lambda t: self._read(after, t))
        except Exception as e:
            self._drop(made)
            raise MigrationFailed(f"step {step.name}: {e}") from e
        won = self._enter(past, {"step": step.name, "kind": "apply", "tables": after, "applied": [*(past[-1]["applied"] if past else []), step.name]})
        if won:
            for folder in made:
                commits.remove(self.spark, f"{self.base}/building/{folder}")
        else:
            self._drop(made)
        return won

    def _drop(self, folders: list[str]) -> None:
        for folder in folders:
            commits.remove(self.spark, f"{self.base}/data/{folder}")
            commits.remove(self.spark, f"{self.base}/building/{folder}")

    def roll_back(self, to: str | None) -> list[str]:
        """Return to the state after step ``to`` (None: to no tables); the steps taken back, latest first.  Their data stay until ``clear``."""
        while True:
            past = self.history()
            held = past[-1]["applied"] if past else []
            if to is not None and to not in held:
                raise ValueError(f"step {to} does not hold")
            kept = held[: held.index(to) + 1] if to is not None else []
            if kept == held:
                return []
            then = next((e["tables"] for e in reversed(past) if e["applied"] == kept), {})
            if self._enter(past, {"step": to, "kind": "rollback", "tables": then, "applied": kept}):
                return held[len(kept) :][::-1]

    def clear(self, now: float | None = None) -> list[str]:
        """Remove folders that no state which still can be returned to consists of, and that nobody is building; their names.

        States that can be returned to are those after the steps that hold.  A crashed migrator's folders go when
        its mark has run out.
        """
        at = time.time() if now is None else now
        # Marks are read before the ledger: a folder that is entered in between is in the ledger by then.
        building = {n: commits.read(self.spark, f"{self.base}/building/{n}") for n in commits.names(self.spark, f"{self.base}/building")}
        there = commits.names(self.spark, f"{self.base}/data")
        past = self.history()
        held = past[-1]["applied"] if past else []
        last = {tuple(e["applied"]): e["tables"] for e in past}
        used = {f for i in range(len(held) + 1) for t in last.get(tuple(held[:i]), {}).values() for f in t}
        gone = [f for f in there if f not in used and not (f in building and (building[f] is None or building[f]["until"] > at))]
        self._drop(gone)
        return gone
