"""Sessions: when they are processed, which windows of their transcript are read, and what reuse policies cost over a run of tasks.

Each is a fold, as what a step does depends on the steps before. A session or a scenario is one group; both are of bounded size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WARM_UP, QUEUE, IDLE = (1, 2, 4, 8), 20, 300.0


def schedule(times: list[float], state: tuple[int, int, float | None], queue: int = QUEUE, idle: float = IDLE) -> tuple[list[bool], tuple]:
    """For each turn whether its session is processed then, and the state (turns, queued, last) after them.

    A turn is queued first; the session is processed on its first turns, when its queue is long, or after a pause. That
    empties the queue.
    """
    turns, queued, last = state
    out = []
    for at in times:
        turns, queued, last = turns + 1, queued + 1, at if last is None else last
        due = turns in WARM_UP or queued >= queue or at - last >= idle
        out.append(due)
        if due:
            queued, last = 0, at
    return out, (turns, queued, last)


def scheduled(turns: DataFrame, queue: int = QUEUE, idle: float = IDLE) -> DataFrame:
    """(session, n, due) for turns (session, n, at in seconds); streaming.scheduler has the queues themselves, and streams."""

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"])
        return pd.DataFrame({"session": key[0], "n": pdf.n, "due": schedule(pdf["at"].tolist(), (0, 0, None), queue, idle)[0]})

    return turns.groupBy("session").applyInPandas(whole, "session long, n long, due boolean")


def transcript_windows(lines: DataFrame, most: int = 4000, limit: int = 3) -> DataFrame:
    """(session, window, chars, failed, text): lines (session, n, line, failed) in windows that end with the line that brings them to most characters.

    Of a session's windows limit are chosen, those with failures first, then the longest, then the earliest. Null lines are
    empty; lines of one n go by their text. Only the numbers of windows are found by session in one task.
    """

    def number(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "line", "failed"], ignore_index=True)
        ends, windows, at = pdf.line.str.len().cumsum().to_numpy(), np.zeros(len(pdf), np.int64), 0
        while at < len(ends):
            # The first line whose running sum reaches the sum before this window plus most is the window's last.
            at = max(at, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))) + 1
            windows[at:] += 1
        return pd.DataFrame({"session": key[0], "window": windows, "place": pdf.index, "line": pdf.line, "failed": pdf.failed})

    rows = lines.select("session", "n", F.coalesce("line", F.lit("")).alias("line"), F.coalesce("failed", F.lit(False)).alias("failed"))
    numbered = rows.groupBy("session").applyInPandas(number, f"session {rows.schema['session'].dataType.simpleString()}, window long, place long, line string, failed boolean")
    parts = numbered.groupBy("session", "window").agg(F.bool_or("failed").alias("failed"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    whole = parts.select("session", "window", F.length(F.array_join("x.line", "\n")).cast("long").alias("chars"), "failed", F.array_join("x.line", "\n").alias("text"))
    best = F.row_number().over(W.partitionBy("session").orderBy(F.desc("failed"), F.desc("chars"), "window"))
    return whole.withColumn("best", best).where(F.col("best") <= limit).drop("best")


ARMS = ("no-memory", "naive-cache", "ledger-v1", "ledger-underdecl", "ledger-learn", "ledger-canary", "ledger-tiered")
DERIVE, CHECK, RECALL = 10, 1, 1


class World:
    """A run of tasks in which observed dimensions drift once at a task, noise flips with its period, and hidden ones drift unseen."""

    def __init__(self, tasks: int, drifts: dict[str, int], noise: int, hidden: int | None, lag: int):
        self.tasks, self.drifts, self.noise, self.hidden, self.lag = tasks, drifts, noise, hidden, lag

    def seen(self, task: int) -> dict[str, int]:
        now = {name: int(task >= at) for name, at in self.drifts.items()}
        return now | {"noise": task // self.noise % 2 if self.noise > 0 else 0}

    def truth(self, task: int) -> tuple:
        return (*(int(task >= at) for at in self.drifts.values()), int(self.hidden is not None and task >= self.hidden))

    def undeclared(self) -> set[str]:
        """The dimension that drifts last within the run."""
        late = [(at, name) for name, at in self.drifts.items() if at < self.tasks]
        return {max(late)[1]} if late else set()


def simulate(arm: str, world: World, scope: str, derive: int = DERIVE, check: int = CHECK, recall: int = RECALL) -> dict[str, int]:
    """Turns, reuses, derivations, checks and stale reuses of a policy over a world's tasks.

    A policy looks at what changed since an outcome was derived (its checks have a price) and reuses it or derives anew.
    Policies that learn declare a dimension some tasks after its drift made a reuse wrong, and derive once more then.
    """
    declared = set(world.drifts) - (set() if arm == "ledger-v1" else world.undeclared())
    learns, stored, lessons = arm in ("ledger-learn", "ledger-tiered"), {}, []
    sums = {"turns": 0, "reuses": 0, "derived": 0, "checks": 0, "false_valid": 0}
    for task in range(world.tasks):
        env, truth = world.seen(task), world.truth(task)
        taught = set().union(*(names for at, names in lessons if at <= task)) - declared
        lessons = [x for x in lessons if x[0] > task]
        old = stored.get(env[scope])
        changed = {k for k in env if old and env[k] != old[0][k]}
        if arm == "no-memory" or old is None or taught:
            checks = None
        elif arm == "naive-cache":
            checks = 0
        elif arm == "ledger-canary":
            checks = 1 if not changed and derive > check + recall else None
        elif arm == "ledger-tiered":
            checks = None if changed & declared else 2 if changed else 1
        else:
            checks = len(declared) if not changed & declared and derive > len(declared) * check + recall else None
        declared |= taught
        if checks is None:
            sums["turns"] += derive
            sums["derived"] += 1
            stored[env[scope]] = (env, truth)
            continue
        sums["turns"] += checks * check + recall
        sums["checks"] += checks
        sums["reuses"] += 1
        if old[1] != truth:
            sums["false_valid"] += 1
            missed = (changed & set(world.drifts)) - declared
            if learns and missed:
                lessons.append((task + world.lag, missed))
    return sums


def simulated(scenarios: DataFrame) -> DataFrame:
    """(scenario, arm, turns, reuses, derived, checks, false_valid) for scenarios (scenario, tasks, drift1, drift2, drift3, noise, hidden, lag)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                world = World(int(r.tasks), {"version": int(r.drift1), "workload": int(r.drift2), "volume": int(r.drift3)}, int(r.noise), None if pd.isna(r.hidden) else int(r.hidden), int(r.lag))
                rows += [(r.scenario, arm, *simulate(arm, world, "version").values()) for arm in ARMS]
            yield pd.DataFrame(rows, columns=["scenario", "arm", "turns", "reuses", "derived", "checks", "false_valid"])

    return scenarios.mapInPandas(run, "scenario long, arm string, turns long, reuses long, derived long, checks long, false_valid long")


# Steps that a node may take; from the other states it takes none.
ALLOWED = {"pending": ("active", "blocked", "abandoned"), "active": ("done", "blocked", "failed", "abandoned"), "blocked": ("active", "abandoned")}


def may_follow(old, new):
    """Whether a node's state may become another; to stay is no step."""
    ok = F.lit(False)
    for state, after in ALLOWED.items():
        ok = ok | ((old == state) & new.isin(*after))
    return (old == new) | ok


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes that starts (node) reach over edges (a, b) in at most depth steps, at their least depth; a join and an anti-join a step."""
    seen = starts.select("node", F.lit(0).alias("depth"))
    front = starts.select("node")
    for step in range(1, depth + 1):
        after = edges.join(front.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        front = after.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(step)))
    return seen.where("depth > 0")
