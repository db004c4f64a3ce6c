"""Incident sessions, chat threads, evaluation cases and resolved errors as append-only logs; their states are queries."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from .incidents import CHAIN, FINAL, allowed
from .snapshots import Log, last_wins

#: Event types of an analysis by the state that they lead to; fixed values.
ANALYSIS = {"INGESTING": "analysis_ingesting", "RETRIEVING": "analysis_retrieving", "GRAPH_EXPANDING": "analysis_graph_expanding", "GENERATING_PATCH": "analysis_generating_patch", "VALIDATING": "analysis_ready"}


class InvalidTransition(ValueError):
    pass


def sessions(events: DataFrame) -> DataFrame:
    """A row per session: its state (that of the last event with one), events, created_at and updated_at, newest first."""
    line = F.struct("created_at", "event_id")
    s = events.groupBy("session_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), line)).alias("state"), F.count("*").alias("events"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"))
    return s.orderBy(F.desc("updated_at"), "session_id")


def analysis_events(current: DataFrame) -> DataFrame:
    """(session_id, step, state, event_type): the events by which an analysis takes each of current(session_id, state) from
    where it is to VALIDATING; none for sessions at or beyond it, which can't be analysed."""
    chain = F.array(*map(F.lit, CHAIN[: CHAIN.index("VALIDATING") + 1]))
    kind = F.create_map(*(F.lit(x) for kv in ANALYSIS.items() for x in kv))
    at = F.array_position(chain, F.col("state"))
    ahead = current.where((at > 0) & (at < len(CHAIN) - 1)).select("session_id", F.posexplode(F.slice(chain, (at + 1).cast("int"), F.lit(len(CHAIN)))).alias("step", "state"))
    return ahead.select("session_id", "step", "state", kind[F.col("state")].alias("event_type"))


def resolution_effects(events: DataFrame, analyses: str = "analysis_ready") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ended sessions leave behind: resolved errors and evaluation cases of those that were resolved after an analysis,
    and the counts of created, resolved and failed sessions."""
    line = F.struct("created_at", "event_id")
    last = events.groupBy("session_id").agg(
        F.max_by("payload", F.when(F.col("event_type") == analyses, line)).alias("analysis"), F.max_by("payload", F.when(F.col("state") == "CREATED", line)).alias("request"),
        F.max("created_at").alias("created_at"), F.max_by("state", F.when(F.col("state").isNotNull(), line)).alias("state"),
    )
    field = lambda c, name: F.get_json_object(c, f"$.{name}")
    done = last.where((F.col("state") == "RESOLVED") & F.col("analysis").isNotNull())
    resolved = done.select(field("request", "fingerprint").alias("fingerprint"), field("analysis", "root_cause").alias("root_cause"), field("analysis", "patch").alias("patch"), "created_at")
    cases = done.select(
        F.concat(F.lit("case-"), "session_id").alias("case_id"), field("request", "fingerprint").alias("fingerprint"), field("analysis", "root_cause").alias("expected_root_cause"), field("analysis", "patch").alias("expected_patch"),
        field("request", "environment").alias("environment"), F.array(F.lit("auto-generated"), "state").alias("tags"), "created_at",
    )
    return resolved, cases, last.agg(F.count("*").alias("created"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"), F.count_if(F.col("state") == "FAILED").alias("failed"))


class Incidents:
    """Sessions over a log of events. Writers of one session must be serial, as a stream keyed by session is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Log(spark, folder, schemas.INCIDENTS)

    def _append(self, session_id: str, event_type: str, state: str | None, payload: dict) -> str:
        row = (session_id, uuid.uuid4().hex, event_type, state, json.dumps(payload), datetime.now(timezone.utc))
        self.log.append(self.spark.createDataFrame([row], schemas.INCIDENTS))
        return row[1]

    def create(self, request: dict) -> str:
        if not str(request.get("raw_log", "-")).strip():
            raise ValueError("raw_log is blank")
        session_id = uuid.uuid4().hex
        self._append(session_id, "incident_created", "CREATED", request)
        return session_id

    def list(self) -> DataFrame:
        return sessions(self.log.read())

    def events(self, session_id: str) -> DataFrame:
        return self.log.read().where(F.col("session_id") == session_id).orderBy("created_at", "event_id")

    def get(self, session_id: str):
        row = sessions(self.events(session_id)).first()
        if row is None:
            raise LookupError(f"unknown session: {session_id}")
        return row

    def transition(self, session_id: str, state: str, event_type: str = "state_changed", payload: dict | None = None) -> None:
        now = self.get(session_id).state
        if not allowed(now, state):
            raise InvalidTransition(f"{now} -> {state}")
        self._append(session_id, event_type, state, payload or {})

    def note(self, session_id: str, event_type: str, payload: dict) -> None:
        """An event that changes no state: chat_message, tool_call, analysis_complete, user_action."""
        self.get(session_id)
        self._append(session_id, event_type, None, payload)

    def analyse(self, session_id: str, analysis: dict) -> None:
        """Takes the session to VALIDATING, an event a step; the last has the analysis as its payload."""
        steps = analysis_events(self.spark.createDataFrame([(session_id, self.get(session_id).state)], "session_id string, state string")).orderBy("step").collect()
        if not steps:
            raise InvalidTransition("the session can't be analysed any more")
        for r in steps:
            if r.state == "VALIDATING":
                self.note(session_id, "analysis_complete", analysis)
            self.transition(session_id, r.state, r.event_type, analysis if r.state == "VALIDATING" else {"actor": "backend"})


def eval_cases(cases: DataFrame, environment: str | None = None) -> DataFrame:
    """The last version of each case, of one environment if given, newest first."""
    rest = last_wins(cases, ["case_id"], ["created_at"])
    return (rest if environment is None else rest.where(F.col("environment") == environment)).orderBy(F.desc("created_at"), "case_id")


def threads(log: DataFrame) -> DataFrame:
    """Threads that aren't deleted: thread_id, title (the last), messages, updated_at, newest first. A thread's log has the
    operations create, rename, message and delete."""
    t = log.groupBy("thread_id").agg(
        F.max_by("title", F.when(F.col("op").isin("create", "rename"), F.col("created_at"))).alias("title"), F.count_if(F.col("op") == "message").alias("messages"),
        F.max("created_at").alias("updated_at"), F.bool_or(F.col("op") == "delete").alias("gone"),
    )
    return t.where("not gone").drop("gone").orderBy(F.desc("updated_at"), "thread_id")


def messages(log: DataFrame, thread_id: str) -> DataFrame:
    """A thread's messages, oldest first, their citations as a list; none of a deleted thread."""
    own = log.where(F.col("thread_id") == thread_id)
    gone = own.where("op = 'delete'").select("thread_id").distinct()
    cited = F.coalesce(F.from_json("citations", "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    return own.where("op = 'message'").join(gone, "thread_id", "left_anti").select("message_id", "role", "content", cited.alias("citations"), "created_at").orderBy("created_at", "message_id")


def history(messages: DataFrame, current: DataFrame, k: int = 20) -> DataFrame:
    """The last k messages of each conversation, without the user's that equal current(conv_id, text)."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    tail = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= k)
    same = current.select("conv_id", F.col("text").alias("now"))
    return tail.join(same, "conv_id", "left").where(~((F.col("role") == "user") & F.col("text").eqNullSafe(F.col("now")))).drop("now", "back")


def buffered(samples: DataFrame, key: str, order: list[str], full: int = 1000, kept: int = 500) -> DataFrame:
    """What a buffer that is cut to its last `kept` samples as soon as it holds over `full` has at the end, per key.

    The n-th sample of a key overfills it at n = full + 1 and every full + 1 - kept later, so how many are held follows
    from the key's count alone, and the rank from the end tells which.
    """
    n = samples.groupBy(key).agg(F.count("*").alias("n_"))
    cycle = full + 1 - kept
    held = F.when(F.col("n_") <= full, F.col("n_")).otherwise(kept + (F.col("n_") - full - 1) % cycle)
    back = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return samples.withColumn("back_", back).where(F.col("back_") <= full).join(n, key).where(F.col("back_") <= held).drop("back_", "n_")


def health(checks: DataFrame) -> DataFrame:
    """checks(backend, status) -> status (degraded if any is unhealthy), ready (all that aren't disabled are healthy)."""
    return checks.agg(F.when(F.coalesce(F.bool_or(F.col("status") == "unhealthy"), F.lit(False)), "degraded").otherwise("healthy").alias("status"), F.coalesce(F.bool_and((F.col("status") == "disabled") | (F.col("status") == "healthy")), F.lit(True)).alias("ready"))


def hit_rate(events: DataFrame, hit: str, miss: str, kind: str = "event_type") -> DataFrame:
    n = events.agg(F.count_if(F.col(kind) == hit).alias("hits"), F.count_if(F.col(kind) == miss).alias("misses"))
    return n.withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0), 4))


def ended(state: str) -> bool:
    return state in FINAL
