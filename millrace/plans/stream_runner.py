"""Declared pipelines over a stream: micro-batches, each a batch of the load journal.

A micro-batch is written once, split (broken messages, late rows, the rest), transformed, checked, and
its loads are committed under the name of the stream and the batch. Spark tries a batch again when the driver
died in it; a batch whose commit is there is only published, one that is closed is left alone. So each
row is loaded once, however often and wherever a run dies.

Sessions keep their open slots (``streaming.session_state``) in a folder for each batch; the folder of the
batch before is the state, and counts only because that batch was committed.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.control import runs
from millrace.operators import quality
from millrace.plans import runner
from millrace.plans.runner import Destination, Lookups, Step
from millrace.session import materialize, staging
from millrace.sinks import journal, tables
from millrace.sources.files import CORRUPT
from millrace.streaming.session_state import Sessions
from millrace.streaming.sinks import finish

# Steps that see one row at a time, or look it up: only these mean the same over micro-batches.
ROW_STEPS = frozenset(
    """select_columns drop_columns rename_columns derive_domain derive_column calculate_revenue convert_temperature
    conditional_column bucket_column clean_strings parse_dates cast_types cast fill_nulls static_columns filter_rows
    filter filter_bots exclude_value filter_event_types drop_incomplete enrich enrich_user_profile parse_image
    parse_dynamodb parse_font_identifier enrich_gcid enrich_profile enrich_style enrich_font_universe split_routing""".split()
)
MARK_SCHEMA = (
    "batch_id LONG, rows_read LONG, corrupt_rows LONG, late_rows LONG, untimed_rows LONG, on_time_rows LONG, "
    "loaded_rows LONG, open_rows LONG, watermark_micros LONG"
)


@dataclass(frozen=True)
class StreamOptions:
    """``timestamp`` and ``delay_minutes`` make the watermark; rows before it go to the table ``late_rows``
    or, without one, are only counted. ``trigger`` is Spark's; the default reads what there is and ends."""

    timestamp: str | None = None
    delay_minutes: float = 10
    late_rows: str | None = None
    trigger: Mapping[str, Any] = field(default_factory=lambda: {"availableNow": True})

    @staticmethod
    def declared(spark: SparkSession, pipeline: Mapping[str, Any], schema: T.StructType) -> StreamOptions:
        """From ``extract.watermark`` (column, delay_minutes), ``extract.trigger`` and ``load.late_rows`` (table, path:
        created if absent). A pipeline with sessions has the watermark of their time."""
        extract, mark = pipeline["extract"], pipeline["extract"].get("watermark", {})
        transform = pipeline.get("transform") or []
        steps = transform["steps"] if isinstance(transform, Mapping) else transform
        ordered = [p["order_by"] for _, p in _pairs(steps) if _ == "sessionize"]
        late = pipeline["load"].get("late_rows") or {}
        if late.get("path"):
            rows = T.StructType([f for f in schema if f.name != CORRUPT])
            tables.create_table(spark, late["table"], rows, late["path"])
        return StreamOptions(
            mark.get("column") or next(iter(ordered), None), mark.get("delay_minutes", 10), late.get("table"),
            extract.get("trigger") or {"availableNow": True},
        )


def _pairs(steps: Sequence[Step]) -> list[tuple[str, Any]]:
    out = []
    for item in steps:
        if isinstance(item, str):
            name, _, params = item.partition(":")
            out.append((name.strip(), params.strip().strip('"')))
        else:
            out += [(k, v) for k, v in item.items() if k != "description"]
    return out


@dataclass(frozen=True)
class Plan:
    """The steps of a stream: on rows, the sessions if there are any, and on what they give."""

    before: list[Step]
    sessions: Sessions | None
    after: list[Step]


def plan_steps(steps: Sequence[Step]) -> Plan:
    """Cut the steps at ``sessionize``. Lookups by the session's user between it and ``aggregate_sessions`` come
    after the roll-up: they have one value for each user, so the rows are the same. Steps that
    would need rows of several micro-batches are refused."""
    pairs = _pairs(steps)
    names = [n for n, _ in pairs]
    known = ROW_STEPS | set(runner.own_steps())
    cut = [k for k, n in enumerate(names) if n in ("sessionize", "aggregate_sessions")]
    refused = [n for k, n in enumerate(names) if n not in known and k not in cut]
    if refused:
        raise ValueError(f"steps that a stream cannot take: {', '.join(refused)}")
    if not cut:
        return Plan(list(steps), None, [])
    if [names[k] for k in cut] != ["sessionize", "aggregate_sessions"]:
        raise ValueError("a stream takes one sessionize and, after it, one aggregate_sessions")
    made, rolled = pairs[cut[0]][1], pairs[cut[1]][1]
    user, session = made["partition_by"], made.get("output_column", "session_id")
    if list(rolled["group_by"]) != [user, session]:
        raise ValueError(f"sessions are grouped by {user} and {session}")
    between, moved = pairs[cut[0] + 1 : cut[1]], set()
    for name, p in between:
        on = p.get("on") or {p.get("join_key"): None} if isinstance(p, Mapping) else {}
        if name not in ("enrich", "enrich_user_profile") or set(on) != {user} or p.get("on_miss", "keep") != "keep":
            raise ValueError(f"{name} cannot stand between sessionize and aggregate_sessions in a stream")
        moved |= set(p.get("take") or p["fields"])
    sessions = Sessions(
        user, made["order_by"], rolled["metrics"], made.get("inactivity_gap_minutes", 30), session,
        tuple(c for c in rolled.get("keep_first", ()) if c not in moved), tuple(rolled.get("order_by", ())),
    )
    sessions.parsed()
    kept = [{n: p} for n, p in between]
    wanted = moved - set(rolled.get("keep_first", ()))
    if wanted:
        kept.append({"drop_columns": {"columns": sorted(wanted)}})
    return Plan([{n: p} for n, p in pairs[: cut[0]]], sessions, [*kept, *({n: p} for n, p in pairs[cut[1] + 1 :])])


class MicroBatches:
    """Handles the micro-batches of one run. ``folder`` keeps the checkpoint, the state and a mark (counts and
    watermark) of each batch."""

    def __init__(
        self, name: str, plan: Plan, checks: Sequence[Mapping[str, Any]], destinations: Sequence[Destination],
        control_path: str, lookups: Lookups, options: StreamOptions, load_date: date, started: datetime,
    ):
        self.name, self.plan, self.destinations, self.lookups = name, plan, destinations, lookups
        self.options, self.load_date, self.started = options, load_date, started
        self.rules = runner.skip_rules(checks)
        # An empty micro-batch is no error; ``run_stream`` checks the count of the run.
        self.checks = [c for c in runner.build_checks(checks) if c.kind != "count"]
        self.folder, self.journal, self.rejects = f"{control_path}.stream/{name}", f"{control_path}.journal", f"{control_path}.rejects"
        self.marks: list[Any] = []

    @property
    def checkpoint(self) -> str:
        return f"{self.folder}/checkpoint"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A new checkpoint has a new id, so its batches are others although they have the same numbers.
        query = json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]
        label = f"{query}-{batch_id}"
        journal.finish_open(spark, self.journal)
        if not journal.closed(spark, self.journal, label):
            with staging(spark):
                changes = self._prepare(spark, batch, query, batch_id)
                journal.commit(spark, self.journal, changes, label)
                journal.complete(spark, self.journal, label)
        self.marks.append(spark.read.schema(MARK_SCHEMA).parquet(self._place("mark", query, batch_id)).first())
        for kind in ("state", "mark"):
            journal.delete(spark, self._place(kind, query, batch_id - 2))

    def _place(self, kind: str, query: str, batch_id: int) -> str:
        return f"{self.folder}/{kind}/{query}/{batch_id}"

    def _prepare(self, spark: SparkSession, batch: DataFrame, query: str, batch_id: int) -> list[tables.Change]:
        before = None
        if batch_id > 0:
            before = spark.read.schema(MARK_SCHEMA).parquet(self._place("mark", query, batch_id - 1)).first()
        watermark = before.watermark_micros if before else None
        rows = materialize(batch, "micro-batch")
        time, corrupt = self.options.timestamp, CORRUPT in rows.columns
        bad = F.col(CORRUPT).isNotNull() if corrupt else F.lit(False)
        late = F.lit(False)
        if time and watermark is not None:
            late = F.coalesce(F.unix_micros(F.col(time)) < F.lit(watermark), F.lit(False))
        untimed = F.col(time).isNull() if time else F.lit(False)
        counts = rows.agg(
            F.count("*").alias("read"), F.count_if(bad).alias("bad"), F.count_if(~bad & late).alias("late"),
            F.count_if(~bad & untimed).alias("untimed"), (F.unix_micros(F.max(time)) if time else F.lit(None)).alias("latest"),
        ).first()
        good = rows.where(~bad & ~late)
        good = good.drop(CORRUPT) if corrupt else good
        changes = []
        if counts["bad"]:
            lost = rows.where(bad).select(F.lit(self.name).alias("job_name"), F.col(CORRUPT).alias("record"), F.lit(self.started).alias("rejected_on"))
            changes.append(tables.prepare_files(lost, self.rejects))
        if counts["late"] and self.options.late_rows:
            changes.append(tables.prepare_append(rows.where(~bad & late), self.options.late_rows))
        if time and counts["latest"] is not None:
            moved = counts["latest"] - int(self.options.delay_minutes * 60_000_000)
            watermark = moved if watermark is None else max(watermark, moved)
        out, open_rows = runner.apply_steps(good, self.plan.before, self.lookups), 0
        if self.plan.sessions:
            state = self._place("state", query, batch_id)
            earlier = self._place("state", query, batch_id - 1) if before else None
            out, open_rows = self._sessions(spark, out, earlier, state, F.lit(watermark).cast("long"))
        out = runner.apply_steps(out, self.plan.after, self.lookups)
        out = runner.passing(out, self.rules)
        out = materialize(runner.stamped(out, self.destinations, self.load_date, self.started), "run")
        if self.checks:
            quality.enforce(out, self.checks)
        loaded = out.count()
        if loaded:
            changes += [runner.prepare_load(out, d) for d in self.destinations]
        on_time = counts["read"] - counts["bad"] - counts["late"]
        mark = (batch_id, counts["read"], counts["bad"], counts["late"], counts["untimed"], on_time, loaded, open_rows, watermark)
        spark.createDataFrame([mark], MARK_SCHEMA).coalesce(1).write.mode("overwrite").parquet(self._place("mark", query, batch_id))
        return changes

    def _sessions(
        self, spark: SparkSession, rows: DataFrame, earlier: str | None, state: str, watermark: Column
    ) -> tuple[DataFrame, int]:
        """The sessions that close, and the number of rows that stay in the state."""
        sessions = self.plan.sessions
        new = sessions.reduce(rows)
        if earlier:
            new = sessions.merge(spark.read.schema(new.schema).parquet(earlier), new)
        merged = materialize(new, "slots")
        placed = materialize(sessions.placed(merged, watermark), "placed")
        still = placed.where("NOT __closed").drop("__begin", "__closed")
        still.write.mode("overwrite").parquet(state)
        return sessions.rolled_up(placed.where("__closed")), spark.read.schema(still.schema).parquet(state).count()


def run_stream(
    name: str,
    source: DataFrame,
    steps: Sequence[Step],
    checks: Sequence[Mapping[str, Any]],
    destinations: Sequence[Destination],
    control_path: str,
    lookups: Lookups | None = None,
    load_date: date | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    options: StreamOptions = StreamOptions(),
    **names: str,
) -> DataFrame:
    """Run a pipeline over what a stream has to give, and record the run.

    The record counts rows read and rows loaded; with a late-rows table a second record counts
    the rows that went there. A batch that was committed when an earlier run died counts in
    the run that closes it. Sessions are named by their start and loaded when the watermark has passed
    them; open ones wait in the state for the next run. Destinations are catalog tables: a database
    can't take part in a batch.
    """
    if any(d.connection is not None for d in destinations):
        raise ValueError("a stream loads catalog tables: a database takes no part in a journal batch")
    spark = source.sparkSession
    started = clock()
    handler = MicroBatches(
        name, plan_steps(steps), checks, destinations, control_path, lookups or {}, options, load_date or started.date(), started
    )
    status = runs.FAILED
    try:
        journal.finish_open(spark, handler.journal)
        writer = source.writeStream.foreachBatch(handler).option("checkpointLocation", handler.checkpoint)
        finish(writer.trigger(**options.trigger).start())
        read = sum(m.rows_read for m in handler.marks)
        least = [c.minimum for c in runner.build_checks(checks) if c.kind == "count"]
        if handler.marks and any(read <= m for m in least):
            raise quality.QualityError(f"quality checks failed: row_count_gt(*): {read} rows were read")
        status = runs.SUCCESS
    finally:
        ended = clock()
        total = {c: sum(m[c] for m in handler.marks) for c in ("rows_read", "late_rows", "loaded_rows")}
        common = dict(started=started, ended=ended, load_date=load_date or started.date(), load_status=status)
        record = runs.control_record(
            spark, job_name=name, source_count=total["rows_read"], target_count=total["loaded_rows"], **common, **names
        )
        runs.append_record(record, control_path)
        if options.late_rows:
            own = {**names, "target_table": options.late_rows}
            late = runs.control_record(
                spark, job_name=f"{name}.late_rows", source_count=total["rows_read"], target_count=total["late_rows"], **common, **own
            )
            runs.append_record(late, control_path)
        elif total["late_rows"]:
            logging.getLogger(__name__).warning("%d late rows were dropped", total["late_rows"])
    return record
