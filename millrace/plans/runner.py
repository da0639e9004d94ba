"""A pipeline as data: an ordered list of steps folded over a DataFrame.

Steps are mappings such as ``{"drop_columns": {"columns": ["a"]}}``; expressions and
conditions are Spark SQL. The fold only builds one logical plan, which Catalyst optimizes
as a whole.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.control import runs
from millrace.operators import aggregates, columns, enrich, filters, quality, routing, windows
from millrace.session import counted, materialize
from millrace.sinks import jdbc, journal, tables
from millrace.sources.extract import open_source
from millrace.sources.files import CORRUPT
from millrace.sources.jdbc import JDBC_KINDS
from millrace.sources.lookups import lookup, snapshot

Step = Mapping[str, Any] | str
Lookups = Mapping[str, DataFrame]
StepFunction = Callable[[DataFrame, Any, Lookups], DataFrame]

_steps: dict[str, StepFunction] = {}
_own: set[str] = set()


def register_step(name: str, function: Callable[[DataFrame, Any], DataFrame]) -> None:
    """Add a step of your own: ``function(df, params) -> DataFrame``. In a stream it sees each micro-batch."""
    _steps[name] = lambda df, params, _lookups: function(df, params)
    _own.add(name)


def own_steps() -> frozenset[str]:
    """The names given to ``register_step``."""
    return frozenset(_own)


def step(*names: str):
    def add(function: StepFunction) -> StepFunction:
        for name in names:
            _steps[name] = function
        return function

    return add


def apply_steps(df: DataFrame, steps: Sequence[Step], lookups: Lookups | None = None) -> DataFrame:
    """Fold ``steps`` over ``df``. An unknown step is an error, never skipped."""
    for item in steps:
        if isinstance(item, str):
            name, _, params = item.partition(":")
            pairs = [(name.strip(), params.strip().strip('"'))]
        else:
            pairs = [(k, v) for k, v in item.items() if k != "description"]
        for name, params in pairs:
            if name not in _steps:
                raise ValueError(f"unknown step {name!r}")
            df = _steps[name](df, params, lookups or {})
    return df


@step("select_columns")
def _select(df, p, _):
    return columns.select_columns(df, p["columns"])


@step("drop_columns")
def _drop(df, p, _):
    return columns.drop_columns(df, p["columns"])


@step("rename_columns")
def _rename(df, p, _):
    return columns.rename_columns(df, p["mappings"])


@step("derive_domain")
def _domain(df, p, _):
    return columns.derive_domain(df, p["source_field"], p["target_field"], p.get("default"))


@step("derive_column")
def _derive(df, p, _):
    return columns.derive_column(df, p["target_field"], p["expression"])


@step("calculate_revenue", "convert_temperature")
def _formula(df, p, _):
    return columns.derive_column(df, p["output_column"], p["formula"])


@step("conditional_column")
def _conditional(df, p, _):
    cases = [(c["when"], c["then"]) for c in p["conditions"] if "when" in c]
    default = next((c["default"] for c in p["conditions"] if "default" in c), None)
    return columns.conditional_column(df, p["target_field"], cases, default)


@step("bucket_column")
def _bucket(df, p, _):
    buckets = [(*b["range"], b["label"]) for b in p["buckets"]]
    return columns.bucket_column(df, p["target_field"], p["source_field"], buckets)


@step("clean_strings")
def _clean(df, p, _):
    return columns.clean_strings(df, p["columns"], p.get("operations", ("strip", "lowercase")))


@step("parse_dates")
def _dates(df, p, _):
    return columns.parse_dates(df, p["columns"])


@step("cast_types")
def _cast(df, p, _):
    return columns.cast_types(df, p["mappings"], p.get("errors", "raise"))


@step("cast")
def _cast_template(df, p, _):
    return columns.cast_template(df, p)


@step("fill_nulls")
def _fill(df, p, _):
    return columns.fill_nulls(df, p["mappings"])


@step("static_columns")
def _static(df, p, _):
    return columns.static_columns(df, p)


@step("deduplicate")
def _deduplicate(df, p, _):
    subset = p.get("subset") or p.get("columns") or p["key"]
    subset = [subset] if isinstance(subset, str) else subset
    order = p.get("sort_by", [])
    if "keep" not in p and not order:
        return windows.deduplicate_any(df, subset)
    return windows.deduplicate(df, subset, order, p.get("keep", "first"), p.get("tiebreak"))


# ``column != literal`` as a whole condition.
_DIFFERS = re.compile(r"""\s*(\w+)\s*(?:!=|<>)\s*('[^']*'|"[^"]*"|-?\d+(?:\.\d+)?)\s*""")


@step("filter_rows", "filter", "filter_bots")
def _filter(df, p, _):
    """A condition that a column differs from a value keeps NULL, which differs too."""
    text = p if isinstance(p, str) else p["condition"]
    differs = _DIFFERS.fullmatch(text) if isinstance(text, str) else None
    if differs:
        return df.where(~F.col(differs[1]).eqNullSafe(F.expr(differs[2])))
    return filters.filter_rows(df, text)


@step("exclude_value")
def _exclude(df, p, _):
    return filters.exclude_value(df, p["column"], p["value"])


@step("filter_event_types")
def _event_types(df, p, _):
    return filters.keep_values(df, p.get("column", "event_type"), p["allowed"])


@step("drop_incomplete")
def _incomplete(df, p, _):
    if "condition" in p:
        return filters.filter_rows(df, p["condition"])
    return filters.drop_incomplete(df, p["columns"])


@step("sort_rows")
def _sort(df, p, _):
    return windows.sort_rows(df, p["by"], p.get("ascending", True), p.get("tiebreak", ()))


@step("sessionize")
def _sessionize(df, p, _):
    return windows.sessionize(
        df,
        p["partition_by"],
        p["order_by"],
        p.get("inactivity_gap_minutes", 30),
        p.get("output_column", "session_id"),
    )


@step("aggregate_daily", "aggregate_sessions", "aggregate")
def _aggregate(df, p, _):
    return aggregates.aggregate(
        df, p["group_by"], p["metrics"], p.get("keep_first", ()), p.get("order_by", ())
    )


@step("enrich", "enrich_user_profile")
def _enrich(df, p, lookups):
    """``unique: true`` says the lookup has one row per key; else it is reduced and written."""
    on = p.get("on") or {p["join_key"]: p["join_key"]}
    take = p.get("take") or {f: f for f in p["fields"]}
    table = lookups[p["lookup_table"]]
    if not p.get("unique"):
        table = snapshot(lookup(table, list(on.values()), list(dict.fromkeys(take.values()))))
    return enrich.enrich(df, table, on, take, p.get("on_miss", "keep"))


@step("split_routing")
def _route(df, p, _):
    return routing.split_routing(
        df, p["condition"], p["when_true"]["route"], p["when_false"]["route"]
    )


@step("parse_image")
def _image(df, p, _):
    return columns.parse_image(df, (p or {}).get("record_path", "dynamodb.NewImage"))


@step("parse_dynamodb")
def _event_image(df, p, _):
    """Records to one row per font entry; ``font_entry`` holds the packed identifier."""
    parsed = columns.parse_image(df, p.get("record_path", "dynamodb.NewImage").removeprefix("$."))
    return columns.event_dates(columns.explode_fonts(parsed))


@step("parse_font_identifier")
def _identifier(df, p, _):
    """Positions are numbers, or text such as ``index 5``."""
    fields = {k: int(str(v).split()[-1]) for k, v in p["output_fields"].items()}
    parsed = columns.parse_packed(df, p.get("source_field", "font_entry"), p["delimiter"], fields)
    ids = {c: "bigint" for c in ("fontsense_id",) if c in fields}
    return columns.cast_types(parsed, ids, errors="coerce") if ids else parsed


@step("enrich_gcid", "enrich_profile", "enrich_style")
def _enrich_entry(df, p, lookups):
    """A lookup by one or several fields, or by one field under either of two keys.

    ``on_miss``: skip_record and skip_font_entry drop the row, anything else keeps it. ``unless``
    is a condition under which a miss is kept.
    """
    table = lookups[p["lookup"]]
    sources = p.get("source_fields") or [p["source_field"].split(".")[-1]]
    targets = p.get("target_fields") or [p["target_field"]]
    keys = p.get("keys") or [c for c in table.columns if c not in targets][: len(sources)]
    returns = p.get("returns") or [c for c in table.columns if c not in keys or c in targets]
    take = dict(zip(targets, returns))
    found = "__found"
    if p.get("either_key"):
        out = enrich.enrich_either_key(df, table, sources[0], p["either_key"], take, "keep", found)
    else:
        one = snapshot(lookup(table, keys, list(dict.fromkeys(take.values()))))
        out = enrich.enrich(df, one, dict(zip(sources, keys)), take, "keep", found)
    if str(p.get("on_miss", "keep")).startswith("skip"):
        kept = F.col(found)
        if p.get("unless"):
            kept = kept | F.coalesce(F.expr(p["unless"]), F.lit(False))
        out = out.where(kept)
    return out.drop(found)


@step("enrich_font_universe")
def _enrich_fonts(df, p, lookups):
    """The first of ``source_fields`` that the lookup knows under a key of the same name."""
    table, target = lookups[p["lookup"]], p["target_field"]
    value = p.get("return_column", target)
    tries = [(c, snapshot(lookup(table, [c], [value])), c) for c in p["source_fields"]]
    return enrich.enrich_fallback_key(df, tries, {target: value}, "keep")


# Steps that end a branch: each gives an output of its own to destinations that name it in ``from``.
_branches: dict[str, StepFunction] = {}


def branch(name: str):
    def add(function: StepFunction) -> StepFunction:
        _branches[name] = function
        return function

    return add


def _branch_input(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    return df.where(F.expr(p["where"])) if p.get("where") else df


@branch("aggregate_sync_download")
def _downloads(df, p, _):
    rows = aggregates.count_rows(_branch_input(df, p), p["group_by"], *p["metrics"])
    return columns.static_columns(rows, p.get("static_columns", {}))


@branch("aggregate_asset")
def _assets(df, p, _):
    order = p.get("order_by", ["event_id"])
    return aggregates.first_rows(_branch_input(df, p), p["deduplicate_by"], order, p["columns"])


@branch("aggregate_project")
def _projects(df, p, _):
    order = p.get("order_by", ["created_at", "event_id"])
    least = [c for c, how in p["agg"].items() if how == "min"]
    return aggregates.collapse(_branch_input(df, p), p["deduplicate_by"], order, least, p["keep_first"])


@branch("aggregate_font_universe_usage")
def _usage(df, p, _):
    """Counts per month, in the shape that the monthly merge takes."""
    rows = _branch_input(df, p)
    if not (p.get("monthly_merge") or {}).get("enabled"):
        return aggregates.count_rows(rows, p["group_by"], *p["metrics"])
    kept = [c for c in p["monthly_merge"]["group_by"] if c in rows.columns]
    return rows.groupBy(*kept).agg(
        F.min("event_date").alias("first_usage"), F.max("event_date").alias("last_usage"),
        F.count(F.lit(1)).cast("bigint").alias("usage_count"),
        *[F.first(c, ignorenulls=True).alias(c) for c in p.get("constants", ())],
    )


def apply_outputs(
    df: DataFrame,
    steps: Sequence[Step],
    lookups: Lookups | None = None,
    rules: Sequence[tuple[str, str, Any]] = (),
) -> dict[str, DataFrame]:
    """Fold the steps; branch steps become outputs by their name, the folded frame is ``""``.

    ``rules`` (see ``skip_rules``) drop rows of the folded frame, or of the usage branch only.
    What the branches share is written once.
    """
    ends = [(n, p) for s in steps if not isinstance(s, str) for n, p in s.items() if n in _branches]
    folded = [s for s in steps if isinstance(s, str) or not set(s) & set(_branches)]
    base = _passing(apply_steps(df, folded, lookups), rules, "skip_record")
    if not ends:
        return {"": base}
    base = materialize(base, "branches")
    usage = _passing(base, rules, "skip_fu_record")
    return {"": base} | {
        name: _branches[name](usage if name == USAGE_BRANCH else base, p, lookups or {}) for name, p in ends
    }


def _passing(df: DataFrame, rules: Sequence[tuple[str, str, Any]], scope: str) -> DataFrame:
    own = [(reason, good) for where, reason, good in rules if where == scope]
    return quality.valid_rows(quality.mark_rejects(df, own)) if own else df


def passing(df: DataFrame, rules: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """The rows that meet the rules of ``skip_rules`` for whole records."""
    return _passing(df, rules, "skip_record")


USAGE_BRANCH = "aggregate_font_universe_usage"


def skip_rules(specs: Sequence[Mapping[str, Any]]) -> list[tuple[str, str, Any]]:
    """(``on_fail``, reason, condition that a good row meets) of the checks that skip records."""
    rules: list[tuple[str, str, Any]] = []
    for spec in specs:
        for name, p in spec.items():
            if not isinstance(p, Mapping) or not str(p.get("on_fail", "")).startswith("skip"):
                continue
            scope = p["on_fail"]
            if name == "event_type_in":
                rules.append((scope, name, F.col(p.get("column", "event_type")).isin(list(p["allowed"]))))
            elif name == "font_list_not_empty":
                rules.append((scope, name, F.col(p.get("column", "font_entry")).isNotNull()))
            elif name in ("required_fields_not_null", "lookup_resolved", "font_universe_fields_valid"):
                rules.append((scope, name, quality.complete(p.get("fields") or p["required"])))
            else:
                raise ValueError(f"check {name!r} cannot skip records")
    return rules


def open_lookups(spark: SparkSession, specs: Sequence[Mapping[str, Any]]) -> dict[str, DataFrame]:
    """The declared lookup tables as ``name.table``, with their key and return columns.

    ``engine: table`` (or none) takes a table of the catalog, other engines are databases.
    """
    found = {}
    for spec in specs:
        for table in spec["tables"]:
            engine = spec.get("engine", "table")
            df = open_source(spark, {**spec, **table, "source": engine})
            named = [table.get(k) for k in ("key_column", "return_column")]
            wanted = [*table.get("key_columns", []), *table.get("return_columns", []), *filter(None, named)]
            found[f"{spec['name']}.{table['table']}"] = df.select(*dict.fromkeys(wanted)) if wanted else df
    return found


def check_record(record: DataFrame, specs: Sequence[Mapping[str, Any]]) -> None:
    """The ``post_load`` checks: a bad status raises, rows that didn't arrive are a warning."""
    for spec in specs:
        for name in spec:
            if name == "control_record_status":
                if runs.status_check(record, spec[name]["expected"]).where("NOT passed").count():
                    runs.require_status(record)
                    raise quality.QualityError(f"run status is none of {spec[name]['expected']}")
            elif name == "source_vs_target_count":
                if runs.count_check(record).where("NOT passed").count():
                    logging.getLogger(__name__).warning("rows were read but none was loaded")
            elif name != "description":
                raise ValueError(f"unknown check {name!r}")


def build_checks(specs: Sequence[Mapping[str, Any]]) -> list[quality.Check]:
    """Checks from their declared form."""
    checks: list[quality.Check] = []
    for spec in specs:
        for name, p in spec.items():
            if isinstance(p, Mapping) and str(p.get("on_fail", "")).startswith("skip"):
                continue  # see skip_rules
            if name == "row_count_gt":
                checks += quality.row_count_gt(p)
            elif name == "required_fields_not_null":
                checks += quality.required_fields(p["fields"] if isinstance(p, Mapping) else p)
            elif name == "column_not_null":
                checks += quality.not_null(p)
            elif name == "unique_check":
                checks += quality.unique(p["columns"], bool(p.get("wide")))
            elif name == "value_range":
                checks += quality.value_range(p["column"], p["min"], p["max"])
            elif name == "allowed_values":
                checks += quality.allowed_values(p["column"], p["values"])
            elif name != "description":
                raise ValueError(f"unknown check {name!r}")
    if not any(c.kind == "count" for c in checks):
        checks = [*quality.row_count_gt(0), *checks]
    return checks


@dataclass(frozen=True)
class Destination:
    """Where a pipeline loads to: a catalog table or (with ``connection``) a database table,
    a mode, and an optional projection (target column -> expression)."""

    table: str
    mode: str = "append"
    key: tuple[str, ...] = ()
    columns: Mapping[str, str] | None = None
    group_by: tuple[str, ...] = ()
    connection: Mapping[str, Any] | None = None
    output: str = ""


def destination(spark: SparkSession, spec: Mapping[str, Any]) -> Destination:
    """A destination from its declared form. With ``path``, the table is created if absent
    from ``target_ddl``, a Spark column list; ``key_buckets`` lays it out by a hash of the key."""
    columns = spec.get("columns")
    key = tuple(spec.get("upsert_key") or spec.get("key") or ())
    if isinstance(columns, (list, tuple)):
        columns = {c: f"`{c}`" for c in columns}
    if spec.get("path"):
        buckets = tables.KeyBuckets(key, int(spec["key_buckets"])) if spec.get("key_buckets") else None
        tables.create_table(
            spark, spec["table"], spec["target_ddl"], spec["path"], spec.get("partition_by", ()), buckets
        )
    return Destination(
        spec["table"],
        spec.get("mode", "append"),
        key,
        columns,
        tuple(spec.get("group_by", ())),
        spec if spec.get("engine") in JDBC_KINDS else None,
        spec.get("from", ""),
    )


# Columns of a target that the run itself fills, fixed values.
STAMPS = ("load_date", "load_timestamp", "last_modified")


def stamped(df: DataFrame, destinations: Sequence[Destination], load_date: date, started: datetime) -> DataFrame:
    """With the load stamps that a destination has and the frame lacks."""
    wanted: set[str] = set()
    for d in destinations:
        wanted |= set(d.columns or (() if d.connection else df.sparkSession.table(d.table).columns))
    values = dict.fromkeys(STAMPS, F.lit(started)) | {"load_date": F.lit(load_date)}
    return df.withColumns({c: values[c] for c in STAMPS if c in wanted and c not in df.columns})


def project(df: DataFrame, projection: Mapping[str, str]) -> DataFrame:
    """Columns and renames of a destination."""
    return df.select(*[F.expr(source).alias(target) for target, source in projection.items()])


def prepare_load(df: DataFrame, destination: Destination, staged: bool = False) -> tables.Change:
    """Write ``df`` in the destination's mode, to be published. ``staged`` says that ``df`` is a
    written frame with one row per key, which keyed modes then need not write again."""
    out = project(df, destination.columns) if destination.columns else df
    table, key = destination.table, destination.key
    if destination.mode == "append":
        return tables.prepare_append(out, table)
    if destination.mode == "replace":
        return tables.prepare_replace(out, table)
    if destination.mode == "upsert":
        return tables.prepare_upsert(out, table, key, staged=staged)
    if destination.mode == "insert_ignore":
        return tables.prepare_insert_ignore(out, table, key, staged=staged)
    if destination.mode == "monthly_merge":
        return tables.prepare_monthly_merge(out, table, destination.group_by, staged=staged)
    raise ValueError(f"unknown load mode {destination.mode!r}")


def load(df: DataFrame, destination: Destination, staged: bool = False) -> None:
    """``prepare_load`` and publish; a database table is written at once."""
    if destination.connection is not None:
        out = project(df, destination.columns) if destination.columns else df
        jdbc.write_table(out, destination.connection)
    else:
        tables.publish(df.sparkSession, prepare_load(df, destination, staged))


REJECTS_SCHEMA = "job_name STRING, record STRING, rejected_on TIMESTAMP"


def good_records(source: DataFrame, name: str, now: datetime) -> tuple[DataFrame, DataFrame | None]:
    """The records that a source could read, and the others (None if there are none), as it marks them."""
    if CORRUPT not in source.columns:
        return source, None
    # Written: Spark answers no question about the marks alone from text files.
    source = materialize(source, "marked")
    bad = source.where(F.col(CORRUPT).isNotNull())
    if bad.isEmpty():
        return source.drop(CORRUPT), None
    rows = bad.select(F.lit(name).alias("job_name"), F.col(CORRUPT).alias("record"), F.lit(now).alias("rejected_on"))
    return source.where(F.col(CORRUPT).isNull()).drop(CORRUPT), rows


def read_rejects(spark: SparkSession, control_path: str) -> DataFrame:
    """The records that the runs of a control table could not read."""
    return spark.read.schema(REJECTS_SCHEMA).parquet(f"{control_path}.rejects")


def one_kind(destinations: Sequence[Destination]) -> None:
    """Refuse targets of which some are published together and others, in a database, are not."""
    if len({d.connection is None for d in destinations}) > 1:
        raise ValueError("catalog and database targets in one run: a failure between them would load one twice")


def run_pipeline(
    name: str,
    source: DataFrame,
    steps: Sequence[Step],
    checks: Sequence[Mapping[str, Any]],
    destinations: Sequence[Destination],
    control_path: str,
    lookups: Lookups | None = None,
    load_date: date | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    **names: str,
) -> DataFrame:
    """Transform, stage, check, load every destination, and record the run.

    The source's rows are counted apart from the steps, which may read it more than once (a
    global sort does); the result is staged in the shared folder, and the checks and all
    destinations read the staged copy. The catalog tables are one batch of the load journal beside the control
    table, which the next run finishes first if this one dies. Destinations are catalog tables or
    database tables, not both: a database is outside the batch. Records that the source could not read go to
    ``<control_path>.rejects``. A failing run is recorded as Failed and raised. Returns the control record.
    """
    spark = source.sparkSession
    started = clock()
    source_count = target_count = 0
    loaded = False
    status = runs.FAILED
    one_kind(destinations)
    try:
        journal.finish_open(spark, f"{control_path}.journal")
        source, source_count = counted(source)
        source, rejects = good_records(source, name, started)
        outputs = apply_outputs(source, steps, lookups, skip_rules(checks))
        by_output = {k: [d for d in destinations if d.output == k] for k in {d.output for d in destinations} or {""}}
        day = load_date or started.date()
        staged = {k: materialize(stamped(outputs[k], own, day, started), "run") for k, own in by_output.items()}
        for df in staged.values():
            quality.enforce(df, build_checks(checks))
            target_count += df.count()
        catalog = [d for d in destinations if d.connection is None]
        changes = [prepare_load(staged[d.output], d) for d in catalog]
        if rejects is not None:
            changes.append(tables.prepare_files(rejects, f"{control_path}.rejects"))
        if changes:
            journal.load_all(spark, f"{control_path}.journal", changes)
        for destination in destinations:
            if destination.connection is not None:
                load(staged[destination.output], destination)
        loaded = bool(destinations)
        status = runs.SUCCESS
    finally:
        ended = clock()
        record = runs.control_record(
            spark,
            job_name=name,
            source_count=source_count,
            target_count=target_count if loaded else 0,
            load_status=status,
            started=started,
            ended=ended,
            load_date=load_date or started.date(),
            **names,
        )
        runs.append_record(record, control_path)
    return record


def run_spec(
    spark: SparkSession,
    spec: Mapping[str, Any],
    control_path: str,
    schema: T.StructType | None = None,
    lookups: Lookups | None = None,
    execution_date: date | None = None,
    control: DataFrame | None = None,
) -> DataFrame:
    """Run a declared pipeline: ``extract``, ``lookups``, ``transform.steps``, ``quality_checks`` and
    ``load.destinations``, with Spark SQL expressions. A source that is a stream is read as far as it goes,
    in micro-batches (``stream_runner``). Returns the control record."""
    pipeline = spec.get("pipeline", spec)
    extract = pipeline["extract"]
    transform = pipeline.get("transform") or []
    source = open_source(
        spark, extract, schema, execution_date, control, job_name=pipeline["name"], keep_corrupt=True
    )
    lookups = {**open_lookups(spark, pipeline.get("lookups") or []), **(lookups or {})}
    checks = pipeline.get("quality_checks") or {}
    run, more = run_pipeline, {}
    if source.isStreaming:
        from millrace.plans.stream_runner import StreamOptions, run_stream

        run, more = run_stream, {"options": StreamOptions.declared(spark, pipeline, source.schema)}
    record = run(
        pipeline["name"],
        source,
        transform["steps"] if isinstance(transform, Mapping) else transform,
        checks.get("pre_load", []),
        [destination(spark, d) for d in pipeline["load"]["destinations"]],
        control_path,
        lookups,
        **more,
        load_date=execution_date,
        source_data=extract["source"],
        source_database=extract.get("database"),
        source_table=extract.get("table"),
        target_table=",".join(d["table"] for d in pipeline["load"]["destinations"]),
    )
    check_record(record, checks.get("post_load", []))
    return record
