"""Migrations of stored messages: runs over a stored table that go on where they stopped.

A run takes a table's files some at a time. Each step is one commit: the files with changed rows written anew, and rows
of the progress table that name the files that are done, those that the step made included. So a run that was stopped
anywhere goes on with the files that are left, and ends as one that was not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions import legacy, payloads, text
from corpuscope.operators import store

#: (run, file, made, n_rows, n_changed): a file that is done; made: by the run itself.
PROGRESS = "run string, file string, made boolean, n_rows long, n_changed long"
NEXT = "next_"


# ---------------------------------------------------------------- steps
def message_kinds(messages: DataFrame, prompts: tuple[str, ...] = ()) -> DataFrame:
    """messages with next_message_kind, next_section_category, next_visible_to_user and next_payload: what they are by the
    present rules. Of replies the status in the payload is made anew: the block in the text first, a stored one unless it
    was a guess; payloads that mean the same stay as they are written. Columns that messages lack count as null."""
    has, null = set(messages.columns), F.lit(None).cast("string")
    col = lambda c, kind="string": F.col(c) if c in has else F.lit(None).cast(kind)
    kind = text.inferred_kind(col("message_kind"), col("message_type"), col("role"), F.col("content"), prompts)
    m = messages.withColumn(f"{NEXT}message_kind", kind)
    bot = F.col(f"{NEXT}message_kind") == "bot_reply"
    content, payload = F.coalesce("content", F.lit("")), col("payload")
    m = m.withColumn("_status", F.when(bot, legacy.migrated_status(content, payload)))
    m = m.withColumn("_payload", F.when(bot, _with_status(payload, F.col("_status"))).otherwise(payload))
    same = payloads.canonical_json(F.col("_payload")).eqNullSafe(payloads.canonical_json(payload))
    shown = F.when(bot, legacy.displayed(content)["display"])
    section = text.message_section(shown, payloads.key(F.col("_payload"), "translation_status.active_scope"), content)["section"]
    visible = F.coalesce(col("visible_to_user", "boolean"), text.visible(F.col(f"{NEXT}message_kind")))
    out = m.withColumns({f"{NEXT}payload": F.when(same, payload).otherwise(F.col("_payload")), f"{NEXT}section_category": F.when(bot, section).otherwise(null), f"{NEXT}visible_to_user": visible})
    return out.drop("_status", "_payload")


def _with_status(payload: Column, status: Column) -> Column:
    """The payload's other keys, and the status if there is one; null if nothing is left."""
    obj = F.when(F.startswith(text.strip(F.coalesce(payload, F.lit(""))), F.lit("{")), payload)
    own = F.map_filter(F.coalesce(F.try_parse_json(obj).cast("map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, _: k != "translation_status")
    made = F.when(status.isNotNull(), F.map_concat(own, F.parse_json(F.to_json(F.struct(status.alias("translation_status")))).cast("map<string,variant>"))).otherwise(own)
    return F.when(F.size(made) > 0, F.to_json(made))


def payload_cleanup(messages: DataFrame) -> DataFrame:
    """messages (message_kind, content, payload) with action, reasons, next_content and next_payload: replies as they would
    be stored today, the status block out of the text and the payload's parts in their form. A block that can't be read
    is left alone (skip_parse_error); what is stored so already, or is no reply, is kept."""
    bot = F.col("message_kind") == "bot_reply"
    m = messages.withColumn("_s", F.when(bot, payloads.stored_reply(F.coalesce("content", F.lit("")), F.col("payload"))))
    unread = F.coalesce("content", F.lit("")).rlike(text.STATUS_JSON) & F.col("_s.raw").isNull()
    made = payloads.payload_json(F.col("_s"))
    same = payloads.canonical_json(made).eqNullSafe(payloads.canonical_json(F.col("payload")))
    content, payload = F.col("_s.content"), F.when(same, F.col("payload")).otherwise(made)
    differs = ~content.eqNullSafe(F.coalesce("content", F.lit(""))) | ~same
    m = m.withColumn("action", F.when(~bot, "keep").when(unread, "skip_parse_error").when(differs, "update").otherwise("keep"))
    update = F.col("action") == "update"
    m = m.withColumn("reasons", F.when(F.col("action") == "skip_parse_error", F.array(F.lit("status block that is no JSON"))).otherwise(F.array().cast("array<string>")))
    return m.withColumns({f"{NEXT}content": F.when(update, content).otherwise(F.col("content")), f"{NEXT}payload": F.when(update, payload).otherwise(F.col("payload"))}).drop("_s")


# Keys that are no longer kept.
OUTDATED = ("translation_status", "raw_translation_status_text", "raw_document_outline_text", "parse_error")


def status_version_2(messages: DataFrame) -> DataFrame:
    """messages (message_kind, content, payload) with action, reasons and next_payload: replies' old statuses, from the
    payload or else from the block in the text, in the form of version 2, the payload's other keys beside it. A status that
    can't be brought into that form leaves the message alone (skip_error), the reason being where it was found and why."""
    bot = F.col("message_kind") == "bot_reply"
    m = messages.withColumn("_o", F.when(bot, legacy.old_status(F.col("content"), F.col("payload")))).withColumn("_v", F.when(bot, legacy.status_v2(F.col("_o.status"))))
    obj = F.when(F.startswith(text.strip(F.coalesce("payload", F.lit(""))), F.lit("{")), F.col("payload"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    others = F.map_filter(F.coalesce(F.try_parse_json(obj).cast("map<string,variant>"), empty), lambda k, _: ~k.isin(*OUTDATED))
    made = F.to_json(F.map_concat(others, F.parse_json(F.to_json(F.struct(F.col("_v.status").alias("translation_status")))).cast("map<string,variant>")))
    same = payloads.canonical_json(made).eqNullSafe(payloads.canonical_json(F.col("payload")))
    good = F.col("_v.reason") == "ok"
    m = m.withColumn("action", F.when(~bot, "keep").when(~good, "skip_error").when(same, "keep").otherwise("update"))
    m = m.withColumn("reasons", F.when(F.col("action") == "skip_error", F.array(F.concat_ws(":", "_o.origin", "_v.reason"))).otherwise(F.array().cast("array<string>")))
    return m.withColumn(f"{NEXT}payload", F.when(F.col("action") == "update", made).otherwise(F.col("payload"))).drop("_o", "_v")


def display_filter(messages: DataFrame) -> DataFrame:
    """messages with action (keep, trim or hide), reasons, next_content and next_visible_to_user: what the filter for old
    replies does to them. A trimmed reply keeps what is shown of it, a hidden one is no longer visible."""
    m = messages.withColumn("_d", legacy.displayed(F.coalesce("content", F.lit(""))))
    m = m.withColumn("action", legacy.display_action(F.col("message_kind"), F.col("content"), F.col("_d.display"))).withColumn("reasons", F.col("_d.reasons"))
    trim, hide = F.col("action") == "trim", F.col("action") == "hide"
    return m.withColumns({f"{NEXT}content": F.when(trim, F.col("_d.display")).otherwise(F.col("content")), f"{NEXT}visible_to_user": F.when(hide, F.lit(False)).otherwise(F.col("visible_to_user"))}).drop("_d")


# ---------------------------------------------------------------- runs
def report(rows: DataFrame, key: str) -> DataFrame:
    """rows of a step as its report: the key, each value before and after, and what else the step said; changed says
    whether any value differs, nulls compared like values."""
    after = [c for c in rows.columns if c.startswith(NEXT)]
    names = [c.removeprefix(NEXT) for c in after]
    before = [(F.col(n) if n in rows.columns else F.lit(None).cast(rows.schema[c].dataType)) for n, c in zip(names, after)]
    changed = F.lit(False)
    for old, c in zip(before, after):
        changed = changed | ~old.eqNullSafe(F.col(c))
    said = [c for c in rows.columns if c in ("action", "reasons")]
    values = [x for n, old, c in zip(names, before, after) for x in (old.alias(f"{n}_before"), F.col(c).alias(f"{n}_after"))]
    return rows.select(key, *said, *values, changed.alias("changed"))


def audit(spark: SparkSession, root: str, name: str, key: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report of a step over the stored table as it is; nothing is written."""
    return report(step(store.read(spark, root, name)), key)


def migrate(spark: SparkSession, root: str, name: str, key: str, step: Callable[[DataFrame], DataFrame], run: str, files: int = 32, most: int | None = None) -> DataFrame:
    """Apply a step to a stored table, files at a time and each only once by a run of this name; the report of all rows
    that the run has changed, in whatever calls. Columns that the step sets and the table lacks are added first. most: so
    many commits in this call, if the run is to be stopped early. Files that other writers add meanwhile are taken too.
    """
    progress, reported = f"{name}_progress", f"{name}_report_{run}"
    wanted = {c.removeprefix(NEXT): t for c, t in step(store.read(spark, root, name).limit(0)).dtypes if c.startswith(NEXT)}

    def widened(now: store.Version, own: str) -> dict[str, dict] | None:
        table = store.alter(spark, root, name, now, own, add=wanted)
        return {name: table} if table else None

    store.commit(spark, root, widened)
    done = 0
    while (most is None or done < most) and _some(spark, root, name, progress, run):

        def make(now: store.Version, own: str) -> dict[str, dict] | None:
            todo = _left(spark, root, now, name, progress, run)[:files]
            return _moved(spark, root, name, key, step, run, now, own, todo, progress, reported) if todo else None

        store.commit(spark, root, make)
        done += 1
    version = store.latest(spark, root)
    return store.read(spark, root, reported, version) if reported in version.tables else report(step(store.read(spark, root, name, version).limit(0)), key)


def _left(spark: SparkSession, root: str, now: store.Version, name: str, progress: str, run: str) -> list[tuple[str, int]]:
    known = store.read(spark, root, progress, now).where(F.col("run") == run) if progress in now.tables else spark.createDataFrame([], PROGRESS)
    seen = {r.file for r in known.select("file").distinct().collect()}
    return [f for f in store.file_list(spark, root, now, name) if f[0] not in seen]


def _some(spark: SparkSession, root: str, name: str, progress: str, run: str) -> bool:
    return bool(_left(spark, root, store.latest(spark, root), name, progress, run))


def _moved(spark: SparkSession, root: str, name: str, key: str, step, run: str, now: store.Version, own: str, todo: list[tuple[str, int]], progress: str, reported: str) -> dict[str, dict]:
    """One step over some files: the table, its report and the progress after it."""
    schema = now.schema(name)
    # few files, or such of one row group, would be few tasks; a step costs more than moving its rows
    rows = step(store.rows_of(spark, root, now, name, todo).repartition(key))
    after = {c.removeprefix(NEXT): c for c in rows.columns if c.startswith(NEXT)}
    changed = F.lit(False)
    for n, c in after.items():
        changed = changed | ~F.col(n).eqNullSafe(F.col(c))
    marked = store.written(rows.withColumn("_changed", changed), "migration")
    counts = {r[0]: (r.n, r.c) for r in marked.groupBy(store.FILE).agg(F.count("*").alias("n"), F.count_if("_changed").alias("c")).collect()}
    touched = {f for f, (_, c) in counts.items() if c}
    new = marked.where(F.col(store.FILE).isin(*touched)).select(*(F.col(after.get(c, c)).cast(schema[c].dataType).alias(c) for c in schema.names)) if touched else None
    table, made = store.rewritten(spark, root, name, now, own, touched, new)
    lines = [(run, f, False, *counts.get(f, (0, 0))) for f, _ in todo] + [(run, f, True, 0, 0) for f in made]
    out = {name: table, progress: store.append(spark.createDataFrame(lines, PROGRESS), root, progress, now, own)}
    if touched:
        said = report(marked.where("_changed"), key)
        out[reported] = store.append(said, root, reported, now, own)
    return out


def run_counts(spark: SparkSession, root: str, name: str, run: str) -> DataFrame:
    """(n_files, n_rows, n_changed) of what a run has done so far."""
    own = store.read(spark, root, f"{name}_progress").where((F.col("run") == run) & ~F.col("made"))
    return own.agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_changed").alias("n_changed"))
