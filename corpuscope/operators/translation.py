"""Translation as a batch over conversations: the latest context, the next unit, glossary confirmation, whole runs, and
the artifacts of finished runs. What a model says comes in as a table of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions import payloads, progress
from corpuscope.functions.text import let, strip, whole_number
from corpuscope.operators import store, writes

CONTINUE_TYPE = "continue_translation"


def latest_context(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    """(conversation_id, plan, status, glossary, error): the newest valid plan, status and glossary among replies.

    messages: conversation_id, id, message_kind, payload (JSON). Without a plan or a status there is an error; a glossary
    may be missing.
    """
    s = messages.where("message_kind = 'bot_reply'").select(key, "id", payloads.stored_reply(F.lit(""), F.col("payload")).alias("_s"))
    newest = lambda f: F.max_by(F.col(f"_s.{f}"), F.when(F.col(f"_s.{f}").isNotNull(), F.col("id")))
    found = s.groupBy(key).agg(newest("translation_plan").alias("plan"), newest("translation_status").alias("status"), newest("translation_glossary").alias("glossary"))
    return found.withColumn("error", F.when(F.col("plan").isNull() | F.col("status").isNull(), "no plan or status"))


def claim(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests with accepted: one a conversation, the earliest, and none while a job of theirs is queued or runs.
    requests: conversation_id, seq; jobs: conversation_id, job_type, status."""
    busy = jobs.where(F.col("status").isin("queued", "running") & (F.col("job_type") == CONTINUE_TYPE)).select("conversation_id").distinct().withColumn("_busy", F.lit(True))
    first = requests.groupBy("conversation_id").agg(F.min("seq").alias("_first"))
    return requests.join(first, "conversation_id").join(busy, "conversation_id", "left").withColumn("accepted", (F.col("seq") == F.col("_first")) & F.col("_busy").isNull()).drop("_first", "_busy")


def next_steps(contexts: DataFrame, template: str, scope: str = "target_scope") -> DataFrame:
    """contexts (latest_context() with a target scope) with unit, prompt and error: why there is nothing to go on with."""
    entries = F.col("glossary.entries")
    open_ = (F.col("glossary.status") != "confirmed") & (F.size(entries) > 0)
    unit = progress.next_unit(F.col("plan.units"), F.col("plan.appendix_units"), F.col("status.completed_unit_ids"), F.col(scope))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(F.col(scope).isin("body", "appendix"), F.lit(False)), "unsupported scope").when(open_, "glossary not confirmed")
    error = error.when(F.col("status.state").isin("UNSUPPORTED", "ALL_DONE"), "no unit left").when(F.col("unit").isNull(), "no unit left in this scope")
    units = F.when(F.col(scope) == "body", F.col("plan.units")).otherwise(F.col("plan.appendix_units"))
    said = payloads.unit_prompt(F.lit(template), units, F.col("unit"), F.col("glossary"))
    return contexts.withColumn("unit", unit).withColumn("error", error).withColumn("prompt", F.when(F.col("error").isNull(), said))


def after_reply(steps: DataFrame, reply: str = "reply", scope: str = "target_scope") -> DataFrame:
    """steps with a reply each, without errors, with new_status and stored (see stored_reply). A reply that says OK
    completes its unit; one without a status is unsupported, but its text is stored."""
    said = F.coalesce(payloads.text.status_block(F.col(reply)), F.struct(F.col("unit").alias("current_unit_id"), F.lit("UNSUPPORTED").alias("state"), F.lit("translator_status_missing").alias("reason")))

    def judged(raw: Column) -> Column:
        done = F.when(raw["state"] == "OK", F.array_union(F.col("status.completed_unit_ids"), F.array("unit"))).otherwise(F.col("status.completed_unit_ids"))
        return progress.status(F.col("plan.status"), F.col("plan.units"), F.col("plan.appendix_units"), done, F.col("unit"), F.col(scope), raw["state"], raw["reason"], F.col("plan.reason"), raw["current_unit_id"])

    new = steps.where("error IS NULL").withColumn("new_status", let(said, judged))
    payload = F.to_json(F.struct(F.col("plan").alias("translation_plan"), F.col("new_status").alias("translation_status"), F.col("glossary").alias("translation_glossary")))
    return new.withColumn("payload", payload).withColumn("stored", payloads.stored_reply(F.col(reply), F.col("payload")))


def confirm_glossary(contexts: DataFrame, submitted: str = "entries") -> DataFrame:
    """contexts with confirmed (the glossary to store) and error: refused once a unit is done, or where terms or their
    candidates differ from the draft's, in order."""
    none = F.from_json(F.lit('{"status": "confirmed", "entries": []}'), payloads.GLOSSARY)
    given = payloads.glossary(F.struct(F.lit("confirmed").alias("status"), F.col(submitted).cast(payloads.ENTRY).alias("entries")))
    now = F.coalesce(payloads.signature(F.col("glossary")), payloads.signature(payloads.glossary(none)))
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("status.completed_unit_count") > 0, "units are done").when(~now.eqNullSafe(payloads.signature(F.col("confirmed"))), "glossary changed")
    return contexts.withColumn("confirmed", given).withColumn("error", error)


# ---------------------------------------------------------------- replies that arrive
#: What becomes of a reply or a confirmation: error is null if it counted.
OUTCOME = "conversation_id {key}, seq long, unit string, state string, error string"


def continued(contexts: DataFrame, replies: DataFrame, template: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts, messages, outcomes) after replies have come in: what each conversation's plan, status and glossary are
    now, the pairs of messages to append, and for each reply its unit and new state, or why it is refused.

    contexts: as latest_context() gives them; replies: conversation_id, seq, action, target_scope, unit (the one that was
    asked for) and reply. A conversation's replies count in the order of seq, each for the unit that is next then: one
    for another unit is stale. Replies of all conversations are taken side by side, the first of each, then the second
    and so on, so there are as many rounds as the busiest conversation has replies here.
    """
    key = contexts.schema["conversation_id"].dataType.simpleString()
    now = store.written(contexts.select("conversation_id", "plan", "status", "glossary", "error"), "contexts")
    given = replies.where("conversation_id IS NOT NULL").select("conversation_id", F.col("seq").cast("long").alias("seq"), F.col("unit").alias("asked"), "reply", F.struct("action", "target_scope").alias("_how"))
    once = given.groupBy("conversation_id", "seq", "asked", "reply").agg(F.min("_how").alias("_how"))
    numbered = once.select("*", "_how.*", F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq", "asked", "reply")).alias("_n")).drop("_how")
    numbered = store.written(numbered.repartitionByRange("_n", "conversation_id"), "replies")  # a round reads the files of its number
    messages, outcomes = None, replies.sparkSession.createDataFrame([], OUTCOME.format(key=key))
    for n in range(1, (numbered.agg(F.max("_n")).first()[0] or 0) + 1):
        known = numbered.where(F.col("_n") == n).drop("_n").join(now, "conversation_id", "left").withColumn("error", F.coalesce("error", F.when(F.col("plan").isNull() | F.col("status").isNull(), "no plan or status")))
        steps = next_steps(known, template)
        steps = steps.withColumn("error", F.coalesce(F.when(~F.col("action").eqNullSafe(F.lit("continue")), "unsupported action"), "error", F.when(F.col("asked").isNotNull() & (strip(F.col("asked")) != F.col("unit")), "stale reply")))
        steps = store.written(steps, "steps")
        said = ("conversation_id", "seq", "unit", "error", "prompt", "reply")
        after = after_reply(steps).select(*said, F.col("stored.translation_status").alias("_status"), payloads.payload_json(F.col("stored")).alias("_payload"), F.col("stored.content").alias("_content"))
        done = store.written(after.unionByName(steps.where("error IS NOT NULL").select(*said), allowMissingColumns=True), "round")
        good = done.where("error IS NULL")
        outcomes = outcomes.unionByName(done.select("conversation_id", "seq", "unit", F.col("_status.state").alias("state"), "error"))
        section = payloads.text.message_section(F.col("_content"), F.col("_status.active_scope"), F.col("_content"))["section"]
        turns = good.select("conversation_id", "seq", F.col("prompt").alias("user_content"), F.col("reply").alias("bot_content"), F.col("_payload").alias("payload"), section.alias("section_category"))
        pairs = writes.message_pairs(turns, "continue_command", False)
        messages = pairs if messages is None else messages.unionByName(pairs)
        new = good.select("conversation_id", "_status")
        now = store.written(now.join(new, "conversation_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status"), "contexts")
    if messages is None:
        none = replies.sparkSession.createDataFrame([], f"conversation_id {key}, seq long, user_content string, bot_content string, payload string, section_category string")
        messages = writes.message_pairs(none, "continue_command", False)
    return now, messages, outcomes


def confirmed(contexts: DataFrame, submissions: DataFrame, asked: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contexts, messages, outcomes) after glossaries were confirmed: the newest valid submission of a conversation is its
    glossary now, and each valid one appends a hidden pair, the user's text (asked) and an empty reply that carries plan,
    status and glossary. submissions: conversation_id, seq, entries. See confirm_glossary() for what is refused."""
    key = contexts.schema["conversation_id"].dataType.simpleString()
    given = submissions.where("conversation_id IS NOT NULL").select("conversation_id", F.col("seq").cast("long").alias("seq"), "entries")
    known = given.join(contexts.select("conversation_id", "plan", "status", "glossary", "error"), "conversation_id", "left")
    judged = confirm_glossary(known.withColumn("error", F.coalesce("error", F.when(F.col("plan").isNull() | F.col("status").isNull(), "no plan or status"))))
    judged = store.written(judged, "confirmed")
    good = judged.where("error IS NULL")
    payload = F.to_json(F.struct(F.col("plan").alias("translation_plan"), F.col("status").alias("translation_status"), F.col("confirmed").alias("translation_glossary")))
    turns = good.select("conversation_id", "seq", F.lit(asked).alias("user_content"), F.lit("").alias("bot_content"), payload.alias("payload"), F.lit(None).cast("string").alias("section_category"))
    messages = writes.message_pairs(turns, "user_message", False).withColumn("visible_to_user", F.lit(False))
    new = good.groupBy("conversation_id").agg(F.max_by("confirmed", "seq").alias("_g"))
    now = contexts.join(new, "conversation_id", "left").withColumn("glossary", F.coalesce("_g", "glossary")).drop("_g")
    outcomes = judged.select("conversation_id", "seq", F.lit(None).cast("string").alias("unit"), F.col("status.state").alias("state"), "error")
    return now, messages, outcomes.to(replies_schema(judged.sparkSession, key))


def replies_schema(spark, key: str):
    return spark.createDataFrame([], OUTCOME.format(key=key)).schema


# ---------------------------------------------------------------- whole runs
def run_states(plans: DataFrame, replies: DataFrame, continue_count: int) -> DataFrame:
    """(conversation_id, step, unit, status) of whole runs: the first unit and up to continue_count more, the appendix
    after the body, until a reply is no success.

    plans: conversation_id, plan (normalised); replies: conversation_id, step (from 0), reply. A run's place after each
    step follows from the units before it alone, so steps are judged side by side and cut at the first failure.
    """
    units = F.concat("plan.units", "plan.appendix_units")
    planned = plans.where("plan.status = 'ok'").select("conversation_id", "plan", F.posexplode(units).alias("step", "unit")).where(F.col("step") <= continue_count)
    raw = payloads.text.status_block(F.coalesce("reply", F.lit("")))
    r = replies.select("conversation_id", "step", "reply", F.coalesce(raw, F.struct(F.lit("").alias("current_unit_id"), F.lit("UNSUPPORTED").alias("state"), F.lit("translator_status_missing").alias("reason"))).alias("raw"))
    each = planned.join(r, ["conversation_id", "step"])
    ended = each.groupBy("conversation_id").agg(F.min(F.when(F.col("raw.state") != "OK", F.col("step"))).alias("end"), F.collect_set("step").alias("steps"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(0), F.array_max("steps") + 1), F.col("steps")))  # a missing reply ends the run as well
    kept = each.join(ended.select("conversation_id", F.coalesce("end", F.lit(1 << 30)).alias("end"), gap.alias("gap")), "conversation_id").where((F.col("step") <= F.col("end")) & (F.col("step") < F.col("gap")))
    done = F.slice(F.concat("plan.units", "plan.appendix_units"), F.lit(1), F.col("step") + F.when(F.col("raw.state") == "OK", 1).otherwise(0))
    scope = F.when(F.col("step") < F.size("plan.units"), "body").otherwise("appendix")
    status = progress.status(F.col("plan.status"), F.col("plan.units"), F.col("plan.appendix_units"), done, F.col("unit"), scope, F.col("raw.state"), F.col("raw.reason"), F.col("plan.reason"), F.col("raw.current_unit_id"))
    return kept.select("conversation_id", "step", "unit", status.alias("status"), "reply")


RESULT = "array<struct<unit_id:string,state:string,reason:string,content:string>>"


def artifact_errors(plan: Column, results: Column) -> Column:
    """What is wrong with the unit results of a run, as texts in order; empty if nothing. results: an array like RESULT."""
    planned = F.concat(plan["units"], plan["appendix_units"])

    def one(r: Column, i: Column) -> Column:
        state, at = F.upper(strip(F.coalesce(r["state"], F.lit("")))), F.concat(F.lit("unit_results["), i.cast("string"), F.lit("]"))
        unit, blank = strip(F.coalesce(r["unit_id"], F.lit(""))), lambda c: strip(F.coalesce(r[c], F.lit(""))) == ""
        earlier = F.exists(F.slice(results, F.lit(1), i), lambda o: F.upper(strip(F.coalesce(o["state"], F.lit("")))) == "UNSUPPORTED")
        return F.concat(at, F.when(unit == "", ".unit_id is required").when(~state.isin("OK", "UNSUPPORTED"), ".state must be OK or UNSUPPORTED").when((state == "OK") & blank("content"), ".content is required")
                        .when((state == "UNSUPPORTED") & blank("reason"), ".reason is required").when(~unit.eqNullSafe(F.get(planned, i)), " is not the next planned unit").when(earlier, " follows an unsupported unit"))

    found = F.filter(F.transform(results, one), lambda e: e.isNotNull())
    missing = F.coalesce(F.size(results), F.lit(0)) <= 0
    return F.when(plan.isNull(), F.array(F.lit("translation_plan is missing or invalid"))).when(plan["status"] == "unsupported", F.array().cast("array<string>")).when(missing, F.array(F.lit("unit_results must be a non-empty list"))).when(F.size(results) > F.size(planned), F.concat(F.array(F.lit("unit_results exceed the planned units")), found)).otherwise(found)


def build_artifact(rows: DataFrame, first: str, more: str, planned: str) -> DataFrame:
    """rows (plan normalised, results like RESULT) with artifact_errors, messages (role, content, message_kind,
    visible_to_user, status), first_bot_message, continue_count_used and translation_status; the last four null where
    there are errors. first, more: what is asked for the first and for each further unit, whose id takes the place of
    {unit}; planned: what is asked for a plan. A run of an unsupported plan has one pair of messages, without a reply's
    text."""
    out = rows.withColumn("artifact_errors", artifact_errors(F.col("plan"), F.col("results")))

    def pair(r: Column, i: Column) -> Column:
        unit, state = strip(r["unit_id"]), F.upper(strip(r["state"]))
        asked = F.replace(F.when(i == 0, F.lit(first)).otherwise(F.lit(more)), F.lit("{unit}"), unit)
        done = F.transform(F.slice(F.col("results"), F.lit(1), i + F.when(state == "OK", 1).otherwise(0)), lambda x: strip(x["unit_id"]))
        scope = F.when(F.array_contains(F.col("plan.appendix_units"), unit), "appendix").otherwise("body")
        status = progress.status(F.col("plan.status"), F.col("plan.units"), F.col("plan.appendix_units"), done, unit, scope, state, strip(F.coalesce(r["reason"], F.lit(""))), F.col("plan.reason"), unit)
        said = F.when(state == "OK", payloads.stored_reply(r["content"], F.lit(None).cast("string"))["content"]).otherwise("")
        none = F.lit(None).cast(_STATUS)
        user = F.struct(F.lit("user").alias("role"), asked.alias("content"), F.when(i == 0, "system_prompt").otherwise("continue_command").alias("message_kind"), F.lit(False).alias("visible_to_user"), none.alias("status"))
        return F.array(user, F.struct(F.lit("bot").alias("role"), said.alias("content"), F.lit("bot_reply").alias("message_kind"), F.lit(True).alias("visible_to_user"), status.cast(_STATUS).alias("status")))

    refused = progress.status(F.lit("unsupported"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(""), F.lit("body"), F.lit(None).cast("string"), F.lit(""), F.col("plan.reason"))
    empty = F.array(
        F.struct(F.lit("user").alias("role"), F.lit(planned).alias("content"), F.lit("system_prompt").alias("message_kind"), F.lit(False).alias("visible_to_user"), F.lit(None).cast(_STATUS).alias("status")),
        F.struct(F.lit("bot").alias("role"), F.lit("").alias("content"), F.lit("bot_reply").alias("message_kind"), F.lit(True).alias("visible_to_user"), refused.cast(_STATUS).alias("status")),
    )
    good = F.size("artifact_errors") == 0
    out = out.withColumn("messages", F.when(good, F.when(F.col("plan.status") == "unsupported", empty).otherwise(F.flatten(F.transform("results", pair)))))
    return with_summary(out.withColumn("translation_status", F.try_element_at("messages", F.lit(-1))["status"]))


_STATUS = (
    "struct<protocol:string,planner_status:string,state:string,active_scope:string,active_units:array<string>,current_unit_id:string,current_unit_index:int,completed_unit_ids:array<string>,remaining_unit_ids:array<string>,"
    "next_unit_id:string,reason:string,total_unit_count:int,completed_unit_count:int,source:string,is_completed:boolean,is_all_done:boolean>"
)


def with_summary(rows: DataFrame) -> DataFrame:
    """rows with first_bot_message and continue_count_used of their messages."""
    bots = F.filter("messages", lambda m: (m["role"] == "bot") & (m["content"] != ""))
    return rows.withColumns({"first_bot_message": F.when(F.col("messages").isNotNull(), F.coalesce(F.get(bots, F.lit(0))["content"], F.lit(""))), "continue_count_used": F.size(F.filter("messages", lambda m: (m["role"] == "user") & (m["message_kind"] == "continue_command")))})


def message_errors(messages: Column, plans: Column, plan: Column, statuses: Column, latest: Column) -> Column:
    """What is wrong with a finished run: messages (role, message_kind) must alternate, each reply's plan be the run's and
    its status valid, and the last status be the run's own. plans, statuses: of each message, null for users."""

    def one(m: Column, i: Column) -> Column:
        at, first = F.concat(F.lit("messages["), i.cast("string"), F.lit("]")), F.when(i == 0, "system_prompt").otherwise("continue_command")
        role, kind = F.lower(strip(F.coalesce(m["role"], F.lit("")))), F.coalesce(F.nullif(strip(F.coalesce(m["message_kind"], F.lit(""))), F.lit("")), first)
        user = F.when(role != "user", " must be a user message").when(kind != first, F.concat(F.lit(" must use message_kind="), first))
        bot = F.when(role != "bot", " must be a bot message").when(F.get(plans, i).isNull(), " has an invalid plan").when(F.get(statuses, i).isNull(), " has an invalid status").when(~F.get(plans, i).eqNullSafe(plan), " has another plan")
        return F.concat(at, F.when(i % 2 == 0, user).otherwise(bot))

    found = F.filter(F.transform(messages, one), lambda e: e.isNotNull())
    last = F.when(~F.try_element_at(statuses, F.lit(-1)).eqNullSafe(latest), F.array(F.lit("translation_status is not that of the last reply"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.lit("messages must be a non-empty list"))).when(F.size(messages) % 2 != 0, F.array(F.lit("messages must be ordered pairs"))).otherwise(F.concat(found, last))


def continue_count(given: Column, messages: Column) -> Column:
    """A given number of continuations, or as many as the messages have."""
    n = whole_number(given)
    return F.when(n >= 0, n.cast("int")).otherwise(F.size(F.filter(messages, lambda m: (m["role"] == "user") & (m["message_kind"] == "continue_command"))))


def markdown(messages: Column, plan: Column, status: Column, errors: Column, continues: Column, first: Column, title: Column | None = None, source_pdf: Column | None = None) -> Column:
    """A finished run as Markdown: a header with counts, summaries of status and plan, the translated units, warnings.
    messages: (role, content, status); errors: (skill, type, message, retryable)."""
    # Headings and line heads.
    said = F.filter(messages, lambda m: (F.lower(strip(m["role"])) == "bot") & (strip(F.coalesce(m["content"], F.lit(""))) != ""))
    or_dash = lambda c: F.coalesce(F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("-"))
    head = lambda h, v: F.concat(F.lit(f"- {h}: "), v.cast("string"))
    given = lambda h, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", head(h, strip(c)))
    listed = lambda h, c: F.when(F.size(c) > 0, head(h, F.array_join(c, ", ")))
    name = F.coalesce(F.nullif(strip(F.coalesce(title if title is not None else F.lit(""), F.lit(""))), F.lit("")), F.lit("Paper Translation"))
    counts = F.concat(status["completed_unit_count"].cast("string"), F.lit(" / "), status["total_unit_count"].cast("string"))
    top = [F.concat(F.lit("# "), name), F.lit(""), given("源 PDF", source_pdf if source_pdf is not None else F.lit("")), head("可见译文段数", F.size(said)), head("续翻次数", F.coalesce(continues, F.lit(0))), head("首段摘要预览", or_dash(F.substring(strip(F.coalesce(first, F.lit(""))), 1, 120))), F.lit("")]
    state = [F.lit("## Translation Summary"), F.lit(""), head("当前状态", status["state"]), head("当前 scope", status["active_scope"]), head("当前 unit", or_dash(status["current_unit_id"])), head("下一 unit", or_dash(status["next_unit_id"])), head("已完成 unit 数", counts), given("原因", status["reason"]), F.lit("")]
    planned = [F.lit("## Translation Plan"), F.lit(""), head("Planner 状态", plan["status"]), head("主体 unit", F.size(plan["units"])), head("附录 unit", F.size(plan["appendix_units"])), listed("主体顺序", plan["units"]), listed("附录顺序", plan["appendix_units"]), given("Planner 原因", plan["reason"]), F.lit("")]

    def unit(m: Column, i: Column) -> Column:
        n = (i + 1).cast("string")
        named = F.coalesce(F.nullif(strip(F.coalesce(m["status"]["current_unit_id"], F.lit(""))), F.lit("")), F.concat(F.lit("section-"), n))
        return F.concat(F.lit("## "), n, F.lit(". "), named, F.lit("\n\n"), strip(m["content"]), F.lit("\n"))

    def warning(e: Column, i: Column) -> Column:
        return F.concat(F.lit("- ["), (i + 1).cast("string"), F.lit("] skill="), or_dash(e["skill"]), F.lit("; type="), or_dash(e["type"]), F.lit("; retryable="), F.when(F.coalesce(e["retryable"], F.lit(False)), "yes").otherwise("no"), F.lit("; message="), or_dash(e["message"]))

    body = F.concat(F.array(F.lit("## Translation"), F.lit("")), F.transform(said, unit), F.when(F.size(errors) > 0, F.concat(F.array(F.lit("## Warnings"), F.lit("")), F.transform(errors, warning))).otherwise(F.array().cast("array<string>")))
    rows = F.concat(F.filter(F.array(*top, *state, *planned), lambda x: x.isNotNull()), body)
    return F.concat(F.regexp_replace(F.array_join(rows, "\n"), r"(?U)\s+$", ""), F.lit("\n"))
