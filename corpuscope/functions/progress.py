"""Translation progress as Column expressions over arrays of units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import let, ordered_set, strip


def _left(units: Column, done: Column) -> Column:
    return F.filter(units, lambda u: ~F.array_contains(done, u))


def next_unit(units: Column, appendix: Column, completed: Column, scope: Column) -> Column:
    """The first unit of the scope that is not done; none of the appendix while any of the body is open."""
    done = F.coalesce(completed, F.array().cast("array<string>"))
    body, rest = _left(units, done), _left(appendix, done)
    return F.when(scope != "appendix", F.get(body, F.lit(0))).when(F.size(body) == 0, F.get(rest, F.lit(0)))


def status(planner: Column, units: Column, appendix: Column, completed: Column, current: Column, scope: Column, raw_state: Column, raw_reason: Column, plan_reason: Column | None = None, raw_unit: Column | None = None, source: Column | None = None) -> Column:
    """The progress of one paper: state, active scope and unit, what is done and left, and what comes next.

    planner: ok or unsupported. raw_state: what the last reply reported, if anything. Done units are put into the plan's
    order, and others than the plan's are dropped. The index is within the units of the new scope, -1 if not there.
    """
    none = F.array().cast("array<string>")
    done = F.filter(F.concat(units, appendix), lambda u: F.array_contains(F.coalesce(completed, none), u))
    given, source_name = F.lower(strip(F.coalesce(scope, F.lit("")))), F.coalesce(F.nullif(strip(F.coalesce(source if source is not None else F.lit(""), F.lit(""))), F.lit("")), F.lit("canonical_payload"))

    def placed(d: Column) -> Column:
        return F.struct(d.alias("done"), _left(units, d).alias("body"), _left(appendix, d).alias("rest"))

    def judged(l: Column) -> Column:  # noqa: E741
        body, rest = F.size(l["body"]) > 0, F.size(l["rest"]) > 0
        refused, stuck = planner == "unsupported", F.coalesce(raw_state == "UNSUPPORTED", F.lit(False))
        tried = F.when(given.isin("body", "appendix"), given).when(given == "done", F.when(body, "body").otherwise("appendix")).otherwise("body")
        state = F.when(refused | stuck, "UNSUPPORTED").when(body, "IN_PROGRESS").when(rest, "BODY_DONE").otherwise("ALL_DONE")
        active = F.when(refused, "body").when(stuck, tried).when(body, "body").when(rest, "appendix").otherwise("done")
        own = F.coalesce(F.nullif(strip(F.coalesce(raw_unit if raw_unit is not None else F.lit(""), F.lit(""))), F.lit("")), strip(F.coalesce(current, F.lit(""))))
        unit = F.when(refused, "").when(stuck, own).otherwise(strip(F.coalesce(current, F.lit(""))))
        reason = F.when(refused, F.coalesce(plan_reason if plan_reason is not None else F.lit(""), F.lit(""))).when(stuck, F.coalesce(raw_reason, F.lit(""))).otherwise("")
        return F.struct(l["done"].alias("done"), l["body"].alias("body"), l["rest"].alias("rest"), state.alias("state"), active.alias("active"), unit.alias("unit"), reason.alias("reason"), refused.alias("refused"))

    def written(j: Column) -> Column:
        by_scope = lambda b, a: F.when(j["refused"], none).when(j["active"] == "body", b).when(j["active"] == "appendix", a).otherwise(none)
        both = F.struct(by_scope(units, appendix).alias("own"), by_scope(j["body"], j["rest"]).alias("left"))
        return let(both, lambda b: F.struct(
            F.lit("unit_v1").alias("protocol"), F.when(planner == "unsupported", "unsupported").otherwise("ok").alias("planner_status"),
            j["state"].alias("state"), j["active"].alias("active_scope"), b["own"].alias("active_units"), j["unit"].alias("current_unit_id"), (F.coalesce(F.array_position(b["own"], j["unit"]), F.lit(0)) - 1).cast("int").alias("current_unit_index"),
            j["done"].alias("completed_unit_ids"), b["left"].alias("remaining_unit_ids"), F.when(j["state"] == "UNSUPPORTED", "").otherwise(F.coalesce(F.get(b["left"], F.lit(0)), F.lit(""))).alias("next_unit_id"), j["reason"].alias("reason"),
            (F.size(units) + F.size(appendix)).alias("total_unit_count"), F.size(j["done"]).alias("completed_unit_count"), source_name.alias("source"), j["state"].isin("BODY_DONE", "ALL_DONE").alias("is_completed"), (j["state"] == "ALL_DONE").alias("is_all_done"),
        ))

    return let(let(let(done, placed), judged), written)


def glossary_entries(entries: Column, most: int = 30, candidates: int = 3) -> Column:
    """Entries (term, candidates, selected): trimmed, first of each term, at most three candidates, and a selected one of these."""

    def clean(e: Column) -> Column:
        own = F.slice(ordered_set(e["candidates"]), 1, candidates)
        chosen = strip(F.coalesce(e["selected"], F.lit("")))
        return F.struct(strip(e["term"]).alias("term"), own.alias("candidates"), F.when(F.array_contains(own, chosen), chosen).otherwise(F.get(own, F.lit(0))).alias("selected"))

    good = F.filter(F.transform(entries, clean), lambda e: (e["term"] != "") & (F.size(e["candidates"]) > 0))
    first = lambda g: let(F.transform(g, lambda e: e["term"]), lambda terms: F.filter(g, lambda e, i: F.array_position(terms, e["term"]) == i + 1))
    return F.slice(let(good, first), 1, most)
