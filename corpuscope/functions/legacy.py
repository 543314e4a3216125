"""Old replies: which of their lines are shown, and their key=value status, as Column expressions.

A reply's lines get their marks once; what is cut follows from the places of the last or first lines with a mark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions import payloads
from corpuscope.functions.text import SEPARATOR, STATUS_OLD, let, lines, strip

# Phrases of footers in old replies.
FULL_DONE = ("全文已经翻译完成", "全文已翻译完成", "全文翻译完成", "已全部翻译完成", "翻译已完成", "已完成全文翻译", "全文翻译结束", "全文翻译完毕", "论文已全部翻译完毕", "论文翻译完成", "论文翻译完毕", "本文翻译至此结束", "（全文完）")
BODY_DONE = ("正文翻译完毕", "正文部分翻译完毕", "全文主文部分翻译完成", "论文主体翻译完成", "主文部分翻译完成", "论文正文翻译完毕", "论文正文已结束", "论文正文已全部翻译完成", "正文已完成")
OFFER_EXACT = ("如需", "如需:", "如需：")
OFFER_START = ("如果你希望我", "如果你希望", "如果你需要我", "如果你需要", "如果需要", "可以直接告诉我", "直接告诉我", "告诉我即可", "我可以继续协助", "我可以继续帮你")
SERVICE_ANY_CASE = ("latex", "ppt", "appendix", "word")
SERVICE = (
    "伪代码", "ppt大纲", "答辩ppt", "答辩讲稿", "论文笔记", "精读笔记", "方法解析", "方法对比分析", "方法对比总结", "技术解读文章", "技术解读", "技术报告", "学术润色", "中文版论文格式", "可投稿中文版本", "排版整理", "排版版翻译稿",
    "公式优化", "推导公式讲解", "继续协助", "可以告诉我", "告诉我你想", "告诉我你接下来想做什么", "告诉我你想要哪种版本", "如需整理", "如需翻译参考文献", "如需翻译", "整理为", "整理成", "可直接发表", "总结全文", "补充材料",
    "如果你希望", "如果你需要", "请告诉我你的需求", "请告诉我", "你的需求", "翻译致谢", "继续翻译「致谢」", "继续翻译致谢", "继续翻译附录", "继续翻译参考文献", "参考文献标题", "翻译全部参考文献标题", "提炼创新点", "术语对照表",
    "方法流程图", "流程图", "深入处理", "输出为word", "导出为word", "逐段对照", "英文+中文", "中英对照", "精简版讲稿", "生成精简版讲稿", "讲稿版精简稿",
)
SERVICE_START = ("导出为", "生成", "整理成", "整理为", "提炼为", "提炼成", "总结", "解释", "讲解", "画", "绘制", "制作", "转成", "输出为", "梳理", "归纳", "或需要我", "需要我")
NEXT_START = ("下一章", "下一节", "（下一章", "(下一章", "（下一节", "(下一节")
OPTIONAL = {"appendix": r"(?:附录|appendix|supplement(?:ary|al)?(?:\s+material)?)", "acknowledgements": r"(?:致谢|acknowledg(?:e)?ments?)", "references": r"(?:参考文献|references?|bibliography)"}
STATUS_KEYS = ("scope", "completed", "current", "next", "remaining", "state", "phase", "available_scope_extensions", "next_action_type", "next_action_command", "next_action_target_scope", "recommended_stop_reason")
EXTENSIONS = {"appendix": "继续翻译附录", "acknowledgements": "继续翻译致谢", "references": "继续翻译参考文献"}
BULLET = r"^(?:[-*•]\s+|\d+[.)]\s+)"


def _any(words) -> str:
    """A pattern of any of some words, which tries none where no word can start, and words of one first character together."""
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[0], []).append(re.escape(w[1:]))
    plain, other = (sorted(c for c in rests if (ord(c) < 128) == low) for low in (True, False))
    starts = "".join(map(re.escape, plain)) + (f"{other[0]}-{other[-1]}" if other else "")
    return f"(?=[{starts}])(?:" + "|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in rests.items()) + ")"


# ---------------------------------------------------------------- lines
def hint_text(c: Column) -> Column:
    """A line without bold marks and leading check marks."""
    return strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"\*\*|__", ""), r"(?U)^[\s✅✔✓☑]+", ""))


def is_marker(n: Column) -> Column:
    return n.rlike(_any(FULL_DONE + BODY_DONE))


def is_offer(n: Column) -> Column:
    return n.isin(*OFFER_EXACT) | n.rlike(f"^{_any(OFFER_START)}")


def is_hint(n: Column) -> Column:
    """A line that says how to go on; n is its hint_text()."""
    on, low, ahead = F.contains(n, F.lit("继续")), F.lower(n), n.rlike("下一章|下一节")
    said = F.contains(low, F.lit("continue"))
    asked = on & n.rlike("当你输入|如果你说|请回复|请输入|请继续输入|回复")
    return n.rlike(f"如需继续|是否继续|翻译下一章|翻译下一节|^{_any(NEXT_START)}") | (ahead & (on | F.contains(low, F.lit("reply")) | said)) | asked | (F.contains(low, F.lit("reply")) & said)


def is_service(n: Column) -> Column:
    return (n != "") & (is_marker(n) | is_offer(n) | F.lower(n).rlike(_any(SERVICE_ANY_CASE)) | n.rlike(_any(SERVICE)))


def is_heading(t: Column) -> Column:
    """Blank lines and separators count as headings."""
    return (t == "") | t.rlike(SEPARATOR) | t.rlike(r"^#{1,6}\s+\S+") | t.rlike(r"(?i)^(?:第\s*[0-9一二三四五六七八九十IVXLC]+\s*[章节]|[IVXLC0-9]+[\.、．)]\s*\S+)")


def optional_section(t: Column) -> Column:
    out = None
    for scope, words in OPTIONAL.items():
        is_ = t.rlike(rf"(?iU)^(?:#{{1,6}}\s*)?{words}\b")
        out = F.when(is_, scope) if out is None else out.when(is_, scope)
    return out


def _marked(line: Column, i: Column) -> Column:
    """One line with its place (from 1) and marks. kind: skip, done, signal, heading or other, as a block of services sees it."""

    def marks(x: Column) -> Column:
        t, n, p = x["t"], x["n"], x["p"]
        bullet = t.rlike(BULLET)
        lead = is_hint(n) | is_service(n) | (bullet & is_service(p))
        found = F.struct(((t == "") | t.rlike(SEPARATOR)).alias("blank"), lead.alias("lead"), is_heading(t).alias("heading"), (bullet & p.rlike(f"^{_any(SERVICE_START)}")).alias("starts"))
        return let(found, lambda y: row(t, n, y))

    def row(t: Column, n: Column, y: Column) -> Column:
        kind = F.when(y["blank"], "skip").when(is_marker(n), "done").when(y["lead"] | y["starts"], "signal").when(y["heading"], "heading").otherwise("other")
        return F.struct((i + 1).alias("i"), y["blank"].alias("blank"), y["lead"].alias("lead"), (y["lead"] | y["heading"]).alias("foot"), kind.alias("kind"), F.when(~y["blank"], optional_section(t)).alias("scope"))

    return let(strip(line), lambda own: let(F.struct(own.alias("t"), hint_text(own).alias("n"), hint_text(F.regexp_replace(own, BULLET, "")).alias("p")), marks))


def _last(rows: Column, test) -> Column:
    return F.coalesce(F.array_max(F.transform(F.filter(rows, test), lambda r: r["i"])), F.lit(0))


def _first(rows: Column, test) -> Column:
    return F.array_min(F.transform(F.filter(rows, test), lambda r: r["i"]))


def _cut(rows: Column) -> Column:
    """Where the closing block of services starts: the first line from which all are of a footer, or from which lines are
    signals after a done mark, with headings only among them."""

    def found(p: Column) -> Column:
        after = F.filter(rows, lambda r: (r["i"] > p["other"]) & (r["kind"] != "skip"))
        signal = _first(after, lambda r: r["kind"].isin("done", "signal"))
        block = let(signal, lambda g: F.when(p["done"] > p["other"], F.greatest(_last(after, lambda r: r["i"] < g), p["other"]) + 1))
        return F.least(_first(rows, lambda r: r["lead"] & (r["i"] > p["plain"])), block)

    return let(F.struct(_last(rows, lambda r: ~r["foot"]).alias("plain"), _last(rows, lambda r: r["kind"] == "other").alias("other"), _last(rows, lambda r: r["kind"] == "done").alias("done")), found)


def displayed(c: Column) -> Column:
    """(display, reasons, has_status_block): what of an old reply is shown.

    The status block goes. Without one, closing footers and blocks of services go, and what follows the first heading of
    an appendix, acknowledgements or references; all, if the reply starts with one.
    """
    body = F.coalesce(c, F.lit(""))
    has = body.rlike(STATUS_OLD)
    said = strip(F.regexp_replace(body, STATUS_OLD, ""))
    none = F.array().cast("array<string>")
    joined = lambda all_, n: strip(F.array_join(F.slice(all_, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "\n"))
    reason = lambda when, r: F.when(F.coalesce(when, F.lit(False)), F.array(r)).otherwise(none)
    made = lambda d, r: F.struct(d.alias("display"), F.concat(r, reason(d == "", F.lit("empty_after_cleanup"))).alias("reasons"), has.alias("has_status_block"))

    def sections(all_: Column, rows: Column, kept: Column, why: Column) -> Column:
        own = F.filter(rows, lambda r: r["i"] <= kept)
        at = F.struct(_first(own, lambda r: r["scope"].isNotNull()).alias("o"), F.get(F.filter(own, lambda r: r["scope"].isNotNull()), F.lit(0))["scope"].alias("scope"), _first(own, lambda r: r["kind"].isNotNull() & ~(r["blank"] & ~_separator(all_, r["i"]))).alias("first"))

        def out(a: Column) -> Column:
            hidden = F.struct(F.lit("").alias("display"), F.concat(why, F.array(F.concat(F.lit("hidden_optional_section_only:"), a["scope"]))).alias("reasons"), has.alias("has_status_block"))
            short = let(joined(all_, _last(rows, lambda r: (r["i"] < a["o"]) & ~r["blank"])), lambda d: made(d, F.concat(why, F.array(F.concat(F.lit("trimmed_optional_section_tail:"), a["scope"])))))
            return F.when(a["o"].isNull(), let(joined(all_, kept), lambda d: made(d, why))).when(a["o"] == a["first"], hidden).otherwise(short)

        return let(at, out)

    def footers(x: Column) -> Column:
        all_, rows = x["all"], x["rows"]

        def trimmed(n: Column) -> Column:
            left = F.filter(rows, lambda r: r["i"] <= n)

            def closed(cut: Column) -> Column:
                kept = F.when(cut.isNotNull(), _last(left, lambda r: (r["i"] < cut) & ~r["blank"])).otherwise(n)
                why = F.concat(reason(n < F.size(all_), F.lit("trimmed_legacy_footer")), reason(cut.isNotNull(), F.lit("trimmed_trailing_service_block")))
                return let(F.struct(kept.alias("k"), why.alias("w")), lambda y: sections(all_, rows, y["k"], y["w"]))

            return let(_cut(left), closed)

        return let(_last(rows, lambda r: ~(r["blank"] | r["lead"])), trimmed)

    plain = let(lines(said), lambda a: let(F.struct(a.alias("all"), F.transform(a, _marked).alias("rows")), footers))
    empty = F.struct(F.lit("").alias("display"), F.array(F.lit("empty_after_status_strip")).alias("reasons"), has.alias("has_status_block"))
    return F.when(said == "", empty).when(has, F.struct(said.alias("display"), none.alias("reasons"), has.alias("has_status_block"))).otherwise(plain)


def _separator(all_: Column, i: Column) -> Column:
    return F.get(all_, i - 1).rlike(SEPARATOR)


def display_action(kind: Column, content: Column, shown: Column) -> Column:
    """keep, trim or hide: what the filter does to a message. Others than replies stay."""
    return F.when(kind != "bot_reply", "keep").when(shown == "", "hide").when(shown == F.coalesce(content, F.lit("")), "keep").otherwise("trim")


# ---------------------------------------------------------------- status
def scope_name(c: Column) -> Column:
    """body, appendix, acknowledgements, references, done or none, by any of the ways they were written; else null."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    exact = (("appendix", ("appendix", "appendices")), ("acknowledgements", ("acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments")), ("references", ("reference", "references")), ("body", ("body", "main_body", "body_only")), ("done", ("done", "all_done")), ("none", ("none",)))
    within = (("appendix", "附录|补充材料|supplement"), ("acknowledgements", "致谢|acknowledg"), ("references", "参考文献|references|bibliograph"), ("body", "正文|主体"))
    out = F.when(t == "", None)
    for name, words in exact:
        out = out.when(t.isin(*words), name)
    for name, pattern in within:
        out = out.when(t.rlike(pattern), name)
    return out


def scope_list(c: Column) -> Column:
    """The known extensions in a list or its JSON, in their fixed order."""
    parts = F.when(F.startswith(strip(F.coalesce(c, F.lit(""))), F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.split(F.coalesce(c, F.lit("")), r"[,|;/，、]+"))
    return let(F.transform(parts, scope_name), lambda found: F.filter(F.array(*map(F.lit, EXTENSIONS)), lambda s: F.array_contains(found, s)))


def command(action: Column, target: Column) -> Column:
    return F.concat(F.lit("[COMMAND]\naction="), action, F.lit("\ntarget="), target, F.lit("\n[/COMMAND]"))


def _pairs(rows: Column) -> Column:
    """Lines key=value as structs, key in lower case; each line is taken apart once."""
    return F.transform(rows, lambda r: F.struct(F.lower(strip(F.substring_index(r, "=", 1))).alias("k"), strip(F.regexp_extract(r, r"(?s)=(.*)$", 1)).alias("v"), F.contains(r, F.lit("=")).alias("given")))


def _value(pairs: Column, name: str) -> Column:
    """The last value of a key; null if it is not there."""
    return F.try_element_at(F.filter(pairs, lambda r: r["given"] & (r["k"] == name)), F.lit(-1))["v"]


def command_fields(c: Column) -> Column:
    """(action, target) of a command block; null where they are not given."""
    rows = lines(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\[COMMAND\]\s*(.*?)\s*\[/COMMAND\]", 1))
    return let(_pairs(rows), lambda r: F.struct(_value(r, "action").alias("action"), _value(r, "target").alias("target")))


def scope_of_command(c: Column) -> Column:
    """What a free text asks to go on with; empty if nothing is said."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(t.rlike("附录|appendix|supplement"), "appendix").when(t.rlike("致谢|acknowledg"), "acknowledgements").when(t.rlike("参考文献|references|bibliograph"), "references").when(t.rlike("继续|continue"), "body").otherwise("")


def status_lines(c: Column, long_command: bool = True) -> Column:
    """The twelve values of a status block as a struct of texts, empty where not given; null without a block.

    long_command: the command may go on over more lines, blank ones included, up to the next known key.
    """
    block = F.regexp_extract(F.coalesce(c, F.lit("")), STATUS_OLD, 1)

    def made(x: Column) -> Column:
        rows, pairs = x["rows"], x["pairs"]
        values = {k: F.coalesce(_value(pairs, k), F.lit("")) for k in STATUS_KEYS}
        if long_command:
            named = F.transform(pairs, lambda r, i: F.struct((i + 1).alias("i"), F.when(r["given"], r["k"]).otherwise("").alias("k")))
            at = F.struct(_last(named, lambda r: r["k"] == "next_action_command").alias("p"), named.alias("named"))

            def text(a: Column) -> Column:
                end = F.coalesce(_first(a["named"], lambda r: (r["i"] > a["p"]) & r["k"].isin(*STATUS_KEYS)), F.size(rows) + 1)
                more = F.transform(F.slice(rows, (a["p"] + 1).cast("int"), F.greatest(end - a["p"] - 1, F.lit(0)).cast("int")), lambda r: F.regexp_replace(r, r"(?U)\s+$", ""))
                return F.when(a["p"] > 0, strip(F.array_join(F.concat(F.array(F.regexp_extract(F.get(rows, a["p"] - 1), r"=(.*)$", 1)), more), "\n"))).otherwise("")

            values["next_action_command"] = let(at, text)
        return F.struct(*(v.alias(k) for k, v in values.items()))

    split = let(lines(block), lambda r: F.struct(r.alias("rows"), _pairs(r).alias("pairs")))
    return F.when(F.coalesce(c, F.lit("")).rlike(STATUS_OLD), let(split, made))


STATUS_JSON_FIELDS = "struct<" + ",".join(f"{k}:string" for k in STATUS_KEYS) + ",source:string,next_action:struct<type:string,command:string,target_scope:string>>"


def old_status(content: Column, payload: Column, long_command: bool = True) -> Column:
    """(origin, status): from the payload's status, else from the block in the text, else missing."""
    stored = payloads.parsed(payloads.key(payload, "translation_status"), STATUS_JSON_FIELDS)
    empty = F.lit(None).cast("string")
    as_json = lambda b: F.struct(*(b[k].alias(k) for k in STATUS_KEYS), empty.alias("source"), F.struct(*(empty.alias(k) for k in ("type", "command", "target_scope"))).alias("next_action"))
    pair = lambda o, s: F.struct(F.lit(o).alias("origin"), s.cast(STATUS_JSON_FIELDS).alias("status"))
    choose = lambda x: F.when(x["stored"].isNotNull(), pair("payload.translation_status", x["stored"])).when(x["block"].isNotNull(), pair("content.translation_status_block", as_json(x["block"]))).otherwise(pair("missing", F.lit(None)))
    return let(F.struct(stored.alias("stored"), status_lines(content, long_command).alias("block")), choose)


def _clean(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def status_v2(s: Column) -> Column:
    """(reason, status) of an old status in the form of version 2: ok, or why it is refused and null."""
    return let(s, _version_2)


def _version_2(s: Column) -> Column:
    def fields(x: Column) -> Column:
        said = F.lower(_clean(F.coalesce(x["type"], x["action"])))
        kind = F.when(said == "custom_message", "continue").otherwise(said)
        named = F.coalesce(F.nullif(scope_name(F.coalesce(x["to"], x["target"])), F.lit("none")), F.lit(""))
        scope = F.coalesce(F.nullif(named, F.lit("")), scope_of_command(x["command"]))
        phase = F.coalesce(F.nullif(scope_name(s["phase"]), F.lit("none")), F.lit(""))
        return F.struct(kind.alias("kind"), scope.alias("scope"), phase.alias("phase"), F.upper(_clean(s["state"])).alias("state"), scope_list(s["available_scope_extensions"]).alias("extensions"))

    def made(f: Column) -> Column:
        going = (f["kind"] == "") & (f["state"] == "IN_PROGRESS")
        kind = F.when(f["kind"] != "", f["kind"]).when(going, "continue").otherwise("stop")
        fallback = F.when(f["phase"].isin("body", *EXTENSIONS), f["phase"]).otherwise("body")
        scope = F.when(going & (f["scope"] == ""), fallback).otherwise(f["scope"])
        none = F.when(kind == "stop", "none").otherwise("")
        commands = F.map_from_arrays(f["extensions"], F.transform(f["extensions"], lambda e: F.element_at(F.create_map(*(F.lit(v) for kv in EXTENSIONS.items() for v in kv)), e)))
        out = F.struct(
            F.coalesce(F.nullif(_clean(s["scope"]), F.lit("")), F.lit("body_only")).alias("scope"), *(_clean(s[k]).alias(k) for k in ("completed", "current", "next", "remaining")), f["state"].alias("state"), f["phase"].alias("phase"), f["extensions"].alias("available_scope_extensions"),
            F.struct(kind.alias("type"), command(kind, F.coalesce(F.nullif(scope, F.lit("")), F.lit("none"))).alias("command"), F.coalesce(F.nullif(scope, F.lit("")), none).alias("target_scope")).alias("next_action"), commands.alias("extension_commands"),
            F.lower(_clean(s["recommended_stop_reason"])).alias("recommended_stop_reason"), F.lit("backfill_v2").alias("source"), f["state"].isin("BODY_DONE", "ALL_DONE").alias("is_completed"), (f["state"] == "ALL_DONE").alias("is_all_done"),
        )
        why = F.when(~f["state"].isin("IN_PROGRESS", "BODY_DONE", "ALL_DONE"), "invalid_state").when((f["kind"] != "") & ~f["kind"].isin("continue", "stop"), "invalid_next_action_type").when((kind == "continue") & (scope == ""), "missing_target_scope").otherwise("ok")
        return F.struct(why.alias("reason"), F.when(why == "ok", out).alias("status"))

    given = lambda k, old: F.coalesce(s["next_action"][k], s[old])
    raw = _clean(F.when(s["next_action"].isNotNull() & s["next_action"]["command"].isNotNull(), s["next_action"]["command"]).otherwise(s["next_action_command"]))
    parts = let(command_fields(raw), lambda f: F.struct(given("type", "next_action_type").alias("type"), given("target_scope", "next_action_target_scope").alias("to"), raw.alias("command"), f["action"].alias("action"), f["target"].alias("target")))
    found = let(let(parts, fields), made)
    return F.when(s.isNotNull(), found).otherwise(F.struct(F.lit("missing_translation_status").alias("reason"), F.lit(None)).cast(_V2))


_V2 = (
    "struct<reason:string,status:struct<scope:string,completed:string,current:string,next:string,remaining:string,state:string,phase:string,available_scope_extensions:array<string>,next_action:struct<type:string,command:string,target_scope:string>,"
    "extension_commands:map<string,string>,recommended_stop_reason:string,source:string,is_completed:boolean,is_all_done:boolean>>"
)


def migrated_status(content: Column, payload: Column) -> Column:
    """(state, phase, available_scope_extensions, next_action, recommended_stop_reason, is_completed, is_all_done) for the
    migration: the block in the text first, a stored status only if it was no guess. Any state but none is taken."""
    stored = payloads.parsed(payloads.key(payload, "translation_status"), STATUS_JSON_FIELDS)
    block = status_lines(content, long_command=False)

    def made(s: Column, action: dict[str, Column]) -> Column:
        state, phase = F.upper(_clean(s["state"])), scope_name(s["phase"])
        return F.when(state != "", F.struct(
            state.alias("state"), F.when(phase.isin("body", *EXTENSIONS, "done"), phase).otherwise("").alias("phase"), scope_list(s["available_scope_extensions"]).alias("available_scope_extensions"),
            F.struct(F.lower(_clean(action["type"])).alias("type"), _clean(action["command"]).alias("command"), F.coalesce(scope_name(action["target_scope"]), F.lit("")).alias("target_scope")).alias("next_action"),
            _clean(s["recommended_stop_reason"]).alias("recommended_stop_reason"), F.lit("status_block").alias("source"), state.isin("BODY_DONE", "ALL_DONE").alias("is_completed"), (state == "ALL_DONE").alias("is_all_done"),
        ))

    flat = lambda s: {k: s[f"next_action_{k}"] for k in ("type", "command", "target_scope")}
    nested = lambda s: {k: F.coalesce(s["next_action"][k], s[f"next_action_{k}"]) for k in ("type", "command", "target_scope")}
    guess = F.lower(_clean(stored["source"])) == "heuristic"
    return F.coalesce(let(block, lambda b: made(b, flat(b))), F.when(~guess, let(stored, lambda b: made(b, nested(b)))))
