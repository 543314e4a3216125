"""Formula marks of texts as Column expressions: brackets round formulas become marks, and marked formulas are set aside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscope.functions.text import let, strip

# What looks like a formula, and how formulas are marked: in blocks, and within a line.
MATH = r"\\[a-zA-Z]+|[_^=+\-*/{}0-9]|[A-Za-z]\([A-Za-z0-9]+\)"
INLINE, BLOCK = r"\\\([^\\]*+(?:\\[^)\n][^\\]*+)*+\\\)", r"(?s)\\\[.*?\\\]|\\\(.*?\\\)"
_STATE = "struct<mark:string,block:array<string>,out:array<string>>"


def looks_like_math(c: Column) -> Column:
    return c.rlike(MATH)


def _inline(line: Column) -> Column:
    """Plain brackets round formulas as marks; those that are marked already stay. The line is cut into marked formulas,
    brackets without brackets in them, and what is between."""
    parts = F.regexp_extract_all(line, F.lit(INLINE + r"|\([^()\n]+\)|[^\\(]+|[\\(]"), F.lit(0))

    def one(t: Column) -> Column:
        inner = strip(F.substring(t, 2, F.length(t) - 2))
        return F.when(t.rlike(r"(?s)^\([^()]+\)$") & looks_like_math(inner), F.concat(F.lit("\\("), inner, F.lit("\\)"))).otherwise(t)

    return F.array_join(F.transform(parts, one), "")


def _closing(mark: Column) -> Column:
    return F.when(mark == "\\[", "\\]").otherwise("]")


def math_marks(c: Column) -> Column:
    """Formulas in square brackets, on one line or over several, and in round ones within a line, with formula marks. A
    block that is not closed takes the rest of the text as it is. The lines are gone through once; a block's lines are
    held until it closes."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    made = lambda mark, block, out: F.struct(mark.alias("mark"), block.alias("block"), out.alias("out")).cast(_STATE)

    def closed(s: Column, line: Column) -> Column:
        rows, close = F.concat(s["block"], F.array(line)), _closing(s["mark"])
        whole = F.array_join(rows, "\n")
        from_ = F.instr(whole, s["mark"]) + F.length(s["mark"])
        upto = F.length(whole) - F.instr(F.reverse(whole), F.reverse(close)) - F.length(close) + 2
        formula = strip(F.substring(whole, from_, upto - from_))
        return F.when(looks_like_math(formula), F.array(F.concat(F.lit("\\[\n"), formula, F.lit("\n\\]")))).otherwise(rows)

    def step(s: Column, line: Column) -> Column:
        said = strip(line)
        mark = F.when(F.startswith(said, F.lit("\\[")), "\\[").when(F.startswith(said, F.lit("[")), "[")
        close = _closing(mark)
        opens = mark.isNotNull() & ((said == mark) | ~F.contains(said, close))
        formula = strip(F.substring(said, F.length(mark) + 1, F.length(said) - 2 * F.length(mark)))
        one = F.when(looks_like_math(formula), F.concat(F.lit("\\["), formula, F.lit("\\]"))).otherwise(line)
        plain = F.when(mark.isNotNull() & F.endswith(said, F.lit("]")), one).otherwise(_inline(line))
        inside = F.when(F.contains(line, _closing(s["mark"])), made(none, empty, F.concat(s["out"], closed(s, line)))).otherwise(made(s["mark"], F.concat(s["block"], F.array(line)), s["out"]))
        return F.when(s["mark"].isNotNull(), inside).when(opens, made(mark, F.array(line), s["out"])).otherwise(made(none, empty, F.concat(s["out"], F.array(plain))))

    state = F.aggregate(F.split(c, "\n"), made(none, empty, empty), step)
    return let(state, lambda s: F.array_join(F.concat(s["out"], s["block"]), "\n"))


def set_aside(c: Column) -> Column:
    """(text, formulas): each marked formula as a numbered token, and the formulas in order."""
    found = F.regexp_extract_all(c, F.lit(BLOCK), F.lit(0))
    token = lambda piece, i: F.concat(piece, F.when(i < F.size(found), F.concat(F.lit("@@MATH_"), i.cast("string"), F.lit("@@"))).otherwise(""))
    text = F.array_join(F.transform(F.split(c, BLOCK, -1), token), "")
    return F.when(c.isNotNull(), F.struct(text.alias("text"), found.alias("formulas")))


def put_back(c: Column, formulas: Column) -> Column:
    """A text with its tokens as the formulas they stand for; tokens of no formula stay."""
    ids = F.regexp_extract_all(c, F.lit(r"@@MATH_(\d+)@@"), F.lit(1))
    own = lambda i: F.coalesce(F.get(formulas, F.get(ids, i).try_cast("int")), F.concat(F.lit("@@MATH_"), F.get(ids, i), F.lit("@@")))
    return F.array_join(F.transform(F.split(c, r"@@MATH_\d+@@", -1), lambda piece, i: F.concat(piece, F.when(i < F.size(ids), own(i)).otherwise(""))), "")
