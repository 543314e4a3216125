"""Line differences and formula marks of texts, which need whole texts at a time: pandas UDFs over Arrow batches."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
MATH = re.compile(r"\\[a-zA-Z]+|[_^=+\-*/{}0-9]|[A-Za-z]\([A-Za-z0-9]+\)")
INLINE = re.compile(r"\\\((?:\\.|[^\\])*?\\\)|\(([^()\n]+)\)")
BLOCKS = re.compile(r"\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)")


def looks_like_math(text: str) -> bool:
    return bool(MATH.search(text))


def _inline(line: str) -> str:
    """Plain brackets round formulas as formula marks; those that are marked already stay."""
    return INLINE.sub(lambda m: f"\\({m[1].strip()}\\)" if m[1] and looks_like_math(m[1].strip()) else m[0], line)


def normal_math(text: str) -> str:
    """Formulas in square brackets, on one line or over several, and in round ones within a line, with formula marks. A
    block that is not closed takes the rest of the text as it is."""
    rows, out, i = text.split("\n"), [], 0
    while i < len(rows):
        said = rows[i].strip()
        mark = next((m for m in ("\\[", "[") if said.startswith(m)), None)
        close = {"\\[": "\\]", "[": "]"}.get(mark)
        if mark and (said == mark or close not in said):
            end = next((j for j in range(i + 1, len(rows)) if close in rows[j]), None)
            block = rows[i:] if end is None else rows[i : end + 1]
            whole = "\n".join(block)
            formula = whole[whole.index(mark) + len(mark) : whole.rindex(close)].strip() if end is not None else ""
            out += [f"\\[\n{formula}\n\\]"] if looks_like_math(formula) else block
            i = len(rows) if end is None else end + 1
            continue
        if mark and said.endswith(close[-1]):
            formula = said[len(mark) : len(said) - len(mark)].strip()
            out.append(f"\\[{formula}\\]" if looks_like_math(formula) else rows[i])
        else:
            out.append(_inline(rows[i]))
        i += 1
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def normalised_math(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normal_math(t))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("formulas", _LIST)]))
def protected_math(texts: pd.Series) -> pd.DataFrame:
    """Texts with each marked formula as a numbered token, and the formulas."""

    def one(t):
        found: list[str] = []

        def token(m):
            found.append(m[0])
            return f"@@MATH_{len(found) - 1}@@"

        return (None, None) if t is None else (BLOCKS.sub(token, t), found)

    rows = [one(t) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "formulas": [r[1] for r in rows]})


@F.pandas_udf(T.StringType())
def restored_math(texts: pd.Series, formulas: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else re.sub(r"@@MATH_(\d+)@@", lambda m: f[int(m[1])], t) for t, f in zip(texts, formulas)])


# ---------------------------------------------------------------- differences
def deleted(original: str, shown: str) -> list[str]:
    return [x[2:] for x in difflib.ndiff((original or "").splitlines(), (shown or "").splitlines()) if x.startswith("- ")]


@F.pandas_udf(_LIST)
def deleted_lines(original: pd.Series, shown: pd.Series) -> pd.Series:
    return pd.Series([deleted(a, b) for a, b in zip(original, shown)])


def _head(message, conversation, action, reasons) -> tuple[str, str]:
    return f"message_id={message} conversation_id={conversation} action={action}", f"reasons={','.join(reasons) if reasons is not None and len(reasons) else '-'}"


@F.pandas_udf(T.StringType())
def deleted_view(message: pd.Series, conversation: pd.Series, action: pd.Series, reasons: pd.Series, original: pd.Series, shown: pd.Series) -> pd.Series:
    out = []
    for m, c, a, r, o, s in zip(message, conversation, action, reasons, original, shown):
        gone = deleted(o, s) or ((o or "").splitlines() if a == "hide" else []) or ["[no deleted lines captured]"]
        out.append("\n".join([*_head(m, c, a, r), "deleted:", *(f"- {x or '[blank line]'}" for x in gone), ""]))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def diff_view(message: pd.Series, conversation: pd.Series, action: pd.Series, reasons: pd.Series, original: pd.Series, shown: pd.Series) -> pd.Series:
    out = []
    for m, c, a, r, o, s in zip(message, conversation, action, reasons, original, shown):
        diff = list(difflib.unified_diff((o or "").splitlines(), (s or "").splitlines(), f"message:{m}:original", f"message:{m}:display", n=3, lineterm=""))
        out.append("\n".join(["# " + " ".join(_head(m, c, a, r)), *(diff or ["[no diff lines captured]"]), ""]))
    return pd.Series(out)


def register(spark) -> None:
    """The functions of this module, and the rows of HTML tables, under names that SQL can use."""
    from pyspark.sql.functions import udtf

    from corpuscope.sources.catalogue import table_rows

    for f in (normalised_math, protected_math, restored_math, deleted_lines):
        spark.udf.register(f.__name__, f)

    @udtf(returnType="row_no int, cells array<string>")
    class HtmlRows:
        def eval(self, html: str, element_id: str):
            yield from enumerate(table_rows(html or "", element_id or None))

    spark.udtf.register("html_rows", HtmlRows)
