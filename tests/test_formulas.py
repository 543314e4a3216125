"""Formula marks as expressions against the same rules in plain Python, text by text."""

import random

from pyspark.sql import functions as F

from corpuscope.functions import formulas, markup

TEXTS = [
    "plain", "", None, "a (x+1) b (see there) c", "\\(a\\) (b_1) \\(c (d=2) \\)", "[x^2]", "[ see ]", "[x=1", "[\nx=1\n]", "\\[\nx\\alpha\n\\]", "\\[x=1\\]", "\\[\nwords\n\\] tail", "[\nwords\n\nmore", "  [ a = b ]  ", "[x] and [y]", "[1] text",
    "f(x) and g(n)", "((a=1) b)", "([x=1])", "\\[ a\nb=2 ] c \\] d\nnext (y=2)", "a\\", "\\(open (x=1)", "(a\\)b=1)", "[\n\\]\n]", "line\n\n(q=1)\n", "[]", "[\n]", "\\[\\]",
]


def random_texts(n):
    draw = random.Random(5)
    parts = ["(", ")", "[", "]", "\\(", "\\)", "\\[", "\\]", "x=1", "word", " ", "\n", "\\alpha", "f(x)", "a_b", "\n[\n", "\n]\n", "  "]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(n)]


def column(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.c for r in df.select("i", f(F.col("t")).alias("c")).orderBy("i").collect()]


def test_math_marks(spark):
    texts = [*TEXTS, *random_texts(1500)]
    got = column(spark, texts, formulas.math_marks)
    for t, g in zip(texts, got):
        assert g == (None if t is None else markup.normal_math(t)), repr(t)


def test_long_lines(spark):
    texts = ["(x=1) " * 20_000, "\\(" + "a" * 50_000 + "\\) (y=1)", "[\n" + "z=1\n" * 3000 + "]"]
    assert column(spark, texts, formulas.math_marks) == [markup.normal_math(t) for t in texts]


def test_formulas_set_aside(spark):
    texts = [t for t in [*TEXTS, *random_texts(500)] if t is not None]
    for t, r in zip(texts, column(spark, texts, formulas.set_aside)):
        found = markup.BLOCKS.findall(t)
        assert r.formulas == found and r.text.count("@@MATH_") == len(found)
    both = lambda c: formulas.put_back(formulas.set_aside(c)["text"], formulas.set_aside(c)["formulas"])
    assert column(spark, texts, both) == texts
    assert column(spark, ["@@MATH_7@@ x", None], lambda c: formulas.put_back(c, F.array(F.lit("a")))) == ["@@MATH_7@@ x", None]
    assert column(spark, [None], formulas.set_aside) == [None]
