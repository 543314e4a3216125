"""Captions and graphic regions of pages: which regions a caption can own, as a join by page, and whole pages as rows whose
blocks, captions and groups of regions are arrays, judged by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import FIGURE, TABLE, adjacent, caption_label, compact, digit_ratio, has_caption_suffix, has_line_numbers, is_paragraph, let, near_same, overlap, strip
from corpuscope.operators import store

# Fixed values, in points and shares of the page.
MIN_WIDTH, MIN_HEIGHT, NEAREST, FARTHEST, SHARE, CENTRE = 40, 16, -6, 260, 0.25, 30
BOX = ("x0", "y0", "x1", "y1")
GROUP_GAP, TABLE_GROUP_GAP, CONTEXT_GAP, PADDING, TEXT_WIDTH, TEXT_HEIGHT, MARGIN = 40, 56, 14, 8, 24, 8, 28
BIG_AREA, BIG_WIDTH, BIG_HEIGHT, ONE_COLUMN, COLUMN_PADDING = 0.16, 0.78, 0.22, 0.55, 24


def graphic_regions(regions: DataFrame) -> DataFrame:
    """Regions large enough for a figure. Drawings that fill much of a page don't count."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    huge = (w * h > 0.16 * F.col("page_w") * F.col("page_h")) | ((w >= 0.78 * F.col("page_w")) & (h >= 0.22 * F.col("page_h")))
    return regions.where((w >= MIN_WIDTH) & (h >= MIN_HEIGHT) & ~((F.col("kind") == "drawing") & huge))


def region_score(regions: DataFrame) -> DataFrame:
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return regions.withColumn("score", F.when(F.col("kind") == "image", 2.0).otherwise(1.4) + F.when(w >= 140, 0.5).otherwise(0.0) + F.when(h >= 60, 0.5).otherwise(0.0) + F.least(w * h / 12000.0, F.lit(6.0)))


def candidates(captions: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page, caption_id, region_id, direction, distance): regions above or below a caption of their page, near
    enough and in its column. Pages are small, so the join by page stays in proportion to the regions."""
    c = captions.select("doc_id", "page", "caption_id", *(F.col(x).alias(f"c_{x}") for x in BOX))
    r = regions.select("doc_id", "page", "region_id", *BOX)
    j = c.join(r, ["doc_id", "page"]).withColumn("direction", F.explode(F.array(F.lit("above"), F.lit("below"))))
    distance = F.when(F.col("direction") == "above", F.col("c_y0") - F.col("y1")).otherwise(F.col("y0") - F.col("c_y1"))
    across = overlap(F.col("c_x0"), F.col("c_x1"), F.col("x0"), F.col("x1")) >= SHARE * F.least(F.col("c_x1") - F.col("c_x0"), F.col("x1") - F.col("x0"))
    middle = (F.col("c_x0") + F.col("c_x1")) / 2
    inside = middle.between(F.col("x0") - CENTRE, F.col("x1") + CENTRE)
    return j.withColumn("distance", distance).where(F.col("distance").between(NEAREST, FARTHEST) & (across | inside)).select("doc_id", "page", "caption_id", "region_id", "direction", "distance")


def matches(captions: DataFrame, regions: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """The best single region of each caption: in each direction by score less 0.02 of the distance (an overlap counts as
    nearer), then above unless the other's score alone is better by over 0.5. directions (doc_id, direction): documents
    whose captions are said to stand above or below, of which only regions in that direction count. Groups of regions: see
    page_assets()."""
    found = candidates(captions, regions)
    if directions is not None:
        found = found.join(directions.select("doc_id", F.col("direction").alias("_only")), "doc_id", "left").where("_only IS NULL OR _only = direction").drop("_only")
    scored = found.join(region_score(regions).select("doc_id", "page", "region_id", "score"), ["doc_id", "page", "region_id"])
    near = scored.withColumn("value", F.col("score") - 0.02 * F.col("distance"))
    keys = ["doc_id", "page", "caption_id"]
    best = near.groupBy(*keys, "direction").agg(F.max_by(F.struct("region_id", "score"), F.struct("value", -F.col("region_id"))).alias("b"))
    side = lambda d: F.max(F.when(F.col("direction") == d, F.col("b"))).alias(d)
    both = best.groupBy(*keys).agg(side("above"), side("below"))
    above = F.col("below").isNull() | (F.col("above.score") >= F.col("below.score") - 0.5)
    chosen = F.when(F.coalesce(above, F.lit(False)), F.struct("above.region_id", F.lit("above").alias("direction"))).otherwise(F.struct("below.region_id", F.lit("below").alias("direction")))
    return both.withColumn("c", chosen).select(*keys, "c.region_id", "c.direction")


def direction_vote(matched: DataFrame) -> DataFrame:
    """Where a document's captions stand: the more frequent direction; null on a tie."""
    n = matched.groupBy("doc_id").agg(F.count_if(F.col("direction") == "above").alias("above"), F.count_if(F.col("direction") == "below").alias("below"))
    return n.withColumn("direction", F.when(F.col("above") > F.col("below"), "above").when(F.col("below") > F.col("above"), "below"))


# ---------------------------------------------------------------- whole pages
#: What pages are: one row each. Blocks of type 0 hold lines of text, those of type 1 are images.
PAGE = "doc_id long, page int, page_w double, page_h double, blocks array<struct<type:int,x0:double,y0:double,x1:double,y1:double,lines:array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>>>, drawings array<struct<x0:double,y0:double,x1:double,y1:double>>"
_EDGES = "x0:double,y0:double,x1:double,y1:double"
_LINES = f"array<struct<text:string,{_EDGES}>>"
_TEXT = f"struct<{_EDGES},text:string,lines:{_LINES}>"
_CAPTION = f"struct<{_EDGES},text:string,label:string>"
#: Of a region: whether it is text, what it adds to a group's score, and its area.
_REGION = "struct<y0:double,x0:double,i:int,x1:double,y1:double,is_text:boolean,score:double,area:double>"
_GROUP = f"struct<{_EDGES},members:array<int>,score:double,area:double,texts:int>"
_FOUND = f"struct<place:int,label:string,caption:string,{_EDGES},cx0:double,cy0:double,cx1:double>"
#: kind: vertical gap within a group, and how much better below must be.
RULES = {"figure": (GROUP_GAP, 0.5), "table": (TABLE_GROUP_GAP, 0.75)}


def _list(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def _height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def _same(a: Column, b: Column) -> Column:
    return near_same({e: a[e] for e in BOX}, {e: b[e] for e in BOX})


def _beside(a: Column, b: Column, across: float, down: float) -> Column:
    return adjacent({e: a[e] for e in BOX}, {e: b[e] for e in BOX}, across, down)


def _in_column(r: Column, c: Column) -> Column:
    """Whether c, a caption, stands over or under a box."""
    middle = (c["x0"] + c["x1"]) / 2
    return (overlap(r["x0"], r["x1"], c["x0"], c["x1"]) >= SHARE * F.greatest(F.lit(1.0), F.least(_width(r), _width(c)))) | middle.between(r["x0"] - CENTRE, r["x1"] + CENTRE)


def _joined(a: Column, b: Column) -> list[Column]:
    """The edges of the least box round two."""
    return [F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1")]


def _around(boxes: Column) -> list[Column]:
    """The edges of the least box round all of an array."""
    return [(F.array_min if e in ("x0", "y0") else F.array_max)(_edge(boxes, e)).alias(e) for e in BOX]


def _edge(boxes: Column, e: str) -> Column:
    return F.transform(boxes, lambda b: b[e])


def _caption_start(text: Column, name: str) -> Column:
    return text.rlike(rf"(?i)^\s*(?:{name})\b")


def _table_label(text: Column) -> Column:
    return strip(F.regexp_extract(text, rf"(?i)^\s*({TABLE})\b", 1))


def _joined_text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def _texts(blocks: Column) -> Column:
    """Blocks of text with their lines that are not blank, runs of white space as one blank."""
    line = lambda x: F.struct(compact(F.coalesce(x["text"], F.lit(""))).alias("text"), *(x[e].cast("double").alias(e) for e in BOX))
    lines = lambda b: F.filter(F.transform(F.coalesce(b["lines"], _list(f"struct<text:string,{_EDGES}>")), line), lambda x: x["text"] != "")
    text = lambda b: let(lines(b), lambda rows: F.struct(*(b[e].cast("double").alias(e) for e in BOX), _joined_text(rows).alias("text"), rows.alias("lines")))
    return F.filter(F.transform(F.filter(F.coalesce(blocks, F.array()), lambda b: b["type"] == 0), text), lambda t: t["text"] != "").cast(f"array<{_TEXT}>")


def _in_order(regions: Column) -> Column:
    """Regions from top to bottom and left to right, of nearly equal ones the first alone, numbered."""
    placed = F.array_sort(F.transform(regions, lambda r, i: F.struct(r["y0"], r["x0"], i.cast("int").alias("i"), r["x1"], r["y1"], r["is_text"], r["score"], r["area"])))
    apart = F.aggregate(placed, _list(_REGION), lambda kept, r: F.when(F.exists(kept, lambda o: _same(r, o)), kept).otherwise(F.concat(kept, F.array(r.cast(_REGION)))))
    return F.transform(apart, lambda r, i: r.withField("i", i.cast("int")))


def _region(b: Column, is_text: Column | bool, score: Column) -> Column:
    return F.struct(b["y0"].cast("double").alias("y0"), b["x0"].cast("double").alias("x0"), F.lit(0).alias("i"), b["x1"].cast("double").alias("x1"), b["y1"].cast("double").alias("y1"), F.lit(is_text).alias("is_text"), score.cast("double").alias("score"), (_width(b) * _height(b)).cast("double").alias("area")).cast(_REGION)


def _large(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: (_width(b) >= MIN_WIDTH) & (_height(b) >= MIN_HEIGHT))


def _graphics() -> Column:
    """Images and drawings large enough for a figure, but for drawings that fill much of the page."""
    w, h = F.col("page_w"), F.col("page_h")
    size = lambda b: F.when(_width(b) >= 140, 0.5).otherwise(0.0) + F.when(_height(b) >= 60, 0.5).otherwise(0.0)
    huge = lambda b: (_width(b) * _height(b) > BIG_AREA * w * h) | ((_width(b) >= BIG_WIDTH * F.greatest(F.lit(1.0), w)) & (_height(b) >= BIG_HEIGHT * F.greatest(F.lit(1.0), h)))
    images = F.transform(_large(F.filter(F.coalesce("blocks", F.array()), lambda b: b["type"] == 1)), lambda b: _region(b, False, 2.0 + size(b)))
    drawn = F.transform(F.filter("_drawn", lambda b: ~huge(b)), lambda b: _region(b, False, 1.4 + size(b)))
    return _in_order(F.concat(images, drawn))


def _first_caption(t: Column) -> Column:
    """The place (from 1) of the first line that starts as a table's caption; 0 if none does."""
    return F.array_position(F.transform(t["lines"], lambda x: has_caption_suffix(x["text"])), True).cast("int")


def _table_regions() -> Column:
    """Text that may be a table's, above a caption's line if there is one, and drawings."""
    h = F.col("page_h")

    def part(t: Column) -> Column:
        return let(_first_caption(t), lambda at: F.when(at > 0, F.slice(t["lines"], F.lit(1), at - 1)).otherwise(t["lines"]))

    def judged(rows: Column) -> Column:
        return let(F.struct(*_around(rows), _joined_text(rows).alias("text"), rows.alias("lines"), F.size(rows).alias("n")), lambda x: x.withField("digits", digit_ratio(x["text"])))

    def good(x: Column) -> Column:
        named = _caption_start(x["text"], FIGURE) | _caption_start(x["text"], TABLE)
        margin = (x["n"] <= 2) & ((x["y1"] <= MARGIN) | (x["y0"] >= h - MARGIN))
        small = (_width(x) < TEXT_WIDTH) | (_height(x) < TEXT_HEIGHT) | ((x["n"] <= 2) & (_width(x) < 120) & (_height(x) < 20) & (x["digits"] < 0.2))
        return ~(named | margin | small | has_line_numbers(_edge(x["lines"], "text")) | (is_paragraph(x["text"], x["n"]) & (x["digits"] < 0.05)))

    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    score = lambda x: 1.5 + yes(_width(x) >= 140, 0.8) + yes(x["digits"] >= 0.08, 1.4) + yes(x["n"] <= 3, 0.3) - yes(is_paragraph(x["text"], x["n"]), 2.5)
    parts = F.filter(F.transform("_texts", part), lambda rows: F.size(rows) > 0)
    texts = F.transform(F.filter(F.transform(parts, judged), good), lambda x: _region(x, True, score(x)))
    return _in_order(F.concat(F.transform("_drawn", lambda b: _region(b, False, F.lit(1.2))), texts))


def _ordered(captions: Column) -> Column:
    """Captions from top to bottom and left to right."""
    placed = F.array_sort(F.transform(captions, lambda c, i: F.struct(c["y0"], c["x0"], i.alias("i"), c.alias("c"))))
    return F.transform(placed, lambda x: x["c"]).cast(f"array<{_CAPTION}>")


def _figure_captions() -> Column:
    named = F.transform("_texts", lambda t: F.struct(*(t[e].alias(e) for e in BOX), t["text"].alias("text"), caption_label(t["text"], FIGURE).alias("label")))
    return _ordered(F.filter(named, lambda c: c["label"].isNotNull() & (c["label"] != "")))


def _table_captions() -> Column:
    """Whole blocks, then blocks from the line that starts like a caption on; each with narrow text close below."""
    whole = F.transform(F.filter("_texts", lambda t: has_caption_suffix(t["text"])), lambda t: F.struct(*(t[e].alias(e) for e in BOX), t["text"].alias("text"), _table_label(t["text"]).alias("label")).cast(_CAPTION))

    def part(t: Column) -> Column:
        rows = lambda at: F.slice(t["lines"], at, F.size(t["lines"]))
        made = lambda r: F.struct(*_around(r), _joined_text(r).alias("text"), _table_label(F.get(r, F.lit(0))["text"]).alias("label"))
        return let(_first_caption(t), lambda at: F.when(at > 0, let(rows(F.greatest(at, F.lit(1))), made)))

    parts = F.filter(F.transform("_texts", part), lambda c: c.isNotNull()).cast(f"array<{_CAPTION}>")
    found = F.aggregate(parts, whole, lambda kept, c: F.when(F.exists(kept, lambda o: _same(c, o)), kept).otherwise(F.concat(kept, F.array(c.cast(_CAPTION)))))

    def grown(c: Column) -> Column:
        def more(g: Column, t: Column) -> Column:
            close = (t["y0"] - g["y1"]).between(-1, 18) & (_width(t) <= F.least(F.lit(140.0), _width(g) * 0.33))
            takes = close & ~_same(t, c) & _in_column(t, g) & ~_caption_start(t["text"], TABLE)
            return F.when(takes, F.struct(*_joined(g, t), F.concat_ws(" ", g["text"], t["text"]).alias("text"), g["label"].alias("label")).cast(_CAPTION)).otherwise(g)

        return F.aggregate("_texts", c.cast(_CAPTION), more)

    return F.transform(_ordered(found), grown)


# ---------------------------------------------------------------- groups
def _value(g: Column, kind: str) -> Column:
    """The score of a group of regions."""
    if kind == "figure":
        return g["score"] + F.when(F.size(g["members"]) >= 2, 0.8).otherwise(0.0) + F.least(g["area"] / 12000, F.lit(6.0))
    return g["score"] + F.when(g["texts"] >= 2, 1.2).otherwise(0.0)


def _with(g: Column, r: Column) -> Column:
    return F.struct(*_joined(g, r), F.concat(g["members"], F.array(r["i"])).alias("members"), (g["score"] + r["score"]).alias("score"), (g["area"] + r["area"]).alias("area"), (g["texts"] + r["is_text"].cast("int")).alias("texts"))


def _grown(seed: Column, near: Column, down: float) -> Column:
    """The group that grows from a region: whatever stands beside its box joins it, until nothing does. Each round goes
    through all regions; there are as many as regions at most, and none after one that adds nothing."""
    first = F.struct(*(seed[e].alias(e) for e in BOX), F.array(seed["i"]).alias("members"), seed["score"].alias("score"), seed["area"].alias("area"), seed["is_text"].cast("int").alias("texts"))
    state = lambda g, n: F.struct(g.alias("g"), n.cast("int").alias("n"))  # noqa: E731  n: members before the last round, -1 before any

    def once(g: Column) -> Column:
        return F.aggregate(near, g, lambda a, r: F.when(~F.array_contains(a["members"], r["i"]) & _beside(a, r, GROUP_GAP, down), _with(a, r)).otherwise(a))

    def round_(s: Column, _: Column) -> Column:
        return F.when(s["n"] == F.size(s["g"]["members"]), s).otherwise(state(once(s["g"]), F.size(s["g"]["members"])))

    return F.when(F.size(near) == 1, first).otherwise(F.aggregate(near, state(first, F.lit(-1)), round_)["g"])


def _toward(c: Column, regions: Column, used: Column, up: bool, kind: str) -> Column:
    """The best group of regions above or below a caption, null if there is none: grown from each region that is near
    enough and in its column, and judged by score less 0.02 of the first one's distance."""
    distance = lambda r: (c["y0"] - r["y1"]) if up else (r["y0"] - c["y1"])
    near = F.filter(regions, lambda r: ~F.array_contains(used, r["i"]) & distance(r).between(NEAREST, FARTHEST) & _in_column(r, c))
    judged = lambda some: F.transform(some, lambda r: let(_grown(r, some, RULES[kind][0]), lambda g: F.struct((_value(g, kind) - 0.02 * distance(r)).alias("value"), -r["i"].alias("i"), g.alias("g"))))
    return F.array_max(let(near, judged))["g"]


def _pick(c: Column, regions: Column, used: Column, kind: str, direction: Column) -> Column:
    """(taken, above, below): the groups of a caption, the one in the given direction if there is one, else above unless
    below is better by a margin; null where there is none."""
    both = F.struct(_toward(c, regions, used, True, kind).alias("above"), _toward(c, regions, used, False, kind).alias("below"))

    def chosen(b: Column) -> Column:
        a, o = b["above"], b["below"]
        up = _value(a, kind) >= _value(o, kind) - RULES[kind][1]
        taken = F.when((direction == "above") & a.isNotNull(), a).when((direction == "below") & o.isNotNull(), o).when(a.isNull() | o.isNull(), F.coalesce(a, o)).when(up, a).otherwise(o)
        return F.struct(taken.alias("taken"), a.alias("above"), o.alias("below"))

    return let(both, chosen)


def _with_regions(pages: DataFrame) -> DataFrame:
    """pages with the captions and regions of each kind."""
    w = pages.withColumns({"page_w": F.col("page_w").cast("double"), "page_h": F.col("page_h").cast("double"), "_texts": _texts(F.col("blocks")), "_drawn": _large(F.coalesce("drawings", _list(f"struct<{_EDGES}>")))})
    return w.withColumns({"_figure_regions": _graphics(), "_table_regions": _table_regions(), "_figure_captions": _figure_captions(), "_table_captions": _table_captions()})


def page_votes(pages: DataFrame) -> DataFrame:
    """(doc_id, kind, direction): by the votes of all captions of a document; null on a tie. A caption speaks for the side
    on which alone it has matches, and of figures also for the better side if that leads by 0.75. Tables use up what they
    take. Pages are judged one by one, as expressions over their rows; only the votes are gathered."""
    return _votes(_with_regions(pages))


def _each(found: Column) -> Column:
    """The elements of an array as rows, and null for none: an inner explode() makes Spark work the array out twice more for a
    filter on its size."""
    return F.explode_outer(found)


def _votes(regions: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")

    def votes(kind: str) -> Column:
        def one(s: Column, c: Column) -> Column:
            def counted(p: Column) -> Column:
                a, b = p["above"], p["below"]
                lead = _value(a, "figure") - _value(b, "figure") if kind == "figure" else F.lit(0.0)
                vote = F.when(a.isNotNull() & b.isNull(), 1).when(a.isNull() & b.isNotNull(), -1).when(a.isNull(), 0).when(lead >= 0.75, 1).when(lead <= -0.75, -1).otherwise(0)
                used = F.concat(s["used"], F.coalesce(p["taken"]["members"], _list("int"))) if kind == "table" else s["used"]
                return F.struct(used.alias("used"), (s["votes"] + vote).cast("int").alias("votes"))

            return let(_pick(c, F.col(f"_{kind}_regions"), s["used"], kind, none), counted)

        return F.aggregate(f"_{kind}_captions", F.struct(_list("int").alias("used"), F.lit(0).alias("votes")), one)["votes"]

    counted = F.array(*(F.struct(F.lit(k).alias("kind"), votes(k).alias("n")) for k in RULES))
    each = regions.select("doc_id", _each(counted).alias("v")).select("doc_id", "v.*")
    n = each.groupBy("doc_id", "kind").agg(F.sum("n").alias("n"))
    return n.select("doc_id", "kind", F.when(F.col("n") > 0, "above").when(F.col("n") < 0, "below").alias("direction"))


def _clipped(b: Column) -> Column:
    return F.struct(F.greatest(F.lit(0.0), b["x0"] - PADDING).alias("x0"), F.greatest(F.lit(0.0), b["y0"] - PADDING).alias("y0"), F.least(F.col("page_w"), b["x1"] + PADDING).alias("x1"), F.least(F.col("page_h"), b["y1"] + PADDING).alias("y1"))


def _frame(f: Column, kind: str) -> Column:
    """The final rectangle of what was found: figures take in text close to them and keep to a narrow caption's column;
    tables keep to it. cx0, cy0, cx1: the caption's edges."""
    w = F.col("page_w")
    share = (f["cx1"] - f["cx0"]) / F.greatest(F.lit(1.0), w)
    edges = F.struct(*(f[e].alias(e) for e in BOX))
    span = lambda b, x0, x1: F.struct(x0.alias("x0"), b["y0"].alias("y0"), x1.alias("x1"), b["y1"].alias("y1"))
    if kind == "figure":
        context = F.filter("_texts", lambda t: ~_caption_start(t["text"], FIGURE) & ~_caption_start(t["text"], TABLE))

        def more(b: Column, t: Column) -> Column:
            inside = ((t["x0"] + t["x1"]) / 2).between(b["x0"] - CONTEXT_GAP, b["x1"] + CONTEXT_GAP) & ((t["y0"] + t["y1"]) / 2).between(b["y0"] - CONTEXT_GAP, b["y1"] + CONTEXT_GAP)
            return F.when((t["y0"] < f["cy0"]) & inside & _beside(b, t, CONTEXT_GAP, CONTEXT_GAP), F.struct(*_joined(b, t))).otherwise(b)

        grown = let(F.aggregate(context, edges, more), _clipped)
        return let(grown, lambda b: F.when(share >= 0.6, b).otherwise(span(b, F.greatest(F.lit(0.0), F.least(b["x0"], f["cx0"] - PADDING)), F.least(b["x1"], w, f["cx1"] + 12))))
    narrow = span(edges, F.greatest(edges["x0"], F.lit(0.0), f["cx0"] - 10), F.least(edges["x1"], w, f["cx1"] + 10))
    wide = span(edges, F.greatest(F.lit(0.0), F.least(edges["x0"], f["cx0"] - COLUMN_PADDING)), F.least(w, F.greatest(edges["x1"], f["cx1"] + COLUMN_PADDING)))
    return let(F.when(share < ONE_COLUMN, narrow).when(share < 0.85, wide).otherwise(edges), _clipped)


def page_assets(pages: DataFrame, directions: DataFrame | None = None) -> DataFrame:
    """Figures and tables of documents: (doc_id, page, kind, label, caption, x0, y0, x1, y1, pixel_width, pixel_height,
    asset_index). pages: rows like PAGE; directions: see page_votes(), found here if not given.

    On a page, captions take regions from top to bottom, each region once. Indexes count a document's figures and tables
    each. Pages without captions or regions give nothing; doubled pages count twice. A page is one row, judged by
    expressions over its arrays; only directions and indexes need rows of a document together.
    """
    regions = store.written(_with_regions(pages), "pages")
    directions = _votes(regions) if directions is None else directions
    by_doc = directions.groupBy("doc_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("direction"))).alias(f"_{k}_direction") for k in RULES))

    def found(kind: str) -> Column:
        def one(s: Column, c: Column) -> Column:
            def taken(p: Column) -> Column:
                g = p["taken"]
                row = F.struct(s["place"].alias("place"), c["label"].alias("label"), c["text"].alias("caption"), *(g[e].alias(e) for e in BOX), c["x0"].alias("cx0"), c["y0"].alias("cy0"), c["x1"].alias("cx1")).cast(_FOUND)
                some = g.isNotNull()
                return F.struct((s["place"] + 1).alias("place"), F.when(some, F.concat(s["used"], g["members"])).otherwise(s["used"]).alias("used"), F.when(some, F.concat(s["found"], F.array(row))).otherwise(s["found"]).alias("found"))

            return let(_pick(c, F.col(f"_{kind}_regions"), s["used"], kind, F.col(f"_{kind}_direction")), taken)

        return F.aggregate(f"_{kind}_captions", F.struct(F.lit(0).alias("place"), _list("int").alias("used"), _list(_FOUND).alias("found")), one)["found"]

    named = lambda kind: F.transform(found(kind), lambda f: F.struct(F.lit(kind).alias("kind"), f["place"].alias("place"), f["label"].alias("label"), f["caption"].alias("caption"), _frame(f, kind).alias("box")))
    rows = regions.join(by_doc, "doc_id", "left").select("doc_id", "page", _each(F.concat(*(named(k) for k in RULES))).alias("a")).where("a IS NOT NULL").select("doc_id", "page", "a.*")
    size = lambda a, b: F.ceil(2 * (F.col(f"box.{b}") - F.col(f"box.{a}"))).cast("int")  # noqa: E731  rendered at twice the size
    order = Window.partitionBy("doc_id", "kind").orderBy("page", "place")  # assets of one document
    out = rows.select("doc_id", "page", "place", "kind", "label", "caption", *(F.col(f"box.{e}").alias(e) for e in BOX), size("x0", "x1").alias("pixel_width"), size("y0", "y1").alias("pixel_height"))
    return out.withColumn("asset_index", F.row_number().over(order)).drop("place")
