"""Pages judged one by one in plain Python: what the page expressions are held against."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from corpuscope.functions.text import FIGURE, TABLE
from corpuscope.operators.layout import BIG_AREA, BIG_HEIGHT, BIG_WIDTH, BOX, CENTRE, COLUMN_PADDING, CONTEXT_GAP, FARTHEST, GROUP_GAP, MARGIN, MIN_HEIGHT, MIN_WIDTH, NEAREST, ONE_COLUMN, PADDING, SHARE, TABLE_GROUP_GAP, TEXT_HEIGHT, TEXT_WIDTH

_FIGURE, _TABLE = (re.compile(rf"^\s*({x})\b", re.I) for x in (FIGURE, TABLE))
_INNER = re.compile(rf"({FIGURE})\s*[:.]?", re.I)


@dataclass
class Region:
    """A box with what is known of it."""

    x0: float
    y0: float
    x1: float
    y1: float
    kind: str = ""
    text: str = ""
    label: str = ""
    lines: list = field(default_factory=list)

    @property
    def width(self) -> float:
        return self.x1 - self.x0

    @property
    def height(self) -> float:
        return self.y1 - self.y0

    def near_same(self, o: Region, tolerance: float = 6) -> bool:
        return all(abs(getattr(self, e) - getattr(o, e)) <= tolerance for e in BOX)

    def gap(self, o: Region, axis: str) -> float:
        return max(0.0, getattr(o, f"{axis}0") - getattr(self, f"{axis}1"), getattr(self, f"{axis}0") - getattr(o, f"{axis}1"))

    def shared(self, o: Region, axis: str) -> float:
        return max(0.0, min(getattr(self, f"{axis}1"), getattr(o, f"{axis}1")) - max(getattr(self, f"{axis}0"), getattr(o, f"{axis}0")))

    def beside(self, o: Region, across: float, down: float) -> bool:
        return (self.shared(o, "x") > 0 and self.gap(o, "y") <= down) or (self.shared(o, "y") > 0 and self.gap(o, "x") <= across)

    def in_column(self, o: Region) -> bool:
        """Whether o, a caption, stands over or under this box."""
        return self.shared(o, "x") >= SHARE * max(1.0, min(self.width, o.width)) or self.x0 - CENTRE <= (o.x0 + o.x1) / 2 <= self.x1 + CENTRE

    def clipped(self, w: float, h: float) -> Region:
        return Region(max(0.0, self.x0 - PADDING), max(0.0, self.y0 - PADDING), min(w, self.x1 + PADDING), min(h, self.y1 + PADDING))


def union(boxes: list[Region], **more) -> Region:
    return Region(min(b.x0 for b in boxes), min(b.y0 for b in boxes), max(b.x1 for b in boxes), max(b.y1 for b in boxes), **more)


def _in_order(boxes: list[Region], apart: bool = True) -> list[Region]:
    """From top to bottom and left to right; apart: of nearly equal ones the first alone."""
    out: list[Region] = []
    for b in sorted(boxes, key=lambda b: (b.y0, b.x0)):
        if not apart or not any(b.near_same(o) for o in out):
            out.append(b)
    return out


def _styled(text: str) -> re.Match | None:
    """A table's label that is followed as captions are: by nothing, a mark, a capital or a digit."""
    m = _TABLE.match(text)
    rest = text[m.end() :].lstrip() if m else ""
    return m if m and (not rest or rest[0] in ".:;,-(" or rest[0].isupper() or rest[0].isdigit()) else None


def _figure_label(text: str) -> str | None:
    if m := _FIGURE.match(text):
        return m[1].strip()
    m = _INNER.search(text)
    head = text[: m.start()] if m else ""
    return m[1].strip() if m and len(head) <= 48 and len(head.strip()) <= 24 and not set(head) & set(".:;!?") else None


def _digits(text: str) -> float:
    return sum(c.isdigit() for c in text) / len(text) if text else 0.0


def _paragraph(text: str, n: int) -> bool:
    return len(text) >= 120 and n >= 3 and sum(c.isalpha() for c in text) > 40 and sum(c in ",.;:()[]" for c in text) >= 2


def _numbered_lines(rows: list[str]) -> bool:
    n, letters = len(rows), sum(c.isalpha() for r in rows for c in r)
    ends, alone = (sum(bool(re.search(p, r)) for r in rows) for p in (r"\b\d{2,4}\s+\d{2,4}\s*$", r"^\d{2,4}$"))
    return n >= 4 and letters > 40 and (ends >= max(3, n // 2) or alone >= max(3, n // 3))


class Page:
    """One page: its regions and captions."""

    def __init__(self, row):
        self.w, self.h = float(row.page_w), float(row.page_h)
        self.texts, self.images = [], []
        for b in [] if row.blocks is None else row.blocks:
            box = Region(*(float(b[e]) for e in BOX))
            if b["type"] == 1:
                self.images.append(box)
            elif b["type"] == 0:
                lines = [Region(*(float(x[e]) for e in BOX), text=" ".join((x["text"] or "").split())) for x in ([] if b["lines"] is None else b["lines"])]
                box.lines = [x for x in lines if x.text]
                box.text = " ".join(x.text for x in box.lines)
                if box.text:
                    self.texts.append(box)
        drawn = [Region(*(float(d[e]) for e in BOX), kind="drawing") for d in ([] if row.drawings is None else row.drawings)]
        self.drawings = [d for d in drawn if d.width >= MIN_WIDTH and d.height >= MIN_HEIGHT]

    def graphics(self) -> list[Region]:
        images = [Region(i.x0, i.y0, i.x1, i.y1, "image") for i in self.images if i.width >= MIN_WIDTH and i.height >= MIN_HEIGHT]
        huge = lambda d: d.width * d.height > BIG_AREA * self.w * self.h or (d.width >= BIG_WIDTH * max(1.0, self.w) and d.height >= BIG_HEIGHT * max(1.0, self.h))
        return _in_order([*images, *(d for d in self.drawings if not huge(d))])

    def figure_captions(self) -> list[Region]:
        named = [(t, _figure_label(t.text)) for t in self.texts]
        return _in_order([Region(t.x0, t.y0, t.x1, t.y1, text=t.text, label=label) for t, label in named if label], apart=False)

    def table_captions(self) -> list[Region]:
        """Whole blocks, then blocks from the line that starts like a caption on; each with narrow text close below."""
        found = [Region(t.x0, t.y0, t.x1, t.y1, text=t.text, label=m[1].strip()) for t in self.texts if (m := _styled(t.text))]
        for t in self.texts:
            at = self.caption_line(t)
            if at is not None:
                part = union(t.lines[at:], text=" ".join(x.text for x in t.lines[at:]), label=_styled(t.lines[at].text)[1].strip())
                if not any(part.near_same(o) for o in found):
                    found.append(part)
        out = []
        for c in _in_order(found, apart=False):
            grown = c
            for t in self.texts:
                close = -1 <= t.y0 - grown.y1 <= 18 and t.width <= min(140.0, grown.width * 0.33)
                if close and not t.near_same(c) and t.in_column(grown) and not _TABLE.match(t.text):
                    grown = union([grown, t], text=f"{grown.text} {t.text}", label=c.label)
            out.append(grown)
        return out

    @staticmethod
    def caption_line(t: Region) -> int | None:
        return next((i for i, x in enumerate(t.lines) if _styled(x.text)), None)

    def context(self) -> list[Region]:
        return [t for t in self.texts if not _FIGURE.match(t.text) and not _TABLE.match(t.text)]

    def table_regions(self) -> list[Region]:
        """Text that may be a table's, above a caption's line if there is one, and drawings."""
        out = list(self.drawings)
        for t in self.texts:
            rows = t.lines[: self.caption_line(t)]
            text = " ".join(x.text for x in rows)
            if not text or _FIGURE.match(text) or _TABLE.match(text):
                continue
            box, n, digits = union(rows, kind="text", text=text, lines=rows), len(rows), _digits(text)
            margin = n <= 2 and (box.y1 <= MARGIN or box.y0 >= self.h - MARGIN)
            small = box.width < TEXT_WIDTH or box.height < TEXT_HEIGHT or (n <= 2 and box.width < 120 and box.height < 20 and digits < 0.2)
            if not (margin or small or _numbered_lines([x.text for x in rows]) or (_paragraph(text, n) and digits < 0.05)):
                out.append(box)
        return _in_order(out)


def _graphic_score(group: list[Region]) -> float:
    each = sum((2.0 if r.kind == "image" else 1.4) + 0.5 * (r.width >= 140) + 0.5 * (r.height >= 60) for r in group)
    return each + 0.8 * (len(group) >= 2) + min(sum(r.width * r.height for r in group) / 12000, 6.0)


def _table_score(group: list[Region]) -> float:
    score, texts = 0.0, [r for r in group if r.kind == "text"]
    for r in texts:
        score += 1.5 + 0.8 * (r.width >= 140) + 1.4 * (_digits(r.text) >= 0.08) + 0.3 * (len(r.lines) <= 3) - 2.5 * _paragraph(r.text, len(r.lines))
    return score + 1.2 * (len(group) - len(texts)) + 1.2 * (len(texts) >= 2)


#: score, vertical gap within a group, and how much better below must be
RULES = {"figure": (_graphic_score, GROUP_GAP, 0.5), "table": (_table_score, TABLE_GROUP_GAP, 0.75)}


def _toward(caption: Region, regions: list[Region], used: set[int], up: bool, kind: str) -> list[int]:
    """The best group of regions above or below a caption: grown from each candidate by what stands beside it, and judged
    by score less 0.02 of the first one's distance."""
    score, down, _ = RULES[kind]
    far = {i: caption.y0 - r.y1 if up else r.y0 - caption.y1 for i, r in enumerate(regions) if i not in used and r.in_column(caption)}
    far = {i: d for i, d in far.items() if NEAREST <= d <= FARTHEST}
    best, top = [], None
    for i, distance in far.items():
        group, box, more = {i}, regions[i], True
        while more:
            more = False
            for j in far:
                if j not in group and box.beside(regions[j], GROUP_GAP, down):
                    group.add(j)
                    box, more = union([box, regions[j]]), True
        value = score([regions[j] for j in sorted(group)]) - 0.02 * distance
        if top is None or value > top:
            best, top = sorted(group), value
    return best


def _pick(caption: Region, regions: list[Region], used: set[int], kind: str, direction: str | None = None) -> tuple[list[int], list[int], list[int]]:
    """(the regions taken, those above, those below)."""
    score, _, margin = RULES[kind]
    above, below = (_toward(caption, regions, used, up, kind) for up in (True, False))
    if direction in ("above", "below") and (above if direction == "above" else below):
        return (above if direction == "above" else below), above, below
    if not above or not below:
        return above or below, above, below
    up = score([regions[i] for i in above]) >= score([regions[i] for i in below]) - margin
    return (above if up else below), above, below


def _votes(page: Page, kind: str) -> tuple[int, int]:
    """How many captions speak for above and for below: those with matches on one side, and of figures also those whose
    better side leads by 0.75. Tables use up what they take."""
    captions, regions = (page.figure_captions(), page.graphics()) if kind == "figure" else (page.table_captions(), page.table_regions())
    votes, used = [0, 0], set()
    for c in captions:
        taken, above, below = _pick(c, regions, used, kind)
        if bool(above) != bool(below):
            votes[0 if above else 1] += 1
        elif above and kind == "figure":
            lead = _graphic_score([regions[i] for i in above]) - _graphic_score([regions[i] for i in below])
            votes[0] += lead >= 0.75
            votes[1] += lead <= -0.75
        if kind == "table":
            used.update(taken)
    return votes[0], votes[1]


def _frame(page: Page, box: Region, caption: Region, kind: str) -> Region:
    """The final rectangle: figures take in text close to them and keep to a narrow caption's column; tables keep to it."""
    share = caption.width / max(1.0, page.w)
    if kind == "figure":
        for t in page.context():
            x, y = (t.x0 + t.x1) / 2, (t.y0 + t.y1) / 2
            inside = box.x0 - CONTEXT_GAP <= x <= box.x1 + CONTEXT_GAP and box.y0 - CONTEXT_GAP <= y <= box.y1 + CONTEXT_GAP
            if t.y0 < caption.y0 and inside and box.beside(t, CONTEXT_GAP, CONTEXT_GAP):
                box = union([box, t])
        box = box.clipped(page.w, page.h)
        return box if share >= 0.6 else Region(max(0.0, min(box.x0, caption.x0 - PADDING)), box.y0, min(box.x1, page.w, caption.x1 + 12), box.y1)
    if share < ONE_COLUMN:
        box = Region(max(box.x0, 0.0, caption.x0 - 10), box.y0, min(box.x1, page.w, caption.x1 + 10), box.y1)
    elif share < 0.85:
        box = Region(max(0.0, min(box.x0, caption.x0 - COLUMN_PADDING)), box.y0, min(page.w, max(box.x1, caption.x1 + COLUMN_PADDING)), box.y1)
    return box.clipped(page.w, page.h)


def votes(rows) -> dict:
    """(doc_id, kind) -> direction of rows like PAGE."""
    n = Counter()
    for r in rows:
        for kind in RULES:
            up, down = _votes(Page(r), kind)
            n[r.doc_id, kind] += up - down
    return {k: "above" if v > 0 else "below" if v < 0 else None for k, v in n.items()}


def assets(rows, directions: dict) -> list[tuple]:
    """(doc_id, page, place, kind, label, caption, x0, y0, x1, y1, pixel_width, pixel_height) of what is on the pages."""
    out = []
    for r in rows:
        page = Page(r)
        for kind in RULES:
            captions, regions = (page.figure_captions(), page.graphics()) if kind == "figure" else (page.table_captions(), page.table_regions())
            used: set[int] = set()
            for place, c in enumerate(captions):
                taken, _, _ = _pick(c, regions, used, kind, directions.get((r.doc_id, kind)))
                if taken:
                    used.update(taken)
                    b = _frame(page, union([regions[i] for i in taken]), c, kind)
                    out.append((r.doc_id, r.page, place, kind, c.label, c.text, b.x0, b.y0, b.x1, b.y1, int(-(-2 * b.width // 1)), int(-(-2 * b.height // 1))))
    return out
