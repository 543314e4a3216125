"""Pages as expressions against the same pages judged one by one in plain Python."""

import random

import page_oracle
import pytest
from conftest import SF
from test_rules import page

from corpuscope.operators import layout
from corpuscope.plans import rules
from corpuscope.plans.catalogue import QUERIES


def drawn_pages(seed, n):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        blocks = []
        for _ in range(draw.randrange(0, 14)):
            x, y = draw.choice([40, 60, 300, 320]) + draw.randrange(8), draw.randrange(0, 760)
            w, h = draw.choice([15, 60, 130, 200, 250, 520]), draw.choice([6, 12, 24, 60, 150])
            if draw.random() < 0.4:
                blocks.append((1, float(x), float(y), float(x + w), float(y + h), None))
                continue
            said = draw.choice([["Figure %d: some"], ["see Fig. %d more"], ["Table %d"], ["Table %d. Numbers", "of it"], ["1 2 3 %d", "4 5 6"], ["words of   text %d"], ["%d"], ["", "  "], ["x %d", "Table 3: inner", "1 2"], ["Running text, of many words; with marks. %d"] * 4, ["letters and letters that go on 12 3%d"] * 5])
            rows = [((t % i if "%" in t else t), float(x), float(y + 10 * k), float(x + w), float(y + 10 * k + h)) for k, t in enumerate(said)]
            blocks.append((0, float(x), float(y), float(x + w), float(y + 10 * (len(rows) - 1) + h), rows))
        drawings = [(float(a), float(b), float(a + draw.choice([30, 80, 500])), float(b + draw.choice([10, 40, 300]))) for a, b in ((draw.randrange(0, 400), draw.randrange(0, 600)) for _ in range(draw.randrange(0, 4)))]
        out.append((i // 3, i, 600.0, 800.0, blocks or draw.choice([None, []]), drawings or draw.choice([None, []])))
    return out


def rows_of(assets):
    return sorted((r.doc_id, r.page, r.kind, r.label, r.caption, *(round(r[e], 6) for e in layout.BOX), r.pixel_width, r.pixel_height) for r in assets.collect())


def hold(pages):
    rows = pages.collect()
    votes = page_oracle.votes(rows)
    assert {(r.doc_id, r.kind): r.direction for r in layout.page_votes(pages).collect()} == votes
    want = page_oracle.assets(rows, votes)
    got = layout.page_assets(pages)
    assert rows_of(got) == sorted((d, p, k, label, said, *(round(x, 6) for x in rest[:4]), *rest[4:]) for d, p, _, k, label, said, *rest in want)
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_pages(spark, seed):
    assert len(hold(spark.createDataFrame(drawn_pages(seed, 120), layout.PAGE))) > 40


def test_long_chains(spark):
    """Groups that grow region by region, from both ends, and pages with many of them."""
    chain = [(1, (100, 100 + 30 * i, 300, 120 + 30 * i), []) for i in range(9)]
    random.Random(3).shuffle(chain)
    apart = [(1, (400, 100 + 60 * i, 440, 118 + 60 * i), []) for i in range(5)]
    pages = page(spark, [*chain, *apart, (0, (100, 380, 300, 390), ["Figure 1. chain"]), (0, (380, 420, 460, 430), ["Figure 2. column"])])
    want = hold(pages)
    assert {r[4]: r[7] for r in want}["Figure 1"] == 92.0


def test_registered_pages(spark):
    """The query's own pages, judged again one by one."""
    assert len(hold(rules.page_rows(spark, SF))) > 100
    assert rows_of(QUERIES["figures_and_tables"](spark, SF)) == rows_of(layout.page_assets(rules.page_rows(spark, SF)))


def test_what_is_found_is_worked_out_once(spark):
    """No filter on the size of what is found, which would work it out again for each page."""
    plan = layout.page_assets(rules.page_rows(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not [x for x in plan.splitlines() if "Filter" in x and "aggregate(" in x]
