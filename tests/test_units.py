"""Rules of texts, progress, writes and streams on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from corpuscope.functions import progress, text
from corpuscope.operators import filters, search, venues, writes
from corpuscope.sources import catalogue
from corpuscope.streaming import jobs


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("title, prefix", [("Appendix A.1 x", "appendix a.1"), ("A.1. S", "a.1"), ("A. Add", "a"), ("1 METHOD", "1"), ("1.1 Setup", "1.1"), ("III. R", "iii"), ("I. R", "i"), ("ABSTRACT", ""), ("3 METHOD :: 3.1 Setup", ""), (None, "")])
def test_hierarchy_prefix(spark, title, prefix):
    assert one(spark, title, text.hierarchy_prefix) == prefix


@pytest.mark.parametrize("units, top", [
    (["ABSTRACT", "1 METHOD", "1.1 Setup", "1.2 Training"], ["ABSTRACT", "1 METHOD"]),
    (["Supplementary Material", "A. x", "A.1. y", "A.2. z", "B. x", "B.1. y"], ["A. x", "B. x"]),
    (["3 M", "3 M :: 3.1 S"], ["3 M :: 3.1 S"]), (["Appendix"], ["Appendix"]), ([], []),
])
def test_top_units(spark, units, top):
    assert spark.createDataFrame([(units,)], "u array<string>").select(text.top_units(F.col("u")).alias("y")).first().y == top


@pytest.mark.parametrize("said, kind", [("继 续", "continue_command"), ("hello", "user_message"), (None, "user_message"), ("a　b", "system_prompt")])
def test_kind_by_text(spark, said, kind):
    assert one(spark, said, lambda x: text.inferred_kind(F.lit(None).cast("string"), F.lit("nope"), F.lit("user"), x, ("a b",))) == kind


@pytest.mark.parametrize("said, section", [("# 摘要\nx", "abstract"), ("1. Intro\nReferences:", "references"), ("Appendix A", "appendix"), ("text", "body"), ("---\n \n", None), (None, None)])
def test_section(spark, said, section):
    assert one(spark, said, text.section) == section


def test_texts(spark):
    assert one(spark, "　a \n", text.strip) == "a"
    assert one(spark, "```x```# Abstract\n\n* one\ntwo  three\n## Next\nno", text.abstract) == "one two three"
    assert one(spark, "aaa bbb ccc", lambda x: text.abstract(x, 9)) == "aaa bbb"
    assert one(spark, "l3, M4;L3 X9 p12", text.tag_codes) == ["L3", "M4", "P12"]
    assert one(spark, "x" * 201, lambda x: text.summary(x, "-")) == "x" * 200 + "..."
    assert one(spark, "ACM & the Art of 'X'", text.venue_name) == "and art x"
    assert [one(spark, v, lambda x: text.safe_int(x, 7, 1)) for v in ("3", "-2", "x", None, "2.7")] == [3, 1, 7, 7, 7]
    assert one(spark, '[TRANSLATION_STATUS_JSON]{"state":"odd"}[/TRANSLATION_STATUS_JSON]', text.status_block) is None


def test_status(spark):
    cases = [([], "OK", "IN_PROGRESS", "body", "ABSTRACT"), (["ABSTRACT", "1 I"], "OK", "BODY_DONE", "appendix", "APP"), (["1 I", "APP", "ABSTRACT"], "OK", "ALL_DONE", "done", ""), (["ABSTRACT"], "UNSUPPORTED", "UNSUPPORTED", "body", "")]
    for done, raw, state, scope, following in cases:
        row = spark.createDataFrame([(["ABSTRACT", "1 I"], ["APP"], done)], "u array<string>, a array<string>, d array<string>")
        s = row.select(progress.status(F.lit("ok"), F.col("u"), F.col("a"), F.col("d"), F.lit("1 I"), F.lit("body"), F.lit(raw), F.lit("r")).alias("s")).first().s
        assert (s.state, s.active_scope, s.next_unit_id) == (state, scope, following)
    entries = [(" a ", [" x", "x", "y", "z", "w"], "y"), ("a", ["q"], None), ("b", [""], None), ("c", ["k"], "other")]
    got = spark.createDataFrame([(entries,)], "e array<struct<term:string,candidates:array<string>,selected:string>>").select(progress.glossary_entries(F.col("e")).alias("g")).first().g
    assert [(g.term, g.candidates, g.selected) for g in got] == [("a", ["x", "y", "z"], "y"), ("c", ["k"], "k")]


def test_filters(spark):
    papers = spark.range(4).select("id")
    meta = spark.createDataFrame([(0, "A"), (1, "None"), (2, "B")], "conversation_id long, ccf_category string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(filters.by_category(papers, meta, ["None"])) == [1, 3]
    assert ids(filters.by_category(papers, meta, ["A"])) == [0]
    assert ids(filters.by_category(papers, meta, ["Z"])) == [0, 1, 2, 3]
    assert filters.normalised([" a", None, "a", ""], upper=True) == ["A"] and filters.years(["2020", "x", " 2020"]) == [2020]


def test_search_wildcards(spark):
    papers = spark.createDataFrame([(1, "50% more", 1), (2, "50 of more", 2), (3, None, 3)], "id long, title string, created_at long")
    assert [r.id for r in search.exact(papers, "50% MORE").collect()] == [2, 1]
    assert [(r.id, r.relevance) for r in search.fuzzy(papers, "more money more").collect()] == [(1, 8), (2, 8)]
    assert [(r.id, r.relevance) for r in search.fuzzy(papers, "more money", word_bonus=True).collect()] == [(1, 9), (2, 9)]


def test_venues(spark):
    pubs = spark.createDataFrame([("x", 0, "CVPR", "Conference on Computer Vision"), ("y", 1, "ICCV", "International Conference on Computer Vision"), ("z", 2, "TOG", "Graphics")], "item string, position int, abbr string, full_name string")
    names = spark.createDataFrame([("IEEE cvpr",), ("computer vision",), ("ACM Graphics Letters",), ("nothing",), (None,)], "name string")
    got = {r.name: r.item for r in venues.resolve(names, pubs).collect()}
    assert got == {"IEEE cvpr": "x", "computer vision": None, "ACM Graphics Letters": "z", "nothing": None, None: None}


def test_writes(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, v string, created_at long")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k long, v string, created_at long")
    assert sorted(map(tuple, writes.upsert(old, new, "k").collect())) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
    assert sorted(r.k for r in writes.replace_by_key(old, old.select("k"), new.where("k = 3"), "k").collect()) == [3]
    assert [r.k for r in writes.changed(old, old.withColumn("v", F.nullif("v", F.lit("b"))), "k").collect()] == [2]
    writes.publish(spark, {"t": old}, str(tmp_path))
    writes.publish(spark, {"t": new}, str(tmp_path))
    assert writes.published(spark, str(tmp_path), "t").count() == 2
    bundle = spark.createDataFrame([("f", None, " ")], "filename string, fingerprint string, poe_url string")
    assert writes.bundle_error(bundle).first().error == "missing: fingerprint, poe_url"


def test_files_and_html(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"")
    assert [r.fingerprint[:4] for r in catalogue.files(spark, str(tmp_path)).select("fingerprint").collect()] == ["2d71"]
    html = "<table><tr><td>skip</td></tr></table><div id='v'><div><table><tr><th>1</th><td>AB</td><td>A  Big\nOne</td><td>A</td><td>会议</td><td>f</td></tr><tr><td>n</td></tr></table></div></div>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<table><tr>")], "id long, html string")
    assert [tuple(r)[2:] for r in catalogue.venue_list(pages, "id", element_id="v").collect()] == [("AB", "A Big One", "A", "conference", "f")]


def test_stream_is_batch(spark, tmp_path):
    from corpuscope.plans.catalogue import job_events
    from conftest import SF

    events = job_events(spark, SF).withColumn("at", F.col("at").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}
    q = jobs.stream_job_states(read).writeStream.outputMode("update").foreachBatch(lambda df, _: got.update({r.job_id: tuple(r) for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == {r.job_id: tuple(r) for r in jobs.job_states(events).collect()}


@pytest.mark.parametrize("name", ["detail_assembly", "bundle_figures"])
def test_no_array_of_a_whole_group(spark, name):
    from conftest import SF

    from corpuscope.plans.catalogue import QUERIES

    assert "collect_list" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_numbered_children_of_a_large_key(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("conversation_id"), F.nullif(19_999 - F.col("id"), F.lit(3)).cast("int").alias("figure_index"), F.col("id").alias("asset"))
    got = writes.numbered_children(rows, "figures", ["figure_index", "asset"]).where("conversation_id = -1").orderBy("position").collect()
    assert [r.position for r in got] == list(range(18_000))
    assert [r.asset for r in got] == [19_996, *(i for i in range(19_999, -1, -1) if i % 10 and i != 19_996)]


def test_details_of_a_checked_size(spark):
    papers = spark.createDataFrame([(1,), (2,)], "id long")
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "conversation_id long, turn long, text string")
    got = {r.id: [m.text for m in r.messages] for r in search.details(papers, messages=(rows, "turn")).collect()}
    assert got == {1: ["a", "b"], 2: []}
    with pytest.raises(Exception, match="more than 1 messages"):
        search.details(papers, most=1, messages=(rows, "turn")).collect()
    assert {r.id: r.n for r in search.child_counts(papers, n=rows).collect()} == {1: 2, 2: 0}


def test_tag_codes_of_the_whole_text(spark, tmp_path):
    from corpuscope.plans.catalogue import QUERIES

    spark.createDataFrame([(5, "word " * 30 + "M4 end")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert "M4" in QUERIES["tag_codes"](spark, str(tmp_path)).first().codes.split(",")


def test_strip_of_long_texts(spark):
    """White space of all kinds goes from both ends, and the time for it does not grow with the blanks within."""
    import time

    texts = ["", " ", "\n 　", "a", " a b \r\n ", "\u0085x\n\ny\t", None, "\U0001f600 z \U0001f600 "]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(text.strip(F.col("t"))).collect()]
    assert got == [None if x is None else x.strip() for x in texts]
    one = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 60_000), F.lit("b")).alias("t"))
    began = time.time()
    assert one.select(F.length(text.strip(F.col("t")))).first()[0] == 60_002
    assert time.time() - began < 5
