"""Quirks of single operators on fixtures of our own wording."""

import json
import timeit
import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from riskweave.functions import display as D
from riskweave.functions import fixed, lexicons, terms
from riskweave.functions import text as T
from riskweave.operators import extract as E
from riskweave.operators import metadata as M
from riskweave.operators import cache, figures, filters, ingest, records, store, warehouse, years
from riskweave.operators import summary as Y
from riskweave.plans import views
from riskweave.sources import corpus, search, sinks
from riskweave.sources.corpus import BLOCKS, RISK, Frames
from riskweave.streaming import ingest as stream

TEXT = "doc_id long, root_form string, text string"


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), TEXT)


def checked(spark, text):
    return E.check(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()


def test_section_check(spark):
    assert checked(spark, BLOCKS["fees"]).reason == "fee schedule"
    assert checked(spark, BLOCKS["thin"]).reason == "insufficient risk density"
    assert checked(spark, "Fee schedule: 1%.").reason == checked(spark, None).reason == checked(spark, "").reason == "too short"
    assert checked(spark, "bread and cheese " * 30).reason == "insufficient crypto content"
    good = checked(spark, RISK)
    assert good.reason == "" and 0 < good.confidence <= 1
    assert checked(spark, "risks losses bitcoins " * 30).risk_hits == 0


def test_boundary_pair_takes_the_body_not_the_contents(spark):
    text = BLOCKS["toc"] + BLOCKS["body"]
    got = texts(spark, (1, "10-K", text)).select(F.inline(E.boundary_spans(F.col("text"), "1A", "1B"))).collect()
    assert len(got) == 1 and got[0].size >= 1000 and "Item 1B" not in got[0].text
    quirk = texts(spark, (1, "10-K", "ITEM 1 A: first" + RISK * 2 + "\nITEM 1 B. end"), (2, "10-K", "\nITEM 1 A: first" + RISK * 2 + "\nITEM 1 B. end"))
    assert [r.n for r in quirk.select(F.size(E.boundary_spans(F.col("text"), "1A", "1B")).alias("n")).collect()] == [0, 1]


def test_prospectus_skips_references(spark):
    got = texts(spark, (1, "S-1", BLOCKS["fees"] + BLOCKS["prospectus"]), (2, "S-1", "Please see the Principal Risks " + RISK)).select("doc_id", F.inline(E.header_spans(F.col("text")))).collect()
    assert {r.doc_id for r in got} == {1} and all("Portfolio Turnover" not in r.text and "custody fee" not in r.text.lower() for r in got)


def test_strategies_and_dedup(spark):
    item = "\nItem 8.01 Other Events\n" + RISK
    rows = texts(spark, (1, "10-Q", BLOCKS["body"]), (2, "10-Q", BLOCKS["short"]), (3, "485APOS", BLOCKS["prospectus"]), (4, "8-K", item + item.replace("8.01", "7.01")), (5, "10-K", "nothing here " * 60), (6, "10-K", None), (7, "10-K", BLOCKS["toc"] + BLOCKS["body"]))
    found = E.candidates(rows)
    got = {(r.doc_id, r.strategy, r.section_type, r.title) for r in found.collect()}
    assert got == {
        (1, "B", "risk_factors", "Item 1A"), (2, "D", "risk_factors", "Item 1A (lenient)"), (3, "C", "principal_risks", "Principal Investment Risks"),
        (4, "A", "current_report_item", "Item 8.01"), (4, "A", "current_report_item", "Item 7.01"), (7, "A", "risk_factors", "TenK.risk_factors"),
    }
    best = E.distinct_best(found).collect()
    assert [(r.place, r.title) for r in best if r.doc_id == 4] == [(1, "Item 8.01")]  # the other is the same text
    assert E.distinct_best(found.unionByName(found)).count() == len(best)


def test_sections_of_a_report(spark):
    long = "words that fill a section of a report " * 20
    report = f"Part I\nItem 1A. Contents 4\nPart II\nItem 1A. Contents 9\nPart I\n Item 2. Discussion\n{long}see Item 1A for more\nPart II\nITEM 1. Suits\n{long}\nItem 1 A: Risks\n{long}{long}\nItem 6. Exhibits\nnone\n"
    rows = texts(spark, (1, "10-Q", "\n" + report), (2, "10-K", "\n" + report), (3, "8-K", f"\nItem 2.02 Results\nshort\nItem 9.01 Exhibits\n{long}\nItem 2.02 Results\n{long}{long}"), (4, "S-1", "\n" + report), (5, "10-K", None), (6, "10-Q", "Item 1A at the very start " + long))
    got = {}
    for r in rows.select("doc_id", F.inline(E.typed_sections(F.col("text"), F.col("root_form")))).collect():
        got.setdefault(r.doc_id, []).append((r.seq, r.section_type, r.title, r.text[:14], len(r.text) > 1000))
    assert got == {
        1: [(0, "risk_factors", "Part II, Item 1A", "Item 1 A: Risk", True), (1, "legal_proceedings", "Part II, Item 1", "ITEM 1. Suits\n", False), (2, "mda", "Part I, Item 2", "Item 2. Discus", False)],
        2: [(0, "risk_factors", "TenK.risk_factors", "Item 1 A: Risk", True), (2, "business", "TenK.business", "ITEM 1. Suits\n", False)],
        3: [(0, "current_report_item", "Item 2.02", "Item 2.02 Resu", True), (1, "current_report_item", "Item 9.01", "Item 9.01 Exhi", False)],
    }


def test_expressions_say_what_the_frames_say(spark):
    """The one-expression check and paragraph text against those over frames."""
    rows = texts(spark, *[(i, "D", t) for i, t in enumerate([*BLOCKS.values(), "", None, RISK * 30, "\n\n".join([RISK[:230]] * 400)])])
    hits = rows.withColumn("hits", terms.counted(E.sample(F.col("text"))))
    one = hits.select("doc_id", E.verdict(F.col("text"), F.col("hits")).alias("v")).select("doc_id", "v.*")
    assert sorted(map(tuple, one.collect())) == sorted((r.doc_id, r.reason, r.confidence) for r in E.check(rows).collect())
    own = {r.doc_id: r.t for r in E.with_scored(rows, F.lit(True)).select("doc_id", E.telling_paragraphs(F.col("scored")).alias("t")).collect()}
    of_frame = {r.doc_id: r.text for r in E.paragraph_text(rows.select("doc_id", "text"), "doc_id").collect()}
    assert {k: v for k, v in own.items() if v} == of_frame and 60_000 < len(of_frame[len(BLOCKS) + 3]) < 62_000


def test_index_counts_what_the_patterns_count(spark):
    """The index against each lexicon's own pattern, on words next to what Java's word boundary tells apart, and texts made of the terms."""
    words = ["risk", "RISKS", "materially", "material adverse", "adverse", "base fee schedule", "iXBRL", "Exhibits 4", "exhibit  4", "LIVE 1234567890", "crypto-assets", "crypto\nasset", "cryptoasset", "proof of work", "K", "kraken", "digital asset", "no assurance"]
    odd = ["", " ", "_", "\u0301", "\u200d", "\u203f", "\u00b2", "\u24b6", "\u0663", "é", "\u212araken ", "ri\u017fk ", "r\u0130sk ", "r\u0131sk ", "\U0001f600", "9", "\u0085", "\u2028"]
    made = [(i, a + x + b) for i, (a, x, b) in enumerate((a, x, b) for a in odd for x in words for b in odd)]
    made += [(len(made) + i, " ".join(words[(i * k) % len(words)] for k in range(40))) for i in range(40)] + [(-1, None), (-2, ""), (-3, "risk " * 200_000)]
    rows = spark.createDataFrame(made, "id long, t string")
    want = {r[0]: tuple(r[1:]) for r in rows.select("id", *[lexicons.count(F.col("t"), n) for n in terms.LEXICONS]).collect()}
    got = {r.id: tuple(r.c) if r.c else (None,) * 4 for r in rows.select("id", terms.counted("t").alias("c")).collect()}
    assert [(made[k][1], got[k], want[k]) for k in range(len(made) - 3) if got[k] != want[k]] == [] and got == want


def test_topics_of_a_text_are_those_of_the_pattern(spark):
    """Whether a text tells and the words of its connection, against patterns and counts; no pattern steps through the text for either."""
    words = ["bitcoin", "BTC", "crypto-assets", "crypto\nasset", "cryptoasset", "proof of work", "K", "\u212araken", "b\u0131tcoin", "BITCO\u0130N", "XRP", "DeFi", "digital assets", "risk", "loss", "method"]
    odd = ["", " ", "_", "\u0301", "\u200d", "é", "\U0001f600", "9"]
    made = [(i, a + x + b) for i, (a, x, b) in enumerate((a, x, b) for a in odd for x in words for b in odd)]
    made += [(len(made) + i, " ".join(words[(i * k) % len(words)] for k in range(40))) for i in range(40)] + [(-1, None), (-2, "")]
    rows = spark.createDataFrame(made, "id long, t string")
    plain = F.regexp_extract_all(F.col("t"), F.lit("(?idU)" + lexicons.body("crypto")), 0)
    got = rows.select("t", plain.alias("want"), terms.topics("t").alias("words"), terms.tells("t").alias("tells"), (terms.counted("t")).alias("c")).collect()
    assert [r for r in got if r.words != (None if r.want is None else list(dict.fromkeys(r.want)))] == []
    assert [r for r in got if r.tells != (None if r.c is None else r.c.crypto > 0 and r.c.risk > 0)] == []
    said = rows.select("id", M.connection(F.col("t"), F.lit("8-K")).alias("said"))
    assert "regexp_extract_all" not in said._jdf.queryExecution().executedPlan().toString()
    told = {r.id: r.said for r in said.collect()}
    assert told[-1] == told[-2] == "Crypto-related filing." and told[0] == "Discloses bitcoin material event or corporate action."


def test_index_of_units_and_places(spark):
    rows = spark.createDataFrame([(1, ["a risk", None, "", "bitcoin risk loss"]), (2, None), (3, []), (4, ["digital", "asset"])], "id long, u array<string>")
    got = {r.id: r.c and [x and tuple(x) for x in r.c] for r in rows.select("id", terms.counted_each("u").alias("c")).collect()}
    assert got == {1: [(0, 1, 0, 0), None, (0, 0, 0, 0), (1, 2, 0, 0)], 2: None, 3: [], 4: [(0, 0, 0, 0), (0, 0, 0, 0)]}
    text = "\U0001f600 Material adverse base fee table of contents"
    places = spark.createDataFrame([(text,), (None,)], "t string").select(terms.index("t").alias("x")).collect()
    assert [(terms.LEXICONS[x.lexicon], text[x.start : x.end]) for x in places[0].x] == [("risk", "Material adverse"), ("fee", "base fee"), ("boilerplate", "table of contents")] and places[1].x is None


def test_html(spark):
    page = "<head><title>x</title></head><table><tr><td>Table of Contents</td></tr><tr><td>Item 1</td><td>3</td></tr></table><p>One <b>bold</b> &amp; <br>two</p><script>bad()</script><table><tr><td>kept</td></tr></table>"
    assert T.page_text(page) == "One bold &\ntwo\n\nkept"
    assert T.page_text(None) == ""
    said = "Key Risks\n\nA <loss> may\n12\nfollow.\n\nTable of Contents\n\n- one\n- two\n- three.\n\nabc\n\nThe fee schedule"
    rows = spark.createDataFrame([(1, " Ñandú  ﬁn\x1f ", said), (2, None, None), (3, "", "")], "i int, a string, b string").orderBy("i").select(T.ascii_fold("a").alias("a"), T.risk_html(F.col("b")).alias("b")).collect()
    assert [r.a for r in rows] == ["Nandu fin", None, ""] and [r.b for r in rows[1:]] == ["", ""]
    assert rows[0].b == '<h4 class="risk">Key Risks</h4><p class="risk">A &lt;loss&gt; may follow.</p><p class="risk">- one<br>- two<br>- three.</p><p class="risk">The fee schedule</p>'


def test_upsert_keeps_what_may_not_change(spark):
    old = spark.createDataFrame([("a", "10-K", "Old"), ("b", "8-K", "Same")], "accession_no string, form_type string, company_name string")
    new = spark.createDataFrame([("a", "10-Q", "New"), ("c", "D", "Added")], old.schema)
    got = store.upsert(old, new)
    want = [("a", "10-K", "New"), ("b", "8-K", "Same"), ("c", "D", "Added")]
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, store.upsert(got, new).collect())) == want


def test_wrong_override_leaves_none(spark):
    sections = spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "accession_no string, id long, is_primary int")
    chosen = spark.createDataFrame([("a", 9)], "accession_no string, id long")
    assert [r.is_primary for r in store.set_primary(sections, chosen).collect()] == [0, 0]


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aB\\%_x", max_size=5))
def test_like_takes_backslashes_as_they_are(spark, needle):
    df = spark.createDataFrame([(needle.upper(),), (f"pre{needle}post",)], "company_name string")
    assert df.where(filters.contains_ci("company_name", needle)).count() == 2


def test_batches_and_hits(spark):
    assert [len(b) for b in ingest.keyword_batches()] == [58, 45, 39]
    hit = {"_id": "1-2:d.htm", "_source": {"adsh": "", "display_names": ["Ace & Co (NV) (CIK 0007)"], "form": "S-1/A", "ciks": ["0007"], "file_date": "2024-01-01"}}
    rows = spark.createDataFrame([(1, json.dumps(hit)), (2, "broken")], "okey long, hit string")
    got = ingest.parse_hits(rows).orderBy("okey").collect()
    assert (got[0].accession_no, got[0].cik, got[0].company_name, got[0].ticker, got[0].root_form, got[0].tier) == ("1-2", "7", "Ace & Co", "", "S-1", 1)
    assert len(got) == 1  # a hit without an accession number is none


def answer(folder, key, sub, page, hits, first="2024-01-01", last="2024-01-01"):
    (folder / search.page_name(key, sub, page, first, last)).write_text(json.dumps({"hits": {"hits": hits}}) if hits is not None else "{broken")


def test_search_source(spark, tmp_path):
    answer(tmp_path, "S-1", "0", 0, [{"_id": "a", "okey": 4, "date": "2024-01-01"}, {"_id": "b"}])
    answer(tmp_path, "S-1", "0", 1, None)
    answer(tmp_path, "S-1", "0", 2, [{"_id": "behind"}])
    answer(tmp_path, "S_1/A", "2", 0, [{"_id": "c"}])
    got = search.read(spark, str(tmp_path)).collect()
    assert sorted((r.key, r.sub, r.nth, r.position, r.okey, r.hit, bool(r.error)) for r in got if r.hit) == [("S-1", "0", 0, 0, 4, '{"_id": "a"}', False), ("S-1", "0", 0, 1, None, '{"_id": "b"}', False), ("S_1/A", "2", 1, 0, None, '{"_id": "c"}', False)]
    assert [(r.nth, r.position) for r in got if r.error] == [(0, 100)]


def test_pages_that_hold_nothing_wanted_stay_unopened(spark, tmp_path):
    """Every page that a filter rules out is broken: had it been opened, its error would show, since error rows pass the same filters."""
    for form in ("10-K", "D"):
        for batch in ("0", "1"):
            for page, (first, last) in enumerate((("2020-01-01", "2020-12-31"), ("2021-01-01", "2022-12-31"), ("2023-01-01", "2023-12-31"))):
                fine = (form, batch, page) == ("D", "1", 1)
                answer(tmp_path, form, batch, page, [{"_id": str(i), "date": f"202{1 + i % 2}-06-01"} for i in range(search.PAGE)] if fine else None, first, last)
    all_of = search.read(spark, str(tmp_path))
    got = all_of.where("key IN ('D', 'S-1') AND sub = '1' AND file_date >= '2021-02-01' AND file_date < '2022-01-01'").collect()
    assert len(got) == 50 and not any(r.error for r in got) and {r.position for r in got} == set(range(100, 200, 2))
    first = all_of.where("key = 'D' AND position < 100").collect()
    assert [(r.sub, r.position, bool(r.error)) for r in sorted(first)] == [("0", 0, True), ("1", 0, True)]
    assert all_of.where("file_date > '2024-01-01'").count() == 0


def test_listings_of_companies_are_capped_by_the_reader(spark, tmp_path):
    for page in range(3):
        answer(tmp_path, "7", "10-K", page, [{"_id": f"{page}-{i}"} for i in range(search.PAGE)] if page == 0 else None)
    answer(tmp_path, "8", "10-K", 0, [{"_id": "x"}])
    got = search.read(spark, str(tmp_path), 20).collect()
    assert sorted((r.key, r.position) for r in got) == [("7", i) for i in range(20)] + [("8", 0)]


def test_search_ends_after_three_failed_searches_in_a_row(spark, tmp_path):
    """Two failures, a success, three failures: what stands behind those is lost, whatever task read it."""
    for n, fine in enumerate((True, False, False, True, False, False, False, True, True)):
        answer(tmp_path, f"f{n}", "0", 0, [{"_id": str(n)}] if fine else None)
    answers = search.read(spark, str(tmp_path))
    assert sorted(r.key for r in search.unbroken(answers).collect()) == ["f0", "f3"]
    assert sorted(r.key for r in search.unbroken(answers.where("key <> 'f6'")).collect()) == ["f0", "f3", "f7", "f8"]
    assert search.unbroken(search.read(spark, str(tmp_path / "none"))).count() == 0


def test_pages_are_written_as_they_are_read(spark, tmp_path):
    hits = spark.createDataFrame([(i, "S-1" if i % 3 else "10-K/A", i % 2, f"20{20 + i // 100}-01-01", json.dumps({"_id": str(i)})) for i in range(650)], "okey long, key string, sub int, file_date string, hit string")
    search.write_pages(hits, f"file://{tmp_path}", "okey")
    got = search.read(spark, f"file://{tmp_path}")
    assert {(r.key, r.sub, r.okey, r.file_date) for r in got.collect()} == {(r.key, str(r.sub), r.okey, r.file_date) for r in hits.collect()}
    some = got.where("key = 'S-1' AND sub = '0'").orderBy("position").collect()
    assert [r.okey for r in some] == sorted(r.okey for r in some) and [r.position for r in some] == list(range(len(some)))


def test_exports(spark):
    df = spark.createDataFrame([('say "hi", you', "line\nbreak"), ("", "<&>")], "a string, b string")
    rows = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, sinks.read_csv(spark, sinks.export_csv(spark, df), df.columns).collect())) == rows
    many = df.unionByName(df).unionByName(df).coalesce(1)
    path = sinks.export_workbooks(spark, many, rows=4)
    assert spark.read.parquet(path).count() == 2  # workbooks of four rows and of two
    assert sorted(map(tuple, sinks.read_workbooks(spark, path, df.columns).collect())) == sorted(rows * 3)
    assert sinks.export_csv(spark, df.limit(0)) is None and sinks.export_workbooks(spark, df.limit(0)) is None
    assert sinks.read_csv(spark, None, df.columns).count() == sinks.read_workbooks(spark, None, df.columns).count() == 0
    assert sinks.workbook_rows(sinks.workbook([("a<b", None)], ["one", "two"])) == [["one", "two"], ["a<b", ""]]


def test_filters_of_a_request():
    assert filters.from_request({"company": " x ", "month": "  ", "search": None}) == {"company": "x", "month": None, "search": None}
    assert filters.active(filters.from_request({"company": " ", "form_type": "D"})) == {"form_type": "D"}


# -- what must be as in the reference, with values typed here --


def test_state_codes_are_no_tickers(spark):
    names = ["Ace (TX) (CIK 1)", "Ace (MD) (CIK 1)", "Ace  Two (ABC) Inc (CIK 1)", "Ace (DE) (ABC) (CIK 1)", None]
    hits = [{"_id": "1-2:d.htm", "_source": {"display_names": [n] if n else []}} for n in names] + [{"_id": "no accession"}]
    rows = spark.createDataFrame([(i, "S-1", json.dumps(h)) for i, h in enumerate(hits)], "okey long, form_type string, hit string")
    got = ingest.parse_hits(rows).orderBy("okey").collect()
    assert [r.ticker for r in got] == ["", "MD", "ABC", "", ""]
    assert [r.company_name for r in got] == ["Ace", "Ace", "Ace  Two Inc", "Ace", "Unknown"]
    assert {r.form_type for r in got} == {"S-1"}


def test_run_messages(spark):
    rows = [(3, 0, 0, 0, 9, 30.0), (0, 0, 0, 0, 9, 60.0), (0, 0, 0, 0, 0, 1.0), (0, 5, 4, 1, 9, 90.0)]
    df = spark.createDataFrame(rows, "reprocessed int, new_found int, saved int, failed int, total int, seconds double")
    got = [r.m for r in df.select(ingest.outcome_message(*map(F.col, df.columns)).alias("m")).collect()]
    assert got == [
        "Done: reprocessed 3 filings, 9 total with summaries (0.5min)",
        "Up to date: all 9 filings already processed (1.0min)",
        "No filings found. Check your internet connection and try again.",
        "Done: 4 new, 1 failed, 9 total (1.5min)",
    ]


def test_lengths_of_what_is_shown(spark):
    df = spark.createDataFrame([("x" * n,) for n in (30, 31, 140, 141)], "t string")
    got = [(len(r.a), len(r.b)) for r in df.select(D.short_summary(F.col("t")).alias("a"), D.label(F.col("t")).alias("b")).collect()]
    assert got == [(30, 30), (31, 31), (140, 31), (143, 31)]


def test_paragraph_fallback_measures_the_paragraphs(spark):
    """A long filing whose fitting paragraphs have 500 characters or fewer gives none; a short one with more does."""
    line = "Bitcoin and ethereum custody is a risk of loss and theft, and a failure of the exchange may cause loss of digital assets."
    few = "\n\n".join(["Bread and cheese are quiet things to write about here."] * 30 + [line] * 3)
    more = "\n\n".join([line + f" It is number {i}." for i in range(6)])
    got = E.candidates(texts(spark, (1, "D", few), (2, "D", more)))
    assert [(r.doc_id, r.strategy, r.method) for r in got.collect()] == [(2, "E", "paragraph_density")]


def test_lenient_pairs_are_named_as_such(spark):
    got = E.candidates(texts(spark, (1, "10-Q", BLOCKS["short"])))
    assert [r.method for r in got.collect()] == ["boundary_pair_lenient"]


def test_a_better_document_of_a_shared_filing(spark):
    rows = texts(spark, (1, "485APOS", "nothing here " * 60), (2, "10-Q", BLOCKS["body"]), (3, "N-1A", "nothing here " * 60))
    filings = rows.select("doc_id", "root_form", F.concat(F.lit("f"), "doc_id").alias("accession_no"))
    docs = spark.createDataFrame([("f1", 0, "dull " * 200, 0), ("f1", 1, BLOCKS["prospectus"], 9), ("f2", 0, BLOCKS["prospectus"], 9), ("f3", 0, BLOCKS["prospectus"], 2)], "accession_no string, seq int, text string, crypto_score int")
    got = E.with_best_document(rows, filings, docs).select("doc_id", F.inline("best")).collect()
    assert sorted((r.doc_id, r.src, r.strategy, r.place) for r in got) == [(1, 1, "C", 1), (2, 0, "B", 1)]


def test_hosted_replies_or_the_template(spark):
    df = spark.createDataFrame([(i, "10-K", "Ace", RISK) for i in range(4)] + [(4, "10-K", "Ace", "dull")], "doc_id long, form_type string, company_name string, text string")
    long = "A hosted summary that has more than forty characters in it."
    replies = spark.createDataFrame([(0, json.dumps({"summary": long}), "m"), (1, "short", "m"), (2, long, "m"), (4, long, "m")], "doc_id long, reply string, model string")
    got = {r.doc_id: (r.summary, r.model) for r in Y.summaries(df, "doc_id", replies).collect()}
    assert got[0] == got[2] == (long, "m") and got[1] == got[3] and got[1][1] == Y.TEMPLATE_MODEL and got[4][0] == ""


# -- tables and runs --


def test_warehouse(spark, tmp_path):
    house = warehouse.Warehouse(spark, f"file://{tmp_path}/new", wait=0.01)
    old = warehouse.Warehouse(spark, f"file://{tmp_path}/old-1", wait=0.01)
    for w in (old, house):
        w.init()
        w.init()
    blank = {c.strip().split(" ")[0]: "" for c in warehouse.SCHEMAS["filings"].split(",")} | {"tier": 1}
    filings = spark.createDataFrame([tuple((blank | {"accession_no": a, "form_type": f}).values()) for a, f in (("a", "D"), ("b", "10-K"))], warehouse.SCHEMAS["filings"])
    docs = spark.createDataFrame([("a", 0, "n" * 300, "t", "text", 1, ""), ("a", 1, "m", "t", "x" * 600_000, 5, "")], "accession_no string, seq int, name string, type string, text string, crypto_score int, fund_name string")
    found = spark.createDataFrame([("a", 1, "s", "m", "", "y" * 300_000, 0.5), ("a", 2, "s", "m", "", "z", 0.4), ("b", 1, "s", "m", "", "w", 0.9)], "accession_no string, place int, section_type string, method string, title string, text string, confidence double")
    told = spark.createDataFrame([("a", "t1", "first"), ("b", "t1", "")], "accession_no string, model string, summary string")
    for _ in range(2):
        old.save(filings, docs, found, told)
    assert sorted((r.accession_no, r.form_type) for r in old.read("filings").collect()) == [("a", "D"), ("b", "10-K")]
    assert sorted((r.doc_seq, len(r.doc_name), r.char_count) for r in old.read("documents").collect()) == [(0, 1, 500_000), (1, 200, 4)]
    sections = {r.id: r for r in old.read("sections").collect()}
    assert len(sections) == 3 and sum(r.is_primary for r in sections.values()) == 2 and max(r.char_count for r in sections.values()) == 200_000 and min(sections) > 3
    summaries = sorted(old.read("summaries").collect(), key=lambda r: r.id)
    assert [(r.is_current, r.section_id in sections) for r in summaries] == [(0, False), (1, True)] and summaries[0].section_id is None
    copied = warehouse.Warehouse(spark, f"file://{tmp_path}/later", wait=0.01)
    copied.init((f"file://{tmp_path}/none", f"file://{tmp_path}/old-1"))
    assert copied.read("sections").count() == 3 and copied.version() == warehouse.SCHEMA_VERSION
    copied.reset()
    assert all(copied.read(n).count() == 0 for n in warehouse.SCHEMAS) and old.read("filings").count() == 2
    with old.lock(), pytest.raises(warehouse.Locked):
        old.reset()


def test_a_write_that_fails_between_tables_changes_nothing(spark, tmp_path):
    house = warehouse.Warehouse(spark, f"file://{tmp_path}/house", wait=0.01)
    house.init()
    blank = {c.strip().split(" ")[0]: "" for c in warehouse.SCHEMAS["filings"].split(",")} | {"tier": 1}
    filings = spark.createDataFrame([tuple((blank | {"accession_no": "a"}).values())], warehouse.SCHEMAS["filings"])
    docs = spark.createDataFrame([], "accession_no string, seq int, name string, type string, text string, crypto_score int, fund_name string")
    found = spark.createDataFrame([("a", 1, "s", "m", "", "y", 0.5)], "accession_no string, place int, section_type string, method string, title string, text string, confidence double")
    broken = spark.createDataFrame([("a", "m", "told")], "accession_no string, model string, summary string").withColumn("summary", F.raise_error(F.lit("no reply")).cast("string"))
    with pytest.raises(Exception, match="no reply"):
        house.save(filings, docs, found, broken)
    assert house.read("filings").count() == house.read("sections").count() == 0
    house.save(filings, docs, found, broken.select("accession_no", "model", F.lit("told").alias("summary")))
    assert house.read("filings").count() == house.read("sections").count() == house.read("summaries").count() == 1


def test_records_of_a_run(spark):
    """What is dropped, what is told of a filing and where it comes from; the expected values are typed."""
    work = spark.createDataFrame(
        [("a-1", "7", "Ace Ñandú Inc", "ACE", "10-K", "10-K", "2024-01-02", ""), ("b-1", "99", "Bee", "", "485APOS", "485APOS", "2024-02-03", "DeFi"), ("c-1", "1", "Cee", "", "8-K", "8-K", "", ""), ("d-1", "1", "Dee", "", "D", "D", "", ""), ("e-1", "1", "Eee", "", "D", "D", "", "")],
        "accession_no string, cik string, company_name string, ticker string, form_type string, root_form string, filing_date string, keyword string",
    )
    said = spark.createDataFrame([("a-1", "A blockchain story." + BLOCKS["body"]), ("b-1", "nothing here " * 60), ("c-1", "too short"), ("d-1", "dull " * 99)], "accession_no string, text string")
    files = [("a-1", 0, "x", "EX", "u.pdf", 0, BLOCKS["prospectus"]), ("b-1", 0, "dull", "EX", "u.htm", 0, "dull " * 200), ("b-1", 1, "good", "EX", "v.pdf", 0, "\nThe Northern Light Bitcoin Fund grows." + BLOCKS["prospectus"]), ("b-1", 2, "image", "GRAPHIC", "w.pdf", 1, RISK), ("b-1", 6, "late", "EX", "x.htm", 0, RISK * 3)]
    attached = spark.createDataFrame(files, "accession_no string, seq int, name string, type string, url string, is_binary int, text string")
    companies = spark.createDataFrame([("7", "miner")], "cik string, category string")
    made = records.compose(work, said, attached, companies, spark.createDataFrame([], "cik string, holdings string"), "now")
    filings = {r.accession_no: r for r in made.filings.collect()}
    assert made.filings.columns == list(records.FILING) and set(filings) == {"a-1", "b-1"}
    a, b = filings["a-1"], filings["b-1"]
    assert (a.company_name, a.filing_category, a.tier, a.search_keyword, a.filing_pdf_url, a.fetched_at) == ("Ace Nandu Inc", "Operating Co.", 2, "cryptocurrency", "u.pdf", "now")
    assert a.sec_url == "https://filings.example/data/7/a1/a-1-index.htm" and a.crypto_connection.startswith("Reports blockchain or bitcoin or digital assets") and "BTC" in a.top_holdings
    assert (b.search_keyword, b.filing_pdf_url, b.crypto_connection, b.tier) == ("DeFi", "v.pdf", "Crypto-related filing.", 1)
    sections = [(r.accession_no, r.place, r.src, r.strategy, r.section_type, r.title) for r in made.sections.orderBy("accession_no", "place").collect()]
    assert sections == [("a-1", 1, 0, "A", "risk_factors", "TenK.risk_factors"), ("b-1", 1, 1, "C", "principal_risks", "Principal Investment Risks")]
    assert sorted((r.accession_no, r.seq, r.crypto_score > 2, r.fund_name) for r in made.documents.collect()) == [("b-1", 0, False, ""), ("b-1", 1, True, "The Northern Light Bitcoin Fund")]
    told = {r.accession_no: r for r in made.summaries.collect()}
    assert set(told) == {"a-1", "b-1"} and told["a-1"].summary.startswith("Ace Ñandú Inc — annual report involving Bitcoin") and told["a-1"].model == "template-v1"


def test_candidates_are_found_once(spark):
    """The outputs read the stage table: no output's plan has a strategy in it."""
    f = Frames(spark, "/root/testdata/sf0.001")
    made = records.compose(f.work.drop("doc_id"), f.texts.select("accession_no", "text"), f.attachments, f.companies, f.details, "now")
    for df in (made.sections, made.filings, made.summaries):
        assert "Principal Investment Risks" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_outputs_of_a_run_read_no_text_again(spark):
    """A save evaluates an output several times: none of them has the index of terms in its plan, which reads texts."""
    f = Frames(spark, "/root/testdata/sf0.001")
    made = records.compose(f.work.drop("doc_id"), f.texts.select("accession_no", "text"), f.attachments, f.companies, f.details, "now")
    for df in (made.documents, made.sections, made.summaries):
        assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString() and not df.isEmpty()


def test_memory_of_python_workers_is_bounded(spark, monkeypatch):
    """Each step of a run has few Python workers at once, and hands them few texts at a time; what passes between steps goes."""
    workers, write, told = [], DataFrameWriter.parquet, terms.tells

    def written(self, path, *args, **kwargs):
        workers.append(self._df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython"))
        return write(self, path, *args, **kwargs)

    @F.arrow_udf("boolean")
    def few(text: pa.Array) -> pa.Array:
        assert len(text) <= 500 and text.nbytes < 8 << 20
        return pa.array([True] * len(text), pa.bool_())

    monkeypatch.setattr(DataFrameWriter, "parquet", written)
    monkeypatch.setattr(terms, "tells", lambda text: few(text) & told(text))
    work = "cast(id as string) AS accession_no, '7' AS cik, 'Ace' AS company_name, '' AS ticker, '10-K' AS form_type, '10-K' AS root_form, '2024-01-15' AS filing_date, '' AS keyword"
    runs = spark.range(0, 1500, 1, 1).selectExpr(*work.split(", "), "id")
    said = runs.select("accession_no", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("bread and cheese "), 3000)).otherwise(BLOCKS["body"]).alias("text"))
    none = spark.createDataFrame([], "accession_no string, seq int, name string, type string, url string, is_binary int, text string")
    made = records.compose(runs.drop("id"), said, none, spark.createDataFrame([], "cik string, category string"), spark.createDataFrame([], "cik string, holdings string"), "now")
    assert made.summaries.count() == 750 and len(workers) > 1 and max(workers) <= 6  # one of them is this test's
    assert not list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "riskweave").glob("tried-*"))


def test_stream_holds_no_state_and_takes_each_accession_once(spark, tmp_path):
    """Many commits, a restart in the middle: what was taken is in the target, not in the stream's state."""
    source, target, state = (f"file://{tmp_path}/{n}" for n in ("hits", "taken", "state"))
    stored = spark.createDataFrame([("d",)], "accession_no string")
    calls = []
    for parts in ([["a", "b"], ["b", "c"]], [["d"], ["a", "e", "e"], ["b"]]):
        for part in parts:
            spark.createDataFrame([(x,) for x in part], "accession_no string").coalesce(1).write.mode("append").parquet(source)
        query = stream.ingest(spark, source, "accession_no string", stored, target, state, files=1, told=calls.append)
        assert not query.lastProgress.stateOperators
    assert len(calls) == 5 and sum(calls) == 4
    assert sorted(r.accession_no for r in spark.read.parquet(target).collect()) == ["a", "b", "c", "e"]


def test_cleaned_texts_are_parsed_once(spark, tmp_path):
    folder = f"file://{tmp_path}/texts"
    pages = spark.createDataFrame([(1, "<p>one</p>"), (2, "<p>one</p>"), (3, None), (4, "<p>two</p>")], "page_id long, html string")
    told = lambda df: sorted((r.page_id, r.text, r.made) for r in df.collect())
    assert told(cache.cleaned(pages.where("page_id < 4"), folder, 10.0, 100.0)) == [(1, "one", 10.0), (2, "one", 10.0), (3, "", 10.0)]
    assert cache.entries(spark, folder).count() == 2
    assert told(cache.cleaned(pages, folder, 50.0, 100.0)) == [(1, "one", 10.0), (2, "one", 10.0), (3, "", 10.0), (4, "two", 50.0)]
    assert cache.entries(spark, folder).count() == 3  # only what was new
    assert told(cache.cleaned(pages, folder, 130.0, 100.0)) == [(1, "one", 130.0), (2, "one", 130.0), (3, "", 130.0), (4, "two", 50.0)]
    assert cache.entries(spark, folder).where("key = sha2('<p>one</p>', 256)").select("prefix").distinct().count() == 1
    assert cache.cleaned(pages.limit(0), folder, 131.0).count() == 0 and cache.entries(spark, folder).count() == 5


def test_commits_of_filings_with_a_restart(spark, tmp_path):
    """Units hold their number of filings exactly; a commit that fails after its write is taken again, whole, and none twice."""
    source, stage, target, state = (f"file://{tmp_path}/{n}" for n in ("units", "stage", "taken", "state"))
    work = spark.createDataFrame([(f"k{i:03}", i) for i in range(64)], "accession_no string, extra int").repartition(5)
    stream.units(work, source, stage, stream.COMMIT_ROWS_AGAIN)
    read = spark.read.parquet(source)
    assert sorted(r["count"] for r in read.groupBy("unit").count().collect()) == [4, 20, 20, 20]
    assert {r.unit for r in read.where("accession_no < 'k020'").collect()} == {0}
    calls, none = [], spark.createDataFrame([], "accession_no string")

    def told(n):
        calls.append(n)
        if len(calls) == 2:
            raise RuntimeError("executor lost")

    with pytest.raises(Exception, match="executor lost"):
        stream.ingest(spark, source, read.schema, none, target, state, files=1, told=told)
    stream.ingest(spark, source, read.schema, none, target, state, files=1, told=told)
    assert len(calls) == 5 and calls[1] == calls[2]
    taken = spark.read.parquet(target)
    assert sorted(r.accession_no for r in taken.collect()) == [f"k{i:03}" for i in range(64)]
    assert sorted(r["count"] for r in taken.groupBy("batch").count().collect()) == [4, 20, 20, 20]


VIEW = "accession_no string, company_name string, filing_category string, form_type string, search_keyword string, filing_date string"


def test_figures_add_up(spark, tmp_path):
    """Insert, rename, repeat of an ingest, removal of a key's last filing; an empty change and no filings at all."""
    folder = f"file://{tmp_path}/figures"
    view = lambda *rows: spark.createDataFrame(list(rows), VIEW)
    a, b, c = ("a", "One", "Fund", "D", "bitcoin", "2024-01-02"), ("b", "One", "Fund", "D", "", ""), ("c", "Two", "Op", "8-K", "bitcoin", "2024-02-02")
    later = ("c", "Three", "Op", "8-K", "bitcoin", "2024-02-02")
    steps = [(view(), view(a, b, c)), (view(c), view(later)), (view(a), view()), (view(), view())]
    for i, (before, after) in enumerate(steps):
        for _ in range(2):
            figures.append(figures.change(before, after), folder, i)
    told = lambda df: sorted(map(tuple, df.collect()))
    merged = figures.bundle(figures.merged(spark, folder))
    assert told(merged) == told(figures.bundle(figures.counts(view(b, later))))
    assert told(merged) == sorted([("category", "Fund", 1), ("category", "Op", 1), ("companies", "", 2), ("company", "One", 1), ("company", "Three", 1), ("day", "2024-02-02", 1), ("form", "Fund|D", 1), ("form", "Op|8-K", 1), ("keyword", "bitcoin", 1), ("month", "2024-02", 1), ("total", "", 2)])
    figures.append(figures.change(view(b, later), view()), folder, 4)
    assert told(figures.bundle(figures.merged(spark, folder))) == [("companies", "", 0), ("total", "", 0)]


def test_a_write_rewrites_the_years_it_touches(spark, tmp_path):
    """Equal to the upsert of the whole table; other years keep their files, and the stored side isn't shuffled."""
    schema, path = "accession_no string, company_name string, form_type string", f"{tmp_path}/years"
    years.attach(spark, "filings_by_year", schema, f"file://{path}", 4)
    key = lambda i, y: f"{i:010}-{y}-{i:09}"
    old = spark.createDataFrame([(key(i, 20 + i % 4), f"c{i}", "D") for i in range(400)] + [("short", "s", "D")], schema)
    assert years.write(spark, "filings_by_year", old, store.upsert) == ["--", "20", "21", "22", "23"]
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in tmp_path.glob("years/*/*.parquet")}
    before = files()
    new = spark.createDataFrame([(key(i, 22), "new", "10-K") for i in (2, 6, 1000)] + [(key(7, 24), "other", "8-K")], schema)
    want = sorted(map(tuple, store.upsert(old, new).collect()))
    for _ in range(2):  # repeated, as after a failure
        plan = years.changed(spark, "filings_by_year", new, ["22", "24"], store.upsert)
        shown = plan._jdf.queryExecution().executedPlan().toString()
        assert shown.count("Exchange") == 1 and "Bucketed: true" in plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert years.write(spark, "filings_by_year", new, store.upsert) == ["22", "24"]
        assert sorted(map(tuple, years.read(spark, "filings_by_year").collect())) == want
    after = files()
    assert {f: t for f, t in before.items() if "=22" not in f} == {f: t for f, t in after.items() if "=22" not in f and "=24" not in f}
    assert not {f for f in before if "=22" in f} & set(after)
    spark.sql("DROP TABLE filings_by_year")
    years.attach(spark, "filings_by_year", schema, f"file://{path}", 4)  # another session finds what stands there
    assert years.read(spark, "filings_by_year").count() == len(want)
    years.write(spark, "filings_by_year", new.limit(0), store.upsert)
    assert years.read(spark, "filings_by_year").count() == len(want)
    spark.sql("DROP TABLE filings_by_year")


def test_plain_words_are_looked_for_before_patterns(spark):
    pieces = ["price fluctuates", "prices may well fluctuate", "price\nfluctuation", "fluctuat price", "tax", "tax on uncertain", "cyber security", "cyber\nsecurity", "front-running", "SEC will regulate", "net asset value", "custodian", "KYC", "exchange had failed", "decentralized finance", "eth", "method", "non-fungible", "stablecoins", "cryptocurrencies", "crypto", "", "İ nft", "nfté"]
    df = spark.createDataFrame([(f"{a} {b}",) for a in pieces for b in pieces] + [(None,)], "text string").withColumn("low", F.lower("text"))
    tables = [(p, "(?d)") for _, p in fixed.RISK_CATEGORIES] + [(p, "(?dU)") for p, _ in fixed.ASSETS]
    bad = [df.where(~lexicons.named(F.col("low"), p, flags).eqNullSafe(F.col("low").rlike(flags + p))) for p, flags in tables]
    assert all(b.isEmpty() for b in bad)
    with pytest.raises(ValueError):
        lexicons.named(F.col("low"), r"(\d+|word)", "")


def test_a_summary_is_made_of_its_own_row(spark):
    df = spark.createDataFrame([(1, "10-K", "A", BLOCKS["body"] * 2), (2, "S-1", "B", "quiet"), (3, "D", "C", None)], "doc_id long, form_type string, company_name string, text string")
    made = Y.template_summary(df, "doc_id")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2
    got = {r.doc_id: r.summary for r in made.collect()}
    assert got[1].startswith("A — annual report involving Bitcoin, ") and got[2] == got[3] == ""
    assert got[1].endswith(" ".join(Y.best_sentences(df, "doc_id").first().picked))


def test_letters_outside_ascii_cost_the_index_little():
    def seconds(text):
        list(terms.occurrences(text))
        return min(timeit.repeat(lambda: list(terms.occurrences(text)), number=1, repeat=5))

    plain = "cheese and bread with nothing to tell " * 10_000
    assert seconds(plain + "é") < 3 * seconds(plain)


def test_a_workbook_holds_packed_rows_only(spark):
    columns, row = [f"c{i}" for i in range(24)], tuple(["a & b" * 8] * 24)
    tracemalloc.start()
    data = sinks.workbook((row for _ in range(10_000)), columns)
    read = sum(len(r) for r in sinks.sheet_rows(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 24 * 10_001 and peak < 10 << 20
    frame = spark.range(0, 2_500, 1, 1).select(F.col("id").cast("string").alias("id"), F.lit("x < y").alias("said"))
    again = sinks.read_workbooks(spark, sinks.export_workbooks(spark, frame, rows=1_100), frame.columns)
    assert sorted(again.collect()) == sorted(frame.collect())


def test_pages_are_parsed_a_few_at_a_time(spark, tmp_path, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)

    @F.arrow_udf("string")
    def seen(markup):
        sizes.add(1)
        return T.html_to_text.func(markup)

    monkeypatch.setattr(cache, "html_to_text", seen)
    pages = spark.range(0, 1_200, 1, 1).select("id", F.concat(F.lit("<p>page "), "id", F.lit("</p>")).alias("html"))
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = cache.cleaned(pages.coalesce(1), f"file://{tmp_path}/texts", 0.0)
    assert {r.id: r.text for r in got.collect()} == {i: f"page {i}" for i in range(1_200)}
    assert sizes.value >= 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == with_batches


def test_figures_read_no_sections(spark):
    f = Frames(spark, "/root/testdata/sf0.001")
    lean, whole = views.gated(f.filings, f.summaries), views.visible(views.display(f.filings, f.sections, f.summaries))
    assert sorted(map(tuple, figures.counts(lean).collect())) == sorted(map(tuple, figures.counts(whole).collect()))
    assert "l_discount" not in lean._jdf.queryExecution().executedPlan().toString()


def test_a_task_of_the_view_has_so_many_rows(spark, monkeypatch):
    """Larger order tables are dealt out to more tasks, not to larger ones; the rows stay the same."""
    sf = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, Frames(spark, sf).view.collect()))
    monkeypatch.setattr(corpus, "ROWS", 300)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")  # so small a table would be broadcast
    try:
        f = Frames(spark, sf)
        for df in (f.section_rows, f.sections, f.view):
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 15 and max(sizes) < 4 * corpus.ROWS
        assert sorted(map(tuple, f.view.collect())) == plain
    finally:
        for name in names:
            spark.conf.unset(name)
