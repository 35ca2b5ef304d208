"""Candidate sections of a filing's text and their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskweave.functions import fixed, terms
from riskweave.functions.text import let, overlap, rows, sentences, strip, word_set

SAMPLE, LENIENT, PARAGRAPHS, PARAGRAPHS_LEAST = 40_000, 0.8, 0.6, 500
REPORTS = ("10-K", "10-Q")
CUT = 60_000


def item(code: str) -> str:
    """Pattern of an item heading, with or without a space inside its code."""
    return r"Item[^\S\r\n]+" + r"[^\S\r\n]*".join(code) + r"[.\-:\s\(]?"


def pair_pattern(start: str, end: str) -> str:
    return rf"(?is)(\n[^\S\r\n]*{item(start)}.+?)\n[^\S\r\n]*{item(end)}"


def boundary_spans(text: Column, start: str, end: str, least: int = 1000) -> Column:
    """Array of struct(rank_by, nth, size, text): spans between two headings, largest first, ``least`` characters or more."""
    return _spans(text, F.lit(pair_pattern(start, end)), least)


def _spans(text: Column, pattern: Column, least: int) -> Column:
    found = F.regexp_extract_all(text, pattern, 1)
    sized = F.transform(found, lambda s, i: F.struct((-F.length(s)).alias("rank_by"), i.alias("nth"), F.length(s).alias("size"), strip(s).alias("text")))
    return F.array_sort(F.filter(sized, lambda s: s["size"] >= least))


def header_spans(text: Column) -> Column:
    """Array of struct(rank_by, header_no, nth, size, text): prospectus sections, largest first."""
    tail = r"(?im)(?:^|\n)\s*(?:" + "|".join(fixed.END_LINES) + r")\b"
    headers = rows("no header low pattern size", [(no, h, h.lower(), r"(?i)\Q" + h + r"\E", len(h)) for no, h in enumerate(fixed.HEADERS)])

    def of_header(h: Column, low: Column) -> Column:
        """The sections behind all occurrences of a header, of the pieces that it splits the text into."""
        pieces_ = lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: one(h, p, i)))
        return F.when(low.contains(h["low"]), let(F.split(text, h["pattern"], -1), pieces_))

    def one(h: Column, pieces_: Column, i: Column) -> Column:
        place = F.aggregate(F.slice(pieces_, F.lit(1), i), F.lit(0), lambda n, p: n + F.length(p)) + i * h["size"]  # where the content begins, from 0
        return let(place, lambda at: let(F.substring(text, at + 301, F.length(text)), lambda rest: let(F.regexp_instr(rest, F.lit(tail)), lambda stop: cut(h, i, at, stop))))

    def cut(h: Column, i: Column, at: Column, stop: Column) -> Column:
        begin = at - h["size"]
        before = F.lower(F.substring(text, F.greatest(begin - 80, F.lit(0)) + 1, F.least(begin, F.lit(80))))
        after = F.lower(F.substring(text, at + 1, F.lit(120)))
        end = F.when(stop > 0, at + 300 + stop - 1).otherwise(F.least(at + 80_000, F.length(text)))
        skip = let(before, lambda b: b.contains("see ") | b.contains("refer to ") | b.contains("beginning on page")) | let(after, lambda x: x.contains("on page") & (F.length(x) < 80))
        own = strip(F.substring(text, at + 1, end - at))
        return let(own, lambda x: F.struct((-F.length(x)).alias("rank_by"), h["no"].alias("header_no"), i.alias("nth"), F.length(x).alias("size"), x.alias("text"), skip.alias("skip")))

    every = F.flatten(F.array_compact(let(F.lower(text), lambda low: F.transform(headers, lambda h: of_header(h, low)))))
    return F.array_sort(F.filter(every, lambda s: ~s["skip"] & (s["size"] >= 800)))


PART = r"(?i)\n([^\S\n]*part[^\S\n]+[iv]+\b)"
ITEM = r"(?i)\n([^\S\n]*item[^\S\n]+\d{1,2}(?:\.\d{2})?[^\S\n]?[a-z]?\b)"
PART_NAME, ITEM_NAME = r"(?i)\A[^\S\n]*part[^\S\n]+([iv]+)\b", r"(?i)\A[^\S\n]*item[^\S\n]+(\d{1,2}(?:\.\d{2})?[^\S\n]?[a-z]?)\b"


def report_items(text: Column) -> Column:
    """Array of struct(part, item, text) of a report: what stands from each item's heading, at the start of a line, to the next item or part."""

    def of_part(q: Column) -> Column:
        part = F.upper(F.regexp_extract(q, PART_NAME, 1))
        pieces = F.split(F.regexp_replace(q, ITEM, "\n\x01$1"), "\x01")
        item = lambda p: F.upper(F.regexp_replace(F.regexp_extract(p, ITEM_NAME, 1), r"\s", ""))
        return let(part, lambda name: F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.struct(name.alias("part"), item(p).alias("item"), strip(p).alias("text"))))

    marked = F.regexp_replace(F.translate(text, "\x01\x02", ""), PART, "\n\x02$1")
    return F.flatten(F.transform(F.split(marked, "\x02"), of_part))


def typed_sections(text: Column, root: Column) -> Column:
    """Array of struct(seq, section_type, title, text): the sections of an annual or quarterly report by their items, all items of a current one.

    A heading occurs in the contents too: of equal ones the longest section counts.
    """

    def longest(items: Column, test) -> Column:
        sized = F.transform(F.filter(items, test), lambda x, i: F.struct((-F.length(x["text"])).alias("size"), i.alias("i"), x["text"].alias("text")))
        return F.get(F.array_sort(sized), F.lit(0))["text"]

    def wanted(items: Column) -> Column:
        named = lambda t: lambda x: (x["item"] == t["code"]) & ((t["part"] == "") | (x["part"] == t["part"]))
        tables = [rows("seq section_type part code title", [(seq, *row) for seq, row in enumerate(t)]) for t in (fixed.TYPED_10K, fixed.TYPED_10Q)]
        return F.transform(F.when(root == "10-K", tables[0]).otherwise(tables[1]), lambda t: F.struct(t["seq"].alias("seq"), t["section_type"].alias("section_type"), t["title"].alias("title"), longest(items, named(t)).alias("text")))

    def each(items: Column) -> Column:
        names = F.array_distinct(F.transform(items, lambda x: x["item"]))
        return F.transform(names, lambda c, i: F.struct(i.alias("seq"), F.lit(fixed.TYPED_8K).alias("section_type"), F.concat(F.lit("Item "), c).alias("title"), longest(items, lambda x: x["item"] == c).alias("text")))

    least = F.when(root == "8-K", fixed.TYPED_LEAST_8K).otherwise(fixed.TYPED_LEAST)
    found = F.when(root.isin("10-K", "10-Q", "8-K"), let(report_items(text), lambda items: F.when(root == "8-K", each(items)).otherwise(wanted(items))))
    return F.filter(found, lambda s: F.length(s["text"]) >= least)


def sample(text: Column) -> Column:
    """What of a text the check counts terms in."""
    return F.substring(text, 1, SAMPLE)


def verdict(text: Column, hits: Column) -> Column:
    """struct(reason, confidence) of a text, as ``check`` finds them, as one expression; ``hits`` are the counts of its sample."""

    def judged(h: Column) -> Column:
        density = F.when(h["n"] == 0, 0.0).otherwise(h["risk"] / (h["n"] / 1000.0))
        ratio = F.when(h["risk"] > 0, h["fee"] / h["risk"]).otherwise(1.0)
        return let(F.struct(h["size"].alias("size"), h["crypto"].alias("crypto"), h["boilerplate"].alias("boilerplate"), density.alias("density"), ratio.alias("ratio")), lambda d: let(_reason(d["size"], d["crypto"], d["density"], d["ratio"]), lambda r: F.struct(r.alias("reason"), F.when(r == "", _score(d["crypto"], d["density"], d["ratio"], d["boilerplate"])).otherwise(0.0).alias("confidence"))))

    return let(F.struct(F.length(text).alias("size"), F.least(F.length(text), F.lit(SAMPLE)).alias("n"), *[hits[x].alias(x) for x in terms.LEXICONS]), judged)


def _reason(size: Column, crypto: Column, density: Column, ratio: Column) -> Column:
    return F.when(F.coalesce(size, F.lit(0)) < 200, "too short").when(crypto < fixed.MIN_CRYPTO, "insufficient crypto content").when(density < fixed.MIN_RISK_DENSITY, "insufficient risk density").when(ratio > fixed.MAX_FEE_RATIO, "fee schedule").otherwise("")


def _score(crypto: Column, density: Column, ratio: Column, boilerplate: Column) -> Column:
    one = F.lit(1.0)
    return F.least(one, 0.3 * F.least(crypto / 15.0, one) + 0.4 * F.least(density / 15.0, one) + 0.2 * F.when(ratio < 0.2, 1.0).otherwise(0.5) + 0.1 * F.when(boilerplate < 5, 1.0).otherwise(0.5))


def check(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with hits, density, ratio, reason ('' where valid) and confidence of its texts."""
    own = "_hits"
    df = df.withColumns({own: terms.counted(sample(F.col(text))), "sampled": F.length(sample(F.col(text)))})
    df = df.withColumns({f"{n}_hits": F.col(own)[n] for n in terms.LEXICONS}).drop(own)
    df = df.withColumns({
        "risk_density": F.when(F.col("sampled") == 0, 0.0).otherwise(F.col("risk_hits") / (F.col("sampled") / 1000.0)),
        "fee_ratio": F.when(F.col("risk_hits") > 0, F.col("fee_hits") / F.col("risk_hits")).otherwise(1.0),
    })
    reason = _reason(F.length(text), F.col("crypto_hits"), F.col("risk_density"), F.col("fee_ratio"))
    score = _score(F.col("crypto_hits"), F.col("risk_density"), F.col("fee_ratio"), F.col("boilerplate_hits"))
    return df.withColumn("reason", reason).withColumn("confidence", F.when(F.col("reason") == "", score).otherwise(0.0))


def pieces(text: Column) -> Column:
    """The paragraphs of a text; one of fewer than five is cut into runs of sentences of over 400 characters."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def grow(acc: Column, s: Column) -> Column:
        longer = F.concat(acc["open"], s, F.lit(" "))
        full = F.length(longer) > 400
        return F.struct(F.when(full, F.array_append(acc["done"], strip(longer))).otherwise(acc["done"]).alias("done"), F.when(full, F.lit("")).otherwise(longer).alias("open"))

    runs = F.aggregate(sentences(text), empty, grow, lambda a: F.when(strip(a["open"]) != "", F.array_append(a["done"], strip(a["open"]))).otherwise(a["done"]))
    return let(F.split(text, r"\n\s*\n"), lambda plain: F.transform(F.when(F.size(plain) < 5, runs).otherwise(plain), strip))


def paragraphs(df: DataFrame) -> DataFrame:
    """(keys.., pos, p): the pieces of ``text``."""
    keys = [c for c in df.columns if c != "text"]
    return df.select(*keys, F.posexplode(pieces(F.col("text"))).alias("pos", "p"))


def units(text: Column) -> Column:
    """Array of struct(pos, p): the pieces of a text that are long enough to tell something."""
    return F.filter(F.transform(pieces(text), lambda p, i: F.struct(i.alias("pos"), p.alias("p"))), lambda u: F.length(u["p"]) >= 60)


def with_scored(df: DataFrame, wanted: Column) -> DataFrame:
    """``df`` (text, ..) with ``scored``, an array of struct(s, pos, p): the paragraphs on topic and risk of the texts that are ``wanted``, s less than 0.

    Each text's paragraphs are read once for all lexicons.
    """
    own, hits = "_units", "_unit_hits"
    df = df.withColumn(own, F.when(wanted, units(F.col("text"))))
    df = df.withColumn(hits, terms.counted_each(F.col(f"{own}.p")))
    each = F.zip_with(own, hits, lambda u, h: F.when(terms.telling(h), F.struct((-h["crypto"] * h["risk"]).alias("s"), u["pos"].alias("pos"), u["p"].alias("p"))))
    return df.withColumn("scored", F.array_compact(each)).drop(own, hits)


def telling_paragraphs(scored: Column) -> Column:
    """Scored paragraphs up to the cut, best first, as one text; as ``paragraph_text``, in one expression."""
    lengths = lambda acc, x: F.struct((acc["total"] + F.length(x["p"])).alias("total"), (acc["n"] + (acc["total"] <= CUT).cast("int")).alias("n"))
    least = F.aggregate(scored, F.struct(F.lit(0).alias("total"), F.lit(0).alias("n")), lengths)["n"]
    return F.array_join(F.transform(F.array_sort(F.slice(scored, F.lit(1), least)), lambda x: x["p"]), "\n\n")


def scored_paragraphs(df: DataFrame, key: str, most: int = CUT) -> DataFrame:
    """Paragraphs on topic and risk, each with its score, up to the one at which their running length passes ``most``."""
    fine = with_scored(df, F.lit(True)).select(key, F.inline("scored")).withColumn("score", -F.col("s")).drop("s")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return fine.withColumn("total", F.coalesce(F.sum(F.length("p")).over(before), F.lit(0))).where(F.col("total") <= most).drop("total")


def paragraph_text(df: DataFrame, key: str) -> DataFrame:
    """(key, text): the scored paragraphs of each text, best first."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "p")))
    return scored_paragraphs(df, key).groupBy(key).agg(F.array_join(F.transform(best, lambda x: x["p"]), "\n\n").alias("text"))


CANDIDATE = "struct<strategy:string,seq:int,section_type:string,method:string,title:string,text:string,confidence:double>"
SPAN = "struct<strategy:string,seq:int,section_type:string,method:string,title:string,text:string,weight:double>"


def _span(strategy: str, seq: Column, kind: Column, method: Column, title: Column, text: Column, weight: float = 1.0) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), seq.alias("seq"), kind.alias("section_type"), method.alias("method"), title.alias("title"), text.alias("text"), F.lit(weight).alias("weight")).cast(SPAN)


def _with_good(df: DataFrame, name: str, spans: Column) -> DataFrame:
    """``df`` with ``name``: those of ``spans`` that pass the check as candidates, in order; their samples are read together."""
    own, hits = "_spans", "_span_hits"
    df = df.withColumn(own, spans.cast(f"array<{SPAN}>"))
    df = df.withColumn(hits, terms.counted_each(F.transform(F.col(f"{own}.text"), sample)))

    def made(x: Column, h: Column) -> Column:
        fields = [x[f].alias(f) for f in ("strategy", "seq", "section_type", "method", "title", "text")]
        return let(verdict(x["text"], h), lambda v: F.when(v["reason"] == "", F.struct(*fields, (v["confidence"] * x["weight"]).alias("confidence")).cast(CANDIDATE)))

    good = F.coalesce(F.array_compact(F.zip_with(own, hits, made)), F.array().cast(f"array<{CANDIDATE}>"))
    return df.withColumn(name, good).drop(own, hits)


def with_candidates(df: DataFrame) -> DataFrame:
    """``df`` (root_form, text, ..) with ``found``: the candidates of each text by five strategies, in order.

    Later strategies are tried only where earlier ones found none. No text is shuffled;
    what a strategy finds in a text goes to the index of terms at once.
    """
    return with_paragraphs(with_sections(df))


def with_sections(df: DataFrame) -> DataFrame:
    """``df`` with the candidates of the strategies that look for headings, and ``open``: whether paragraphs are still to be tried."""
    root, text, lit = F.col("root_form"), F.col("text"), F.lit
    own, more, told = "found", "_more", F.col("_told")
    empty = F.size(own) == 0
    df = df.withColumn("_told", terms.tells(text)).withColumn("_told", F.coalesce(told, lit(False)))  # no other report or paragraph has a candidate
    a = F.transform(typed_sections(text, root), lambda s: _span("A", s["seq"], s["section_type"], F.concat(lit("typed_"), s["section_type"]), s["title"], s["text"]))
    headers = rows("header", [(h,) for h in fixed.HEADERS])
    c = F.transform(F.slice(header_spans(text), 1, 3), lambda s, i: _span("C", i, lit(fixed.PROSPECTUS_TYPE), lit("prospectus_header"), F.get(headers, s["header_no"])["header"], s["text"]))
    df = _with_good(df, own, F.when(told & root.isin("10-K", "10-Q", "8-K"), a).when(root.isin(*fixed.FUND_FORMS), c))

    tables = [rows("seq section_type method title pattern", [(no, kind, f"boundary_pair_{start}_{end}", f"Item {start}", pair_pattern(start, end)) for no, (kind, start, end) in enumerate(t)]) for t in (fixed.PAIRS_10K, fixed.PAIRS_10Q)]
    largest = lambda p: let(F.get(_spans(text, p["pattern"], 1000), lit(0))["text"], lambda x: F.when(x.isNotNull(), _span("B", p["seq"], p["section_type"], p["method"], p["title"], x)))
    b = F.array_compact(F.transform(F.when(root == "10-K", tables[0]).otherwise(tables[1]), largest))
    df = _with_good(df, more, F.when(told & root.isin(*REPORTS) & empty, b))
    df = df.withColumn(own, F.when(empty, F.slice(more, 1, 1)).otherwise(F.col(own)))  # the first pair whose largest span is good

    wide = F.get(boundary_spans(text, "1A", "2", 500), lit(0))["text"]
    d = let(wide, lambda x: F.when(x.isNotNull(), F.array(_span("D", lit(0), lit(fixed.LENIENT_TYPE), lit("boundary_pair_lenient"), lit(fixed.LENIENT_TITLE), x, LENIENT))))
    df = _with_good(df, more, F.when(told & root.isin(*REPORTS) & empty, d))
    df = df.withColumn(own, F.when(empty, F.col(more)).otherwise(F.col(own)))
    return df.withColumn("open", told & empty).drop("_told", more)


def with_paragraphs(df: DataFrame) -> DataFrame:
    """``df``, as ``with_sections`` leaves it, with the candidate of the paragraphs of texts that are ``open``; no other text is read."""
    own, more, lit, tried = "found", "_more", F.lit, F.col("open")
    joined = telling_paragraphs(F.col("scored"))
    e = let(joined, lambda x: F.when(F.length(x) > PARAGRAPHS_LEAST, F.array(_span("E", lit(0), lit(fixed.PARAGRAPHS_TYPE), lit("paragraph_density"), lit(fixed.PARAGRAPHS_TITLE), x, PARAGRAPHS))))
    df = _with_good(with_scored(df, tried), more, e)
    return df.withColumn(own, F.when(tried, F.col(more)).otherwise(F.col(own))).drop("open", more, "scored")


def candidates(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each candidate of ``texts`` (key, root_form, text)."""
    return with_candidates(texts.select(key, "root_form", "text")).select(key, F.inline("found"))


BEST = "array<struct<place:int,strategy:string,seq:int,section_type:string,method:string,title:string,text:string,confidence:double>>"


def best(found: Column, most: int = 5) -> Column:
    """Candidates in order of confidence, without those much like a better one, ``most`` at most; ``place`` from 1."""
    fields = ["strategy", "seq", "section_type", "method", "title", "text", "confidence"]
    ranked = F.array_sort(F.transform(found, lambda x: F.struct((-F.round(x["confidence"], 6)).alias("c"), *[x[f].alias(f) for f in fields], word_set(F.substring(x["text"], 1, 2000)).alias("words"))))

    def kept(ordered: Column) -> Column:
        take = lambda acc, x: F.when(F.exists(acc, lambda k: overlap(k["words"], x["words"]) > 0.8), acc).otherwise(F.array_append(acc, x))
        return F.aggregate(ordered, F.slice(ordered, 1, 0), take)

    return F.transform(F.slice(let(ranked, kept), 1, most), lambda x, i: F.struct((i + 1).alias("place"), *[x[f].alias(f) for f in fields])).cast(BEST)


def distinct_best(found: DataFrame, key: str = "doc_id", most: int = 5) -> DataFrame:
    """``best`` of candidates that stand in rows of their own."""
    fields = ["strategy", "seq", "section_type", "method", "title", "text", "confidence"]
    return found.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("found")).select(key, F.inline(best(F.col("found"), most)))


def with_best_document(texts: DataFrame, filings: DataFrame, documents: DataFrame, least: int = 3, most: int = 5, key: str = "doc_id", carry: tuple[str, ...] = (), stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(key, best, ..): each filing's best candidates, merged with those of its best document; ``src`` 1 marks the latter.

    Only filings of a form in which several funds share a filing (``filings``: key,
    root_form, accession_no) and whose best document (``documents``: accession_no, seq,
    text, crypto_score) has a score of ``least`` or more get the latter. All texts go
    through the strategies together, once; what is dealt out is their best candidates
    and what is to be carried along (columns of ``texts``). The merge drops no likeness
    again; ties go to the filing's own. Filings without a candidate go. ``stage`` may write
    what goes to the paragraphs and read it again: a task that runs all strategies keeps a
    Python worker for each of them.
    """
    top = documents.groupBy("accession_no").agg(F.min_by(F.struct("text", "crypto_score"), F.struct(-F.col("crypto_score"), "seq")).alias("x"))
    top = top.where(F.col("x.crypto_score") >= least).select("accession_no", "x.text")
    shared = filings.where(F.col("root_form").isin(*fixed.MULTI_FUND_FORMS)).join(top, "accession_no").select(key, "root_form", "text", F.lit(1).alias("src"))
    every = texts.select(key, "root_form", "text", F.lit(0).alias("src"), *carry).unionByName(shared, allowMissingColumns=True)
    fields = ["src", "strategy", "seq", "section_type", "method", "title", "text", "confidence"]
    ranked = lambda x: F.struct((-F.round(x["confidence"], 6)).alias("c"), F.col("src").alias("src"), x["place"].alias("at"), *[x[f].alias(f) for f in fields[1:]])
    tried = with_sections(every).select(key, *carry, "src", "found", "open", F.when(F.col("open"), F.col("text")).alias("text"))
    each = with_paragraphs(stage(tried)).select(key, *carry, F.transform(best(F.col("found"), most), ranked).alias("own"))
    ordered = F.array_sort(F.flatten(F.collect_list("own")))
    merged = F.transform(F.slice(ordered, 1, most), lambda x, i: F.struct((i + 1).alias("place"), *[x[f].alias(f) for f in fields]))
    return each.groupBy(key).agg(merged.alias("best"), *[F.max(c).alias(c) for c in carry]).where(F.size("best") > 0)
