"""Text operators over the filing texts, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskweave.catalog import query
from riskweave.functions import fixed, lexicons, terms, text as T
from riskweave.functions.lexicons import count_sql, has_sql, plain_sql, quoted
from riskweave.operators import extract as E
from riskweave.operators import metadata as M
from riskweave.operators import records, store, warehouse
from riskweave.operators import summary as Y
from riskweave.session import work_folder
from riskweave.sources.corpus import BLOCKS, literal

_LEX = ("crypto", "risk", "fee", "boilerplate")


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def words_sql(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"


def fold_sql(values: str, step: str, empty: str = "[]") -> str:
    """A fold over singletons: ``acc`` the list so far, ``x`` the next singleton."""
    return f"CASE WHEN coalesce(len({values}), 0) = 0 THEN {empty} ELSE list_reduce(list_transform({values}, lambda v: [v]), lambda acc, x: {step}) END"


def checked(name: str, source: str) -> str:
    """Common table expression ``name``: ``source`` (with a column text) and the check's columns."""
    hits = ", ".join(f"{count_sql('pt', n)} AS {n}_hits" for n in _LEX)
    return f"""{name} AS (SELECT * EXCLUDE (pt, score), CASE WHEN reason = '' THEN score ELSE 0.0::DOUBLE END AS confidence FROM (SELECT *,
  CASE WHEN text IS NULL OR length(text) < 200 THEN 'too short' WHEN crypto_hits < {fixed.MIN_CRYPTO} THEN 'insufficient crypto content' WHEN risk_density < {fixed.MIN_RISK_DENSITY} THEN 'insufficient risk density' WHEN fee_ratio > {fixed.MAX_FEE_RATIO} THEN 'fee schedule' ELSE '' END AS reason,
  least(1.0::DOUBLE, 0.3::DOUBLE * least(crypto_hits / 15.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * least(risk_density / 15.0::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN fee_ratio < 0.2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.1::DOUBLE * CASE WHEN boilerplate_hits < 5 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS score
  FROM (SELECT *, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE risk_hits / (n / 1000.0::DOUBLE) END AS risk_density, CASE WHEN risk_hits > 0 THEN fee_hits::DOUBLE / risk_hits ELSE 1.0::DOUBLE END AS fee_ratio
  FROM (SELECT *, length(substr(text, 1, 40000)) AS n, {hits} FROM (SELECT *, {plain_sql("substr(text, 1, 40000)")} AS pt FROM {source})))))"""


def spans_sql(start: str, end: str, least: int) -> str:
    """The largest span between two headings, or null."""
    found = f"list_filter(regexp_extract_all(text, {quoted(E.pair_pattern(start, end))}, 1), lambda s: length(s) >= {least})"
    ranked = f"list_sort(list_transform({found}, lambda s, i: {{'r': -length(s), 'i': i, 't': {strip_sql('s')}}}))"
    return f"({ranked})[1].t"


# -- lexicons and the section check --


@query("lexicon_counts", f"SELECT doc_id, {', '.join(f'{count_sql(chr(112), n)} AS {n}_hits' for n in _LEX)} FROM (SELECT doc_id, {plain_sql('text')} AS p FROM texts)")
def _(f):
    counts = f.texts.select("doc_id", terms.counted("text").alias("hits"))
    return counts.select("doc_id", *[F.col("hits")[n].cast("long").alias(f"{n}_hits") for n in _LEX])


def _positions_sql(n: str) -> str:
    pieces = f"string_split_regex(p, {quoted('(?i)' + lexicons.body(n))})"
    found = f"regexp_extract_all(p, {quoted('(?i)' + lexicons.body(n))})"
    return f"""SELECT doc_id, '{n}' AS lexicon, len(m) AS n, CAST(list_sum(list_transform(m, lambda x: length(x))) AS BIGINT) AS covered, length(s[1]) AS first_start,
  CAST(list_sum(list_transform(s, lambda x, i: length(x) * (len(m) + 1 - i))) + list_sum(list_transform(m, lambda x, i: length(x) * (len(m) - i))) AS BIGINT) AS start_sum FROM (SELECT doc_id, {pieces} AS s, {found} AS m FROM plain_texts) WHERE len(m) > 0"""


@query("term_positions", f", plain_texts AS (SELECT doc_id, {plain_sql('text')} AS p FROM texts) {' UNION ALL '.join(map(_positions_sql, _LEX))}")
def _(f):
    """Where each text's terms stand, by lexicon: how many, how many characters, the first start and the sum of all starts."""
    each = f.texts.select("doc_id", F.inline(terms.index("text")))
    names = F.array(*map(F.lit, terms.LEXICONS))
    sums = each.groupBy("doc_id", F.get(names, F.col("lexicon")).alias("lexicon"))
    return sums.agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").cast("long").alias("first_start"), F.sum("start").alias("start_sum"))


_SIGNALS = ["crypto_hits", "risk_hits", "fee_hits", "boilerplate_hits"]


@query("validate_section", f", {checked('done', 'passages')} SELECT doc_id, reason = '' AS valid, round(confidence, 6) AS confidence, {', '.join(_SIGNALS)}, round(risk_density, 6) AS risk_density, round(fee_ratio, 6) AS fee_ratio FROM done")
def _(f):
    done = E.check(f.passages)
    return done.select("doc_id", (F.col("reason") == "").alias("valid"), F.round("confidence", 6).alias("confidence"), *[F.col(c).cast("long").alias(c) for c in _SIGNALS], F.round("risk_density", 6).alias("risk_density"), F.round("fee_ratio", 6).alias("fee_ratio"))


@query("validate_reject_reason", f", {checked('done', 'passages')} SELECT reason, count(*) AS n FROM done GROUP BY 1")
def _(f):
    return E.check(f.passages).groupBy("reason").agg(F.count("*").alias("n"))


# -- spans --


@query("extract_boundary_pair", f"SELECT doc_id, i AS nth, length(s) AS size, md5({strip_sql('s')}) AS digest FROM (SELECT doc_id, unnest(spans) AS s, generate_subscripts(spans, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, {quoted(E.pair_pattern('1A', '1B'))}, 1) AS spans FROM texts)) WHERE length(s) >= 1000")
def _(f):
    spans = f.texts.select("doc_id", F.inline(E.boundary_spans(F.col("text"), "1A", "1B")))
    return spans.select("doc_id", (F.col("nth") + 1).cast("long").alias("nth"), F.col("size").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("boundary_lenient", f", spans AS (SELECT doc_id, {spans_sql('1A', '2', 500)} AS text FROM texts WHERE root_form IN ('10-K', '10-Q')), {checked('done', '(SELECT * FROM spans WHERE text IS NOT NULL)')} SELECT doc_id, reason, round(confidence * 0.8, 6) AS confidence, length(text) AS size FROM done")
def _(f):
    spans = f.texts.where(F.col("root_form").isin(*E.REPORTS)).select("doc_id", F.get(E.boundary_spans(F.col("text"), "1A", "2", 500), 0)["text"].alias("text")).where("text IS NOT NULL")
    return E.check(spans).select("doc_id", "reason", F.round(F.col("confidence") * E.LENIENT, 6).alias("confidence"), F.length("text").cast("long").alias("size"))


_TAIL = quoted(r"(?im)(?:^|\n)\s*(?:" + "|".join(fixed.END_LINES) + r")\b")
_HEADERS_SQL = f"""headers(no, header) AS (VALUES {", ".join(f"({i}, {quoted(h)})" for i, h in enumerate(fixed.HEADERS))}),
cut AS (SELECT doc_id, text, no, length(header) AS hl, regexp_split_to_array(text, '(?i)\\Q' || header || '\\E') AS pieces FROM texts, headers WHERE contains(lower(text), lower(header))),
piece AS (SELECT doc_id, text, no, hl, len(pieces) AS k, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM cut),
placed AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id, no ORDER BY i) + i * hl AS pos FROM piece),
around AS (SELECT doc_id, text, no, i, pos, lower(substr(text, CAST(greatest(pos - hl - 80, 0) + 1 AS BIGINT), CAST(least(pos - hl, 80) AS BIGINT))) AS bef, lower(substr(text, CAST(pos + 1 AS BIGINT), 120)) AS aft, substr(text, CAST(pos + 301 AS BIGINT)) AS rest FROM placed WHERE i < k),
ended AS (SELECT *, CASE WHEN regexp_matches(rest, {_TAIL}) THEN pos + 300 + length(regexp_split_to_array(rest, {_TAIL})[1]) ELSE least(pos + 80000, length(text)) END AS stop FROM around
  WHERE NOT contains(bef, 'see ') AND NOT contains(bef, 'refer to ') AND NOT contains(bef, 'beginning on page') AND NOT (contains(aft, 'on page') AND length(aft) < 80)),
prospectus AS (SELECT doc_id, no, i AS nth, {strip_sql("substr(text, CAST(pos + 1 AS BIGINT), CAST(stop - pos AS BIGINT))")} AS own FROM ended)"""


@query("extract_prospectus", f", {_HEADERS_SQL} SELECT doc_id, no AS header_no, nth, length(own) AS size, md5(own) AS digest FROM prospectus WHERE length(own) >= 800")
def _(f):
    spans = f.texts.select("doc_id", F.inline(E.header_spans(F.col("text"))))
    return spans.select("doc_id", "header_no", F.col("nth").cast("long").alias("nth"), F.col("size").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _wanted_sql(root: str, table, parts: bool) -> str:
    rows = []
    for seq, (kind, part, code, title) in enumerate(table):
        test = f"item = '{code}'" + (f" AND part = '{part}'" if parts else "")
        rows.append(f"SELECT doc_id, root_form, {seq} AS seq, '{kind}' AS section_type, '{title}' AS title, arg_min(text, [-length(text), pi, ii]) AS text FROM report_items WHERE root_form = '{root}' AND {test} GROUP BY 1, 2")
    return " UNION ALL ".join(rows)


_TYPED = rf"""report_parts AS (SELECT doc_id, root_form, unnest(ps) AS q, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, root_form, string_split(regexp_replace(translate(text, chr(1) || chr(2), ''), {quoted(E.PART)}, chr(10) || chr(2) || '\1', 'g'), chr(2)) AS ps FROM texts WHERE root_form IN ('10-K', '10-Q', '8-K'))),
report_items AS (SELECT doc_id, root_form, pi, ii, upper(regexp_extract(q, {quoted(E.PART_NAME)}, 1)) AS part, upper(regexp_replace(regexp_extract(p, {quoted(E.ITEM_NAME)}, 1), '\s', '', 'g')) AS item, {strip_sql('p')} AS text
  FROM (SELECT doc_id, root_form, q, pi, unnest(l) AS p, generate_subscripts(l, 1) AS ii FROM (SELECT *, string_split(regexp_replace(q, {quoted(E.ITEM)}, chr(10) || chr(1) || '\1', 'g'), chr(1)) AS l FROM report_parts)) WHERE ii > 1),
typed AS ({_wanted_sql('10-K', fixed.TYPED_10K, False)} UNION ALL {_wanted_sql('10-Q', fixed.TYPED_10Q, True)}
  UNION ALL SELECT doc_id, root_form, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS seq, '{fixed.TYPED_8K}' AS section_type, 'Item ' || item AS title, text FROM (SELECT doc_id, root_form, item, min([pi, ii]) AS first, arg_min(text, [-length(text), pi, ii]) AS text FROM report_items WHERE root_form = '8-K' GROUP BY 1, 2, 3)),
{checked('typed_done', "(SELECT * FROM typed WHERE length(text) >= CASE WHEN root_form = '8-K' THEN 400 ELSE 500 END)")}"""


@query("extract_typed_sections", f", {_TYPED} SELECT doc_id, seq, section_type, title, round(confidence, 6) AS confidence, length(text) AS size FROM typed_done WHERE reason = ''")
def _(f):
    """The sections of every report, found by its headings, that pass the check."""
    sections = f.texts.select("doc_id", F.inline(E.typed_sections(F.col("text"), F.col("root_form"))))
    done = E.check(sections).where("reason = ''")
    return done.select("doc_id", F.col("seq").cast("long").alias("seq"), "section_type", "title", F.round("confidence", 6).alias("confidence"), F.length("text").cast("long").alias("size"))


# -- paragraphs --

_SENTENCES = "string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_CHUNK = "struct_pack(done := CASE WHEN length(acc[1].o || x[1].o) > 400 THEN acc[1].done || [" + strip_sql("acc[1].o || x[1].o") + "] ELSE acc[1].done END, o := CASE WHEN length(acc[1].o || x[1].o) > 400 THEN '' ELSE acc[1].o || x[1].o END)"
# the first sentence starts the fold, so it is closed here if it is long enough by itself
_START = "list_transform({s}, lambda v, i: struct_pack(done := CASE WHEN i = 1 AND length(v) > 399 THEN [" + strip_sql("v") + "] ELSE []::VARCHAR[] END, o := CASE WHEN i = 1 AND length(v) > 399 THEN '' ELSE v || ' ' END))"


def _paragraphs_sql(source: str) -> str:
    sent = _SENTENCES.format(x="text")
    return f"""run AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n\\s*\\n') AS plain, CASE WHEN len(regexp_split_to_array(text, '\\n\\s*\\n')) < 5 THEN list_reduce(list_transform({_START.format(s=sent)}, lambda v: [v]), lambda acc, x: [{_CHUNK}])[1] END AS r FROM {source}),
pieces AS (SELECT doc_id, CASE WHEN len(plain) >= 5 THEN plain WHEN {strip_sql('r.o')} <> '' THEN r.done || [{strip_sql('r.o')}] ELSE r.done END AS ps FROM run),
para AS (SELECT doc_id, {strip_sql('p')} AS p, pos FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM pieces)),
scored AS (SELECT doc_id, pos, p, {count_sql('q', 'crypto')} * {count_sql('q', 'risk')} AS score FROM (SELECT *, {plain_sql('p')} AS q FROM para) WHERE length(p) >= 60 AND NOT {has_sql('q', 'boilerplate')} AND NOT {has_sql('q', 'fee')}),
cuts AS (SELECT *, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS total FROM scored WHERE score > 0)"""


@query("sentence_chunks", f", {_paragraphs_sql('passages')} SELECT doc_id, pos, length(p) AS size, md5(p) AS digest FROM para")
def _(f):
    return E.paragraphs(f.passages).select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("p").cast("long").alias("size"), F.md5(F.col("p").cast("binary")).alias("digest"))


# copies of a telling block make every fiftieth text longer than the cut
_LONG = "SELECT doc_id, text || CASE WHEN doc_id % 50 = 4 THEN repeat(" + literal(BLOCKS["paragraphs"]) + ", 120) ELSE '' END AS text FROM texts"


@query("paragraph_running_cut", f", long AS ({_LONG}), {_paragraphs_sql('long')} SELECT doc_id, pos, score FROM cuts WHERE total <= 60000")
def _(f):
    long = F.when(F.col("doc_id") % 50 == 4, F.repeat(F.lit(BLOCKS["paragraphs"]), F.lit(120))).otherwise("")
    return E.scored_paragraphs(f.texts.select("doc_id", F.concat("text", long).alias("text")), "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("score").cast("long").alias("score"))


_PARA_TEXT = "SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY score DESC, pos) AS text FROM cuts WHERE total <= 60000 GROUP BY 1"


@query("crypto_paragraphs", f", {_paragraphs_sql('texts')} SELECT doc_id, length(text) AS size, md5(text) AS digest FROM ({_PARA_TEXT})")
def _(f):
    made = E.paragraph_text(f.texts.select("doc_id", "text"), "doc_id")
    return made.select("doc_id", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("paragraph_fallback", f", {_paragraphs_sql('texts')}, {checked('done', '(SELECT * FROM (' + _PARA_TEXT + ') WHERE length(text) > 500)')} SELECT doc_id, reason, round(confidence * 0.6, 6) AS confidence FROM done")
def _(f):
    made = E.paragraph_text(f.texts.select("doc_id", "text"), "doc_id").where(F.length("text") > E.PARAGRAPHS_LEAST)
    return E.check(made).select("doc_id", "reason", F.round(F.col("confidence") * E.PARAGRAPHS, 6).alias("confidence"))


# -- all strategies --


def _pairs_sql() -> str:
    rows = []
    for root, pairs in (("10-K", fixed.PAIRS_10K), ("10-Q", fixed.PAIRS_10Q)):
        for no, (kind, start, end) in enumerate(pairs):
            rows.append(f"SELECT doc_id, {no} AS seq, '{kind}' AS section_type, 'boundary_pair_{start}_{end}' AS method, 'Item {start}' AS title, {spans_sql(start, end, 1000)} AS text FROM open_b WHERE root_form = '{root}'")
    return " UNION ALL ".join(rows)


_FUNDS = ", ".join(f"'{x}'" for x in fixed.FUND_FORMS)
_SHAPE = "seq, section_type, method, title, text"
_ALL = f""", {_TYPED}, a AS (SELECT doc_id, 'A' AS strategy, seq, section_type, 'typed_' || section_type AS method, title, text, confidence FROM typed_done WHERE reason = ''),
open_b AS (SELECT * FROM texts WHERE root_form IN ('10-K', '10-Q') AND doc_id NOT IN (SELECT doc_id FROM a)), tries AS ({_pairs_sql()}), {checked('b_done', '(SELECT * FROM tries WHERE text IS NOT NULL)')},
b AS (SELECT doc_id, 'B' AS strategy, {_SHAPE}, confidence FROM b_done WHERE reason = '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1), {_HEADERS_SQL},
tops AS (SELECT doc_id, header AS title, own AS text, row_number() OVER (PARTITION BY doc_id ORDER BY length(own) DESC, no, nth) - 1 AS seq FROM prospectus JOIN headers USING (no) WHERE length(own) >= 800 AND doc_id IN (SELECT doc_id FROM texts WHERE root_form IN ({_FUNDS})) QUALIFY seq < 3),
{checked('c_done', 'tops')}, c AS (SELECT doc_id, 'C' AS strategy, seq, '{fixed.PROSPECTUS_TYPE}' AS section_type, 'prospectus_header' AS method, title, text, confidence FROM c_done WHERE reason = ''),
found_ab AS (SELECT doc_id FROM a UNION SELECT doc_id FROM b), wide AS (SELECT doc_id, {spans_sql('1A', '2', 500)} AS text FROM texts WHERE root_form IN ('10-K', '10-Q') AND doc_id NOT IN (SELECT doc_id FROM found_ab)),
{checked('d_done', '(SELECT * FROM wide WHERE text IS NOT NULL)')}, d AS (SELECT doc_id, 'D' AS strategy, 0 AS seq, '{fixed.LENIENT_TYPE}' AS section_type, 'boundary_pair_lenient' AS method, '{fixed.LENIENT_TITLE}' AS title, text, confidence * 0.8::DOUBLE AS confidence FROM d_done WHERE reason = ''),
found_abcd AS (SELECT doc_id FROM found_ab UNION SELECT doc_id FROM c UNION SELECT doc_id FROM d), {_paragraphs_sql('(SELECT * FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM found_abcd))')},
{checked('e_done', '(SELECT * FROM (' + _PARA_TEXT + ') WHERE length(text) > 500)')}, e AS (SELECT doc_id, 'E' AS strategy, 0 AS seq, '{fixed.PARAGRAPHS_TYPE}' AS section_type, 'paragraph_density' AS method, '{fixed.PARAGRAPHS_TITLE}' AS title, text, confidence * 0.6::DOUBLE AS confidence FROM e_done WHERE reason = ''),
cands AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e)"""
_OVER = "CASE WHEN least(len(k.w), len(x[1].w)) = 0 THEN 0.0 ELSE len(list_intersect(k.w, x[1].w)) / least(len(k.w), len(x[1].w))::DOUBLE END"
_BEST = f"""sorted AS (SELECT doc_id, list({{'s': strategy, 'q': seq, 'y': section_type, 'm': method, 'h': title, 'c': round(confidence, 6), 't': text, 'w': {words_sql('substr(text, 1, 2000)')}}} ORDER BY round(confidence, 6) DESC, strategy, seq) AS l FROM cands GROUP BY 1),
kept AS (SELECT doc_id, {fold_sql('l', f'CASE WHEN len(list_filter(acc, lambda k: {_OVER} > 0.8)) > 0 THEN acc ELSE acc || x END')} AS ks FROM sorted),
best AS (SELECT doc_id, i AS place, k.s AS strategy, k.y AS section_type, k.m AS method, k.h AS title, k.c AS confidence, k.t AS text FROM (SELECT doc_id, unnest(ks) AS k, generate_subscripts(ks, 1) AS i FROM kept) WHERE i <= 5)"""


@query("extract_all_candidates", f"{_ALL} SELECT doc_id, strategy, seq, section_type, method, title, round(confidence, 6) AS confidence, length(text) AS size FROM cands")
def _(f):
    found = E.candidates(f.texts)
    return found.select("doc_id", "strategy", F.col("seq").cast("long").alias("seq"), "section_type", "method", "title", F.round("confidence", 6).alias("confidence"), F.length("text").cast("long").alias("size"))


@query("run_outcomes", f"""{_ALL}, told AS (SELECT DISTINCT doc_id FROM cands)
SELECT form_type, count(*) AS total, count(told.doc_id) AS saved, count(*) FILTER (text = '') AS failed, count(*) - count(told.doc_id) - count(*) FILTER (text = '') AS dropped FROM texts LEFT JOIN told USING (doc_id) GROUP BY 1""")
def _(f):
    """What became of a run's filings by form: saved with a section, failed as no text was had, dropped as nothing in it was a section."""
    found = E.with_candidates(f.texts.select("doc_id", "form_type", "root_form", "text"))
    ended = found.select("form_type", (F.size("found") > 0).alias("saved"), (F.col("text") == "").alias("failed"))
    return ended.groupBy("form_type").agg(F.count("*").alias("total"), F.count_if("saved").alias("saved"), F.count_if("failed").alias("failed"), F.count_if(~F.col("saved") & ~F.col("failed")).alias("dropped"))


@query("candidate_dedup", f"{_ALL}, {_BEST} SELECT doc_id, place, strategy, method, confidence FROM best")
def _(f):
    kept = E.with_candidates(f.texts.select("doc_id", "root_form", "text")).select("doc_id", F.inline(E.best(F.col("found"))))
    return kept.select("doc_id", F.col("place").cast("long").alias("place"), "strategy", "method", F.round("confidence", 6).alias("confidence"))


# filings of a form in which funds share a filing: the candidates of the best document too, if it names the topic three times
_MULTI = "('485APOS', '485BPOS', 'N-1A', 'N-1A/A')"
_BEST_DOC = f"""best_docs AS (SELECT t.doc_id, t.form_type, t.root_form, t.company_name, d.text FROM texts t JOIN (SELECT accession_no, text, crypto_score FROM (SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY crypto_score DESC, seq) AS place
  FROM (SELECT *, {count_sql('p', 'crypto')} AS crypto_score FROM (SELECT *, {plain_sql('substr(text, 1, 20000)')} AS p FROM fund_docs WHERE seq < 5 AND is_binary = 0 AND length(text) >= 500))) WHERE place = 1) d
  ON d.accession_no = 'F' || CAST(t.doc_id - t.doc_id % 8 AS VARCHAR) WHERE t.root_form IN {_MULTI} AND d.crypto_score >= 3)"""
_MERGED = f"""{_BEST}, {_BEST_DOC}, extra AS (WITH texts AS (SELECT * FROM best_docs){_ALL}, {_BEST} SELECT * FROM best),
merged AS (SELECT doc_id, src, strategy, section_type, method, title, confidence, text, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, src, place) AS place FROM (SELECT *, 0 AS src FROM best UNION ALL SELECT *, 1 AS src FROM extra) QUALIFY place <= 5)"""


def _merged(f):
    docs = f.fund_docs.where("seq < 5 AND is_binary = 0").where(F.length("text") >= 500).withColumn("crypto_score", terms.counted(F.substring("text", 1, 20_000))["crypto"])
    filings = f.texts.select("doc_id", "root_form", F.concat(F.lit("F"), (F.col("doc_id") - F.col("doc_id") % 8).cast("string")).alias("accession_no"))
    return E.with_best_document(f.texts, filings, docs).select("doc_id", F.inline("best"))


@query("multi_fund_merge", f"{_ALL}, {_MERGED} SELECT doc_id, place, src, strategy, method, confidence, length(text) AS size FROM merged")
def _(f):
    """Candidates of the filing and, for shared fund filings, of its best document; merged without another dedup."""
    best = _merged(f)
    return best.select("doc_id", F.col("place").cast("long").alias("place"), "src", "strategy", "method", F.round("confidence", 6).alias("confidence"), F.length("text").cast("long").alias("size"))


_NAME = ", ".join("CASE WHEN length({0}) BETWEEN 9 AND 79 THEN {0} END".format(strip_sql(f"regexp_extract(substr(text, 1, 3000), {quoted(p)}, 1)")) for p in fixed.FUND_NAMES)


@query("fund_documents", f", found AS (SELECT accession_no, seq, name, {count_sql('p', 'crypto')} AS crypto_score FROM (SELECT *, {plain_sql('substr(text, 1, 20000)')} AS p FROM fund_docs WHERE seq < 5 AND is_binary = 0 AND length(text) >= 500)) SELECT *, row_number() OVER (PARTITION BY accession_no ORDER BY crypto_score DESC, seq) - 1 AS doc_seq FROM found")
def _(f):
    docs = f.fund_docs.where("seq < 5 AND is_binary = 0").where(F.length("text") >= 500).withColumn("crypto_score", terms.counted(F.substring("text", 1, 20_000))["crypto"].cast("long"))
    return store.ranked_documents(docs).select("accession_no", "seq", "name", "crypto_score", F.col("doc_seq").cast("long").alias("doc_seq"))


@query("fund_name", f"SELECT accession_no, seq, coalesce({_NAME}, '') AS fund FROM (SELECT accession_no, seq, {plain_sql('text')} AS text FROM fund_docs)")
def _(f):
    plain = F.regexp_replace("text", "[À-ÖØ-öø-ÿ]", "x")
    return f.fund_docs.select("accession_no", "seq", T.fund_name(plain).alias("fund"))


# -- scalars --


@query("html_to_text")
def _(f):
    """Readable text of whole pages (no SQL twin: a parser's work)."""
    return f.html_pages.select("page_id", T.html_to_text("html").alias("text"))


@query("html_strip_simple", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def _(f):
    return f.pages.select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("toc_table_flag", "SELECT page_id, length(table_text) < 2000 AND ((len(regexp_extract_all(table_text, '(?i)\\bItem\\s+\\d+[A-Z]?\\b')) >= 3 AND len(regexp_extract_all(table_text, '\\b\\d{1,3}\\b')) >= 3) OR regexp_matches(table_text, '(?i)table\\s+of\\s+contents')) AS contents FROM html_pages")
def _(f):
    return f.html_pages.select("page_id", T.toc_table(F.col("table_text")).alias("contents"))


@query("ascii_fold", "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(strip_accents(replace(replace(text, 'ß', ''), 'ẞ', '')), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)")
def _(f):
    folded = f.documents.select("doc_id", T.ascii_fold("text").alias("t"))
    return folded.select("doc_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


_LINES = "list_transform(string_split(replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;'), chr(10)), lambda x: " + strip_sql("x") + ")"
_MARKUP = f"""bare AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\\n\\s*\\d{{1,3}}\\s*\\n', chr(10), 'g'), '(?i)\\nTable of Contents\\n', chr(10), 'g') AS b FROM passages),
parts AS (SELECT doc_id, {strip_sql('p')} AS p, i FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(b, '\\n\\s*\\n') AS ps FROM bare))),
lined AS (SELECT *, {_LINES} AS lines, {plain_sql('p')} AS q FROM parts WHERE length(p) >= 5),
shown AS (SELECT doc_id, i, CASE WHEN len(lines) > 1 AND len(list_filter(lines, lambda x: regexp_matches(x, '^[•●\\-*(\\d]'))) > 0.3 * len(lines) THEN array_to_string(list_filter(lines, lambda x: x <> ''), '<br>') ELSE array_to_string(list_filter(lines, lambda x: x <> ''), ' ') END AS body,
  length(p) < 120 AND NOT regexp_matches(p, '[.,]$') AND regexp_matches(p, '[A-Z]') AND NOT {has_sql('q', 'boilerplate')} AND NOT {has_sql('q', 'fee')} AS heading FROM lined),
markup AS (SELECT doc_id, string_agg(CASE WHEN heading THEN '<h4 class="risk">' || body || '</h4>' ELSE '<p class="risk">' || body || '</p>' END, '' ORDER BY i) AS m FROM shown GROUP BY 1)"""


@query("risk_html", f", {_MARKUP} SELECT doc_id, length(coalesce(m, '')) AS size, md5(coalesce(m, '')) AS digest FROM bare LEFT JOIN markup USING (doc_id)")
def _(f):
    """Risk texts as HTML."""
    made = f.passages.select("doc_id", T.risk_html(F.col("text")).alias("m"))
    return made.select("doc_id", F.length("m").cast("long").alias("size"), F.md5(F.col("m").cast("binary")).alias("digest"))


_TOKENS = f"list_transform(regexp_extract_all({plain_sql('substr(text, 1, 5000)')}, {quoted('(?i)' + lexicons.body('crypto'))}), lambda t: lower(t))"
_JOINED = "array_to_string(list_slice(toks, 1, 5), ' or ')"
CONNECTION_SQL = f"""SELECT doc_id, CASE WHEN text = '' OR len(toks) = 0 THEN 'Crypto-related filing.' WHEN root_form IN ({_FUNDS}) THEN 'Proposes ' || {_JOINED} || ' ETF, fund, or security offering.' WHEN root_form IN ('10-K', '10-Q') THEN 'Reports ' || {_JOINED} || ' operations with risk disclosures.'
WHEN root_form = '8-K' THEN 'Discloses ' || {_JOINED} || ' material event or corporate action.' ELSE 'Filing related to ' || {_JOINED} || '.' END AS connection FROM (SELECT doc_id, root_form, text, {fold_sql("m", "CASE WHEN list_contains(acc, x[1]) THEN acc ELSE acc || x END")} AS toks FROM (SELECT *, {_TOKENS} AS m FROM texts))"""


@query("crypto_connection", CONNECTION_SQL)
def _(f):
    """The first five topic words in order of appearance, in the sentence of the form."""
    return f.texts.select("doc_id", M.connection(F.col("text"), F.col("root_form")).alias("connection"))


@query("word_overlap", f"""SELECT doc_id, round(CASE WHEN least(len(a), len(b)) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE END, 6) AS overlap FROM (SELECT p.doc_id, {words_sql("p.text")} AS a, {words_sql("substr(t.text, 1, 2000)")} AS b FROM passages p JOIN texts t USING (doc_id))""")
def _(f):
    both = f.passages.join(f.texts.select("doc_id", F.col("text").alias("other")), "doc_id")
    return both.select("doc_id", F.round(T.overlap(T.word_set(F.col("text")), T.word_set(F.substring("other", 1, 2000))), 6).alias("overlap"))


# -- summaries --

_ASSETS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {quoted(p)}) THEN '{label}' END" for p, label in fixed.ASSETS) + "], lambda a: a IS NOT NULL)"
_AREAS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, {quoted(p)}) THEN '{label}' END" for label, p in fixed.RISK_CATEGORIES) + "], lambda a: a IS NOT NULL)"
_PHRASE = "CASE form_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.FORM_PHRASES.items()) + " ELSE form_type || ' filing' END"
_GATE = f"length(text) >= 200 AND {count_sql('g', 'crypto')} >= 3 AND {count_sql('g', 'risk')} >= 5 AND {count_sql('g', 'fee')} <= 0.5 * {count_sql('g', 'risk')}"
_SENT = f"""told_of AS (SELECT * FROM texts), sents AS (SELECT doc_id, {strip_sql('s')} AS s, pos FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {_SENTENCES.format(x="substr(text, 1, 50000)")} AS l FROM told_of))),
marked AS (SELECT *, {plain_sql('s')} AS q FROM sents WHERE length(s) BETWEEN 80 AND 450), hits AS (SELECT *, {count_sql('q', 'crypto')} AS c, {count_sql('q', 'risk')} AS r FROM marked WHERE NOT ({has_sql('q', 'generic')} OR {has_sql('q', 'boilerplate')} OR {has_sql('q', 'fee')})),
telling AS (SELECT doc_id, pos, s, (c * 3 + r * 2 + {count_sql('q', 'specific')} * 5 - {count_sql('q', 'hedge')} * 0.5)::DOUBLE AS score FROM hits WHERE c > 0 AND r > 0)""".replace("hits AS", "rated AS").replace("FROM hits", "FROM rated")
_PICKED = f"""lists AS (SELECT doc_id, list({{'s': s, 'w': {words_sql('s')}}} ORDER BY score DESC, pos) AS l FROM telling GROUP BY 1),
picks AS (SELECT doc_id, list_transform({fold_sql('l', 'CASE WHEN len(acc) >= 3 OR len(list_filter(acc, lambda k: len(list_intersect(x[1].w, k.w)) / greatest(len(x[1].w), 1)::DOUBLE > 0.4)) > 0 THEN acc ELSE acc || x END')}, lambda k: k.s) AS picked FROM lists)"""


@query("summary_gate", f"SELECT doc_id, {_GATE} AS open FROM (SELECT *, {plain_sql('substr(text, 1, 30000)')} AS g FROM texts)")
def _(f):
    counts = f.texts.select("doc_id", "text", terms.counted(Y.gated(F.col("text"))).alias("hits"))
    return counts.select("doc_id", Y.gate(F.col("text"), F.col("hits")).alias("open"))


@query("detect_assets", f"SELECT doc_id, array_to_string({_ASSETS}, ', ') AS assets FROM (SELECT doc_id, {plain_sql('lower(substr(text, 1, 10000))')} AS low FROM texts)")
def _(f):
    return f.texts.select("doc_id", F.array_join(Y.assets(F.col("text")), ", ").alias("assets"))


_TICK = "CASE a " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.TICKERS.items()) + " END"


@query("asset_tickers", f"SELECT doc_id, array_to_string(list_transform(list_slice({_ASSETS}, 1, 5), lambda a: {_TICK}), ', ') AS tickers FROM (SELECT doc_id, {plain_sql('lower(substr(text, 1, 10000))')} AS low FROM texts)")
def _(f):
    return f.texts.select("doc_id", F.array_join(Y.tickers(Y.assets(F.col("text"))), ", ").alias("tickers"))


@query("form_phrase", f"SELECT DISTINCT form_type, {_PHRASE} AS phrase FROM filings")
def _(f):
    return f.filings.select("form_type", Y.form_phrase(F.col("form_type")).alias("phrase")).distinct()


@query("risk_categories", f"SELECT doc_id, array_to_string({_AREAS}, '; ') AS areas FROM (SELECT doc_id, lower(substr(text, 1, 60000)) AS low FROM texts)")
def _(f):
    return f.texts.select("doc_id", F.array_join(Y.risk_categories(F.col("text")), "; ").alias("areas"))


@query("summary_sentence_scores", f", {_SENT} SELECT doc_id, pos, score, md5(s) AS digest FROM telling")
def _(f):
    return Y.scored_sentences(f.texts.select("doc_id", "text")).select("doc_id", F.col("pos").cast("long").alias("pos"), "score", F.md5(F.col("s").cast("binary")).alias("digest"))


@query("summary_sentences", f", {_SENT}, {_PICKED} SELECT doc_id, len(picked) AS n, array_to_string(picked, ' ') AS picked FROM picks")
def _(f):
    best = Y.best_sentences(f.texts.select("doc_id", "text"), "doc_id")
    return best.select("doc_id", F.size("picked").cast("long").alias("n"), F.array_join("picked", " ").alias("picked"))


_SUMMARY = f"""{_SENT}, {_PICKED}, gated AS (SELECT doc_id, form_type, company_name, {_GATE} AS open, {_ASSETS.replace("low", "lowa")} AS assets, {_AREAS} AS areas FROM (SELECT *, {plain_sql('substr(text, 1, 30000)')} AS g, {plain_sql('lower(substr(text, 1, 10000))')} AS lowa, lower(substr(text, 1, 60000)) AS low FROM told_of)),
told AS (SELECT doc_id, CASE WHEN open THEN company_name || ' — ' || {_PHRASE} || CASE WHEN len(assets) > 0 THEN ' involving ' || array_to_string(list_slice(assets, 1, 3), ', ') ELSE '' END || '.'
  || CASE WHEN len(areas) > 0 THEN ' Risk disclosure covers ' || len(areas) || ' crypto-relevant areas: ' || array_to_string(list_slice(areas, 1, 5), '; ') || CASE WHEN len(areas) > 5 THEN ' (and ' || (len(areas) - 5) || ' more).' ELSE '.' END ELSE '' END
  || CASE WHEN len(picked) > 0 THEN ' ' || array_to_string(picked, ' ') ELSE '' END ELSE '' END AS summary FROM gated LEFT JOIN picks USING (doc_id))"""


@query("template_summary", f", {_SUMMARY} SELECT * FROM told")
def _(f):
    return Y.template_summary(f.texts.select("doc_id", "form_type", "company_name", "text"), "doc_id")


_REPLY = "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'short reply' ELSE '{\"summary\": \"A hosted summary of filing ' || doc_id || ' that is long enough to be used.\"}' END"


@query("summary_backend", f""", {_SUMMARY}, asked AS (SELECT *, CASE WHEN json_valid(r) THEN json_extract_string(r, '$.summary') ELSE r END AS reply FROM (SELECT *, {_REPLY} AS r FROM told))
SELECT doc_id, CASE WHEN length(reply) > 40 AND summary <> '' THEN reply ELSE summary END AS summary, CASE WHEN length(reply) > 40 AND summary <> '' THEN 'hosted-1' ELSE 'template-v1' END AS model FROM asked""")
def _(f):
    """A hosted model's reply where one of over 40 characters came, else the template; the model's name beside it."""
    reply = F.when(F.col("doc_id") % 3 == 1, F.lit("short reply")).when(F.col("doc_id") % 3 == 2, F.concat(F.lit('{"summary": "A hosted summary of filing '), "doc_id", F.lit(' that is long enough to be used."}')))
    replies = f.texts.select("doc_id", reply.alias("reply"), F.lit("hosted-1").alias("model")).where("reply IS NOT NULL")
    return Y.summaries(f.texts.select("doc_id", "form_type", "company_name", "text"), "doc_id", replies)


# -- records --

NOW = "2024-06-01T00:00:00"
# fund documents of the filings in which several funds share a filing, the best of each, and the candidates of both merged
_OWN_DOCS = f"""own_docs AS (SELECT accession_no, seq, name, type, text, crypto_score, row_number() OVER (PARTITION BY accession_no ORDER BY crypto_score DESC, seq) - 1 AS doc_seq
  FROM (SELECT a.*, {count_sql('p', 'crypto')} AS crypto_score FROM (SELECT *, {plain_sql('substr(text, 1, 20000)')} AS p FROM attachments WHERE seq < 5 AND is_binary = 0 AND length(text) >= 500) a) WHERE accession_no IN (SELECT accession_no FROM work WHERE root_form IN {_MULTI}))"""
_OWN_MERGED = f"""texts_long AS (SELECT * FROM texts WHERE length(text) >= 200), {_OWN_DOCS}, best_docs AS (SELECT t.doc_id, t.form_type, t.root_form, t.company_name, d.text FROM texts_long t JOIN own_docs d USING (accession_no) WHERE d.doc_seq = 0 AND d.crypto_score >= 3),
main AS (WITH texts AS (SELECT * FROM texts_long){_ALL}, {_BEST} SELECT * FROM best), extra AS (WITH texts AS (SELECT * FROM best_docs){_ALL}, {_BEST} SELECT * FROM best),
merged AS (SELECT doc_id, src, strategy, section_type, method, title, confidence, text, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, src, place) AS place FROM (SELECT *, 0 AS src FROM main UNION ALL SELECT *, 1 AS src FROM extra) QUALIFY place <= 5),
{_SUMMARY.replace("told_of AS (SELECT * FROM texts)", "told_of AS (SELECT b.doc_id, t.form_type, t.company_name, b.text FROM merged b JOIN texts t USING (doc_id) WHERE b.place = 1)")},
linked AS ({CONNECTION_SQL}), pdfs AS (SELECT accession_no, coalesce(min_by(url, seq) FILTER (url LIKE '%.pdf'), '') AS pdf FROM attachments GROUP BY 1),
recorded AS (WITH filings AS (SELECT w.accession_no, w.doc_id, w.cik, w.company_name, w.ticker, w.form_type, w.root_form, w.filing_date, CASE WHEN w.root_form IN ({_FUNDS}) THEN 'ETF/Fund' ELSE 'Operating Co.' END AS filing_category, CASE WHEN w.root_form IN ({_FUNDS}) THEN 1 ELSE 2 END AS tier,
    'https://filings.example/data/' || ltrim(w.cik, '0') || '/' || replace(w.accession_no, '-', '') || '/' || w.accession_no || '-index.htm' AS sec_url, coalesce(p.pdf, '') AS filing_pdf_url, l.connection AS crypto_connection,
    CASE WHEN w.keyword <> '' THEN w.keyword ELSE {"CASE " + " ".join(f"WHEN contains(lower(substr(t.text, 1, 5000)), '{k.lower()}') THEN '{k}'" for k in fixed.KEYWORDS) + " ELSE '' END"} END AS search_keyword
    FROM work w JOIN texts_long t USING (accession_no) JOIN linked l ON l.doc_id = w.doc_id LEFT JOIN pdfs p ON p.accession_no = w.accession_no){M.META_SQL}
  SELECT accession_no, doc_id, cik, company_name, ticker, form_type, root_form, filing_date, filing_category, tier, sec_url, filing_pdf_url, crypto_connection, display_type AS entity_type, search_keyword, new_purpose AS purpose, new_holdings AS top_holdings FROM meta)"""


def _records(f):
    return records.compose(f.work.drop("doc_id"), f.texts.select("accession_no", "text"), f.attachments, f.companies, f.details, NOW)


@query("process_filings", f""", {_OWN_MERGED} SELECT r.* EXCLUDE (doc_id), '{NOW}' AS fetched_at, '{NOW}' AS processed_at, b.strategy, b.section_type, b.method, b.title, b.confidence, length(b.text) AS section_chars, t.summary, 'template-v1' AS model, (SELECT count(*) FROM merged x WHERE x.doc_id = b.doc_id) AS candidates
FROM recorded r JOIN merged b ON b.doc_id = r.doc_id AND b.place = 1 JOIN told t ON t.doc_id = r.doc_id""")
def _(f):
    """From texts to what is stored: filings with a candidate, all that is told of them, their primary section, its summary and the model."""
    made = _records(f)
    sections = made.sections.groupBy("accession_no").agg(F.count("*").alias("candidates"), F.min_by(F.struct("strategy", "section_type", "method", "title", "confidence", F.length("text").cast("long").alias("section_chars")), "place").alias("x"))
    sections = sections.select("accession_no", "candidates", "x.*").withColumn("confidence", F.round("confidence", 6))
    return made.filings.join(sections, "accession_no").join(made.summaries, "accession_no")


@query("stored_records", f""", {_OWN_MERGED} SELECT r.accession_no, r.company_name, r.entity_type, r.search_keyword, d.n AS documents, d.chars AS document_chars, d.first AS best_document, s.n AS sections, b.section_type, b.title, length(substr(b.text, 1, 200000)) AS section_chars, round(b.confidence, 6) AS confidence, t.summary AS risk_summary, CASE WHEN t.summary <> '' THEN true END AS linked
FROM recorded r JOIN merged b ON b.doc_id = r.doc_id AND b.place = 1 JOIN told t ON t.doc_id = r.doc_id JOIN (SELECT doc_id, count(*) AS n FROM merged GROUP BY 1) s ON s.doc_id = r.doc_id
LEFT JOIN (SELECT accession_no, count(*) AS n, CAST(sum(length(substr(text, 1, 500000))) AS BIGINT) AS chars, min_by(name, doc_seq) AS first FROM own_docs GROUP BY 1) d ON d.accession_no = r.accession_no""")
def _(f):
    """The records written to the four tables, twice, and read back: filings with their documents, sections, primary section and linked summary."""
    house = warehouse.Warehouse(f.spark, work_folder(f.spark, "warehouse"))
    house.init()
    made = _records(f)
    for _again in range(2):
        house.save(made.filings, made.documents, made.sections, made.summaries)
    sections, summaries = house.read("sections"), house.read("summaries").where("is_current = 1")
    documents = house.read("documents").groupBy("accession_no").agg(F.count("*").alias("documents"), F.sum("char_count").alias("document_chars"), F.min_by("doc_name", "doc_seq").alias("best_document"))
    counted = sections.groupBy("accession_no").agg(F.count("*").alias("sections"))
    primary = sections.where("is_primary = 1").select("accession_no", "id", "section_type", "title", F.col("char_count").cast("long").alias("section_chars"), F.round("confidence", 6).alias("confidence"))
    whole = house.read("filings").select("accession_no", "company_name", "entity_type", "search_keyword").join(counted, "accession_no").join(primary, "accession_no").join(documents, "accession_no", "left").join(summaries.select("accession_no", "summary", "section_id"), "accession_no", "left")
    return whole.select("accession_no", "company_name", "entity_type", "search_keyword", "documents", "document_chars", "best_document", "sections", "section_type", "title", "section_chars", "confidence", F.coalesce("summary", F.lit("")).alias("risk_summary"), F.when(F.col("summary").isNotNull(), F.col("section_id") == F.col("id")).alias("linked"))
