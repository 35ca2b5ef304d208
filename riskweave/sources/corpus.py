"""Frames of the filing domain derived from the driver's generic tables.

Each frame is one SQL text that Spark and DuckDB both run, so a query and its twin start
from the same rows. ``{orders}`` and the like stand for the driver's tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from riskweave.functions import fixed

TABLES = ("customer", "orders", "lineitem", "events", "documents", "pages")
#: Rows that a task of the joins and sorts over the order tables has, about, where the session's partitions would give it more.
ROWS = 500_000
#: The tables that frames deal out by a key, which the frame's own grouping or join then keeps.
DEALT = {"section_rows": ("lineitem", "l_orderkey"), "filings_raw": ("orders", "o_custkey")}

# -- prose blocks that make every branch of the text operators fire (our own wording) --
RISK = (
    "Bitcoin and other digital assets are volatile and holders may suffer a loss of 40% within one day of trading. "
    "A hack or theft at an exchange such as Coinbase could result in a material adverse effect on the blockchain venture. "
    "Regulatory action by the SEC against a stablecoin issuer may restrict how ethereum tokens trade on Nasdaq in 2024. "
    "The private key of a wallet can be stolen through fraud, and custody of cryptocurrency carries liability for the trust. "
    "Illiquid markets with low trading volume allow manipulation, so the crypto price may decline and litigation may follow. "
    "A hard fork of the protocol is a risk to the distributed ledger, and a failure of proof of work mining would harm holders. "
    "Tax treatment of virtual currency is uncertain and a penalty could be imposed by the IRS on gains of $5 million or more. "
    "Insurance does not cover a default of the counterparty, and compliance with sanctions rules may not prevent an investigation. "
)
FEE = "The fee schedule lists an annual fee and a monthly fee. A custody fee and a service fee apply to bitcoin and crypto. The base fee, the transaction fee and the billing cycle follow the rate schedule. One risk remains: risk of change. "
BOILER = "This exhibit 5 is filed herewith pursuant to the indenture, and the table of contents names each bookrunner of the offering by incorporation by reference. "
TOC = "\nItem 1A. Outlook 12\nItem 1B. Staff 30\nItem 2. Sites 31\nItem 3. Claims 32\n"
BLOCKS = {
    "body": "\nItem 1A. Risk Factors\n" + RISK + RISK[:400] + "\nItem 1B. Staff Comments\nNone.\nItem 2. Sites\nOne office.\nItem 3. Claims\nNone.\n",
    "short": "\nItem 1A. Risk Factors\n" + RISK[:650] + "\nItem 2. Sites\nOne office.\n",
    "prospectus": "\nPrincipal Investment Risks\n" + RISK + "\nPortfolio Turnover\nThe trust trades rarely.\n",
    "reference": "\nPlease see the Principal Risks in the annex. " + RISK[:300] + "\n",
    "paragraphs": "\n\n" + RISK[:230] + "\n\n" + FEE + "\n\n" + BOILER + "\n\n" + RISK[230:560] + "\n\nA quiet paragraph about bread and cheese that has nothing to say on the topic at all.\n\n" + RISK[560:900] + "\n",
    "fees": FEE + FEE,
    "boiler": BOILER + RISK[:240],
    "thin": "Bitcoin and ethereum are named here once, and the rest of this long passage talks about weather, gardens, rivers and hills. " * 3 + "There is a risk. ",
    "toc": TOC,
    "report": "\nPart I\nItem 1. Business 3\nItem 2. Discussion 9\nPart II\nItem 1A. Risk Factors 12\nPart I\nItem 1. Business\nThe company keeps offices, gardens and a small museum of clocks.\nItem 2. Discussion\n" + RISK[:700] + "\nItem 7. Discussion and Analysis\n" + RISK[300:] + "\nPart II\nItem 1. Proceedings\n" + RISK + "\nItem 1A. Risk Factors\n" + RISK[200:] + "\nItem 8.01 Other Events\n" + RISK[:600] + "\n",
}


def literal(text: str) -> str:
    """A SQL string literal both engines read alike."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


def _pick(expr: str, values: list[str], other: str = "''") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE {other} END"


# the forms of the made filings (a choice of ours)
FORMS = ["S-1", "S-1/A", "N-1A", "485APOS", "485BPOS", "10-K", "10-Q", "8-K", "D", "10-K/A", "8-K/A"]
CATEGORIES = ["etf_issuer", "exchange", "broker", "miner", "treasury", "payments", "other"]
_FUND = "(" + ", ".join(f"'{f}'" for f in fixed.FUND_FORMS) + ")"
_ACC = "lpad(cast({c} as varchar(20)), 10, '0') || '-' || substr(cast({d} as varchar(30)), 3, 2) || '-' || lpad(cast({k} as varchar(20)), 9, '0')"

FRAMES = {
    "filings_raw": f"""
      SELECT {_ACC.format(c="o_custkey", d="o_orderdate", k="o_orderkey")} AS accession_no, o_orderkey AS okey,
        cast(o_custkey % 60 as varchar(20)) AS cik, c_name AS company_name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'T' || cast(o_custkey % 60 as varchar(20)) END AS ticker,
        {_pick("o_orderkey % 11", FORMS)} AS form_type,
        CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE substr(cast(o_orderdate as varchar(30)), 1, 10) END AS filing_date,
        {_pick("o_orderkey % 13", list(fixed.KEYWORDS))} AS search_keyword
      FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "filings": f"""
      SELECT accession_no, cik, company_name, ticker, form_type, replace(form_type, '/A', '') AS root_form, filing_date,
        CASE WHEN replace(form_type, '/A', '') IN {_FUND} THEN 'ETF/Fund' ELSE 'Operating Co.' END AS filing_category,
        CASE WHEN replace(form_type, '/A', '') IN {_FUND} THEN 1 ELSE 2 END AS tier,
        'https://filings.example/' || accession_no AS sec_url, '' AS filing_pdf_url,
        CASE WHEN okey % 5 = 0 THEN '' ELSE 'digital tokens' END AS crypto_connection, CASE WHEN okey % 3 = 0 THEN '' ELSE 'Company' END AS entity_type,
        search_keyword, '' AS purpose, '' AS top_holdings, '2024-01-01T00:00:00' AS fetched_at, '2024-01-02T00:00:00' AS processed_at, okey
      FROM {{filings_raw}}""",
    "section_rows": """
      SELECT l_orderkey, l_linenumber, min(l_discount) AS discount, min(l_quantity) AS quantity, min(l_partkey) AS partkey, min(l_returnflag) AS flag
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "sections": f"""
      SELECT cast(s.l_orderkey * 10 + s.l_linenumber as bigint) AS id, f.accession_no, {_pick("s.l_linenumber % 3", ["risk_factors", "business", "properties"])} AS section_type,
        {_pick("s.partkey % 4", ["typed_item", "boundary_pair_1A_1B", "prospectus_header", "paragraph_density"])} AS method, 'Section ' || cast(s.l_linenumber as varchar(20)) AS title,
        'Section text ' || cast(s.partkey as varchar(20)) AS text, cast(s.quantity * 100 as int) AS char_count, s.discount * 10 AS confidence,
        CASE WHEN row_number() OVER (PARTITION BY s.l_orderkey ORDER BY s.discount DESC, s.l_linenumber) = 1 AND s.l_orderkey % 17 <> 0 THEN 1 ELSE 0 END AS is_primary, '2024-01-01T00:00:00' AS extracted_at
      FROM {{section_rows}} s JOIN {{filings}} f ON f.okey = s.l_orderkey""",
    "summaries": """
      SELECT cast(s.l_orderkey * 10 + s.l_linenumber as bigint) AS id, f.accession_no, CASE WHEN s.l_linenumber % 2 = 0 THEN NULL ELSE cast(s.l_orderkey * 10 + s.l_linenumber as bigint) END AS section_id,
        'template-v1' AS model, CASE s.partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Bitcoin custody risk and price volatility.' WHEN 2 THEN 'Exchange failure, 100% loss_possible.' ELSE 'Regulatory uncertainty for digital assets.' END AS summary,
        CASE WHEN row_number() OVER (PARTITION BY s.l_orderkey ORDER BY s.l_linenumber DESC) = 1 THEN 1 ELSE 0 END AS is_current, '2024-01-03T00:00:00' AS created_at
      FROM {section_rows} s JOIN {filings} f ON f.okey = s.l_orderkey WHERE s.flag = 'R'""",
    "companies": f"""
      SELECT cast(c_custkey as varchar(20)) AS cik, c_name AS name, 'T' || cast(c_custkey as varchar(20)) AS ticker, {_pick("c_custkey % 7", CATEGORIES)} AS category
      FROM {{customer}} WHERE c_custkey < 54""",
    "details": """
      SELECT cast(c_custkey as varchar(20)) AS cik, 'Purpose of ' || c_name AS purpose, CASE c_custkey % 3 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH, SOL' ELSE 'BTC, XRP' END AS holdings
      FROM {customer} WHERE c_custkey < 54 AND c_custkey % 2 = 0""",
    "texts": f"""
      SELECT lpad(cast(doc_id as varchar(20)), 10, '0') || '-24-000001' AS accession_no, doc_id, {_pick("n % 11", FORMS)} AS form_type,
        replace({_pick("n % 11", FORMS)}, '/A', '') AS root_form, 'Issuer ' || source AS company_name, source,
        CASE WHEN doc_id < 0 THEN '' ELSE coalesce(text, '')
          || CASE WHEN n % 4 = 1 THEN {literal(BLOCKS["toc"])} ELSE '' END
          || CASE n % 13 WHEN 0 THEN {literal(BLOCKS["body"])} WHEN 1 THEN {literal(BLOCKS["short"])} WHEN 2 THEN {literal(BLOCKS["prospectus"])} WHEN 3 THEN {literal(BLOCKS["reference"])}
             WHEN 4 THEN {literal(BLOCKS["paragraphs"])} WHEN 5 THEN {literal(BLOCKS["body"] + BLOCKS["prospectus"])} WHEN 6 THEN {literal(BLOCKS["body"] + BLOCKS["body"])} WHEN 7 THEN {literal(RISK)}
             WHEN 8 THEN {literal(BLOCKS["report"])} ELSE '' END END AS text
      FROM (SELECT doc_id, doc_id AS n, source, text FROM {{documents}} UNION ALL SELECT -1 - doc_id AS doc_id, doc_id AS n, 'edge' AS source, '' AS text FROM {{documents}} WHERE doc_id % 41 = 0) d""",
    "passages": f"""
      SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN {literal(RISK)} WHEN 1 THEN {literal(BLOCKS["fees"])} WHEN 2 THEN {literal(BLOCKS["boiler"])} WHEN 3 THEN {literal(BLOCKS["thin"])} WHEN 4 THEN {literal(RISK + RISK + BOILER)} ELSE '' END
        || coalesce(text, '') AS text
      FROM {{documents}} UNION ALL SELECT -1 - doc_id AS doc_id, 'Too short.' AS text FROM {{documents}} WHERE doc_id % 7 = 5""",
    "fund_docs": f"""
      SELECT 'F' || cast((doc_id - doc_id % 8) as varchar(20)) AS accession_no, cast(doc_id % 8 as int) AS seq, source || '-' || cast(doc_id as varchar(20)) AS name,
        CASE WHEN doc_id % 9 = 0 THEN 'GRAPHIC' ELSE 'EX-99' END AS type, 'https://filings.example/' || cast(doc_id as varchar(20)) || CASE WHEN doc_id % 3 = 0 THEN '.pdf' ELSE '.htm' END AS url,
        CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS is_binary,
        coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN {literal(chr(10) + "The Northern Light Bitcoin Fund seeks growth. " + RISK[:500])} WHEN 1 THEN {literal(RISK)} ELSE '' END AS text
      FROM {{documents}}""",
    "work": """
      SELECT accession_no, doc_id, cast(abs(doc_id) % 60 as varchar(20)) AS cik, company_name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'T' || cast(abs(doc_id) % 60 as varchar(20)) END AS ticker, form_type, root_form,
        '2024-0' || cast(1 + abs(doc_id) % 9 as varchar(20)) || '-15' AS filing_date, CASE WHEN doc_id % 3 = 0 THEN 'stablecoin' ELSE '' END AS keyword
      FROM {texts}""",
    "attachments": """
      SELECT lpad(substr(accession_no, 2), 10, '0') || '-24-000001' AS accession_no, seq, name, type, url, is_binary, text FROM {fund_docs}""",
    "html_pages": """
      SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<table><tr><td>Table of Contents</td></tr><tr><td>Item 1</td><td>3</td></tr><tr><td>Item 2</td><td>14</td></tr><tr><td>Item 3</td><td>25</td></tr></table>' ELSE '' END
        || coalesce(html, '') AS html, CASE WHEN page_id % 3 = 0 THEN 'Item 1 . 3 Item 2 . 14 Item 3 . 25' WHEN page_id % 3 = 1 THEN 'Table of Contents' ELSE 'Revenue 3 and 14' END AS table_text
      FROM {pages}""",
    "hits": """
      SELECT okey, '{"_id":"' || accession_no || ':doc.htm","_source":{"adsh":"' || CASE WHEN okey % 5 = 0 THEN '' ELSE accession_no END || '","display_names":["' || replace(company_name, '#', ' ') || CASE WHEN okey % 3 = 0 THEN ' (DE) ' WHEN okey % 3 = 1 THEN ' (ABC) ' ELSE ' ' END || '(CIK 000' || cik
        || ')"],"form":"' || form_type || '","ciks":["000' || cik || '"],"file_date":"' || filing_date || '"}}' AS hit, form_type, accession_no, 0 AS source_rank FROM {filings} WHERE okey % 2 = 0
      UNION ALL
      SELECT okey + 1000000000, '{"_id":"' || accession_no || ':x.htm","_source":{"adsh":"' || accession_no || '","display_names":["Again (CIK 000' || cik || ')"],"form":"' || form_type || '","ciks":["000' || cik || '"],"file_date":"' || filing_date || '"}}' AS hit, form_type, accession_no, 1 AS source_rank FROM {filings} WHERE okey % 3 = 0""",
}


def oracle_prelude() -> str:
    """All frames as common table expressions for DuckDB."""
    names = {t: t for t in TABLES} | {f: f for f in FRAMES}
    parts = []
    for name, sql in FRAMES.items():
        for key, value in names.items():
            sql = sql.replace("{" + key + "}", value)
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ",\n".join(parts)


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` dealt out by ``key`` to so many tasks that one has about ``ROWS`` of ``rows``; as it is where the session's partitions do."""
    tasks = -(-rows // ROWS)
    return df.repartition(tasks, key) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Frames:
    """The frames of one folder of tables, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._counts: dict[str, int] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*TABLES, *FRAMES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                sql = FRAMES[name]
                used = {t: getattr(self, t) for t in (*TABLES, *FRAMES) if "{" + t + "}" in sql}
                if name in DEALT:
                    table, key = DEALT[name]
                    used[table] = spread(used[table], key, self._rows(table))
                for t in used:
                    sql = sql.replace("{" + t + "}", f"<<{t}>>")
                sql = sql.replace("{", "{{").replace("}", "}}")
                for t in used:
                    sql = sql.replace(f"<<{t}>>", "{" + t + "}")
                self._made[name] = self.spark.sql(sql, **used)
        return self._made[name]

    def _rows(self, table: str) -> int:
        """The rows of a table, counted once; a count of a whole Parquet table reads no column."""
        if table not in self._counts:
            self._counts[table] = getattr(self, table).count()
        return self._counts[table]

    @cached_property
    def view(self) -> DataFrame:
        from riskweave.plans.views import display

        return display(spread(self.filings, "accession_no", self._rows("lineitem")), self.sections, self.summaries)
