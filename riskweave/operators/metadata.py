"""Entity labels, purposes and holdings of filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import fixed, terms
from riskweave.functions.text import let


def is_fund(root_form: Column) -> Column:
    return root_form.isin(*fixed.FUND_FORMS)


def lookup(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def filled(template: Column, company: Column, form_desc: Column, tokens: Column) -> Column:
    out = F.replace(template, F.lit("{form_desc}"), form_desc)
    out = F.replace(out, F.lit("{tokens}"), tokens)
    return F.replace(out, F.lit("{company}"), company)


def connection(text: Column, root: Column) -> Column:
    """The first five topic words of a text, in order of appearance, in the sentence of the form."""
    found = F.array_distinct(F.transform(terms.topics(F.substring(text, 1, 5000)), lambda t: F.lower(t)))

    def sentence(said: Column) -> Column:
        return (
            F.when(F.coalesce(said, F.lit("")) == "", "Crypto-related filing.")
            .when(is_fund(root), F.concat(F.lit("Proposes "), said, F.lit(" ETF, fund, or security offering.")))
            .when(root.isin("10-K", "10-Q"), F.concat(F.lit("Reports "), said, F.lit(" operations with risk disclosures.")))
            .when(root == "8-K", F.concat(F.lit("Discloses "), said, F.lit(" material event or corporate action.")))
            .otherwise(F.concat(F.lit("Filing related to "), said, F.lit(".")))
        )

    return let(F.array_join(F.slice(found, 1, 5), " or "), sentence)


def filing_url(cik: Column, accession_no: Column) -> Column:
    return F.concat(F.lit("https://filings.example/data/"), F.ltrim(cik, F.lit("0")), F.lit("/"), F.replace(accession_no, F.lit("-"), F.lit("")), F.lit("/"), accession_no, F.lit("-index.htm"))


def generate(filings: DataFrame, companies: DataFrame, details: DataFrame) -> DataFrame:
    """``filings`` with category, tokens, display_type, new_purpose and new_holdings.

    ``companies`` (cik, category) and ``details`` (cik, holdings) are dimensions the
    caller supplies; Spark broadcasts them where they are small.
    """
    known = companies.select("cik", "category")
    held = details.select("cik", F.col("holdings").alias("held"))
    df = filings.join(known, "cik", "left").join(held, "cik", "left")
    fund = F.col("filing_category") == "ETF/Fund"
    tokens = F.coalesce("held", F.when(F.col("category") == "miner", "BTC").when(fund, "digital assets").otherwise("cryptocurrency"))
    bare = F.replace("form_type", F.lit("/A"), F.lit(""))
    form_desc = F.coalesce(lookup(F.col("form_type"), fixed.FORM_DESCRIPTIONS), lookup(bare, fixed.FORM_DESCRIPTIONS), F.concat("form_type", F.lit(" filing")))
    entity = F.when(F.col("category").isNotNull(), F.coalesce(lookup(F.col("category"), fixed.ENTITY_TYPES), F.lit("Company"))).when(fund, "ETF/Fund").otherwise("Company")
    df = df.withColumns({"tokens": tokens, "form_desc": form_desc, "display_type": F.concat_ws(" — ", entity, form_desc)})
    templates = {f"{c}|{r}": t for (c, r), t in fixed.PURPOSES.items()}
    kind = F.coalesce("category", F.lit("other"))
    template = F.coalesce(lookup(F.concat_ws("|", kind, bare), templates), lookup(F.concat_ws("|", kind, F.lit("10-K")), templates), F.lit(fixed.PURPOSE_DEFAULT))
    unknown = F.when(fund, F.concat(F.lit("Fund with exposure to "), "tokens")).otherwise(F.concat(F.lit("Exposure to "), F.when(F.col("crypto_connection") != "", F.col("crypto_connection")).otherwise(F.col("tokens"))))
    holdings = F.when(F.col("category").isNotNull(), F.replace(F.coalesce(lookup(F.col("category"), fixed.HOLDINGS), F.lit("Exposure to {tokens}")), F.lit("{tokens}"), F.col("tokens"))).otherwise(unknown)
    return df.withColumns({"new_purpose": filled(template, F.col("company_name"), F.col("form_desc"), F.col("tokens")), "new_holdings": holdings})


def _values(name: str, columns: str, rows: list[tuple[str, ...]]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


#: The same for DuckDB, as common table expressions that end in ``meta``.
META_SQL = ", " + ",\n".join(
    [
        _values("form_names", "f, d", list(fixed.FORM_DESCRIPTIONS.items())),
        _values("entity_names", "c, d", list(fixed.ENTITY_TYPES.items())),
        _values("held_names", "c, d", list(fixed.HOLDINGS.items())),
        _values("purposes", "c, r, t", [(c, r, t) for (c, r), t in fixed.PURPOSES.items()]),
        f"""meta AS (
  SELECT *, CASE WHEN category IS NOT NULL THEN replace(held_template, '{{tokens}}', tokens) WHEN filing_category = 'ETF/Fund' THEN 'Fund with exposure to ' || tokens
      WHEN crypto_connection <> '' THEN 'Exposure to ' || crypto_connection ELSE 'Exposure to ' || tokens END AS new_holdings,
    replace(replace(replace(template, '{{form_desc}}', form_desc), '{{tokens}}', tokens), '{{company}}', company_name) AS new_purpose
  FROM (SELECT f.*, c.category, coalesce(d.holdings, CASE WHEN c.category = 'miner' THEN 'BTC' WHEN filing_category = 'ETF/Fund' THEN 'digital assets' ELSE 'cryptocurrency' END) AS tokens,
      coalesce(n1.d, n2.d, form_type || ' filing') AS form_desc, h.d AS held_template,
      coalesce(e.d, CASE WHEN filing_category = 'ETF/Fund' THEN 'ETF/Fund' ELSE 'Company' END) || ' — ' || coalesce(n1.d, n2.d, form_type || ' filing') AS display_type,
      coalesce(p1.t, p2.t, '{fixed.PURPOSE_DEFAULT}') AS template
    FROM filings f LEFT JOIN companies c USING (cik) LEFT JOIN details d USING (cik) LEFT JOIN form_names n1 ON n1.f = form_type LEFT JOIN form_names n2 ON n2.f = replace(form_type, '/A', '')
      LEFT JOIN entity_names e ON e.c = c.category LEFT JOIN held_names h ON h.c = c.category
      LEFT JOIN purposes p1 ON p1.c = coalesce(c.category, 'other') AND p1.r = replace(form_type, '/A', '') LEFT JOIN purposes p2 ON p2.c = coalesce(c.category, 'other') AND p2.r = '10-K'))""",
    ]
)
