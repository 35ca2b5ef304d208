"""Values that stored results and users rely on; kept exactly as they are."""

from __future__ import annotations

# fixed values: labels, descriptions and templates of filing metadata
ENTITY_TYPES = {
    "etf_issuer": "ETF",
    "exchange": "Crypto Exchange",
    "broker": "Crypto Broker/Financial Services",
    "miner": "Bitcoin Miner",
    "treasury": "Corporate Treasury (Crypto Holdings)",
    "payments": "Payments/Fintech",
    "other": "Company",
}

HOLDINGS = {
    "etf_issuer": "Holds spot {tokens} in trust for shareholders",
    "exchange": "Operates marketplace for {tokens} and other digital assets",
    "broker": "Provides trading access to {tokens} and other digital assets",
    "miner": "Mines and holds {tokens} as primary business output",
    "treasury": "Holds {tokens} as corporate treasury reserve asset",
    "payments": "Enables buying, selling, and holding {tokens} for users",
    "other": "Exposure to {tokens} via operations or investments",
}

FORM_DESCRIPTIONS = {
    "10-K": "Annual report",
    "10-K/A": "Amended annual report",
    "10-Q": "Quarterly report",
    "10-Q/A": "Amended quarterly report",
    "8-K": "Current report (material event disclosure)",
    "8-K/A": "Amended current report",
    "S-1": "Registration statement for new securities",
    "S-1/A": "Amended registration statement",
    "S-3": "Shelf registration statement",
    "S-3/A": "Amended shelf registration statement",
    "N-1A": "Mutual fund/ETF registration statement",
    "N-1A/A": "Amended mutual fund/ETF registration",
    "485APOS": "Post-effective prospectus amendment",
    "485BPOS": "Post-effective prospectus amendment (Rule 485(b))",
    "D": "Notice of exempt offering (Regulation D)",
    "D/A": "Amended notice of exempt offering",
    "DEF 14A": "Definitive proxy statement",
    "4": "Insider transaction report (Section 16)",
    "SC 13D": "Beneficial ownership report (activist)",
    "SC 13G": "Beneficial ownership report (passive)",
    "20-F": "Annual report (foreign private issuer)",
    "6-K": "Current report (foreign private issuer)",
}

PURPOSES = {
    ("etf_issuer", "S-1"): "{form_desc} for {company}, a spot {tokens} ETF. Registers the fund's shares for public sale.",
    ("etf_issuer", "N-1A"): "{form_desc} for {company}, a spot {tokens} ETF. Defines fund objectives, fees, and risk factors.",
    ("etf_issuer", "485APOS"): "{form_desc} for {company}, a spot {tokens} ETF. Updates prospectus disclosures including risk factors and fund performance.",
    ("etf_issuer", "485BPOS"): "{form_desc} for {company}, a spot {tokens} ETF. Updates prospectus disclosures including risk factors and fund performance.",
    ("etf_issuer", "10-K"): "{form_desc} for {company}, a spot {tokens} ETF. Annual financial statements and risk disclosures for the fund.",
    ("etf_issuer", "10-Q"): "{form_desc} for {company}, a spot {tokens} ETF. Quarterly financial performance and NAV updates.",
    ("etf_issuer", "8-K"): "{form_desc} for {company}, a spot {tokens} ETF. Discloses material event such as NAV change, fee adjustment, or regulatory update.",
    ("etf_issuer", "D"): "Notice of exempt offering for {company}, a spot {tokens} fund. Filed under Regulation D.",
    ("exchange", "10-K"): "{form_desc} for {company}, a cryptocurrency exchange. Contains annual financials, trading volume data, and crypto-related risk factors.",
    ("exchange", "10-Q"): "{form_desc} for {company}, a cryptocurrency exchange. Quarterly revenue, user growth, and regulatory risk updates.",
    ("exchange", "8-K"): "{form_desc} for {company}, a cryptocurrency exchange. Discloses material event such as regulatory action, product launch, or executive change.",
    ("exchange", "S-1"): "{form_desc} for {company}, a cryptocurrency exchange. Registers securities for public offering.",
    ("exchange", "DEF 14A"): "Proxy statement for {company}, a cryptocurrency exchange. Annual meeting voting matters.",
    ("broker", "10-K"): "{form_desc} for {company}, a crypto-integrated financial services firm. Annual financials and risk disclosures related to digital asset services.",
    ("broker", "10-Q"): "{form_desc} for {company}, a crypto-integrated financial services firm. Quarterly performance and crypto segment updates.",
    ("broker", "8-K"): "{form_desc} for {company}, a crypto-integrated financial services firm. Material event disclosure.",
    ("broker", "S-1"): "{form_desc} for {company}, a crypto-integrated financial services firm. Registers securities for public offering.",
    ("miner", "10-K"): "{form_desc} for {company}, a {tokens} mining company. Annual financials including hash rate, BTC production, energy costs, and crypto risk factors.",
    ("miner", "10-Q"): "{form_desc} for {company}, a {tokens} mining company. Quarterly mining output, revenue, and operational metrics.",
    ("miner", "8-K"): "{form_desc} for {company}, a {tokens} mining company. Discloses material event such as equipment purchase, facility expansion, or hash rate change.",
    ("miner", "S-1"): "{form_desc} for {company}, a {tokens} mining company. Registers securities for public offering or capital raise.",
    ("miner", "S-3"): "Shelf registration for {company}, a {tokens} mining company. Enables future capital raises.",
    ("treasury", "10-K"): "{form_desc} for {company}, which holds {tokens} as a corporate treasury reserve. Annual financials including digital asset impairment and fair value disclosures.",
    ("treasury", "10-Q"): "{form_desc} for {company}, which holds {tokens} as a corporate treasury reserve. Quarterly crypto treasury valuation and impairment updates.",
    ("treasury", "8-K"): "{form_desc} for {company}, which holds {tokens} as a corporate treasury reserve. Material event such as additional crypto purchase, sale, or strategy change.",
    ("treasury", "S-1"): "{form_desc} for {company}, which holds {tokens} as a corporate treasury reserve. Registers securities (often to fund further crypto acquisitions).",
    ("treasury", "S-3"): "Shelf registration for {company}. Enables future capital raises, often used to fund {tokens} treasury purchases.",
    ("payments", "10-K"): "{form_desc} for {company}, a payments company with crypto services. Annual financials and risk disclosures related to digital asset operations.",
    ("payments", "10-Q"): "{form_desc} for {company}, a payments company with crypto services. Quarterly crypto revenue and regulatory updates.",
    ("payments", "8-K"): "{form_desc} for {company}, a payments company with crypto services. Material event disclosure.",
    ("payments", "S-1"): "{form_desc} for {company}, a payments company with crypto services. Registers securities for offering.",
    ("other", "10-K"): "{form_desc} for {company}. Annual report with risk disclosures related to {tokens} or digital assets.",
    ("other", "10-Q"): "{form_desc} for {company}. Quarterly report with crypto-related risk disclosures.",
    ("other", "8-K"): "{form_desc} for {company}. Material event related to {tokens} or digital assets.",
    ("other", "S-1"): "{form_desc} for {company}. Registration statement for securities offering.",
}
PURPOSE_DEFAULT = "{form_desc} for {company}. Contains disclosures related to {tokens}."

# fixed values: words searched for in the filings index, in the order in which matches are tried
KEYWORDS = ("cryptocurrency", "blockchain", "digital asset", "bitcoin", "ethereum", "XRP", "stablecoin", "crypto ETF", "crypto fund", "crypto token", "DeFi")

# fixed values: forms of funds
FUND_FORMS = ("485APOS", "485BPOS", "N-1A", "S-1", "D")
# fixed values: forms in which several funds share a filing
MULTI_FUND_FORMS = ("485APOS", "485BPOS", "N-1A", "N-1A/A")
# fixed values: forms listed for each company
COMPANY_FORM_TYPES = ("10-K", "10-Q", "8-K", "S-1", "S-1/A")
# fixed values: codes in parentheses that aren't tickers
NOT_TICKERS = ("CIK", "DE", "NV", "CA", "NY", "FL", "TX")
# fixed values: patterns of a fund's name, in the order in which they are tried
FUND_NAMES = (
    r"\b([A-Z][A-Za-z&.\s]{4,60}(?:Trust|Fund|ETF))\b",
    r"\b([A-Z][A-Za-z&.\s]{4,60}Bitcoin[A-Za-z\s]{0,20}(?:Trust|Fund|ETF))\b",
    r"\b([A-Z][A-Za-z&.\s]{4,60}(?:Crypto|Digital|Ethereum)[A-Za-z\s]{0,20}(?:Trust|Fund|ETF))\b",
)
# fixed values: what a table of contents holds: listed items, page numbers, its title
TOC_ITEM, TOC_PAGE, TOC_TITLE = r"\bItem\s+\d+[A-Z]?\b", r"\b\d{1,3}\b", r"table\s+of\s+contents"
# fixed values: lengths of a short summary and of a chart's label
SHORT_SUMMARY, LABEL, LABEL_CUT = 140, 30, 28
# fixed values: what is said at the end of a run
RUN_REPROCESSED = "Done: reprocessed %d filings, %d total with summaries (%.1fmin)"
RUN_UP_TO_DATE = "Up to date: all %d filings already processed (%.1fmin)"
RUN_NOTHING = "No filings found. Check your internet connection and try again."
RUN_DONE = "Done: %d new, %d failed, %d total (%.1fmin)"

# fixed values: terms of the topic, in the order in which they are tried
CRYPTO = (
    "cryptocurrency", "cryptocurrencies", "blockchain", "digital asset", "digital assets", "bitcoin", "btc", "ethereum", "eth", "XRP", "stablecoin", "stablecoins", "crypto", "DeFi", "NFT",
    "mining pool", "proof.of.work", "proof.of.stake", "decentralized finance", "virtual currency", "virtual currencies", "digital currency", "crypto.?asset", "crypto.?assets", "digital token", "tokenized",
    "distributed ledger", "smart contract", "altcoin", "satoshi", "binance", "coinbase", "kraken", "gemini", "bitfinex", "solana", "cardano", "polkadot",
)
# fixed values: terms of risk
RISK = (
    "risk", "loss", "adverse", "volatile", "volatility", "uncertain", "decline", "fail", "failure", "liability", "penalty", "harm", "impair", "no assurance", "could result", "may not",
    "subject to", "negatively", "negative impact", "material adverse", "you could lose", "speculative", "cybersecurity", "hack", "theft", "fraud", "manipulation", "regulatory",
    "compliance", "forfeiture", "prohibit", "restrict", "enforce", "sanctions", "illiquid", "default", "lawsuit", "litigation", "investigation",
)
# fixed values: terms of fee schedules
FEES = ("fee schedule", "fee table", "base fee", "transaction fee", "annual fee", "monthly fee", "service fee", "custody fee", "pricing schedule", "compensation schedule", "rate schedule", "billing")
# fixed values: boilerplate, found inside words too
BOILERPLATE = (
    "table of contents", "date of this prospectus", "criminal offense", "approved or disapproved", "bookrunner", "delivery of the securities", "incorporation by reference", r"exhibits? \d", r"EX-\d", "pursuant to",
    "filed herewith", "XBRL", "iXBRL", "EDGAR Online", r"LIVE \d{10}",
)
# fixed values: sentences too general for a summary
GENERIC = (
    "you could lose", "no assurance", "past performance", "an investment in the", "please read", "as with all investments", "you should consider", "before investing", "there is no guarantee",
    "may not be suitable", "carefully consider", "the following", "this summary is not complete", "see the prospectus", "table of contents", r"page \d+", "for more information",
)
# fixed values: names and figures that make a sentence specific
SPECIFIC = (
    "SEC", "CFTC", "IRS", "FINRA", "FinCEN", "OCC", "DOJ", "bitcoin", "ethereum", "XRP", "Coinbase", "CBOE", "NYSE", "Nasdaq", "CME",
    "Bitfinex", "Binance", "Kraken", "Gemini", "Grayscale", "BlackRock", "Fidelity", r"\d+%", r"\$[\d,.]+(?:\s*(?:billion|million))?", "billion", "million",
)
# fixed values: words that hedge
HEDGES = ("may", "could", "might", "would", "should", "possible", "potential", "certain")

# fixed values: headers of risk sections in prospectuses
HEADERS = (
    "Principal Investment Risks", "Principal Risks", "Principal Risks of Investing in the Fund", "Principal Risks of Investing in the Trust", "Summary of Principal Risks", "Risk Factors",
    "Risks of Investing in the Fund", "Risks Related to", "Additional Information About the Fund's Principal Investment Strategies and Risks", "More Information About the Fund's Principal Investment Strategies and Risks",
)
# fixed values: lines that end such sections
END_LINES = (
    r"Portfolio\s+Turnover", r"Portfolio\s+Holdings", r"Fund\s+(?:Performance|Management|Summary)", r"Management\s+of\s+the\s+(?:Fund|Trust)", r"Purchase\s+and\s+(?:Sale|Redemption)\s+of\s+(?:Fund|Trust)\s+Shares",
    r"Tax\s+Information", r"Tax\s+Consequences", r"Payments?\s+to\s+(?:Broker|Financial\s+Intermediaries)", r"Financial\s+Highlights", r"How\s+to\s+(?:Purchase|Buy|Sell|Redeem)", r"Creation\s+and\s+Redemption",
    r"Creation\s+Units", r"Dividends\s+(?:and|&)\s+Distributions", r"Determination\s+of\s+Net\s+Asset\s+Value", r"Investment\s+(?:Policies|Restrictions|Limitations)", r"Description\s+of\s+the\s+(?:Index|Benchmark)", "Signatures", r"Exhibit\s+Index",
)

# fixed values: assets and how a text names them (lower case)
ASSETS = (
    (r"\bbitcoin\b", "Bitcoin"), (r"\bethereum\b|\beth\b", "Ethereum"), (r"\bxrp\b", "XRP"), (r"\bsolana\b", "Solana"), (r"\bstablecoin", "stablecoins"), (r"\bdefi\b|decentralized finance", "DeFi"),
    (r"\bnft\b|non.fungible", "NFTs"), (r"\bcrypto(?:currency|currencies)\b", "cryptocurrency"), (r"\bdigital asset", "digital assets"), (r"\bblockchain\b", "blockchain"),
)
# fixed values: tickers of assets
TICKERS = {"Bitcoin": "BTC", "Ethereum": "ETH", "XRP": "XRP", "Solana": "SOL", "stablecoins": "USDT/USDC", "DeFi": "DeFi", "NFTs": "NFT", "cryptocurrency": "BTC", "digital assets": "BTC", "blockchain": "BTC"}
# fixed values: how a summary names a form
FORM_PHRASES = {
    "S-1": "security registration statement", "S-1/A": "amended security registration statement", "N-1A": "investment company registration", "N-1A/A": "amended investment company registration",
    "485APOS": "post-effective amendment to fund registration", "485BPOS": "post-effective amendment to fund registration", "10-K": "annual report", "10-Q": "quarterly report",
    "8-K": "current report (material event disclosure)", "8-K/A": "amended current report", "D": "exempt offering notice", "D/A": "amended exempt offering notice",
}
# fixed values: categories of risk and how a text (lower case) names them; upper-case alternatives never match there
RISK_CATEGORIES = (
    ("price volatility", r"(price volatility|volatile|price.{0,15}fluctuat|extreme.{0,10}fluctuat|speculative)"),
    ("regulatory uncertainty", r"(regulatory.{0,15}(?:uncertain|risk|change|evolv)|SEC.{0,15}(?:regulat|enforce)|CFTC|securities law|regulatory framework)"),
    ("custody/storage", r"(custody|custod|safekeeping|private key|wallet|cold storage|hot wallet)"),
    ("cybersecurity", r"(hack|cyber.?security|cyber.?attack|security breach|unauthorized access|phishing)"),
    ("tax treatment", r"(tax.{0,15}(?:treatment|uncertain|consequence|implication)|IRS|capital gain|tax reporting)"),
    ("liquidity", r"(liquidity.{0,10}risk|illiquid|trading volume.{0,10}(?:low|limit)|market depth)"),
    ("market manipulation", r"(manipulation|manipulat|wash trading|spoofing|front.running)"),
    ("blockchain fork / protocol", r"(fork|hard fork|protocol.{0,10}(?:change|upgrade|risk)|consensus mechanism)"),
    ("concentration", r"(concentration|concentrated|single.{0,10}(?:asset|invest|exposure)|undiversified)"),
    ("counterparty/exchange", r"(counterparty|counter.party|exchange.{0,10}(?:fail|insol|bankrupt)|exchange risk)"),
    ("valuation", r"(valuation.{0,10}(?:risk|difficult|uncertain)|fair value|net asset value|NAV)"),
    ("AML/KYC", r"(anti.money|money laundering|AML|KYC|know your customer|sanctions)"),
    ("insurance limitations", r"(insurance.{0,10}(?:limit|not cover|inadequate)|SIPC|FDIC.{0,10}not|uninsured)"),
)
# fixed values: limits of the section check: risk terms for each 1000 characters, topic terms, fee terms for each risk term
MIN_RISK_DENSITY, MIN_CRYPTO, MAX_FEE_RATIO = 3, 2, 0.5
# fixed values: headings between which annual and quarterly reports have sections, in the order in which they are tried
PAIRS_10K = (("risk_factors", "1A", "1B"), ("risk_factors", "1A", "2"), ("unresolved_staff", "1B", "2"), ("properties", "2", "3"))
PAIRS_10Q = (("risk_factors", "1A", "2"), ("risk_factors", "1A", "3"))
# fixed values: sections of reports by (section type, part, item, title), in the order in which they are tried; a current report's sections are its items
TYPED_10K = (("risk_factors", "", "1A", "TenK.risk_factors"), ("management_discussion", "", "7", "TenK.management_discussion"), ("business", "", "1", "TenK.business"))
TYPED_10Q = (("risk_factors", "II", "1A", "Part II, Item 1A"), ("legal_proceedings", "II", "1", "Part II, Item 1"), ("mda", "I", "2", "Part I, Item 2"))
TYPED_8K = "current_report_item"
# fixed values: types and titles of the sections that the other strategies find
PROSPECTUS_TYPE, LENIENT_TYPE, LENIENT_TITLE, PARAGRAPHS_TYPE, PARAGRAPHS_TITLE = "principal_risks", "risk_factors", "Item 1A (lenient)", "crypto_paragraphs", "Crypto-relevant paragraphs"
# fixed values: least characters of a section of an annual or quarterly report, and of one of a current report
TYPED_LEAST, TYPED_LEAST_8K = 500, 400
