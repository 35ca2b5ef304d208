"""The corpus operators' queries by name, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from riskweave.llm import alignment, chat_format, decontaminate, language_id, lexicon, mixing, ngram_jaccard, parsing, secret_ledger, suffixes, token_codes, toxicity, whitening


def queries() -> dict:
    return {
        "op1_secret_ledger": secret_ledger.op1_secret_ledger,
        "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
        "op3_mixing": mixing.op3_mixing,
        "op4_token_codes": token_codes.op4_token_codes,
        "op5_fingerprints": parsing.op5_fingerprints,
        "op6_language_id": language_id.op6_language_id,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
        "op11_bpe_lexicon": lexicon.op11_bpe_lexicon,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict:
    return {
        "op1_secret_ledger": secret_ledger.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op9_chat_format": chat_format.OP9_SQL,
    }
