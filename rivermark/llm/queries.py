"""Importing this module registers the queries of all operators."""

from rivermark.llm import (  # noqa: F401
    decontamination,
    exact_dedup,
    html_extract,
    lexical_search,
    licenses,
    mixing,
    near_dedup,
    packing,
    quality,
    secrets,
    tokens,
    toxicity,
    vector_codes,
)
