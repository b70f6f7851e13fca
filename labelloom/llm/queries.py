"""Importing this module registers the queries of the package."""

from labelloom.llm import (  # noqa: F401
    bpe, collocations, language_model, licenses, mixing, multiset, quality, ranking, repeats, sharding, simhash, token_files, warc,
)
