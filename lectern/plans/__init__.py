"""The registered queries, by section."""

from . import aggregates, board_build, corpus_build, documents, filters_joins, programmes, retrieval, scalars, sources_streams, windows_sorts_sets  # noqa: F401
