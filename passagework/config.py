"""Settings of a search and their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# What the service being matched uses when a setting is not given.
DEFAULT_LIMIT = 5
DEFAULT_THRESHOLD = 0.7
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200
DEFAULT_ALPHA = 0.5
DOCUMENT_EXTENSIONS = ("md", "mdx", "txt")
INDEX_DIRECTORY = ".vector-store"
STORED_METADATA_KEYS = ("source", "startLine", "endLine", "documentType")
BOOST_RULES = (("clean-architecture", 0.99),)

# Our own settings.
DEFAULT_DIM = 256
SCORE_DECIMALS = 6
BM25_K1 = 1.2
BM25_B = 0.75

# A side of a join is broadcast only if it was measured to be at most this large.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 500_000
# A task holds at most about this many of the best rows found so far.
HELD_ROWS = 4_000_000

METRICS = ("cosine", "l2", "ip")
SEARCHERS = ("exact", "lsh", "ivf", "pruned", "graph")
FILTER_MODES = ("post", "pre")


@dataclass(frozen=True)
class SearchConfig:
    """Settings of :func:`passagework.plans.search.search`.

    ``hybrid`` and ``alpha`` apply to queries that do not carry their own
    ``use_hybrid`` / ``alpha``, and so do the filters and includes.
    """

    limit: int = DEFAULT_LIMIT
    threshold: float = DEFAULT_THRESHOLD
    metric: str = "cosine"
    dim: int = DEFAULT_DIM
    hybrid: bool = False
    alpha: float = DEFAULT_ALPHA
    boost_rules: tuple = BOOST_RULES
    resort: bool = False
    filter_mode: str = "post"
    document_types: tuple = ()
    source_pattern: str = ""
    date_from: str | None = None
    date_to: str | None = None
    include_metadata: bool = False
    include_summary: bool = False
    include_keywords: bool = False
    include_relevance: bool = False
    metadata_keys: tuple = ()

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"Unsupported metric: {self.metric}")
        if self.filter_mode not in FILTER_MODES:
            raise ValueError(f"Unsupported filter mode: {self.filter_mode}")
        if not 0.0 <= self.alpha <= 1.0:
            raise ValueError("alpha must lie between 0 and 1")
        if self.limit < 0:
            raise ValueError("limit must not be negative")
