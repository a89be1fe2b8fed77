"""Parameters of retrieval and chunking, with their defaults and bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields

#: Fixed values: (lowest, highest) of each bounded parameter.
BOUNDS = {
    "chunk_size": (100, 5000),
    "chunk_overlap": (0, 1000),
    "top_k": (1, 50),
    "min_score": (0.0, 1.0),
    "bm25_weight": (0.0, 1.0),
    "vector_weight": (0.0, 1.0),
    "max_chunks_scan": (100, 10000),
    "candidate_factor": (1, 10),
    "tag_top_n": (1, 20),
    "tag_min_score": (0.0, 1.0),
}


@dataclass(frozen=True)
class SearchSettings:
    """Search parameters; a value outside its bounds raises ValueError."""

    chunk_size: int = 1000
    chunk_overlap: int = 200
    appendix_cutoff: int = 5000
    top_k: int = 5
    min_score: float = 0.25
    bm25_weight: float = 0.5
    vector_weight: float = 0.5
    max_chunks_scan: int = 2000
    candidate_factor: int = 2
    min_candidates: int = 20
    tag_top_n: int = 5
    tag_min_score: float = 0.5
    citation_threshold: float = 0.15
    citation_min_similarity: float = 0.10
    citation_candidates: int = 10
    related_top_k: int = 5
    related_min_score: float = 0.1
    related_factor: int = 5
    page_window: int = 1
    rerank_boost: float = 0.01
    page_size: int = 20
    tag_page_size: int = 50

    def __post_init__(self):
        for f in fields(self):
            low, high = BOUNDS.get(f.name, (float("-inf"), float("inf")))
            if not low <= getattr(self, f.name) <= high:
                raise ValueError(f"{f.name} must lie in {low}..{high}")

    @property
    def candidates(self) -> int:
        """How many rows the hybrid search takes from the text ranking."""
        return max(self.min_candidates, self.candidate_factor * self.top_k)
