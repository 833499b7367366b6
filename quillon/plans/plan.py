"""Search plans: expansion, retrieval lanes, fusion and reranking, with the presets and their overrides."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from quillon.operators import expansion, fusion, rerank
from quillon.operators.retrieve import LANES

FUSIONS: dict[str, Callable] = {"rrf": fusion.rrf}
#: Lanes beside the built-in ones, by name: f(variants, corpus, shortlist) gives a lane's rows.
OWN_LANES: dict[str, Callable] = {}


def register_lane(name: str, make: Callable) -> None:
    """Let plans name a lane of the caller's own."""
    if name in LANES:
        raise ValueError(f"{name} is a built-in retriever")
    OWN_LANES[name] = make


def register_fusion(name: str, fuse: Callable) -> None:
    """Let plans name a fusion of the caller's own: f(lanes, shortlist, payload) as fusion.rrf has it."""
    FUSIONS[name] = fuse


def register_preset(plan: SearchPlan) -> None:
    """Let resolve() find a plan of the caller's own by its name."""
    PRESETS[plan.name] = plan



@dataclass(frozen=True)
class SearchPlan:
    name: str
    expansion: str
    lanes: tuple[str, ...]
    fusion: str
    reranking: str

    def __post_init__(self) -> None:
        for what, value, known in (("expansion", self.expansion, (*expansion.PLAIN, *expansion.KINDS)), ("fusion", self.fusion, FUSIONS), ("reranking", self.reranking, rerank.KINDS)):
            if value not in known:
                raise ValueError(f"unknown {what}: {value}")
        strange = set(self.lanes) - set(LANES) - set(OWN_LANES)
        if not self.lanes or strange:
            raise ValueError(f"unknown retrievers: {sorted(strange) or 'none given'}")

    def with_overrides(self, lanes: tuple[str, ...] | None = None, fusion: str | None = None, reranking: str | None = None) -> SearchPlan:
        """The plan with other lanes, fusion or reranking; expansion belongs to the preset."""
        return replace(self, lanes=lanes or self.lanes, fusion=fusion or self.fusion, reranking=reranking or self.reranking)

    @property
    def needs_embedder(self) -> bool:
        return "vector" in self.lanes


def _presets() -> dict[str, SearchPlan]:
    one, all_ = {"lexical": "bm25", "bm25": "bm25", "vector": "vector"}, LANES
    rows = [(name, "none", (lane,), "none") for name, lane in one.items()]
    rows += [("hybrid", "none", ("bm25", "vector"), "none"), ("path-hybrid", "none", ("bm25", "path-fuzzy"), "position-aware"), ("legacy-hybrid", "none", all_, "position-aware")]
    pages = {"hybrid": ("splade", "position-aware"), "llm": ("hyde", "llm"), "qwen": ("none", "llm"), "splade": ("splade", "position-aware"), "classified": ("classified", "position-aware"), "jina": ("splade", "jina"), "gemma": ("splade", "gemma")}
    rows += [(f"page-index-{name}", grown, all_, last) for name, (grown, last) in pages.items()]
    return {name: SearchPlan(name, grown, lanes, "rrf", last) for name, grown, lanes, last in rows}


PRESETS = _presets()


def resolve(name: str) -> SearchPlan:
    if name not in PRESETS:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(names())}")
    return PRESETS[name]


def names() -> list[str]:
    return sorted(PRESETS)
