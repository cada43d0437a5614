"""Parameters of the engine, with typed reading of overrides from a mapping such as the environment."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    # The defaults that results depend on.
    cache_ttl_seconds: int = 43200
    summary_fallback_on_limit: bool = False
    feed_blocklist: str = ""
    aggregator_feed_items_limit: int = 100
    feed_items_per_feed: int = 25
    news_global_limit: int = 2000
    precluster_threshold: float = 0.42
    precluster_min_size: int = 2
    precluster_max_group: int = 60
    cluster_jaccard_merge: float = 0.4
    cluster_seed_chunk: int = 35
    cluster_seed_overlap: int = 8
    cluster_uncovered_chunk: int = 60
    cluster_title_merge: float = 0.7
    cluster_entity_min_shared: int = 2
    cluster_entity_min_length: int = 4
    cluster_entity_min_coherence: float = 0.20
    cluster_coherence_threshold: float = 0.54
    cluster_coherence_min: int = 2
    cluster_llm_merge: bool = True
    cluster_expand_sim: float = 0.65
    cluster_expand_max_add: int = 15
    cluster_expand_time_hours: float = 48.0
    cluster_expand_category_strict: bool = True
    cluster_per_domain_max: int = 8
    cluster_display_cap: int = 50
    cluster_summarize_top_n: int = 6
    severity_llm_top_n: int = 8
    score_w_articles: float = 0.6
    score_w_domains: float = 0.8
    score_w_images: float = 0.4
    score_w_velocity: float = 1.5
    score_velocity_window_hours: float = 4.0
    score_image_bonus_ge2: float = 2.0
    score_image_bonus_ge1: float = 1.0
    score_image_penalty_none: float = -2.0
    related_min_shared: int = 2
    related_min_length: int = 4
    related_min_coherence: float = 0.03
    related_max: int = 5
    similarity_sample: int = 20
    min_image_width: int = 320
    min_image_height: int = 200
    topic_recency_hours: float = 24.0


def as_int(value: str, fallback: int) -> int:
    """The integer that the text begins with."""
    m = re.match(r"\s*[+-]?\d+", value)
    return int(m.group()) if m else fallback


def as_number(value: str, fallback: float) -> float:
    try:
        found = float(value)
    except ValueError:
        return fallback
    return found if found not in (float("inf"), float("-inf")) and found == found else fallback


def as_bool(value: str, fallback: bool) -> bool:
    low = value.strip().lower()
    return True if low in ("1", "true", "yes", "on") else False if low in ("0", "false", "no", "off") else fallback


def from_env(env: Mapping[str, str], base: Params = Params()) -> Params:
    """base with every parameter that env names in capitals; blank or unreadable values leave it as it was."""
    changes: dict[str, object] = {}
    for f in fields(base):
        value, old = env.get(f.name.upper()), getattr(base, f.name)
        if value is None or not value.strip():
            continue
        read = as_bool if isinstance(old, bool) else as_int if isinstance(old, int) else as_number if isinstance(old, float) else lambda v, _: v
        changes[f.name] = read(value, old)
    return replace(base, **changes)
