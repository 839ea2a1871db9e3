"""Lexicons shipped as resources (stop words) and small label-name tables."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

_RES = Path(__file__).resolve().parents[1] / "resources"


@lru_cache(maxsize=None)
def stop_words(lang: str = "en") -> tuple[str, ...]:
    """English stop words: Spark ML's default list (``StopWordsRemover``),
    stored as a resource so the oracle SQL uses the same list."""
    return tuple(w for w in (_RES / f"stopwords_{lang}.txt").read_text().split("\n") if w)


# Class names of the label maps.
LABEL_NAMES: dict[str, list[str]] = {
    "ag_news": ["World", "Sports", "Business", "Sci / Tech"],
    "instance_severity": ["low", "high"],
}
