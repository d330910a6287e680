"""Settings of an analysis; they enter plans as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    theme_count: int = 8
    #: quotes shown for each theme; 0 or less: all
    quotes_per_theme: int = 0
    min_theme_size: int = 1
    min_quote_words: int = 4
    #: up to this many quotes a corpus is clustered by merging pairs
    agglomerative_limit: int = 120
    central_theme: str = ""

    def clamped(self) -> Settings:
        """As an interactive caller gives them: at least one theme, no negative count."""
        return Settings(
            max(1, self.theme_count), max(
                0, self.quotes_per_theme
            ), self.min_theme_size, self.min_quote_words, self.agglomerative_limit, self.central_theme.strip()
        )
