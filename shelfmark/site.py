"""What belongs to one catalog site: host, names and markers. Every function that needs them takes a ``Site``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Site:
    host: str = "book.example.org"
    name: str = "Site"
    catalog: str = "Catalog"
    title_suffix: str = "Catalog"  # page titles end in " (suffix)"
    key_prefix: str = "book"  # of bibliography keys
    collection_prefix: str = "shelfmark"

    @property
    def root(self) -> str:
        return f"https://{self.host}"


SITE = Site()
