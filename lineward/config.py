"""Scan configuration: which keywords, which matcher, how much noise."""

from __future__ import annotations

from dataclasses import dataclass

# The default keyword list offered to users, and the defaults of the scan form.
DEFAULT_KEYWORDS = "秘密,机密,绝密,内部,涉密,保密,密级,不予公开"
DEFAULT_ALGORITHM = "regex"
DEFAULT_MAX_INSERT = 3

# How long a stored result stays valid, in seconds, per kind of source.
RESULT_TTL_SECONDS = {
    "web": 86400,
    "file": 604800,
    "image": 604800,
    "audio": 604800,
    "db": 3600,
}


def parse_keywords(keywords: str | list[str] | tuple[str, ...] | None) -> tuple[str, ...]:
    """Split a comma-separated list (trimmed, empties dropped); a list is taken as it is."""
    if keywords is None:
        return ()
    if isinstance(keywords, str):
        return tuple(k for k in (part.strip() for part in keywords.split(",")) if k)
    return tuple(k for k in keywords if k)


@dataclass(frozen=True)
class ScanConfig:
    """What to look for.

    ``algorithm="regex"`` is the noise-tolerant matcher, any other value the exact one.
    ``keywords`` keeps the user's raw value because the result fingerprint depends on it.
    """

    keywords: str | tuple[str, ...] = DEFAULT_KEYWORDS
    algorithm: str = DEFAULT_ALGORITHM
    max_insert: int = DEFAULT_MAX_INSERT

    def __post_init__(self):
        if isinstance(self.keywords, list):
            object.__setattr__(self, "keywords", tuple(self.keywords))

    @property
    def keyword_list(self) -> tuple[str, ...]:
        return parse_keywords(self.keywords)

    @property
    def is_fuzzy(self) -> bool:
        return self.algorithm == "regex"

    def fingerprint_key(self, extractor: str = "") -> str:
        """The configuration part of a result fingerprint.

        ``extractor`` names the text producer (an OCR set-up, say): a different producer must not
        reuse stored results.
        """
        raw = self.keywords if isinstance(self.keywords, str) else ",".join(self.keywords)
        if extractor:
            raw = f"{raw}||ocr:{extractor}"
        return f"{raw}||{self.algorithm}||{self.max_insert}"
