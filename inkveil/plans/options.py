"""Job options and their rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.patterns import CATEGORY_ORDER

# Categories switched on by "all", and the accepted languages.
ALL_CATEGORIES = ["phone", "email", "credit_card", "cvv", "expiry", "iban", "bic", "aadhaar", "pan"]
LANGUAGES = ["auto", "en", "fr", "de", "es", "it", "pt", "nl", "hi", "zh", "ja", "ko", "ar", "ru"]


@dataclass(frozen=True)
class RedactOptions:
    """What to find and how to hide it.

    At least one category or a mask is needed; with ``mask_counts=False`` a mask
    alone is not enough (the rule of the upload form).
    """

    categories: tuple[str, ...] = ()
    all_categories: bool = False
    mask: str | None = None
    language: str = "auto"
    preserve_headings: bool = True
    blur: bool = False
    verify: bool = False
    report_only: bool = False
    mask_counts: bool = field(default=True, repr=False)

    def __post_init__(self):
        unknown = set(self.categories) - set(CATEGORY_ORDER)
        if unknown:
            raise ValueError(f"unknown categories: {sorted(unknown)}")
        chosen = self.enabled(with_mask=False)
        if not chosen and not (self.mask and self.mask_counts):
            raise ValueError("select at least one category" + (" or a mask" if self.mask_counts else ""))

    def enabled(self, with_mask: bool = True) -> list[str]:
        """Enabled categories in processing order."""
        chosen = set(ALL_CATEGORIES if self.all_categories else self.categories) - {"mask"}
        if with_mask and self.mask:
            chosen.add("mask")
        return [c for c in CATEGORY_ORDER if c in chosen]

    def page_language(self, detected: Column) -> Column:
        """An explicit language overrides the detected one."""
        if self.language == "auto":
            return F.coalesce(detected, F.lit("en"))
        return F.lit(self.language)


def accepted_language(requested: Column) -> Column:
    """Languages outside the accepted list fall back to ``auto``."""
    return F.when(requested.isin(LANGUAGES), requested).otherwise("auto")
