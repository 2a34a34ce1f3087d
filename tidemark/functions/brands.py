"""Brand names: one spelling for known variants, and recovery from transcripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, fold, normalize_token, table

#: Variant (folded) -> brand.
ALIASES = {
    "rolaid": "Rolaids",
    "rolaids": "Rolaids",
    "creighton resort and casino": "Graton Resort and Casino",
    "greaten resort and casino": "Graton Resort and Casino",
    "grayton resort and casino": "Graton Resort and Casino",
    "grayton resort & casino": "Graton Resort and Casino",
    "graton resort & casino": "Graton Resort and Casino",
    "greaton.com": "Graton Resort and Casino",
    "graton.com": "Graton Resort and Casino",
    "zorton casino": "Graton Resort and Casino",
    "graton resort and casino": "Graton Resort and Casino",
    "smart & final": "Smart and Final",
    "smart and final": "Smart and Final",
    "golden state lumber and showroom": "Golden State Lumber",
    "golden state lumber": "Golden State Lumber",
    "xfinity mobile": "Xfinity",
    "xfinity": "Xfinity",
    "habes law": "Habas Law",
    "habus law": "Habas Law",
    "habas law": "Habas Law",
    "atco": "ATCO",
    "atko": "ATCO",
    "ambutra": "Ambetter",
    "mbutra": "Ambetter",
    "big lou insurance": "Big Lou",
    "big lou's life insurance": "Big Lou",
    "big lou": "Big Lou",
    "pf chang's": "P.F. Chang's",
    "p.f. chang's": "P.F. Chang's",
    "woc fire": "Wokfire",
    "wokfire": "Wokfire",
    "izervay": "Izervay",
    "izerve": "Izervay",
    "eyservé": "Izervay",
    "eyserve": "Izervay",
    "evasenq": "Izervay",
    "eye survey": "Izervay",
    "ethos": "Ethos",
    "ethos insurance": "Ethos",
    "the home depot": "The Home Depot",
    "home depot": "The Home Depot",
    "easy cater": "Easy Cater",
    "easycater": "Easy Cater",
    "ezcater": "Easy Cater",
    "selectquote": "SelectQuote",
    "select quote": "SelectQuote",
}
#: Spoken phrase -> brand, in order of precedence.
PHRASES = (
    ("national debt relief", "National Debt Relief"),
    ("community tax", "Community Tax"),
    ("billshappen", "BillsHappen.com"),
    ("bills happen", "BillsHappen.com"),
    ("river rock casino", "River Rock Casino"),
    ("advertise with live 105", "Live 105"),
    ("you spray, they play", "Spruce"),
    ("you spray they play", "Spruce"),
    ("big lou", "Big Lou"),
    ("biglou", "Big Lou"),
    ("select quote", "SelectQuote"),
    ("selectquote", "SelectQuote"),
    ("ziprecruiter", "ZipRecruiter"),
    ("jumpstart md", "JumpStartMD"),
    ("jumpstartmd", "JumpStartMD"),
)
#: Domain -> brand.
DOMAINS = {
    "billshappen": "BillsHappen.com",
    "bigloo": "Big Lou",
    "biglou": "Big Lou",
    "audacy": "Live 105",
    "odyssey": "Live 105",
    "mirastarfcu": "MiraStar FCU",
    "selectquote": "SelectQuote",
    "ziprecruiter": "ZipRecruiter",
    "ethos": "Ethos",
}
#: Domains that are no advertisers.
STOPLIST = ("calmatters", "usps", "standuptocancer", "children", "medical", "www", "google", "youtube", "facebook", "instagram", "gov")
URL = r"\b([A-Za-z0-9][A-Za-z0-9\-]{2,30})\.(?:[cC][oO][mM]|[oO][rR][gG]|[nN][eE][tT])\b"


def canonicalize_brand(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Collapsed, a free-standing & as and; known variants as their brand; null if blank."""
    clean = F.regexp_replace(collapse(c), " & ", " and ")
    return F.when(clean != "", F.coalesce(F.element_at(table(ALIASES if aliases is None else aliases), normalize_token(clean)), clean))


def extract_brand(c: Column) -> Column:
    """The brand of the first known phrase, else of the first known domain, else null."""
    low = fold(c)
    phrase = F.lit(None).cast("string")
    for text, brand in reversed(PHRASES):
        phrase = F.when(low.contains(text), brand).otherwise(phrase)
    domain = table({k: v for k, v in DOMAINS.items() if k not in STOPLIST})
    stems = F.transform(F.regexp_extract_all(c, F.lit(URL), 1), F.lower)
    known = F.filter(F.transform(stems, lambda s: F.element_at(domain, s)), lambda b: b.isNotNull())
    return F.when(F.trim(c) != "", canonicalize_brand(F.coalesce(phrase, F.get(known, F.lit(0)))))


def brand_key(c: Column) -> Column:
    """What two spellings of a brand share."""
    return normalize_token(canonicalize_brand(c))
