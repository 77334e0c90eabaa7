"""Licence expressions against a list of permitted licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each permitted licence may be written, lower case and without punctuation,
# and package licences that were reviewed.
PERMITTED = {
    "MIT": ("mit", "mitlicense"),
    "BSD-2-Clause": ("bsd2clause", "bsdlicense2clause"),
    "BSD-3-Clause": ("bsd3clause", "bsdlicense3clause", "bsdlicense"),
    "Apache-2.0": ("apache2", "apache20", "apachelicense20", "apachesoftwarelicense"),
    "ISC": ("isc",),
    "Python-2.0": ("python2", "python20", "pythonsoftwarefoundationlicense"),
    "PSF-2.0": ("psf2", "psf20", "psflicense"),
}
REVIEWED = {"certifi": ("MPL-2.0", "Mozilla Public License 2.0 (MPL 2.0)")}
REVIEWED_VERSIONS = {("pypdfium2", "5.13.0"): "BSD-3-Clause, Apache-2.0, dependency licenses"}


def permitted(expression: Column) -> Column:
    """One alternative (OR) must have all its parts (AND and , ; | /) permitted; nested expressions are not read."""
    names = F.array(*[F.lit(n) for forms in PERMITTED.values() for n in forms])
    part = lambda x: F.array_contains(names, F.regexp_replace(F.lower(x), "[^a-z0-9]+", ""))
    every = lambda alternative: F.forall(F.split(alternative, r"(?i)\s+AND\s+|[,;|/]"), part)
    nested = expression.rlike("[()]") & expression.rlike(r"(?i)\b(?:AND|OR)\b")
    return ~nested & F.exists(F.split(expression, r"(?i)\s+OR\s+"), every)


def passes(package: Column, version: Column, expression: Column) -> Column:
    """Whether a package may be shipped: permitted, or reviewed by name (and version)."""
    known = F.lit(False)
    for name, forms in REVIEWED.items():
        known = known | ((F.lower(package) == name) & expression.isin(*forms))
    for (name, v), form in REVIEWED_VERSIONS.items():
        known = known | ((F.lower(package) == name) & (version == v) & (expression == form))
    return known | permitted(expression)
