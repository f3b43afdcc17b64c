"""Licence, time, maturity and seeded-choice columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Licence strings that say nothing.
JUNK_LICENSES = ("", "unknown", "open source", "noassertion", "other", "n/a", "none", "unspecified", "not specified")
#: Substrings by which a licence is told, in order, and the terms of each kind.
LICENSE_TERMS = (
    ("MIT|APACHE-2\\.0|APACHE 2\\.0|BSD|ISC|CC0", "Permissive", "Commercially Friendly", "Permissive license allowing proprietary commercial usage and modification without source redistribution.", "permissive"),
    ("GPL|AGPL|LGPL|MPL", "Copyleft", "Source-Reciprocal (Caution)", "Copyleft license requiring derivative works or hosted modifications to make source available.", "copyleft"),
    ("BSL|SSPL|COMMERCIAL|ELV2", "Fair-Core / Source-Available", "Cloud Restriction", "Source-available license restricting competitive hosted cloud-service offerings.", "source-available"),
)
UNKNOWN_TERMS = ("Unknown / Unspecified", "Custom Terms", "Custom or unspecified license. Review the repository LICENSE file for explicit commercial terms.", "unknown")
#: Fixed value: the date that stands for a missing one.
MISSING_DATE = "2026-09-01T00:00:00Z"
DAY = 86_400


def normalize_license(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(text).isin(*JUNK_LICENSES), "Unknown").otherwise(text)


def _by_terms(c: Column, pick) -> Column:
    upper = F.upper(F.coalesce(c, F.lit("")))
    out = None
    for pattern, *terms in LICENSE_TERMS:
        out = (F if out is None else out).when(upper.rlike(pattern), pick(terms))
    return out.otherwise(pick(list(UNKNOWN_TERMS)))


def license_terms(c: Column) -> Column:
    """Struct of tier, commercial and desc."""
    return _by_terms(c, lambda t: F.struct(F.lit(t[0]).alias("tier"), F.lit(t[1]).alias("commercial"), F.lit(t[2]).alias("desc")))


def license_tier(c: Column) -> Column:
    return _by_terms(normalize_license(c), lambda t: F.lit(t[3]))


def parse_epoch(c: Column) -> Column:
    """Seconds since 1970 of an ISO timestamp; without a zone it is UTC (the session's zone is taken to be); null if it isn't one."""
    return F.unix_timestamp(F.try_to_timestamp(c))


def real_date(c: Column) -> Column:
    """Null for the date that stands for a missing one."""
    return F.nullif(c, F.lit(MISSING_DATE))


def activity(epoch: Column, archived: Column, as_of: int) -> Column:
    return (
        F.when(F.coalesce(archived, F.lit(False)), "archived").when(epoch.isNull(), F.lit(None).cast("string"))
        .when(F.lit(as_of) - epoch <= 365 * DAY, "active").otherwise("idle")
    )


#: Ratings, levels, sentences and bounds of maturity, inside ``maturity``.
def maturity(stars: Column, forks: Column, epoch: Column, as_of: int) -> Column:
    """Struct of rating, level and desc. Four years (of 365.25 whole days) without a push beat every number of stars."""
    years = F.floor((F.lit(as_of) - epoch) / DAY) / 365.25

    def tier(rating, level: str, desc: str) -> Column:
        rating = rating if isinstance(rating, Column) else F.lit(rating)
        return F.struct(rating.alias("rating"), F.lit(level).alias("level"), F.lit(desc).alias("desc"))

    last = F.concat(F.lit("Dormant Legacy (last push "), F.year(F.timestamp_seconds(epoch)).cast("string"), F.lit(")"))
    return (
        F.when(years >= 4.0, tier(last, "tier-4", "No pushes in over four years — stars reflect historical adoption, not current maintenance."))
        .when(stars >= 50_000, tier("Hyper-Scale / Industry Standard", "tier-1", "Massively adopted across global technology industry."))
        .when((stars >= 20_000) & (F.coalesce(forks, F.lit(0)) >= 1000), tier("Production Battle-Tested", "tier-2", "High ecosystem stability, active community, and proven production deployments."))
        .when(stars >= 20_000, tier("High Adoption / Low Fork Traction", "tier-3", "Star-heavy but modest fork activity — viral reach, narrower production footprint."))
        .when(stars >= 5_000, tier("Rapid Growth / Emerging Core", "tier-3", "Significant traction with expanding developer adoption."))
        .otherwise(tier("Promising / Specialized", "tier-4", "Specialized utility or rising repository crossing high-star threshold."))
    )


_M32 = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2 ** 32 of values below it, in halves so that no product leaves 64 bits."""
    high = F.shiftrightunsigned(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + a.bitwiseAND(F.lit(0xFFFF).cast("long")) * b).bitwiseAND(F.lit(_M32))


def text_seed(c: Column) -> Column:
    """FNV-1a of 32 bits over the characters of an ASCII text."""
    chars = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(chars, F.lit(0x811C9DC5).cast("long"), lambda h, x: _times(h.bitwiseXOR(x), F.lit(0x01000193).cast("long")))


def draw(seed: Column, k: Column) -> Column:
    """The k-th (from 0) number in [0, 1) of the mulberry32 sequence of a seed: its state only adds a constant per draw."""
    mask = F.lit(_M32)
    step = _times(((k.cast("long") + 1).bitwiseAND(mask)), F.lit(0x6D2B79F5).cast("long"))
    a = (seed + step).bitwiseAND(mask)
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = ((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseAND(mask)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def pick_index(seed: Column, k: Column, n: Column) -> Column:
    """Index from 0 of the k-th draw among n; null if there are none."""
    return F.when(n > 0, F.floor(draw(seed, k) * n).cast("int"))
