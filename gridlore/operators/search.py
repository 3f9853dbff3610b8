"""Point lookups, facets and full-field search."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.functions.text import not_equal, strip

ALL = "all"
# The fields that the pages search, scalars and arrays.
ALERT_FIELDS = (("id", "message", "assetId", "datacomponent", "chainId", "layerC.action"), ("techniqueIds", "tacticIds", "srcIps", "destIps"))
LOG_FIELDS = (("id", "message", "source", "assetId", "alertId"), ())
MITIGATION_FIELDS = (("title", "rationale", "id", "chainId", "kgMitigationId", "kgMitigationName"), ("appliesToAssets", "appliesToTechniques", "appliesToZones"))
CHAIN_FIELDS = (("name", "summary", "id"), ("techniques", "tactics", "targetAssets"))
PUBLIC_SITE = ("id", "username", "site_name", "ics_architecture", "created_at", "updated_at")


def tenant(df: DataFrame, site_id: int, site: str = "site_id") -> DataFrame:
    return df.where(F.col(site) == site_id)


def tenant_scan(df: DataFrame, site_id: int, site: str = "site_id", order: str = "id") -> DataFrame:
    return tenant(df, site_id, site).orderBy(order)


def lookup(df: DataFrame, site_id: int, key: object, site: str = "site_id", id_col: str = "id") -> DataFrame:
    """The tenant's row of a primary key, or none; another tenant's row is never seen."""
    return tenant(df, site_id, site).where(F.col(id_col) == key).limit(1)


def by_username(sites: DataFrame, username: str) -> DataFrame:
    """Trimmed and compared by case."""
    return sites.where(F.col("username") == F.lit(username.strip()))


def public(sites: DataFrame, allowed: Iterable[str] = PUBLIC_SITE) -> DataFrame:
    """Only the columns that are allowed out; a new column stays inside until it is named."""
    return sites.select(*[c for c in allowed if c in sites.columns])


def equals(column: str, value: str | None) -> Column:
    """`all` or nothing asked for: every row."""
    return F.lit(True) if value in (None, ALL) else F.coalesce(F.col(column) == value, F.lit(False))


def holds(column: str, value: str | None) -> Column:
    """Membership in an array; a null array is empty."""
    return F.lit(True) if value in (None, ALL) else F.coalesce(F.array_contains(column, value), F.lit(False))


def facets(df: DataFrame, scalars: dict[str, str | None] | None = None, arrays: dict[str, str | None] | None = None) -> DataFrame:
    tests = [equals(c, v) for c, v in (scalars or {}).items()] + [holds(c, v) for c, v in (arrays or {}).items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def joined_text(scalars: Iterable[str], arrays: Iterable[str] = ()) -> Column:
    """All fields in lower case with one space between; a null field leaves its two spaces, an empty array leaves none."""
    parts = [F.array(*[F.col(c).cast("string") for c in scalars])] + [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in arrays]
    return F.lower(F.array_join(F.concat(*parts), " ", ""))


def text_search(df: DataFrame, query: str, scalars: Iterable[str], arrays: Iterable[str] = ()) -> DataFrame:
    """Rows whose joined fields contain the trimmed query, any case, across fields too; an empty query keeps all."""
    wanted = query.strip().lower()
    return df.where(joined_text(scalars, arrays).contains(wanted)) if wanted else df


def any_flag(*columns: str) -> Column:
    """One of the flags is true; null is false."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit(False)) for c in columns])


def awaiting_approval(required: str = "requiresHumanApproval", status: str = "status") -> Column:
    return F.coalesce(F.col(required), F.lit(False)) & not_equal(F.col(status), "implemented")


def paused(df: DataFrame, is_paused: bool) -> DataFrame:
    return df.limit(0) if is_paused else df


def prefix(column: str, n: int) -> Column:
    return F.slice(F.coalesce(F.col(column), F.array().cast("array<string>")), 1, n)


def validation(text: str, low: int, high: int, blank: bool = False) -> Column:
    """Length from low to high; blank texts pass only where allowed."""
    c = F.coalesce(F.col(text), F.lit(""))
    return F.char_length(c).between(low, high) & (F.lit(blank) | (strip(c) != ""))
