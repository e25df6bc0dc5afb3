"""Ids and addresses of postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts of known portals (fixed values).
PORTALS = ("greenhouse", "workday", "lever")


def normalized(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores of any script."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", "")


def canonical_url(url: Column) -> Column:
    """Without query, fragment and the parameters of the last segment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r";[^/]*$", "")


def portal_id(url: Column) -> Column:
    """gh_jid of the query, else a path segment that begins with 8 to 15 digits; null if neither is there."""
    query = F.regexp_extract(url, r"[?&]gh_jid=(\d+)", 1)
    path = F.regexp_extract(canonical_url(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(?:/[^/]*)*?/(\d{8,15})(?:[^\d/][^/]*)?(?:/|$)", 1)
    return F.coalesce(F.nullif(query, F.lit("")), F.nullif(path, F.lit("")))


def portal(url: Column) -> Column:
    """Portal that serves a posting."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    out = F.when(F.coalesce(url, F.lit("")).contains("gh_jid="), "greenhouse")
    for name in PORTALS:
        out = out.when(host.contains(name), name)
    return out.otherwise("custom")


def job_id(company: Column, title: Column, location: Column, url: Column | None = None, strict: bool = False) -> Column:
    """portal:16 hex digits of a hash of company, title, location and an anchor.

    The anchor is the canonical address if that holds no portal id, else the company; with ``strict`` the portal id itself.
    """
    address = F.lit(None).cast("string") if url is None else url
    number = portal_id(address)
    company_name = normalized(company)
    anchor = F.when(address.isNotNull() & (address != "") & number.isNull(), canonical_url(address)).otherwise(number if strict else company_name)
    payload = F.concat_ws("|", company_name, normalized(title), normalized(location), F.coalesce(anchor, company_name))
    return F.concat(portal(address), F.lit(":"), F.substring(F.sha2(payload, 256), 1, 16))
