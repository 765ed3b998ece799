"""URL, masking and path helpers (Column -> Column)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_param(url: Column, name: str) -> Column:
    """First non-blank value of query parameter ``name``, decoded; NULL when there is none."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    raw = F.nullif(F.regexp_extract(query, rf"(?:^|&){re.escape(name)}=([^&]+)", 1), F.lit(""))
    # A broken percent sequence leaves the rest of the value readable.
    return F.coalesce(F.try_url_decode(raw), F.translate(raw, "+", " "))


def url_groups(url: Column, pattern: str, n_groups: int) -> list[Column]:
    """The groups of ``pattern`` anywhere in ``url``; NULL when it does not match."""
    hit = url.rlike(pattern)
    return [F.when(hit, F.regexp_extract(url, pattern, i)) for i in range(1, n_groups + 1)]


# Fixed value: ids in a workspace address.
WORKSPACE_PATTERN = r"groups/([\w-]+)/lakehouses/([\w-]+)"


def mask_middle(secret: Column, keep: int = 20) -> Column:
    """First and last ``keep`` characters with ``...`` between; short values are hidden entirely."""
    shown = F.concat(F.left(secret, F.lit(keep)), F.lit("..."), F.right(secret, F.lit(keep)))
    return F.when(F.length(secret) <= 2 * keep, F.lit("...")).otherwise(shown)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def plural_table(table: str) -> str:
    """Remote table addresses are the table name with an ``s``."""
    return f"{table}s"
