"""The site registry: which host belongs to which site.

A site is one row of the ``parser_configs`` table. Its size follows the number of configured sites, not the data, so
it is held on the driver; ``load_sites`` checks that bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame

#: Most sites held in memory. A registry above this size is refused instead of being broadcast.
MAX_SITES = 200_000
#: Hosts remembered by a resolver before its memory is emptied.
REMEMBERED = 100_000


@dataclass
class SiteRegistry:
    """Resolves hosts and URLs to sites: the host itself, or what is left after its first labels are dropped."""

    sites: dict[str, dict]
    _known: dict[str, str | None] = field(default_factory=dict, repr=False)

    def of_host(self, host: str | None) -> str | None:
        """The site of a host; null for null and for hosts of no site."""
        if not host:
            return None
        found = self._known.get(host, "")
        if found != "":
            return found
        name = host.strip().lower().rstrip(".").rpartition("@")[2].partition(":")[0]
        at: str | None = name
        while at and at not in self.sites:
            at = at.partition(".")[2]
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        self._known[host] = at or None
        return at or None

    def of_url(self, url: str | None) -> str | None:
        """The site of a URL; null for null, unreadable URLs and hosts of no site."""
        if not url:
            return None
        start = url.find("://")
        if start < 0:
            return None
        rest = url[start + 3 :]
        for stop in "/?#":
            rest = rest.partition(stop)[0]
        return self.of_host(rest)


def host_of(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def load_sites(configs: DataFrame) -> SiteRegistry:
    """Collect the registry, refusing more than ``MAX_SITES`` rows. Of rows with one domain the first in order counts."""
    rows = configs.where("domain is not null").limit(MAX_SITES + 1).collect()
    if len(rows) > MAX_SITES:
        raise ValueError(f"more than {MAX_SITES} sites: the registry is no longer a small table")
    sites: dict[str, dict] = {}
    for row in sorted(rows, key=lambda r: (r["domain"], str(r))):
        sites.setdefault(row["domain"].strip().lower(), row.asDict(recursive=True))
    return SiteRegistry(sites)
