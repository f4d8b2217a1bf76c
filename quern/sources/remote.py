"""Remote sources: HTTP with retries, an article search, and listings of an object store.

None of them runs inside a plan by itself: ``fetched`` in ``io`` calls a function
such as these for each id, in the tasks.  ``opener`` stands for the network.
"""

from __future__ import annotations

import html
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable

Opener = Callable[[str, float], bytes]

SEARCH = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/esearch.fcgi"


def _open(url: str, timeout: float) -> bytes:
    with urllib.request.urlopen(url, timeout=timeout) as reply:  # noqa: S310
        return reply.read()


def http_get(url: str, timeout: float = 90, tries: int = 3, wait: float = 1.5, opener: Opener = _open) -> bytes:
    """The body; after a failure another try, n * wait seconds later."""
    for n in range(1, tries + 1):
        try:
            return opener(url, timeout)
        except OSError:
            if n == tries:
                raise
            time.sleep(n * wait)
    raise ValueError("tries must be 1 or more")


def search_url(query: str, most: int = 100, first: str | None = None, last: str | None = None, date: str = "pdat") -> str:
    """A search for openly licensed articles, the most relevant first, within dates if both are given."""
    terms = {"db": "pmc", "term": f"({query}) AND (cc0 license[filter] OR cc by license[filter]) AND open access[filter]", "retmode": "json", "retmax": most, "sort": "relevance"}
    dates = {"mindate": first, "maxdate": last, "datetype": date} if first and last else {}
    return SEARCH + "?" + urllib.parse.urlencode(terms | dates)


def search_ids(query: str, most: int = 100, first: str | None = None, last: str | None = None, opener: Opener = _open) -> list[str]:
    import json

    return json.loads(http_get(search_url(query, most, first, last), opener=opener))["esearchresult"]["idlist"]


def listing_url(bucket: str, prefix: str, token: str = "") -> str:
    asked = {"list-type": 2, "prefix": prefix, "delimiter": "/"} | ({"continuation-token": token} if token else {})
    return f"https://{bucket}.s3.amazonaws.com/?" + urllib.parse.urlencode(asked)


def list_prefixes(bucket: str, prefix: str, opener: Opener = _open) -> list[str]:
    """The folders below a prefix of a public bucket, of all pages of the listing."""
    found, token = [], ""
    while True:
        page = http_get(listing_url(bucket, prefix, token), opener=opener).decode()
        found += re.findall(r"<CommonPrefixes><Prefix>([^<]+)</Prefix>", page)
        more = re.search(r"<NextContinuationToken>([^<]+)<", page)
        if not more:
            return found
        token = html.unescape(more.group(1))


def latest_prefix(prefixes: list[str]) -> str | None:
    """The one with the largest number at its end."""
    numbered = [(int(m.group(1)), p) for p in prefixes if (m := re.search(r"\.(\d+)/?$", p))]
    return max(numbered)[1] if numbered else None
