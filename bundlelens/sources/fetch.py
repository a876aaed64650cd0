"""A data source that captures pages: each task fetches its share of a list of URLs.

    spark.dataSource.register(Capture)
    spark.read.format("capture").options(urls="https://a.test/ https://a.test/b", concurrency="6").load()

Rows are those of a network log. Failed requests are rows with an error; nothing is raised for them. Redirects are
followed by hand, so that every hop is a row; bodies beyond the cap are errors. Requests have a browser's headers for
documents, and a task's requests share a cookie jar.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime, timezone
from http.cookiejar import CookieJar
from urllib import error, request
from urllib.parse import urljoin, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bundlelens import rules

SCHEMA = "url string, status int, redirect_to string, content_type string, headers map<string,string>, body string, size long, time_ms long, started_at timestamp, error string"


def document_headers(url: str, referrer: str | None = None) -> dict[str, str]:
    """The headers of a browser that opens a document, in their order; after a redirect with where it came from."""
    _, accept, mode, dest, priority = next(r for r in rules.RESOURCE_TYPES if r[0] == "document")
    origin = lambda u: urlparse(u)[:2]
    site = "none" if referrer is None else "same-origin" if origin(referrer) == origin(url) else "cross-site"
    found = {
        "sec-ch-ua": rules.SEC_CH_UA, "sec-ch-ua-mobile": "?0", "sec-ch-ua-platform": rules.PLATFORM, "upgrade-insecure-requests": "1", "user-agent": rules.USER_AGENT, "accept": accept,
        "sec-fetch-site": site, "sec-fetch-mode": mode, "sec-fetch-user": "?1", "sec-fetch-dest": dest, "accept-language": rules.ACCEPT_LANGUAGE, "priority": priority,
    }
    return found


class Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _NoRedirect(request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = list(dict.fromkeys(options.get("urls", "").split()))
        if bad := [u for u in self.urls if urlparse(u).scheme not in ("http", "https")]:
            raise ValueError(f"no http(s) URLs: {bad}")
        self.concurrency = max(1, int(options.get("concurrency", 6)))
        self.retries = int(options.get("retries", 2))
        self.timeout = int(options.get("timeout_ms", options.get("timeoutms", 30_000))) / 1000
        self.most = int(options.get("max_bytes", options.get("maxbytes", 50 << 20)))

    def partitions(self) -> list[Part]:
        n = min(self.concurrency, max(1, len(self.urls)))
        return [Part(self.urls[i::n]) for i in range(n)]

    def read(self, partition: Part) -> Iterator[tuple]:
        opener = request.build_opener(_NoRedirect, request.HTTPCookieProcessor(CookieJar()))
        for url in partition.urls:
            referrer = None
            for _ in range(rules.MAX_REDIRECTS + 1):
                row = self.fetch(opener, url, referrer)
                yield row
                if row[2] is None:
                    break
                referrer, url = url, row[2]

    def fetch(self, opener, url: str, referrer: str | None = None) -> tuple:
        """One request, tried again after a wait where that may help."""
        for attempt in range(self.retries + 1):
            row = self.once(opener, url, referrer)
            if not (row[1] in rules.RETRYABLE or row[1] is None and row[9] != "too large") or attempt == self.retries:
                return row
            time.sleep(min(0.25 * 2**attempt, 4.0))
        raise AssertionError("a request is tried at least once")

    def once(self, opener, url: str, referrer: str | None = None) -> tuple:
        begun, at = time.monotonic(), datetime.now(timezone.utc)
        spent = lambda: int((time.monotonic() - begun) * 1000)
        asked = request.Request(url, headers=document_headers(url, referrer))
        try:
            with opener.open(asked, timeout=self.timeout) as r:
                return self.row(url, r, at, spent)
        except error.HTTPError as e:
            return self.row(url, e, at, spent)
        except (OSError, ValueError) as e:
            return (url, None, None, None, {}, None, 0, spent(), at, str(e) or type(e).__name__)

    def row(self, url: str, r, at: datetime, spent) -> tuple:
        headers = {k.lower(): v for k, v in r.headers.items()}
        data = r.read(self.most + 1)
        if len(data) > self.most:
            return (url, None, None, headers.get("content-type"), headers, None, len(data), spent(), at, "too large")
        to = urljoin(url, headers["location"]) if r.status in (301, 302, 303, 307, 308) and "location" in headers else None
        if to is not None and urlparse(to).scheme not in ("http", "https"):
            to = None
        return (url, r.status, to, headers.get("content-type"), headers, data.decode(r.headers.get_content_charset() or "utf-8", "replace"), len(data), spent(), at, f"HTTP {r.status}" if r.status >= 400 else None)


class Capture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
