"""Reading of URLs by executors: encrypted by default, public addresses only, bounded in size, time and redirects.

How a connection is made and a name resolved are parameters, so that tests and callers
with a proxy of their own bring theirs. Each hop of a redirect is checked like the first
URL, and the address that was checked is the one that is connected to.
"""

from __future__ import annotations

import hashlib
import ipaddress
import socket
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: (url, address, seconds, most bytes) -> (status, headers in lower case, body)
Opener = Callable[[str, str, float, int], tuple[int, dict[str, str], bytes]]


@dataclass(frozen=True)
class FetchPolicy:
    schemes: tuple[str, ...] = ("https",)
    hosts: tuple[str, ...] = ()  # none: any public host
    most_bytes: int = 25 << 20
    seconds: float = 10.0
    redirects: int = 5


def resolve(host: str) -> list[str]:
    return sorted({a[4][0] for a in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)})


def checked_address(url: str, policy: FetchPolicy, lookup: Callable[[str], list[str]] = resolve) -> str:
    """The address to connect to; raises for a URL that may not be read."""
    parts = urlsplit(url)
    if parts.scheme not in policy.schemes or not parts.hostname or parts.username is not None or parts.password is not None:
        raise ValueError("scheme, host or credentials are not allowed")
    if policy.hosts and not any(parts.hostname == h or h.startswith("*.") and parts.hostname.endswith(h[1:]) for h in policy.hosts):
        raise ValueError("the host is not on the list")
    found = [ipaddress.ip_address(a.split("%")[0]) for a in lookup(parts.hostname)]
    if not found or not all((getattr(a, "ipv4_mapped", None) or a).is_global for a in found):
        raise ValueError("the host has no address, or one that is not public")
    return str(found[0])


def open_plain(url: str, address: str, seconds: float, most: int) -> tuple[int, dict[str, str], bytes]:
    """A GET over http.client, connected to ``address`` under the URL's own name."""
    import http.client
    import ssl

    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    raw = socket.create_connection((address, port), seconds)
    if parts.scheme == "https":
        raw = ssl.create_default_context().wrap_socket(raw, server_hostname=parts.hostname)
    link = http.client.HTTPConnection(parts.hostname, port, timeout=seconds)
    link.sock = raw
    try:
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
        answer = link.getresponse()
        return answer.status, {k.lower(): v for k, v in answer.getheaders()}, answer.read(most + 1)
    finally:
        link.close()


def read_url(url: str, policy: FetchPolicy = FetchPolicy(), opener: Opener = open_plain, lookup: Callable[[str], list[str]] = resolve) -> tuple[bytes, str]:
    """(body, media type) of a URL."""
    for _ in range(policy.redirects + 1):
        status, headers, body = opener(url, checked_address(url, policy, lookup), policy.seconds, policy.most_bytes)
        if status in (301, 302, 303, 307, 308):
            url = urljoin(url, headers.get("location", ""))
            continue
        if status != 200:
            raise ValueError(f"status {status}")
        if len(body) > policy.most_bytes or int(headers.get("content-length", 0) or 0) > policy.most_bytes:
            raise ValueError("the body is too large")
        return body, headers.get("content-type", "").split(";")[0].strip().lower()
    raise ValueError("too many redirects")


def fetched(urls: DataFrame, policy: FetchPolicy = FetchPolicy(), opener: Opener = open_plain, lookup: Callable[[str], list[str]] = resolve) -> DataFrame:
    """(url) -> url, content, mime, content_sha256, error; a URL that can't be read is a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for url in frame["url"]:  # a row each: bodies are large
                try:
                    body, mime = read_url(url, policy, opener, lookup)
                    row = (url, body, mime, hashlib.sha256(body).hexdigest(), None)
                except (ValueError, OSError) as e:
                    row = (url, None, None, None, f"{type(e).__name__}: {e}")
                yield pd.DataFrame([row], columns=["url", "content", "mime", "content_sha256", "error"])

    return urls.select("url").mapInPandas(run, "url string, content binary, mime string, content_sha256 string, error string")
