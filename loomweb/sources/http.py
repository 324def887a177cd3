"""Pages over HTTP: a Python Data Source, and the same fetch over a DataFrame of URLs.

Both give requested_url, final_url, html and reason (null where html is there): a failure is a row.
Redirects are followed by hand, so that one that leaves the site is refused before it is asked for.
Requests are dealt out by host, since each host has a rate of its own.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomweb.functions import urls

SCHEMA = "requested_url string, final_url string, html string, reason string"


@dataclass(frozen=True)
class Policy:
    """How a page may be asked for."""

    same_site: bool = True
    redirects: int = 10
    attempts: int = 2
    delay: float = 1.5
    timeout: float = 15.0
    rate: float = 2.0
    agent: str = "Mozilla/5.0 (compatible; loomweb)"


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def site_of(url: str) -> str:
    host = (urlsplit(url).hostname or "").lower().strip(".")
    labels = host.split(".")
    if host.replace(".", "").isdigit() or ":" in host:
        return host
    return ".".join(labels[-3:] if ".".join(labels[-2:]) in urls.TWO_LABEL_SUFFIXES else labels[-2:])


def _once(opener, url: str, policy: Policy) -> tuple[str, str]:
    """final URL and body; raises for anything that isn't a page."""
    at, seen = url, set()
    for _ in range(policy.redirects + 1):
        if urlsplit(at).scheme not in ("http", "https") or (policy.same_site and site_of(at) != site_of(url)):
            raise ValueError("redirect leaves the site")
        if at in seen:
            raise ValueError("redirect loop")
        seen.add(at)
        try:
            with opener.open(urllib.request.Request(at, headers={"User-Agent": policy.agent}), timeout=policy.timeout) as answer:
                if "html" not in answer.headers.get("content-type", "").lower():
                    raise ValueError("not a page")
                return at, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code not in (301, 302, 303, 307, 308) or not error.headers.get("location"):
                raise
            at = urljoin(at, error.headers["location"])
    raise ValueError("too many redirects")


def fetch(url: str, policy: Policy, opener=None) -> tuple[str, str | None, str | None, str | None]:
    """A row.  Transport errors and 5xx answers are tried again after a growing delay, others aren't."""
    opener = opener or urllib.request.build_opener(_NoRedirect)
    reason = ""
    for attempt in range(policy.attempts):
        if attempt:
            time.sleep(policy.delay * 2 ** (attempt - 1))
        try:
            final, body = _once(opener, url, policy)
            return url, final, body, None
        except urllib.error.HTTPError as error:
            reason = f"HTTP {error.code}"
            if error.code < 500:
                break
        except ValueError as error:
            reason = str(error)
            break
        except OSError as error:
            reason = "timeout" if "timed out" in str(error) else type(error).__name__
    return url, None, None, reason


def fetch_all(addresses: list[str], policy: Policy) -> Iterator[tuple]:
    """Rows in order; requests to one host keep its rate."""
    opener, ready = urllib.request.build_opener(_NoRedirect), defaultdict(float)
    for url in addresses:
        host = urlsplit(url).netloc.lower()
        time.sleep(max(0.0, ready[host] - time.monotonic()))
        ready[host] = time.monotonic() + (1 / policy.rate if policy.rate > 0 else 0)
        yield fetch(url, policy, opener)


def fetched(frontier: DataFrame, policy: Policy = Policy(), partitions: int | None = None) -> DataFrame:
    """frontier: url.  A row for each distinct URL."""
    given = asdict(policy)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(fetch_all(batch["url"].tolist(), Policy(**given)), columns=["requested_url", "final_url", "html", "reason"])

    rows = frontier.select("url").distinct().withColumn("host", urls.host(F.col("url")))
    rows = rows.repartition(partitions, "host") if partitions else rows.repartition("host")
    return rows.select("url").mapInPandas(run, SCHEMA)


def accepted(rows: DataFrame) -> DataFrame:
    """url, html of the pages that came; the first of those that ended at one address."""
    good = rows.filter(F.col("html").isNotNull()).withColumn("norm_url", urls.normalize(F.col("final_url")))
    return good.groupBy("norm_url").agg(F.min_by(F.struct(F.col("final_url").alias("url"), "html"), "requested_url").alias("p")).select("p.*")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("html").isNull()).select(F.col("requested_url").alias("url"), "reason")


@dataclass
class HostPartition(InputPartition):
    addresses: list


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.addresses = json.loads(options.get("urls", "[]"))
        kinds = {k: type(v) for k, v in asdict(Policy()).items()}
        given = {k: options[k] for k in kinds if k in options}
        self.policy = {k: (v.lower() == "true" if kinds[k] is bool else kinds[k](v)) for k, v in given.items()}

    def partitions(self):
        by_host: dict[str, list[str]] = defaultdict(list)
        for url in dict.fromkeys(self.addresses):
            by_host[urlsplit(url).netloc.lower()].append(url)
        return [HostPartition(found) for found in by_host.values()]

    def read(self, partition):
        yield from fetch_all(partition.addresses, Policy(**self.policy))


class PageSource(DataSource):
    """``spark.dataSource.register(PageSource)``, then ``spark.read.format("loomweb_pages").option("urls", json)``.

    Options: urls, and each field of Policy.
    """

    @classmethod
    def name(cls):
        return "loomweb_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PageReader(self.options)
