"""Polite HTTP scans: one task a lane of a host, a pause between requests, retries. The client is injected."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.config import EnrichConfig
from docmill.functions.urls import netloc
from docmill.models import Fetcher, HttpFetcher
from docmill.operators.enrich import has_paywall

#: Statuses after which a request is tried again.
RETRY_STATUS = (429, 500, 502, 503, 504)


def fetch_one(client: Fetcher, url: str, timeout: float = 20, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, bytes]:
    """(status, final address, body) of the first request or of one of so many ``retries``, after a timeout or a status that asks for one. Waits grow by half each time.

    A timeout of the last attempt is 408. Another failure of the network is 0 and isn't tried again.
    """
    wait, last = 1.0, (0, url, b"")
    for k in range(max(0, retries) + 1):
        try:
            last = client.get(url, timeout)
            if last[0] not in RETRY_STATUS:
                return last
        except TimeoutError:
            last = (408, url, b"")
        except Exception:  # noqa: BLE001  any other failure of the network is status 0
            return 0, url, b""
        if k < retries:
            sleep(wait)
            wait *= 1.5
    return last


def get_simple(client: Fetcher, url: str, timeout: float = 15, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """The body of a 2xx answer; 5xx and failures are tried again after 1, 2, 4 seconds; anything else is None."""
    for k in range(attempts):
        try:
            status, _, body = client.get(url, timeout)
            if 200 <= status < 300:
                return body
            if status < 500:
                return None
        except Exception:  # noqa: BLE001
            pass
        if k + 1 < attempts:
            sleep(2.0**k)
    return None


def fetched(urls: DataFrame, client: Fetcher, qps: float = 0.5, timeout: float = 20, retries: int = 3, respect_paywalls: bool = True, lanes: int = 1, tasks: int = 4, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> DataFrame:
    """``schemas.FETCHES`` for each distinct url. All addresses of a lane of a host go to one task, which keeps ``lanes`` / ``qps`` seconds between its
    requests, so that at most ``lanes`` requests to a host are open at once and ``qps`` begin each second.

    Politeness makes a host sequential by intent. Hosts are dealt to ``tasks`` partitions, as many requests as are open at once at most; a number that is given isn't
    merged by Spark afterwards. Streams row by row, so a large host needs no memory.
    """
    least = lanes / qps if qps > 0 else 0.0

    def scan(batches):
        last: dict[tuple[str, int], float] = {}
        for pdf in batches:
            rows = []
            for url, host in zip(pdf["url"], zip(pdf["host"], pdf["lane"], strict=True), strict=True):
                rest = last.get(host, -least) + least - clock()
                if rest > 0:
                    sleep(rest)
                last[host] = clock()
                status, final, body = fetch_one(client, url, timeout, retries, sleep)
                rows.append((url, status, final, body))
            yield pd.DataFrame(rows, columns=["url", "status_code", "final_url", "html"])

    hosts = urls.select("url").where("url is not null").distinct().withColumn("host", netloc(F.col("url"))).withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)))
    hosts = hosts.repartition(max(1, tasks), "host", "lane").sortWithinPartitions("host", "lane", "url")
    out = hosts.mapInPandas(scan, "url string, status_code int, final_url string, html binary")
    wall = has_paywall(F.decode("html", "UTF-8"), F.col("status_code")) if respect_paywalls else F.lit(False)
    return out.withColumn("paywall_detected", wall)


def fetched_by(urls: DataFrame, config: EnrichConfig = EnrichConfig(), client: Fetcher | None = None) -> DataFrame:
    """:func:`fetched` as the settings say, with the standard library's client unless another is given."""
    client = client or HttpFetcher(config.user_agent, config.follow_redirects)
    return fetched(urls, client, config.per_domain_qps, config.http_timeout_sec, config.http_max_retries, config.respect_paywalls, config.per_domain_concurrency, config.global_concurrency)
