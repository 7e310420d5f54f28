"""Pages over HTTP: robots.txt, pacing for each host, retries and errors as data.

A host's pages are fetched by one task, one after another, so that the pace holds for the host however many executors there are.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import urls as U
from corpusmill.session import ship
from corpusmill.settings import Settings

ATTEMPTS = 3
FETCHED = "url string, html string, error string"
DISALLOWED = "robots.txt doesn't allow"


class FetchError(RuntimeError):
    pass


class Pacer:
    """At least ``delay`` seconds between the starts of two requests."""

    def __init__(self, delay: float, clock=time.monotonic, sleep=time.sleep):
        self.delay, self.clock, self.sleep, self.last = delay, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (left := self.delay - (self.clock() - self.last)) > 0:
            self.sleep(left)
        self.last = self.clock()


class Client:
    """Pages of one site. robots.txt is read before the first page; if it can't be, no page is fetched."""

    def __init__(self, site: str, agent: str, delay: float, timeout: float, sleep=time.sleep):
        self.site, self.agent, self.timeout, self.sleep = site.rstrip("/"), agent, timeout, sleep
        self.pacer = Pacer(delay, sleep=sleep)
        self.rules: urllib.robotparser.RobotFileParser | None = None

    def _get(self, url: str) -> str:
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, "Accept": "text/html,application/xml"})
        problem = None
        for attempt in range(ATTEMPTS):
            self.pacer.wait()
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as got:
                    return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace")
            except urllib.error.HTTPError as e:
                problem = f"{e.code} {e.reason}"
            except (urllib.error.URLError, OSError, ValueError) as e:
                problem = str(e)
            if attempt < ATTEMPTS - 1:
                self.sleep(2**attempt)
        raise FetchError(f"http {problem} for {url}")

    def page(self, url: str) -> str:
        if self.rules is None:
            self.rules = parsed_rules(self._get(f"{self.site}/robots.txt"))
        if not self.rules.can_fetch(self.agent, url):
            raise FetchError(f"http {DISALLOWED} {url}")
        return self._get(url)


def parsed_rules(text: str) -> urllib.robotparser.RobotFileParser:
    """Groups of agents and their rules, as the standard library reads them."""
    rules = urllib.robotparser.RobotFileParser()
    rules.parse(text.splitlines())
    return rules


def robots_allowed(pages: DataFrame, robots: dict[str, str], agent: str, otherwise: str = "") -> DataFrame:
    """``pages`` (url, any more) with ``allowed``, by the text of robots.txt for each host; other hosts have the text ``otherwise``."""
    ship(pages.sparkSession)

    @F.pandas_udf("boolean")
    def allowed(found: pd.Series) -> pd.Series:
        rules, rest = {host: parsed_rules(text) for host, text in robots.items()}, parsed_rules(otherwise)
        return pd.Series([u is not None and rules.get(urlsplit(u).netloc, rest).can_fetch(agent, u) for u in found])

    return pages.withColumn("allowed", allowed("url"))


def fetch_pages(pages: DataFrame, settings: Settings, agent: str = "corpusmill") -> DataFrame:
    """(url, html, error) for each of ``pages`` (url): the page, or why there is none. Hosts are dealt to tasks whole."""
    ship(pages.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients: dict[str, Client] = {}
        for f in frames:
            for url in f["url"]:
                parts = urlsplit(url)
                site = f"{parts.scheme}://{parts.netloc}"
                client = clients.setdefault(site, Client(site, agent, settings.delay_seconds, settings.timeout_seconds))
                try:
                    row = (url, client.page(url), None)
                except FetchError as e:
                    row = (url, None, str(e))
                yield pd.DataFrame([row], columns=["url", "html", "error"])

    return pages.select("url").where("url IS NOT NULL").repartition(U.host(F.col("url"))).mapInPandas(run, FETCHED)
