"""A paged REST source as a Python data source, one partition for each date window."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, docket_id string, document_id string, text string, title string, submitter_first string, submitter_last string, organization string, city string, state_prov string, posted_date string, receive_date string, tracking_nbr string, withdrawn boolean"
ATTEMPTS, PAGE, PER_HOUR = 5, 250, 900
#: Rows a listing gives at most; for more a new one starts at the last date seen.
LISTED = 5_000


class Throttle:
    """At most `most` requests in any `window` seconds."""

    def __init__(self, most: int = PER_HOUR, window: float = 3600.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.window, self.clock, self.sleep = most, window, clock, sleep
        self.sent: deque[float] = deque()

    def wait(self) -> None:
        now = self.clock()
        while self.sent and now - self.sent[0] >= self.window:
            self.sent.popleft()
        if len(self.sent) >= self.most:
            self.sleep(self.window - (now - self.sent[0]))
            self.sent.popleft()
        self.sent.append(self.clock())


def fetch(url: str, open_url: Callable[[str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep) -> dict | None:
    """The JSON at url; busy servers are asked again after 2, 4, 8.. s, failing ones after 1, 2, 4.. s.

    None where the server says there is nothing of the kind; raises when every attempt failed.
    """

    def default(u: str) -> bytes:
        with urllib.request.urlopen(u, timeout=30) as r:  # noqa: S310
            return r.read()

    get = open_url or default
    last: Exception | None = None
    for attempt in range(ATTEMPTS):
        try:
            return json.loads(get(url))
        except urllib.error.HTTPError as e:
            last = e
            if e.code == 429:
                sleep(2.0 ** (attempt + 1))
            elif e.code >= 500:
                sleep(2.0**attempt)
            else:
                return None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last = e
            sleep(2.0**attempt)
    raise ConnectionError(f"{url}: no answer in {ATTEMPTS} attempts") from last


def flatten(item: dict) -> tuple:
    """A comment of the service as a row of SCHEMA; absent parts are null."""
    a = item.get("attributes") or {}
    where = a.get("address") or {}
    return (item.get("id"), a.get("docketId"), a.get("commentOnDocumentId"), a.get("comment"), a.get("title"), a.get("firstName"), a.get("lastName"), a.get("organization"), where.get("city"), where.get("stateProvinceRegion"), a.get("postedDate"), a.get("receiveDate"), a.get("trackingNbr"), bool(a.get("withdrawn")))


class Window_(InputPartition):
    def __init__(self, start: str, end: str):
        super().__init__((start, end))
        self.start, self.end = start, end


class CommentsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.docket = options["url"], options["docket"]
        days = [d for d in options.get("windows", "").split(",") if d]
        self.windows = list(zip(days, days[1:])) or [("", "")]
        self.per_hour = max(1, int(options.get("perhour", PER_HOUR)) // len(self.windows))
        self.most = int(options.get("maxcomments", 0)) or None
        self.detail = str(options.get("detail", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [Window_(a, b) for a, b in self.windows]

    def read(self, partition: Window_) -> Iterator[tuple]:
        """Pages of the window in order of posting; after LISTED rows a new listing from the last date on, its known rows left out."""
        throttle, start, seen, given = Throttle(self.per_hour), partition.start, set(), 0
        while True:
            last, news = start, False
            for page in range(1, LISTED // PAGE + 1):
                throttle.wait()
                got = fetch(f"{self.base}/comments?docket={self.docket}&from={start}&to={partition.end}&page={page}&size={PAGE}&sort=postedDate")
                if got is None and (seen or page > 1):
                    raise ConnectionError(f"page {page} of {self.docket} from {start} was refused: its rows would be missing")
                rows = (got or {}).get("data") or []
                for x in rows:
                    last = (x.get("attributes") or {}).get("postedDate") or last
                    if x.get("id") in seen:
                        continue
                    seen.add(x.get("id"))
                    news = True
                    if self.detail:
                        throttle.wait()
                        x = (fetch(f"{self.base}/comments/{x.get('id')}") or {}).get("data") or x
                    yield flatten(x)
                    given += 1
                    if given == self.most:
                        return
                if len(rows) < PAGE:
                    return
            if not news or last == start:
                raise ValueError(f"more than {LISTED} comments of {self.docket} at {last}: narrower windows are needed")
            start = last


DOCKET = "id string, title string, agency string, modified string"


class DocketReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.docket = options["url"], options["docket"]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        got = (fetch(f"{self.base}/dockets/{self.docket}") or {}).get("data")
        if got:
            a = got.get("attributes") or {}
            yield (got.get("id"), a.get("title"), a.get("agencyId"), a.get("modifyDate"))


class CommentsSource(DataSource):
    """spark.read.format("comments_api").option("url", ..).option("docket", ..).option("windows", "2031-01-01,2031-02-01,..").load()

    Window ends may be listed twice; dropDuplicates(["id"]) removes them. Options: maxcomments (of each
    window), perhour, detail (true: each comment is fetched by its id as well), kind (docket: the docket's
    own row in place of its comments).
    """

    @classmethod
    def name(cls) -> str:
        return "comments_api"

    def schema(self) -> str:
        return DOCKET if self.options.get("kind") == "docket" else SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocketReader(self.options) if self.options.get("kind") == "docket" else CommentsReader(self.options)
