"""A Python data source over paged JSON APIs: one input partition per query, read on the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The sweep that sources without a list of their own are asked for.
ROLE_QUERIES = ("data engineer", "analytics engineer", "data analyst", "data scientist", "machine learning engineer", "data platform")
ENVELOPES = ("jobs", "data", "results", "items", "hits")


def records(payload: object) -> list[dict]:
    """The records of a bare list or of a known envelope."""
    if isinstance(payload, list):
        return [r for r in payload if isinstance(r, dict)]
    if isinstance(payload, dict):
        return next((payload[k] for k in ENVELOPES if isinstance(payload.get(k), list)), [])
    return []


def get_text(url: str, tries: int = 3, timeout: float = 30.0) -> str | None:
    for left in range(tries - 1, -1, -1):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "tidemark"}), timeout=timeout) as r:
                return r.read().decode(r.headers.get_content_charset() or "utf-8")
        except urllib.error.URLError as e:
            # A client's error stays one, but for too many requests.
            if not left or isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429:
                raise
            time.sleep(2.0 ** (tries - left - 1))
    return None


def get_json(url: str, tries: int = 3, timeout: float = 30.0) -> object:
    return json.loads(get_text(url, tries, timeout) or "null")


@dataclass(frozen=True)
class Api:
    """How an API is asked: names of its parameters, fields that a record must have (any of alternatives by ``|``), and credentials it can't do without."""

    query: str = "q"
    page: str = "page"
    size: str = "limit"
    required: tuple[str, ...] = ()
    fixed: tuple[tuple[str, str], ...] = ()
    credentials: tuple[str, ...] = ()

    def complete(self, record: dict) -> bool:
        return all(any(record.get(f) for f in alternatives.split("|")) for alternatives in self.required)

    def parameters(self, given: dict[str, str]) -> dict[str, str]:
        """The parameters of every request; ValueError where a credential is missing."""
        missing = [c for c in self.credentials if not given.get(c)]
        if missing:
            raise ValueError(f"credentials are missing: {', '.join(missing)}")
        return dict(self.fixed) | {c: given[c] for c in self.credentials}


# The names of the APIs' own parameters and fields.
APIS = {
    "plain": Api(),
    "remoteok": Api(required=("id", "position|title", "url|apply_url")),
    "adzuna": Api(query="what", size="results_per_page", required=("id", "title", "redirect_url"), fixed=(("content-type", "application/json"),), credentials=("app_id", "app_key")),
}


def read_query(url: str, query: str | None, quota: int, page_size: int, get: Callable[[str], object] = get_json, api: Api = APIS["plain"], own: dict[str, str] | None = None) -> Iterator[dict]:
    """At most ``quota`` complete records of one query, each id once: pages by number, in the path at ``{page}`` or as a parameter, or by the next link that a payload names."""
    got, page, at, seen = 0, 1, url, set()
    while got < quota and at:
        asked = dict(own or {}) | {k: v for k, v in {api.query: query, api.page: page if "{page}" not in at else None, api.size: page_size}.items() if v is not None}
        payload = get(f"{at.replace('{page}', str(page))}{'&' if '?' in at else '?'}{urllib.parse.urlencode(asked)}" if at == url else at)
        found = records(payload)
        for r in found:
            if got == quota or not api.complete(r) or (r.get("id") is not None and r["id"] in seen):
                continue
            seen.add(r.get("id"))
            got += 1
            yield r
        link = (payload.get("links") or {}).get("next") if isinstance(payload, dict) else None
        at = link or (url if len(found) >= page_size and not (isinstance(payload, dict) and "links" in payload) else None)
        page += 1


def shares(limit: int, queries: int) -> list[int]:
    """How many records each query may bring, so that all together keep to the limit; the first ones one more where it doesn't divide."""
    return [limit // queries + (i < limit % queries) for i in range(queries)]


class _Query(InputPartition):
    def __init__(self, query: str | None, quota: int):
        self.query, self.quota = query, quota


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.limit, self.page, self.api = options["url"], int(options.get("limit", 200)), int(options.get("pagesize", 50)), APIS[options.get("api", "plain")]
        self.queries = [q for q in options.get("queries", "").split("|") if q] or (list(ROLE_QUERIES) if options.get("sweep") == "roles" else [None])
        self.own = self.api.parameters(options)

    def partitions(self) -> list[_Query]:
        return [_Query(q, n) for q, n in zip(self.queries, shares(self.limit, len(self.queries)), strict=True) if n]

    def read(self, partition: _Query) -> Iterator[tuple[str]]:
        for r in read_query(self.url, partition.query, partition.quota, self.page, api=self.api, own=self.own):
            yield (json.dumps(r),)


class JsonApi(DataSource):
    """spark.dataSource.register(JsonApi); spark.read.format("json_api").option("url", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
