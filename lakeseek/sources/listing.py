"""The portal's listing: a Python data source over a page fetcher, and its JSON pages."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "page long, position long, b_id long, b_bid_number string, b_id_parent long, b_bid_number_parent string, final_end_date_sort string, b_is_inactive int"
RETRIES, WAIT_S, KNOWN_PAGES = 2, 3.0, 3


def with_retry(fetch: Callable[[int], list[dict]], page: int, retries: int = RETRIES, wait: float = WAIT_S, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """A page, tried again after waits that grow; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return fetch(page)
        except Exception:
            if attempt == retries:
                raise
            sleep(wait * (attempt + 1))
    return []


class _Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


def count_pages(fetch: Callable[[int], list[dict]]) -> int:
    """Number of pages before the first empty one: doubling, then halving, so a listing of n pages takes some 2 log2(n) fetches."""
    if not with_retry(fetch, 0):
        return 0
    full, empty = 0, 1
    while with_retry(fetch, empty):
        full, empty = empty, empty * 2
    while empty - full > 1:
        middle = (full + empty) // 2
        full, empty = (middle, empty) if with_retry(fetch, middle) else (full, middle)
    return empty


def with_token(home: Callable[[], str], pattern: str, fetch: Callable[[str, int], list[dict]]) -> Callable[[int], list[dict]]:
    """fetch(token, page) as a fetcher of pages: the token is the pattern's group in home(), looked up once a process and again after a failure. No token: ValueError."""
    held: dict[str, str] = {}

    def page_of(page: int) -> list[dict]:
        if "token" not in held:
            found = re.search(pattern, home())
            if found is None:
                raise ValueError("the listing page has no token")
            held["token"] = found[1]
        try:
            return fetch(held["token"], page)
        except Exception:
            held.clear()
            raise

    return page_of


class _Numbers(InputPartition):
    def __init__(self, numbers: list[str]) -> None:
        super().__init__(numbers)
        self.numbers = numbers


class ListingReader(DataSourceReader):
    """Pages to the end, or up to the option ``pages``; with the option ``bidNumbers`` these numbers, separated by commas, by a request each and no page."""

    def __init__(self, options: dict[str, str], fetch: Callable[[int], list[dict]], lookup: Callable[[str], list[dict]] | None = None) -> None:
        self.pages, self.per_task, self.fetch, self.lookup = options.get("pages"), int(options.get("pagesPerTask", "10")), fetch, lookup
        # Asked for by an option and not by a filter: a pushed filter would stay with the source for later reads of the same DataFrame.
        numbers = options.get("bidNumbers")
        self.numbers = None if numbers is None else list(dict.fromkeys(n.strip() for n in numbers.split(",") if n.strip()))
        if self.numbers is not None and lookup is None:
            raise ValueError("this listing can't look up bid numbers")

    def partitions(self) -> list[InputPartition]:
        if self.numbers is not None:
            return [_Numbers(self.numbers[i : i + self.per_task]) for i in range(0, len(self.numbers), self.per_task)]
        pages = count_pages(self.fetch) if self.pages is None else int(self.pages)
        return [_Pages(p, min(p + self.per_task, pages)) for p in range(0, pages, self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if isinstance(partition, _Numbers):
            for number in partition.numbers:
                yield from (row for row in rows_of(0, with_retry(lambda _, n=number: self.lookup(n), 0)) if row[3] == number)
            return
        for page in range(partition.first, partition.last):
            docs = with_retry(self.fetch, page)
            yield from rows_of(page, docs)
            if not docs:
                return


class ListingStream(SimpleDataSourceStreamReader):
    """New entries of a listing that has the newest first. The offset is the largest entry id seen; a micro-batch reads pages until KNOWN_PAGES in a row have nothing above it."""

    def __init__(self, fetch: Callable[[int], list[dict]]) -> None:
        self.fetch = fetch

    def initialOffset(self) -> dict:
        return {"newest": -1}

    def _above(self, newest: int) -> list[tuple]:
        rows, known, page = [], 0, 0
        while known < KNOWN_PAGES:
            docs = with_retry(self.fetch, page)
            if not docs:
                break
            new = [row for row in rows_of(page, docs) if row[2] is not None and row[2] > newest]
            rows, known, page = rows + new, 0 if new else known + 1, page + 1
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._above(start["newest"])
        return iter(rows), {"newest": max([start["newest"], *(row[2] for row in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same entries again, after a failure; later ones wait for the next batch."""
        return iter([row for row in self._above(start["newest"]) if row[2] <= end["newest"]])

    def commit(self, end: dict) -> None:
        pass


def rows_of(page: int, docs: list[dict]) -> Iterator[tuple]:
    """A page's entries as rows of SCHEMA: the first element of each array."""
    names = ("b_id", "b_bid_number", "b_id_parent", "b_bid_number_parent", "final_end_date_sort", "b_is_inactive")
    for i, doc in enumerate(docs):
        yield (page, i, *((doc.get(n) or [None])[0] for n in names))


def lookup_bids(numbers: DataFrame, lookup: Callable[[str], list[dict]], tasks: int = 5) -> DataFrame:
    """Listing rows of numbers(bid_number), each asked for once; lookup(number) gives the entries found, of which those with that very number stay. At most ``tasks`` requests run at once."""
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [row for number in batch["bid_number"] for row in rows_of(0, with_retry(lambda _, n=number: lookup(n), 0)) if row[names.index("b_bid_number")] == number]
            yield pd.DataFrame(found, columns=names, dtype=object)

    return numbers.where("bid_number is not null").select("bid_number").distinct().repartition(tasks).mapInPandas(ask, SCHEMA)


def listing_source(fetch: Callable[[int], list[dict]], name: str = "listing", lookup: Callable[[str], list[dict]] | None = None) -> type[DataSource]:
    """A data source class to register, for reads and streams; fetch(page) gives the page's entries, lookup(number) those of a bid number; both must be picklable. Options: pages (all without), pagesPerTask, bidNumbers."""

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> ListingReader:
            return ListingReader(self.options, fetch, lookup)

        def simpleStreamReader(self, schema) -> ListingStream:
            return ListingStream(fetch)

    return Listing


def first_of(doc: str = "doc") -> list[Column]:
    """The one element of each array field of a raw entry."""
    names = ("b_id", "b_bid_number", "b_id_parent", "b_bid_number_parent", "final_end_date_sort", "b_is_inactive")
    return [F.get(f"{doc}.{n}", F.lit(0)).alias(n) for n in names]


def candidates(entries: DataFrame) -> DataFrame:
    """(page, position, bid_id, bid_number): reverse auctions stand for their parent and are skipped without one."""
    auction = F.contains(F.coalesce("b_bid_number", F.lit("")), F.lit("/R/"))
    rows = entries.where(~auction | F.col("b_id_parent").isNotNull())
    return rows.select(
        "page",
        "position",
        F.when(auction, F.col("b_id_parent")).otherwise(F.col("b_id")).cast("long").alias("bid_id"),
        F.when(auction, F.coalesce("b_bid_number_parent", F.lit(""))).otherwise(F.coalesce("b_bid_number", F.lit(""))).alias("bid_number"),
    )


def until_known(found: DataFrame, known: DataFrame, pages: int = KNOWN_PAGES, full_sync: bool = False) -> DataFrame:
    """Candidates up to the page that completes a run of all-known pages; pages without candidates neither break nor lengthen a run. The window runs over one row a page. With full_sync all candidates."""
    if full_sync:
        return found
    marked = found.join(known.select("bid_id").distinct().withColumn("_known", F.lit(True)), "bid_id", "left")
    per_page = marked.groupBy("page").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("all_known"))
    run = F.sum(F.col("all_known").cast("int")).over(Window.orderBy("page").rowsBetween(-(pages - 1), 0))
    stop = per_page.withColumn("run", run).where(F.col("run") == pages).agg(F.min("page").alias("stop"))
    return found.crossJoin(F.broadcast(stop)).where("stop is null or page <= stop").drop("stop")


def to_download(found: DataFrame, known: DataFrame, cap: int | None = None) -> DataFrame:
    """(bid_id, bid_number, page, position) of candidates that aren't known, each id once at its first place; the first ``cap`` in listing order if a cap is set (0: none)."""
    first = found.groupBy("bid_id").agg(F.min(F.struct("page", "position", "bid_number")).alias("x")).select("bid_id", "x.bid_number", "x.page", "x.position")
    new = first.join(known.select("bid_id").distinct(), "bid_id", "left_anti")
    return new.orderBy("page", "position").limit(cap) if cap else new
