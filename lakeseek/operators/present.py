"""What is done with results: date filter, export, live status, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import dates

#: Column names of the export: fixed values, as are the badge, label and status texts below.
EXPORT_COLUMNS = (
    "Date", "Portal", "Bid ID", "Client / Organization", "Bid Title", "Quantity", "EMD Amount", "Quoted Bid", "Delivery period",
    "Start date to submit bid", "End date to submit bid", "PDF Link",
)


def first_given(*columns: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def date_range(rows: DataFrame, start: Column, end: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Rows that don't start before first and don't end after last; what can't be read stays."""
    if first is not None:
        rows = rows.where(~F.coalesce(dates.starts_before(start, first), F.lit(False)))
    if last is not None:
        rows = rows.where(~F.coalesce(dates.ends_after(end, last), F.lit(False)))
    return rows


def first_of_bids(rows: DataFrame, position: str = "position") -> DataFrame:
    """Of rows(bid_id, position, ...) each bid's first by position; missing bid ids are one bid. Rows are sorted with all their columns, so those that don't decide are best joined afterwards."""
    first = F.row_number().over(Window.partitionBy(F.coalesce("bid_id", F.lit("N/A"))).orderBy(position))
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def export_columns(firsts: DataFrame, position: str = "position") -> DataFrame:
    """The export's columns, and position, of first_of_bids()."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = {
        "Date": text("date"),
        "Portal": F.coalesce("portal", F.lit("GeM")),
        "Bid ID": F.coalesce("bid_id", F.lit("N/A")),
        "Client / Organization": F.coalesce(first_given("client_organization"), text("organisation")),
        "Bid Title": text("bid_title"),
        "Quantity": text("quantity"),
        "EMD Amount": text("emd_amount"),
        "Quoted Bid": F.lit(""),
        "Delivery period": text("delivery_period"),
        "Start date to submit bid": F.coalesce(first_given("start_date_to_submit_bid"), text("published_date")),
        "End date to submit bid": text("end_date_to_submit_bid"),
        "PDF Link": F.coalesce(first_given("pdf_link"), text("pdf_path")),
    }
    return firsts.select(*[made[c].alias(c) for c in EXPORT_COLUMNS], F.col(position))


def export_rows(results: DataFrame, position: str = "position") -> DataFrame:
    """One row a bid, its first by position, with the export's columns; missing bid ids are one row N/A. position is kept."""
    return export_columns(first_of_bids(results, position), position)


def live_status(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """stored(bid_number, stored_end) against listing(bid_number, live_end_raw, b_is_inactive, position), first entry a number: live_end_date, extended, status, and by how many minutes it moved."""
    rank = F.row_number().over(Window.partitionBy("bid_number").orderBy("position"))
    first = listing.withColumn("_n", rank).where("_n = 1").select("bid_number", "live_end_raw", "b_is_inactive", F.lit(True).alias("_found"))
    joined = stored.join(first, "bid_number", "left").withColumns({"_live": dates.live_end(F.col("live_end_raw")), "_stored": dates.stored_end(F.col("stored_end"))})
    bad = F.col("live_end_raw").isNotNull() & F.col("_live").isNull()
    return joined.select(
        "bid_number",
        F.date_format("_live", "dd-MM-yyyy HH:mm:ss").alias("live_end_date"),
        dates.extended(F.col("_live"), F.col("_stored")).alias("extended"),
        F.when(F.col("_found").isNull(), "not_found").when(bad, "error: unreadable end date").otherwise("ok").alias("status"),
        F.when(~bad, F.col("b_is_inactive")).alias("b_is_inactive"),
        ((F.unix_timestamp(F.date_trunc("minute", "_live")) - F.unix_timestamp(F.date_trunc("minute", "_stored"))) / 60).cast("long").alias("moved_minutes"),
    )


def extension_label(extended: Column, status: Column) -> Column:
    return (
        F.when(extended, "YES").when(status == "not_found", "Closed (not extended)").when(~extended, "No").otherwise("Unknown (could not parse dates)")
    )


def match_badge(dense_rank: Column, lexical_rank: Column) -> Column:
    return (
        F.when(dense_rank <= 3, "High Match (Semantic)")
        .when(lexical_rank <= 3, "High Match (Lexical)")
        .when(dense_rank.isNotNull() | lexical_rank.isNotNull(), "Medium Match")
        .otherwise("Low Match")
    )


def eav_value() -> Column:
    """The first given of string_value, int_value, float_value and bool_value, as text; none: null."""
    return F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.when(F.col("bool_value").isNotNull(), (F.col("bool_value") != 0).cast("string")))


def eav_maps(rows: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, metadata map) of long rows (id, key, typed values); rows without a value are skipped; of repeated keys the largest value stays."""
    given = rows.withColumn("value", eav_value()).where("value is not null").groupBy(id_column, "key").agg(F.max("value").alias("value"))
    return given.groupBy(id_column).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))


def result_format(results: DataFrame) -> DataFrame:
    """The eight fields of a search result, score rounded to six places; fields that results lack are null."""
    names = ("chunk_id", "bid_id", "chunk_type", "bid_title", "score", "dense_rank", "lexical_rank", "text")
    have = lambda c: F.round("score", 6).alias(c) if c == "score" else F.col(c) if c in results.columns else F.lit(None).cast("string").alias(c)
    return results.select(*[have(c) for c in names])


def status_export(exported: DataFrame, status: DataFrame) -> DataFrame:
    """export_rows() with live end date, label and status of status(bid_number, live_end_date, extended, status); bids that weren't checked are unknown."""
    live = status.select(F.col("bid_number").alias("Bid ID"), F.col("live_end_date").alias("_end"), F.col("extended").alias("_extended"), F.col("status").alias("_status"))
    state = F.coalesce("_status", F.lit("unknown"))
    return exported.join(live, "Bid ID", "left").select(
        *exported.columns,
        F.coalesce("_end", F.lit("")).alias("Live End Date (GeM)"),
        extension_label(F.coalesce("_extended", F.lit(None).cast("boolean")), state).alias("Extended?"),
        state.alias("Live Status"),
    )


def display_dates(rows: DataFrame) -> DataFrame:
    """rows with start_label and end_label: the first given of the fields that may hold them, else N/A."""
    def shown(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in rows.columns], F.lit("N/A"))

    return rows.withColumns({"start_label": shown("published_date", "bid_start_date"), "end_label": shown("end_date_to_submit_bid", "bid_end_date")})


def find_files(bids: DataFrame, files: DataFrame) -> DataFrame:
    """(bid_id, path): each of bids(bid_id, pdf_path, pdf_link) with its file of files(path): the one it names, else one whose name has a digit group of at least five digits of the bid id, the last group first.

    Digit groups are keys of an equi-join, so a file is found by any run of digits in its name that equals the group; of several the first by name.
    """
    named = bids.select("bid_id", first_given("pdf_path", "pdf_link").alias("wanted"), F.reverse(F.filter(F.regexp_extract_all("bid_id", F.lit(r"\d+"), F.lit(0)), lambda d: F.length(d) >= 5)).alias("groups"))
    exact = named.join(files.select(F.col("path").alias("wanted"), F.col("path").alias("_exact")).distinct(), "wanted", "left")
    name = F.element_at(F.split("path", "/"), -1)
    by_digits = files.where(F.lower("path").endswith(".pdf")).select("path", F.explode(F.array_distinct(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)))).alias("digits")).groupBy("digits").agg(F.min("path").alias("path"))
    wanted = exact.where("_exact is null").select("bid_id", F.posexplode("groups").alias("at", "digits"))
    found = wanted.join(by_digits, "digits").groupBy("bid_id").agg(F.min(F.struct("at", "path"))["path"].alias("_found"))
    return exact.join(found, "bid_id", "left").select("bid_id", F.coalesce("_exact", "_found").alias("path"))
