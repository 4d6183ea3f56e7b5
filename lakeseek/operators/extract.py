"""Documents to metadata, clauses and retrieval chunks; native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeseek.functions import fields
from lakeseek.functions.text import lines, plain_number, trimmed

#: Marks around the clauses, in order of preference, and the heading pattern: fixed values.
CLAUSES_FROM = ("Buyer Added Bid Specific Terms and Conditions", "Buyer Added Bid Specific ATC")
CLAUSES_TO = ("Disclaimer", "Thank You")
HEADING = r"^\s*(\d+)\.\s*([A-Z][a-zA-Z\s\-\(\)/&]+)(?::|$)$"
CHUNK_ORDER = ("overview", "eligibility_financial", "scope_of_work", "atc_clause", "preference_policy")


def metadata(docs: DataFrame, base_url: str = "", now: Column | None = None) -> DataFrame:
    """One row per docs(path, text[, internal_id, download_date, downloaded_at, document_hash of the file's bytes]): the metadata record, with text and lines kept for the chunk builders."""
    for name, kind in (("internal_id", "long"), ("download_date", "string"), ("downloaded_at", "string"), ("document_hash", "string")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX") if now is None else now
    docs = docs.withColumn("_lines", lines(F.coalesce("text", F.lit("")))).withColumn("bid_id", fields.bid_id(F.col("text"), F.col("path")))
    # Used more than once each, so made in a step before.
    x = F.col("_lines")
    docs = docs.select(
        "*",
        fields.joined(x).alias("lines"),
        fields.after_last(x, fields.MINISTRY).alias("_ministry"),
        fields.after_last(x, fields.ORGANISATION, (fields.MINISTRY, fields.DEPARTMENT)).alias("_organisation"),
        fields.after_last(x, fields.DEPARTMENT, (fields.MINISTRY,)).alias("_department"),
    )
    organisation, department, x = F.col("_organisation"), F.col("_department"), F.col("lines")
    return docs.select(
        "bid_id",
        F.lit("GeM").alias("portal"),
        F.coalesce("download_date", now).alias("date"),
        F.coalesce("downloaded_at", "download_date", now).alias("added_at"),
        F.coalesce(F.nullif(organisation, F.lit("")), department).alias("client_organization"),
        F.col("_ministry").alias("ministry"),
        organisation.alias("organisation"),
        fields.category(x).alias("bid_title"),
        fields.quantity(x).alias("quantity"),
        fields.emd(x)["amount"].alias("emd_amount"),
        F.lit(None).cast("string").alias("delivery_period"),
        fields.date_time(x, fields.BID_START).alias("start_date_to_submit_bid"),
        fields.date_time(x, fields.BID_END).alias("end_date_to_submit_bid"),
        fields.link(F.col("bid_id"), F.col("internal_id"), F.col("path"), base_url).alias("pdf_link"),
        fields.published_date(F.col("text")).alias("published_date"),
        F.coalesce("document_hash", F.md5(F.col("text"))).alias("document_hash"),
        F.col("path").alias("pdf_path"),
        "text",
        "lines",
    )


def clause_arrays(docs: DataFrame) -> DataFrame:
    """docs(text, ...) with _clauses: an array of structs (clause_no, heading, body, pos), made inside the row, so nothing is exploded, shuffled or joined.

    Lines after a heading belong to it, lines before the first are dropped, clauses with an empty body too.
    """
    text = F.col("text")
    start = F.coalesce(*[F.when(F.instr(text, m) > 0, F.instr(text, m) + len(m)) for m in CLAUSES_FROM])
    tail = docs.select("*", F.substr(text, start, F.length(text)).alias("_tail"))
    end = F.coalesce(*[F.when(F.instr("_tail", m) > 0, F.instr("_tail", m) - 1) for m in CLAUSES_TO], F.length("_tail"))
    part = tail.select("*", F.split(F.coalesce(F.substr("_tail", F.lit(1), end), F.lit("")), "\n").alias("_part")).drop("_tail")
    # Each step is a column of its own: no lambda evaluates the one before again.
    bare = part.select("*", F.transform("_part", trimmed).alias("_bare"))
    heads = bare.select("*", F.filter(F.transform("_bare", lambda line, i: F.when(line.rlike(HEADING), i)), lambda i: i.isNotNull()).alias("_heads"))

    def clause(at: Column, nth: Column) -> Column:
        line, until = F.get("_bare", at), F.coalesce(F.get("_heads", nth + 1), F.size("_part"))
        return F.struct(
            fields.found(line, HEADING, 1).try_cast("long").alias("clause_no"),
            trimmed(F.regexp_extract(line, HEADING, 2)).alias("heading"),
            trimmed(F.array_join(F.slice("_part", at + 2, until - at - 1), "\n")).alias("body"),
            at.alias("pos"),
        )

    return heads.select("*", F.filter(F.transform("_heads", clause), lambda c: c["body"] != "").alias("_clauses")).drop("_part", "_bare", "_heads")


def clauses(docs: DataFrame, key: str) -> DataFrame:
    """(key, clause_no, heading, body, pos), a row a clause; key is only carried along: rows with equal keys aren't mixed."""
    return _inlined(clause_arrays(docs.select(key, "text")), "_clauses", "pos", key)


def _inlined(rows: DataFrame, column: str, given: str, *kept: str) -> DataFrame:
    """A row for each struct of an array. Outer, and filtered afterwards: from a plain generator the optimiser infers a filter that makes the array a second time, below."""
    return rows.select(*kept, F.inline_outer(column)).where(F.col(given).isNotNull())


def _sentence(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _given(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def _some(c: Column) -> Column:
    """Neither null nor 0."""
    return F.coalesce(c != 0, F.lit(False))


#: The sentences of the chunk builders below are fixed values: they have to read as written.
def overview(m: DataFrame) -> Column:
    org, ministry = m["client_organization"], m["ministry"]
    return F.concat_ws(
        " ",
        _sentence(_given(m["bid_title"]), "Procurement of ", m["bid_title"], "."),
        _sentence(_given(org), "Required by ", org, F.when(_given(ministry), F.concat(F.lit(" ("), ministry, F.lit(")"))).otherwise(""), "."),
        _sentence(_some(m["quantity"]), "Quantity: ", m["quantity"], "."),
        _sentence(_some(m["emd_amount"]), "EMD Amount: ", plain_number(m["emd_amount"]), "."),
        _sentence(_given(m["end_date_to_submit_bid"]), "Bid closes: ", m["end_date_to_submit_bid"], "."),
    )


def with_conditions(docs: DataFrame) -> DataFrame:
    """Columns for the financial and preference fields of docs(text, lines, ...): made once here, as the chunk builders use each several times.

    None is a struct made by struct(): the optimiser would put its parts wherever they are used, and search for them again each time.
    """
    x = F.col("lines")
    own, oem, local = fields.turnover(x, fields.TURNOVER), fields.turnover(x, fields.OEM_TURNOVER), fields.local_content(F.col("text"))
    return docs.select(
        "*",
        own["value"].alias("_own_value"),
        own["unit"].alias("_own_unit"),
        oem["value"].alias("_oem_value"),
        oem["unit"].alias("_oem_unit"),
        fields.experience_years(x).alias("_years"),
        fields.past_performance(x).alias("_past"),
        fields.emd(x).alias("_emd"),
        fields.epbg(x).alias("_epbg"),
        local["class1"].alias("_class1"),
        local["class2"].alias("_class2"),
        fields.preference(x, fields.MII).alias("_mii"),
        fields.percentage(x, fields.MII_BAND).alias("_mii_band"),
        fields.percentage(x, fields.MII_SHARE).alias("_mii_share"),
        fields.preference(x, fields.MSE).alias("_mse"),
        fields.percentage(x, fields.MSE_BAND).alias("_mse_band"),
        fields.percentage(x, fields.MSE_SHARE).alias("_mse_share"),
    )


def eligibility() -> Column:
    """Financial conditions, from the columns of with_conditions()."""
    own, oem, years, past, emd, epbg = (F.col(c) for c in ("_own_value", "_oem_value", "_years", "_past", "_emd", "_epbg"))
    return F.concat_ws(
        " ",
        _sentence(_some(own), "Minimum average annual turnover required: ", plain_number(own), " ", F.col("_own_unit"), "."),
        _sentence(_some(oem), "OEM average turnover required: ", plain_number(oem), " ", F.col("_oem_unit"), "."),
        _sentence(_some(years), "Past experience required: ", years, " years."),
        _sentence(past.isNotNull(), "Past performance requirement: ", past, "%."),
        _sentence(_some(emd["amount"]), "EMD amount: ", plain_number(emd["amount"]), F.when(_given(emd["bank"]), F.concat(F.lit(", advisory bank "), emd["bank"], F.lit("."))).otherwise(".")),
        _sentence(epbg["required"] & _some(epbg["percent"]), "ePBG required: ", plain_number(epbg["percent"]), "% for ", F.coalesce(epbg["months"].cast("string"), F.lit("None")), " months."),
    )


def preference_policy() -> Column:
    """Purchase preferences, from the columns of with_conditions(); empty unless one of the six numbers is there and not 0."""
    one, two = F.col("_class1"), F.col("_class2")

    def applies(name: str) -> Column:
        wanted, band, share = (F.col(f"_{name.lower()}{c}") for c in ("", "_band", "_share"))
        tail = F.when(_some(share), F.concat(F.lit("%, max "), share.cast("string"), F.lit("% of quantity."))).otherwise("%.")
        return _sentence(wanted & _some(band), f"{name} purchase preference applies up to L1+", band, tail)

    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    text_ = F.concat_ws(
        " ",
        _sentence(_some(one) | _some(two), "Local content requirement: minimum ", shown(one), "% (Class I) / ", shown(two), "% (Class II)."),
        applies("MII"),
        applies("MSE"),
    )
    some = _some(one) | _some(two)
    for c in ("_mii_band", "_mii_share", "_mse_band", "_mse_share"):
        some = some | _some(F.col(c))
    return F.when(some, text_).otherwise("")


def chunk_arrays(meta: DataFrame) -> DataFrame:
    """metadata() rows with _chunks: an array of structs (chunk_id, chunk_type, text, clause_no, position), made inside the row; empty chunks are left out.

    Restarting clause numbers would repeat a chunk_id: the last one in the text stays.
    """
    rows = clause_arrays(with_conditions(meta))
    number = F.lit(None).cast("long")
    built = F.array(
        *[
            F.struct(F.concat_ws("::", "bid_id", F.lit(kind)).alias("chunk_id"), F.lit(kind).alias("chunk_type"), made.alias("text"), number.alias("clause_no"), F.lit(CHUNK_ORDER.index(kind)).alias("position"))
            for kind, made in (
                ("overview", overview(meta)),
                ("eligibility_financial", eligibility()),
                ("scope_of_work", F.coalesce("bid_title", F.lit(""))),
                ("preference_policy", preference_policy()),
            )
        ]
    )
    rows = rows.select("*", F.transform("_clauses", lambda c: c["clause_no"]).alias("_numbers"), built.alias("_built"))
    last = F.filter("_clauses", lambda c, i: ~F.exists(F.slice("_numbers", i + 2, F.size("_numbers")), lambda n: n.eqNullSafe(c["clause_no"])))
    parts = F.transform(
        last,
        lambda c: F.struct(
            F.concat_ws("::", "bid_id", F.lit("atc_clause"), c["clause_no"].cast("string")).alias("chunk_id"),
            F.lit("atc_clause").alias("chunk_type"),
            F.concat_ws(": ", c["heading"], c["body"]).alias("text"),
            c["clause_no"].alias("clause_no"),
            F.lit(CHUNK_ORDER.index("atc_clause")).alias("position"),
        ),
    )
    whole = F.filter("_built", lambda c: c["text"] != "")
    return rows.select(*meta.columns, F.concat(whole, parts).alias("_chunks"))


def chunks(meta: DataFrame) -> DataFrame:
    """(chunk_id, bid_id, chunk_type, text, clause_no, position[, pdf_path]) of metadata() rows, one document's after the other; documents of one bid aren't mixed, last_documents() chooses among them."""
    kept = [c for c in ("bid_id", "pdf_path") if c in meta.columns]
    made = _inlined(chunk_arrays(meta), "_chunks", "position", *kept)
    return made.select("chunk_id", "bid_id", "chunk_type", "text", "clause_no", "position", *kept[1:])


def last_documents(meta: DataFrame) -> DataFrame:
    """One row a bid: the document whose path comes last stays as a whole."""
    from lakeseek.operators.changes import last_by

    return last_by(meta, "bid_id", F.col("pdf_path"))
