"""Companies and filings: from column-wise submissions to a manifest, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import relational as R

FOREIGN_FORMS = ("20-F", "40-F", "6-K")
QUOTAS = {"10-K": 2, "10-Q": 6}


def companies(universe: DataFrame, ciks: DataFrame, snapshot: str) -> DataFrame:
    """Listed companies with their registrant number: by ticker, else with `.` as `-`; none: dropped; the first ticker of each number stays.

    universe(pos, company, ticker), ciks(ticker, cik).
    """
    upper = lambda c: F.upper(F.trim(c))
    known = ciks.select(upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("_cik"))
    rows = universe.withColumn("ticker", upper("ticker"))
    rows = rows.join(known.select(F.col("_t").alias("ticker"), F.col("_cik").alias("_a")), "ticker", "left")
    rows = rows.withColumn("_alt", F.replace("ticker", F.lit("."), F.lit("-"))).join(known.select(F.col("_t").alias("_alt"), F.col("_cik").alias("_b")), "_alt", "left")
    rows = rows.withColumn("cik", F.coalesce("_a", "_b")).dropna(subset=["cik"])
    return R.keep_first(rows, ["cik"], [F.col("pos")]).select("pos", "company", "ticker", "cik", F.lit(snapshot).cast("date").alias("universe_snapshot_date"))


def filing_rows(submissions: DataFrame, keys: list[str], block: str = "filings.recent") -> DataFrame:
    """Column-wise arrays to rows with their place; the shortest array says how many."""
    fields = submissions.select(f"{block}.*").columns
    arrays = [F.col(f"{block}.{f}").alias(f) for f in fields]
    n = F.least(*[F.size(f"{block}.{f}") for f in fields]) if len(fields) > 1 else F.size(f"{block}.{fields[0]}")
    rows = submissions.select(*keys, n.alias("_n"), F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_r"))
    return rows.where("pos < _n").select(*keys, "pos", "_r.*")


def select_filings(filings: DataFrame, keys: list[str], quotas: dict[str, int] | None = None) -> DataFrame:
    """The newest filings of each form up to its quota; only exact forms, so no amendments. Newest first, then place."""
    quotas = quotas or QUOTAS
    rows = filings.where(F.col("form").isin(list(quotas)))
    return R.top_per_group(rows, [*keys, "form"], [F.desc("filingDate"), F.col("pos")], R.quota("form", quotas))


def manifest(selected: DataFrame) -> DataFrame:
    """selected(company, ticker, cik, form, filingDate, reportDate, accessionNumber, primaryDocument) as the manifest."""
    form = F.replace("form", F.lit("-"), F.lit(""))
    plain = F.replace("accessionNumber", F.lit("-"), F.lit(""))
    rows = selected.withColumn("filing_id", F.concat_ws("_", "ticker", form, "reportDate"))
    rows = R.disambiguate(rows, "filing_id", F.right(plain, F.lit(6)))
    url = F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.col("cik").cast("bigint").cast("string"), plain, F.col("primaryDocument"))
    return rows.select("filing_id", "company", "ticker", "cik", F.col("form").alias("form_type"), F.col("filingDate").cast("date").alias("filing_date"), F.col("reportDate").cast("date").alias("period_of_report"), F.col("accessionNumber").alias("accession_number"), F.col("primaryDocument").alias("primary_document"), url.alias("document_url"), F.concat(F.lit("raw/"), F.col("ticker"), F.lit("/"), F.col("filing_id"), F.lit(".htm")).alias("local_path"))


def form_counts(companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Companies with their numbers of annual and quarterly reports, 0 if none."""
    counts = filings.groupBy("cik").pivot("form_type", ["10-K", "10-Q"]).count()
    return companies.join(counts.select("cik", F.col("10-K").alias("n_10k"), F.col("10-Q").alias("n_10q")), "cik", "left").na.fill(0, ["n_10k", "n_10q"])


def foreign_forms(filings: DataFrame) -> DataFrame:
    """(cik, forms): which foreign filers' forms a registrant has, sorted."""
    wanted = F.array(*map(F.lit, FOREIGN_FORMS))
    return filings.groupBy("cik").agg(F.array_sort(F.array_intersect(F.collect_set("form"), wanted)).alias("forms"))


def constituents(html: str, least: int = 90) -> list[dict]:
    """Rows (company, ticker) of the first table on a page that has both columns and enough rows."""
    from ledgerloom.functions.grid import laid_out
    from ledgerloom.functions.html import parse

    for table in parse(html).find("table"):
        head, *rows = laid_out(table) or [[]]
        at = {c.strip().lower(): i for i, c in enumerate(head)}
        ticker, company = at.get("ticker", at.get("symbol")), at.get("company", at.get("security"))
        if ticker is not None and company is not None and len(rows) >= least:
            return [{"pos": i, "company": r[company].strip(), "ticker": r[ticker].strip().upper()} for i, r in enumerate(rows)]
    raise ValueError("no table of constituents")
