"""Where a number stands in the original document: tagged facts, table cells and prose, indexed as tables and joined.

index() reads each document once in an Arrow function and gives one row per candidate place, with all that scoring
needs: row label, reporting period, item, the numbers of its table, the text before it. Scoring a batch of quoted
numbers is then an equi-join on (filing, value) and arithmetic in Spark.
"""

from __future__ import annotations

import bisect
import datetime as dt
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import html as H
from ledgerloom.functions import numbers as N
from ledgerloom.functions.tables import cell_value, norm
from ledgerloom.operators.parsing import frame

# Patterns and names that results depend on.
DATE = re.compile(r"\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+(\d{1,2}),?\s*(\d{4})")
ITEM = re.compile(r"^\s*item\s+(\d{1,2}[a-z]?)\b", re.I)
DAYS = {"three": 91, "six": 182, "nine": 273, "twelve": 365, "year": 365, "fiscal year": 365}
SEGMENT_AXES = ("us-gaap:StatementBusinessSegmentsAxis", "srt:StatementGeographicalAxis")
SMALL_WORDS = ("And", "Of", "The", "For", "In")
BEFORE_TABLE, CAPTION = 800, 60

PLACE_SCHEMA = (
    "node int, method string, value double, raw string, fact_id string, concept string, sign string, row_label string, item string, "
    "start string, end string, instant string, dims array<struct<axis:string,member:string>>, table_values array<double>, before_table string"
)


def index_of(content: str | bytes) -> list[dict]:
    """Candidate places of one document: inline facts, and cells with one number and no fact."""
    root = H.parse(content)
    nodes = list(root.walk())
    periods: dict[str, dict] = {}
    for c in (n for n in nodes if n.tag == "xbrli:context"):
        own = {x.tag.partition(":")[2]: x.text().strip() for x in c.find("xbrli:startdate", "xbrli:enddate", "xbrli:instant")}
        own["dims"] = [{"axis": m.attrs.get("dimension", ""), "member": m.text().strip()} for m in c.find("xbrldi:explicitmember")]
        periods[c.attrs.get("id", "")] = own
    item, items = None, {}
    values: dict[int, list[float]] = {}
    before: dict[int, str] = {}
    seen: list[str] = []
    for i, n in enumerate(nodes):
        shown = n.words() if n.tag not in H.SKIPPED and sum(len(k) for k in n.kids if isinstance(k, str)) < 150 else ""
        if 0 < len(shown) < 150 and (m := ITEM.match(shown)):
            item = m.group(1).upper()
        items[id(n)] = item
        if n.tag == "table":
            values[id(n)] = sorted({v for td in n.find("td") if (v := cell_value(td.words())) is not None})
            before[id(n)] = norm(" ".join(seen)[-BEFORE_TABLE:])
        if n.tag not in H.SKIPPED:
            seen += [w for k in n.kids if isinstance(k, str) and (w := " ".join(k.split()))]
        del i

    def place(i: int, n: H.Node, method: str, value: float, context: dict) -> dict:
        row, table = n.above("tr"), n.above("table")
        label = next((norm(w) for c in row.find("td", "th") if re.search("[A-Za-z]", w := c.words())), "") if row else ""
        return {
            "node": i, "method": method, "value": value, "raw": n.words(), "fact_id": n.attrs.get("id") if method == "ixbrl" else None,
            "concept": n.attrs.get("name") if method == "ixbrl" else None, "sign": n.attrs.get("sign"), "row_label": label, "item": items[id(n)],
            "start": context.get("startdate"), "end": context.get("enddate"), "instant": context.get("instant"), "dims": context.get("dims", []),
            "table_values": values.get(id(table), []) if table else [], "before_table": before.get(id(table), "") if table else "",
        }

    out = []
    for i, n in enumerate(nodes):
        if n.tag == "ix:nonfraction" and (v := N.value_of(n.words())) is not None:
            out.append(place(i, n, "ixbrl", abs(v), periods.get(n.attrs.get("contextref", ""), {})))
        elif n.tag == "td" and next(n.find("ix:nonfraction"), None) is None and len(w := n.words()) < 40 and (v := cell_value(w)) is not None:
            out.append(place(i, n, "table", v, {}))
    return out


def index(docs: DataFrame, filing: str = "filing_id", content: str = "content") -> DataFrame:
    names = [filing, *[c.split()[0] for c in PLACE_SCHEMA.replace("struct<axis:string,member:string>", "s").split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame([{filing: f, **p} for f, c in zip(b[filing], b[content], strict=True) if c is not None for p in index_of(c)], names)

    return docs.select(filing, content).mapInPandas(run, f"{filing} string, {PLACE_SCHEMA}")


# ------------------------------------------------------------------ scores


def label_score(found: Column, wanted: Column) -> Column:
    some = (found != "") & (wanted != "")
    return F.when(some & (found == wanted), 3).when(some & (F.startswith(found, wanted) | F.startswith(wanted, found)), 2).otherwise(0)


def header_dates(column: Column) -> Column:
    """Dates written in a column header."""
    found = F.regexp_extract_all(column, F.lit(r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s*\d{4})"), F.lit(1))
    parts = lambda x: F.concat_ws(" ", F.substring(x, 1, 3), F.regexp_extract(x, r"(\d{1,2}),?\s*\d{4}$", 1), F.right(x, F.lit(4)))
    return F.transform(found, lambda x: F.try_to_date(parts(x), "MMM d yyyy"))


def period_score(start: Column, end: Column, instant: Column, column: Column) -> Column:
    """1 if the fact ends on a date of the header (or in its year, if it has no date), and 1 if it is as long as it says."""
    last = F.try_to_date(F.substring(F.coalesce(F.nullif(end, F.lit("")), instant), 1, 10))
    dates = header_dates(column)
    year = F.rlike(column, F.concat(F.lit(r"\b"), F.year(last).cast("string"), F.lit(r"\b")))
    ends = F.when(F.size(dates) > 0, F.coalesce(F.array_contains(F.array_compact(dates), last), F.lit(False))).otherwise(F.coalesce(year, F.lit(False)))
    days = F.date_diff(last, F.try_to_date(F.substring(start, 1, 10)))
    asked = F.lit(None).cast("int")
    for word, n in reversed(DAYS.items()):
        asked = F.when(F.rlike(F.lower(column), F.lit(rf"\b{word}\b")), F.lit(n)).otherwise(asked)
    return F.when(F.length(column) > 0, ends.cast("int") + F.coalesce((F.abs(days - asked) <= 20).cast("int"), F.lit(0))).otherwise(0)


def overlap(values: Column, quoted: Column) -> Column:
    """Share of the quoted table's numbers that the place's table has."""
    return F.when(F.size(quoted) > 0, F.size(F.array_intersect(values, quoted)) / F.size(F.array_distinct(quoted))).otherwise(0.0)


def caption_score(before: Column, caption: Column) -> Column:
    words = F.lower(F.btrim(F.regexp_replace(F.regexp_extract(F.coalesce(caption, F.lit("")), r"^[^|]*", 0), r"[\s*]+", " "), F.lit(" :")))
    return ((F.length(words) >= 8) & F.contains(before, F.substring(words, 1, CAPTION))).cast("int")


def locate_cells(asked: DataFrame, places: DataFrame, filing: str = "filing_id") -> DataFrame:
    """One row per number of asked(id, filing, value, label, column, caption, quoted, item) that has a place.

    The best place by label (30), shared numbers (20), period (6), item (2) and caption (1); whether it is alone with
    its score; and the best tagged fact for the value.
    """
    q = asked.select("id", filing, "value", F.lower(F.btrim(F.regexp_replace("label", r"[\s*]+", " "), F.lit(" :"))).alias("_l"), F.coalesce("column", F.lit("")).alias("_c"), F.col("caption").alias("_cap"), F.coalesce("quoted", F.array().cast("array<double>")).alias("_q"), F.col("item").alias("_i"))
    rows = q.join(places, [filing, "value"])
    label = label_score(F.col("row_label"), F.col("_l"))
    period = F.when(F.col("method") == "ixbrl", period_score(F.col("start"), F.col("end"), F.col("instant"), F.col("_c"))).otherwise(0)
    same_item = F.coalesce((F.col("_i") == F.col("item")).cast("int"), F.lit(0))
    score = 10 * label + F.bround(20 * overlap(F.col("table_values"), F.col("_q"))).cast("int") + 3 * period + 2 * same_item + caption_score(F.col("before_table"), F.col("_cap"))
    rows = rows.withColumn("score", score).where((F.col("method") == "ixbrl") | (label > 0))
    order = [F.desc("score"), (F.col("method") == "table").cast("int"), F.col("node")]
    w, facts = Window.partitionBy("id").orderBy(*order), Window.partitionBy("id", "method").orderBy(F.desc("score"), "node")
    rows = rows.withColumn("_k", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).withColumn("_f", F.row_number().over(facts))
    best = rows.where("_k = 1").select("id", filing, "node", "method", F.coalesce(F.col("score") > F.col("_next"), F.lit(True)).alias("is_unique"), "score")
    fact = rows.where("method = 'ixbrl' and _f = 1").select("id", "fact_id", "concept")
    return best.join(fact, "id", "left")


def member_label(member: Column) -> Column:
    """`x:CloudAndServicesMember` to `Cloud and Services`."""
    name = F.regexp_replace(F.regexp_extract(member, r"[^:]*$", 0), "Member$", "")
    words = F.split(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "), " ")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*SMALL_WORDS), F.lower(w)).otherwise(w)), " ")


def segment_notes(places: DataFrame, filing: str = "filing_id") -> DataFrame:
    """(filing, fact_id, member, axis, total, total_fact_id) of facts of a segment whose company-wide figure differs.

    A null-safe equi-join of a fact to those of the same name and period without dimensions, the first in the document.
    """
    facts = places.where("method = 'ixbrl'")
    segment = F.get(F.filter("dims", lambda d: d["axis"].isin(*SEGMENT_AXES)), 0)
    part = facts.withColumn("_s", segment).where("_s is not null").select(filing, "fact_id", "concept", "start", "end", "instant", F.col("value").alias("_v"), "_s")
    key = [filing, "concept", "start", "end", "instant"]
    whole = facts.where(F.size("dims") == 0).groupBy(*key).agg(F.min_by(F.struct("raw", "sign", "fact_id"), "node").alias("_t"), F.collect_set("value").alias("_all"))
    same = None
    for k in key:
        test = part[k].eqNullSafe(whole[k])
        same = test if same is None else same & test
    rows = part.join(whole, same).where(~F.array_contains("_all", F.col("_v")))
    total = F.concat(F.when(F.col("_t.sign") == "-", "-").otherwise(""), F.col("_t.raw"))
    return rows.select(part[filing], part["fact_id"], member_label(F.col("_s.member")).alias("member"), F.regexp_extract("_s.axis", r"[^:]*$", 0).alias("axis"), total.alias("total"), F.col("_t.fact_id").alias("total_fact_id"))


# ------------------------------------------------------------------ prose and rendering


def around(text: str, token: str, n: int = 4) -> tuple[str, str] | None:
    """n words on either side of the first place where token stands alone."""
    sides = re.split(rf"(?<![\d,.]){re.escape(token)}(?![\d,]|\.\d)", text, maxsplit=1)
    return (" ".join(sides[0].split()[-n:]), " ".join(sides[1].split()[:n])) if len(sides) == 2 else None


def _joined(root: H.Node) -> tuple[str, list[int], list[H.Node]]:
    """A document's text with single spaces, and where in it each piece starts and which element owns it."""
    full, starts, owners = "", [], []
    for owner, piece in root.pieces():
        if owner.tag in H.SKIPPED:
            continue
        for part in re.findall(r"\s+|\S.*\S|\S", piece, re.S):
            if not part.isspace():
                starts.append(len(full)), owners.append(owner)
                full += " ".join(part.split())
            elif full and full[-1] != " ":
                full += " "
    return full, starts, owners


def _least_common(a: H.Node, b: H.Node) -> H.Node | None:
    """The smallest element that holds both."""
    above = {id(x) for x in (a, *a.up())}
    return next((x for x in (b, *b.up()) if id(x) in above), None)


def locate_text(root: H.Node, token: str, before: str, after: str, item: str | None = None, most: int = 20) -> dict | None:
    """The smallest element that holds the token with words around it; the widest context that is found decides."""
    order = {id(n): i for i, n in enumerate(root.walk())}
    full, starts, owners = _joined(root)
    owner_at = lambda at: owners[max(0, bisect.bisect_right(starts, at) - 1)]
    left, right = before.split(), after.split()
    phrases = [" ".join([*left[-m:], token, *right[:n]]) if m else " ".join([token, *right[:n]]) for m, n in ((8, 8), (4, 4), (4, 0), (0, 4))]
    for phrase in (p for p in phrases if len(p) >= len(token) + 8):
        holders = (_least_common(owner_at(m.start()), owner_at(m.start() + len(phrase) - 1)) for m in re.finditer(f"(?={re.escape(phrase)})", full))
        found = list(itertools.islice({id(n): n for n in holders if n is not None}.values(), most))
        if not found:
            continue
        heads = [(i, m[1].upper()) for i, n in enumerate(root.walk()) if len(w := n.words()) < 150 and (m := ITEM.match(w))]
        items = [next((code for i, code in reversed(heads) if i <= order[id(n)]), None) for n in found]
        fitting = [n for n, own in zip(found, items, strict=True) if item is not None and own == item] or found
        return {"node": order[id(fitting[0])], "method": "text", "unique": len(fitting) == 1}
    return None


def filing_of(ticker: str, form: str, period: str) -> str | None:
    """The filing's id by its passage header: `ACME`, `10-Q`, `... (quarter ended June 28, 2025)`."""
    m = DATE.search(period or "")
    if not m or not ticker:
        return None
    try:
        day = dt.datetime.strptime(" ".join(m.groups()), "%b %d %Y").date()
    except ValueError:
        return None
    return f"{ticker}_{form.replace('-', '')}_{day.isoformat()}"


def rendered(content: str | bytes, node: int | None = None, mark: str | None = None, base: str | None = None, title: str = "") -> str:
    """The document as it may be shown: active parts gone, one element marked, links relative to where it came from."""
    root = H.parse(content)
    nodes = list(root.walk())
    target = nodes[node] if node is not None and 0 <= node < len(nodes) else None
    note = ""
    if target is not None:
        target.attrs["id"] = "target"
        cell = target if target.tag in ("td", "th") else target.above("td", "th")
        note = f" highlighted: <b>{H.escape(mark or target.words()[:40])}</b>"
        if cell is not None:
            cell.attrs["class"] = f"{cell.attrs.get('class', '')} marked-cell".strip()
            if (row := cell.above("tr")) is not None:
                row.attrs["class"] = f"{row.attrs.get('class', '')} marked-row".strip()
        elif mark:
            for n in target.walk():
                at = next((i for i, k in enumerate(n.kids) if isinstance(k, str) and mark in k), None)
                if at is not None:
                    left, _, right = n.kids[at].partition(mark)
                    held = H.Node("mark", {}, n)
                    held.kids = [mark]
                    n.kids[at : at + 1] = [left, held, right]
                    break
    H.sanitised(root)
    page = H.serialise(root)
    banner = f"<div>{H.escape(title)}{note}</div>"
    head = f'<base href="{H.escape(base)}">' if base else ""
    return f"<!DOCTYPE html>{head}{banner}{page}"


def tally(located: DataFrame) -> DataFrame:
    """(method, is_unique, n) of what was located."""
    return located.groupBy("method", "is_unique").agg(F.count(F.lit(1)).alias("n"))
