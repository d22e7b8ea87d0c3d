import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import html as H
from ledgerloom.functions.text import is_filing_id
from ledgerloom.operators import locate as L

def context(name, inner, *members):
    """A reporting context with its period and dimensions."""
    dims = "".join(f'<xbrldi:explicitMember dimension="{axis}">{member}</xbrldi:explicitMember>' for axis, member in members)
    held = f"<xbrli:entity><xbrli:segment>{dims}</xbrli:segment></xbrli:entity>" if dims else ""
    return f'<xbrli:context id="{name}">{held}<xbrli:period>{inner}</xbrli:period></xbrli:context>'


def tagged(name, ref, fact, text, sign=""):
    return f'<ix:nonFraction contextRef="{ref}" name="x:{name}" id="{fact}"{sign}>{text}</ix:nonFraction>'


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


YEAR = "<xbrli:startDate>2030-03-01</xbrli:startDate><xbrli:endDate>2031-02-28</xbrli:endDate>"
QUARTER = "<xbrli:startDate>2030-12-01</xbrli:startDate><xbrli:endDate>2031-02-28</xbrli:endDate>"
DAY = "<xbrli:instant>2031-02-28</xbrli:instant>"
#: A made annual report of a timber merchant.
PAGE = f"""<html><head><style>p {{ color: red }}</style></head><body><div style="display:none">{context("y", YEAR)}{context("q", QUARTER)}{context("d", DAY)}
{context("north", YEAR, ("us-gaap:StatementBusinessSegmentsAxis", "nt:NorthAndCoastSegmentMember"))}{context("planks", YEAR, ("srt:ProductOrServiceAxis", "nt:PlanksMember"))}
{context("all", YEAR, ("srt:StatementGeographicalAxis", "nt:HomeMember"))}</div>
<h2>Item 7. Discussion</h2><p>Freight grew by 312 loads, or 4.5%, as the <b>new</b> line to the coast opened.</p>
{table(("", "Year Ended February 28, 2031", "Three Months Ended February 28, 2031"), ("Timber sold", tagged("Sales", "y", "s1", "8,440"), tagged("Sales", "q", "s2", "2,005")), ("Freight", tagged("Freight", "y", "s3", "1,377"), "344"))}
<h2>Item 8. Statements</h2>
{table(("North and coast", tagged("Sales", "north", "s4", "5,100")), ("Planks", tagged("Sales", "planks", "s5", "3,340")), ("Home", tagged("Sales", "all", "s8", "8,440")), ("Timber sold, all", tagged("Sales", "y", "s6", "8,440")))}
{table(("Stock", tagged("Stock", "d", "s7", "2,005", ' sign="-"')), ("Loads", "312"))}
<p onclick="go()">A fall by 312 loads, or 4.5%, as the old line closed.</p><script>go()</script></body></html>"""


@pytest.fixture(scope="module")
def places(spark):
    return L.index(spark.createDataFrame([("F", PAGE)], "filing_id string, content string")).cache()


ASKED = "id string, filing_id string, value double, label string, column string, caption string, quoted array<double>, item string"


def test_cells_are_told_apart(spark, places):
    rows = [
        ("by row", "F", 8440.0, "Timber sold", "Year Ended · February 28, 2031", None, None, None),
        ("by longer row", "F", 8440.0, "Timber sold, all", "", None, [5100.0, 3340.0], None),
        ("by period", "F", 2005.0, "Timber sold", "Three Months Ended February 28, 2031", None, None, "7"),
        ("untagged", "F", 312.0, "Loads", "", None, None, "8"),
        ("no row", "F", 344.0, "Planks", "", None, None, None),
        ("elsewhere", "G", 8440.0, "Timber sold", "", None, None, None),
    ]
    got = {r["id"]: r for r in L.locate_cells(spark.createDataFrame(rows, ASKED), places).collect()}
    assert {k: (r["method"], r["fact_id"], r["is_unique"]) for k, r in got.items()} == {
        "by row": ("ixbrl", "s1", True), "by longer row": ("ixbrl", "s6", True), "by period": ("ixbrl", "s2", True), "untagged": ("table", None, True),
    }
    facts = {r["fact_id"]: r for r in places.where("fact_id is not null").collect()}
    assert (facts["s3"]["item"], facts["s6"]["item"], facts["s7"]["instant"], facts["s7"]["sign"]) == ("7", "8", "2031-02-28", "-")
    tally = {(r["method"], r["is_unique"]): r["n"] for r in L.tally(L.locate_cells(spark.createDataFrame(rows, ASKED), places)).collect()}
    assert tally == {("ixbrl", True): 3, ("table", True): 1}


def test_segments(places, spark):
    """Only a segment or region whose figure isn't the whole company's has a note; a product line is neither."""
    rows = [r.asDict() for r in L.segment_notes(places).collect()]
    assert rows == [{"filing_id": "F", "fact_id": "s4", "member": "North and Coast Segment", "axis": "StatementBusinessSegmentsAxis", "total": "8,440", "total_fact_id": "s1"}]
    labels = {"a:SawMillOfTheYearMember": "Saw Mill of the Year", "Wood": "Wood", "b:TheMillMember": "The Mill"}
    df = spark.createDataFrame([(k,) for k in labels], "m string")
    assert {r["m"]: r["l"] for r in df.select("m", L.member_label(F.col("m")).alias("l")).collect()} == labels


@pytest.mark.parametrize("column,want", [("Year Ended Feb. 28, 2031", 2), ("Three Months Ended · February 28, 2031", 1), ("Twelve months, 2031", 2), ("2030", 0), ("Mar 1, 2031", 0), ("", 0)])
def test_period_score(spark, column, want):
    score = L.period_score(F.lit("2030-03-01"), F.lit("2031-02-28"), F.lit(None).cast("string"), F.lit(column))
    assert spark.range(1).select(score.alias("s")).first()["s"] == want


def test_prose_and_rendering():
    root = H.parse(PAGE)
    found = lambda before, after, item=None: L.locate_text(root, "312", before, after, item)
    grew, fell = found("Freight grew by", "loads, or 4.5%, as the new"), found("A fall by", "loads, or 4.5%, as the old")
    assert grew["unique"] and fell["unique"] and grew["node"] != fell["node"]
    assert found("by", "loads, or 4.5%, as")["unique"] is False and found("by", "loads, or 4.5%, as", "8")["node"] == fell["node"]
    assert found("never said", "of it") is None
    page = L.rendered(PAGE, grew["node"], "312", base="https://n.test/a/")
    assert 'id="target"' in page and "<mark>312</mark>" in page and '<base href="https://n.test/a/">' in page
    assert not any(x in page.lower() for x in ("<script", "onclick", "go()"))
    assert L.around("Some 8,312 and 312.5, then 312 more loads came", "312", 2) == ("312.5, then", "more loads")
    assert L.filing_of("NORD", "10-K", "fiscal 2030 (fiscal year ended February 28, 2031)") == "NORD_10K_2031-02-28" and L.filing_of("NORD", "10-K", "2030") is None


def test_filing_ids(spark):
    ids = ["NORD_10K_2031-02-28", "NORD_10K_2031-2-28", "x/../NORD_10K_2031-02-28", "Nord_10K_2031-02-28", "NORD_6K_2031-02-28", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", is_filing_id(F.col("x")).alias("ok")).orderBy("i")
    assert [r["ok"] for r in df.collect()] == [True] + [False] * 6
