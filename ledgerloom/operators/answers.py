"""Where the numbers of answers stand in what was read, and whether they are the right ones: joins of claims and cells.

Answers' claims and passages' cells come from table functions by lateral joins; a claim meets a cell by an equi-join on
what the cell's value may be stated as. How a claim stands to the cells of the answer key are flags over its hits, and
its location is the first of an ordered CASE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.functions.tables import passage_parts, stated_numbers

KEYS = ["run", "qid"]
#: Cells and texts that are listed for a claim at most.
MOST = 6

_TYPES = {"question": "string", "expected_change": "double", "expected_pct": "double", "results": "array<double>", "facts": "array<struct<row_label:string,value:string>>", "answer_values": "array<string>", "unverified": "array<string>"}


def _complete(answers: DataFrame) -> DataFrame:
    """answers with the columns it may lack, as null."""
    return answers.withColumns({c: F.lit(None).cast(t) for c, t in _TYPES.items() if c not in answers.columns})


def claims(answers: DataFrame) -> DataFrame:
    """(run, qid, n, start, stop, token, value, checked, cited) of answers(run, qid, answer, contexts).

    checked: verification looks at the number. It passes over small whole percentages; of equal numbers of an answer
    as many are checked as are not written as such, the first ones.
    """
    rows = answers.select(*KEYS, "answer", F.size("contexts").alias("_s")).lateralJoin(stated_numbers(F.col("answer").outer(), F.col("_s").outer()))
    same = Window.partitionBy(*KEYS, "token", "value")
    rows = rows.withColumn("checked", F.row_number().over(same.orderBy("n")) <= F.count_if("sure").over(same))
    return rows.select(*KEYS, "n", "start", "stop", "token", "value", "checked", "cited")


def parts(answers: DataFrame) -> DataFrame:
    """Rows of the passages of answers(run, qid, contexts): see passage_parts; src is the passage's place from 0."""
    rows = answers.select(*KEYS, F.posexplode("contexts").alias("src", "_c"))
    return rows.lateralJoin(passage_parts(F.col("_c").outer())).drop("_c")


def _hits(found: DataFrame, places: DataFrame) -> DataFrame:
    """Claims with the places whose value they may state."""
    keyed = places.withColumn("_key", F.explode(N.candidate_keys(F.col("value")))).withColumnRenamed("value", "held")
    return found.join(keyed.withColumnRenamed("_key", "value"), [*KEYS, "value"])


# ------------------------------------------------------------------ tracing


def trace_numbers(answers: DataFrame) -> DataFrame:
    """One row per claim of answers(run, qid, answer, contexts[, results]): status, in_cited_source, cells, texts.

    The cited passages are searched first, and all of them only if nothing is there. A number that no passage has is
    calculated if it is one of the results, else not found. cells and texts list the first MOST places in order.
    """
    answers = _complete(answers)
    found = claims(answers)
    places = parts(answers).where("kind <> 'header'").withColumnRenamed("content", "written")
    hits = _hits(found, places.drop("token")).withColumn("own", F.coalesce(F.array_contains("cited", F.col("src")), F.lit(False)))
    one = [*KEYS, "n"]
    hits = hits.withColumn("_any", F.max("own").over(Window.partitionBy(*one))).where("own OR NOT _any")
    order = Window.partitionBy(*one, "kind").orderBy("src", "block", "row", "col", "written")
    hits = hits.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= MOST)
    shown = F.btrim(F.replace("label", F.lit("*"), F.lit("")))
    cell = F.when(F.col("kind") == "cell", F.struct("_k", (F.col("src") + 1).alias("source"), "block", "row", "col", shown.alias("label"), "column"))
    text = F.when(F.col("kind") == "prose", F.struct("_k", (F.col("src") + 1).alias("source"), "block", F.col("written").alias("token")))
    listed = lambda c: F.array_sort(F.collect_list(c))
    per = hits.groupBy(*one).agg(listed(cell).alias("cells"), listed(text).alias("texts"), F.first("_any").alias("_any"))
    rows = found.join(per, one, "left").join(answers.select(*KEYS, "results"), KEYS)
    value = F.col("value")
    worked = F.exists("results", lambda r: (F.abs(value - F.abs(r)) < 0.005) | (value == F.bround(F.abs(r), 1)) | (value == F.bround(F.abs(r), 0)))
    status = F.when(F.size("cells") > 0, "cell").when(F.size("texts") > 0, "text").when(F.coalesce(worked, F.lit(False)), "calculated").otherwise("not found")
    return rows.select(*one, "start", "stop", "token", "value", status.alias("status"), F.coalesce("_any", F.lit(False)).alias("in_cited_source"), F.transform("cells", lambda c: c.dropFields("_k")).alias("cells"), F.transform("texts", lambda c: c.dropFields("_k")).alias("texts"))


# ------------------------------------------------------------------ the audit


def _answer_keys(answers: DataFrame) -> DataFrame:
    """(run, qid, labels, keys): what the answer key names, as rows' labels and absolute values."""
    keys = F.filter(F.transform(F.coalesce("answer_values", F.array().cast("array<string>")), lambda v: F.abs(N.token_value(v))), lambda v: v.isNotNull())
    labels = F.transform("facts", lambda f: T.norm_label(f["row_label"]))
    return answers.select(*KEYS, F.coalesce(labels, F.array().cast("array<string>")).alias("labels"), keys.alias("keys"))


def key_cells(answers: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with gold, per answer the key's cells, rows, columns, tables and filings).

    A cell is of the key if its row has a fact's label and its value is one of the answer values, those of an earlier
    period included.
    """
    heads = places.where("kind = 'header'").groupBy(*KEYS, "src").agg(*[F.coalesce(F.max(F.when(F.col("label") == c, F.col("content"))), F.lit("")).alias(c) for c in ("company", "period")])
    cells = places.where("kind = 'cell'").select(*KEYS, "src", "tbl", "row", "col", T.norm_label(F.col("label")).alias("label"), "value")
    cells = cells.join(heads, [*KEYS, "src"], "left").join(_answer_keys(answers), KEYS)
    filing = F.struct(F.coalesce("company", F.lit("")).alias("c"), F.coalesce("period", F.lit("")).alias("p"))
    item = F.array_contains("labels", F.col("label"))
    cells = cells.select(*KEYS, "src", "tbl", "row", "col", "label", "value", filing.alias("filing"), item.alias("item"), (item & F.array_contains("keys", F.col("value"))).alias("gold"))
    sets = {"g_rows": ("src", "tbl", "row"), "g_cols": ("src", "tbl", "col"), "g_tables": ("src", "tbl")}
    gold = cells.where("gold").groupBy(*KEYS).agg(*[F.collect_set(F.struct(*c)).alias(n) for n, c in sets.items()], F.collect_set("filing").alias("g_filings"))
    return cells, gold


def _is_key(value: Column) -> Column:
    """An answer value, the asked-for change, or the asked-for percentage."""
    change, pct = F.abs("expected_change"), F.abs("expected_pct")
    quoted = F.exists("keys", lambda k: N.matches(value, k))
    return quoted | F.coalesce((F.abs(value - change) < 0.5) | N.matches(value, change), F.lit(False)) | F.coalesce(F.abs(value - pct) <= 0.06, F.lit(False))


def audit_numbers(answers: DataFrame) -> DataFrame:
    """One row per claim: run, qid, n, token, value, key, origin, location.

    answers(run, qid, answer, contexts, facts(row_label), answer_values, unverified[, question, expected_change,
    expected_pct]). origin: unverified, source (a passage or the question has it), calculation, or unchecked percentage.
    location: where the number stands from the key's cells; of a calculation, that it is one.
    """
    answers = _complete(answers)
    places = parts(answers)
    cells, gold = key_cells(answers, places)
    found = claims(answers)
    one = [*KEYS, "n"]
    hits = _hits(found, cells).join(gold, KEYS, "left")
    inside = lambda s, *c: F.coalesce(F.array_contains(s, F.struct(*c)), F.lit(False))
    apart = ~F.coalesce(F.array_contains("g_filings", F.col("filing")), F.lit(False))
    any_ = lambda c, name: F.max(c).alias(name)
    flags = hits.groupBy(*one).agg(
        any_(F.col("gold"), "right"), any_(inside("g_rows", "src", "tbl", "row"), "in_row"), any_(F.col("item"), "item"), F.min(F.when(F.col("item"), apart & F.col("g_filings").isNotNull())).alias("all_apart"),
        any_(inside("g_cols", "src", "tbl", "col"), "in_col"), any_(inside("g_tables", "src", "tbl"), "in_table"), F.lit(True).alias("hit"),
    )
    prose = places.where("kind = 'prose'").groupBy(*KEYS).agg(F.collect_set("value").alias("prose"))
    known = F.filter(F.transform(N.number_tokens(F.concat_ws(" ", F.array_join("contexts", "\n"), "question")), lambda t: F.abs(N.token_value(t))), lambda v: v.isNotNull())
    allowed = F.array_distinct(F.flatten(F.transform(known, N.candidate_keys)))
    per = answers.select(*KEYS, F.coalesce("unverified", F.array().cast("array<string>")).alias("unverified"), "expected_change", "expected_pct", allowed.alias("allowed")).join(_answer_keys(answers), KEYS).join(prose, KEYS, "left")
    rows = found.join(per, KEYS).join(flags, one, "left")
    origin = F.when(~F.col("checked"), "unchecked percentage").when(F.array_contains("unverified", F.col("token")), "unverified").when(F.array_contains("allowed", F.col("value")), "source").otherwise("calculation")
    place = (
        F.when(origin == "calculation", "calculation")
        .when(F.col("right"), "right cell")
        .when(F.col("in_row"), "same row, other column")
        .when(F.col("item") & F.col("all_apart"), "same line item, other filing or period")
        .when(F.col("item"), "same line item, other table")
        .when(F.col("in_col"), "same column, other row")
        .when(F.col("in_table"), "same table, other cell")
        .when(F.col("hit"), "other table")
        .when(F.array_contains("prose", F.col("value")), "text")
        .otherwise("not in sources")
    )
    return rows.select(*one, "token", "value", _is_key(F.col("value")).alias("key"), origin.alias("origin"), place.alias("location"))


def outcomes(answers: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """answers with outcome and, given the rows of audit_numbers(), cause.

    answers(run, qid, correct, refused, unverified, values_ok, calc_ok, facts_in_context). The cause of a wrong answer is
    the first that fits: values right but not the change, facts that weren't read, the place of the first wrong number
    that was quoted or is unverified, or a value that is missing.
    """
    flagged = F.size(F.coalesce("unverified", F.array().cast("array<string>"))) > 0
    correct, refused = F.coalesce("correct", F.lit(False)), F.coalesce("refused", F.lit(False))
    out = answers.withColumn("outcome", F.when(correct, "correct").when(refused, "refused").when(flagged, "wrong, flagged").otherwise("wrong, not flagged"))
    if numbers is None:
        return out
    wrong = numbers.where("NOT key AND origin IN ('source', 'unverified')").groupBy(*KEYS).agg(F.min_by("location", "n").alias("_wrong"))
    read = F.coalesce("facts_in_context", F.lit(False))
    cause = (
        F.when(correct, "")
        .when(refused, F.when(read, "refused with facts in context").otherwise("facts not in context"))
        .when(F.coalesce("values_ok", F.lit(False)) & (F.col("calc_ok") == False), "values right, change missing or wrong")  # noqa: E712  null isn't false
        .when(~read, "facts not in context")
        .otherwise(F.coalesce("_wrong", F.lit("value missing from answer")))
    )
    return out.join(wrong, KEYS, "left").withColumn("cause", cause).drop("_wrong")


# ------------------------------------------------------------------ planted errors


def written_like(token: Column, value: Column) -> Column:
    """A value in the style of a token: its decimals and parentheses, its dollar, and commas if it has any or the value is large."""
    bare = F.btrim(token, F.lit("$()"))
    places = F.length(F.regexp_extract(F.replace(bare, F.lit(","), F.lit("")), r"\.(.*)$", 1))
    text = F.when(places == 0, F.format_number(value, 0)).when(places == 1, F.format_number(value, 1)).otherwise(F.format_number(value, 2))
    text = F.when(F.contains(token, F.lit(",")) | (value >= 1000), text).otherwise(F.replace(text, F.lit(","), F.lit("")))
    text = F.when(F.startswith(F.ltrim(token, F.lit("$")), F.lit("(")), F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return F.when(F.startswith(token, F.lit("$")), F.concat(F.lit("$"), text)).otherwise(text)


def transposed(value: Column) -> Column:
    """A whole value with its last two unlike neighbouring digits swapped; null if all digits are alike."""
    d = value.cast("long").cast("string")
    return F.when(F.rlike(d, F.lit(r"(\d)(?!\1)\d")), F.regexp_replace(d, r"^(.*)(\d)((?!\2)\d)(\3*)$", "$1$3$2$4").cast("double"))


def plants(answers: DataFrame) -> DataFrame:
    """(run, qid, key, token, start, stop, kind, plant, planted) for each answer value that the answer states.

    Invented errors change the value itself; the others are values of cells that differ from the key's first cell in one
    respect, of one column the nearest row's. A plant is positive, unlike the value, and none of the answer values.
    """
    answers = _complete(answers)
    cells, _ = key_cells(answers, parts(answers))
    tokens = F.regexp_extract_all("answer", F.lit(N.NUMBER), F.lit(0))
    rows = _answer_keys(answers).join(answers.select(*KEYS, "answer", tokens.alias("tokens")), KEYS)
    said = rows.withColumn("key", F.explode(F.array_distinct("keys"))).withColumn("token", F.get(F.filter("tokens", lambda t: F.abs(N.token_value(t)) == F.col("key")), F.lit(0))).where("token is not null")
    first = F.min(F.struct("src", "tbl", "row", "col", "label")).alias("at")
    target = cells.where("gold").groupBy(*KEYS, F.col("value").alias("key")).agg(first)
    said = said.join(target, [*KEYS, "key"], "left")
    key, unit = F.col("key"), F.when(F.col("key") == F.floor("key"), 1.0).otherwise(0.01)
    near = lambda v: F.when(unit == 1, F.bround(v, 0)).otherwise(F.bround(v, 2))
    made = {"last digit +1": key + unit, "+10%": near(key * 1.1), "-10%": near(key * 0.9), "transposed digits": F.when(unit == 1, transposed(key))}
    own = [*KEYS, "key", "token", "answer"]
    invented = said.select(*own, F.lit("invented").alias("kind"), F.inline(F.array(*[F.struct(F.lit(n).alias("plant"), v.alias("value")) for n, v in made.items()])))
    same = lambda c: F.col(c) == F.col(f"at.{c}")
    here = same("src") & same("tbl")
    name = F.when(here & same("row"), "same row, other column").when(here & same("col"), "same column, other row").when(~here & (F.col("label") == F.col("at.label")), "same line item, other table")
    others = said.join(cells.select(*KEYS, "src", "tbl", "row", "col", "label", F.col("value").alias("held")), KEYS).where("at is not null").withColumn("plant", name)
    others = others.where("plant is not null AND held > 0 AND NOT array_contains(keys, held)")
    rank = F.struct(F.when(F.col("plant") == "same column, other row", F.abs(F.col("row") - F.col("at.row"))).otherwise(0), "src", "tbl", "row", "col")
    wrong = others.groupBy(*own, "plant").agg(F.min_by("held", rank).alias("value")).select(*own, F.lit("wrong cell").alias("kind"), "plant", "value")
    every = invented.unionByName(wrong).where((F.col("value") > 0) & (F.col("value") != key))
    return every.withColumn("planted", written_like(F.col("token"), F.col("value"))).drop("value")


def stress(answers: DataFrame) -> DataFrame:
    """(run, qid, kind, plant, original, planted, flagged) of the plants in answers that are right and unflagged.

    answers(run, qid, question, answer, contexts, facts, answer_values, correct, unverified). What verification flags in
    the answer as it is counts as calculated and isn't held against a plant.
    """
    answers = _complete(answers)
    sources = F.concat_ws(" ", F.array_join("contexts", "\n"), "question")
    fit = answers.where(F.col("correct") & (F.size(F.coalesce("unverified", F.array().cast("array<string>"))) == 0)).withColumn("_sources", sources)
    before = fit.select(*KEYS, "_sources", N.unsupported(F.col("answer"), F.col("_sources")).alias("_known"))
    at = F.instr(F.col("answer"), F.col("token"))
    rows = plants(fit.drop("_sources")).join(before, KEYS)
    changed = F.concat(F.substring(F.col("answer"), F.lit(1), at - 1), "planted", F.substr(F.col("answer"), at + F.length("token")))
    rows = rows.withColumn("_new", F.array_except(N.unsupported(changed, F.col("_sources")), "_known"))
    return rows.select(*KEYS, "kind", "plant", F.col("token").alias("original"), "planted", (F.size("_new") > 0).alias("flagged"))


def stress_rates(planted: DataFrame) -> DataFrame:
    return planted.groupBy("kind", "plant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("flagged").cast("int")).alias("flagged"))

