"""Citation checks of answers against the excerpts that were shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

GAP, BROAD, SNIPPET = 3, 40, 90


def _spelled(c: str = "") -> Column:
    return F.concat(F.col(f"{c}path"), F.lit(":"), F.col(f"{c}first").cast("string"), F.lit("-"), F.col(f"{c}last").cast("string"))


def check_ranges(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """(qid, n_citations, invalid) by containment alone: citations path:a-b that lie in no shown excerpt, repeats kept."""
    cites = answers.select("qid", F.posexplode(T.citations("text", T.RANGE_CITATION)).alias("n", "c")).select("qid", "n", "c.*")
    held = shown.select("qid", "path", "start_line", "end_line")
    inside = cites.join(held, ["qid", "path"]).filter("start_line <= first and last <= end_line").select("qid", "n").distinct().withColumn("ok", F.lit(True))
    rows = cites.join(inside, ["qid", "n"], "left").withColumn("bad", F.when(F.col("ok").isNull(), F.struct("n", _spelled().alias("c"))))
    rows = rows.groupBy("qid").agg(F.count("*").alias("n_citations"), F.transform(F.sort_array(F.collect_list("bad")), lambda x: x["c"]).alias("invalid"))
    none = F.array().cast("array<string>")
    return answers.select("qid").join(rows, "qid", "left").select("qid", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("invalid", none).alias("invalid"))


def _slice(text: Column, start: Column, a: Column, b: Column) -> Column:
    """Lines a to b of a text whose first line is numbered ``start``."""
    return F.array_join(F.slice(T.lines(text), (a - start + 1).cast("int"), F.greatest(F.lit(0), (b - a + 1).cast("int"))), "\n")


def cited_lines(cites: DataFrame, shown: DataFrame) -> DataFrame:
    """``cites`` (qid, path, first, last, one row each) with ``body`` and ``owner`` of the lines that they cite, null if invalid.

    The first shown excerpt that holds the range decides; else excerpts of the file that overlap it, if they leave holes of at
    most ``GAP`` lines, at its ends too.
    """
    keys = cites.select("qid", "path", "first", "last").distinct()
    held = shown.select("qid", "path", "pos", "start_line", "end_line", "text", "symbol")
    met = keys.join(held, ["qid", "path"])
    by = ["qid", "path", "first", "last"]
    inside = met.filter("start_line <= first and last <= end_line")
    single = inside.groupBy(*by).agg(F.min(F.struct("pos", "start_line", "text", "symbol")).alias("m"))
    single = single.select(*by, F.struct(_slice(F.col("m.text"), F.col("m.start_line"), F.col("first"), F.col("last")).alias("body"), F.col("m.symbol").alias("owner")).alias("single"))
    over = met.filter("end_line >= first and start_line <= last")
    order = Window.partitionBy(*by).orderBy("start_line", "pos")
    covered = F.greatest(F.col("first"), F.coalesce(F.max(F.col("end_line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("first")))
    over = over.withColumn("joined", F.col("start_line") <= covered + GAP).withColumn("ord", F.row_number().over(order))
    part = _slice(F.col("text"), F.col("start_line"), F.greatest("first", "start_line"), F.least("last", "end_line"))
    rows = over.select(*by, "joined", "end_line", F.struct("ord", part.alias("body"), "symbol").alias("p")).groupBy(*by).agg(
        F.bool_and("joined").alias("whole"), F.max("end_line").alias("reach"), F.sort_array(F.collect_list("p")).alias("p")
    )
    reaches = F.greatest(F.col("first"), F.col("reach") + 1) + GAP > F.col("last")
    owners = F.filter(F.transform("p", lambda x: x["symbol"]), lambda s: s != "")
    span = rows.filter(F.col("whole") & reaches).select(*by, F.struct(F.array_join(F.transform("p", lambda x: x["body"]), "\n").alias("body"), F.array_join(owners, ", ").alias("owner")).alias("span"))
    return cites.join(single, by, "left").join(span, by, "left").withColumn("found", F.coalesce("single", "span")).drop("single", "span")


def check_answers(answers: DataFrame, shown: DataFrame, broad: int = BROAD) -> DataFrame:
    """One report for each answer (qid, text) against the excerpts ``shown`` to it (qid, pos, path, start_line, end_line, text, symbol).

    invalid: ranges that no shown excerpt supports, once each. unsupported: backticked names that occur neither in the
    cited lines nor among the definitions these lie in, "name @ ranges". uncited: claims without a citation. broad: ranges of more than
    ``broad`` lines. widths in order of citation. refusal: an honest not-found that cites and claims nothing.
    """
    said = answers.select("qid", F.posexplode(T.sentences("text")).alias("s", "sentence"))
    said = said.select("qid", "s", "sentence", T.citations("sentence").alias("cites"), T.claimed_names("sentence").alias("names"))
    cites = said.select("qid", "s", F.posexplode("cites").alias("n", "c")).select("qid", "s", "n", "c.*")
    cites = cited_lines(cites, shown).withColumn("key", _spelled())
    owners = F.transform(F.split("found.owner", ", ", -1), lambda o: F.element_at(F.split(o, "\\.", -1), -1))
    support = F.when(F.col("found").isNotNull(), F.concat("found.body", F.lit("\n"), F.array_join(owners, " ")))
    at = lambda value, when=None: F.collect_list(F.struct("s", "n", value.alias("v")) if when is None else F.when(when, F.struct("s", "n", value.alias("v"))))
    values = lambda c: F.transform(F.sort_array(c), lambda x: x["v"])
    found = F.col("found").isNotNull()
    wide = found & (F.col("last") - F.col("first") + 1 > broad)
    first = F.row_number().over(Window.partitionBy("qid", "key").orderBy("s", "n")) == 1
    cites = cites.withColumn("is_first", first).withColumn("support", support)
    per_answer = cites.groupBy("qid").agg(
        F.count("*").alias("n_citations"), values(at(F.col("key"), ~found & F.col("is_first"))).alias("invalid"),
        values(at(F.col("key"), wide)).alias("broad"), values(at((F.col("last") - F.col("first") + 1).cast("int"))).alias("widths"),
    )
    per_sentence = cites.groupBy("qid", "s").agg(values(at(F.col("key"))).alias("keys"), F.transform(F.sort_array(F.collect_list(F.when(found, F.struct("n", F.col("support").alias("v"))))), lambda x: x["v"]).alias("supports"))
    claims = said.filter(F.size("names") > 0).join(per_sentence, ["qid", "s"], "left")
    joined = F.array_join("supports", "\n")
    missing = F.filter("names", lambda n: (F.size("supports") > 0) & ~F.contains(joined, n))
    unsupported = F.when(F.col("keys").isNotNull(), F.transform(missing, lambda n: F.concat(n, F.lit(" @ "), F.array_join("keys", ", "))))
    snippet = F.concat(F.substring("sentence", 1, SNIPPET), F.when(F.length("sentence") > SNIPPET, "…").otherwise(""))
    claims = claims.select("qid", "s", "keys", unsupported.alias("u"), F.when(F.col("keys").isNull(), F.array(snippet)).alias("b"))
    lists = lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("s", F.col(c).alias("v"))))), lambda x: x["v"]))
    per_claim = claims.groupBy("qid").agg(F.count("*").alias("n_claims"), F.count("keys").alias("cited_claims"), lists("u").alias("unsupported"), lists("b").alias("uncited"))
    rows = answers.select("qid", T.is_refusal("text").alias("_no")).join(per_answer, "qid", "left").join(per_claim, "qid", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0)
    rows = rows.select(
        "qid", F.coalesce("n_citations", zero).cast("int").alias("n_citations"), F.coalesce("invalid", none).alias("invalid"), F.coalesce("n_claims", zero).cast("int").alias("n_claims"),
        F.coalesce("cited_claims", zero).cast("int").alias("cited_claims"), F.coalesce("unsupported", none).alias("unsupported"), F.coalesce("uncited", none).alias("uncited"),
        F.coalesce("broad", none).alias("broad"), F.coalesce("widths", F.array().cast("array<int>")).alias("widths"), "_no",
    )
    rows = rows.withColumn("refusal", (F.col("n_citations") == 0) & (F.col("n_claims") == 0) & F.col("_no")).drop("_no")
    penalty = 3 * F.size("invalid") + 2 * F.size("unsupported") + F.size("uncited") + F.when(F.col("n_citations") == 0, 3).otherwise(0)
    rows = rows.withColumn("penalty", F.when(F.col("refusal"), 0).otherwise(penalty)).withColumn("ok", F.col("penalty") == 0)
    width = F.aggregate("widths", F.lit(0), lambda a, x: a + x) / F.size("widths")
    return rows.withColumn("mean_width", F.when(F.size("widths") > 0, width))


def problems(reports: DataFrame) -> DataFrame:
    """(qid, problems): what a repair turn is told."""
    parts = [
        F.transform("invalid", lambda c: F.concat(c, F.lit(" lies in none of the excerpts that you were shown"))),
        F.transform("unsupported", lambda u: F.concat(F.lit("`"), F.element_at(F.split(u, " @ "), 1), F.lit("` does not occur in the lines that you cite ("), F.element_at(F.split(u, " @ "), 2), F.lit(")"))),
        F.transform("uncited", lambda s: F.concat(F.lit('this claim cites nothing: "'), s, F.lit('"'))),
        F.when((F.col("n_citations") == 0) & ~F.col("refusal"), F.array(F.lit("the answer cites no [path:start-end] at all"))).otherwise(F.array().cast("array<string>")),
    ]
    return reports.select("qid", F.concat(*parts).alias("problems"))


def choose_repairs(drafts: DataFrame, revisions: DataFrame) -> DataFrame:
    """(qid, repaired): whether the revision's report is better than the draft's.

    It is with a strictly smaller penalty, unless it gives up where the draft had evidence: citations of which some are valid.
    A draft without a revision (a failed call) stays.
    """
    had = (F.col("d.n_citations") > F.size("d.invalid")).alias("had")
    both = drafts.alias("d").join(revisions.alias("r"), "qid", "left").select("qid", F.col("d.penalty").alias("old"), F.col("r.penalty").alias("new"), F.col("r.refusal").alias("gave_up"), had)
    better = F.col("new").isNotNull() & ~(F.col("gave_up") & F.col("had")) & (F.col("new") < F.col("old"))
    return both.select("qid", F.coalesce(better, F.lit(False)).alias("repaired"))
