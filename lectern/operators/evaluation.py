"""Retrieval evaluation: expected pages, hits, coverage, summaries, run comparison and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUT = 26


def page_range(page: Column) -> Column:
    """Pages of struct(pdf, pdf_from, pdf_to): one page or an inclusive range; null if both or neither is given."""
    one, many = page["pdf"].isNotNull(), page["pdf_from"].isNotNull() & page["pdf_to"].isNotNull()
    return F.when(one & page["pdf_from"].isNull() & page["pdf_to"].isNull(), F.array(page["pdf"])).when(
        ~one & many & (page["pdf_from"] <= page["pdf_to"]), F.sequence(page["pdf_from"], page["pdf_to"])
    )


def scoreable(records: DataFrame, indexed: DataFrame, statuses: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    """records -> (qid, book, work, page): confirmed, present pages of indexed books of answerable questions of a status."""
    items = records.where(~F.col("expect_not_found") & F.col("status").isin(*statuses)).select("id", F.posexplode("evidence").alias("pos", "e"))
    held = items.where("e.state = 'confirmed'").join(indexed.select(F.col("book").alias("_b")).distinct(), F.col("e.book") == F.col("_b"), "left_semi")
    pages = held.select("id", "pos", F.col("e.book").alias("book"), F.col("e.work").alias("work"), F.explode("e.pages").alias("p")).where("p.text != 'missing'")
    first = F.first("work").over(Window.partitionBy("id", "book").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return pages.select(F.col("id").alias("qid"), "book", first.alias("work"), F.explode(page_range(F.col("p"))).alias("page")).distinct()


def mark_hits(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """results (qid, rank, book, pdf_start, pdf_end) -> with hit and the work hit: any page of the range is expected.

    Ranges are written out as pages, so that the range join is an equi-join.
    """
    pages = results.select("qid", "rank", "book", F.explode(F.sequence("pdf_start", "pdf_end")).alias("page"))
    found = pages.join(evidence.select("qid", "book", "page", "work"), ["qid", "book", "page"]).groupBy("qid", "rank").agg(F.min("work").alias("hit_work"))
    return results.join(found, ["qid", "rank"], "left").withColumn("hit", F.col("hit_work").isNotNull())


def score_questions(marked: DataFrame, evidence: DataFrame, cut: int = CUT) -> DataFrame:
    """One row for each question with evidence: hits at 5, 10 and ``cut``, first hit, works expected and covered."""
    within = lambda k: F.max(F.col("hit") & (F.col("rank") <= k))
    scores = marked.groupBy("qid").agg(
        within(5).alias("hit5"),
        within(10).alias("hit10"),
        within(cut).alias("hit_cut"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit_rank"),
        F.count_distinct(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("hit_work"))).alias("works_covered10"),
    )
    works = evidence.groupBy("qid").agg(F.count_distinct("work").alias("works"))
    no = {c: F.coalesce(c, F.lit(False)) for c in ("hit5", "hit10", "hit_cut")}
    return works.join(scores, "qid", "left").withColumns(no | {"works_covered10": F.coalesce("works_covered10", F.lit(0).cast("bigint"))})


def hits_by_dimension(scored: DataFrame, dimensions: list[str]) -> DataFrame:
    """Hit@5 by each dimension on its own and over all, in one pass of grouping sets: (dimension, value, n, hit5)."""
    sets = [[], *[[d] for d in dimensions]]
    columns = [F.col(d) for d in dimensions]
    name = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions], F.lit("all"))
    value = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dimensions])
    grouped = scored.groupingSets([[F.col(d) for d in s] for s in sets], *columns)
    return grouped.agg(name.alias("dimension"), value.alias("value"), F.count("*").alias("n"), F.sum(F.col("hit5").cast("bigint")).alias("hit5")).select("dimension", "value", "n", "hit5")


def spread(value: str) -> list[Column]:
    """n, least, median and largest of a column, to 4 decimals; only n is set for no values."""
    return [F.count(value).alias("n"), F.bround(F.min(value), 4).alias("min"), F.bround(F.median(value), 4).alias("median"), F.bround(F.max(value), 4).alias("max")]


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Two runs (qid, scored, hit5) -> (qid, change): lost, gained, only_baseline or only_candidate."""
    a, b = (r.where("scored").select("qid", F.col("hit5").alias(n)) for r, n in ((baseline, "before"), (candidate, "after")))
    both = a.join(b, "qid", "full_outer")
    change = (
        F.when(F.col("before").isNull(), F.lit("only_candidate"))
        .when(F.col("after").isNull(), F.lit("only_baseline"))
        .when(F.col("before") & ~F.col("after"), F.lit("lost"))
        .when(~F.col("before") & F.col("after"), F.lit("gained"))
    )
    return both.select("qid", change.alias("change")).where("change is not null")


def run_gate(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: hits before and after, and whether the candidate passes (its hits at 5 don't drop)."""
    hits = lambda r, n: r.where("scored").agg(F.coalesce(F.sum(F.col("hit5").cast("bigint")), F.lit(0).cast("bigint")).alias(n))
    return hits(baseline, "before").join(F.broadcast(hits(candidate, "after"))).withColumn("passed", F.expr("after >= before"))


def cohort_gate(run: DataFrame, cohort: DataFrame, overall: int, within: int) -> DataFrame:
    """Counts of a run (qid, hit5, hit10) overall and within a cohort (qid), and whether both floors of Hit@10 hold."""
    marked = run.join(cohort.select("qid", F.lit(True).alias("inside")), "qid", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    sums = marked.agg(
        F.count("*").alias("n"),
        F.count_if("hit5").alias("hit5"),
        F.count_if("hit10").alias("hit10"),
        F.count_if("inside").alias("cohort_n"),
        F.count_if(F.col("inside") & F.col("hit5")).alias("cohort_hit5"),
        F.count_if(F.col("inside") & F.col("hit10")).alias("cohort_hit10"),
    )
    return sums.withColumn("passed", (F.col("hit10") >= overall) & (F.col("cohort_hit10") >= within))


def served_totals(logged: DataFrame, evidence: DataFrame) -> DataFrame:
    """logged candidates (qid, rank, book, pdf_start, pdf_end, grade, in_scope) -> totals of served questions.

    A question none of whose candidates has been graded can't be scored; outside the sources
    the answer is right if no candidate was graded true.
    """
    marked = mark_hits(logged, evidence)
    each = marked.groupBy("qid", "in_scope").agg(
        F.max("hit").alias("returned"),
        F.max(F.col("hit") & F.coalesce("grade", F.lit(False))).alias("passed"),
        F.max(F.col("hit") & (F.col("rank") <= 10)).alias("hit10"),
        F.max(F.coalesce("grade", F.lit(False))).alias("any_true"),
        F.count("grade").alias("graded"),
        F.count_if(F.col("grade").isNull()).alias("ungraded"),
    )
    scored = F.col("in_scope") & (F.col("graded") > 0)
    return each.agg(
        F.count_if(scored).alias("n"),
        F.count_if(scored & F.col("returned")).alias("returned"),
        F.count_if(scored & F.col("passed")).alias("passed"),
        F.count_if(scored & F.col("hit10")).alias("hit10"),
        F.count_if(F.col("graded") == 0).alias("unscorable"),
        F.count_if(~F.col("in_scope") & (F.col("graded") > 0) & ~F.col("any_true")).alias("correct_not_found"),
        F.coalesce(F.sum("ungraded"), F.lit(0).cast("bigint")).alias("ungraded"),
    )


def run_counts(records: DataFrame, quarantine: DataFrame, scored: DataFrame, statuses: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    """One row: what an evaluation read, kept, retrieved, scored and skipped; set_version is the largest of all records.

    A question is skipped if it should be answerable and nothing of it can be scored: for
    its status, or else for want of evidence.
    """
    done = records.join(scored.select(F.col("qid").alias("id"), F.lit(True).alias("done")).distinct(), "id", "left")
    active, open_ = F.col("status") != "retired", F.col("done").isNull()
    skipped = active & ~F.col("expect_not_found") & open_
    sums = done.agg(
        F.count("*").alias("records"),
        F.max("set_version").alias("set_version"),
        F.count_if(~active).alias("retired"),
        F.count_if(active).alias("retrieved"),
        F.count_if(active & ~F.col("expect_not_found")).alias("answerable"),
        F.count_if(active & F.col("expect_not_found")).alias("not_found"),
        F.count_if(active & ~open_).alias("scored"),
        F.count_if(skipped & ~F.col("status").isin(*statuses)).alias("skipped_status"),
        F.count_if(skipped & F.col("status").isin(*statuses)).alias("skipped_evidence"),
    )
    bad = quarantine.agg(F.count("*").alias("malformed"))
    return sums.join(F.broadcast(bad)).withColumn("read", F.col("records") + F.col("malformed")).drop("records")


def active(records: DataFrame) -> DataFrame:
    """Records that are not retired; none left is an error."""
    found = records.where(F.col("status") != "retired")
    if found.isEmpty():
        raise ValueError("the set has no active record")
    return found


def first_asked(records: DataFrame, n: int = 20) -> DataFrame:
    """The first n records (line, ...) in the order of their file; timings are taken over these."""
    return records.orderBy("line").limit(n)


def same_ids(a: DataFrame, b: DataFrame, key: str = "qid") -> bool:
    """Whether two tables have the same set of ids."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "full").agg(F.count("*")).first()[0] == a.select(key).distinct().join(b.select(key), key, "left_semi").count()


def held_in(part: DataFrame, whole: DataFrame, key: str = "qid") -> bool:
    """Whether every id of part is in whole."""
    return part.select(key).join(whole.select(key), key, "left_anti").isEmpty()


def figure_gate(baseline: DataFrame, candidate: DataFrame, cohort: DataFrame, overall: int, within: int) -> DataFrame:
    """Two runs (qid, hit5, hit10) of the same questions and a cohort (qid) of them -> one row for each run: counts, floors, passed.

    Runs of other questions, or a cohort that isn't part of them, are errors, and so is a
    baseline that misses its own floors.
    """
    if not same_ids(baseline, candidate) or not held_in(cohort, baseline):
        raise ValueError("both runs need the same questions, and the cohort among them")
    rows = cohort_gate(baseline, cohort, overall, within).withColumn("run", F.lit("baseline"))
    if not rows.first()["passed"]:
        raise ValueError("the baseline misses its own floors")
    return rows.unionByName(cohort_gate(candidate, cohort, overall, within).withColumn("run", F.lit("candidate")))


def write_run(scored: DataFrame, path: str, kind: str, purpose: str, set_version: int, roles: bool = False, version: int = 1) -> None:
    """A run as JSON lines: ids and numbers only, with what it was made by; a path that exists is an error."""
    kept = [f.name for f in scored.schema.fields if f.name == "qid" or f.dataType.typeName() != "string"]
    about = {"kind": kind, "format": version, "purpose": purpose, "set_version": set_version, "roles": roles}
    scored.select(*kept).withColumns({k: F.lit(v) for k, v in about.items()}).write.mode("errorifexists").json(path)
