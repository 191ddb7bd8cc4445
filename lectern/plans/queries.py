"""The queries of the library's own operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, evaluation, labels, layout, navigation, passages, quality, retrieval, store
from ..sources import files
from .inputs import BOOK, EVERY, LINES, NODES, book_of, index_nodes, lines, questions, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def topk_sql(nodes: str, kinds: str, dimensions: str = "e") -> str:
    return f"""
n as ({nodes}),
s as (
  select q.id as qid, q.label as q_label, i.id, i.label, round(list_cosine_similarity(q.{dimensions}, i.{dimensions}), 9) as score
  from n q, n i where q.id % {EVERY} = 0 and q.id != i.id and {kinds}),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s)"""


SEARCHED = "i.kind in ('content', 'summary', 'glossary')"


@query(f"with {topk_sql(NODES, 'true')} select qid, id, rank, round(score, 6) as score from r where rank <= 10")
def vector_topk(spark, sf_dir):
    nodes = index_nodes(spark, sf_dir)
    return retrieval.search(questions(nodes), nodes, kinds=None, skip_same_id=True).withColumn("score", F.round("score", 6))


@query(f"with {topk_sql(NODES, SEARCHED)} select qid, id, rank, round(score, 6) as score from r where rank <= 10")
def vector_topk_kind_filter(spark, sf_dir):
    nodes = index_nodes(spark, sf_dir)
    return retrieval.search(questions(nodes), nodes, skip_same_id=True).withColumn("score", F.round("score", 6))


def _scored(spark, sf_dir, dimensions=None):
    """Top 26 of every question as pages of books, with the rows of its label as expected pages and label mod 3 as work."""
    nodes = index_nodes(spark, sf_dir, dimensions)
    asked = questions(nodes)
    found = retrieval.search(asked, nodes, k=evaluation.CUT, skip_same_id=True)
    results = found.join(nodes.select("id", "book_id"), "id").select("qid", "rank", F.col("book_id").alias("book"), F.col("id").alias("pdf_start"), (F.col("id") + 1).alias("pdf_end"))
    near = asked.select("qid", F.explode(F.array("label", (F.col("label") + 1) % 10)).alias("label"))
    evidence = near.join(nodes, "label").select("qid", F.col("book_id").alias("book"), F.col("id").alias("page"), (F.col("label") % 3).alias("work"))
    return evaluation.score_questions(evaluation.mark_hits(results, evidence), evidence), asked


def scored_sql(name: str, dimensions: str) -> str:
    return f"""
{name}_n as ({NODES.replace('embedding::double[] as e', f'{dimensions} as e')}),
{name}_s as (
  select q.id as qid, i.id, i.book_id, round(list_cosine_similarity(q.e, i.e), 9) as score
  from {name}_n q, {name}_n i where q.id % {EVERY} = 0 and q.id != i.id and {SEARCHED}),
{name}_r as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from {name}_s) where rank <= 26),
{name}_e as (
  select q.id as qid, i.book_id, i.id as page, i.label % 3 as work from {name}_n q join {name}_n i on i.label in (q.label, (q.label + 1) % 10) where q.id % {EVERY} = 0),
{name}_h as (select r.qid, rank, min(work) as work from {name}_r r join {name}_e e on r.qid = e.qid and r.book_id = e.book_id and page between id and id + 1 group by r.qid, rank),
{name}_w as (select qid, count(distinct work) as works from {name}_e group by qid),
{name} as (
  select w.qid, works, coalesce(bool_or(rank <= 5), false) as hit5, coalesce(bool_or(rank <= 10), false) as hit10, coalesce(bool_or(rank <= 26), false) as hit_cut,
    min(rank) as first_hit_rank, count(distinct case when rank <= 10 then work end) as works_covered10
  from {name}_w w left join {name}_h h using (qid) group by w.qid, works)"""


WHOLE, SHORT = scored_sql("a", "embedding::double[]"), scored_sql("b", "embedding[1:16]::double[]")


@query(f"with {WHOLE} select * from a")
def hit_at_k(spark, sf_dir):
    return _scored(spark, sf_dir)[0]


@query(
    f"""with {WHOLE},
q as (select a.hit5, cast(vec_id % 4 as varchar) as type, cast(label as varchar) as subject, a.works from a join embeddings on vec_id = qid)
select case when grouping(type) = 0 then 'type' when grouping(subject) = 0 then 'subject' else 'all' end as dimension,
  coalesce(type, subject) as value, count(*) as n, cast(sum(hit5::int) as bigint) as hit5
from q group by grouping sets ((), (type), (subject))"""
)
def eval_summary_by_dimension(spark, sf_dir):
    scored, asked = _scored(spark, sf_dir)
    named = scored.join(asked.select("qid", (F.col("qid") % 4).alias("type"), F.col("label").alias("subject")), "qid")
    return evaluation.hits_by_dimension(named, ["type", "subject"])


@query(
    f"""with {WHOLE}, c as (select works_covered10 / works as coverage, first_hit_rank from a where works >= 2)
select count(*) as n, round(avg(coverage), 4) as coverage, count(first_hit_rank) as ranked, round(median(first_hit_rank), 4) as median_rank, max(first_hit_rank) as last_rank from c"""
)
def work_coverage(spark, sf_dir):
    several = _scored(spark, sf_dir)[0].where("works >= 2")
    return several.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("works_covered10") / F.col("works")), 4).alias("coverage"),
        F.count("first_hit_rank").alias("ranked"),
        F.round(F.median("first_hit_rank"), 4).alias("median_rank"),
        F.max("first_hit_rank").alias("last_rank"),
    )


@query(
    f"""with {WHOLE}, {SHORT}
select a.qid, case when a.hit5 then 'lost' else 'gained' end as change from a join b using (qid) where a.hit5 != b.hit5"""
)
def run_compare(spark, sf_dir):
    runs = [_scored(spark, sf_dir, d)[0].withColumn("scored", F.lit(True)) for d in (None, 16)]
    return evaluation.compare_runs(*runs)


@query(f"with {WHOLE}, {SHORT}, x as (select cast(sum(a.hit5::int) as bigint) as before, cast(sum(b.hit5::int) as bigint) as after from a join b using (qid)) select *, after >= before as passed from x")
def run_compare_gate(spark, sf_dir):
    runs = [_scored(spark, sf_dir, d)[0].withColumn("scored", F.lit(True)) for d in (None, 16)]
    return evaluation.run_gate(*runs)


@query(
    f"""with {WHOLE}, c as (select *, qid % 200 = 0 as inside from a)
select count(*) as n, count_if(hit5) as hit5, count_if(hit10) as hit10, count_if(inside) as cohort_n, count_if(inside and hit5) as cohort_hit5,
  count_if(inside and hit10) as cohort_hit10, count_if(hit10) >= 2 and count_if(inside and hit10) >= 1 as passed from c"""
)
def cohort_gate(spark, sf_dir):
    run = _scored(spark, sf_dir)[0]
    return evaluation.cohort_gate(run, run.where("qid % 200 = 0").select("qid"), 2, 1)


@query(
    f"""with {topk_sql(NODES, SEARCHED)},
c as (select r.qid, 'b' || r.label as book_id, rank, case when r.id % 7 = 0 then null else score end as score, r.id,
  case when r.id % 5 = 0 then null else r.id % 5 != 1 end as flag, case r.label % 3 when 0 then 'English' when 1 then 'es' else 'fr' end as language
  from r where rank <= 26),
p as (select *, max(score) over (partition by qid, book_id) as best, min(rank) over (partition by qid, book_id) as pos from c where flag)
select qid, book_id, id, rank, round(score, 6) as score,
  row_number() over (partition by qid order by best desc nulls last, pos, score desc nulls last, rank) as number, language != 'English' as translation_available from p"""
)
def evidence_group_number(spark, sf_dir):
    nodes = index_nodes(spark, sf_dir)
    found = retrieval.search(questions(nodes), nodes, k=26, skip_same_id=True).join(nodes.select("id", "book_id", "label"), "id")
    flag = F.when(F.col("id") % 5 != 0, F.col("id") % 5 != 1)
    language = F.when(F.col("label") % 3 == 0, "English").when(F.col("label") % 3 == 1, "es").otherwise("fr")
    score = F.when(F.col("id") % 7 != 0, F.col("score"))
    candidates = found.select("qid", "book_id", "id", "rank", score.alias("score"), flag.alias("flag"), language.alias("language"))
    return retrieval.group_evidence(candidates).select("qid", "book_id", "id", "rank", F.round("score", 6).alias("score"), "number", "translation_available")


@query(
    f"""with {topk_sql(NODES, "i.kind != 'exercise'")},
p as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s join n using (id) where n.kind in ('content', 'summary', 'glossary')),
f as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from s join n using (id) where n.kind = 'figure'),
fig as (select id, row_number() over (order by id) - 1 as k, count(*) over () as m from n where kind = 'figure'),
l as (select qid, fig.id, p.rank as passage_rank, x as pos, score from p, (select unnest([0, 1]) as x), fig where p.rank <= 26 and fig.k = (p.id + x) % fig.m),
t as (select qid, id, case when rank <= 2 then 0 else 2 end as tier, rank as a, 0 as b, score, 'direct' as origin from f where rank <= 4
  union all select qid, id, 1, passage_rank, pos, score, 'linked' from l),
u as (select *, row_number() over (partition by qid, id order by tier, a, b, id) as k from t),
v as (select *, row_number() over (partition by qid order by tier, a, b, id) as position from u where k = 1)
select qid, id, position, round(score, 6) as score, origin from v where position <= 4"""
)
def figure_budget_merge(spark, sf_dir):
    nodes = index_nodes(spark, sf_dir)
    asked = questions(nodes)
    found = retrieval.search(asked, nodes, k=26, skip_same_id=True)
    direct = retrieval.search(asked, nodes, k=4, kinds=("figure",), skip_same_id=True)
    figures = nodes.where("kind = 'figure'").select("id")
    ordered = figures.select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("k"))  # the figures of one index
    n = figures.count()
    said = found.select("qid", "rank", "score", F.posexplode(F.array(F.pmod("id", F.lit(n)), F.pmod(F.col("id") + 1, F.lit(n)))).alias("pos", "k"))
    linked = said.join(ordered, "k").select("qid", "id", F.col("rank").alias("passage_rank"), "pos", "score")
    return retrieval.figure_budget(direct, linked).withColumn("score", F.round("score", 6))


IDS = """sha256('["' || book_id || '", [' || pdf_page || ', ' || pdf_page || '], ' || '"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(9), chr(92) || 't'), chr(13), chr(92) || 'r') || '"' || ']')"""


@query(f"with l as ({LINES}) select book_id, pdf_page, cast(pos as integer) as pos, {IDS} as id from l where trim(text) != ''")
def passage_id_sha(spark, sf_dir):
    rows = lines(spark, sf_dir).where(F.trim("text") != "")
    page = F.col("pdf_page")
    return rows.select("book_id", "pdf_page", "pos", T.passage_id(F.col("book_id"), page, page, F.col("text")).alias("id"))


@query(
    f"""with l as ({LINES})
select book_id, pdf_page, count(*) as n_passages, cast(sum(length(text)) as bigint) as chars, book_id || ': pdf page ' || pdf_page || ' <print page unknown: no-header-number>' as label
from l where trim(text) != '' group by book_id, pdf_page"""
)
def passages_from_documents(spark, sf_dir):
    none = F.lit(None).cast("string")
    rows = lines(spark, sf_dir).where(F.trim("text") != "").groupBy("book_id", "pdf_page").agg(F.count("*").alias("n_passages"), F.sum(F.length("text")).alias("chars"))
    page = F.col("pdf_page")
    return rows.withColumn("label", T.passage_label(F.col("book_id"), page, page, none, none, F.lit("no-header-number")))


@query(
    """with c as (select conv_id, turn, role, text, turn // 2 as s, lag(turn // 2) over w as r0, lead(turn // 2) over w as r1, lag(turn) over w as t0, lead(turn) over w as t1, lag(text) over w as x0, lead(text) over w as x1
  from conversations window w as (partition by conv_id order by turn)),
e as (select conv_id || '-' || turn as id, 'before' as side, conv_id || '-' || t0 as neighbour, x0 as text from c where r0 = s
  union all select conv_id || '-' || turn, 'after', conv_id || '-' || t1, x1 from c where r1 = s),
w as (select *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x != '') as ws from e)
select id, side, neighbour, case when len(ws) > 120 then array_to_string(ws[1:120], ' ') else text end as text, len(ws) > 120 as truncated from w"""
)
def neighbours_capped(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.array(F.floor(F.col("turn") / 2)).alias("section_path"), "text"
    )
    return retrieval.neighbour_texts(rows.select("id"), rows)


@query(
    f"""with l as (select *, row_number() over (partition by book_id order by pdf_page, pos) as ord from (select * replace (case when pdf_page % 2 = 0 then lower(regexp_replace(text, '[.]+$', '')) else text end as text) from ({LINES})) where trim(text) != ''),
p as (select *, lag(text) over w as t0, lag(pdf_page) over w as p0 from l window w as (partition by book_id order by ord)),
f as (select *, case when p0 < pdf_page and not regexp_matches(t0, '[.!?…][\\s"''’”)\\]]*$') and (regexp_matches(text, '^\\p{{Ll}}') or regexp_matches(t0, '[\\pL][-­]$')) then 0 else 1 end as fresh from p),
i as (select *, sum(fresh) over (partition by book_id order by ord) as island from f)
select book_id, cast(island as integer) as ord, cast(min(pdf_page) as integer) as pdf_start, cast(max(pdf_page) as integer) as pdf_end, cast(count(*) as integer) as n_parts,
  sum(length(trim(text, chr(32) || chr(9)))) > 0 as some from i group by book_id, island"""
)
def cross_page_join(spark, sf_dir):
    w = Window.partitionBy("book_id").orderBy("pdf_page", "pos")
    """Lines of even documents are put in lower case without their full stop, so that some run on."""
    text = F.when(F.col("pdf_page") % 2 == 0, F.lower(F.regexp_replace("text", "[.]+$", ""))).otherwise(F.col("text"))
    rows = lines(spark, sf_dir).withColumn("text", text).where(F.trim("text") != "").withColumn("ord", F.row_number().over(w))
    ready = rows.select("book_id", "ord", F.col("pdf_page").alias("pdf_start"), F.col("pdf_page").alias("pdf_end"), F.array("book_id").alias("section_path"), F.lit("content").alias("kind"), "text", F.lit(False).alias("ocr"), F.lit(False).alias("check_page"))
    joined = passages.join_across_pages(ready)
    return joined.select("book_id", "ord", "pdf_start", "pdf_end", "n_parts", (F.length("text") > 0).alias("some"))


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id, row_number() over (partition by source, doc_id // {BOOK} order by doc_id) as page from documents),
c as (select book_id, doc_id, page, case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then page + 5 else page + 10 end as v from d),
s as (select *, lag(v, 1) over w as b1, lag(v, 2) over w as b2, lead(v, 1) over w as a1, lead(v, 2) over w as a2 from c window w as (partition by book_id order by page)),
g as (select *, coalesce(b1 = v - 1, false) or coalesce(a1 = v + 1, false) or (b1 is null and coalesce(b2 = v - 2, false)) or (a1 is null and coalesce(a2 = v + 2, false)) as good from s),
r as (select *, case when good and v is not null then v end as got from g),
i as (select *, lag(got) over w as g0, lead(got) over w as g1 from r window w as (partition by book_id order by page))
select book_id, cast(page as integer) as pdf_page,
  case when got is not null then cast(got as varchar) when v is null and g1 - g0 = 2 then cast(g0 + 1 as varchar) end as printed,
  case when got is not null then 'read' when v is null and g1 - g0 = 2 then 'inferred' else 'none' end as method,
  case when got is not null or (v is null and g1 - g0 = 2) then null when v is not null then 'out-of-sequence' else 'no-header-number' end as reason from i"""
)
def printed_pages(spark, sf_dir):
    w = Window.partitionBy("book_id").orderBy("doc_id")
    rows = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), "doc_id").withColumn("pdf_page", F.row_number().over(w))
    shown = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, F.col("pdf_page") + 5).otherwise(F.col("pdf_page") + 10).cast("string")
    number = T.printed_number(shown)
    one = F.when(number.isNotNull(), F.array(F.struct(number["kind"].alias("kind"), number["value"].alias("value"), shown.alias("text")))).otherwise(F.array().cast(passages.CANDIDATES))
    return passages.printed_pages(rows.withColumn("candidates", one)).select("book_id", "pdf_page", "printed", "method", "reason")


NONWORDS = """
t as (select *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v ]+'), lambda x: x != '' and not regexp_matches(x, '[0-9]')) as ws from documents),
u as (select *, list_transform(ws, lambda x: trim(x, '.,;:!?()[]{}"''')) as bs from t),
v as (select *, len(bs) as n, len(list_filter(bs, lambda b: not (length(regexp_replace(b, '[^\\pL]', '', 'g')) >= 2
  and length(regexp_replace(b, '[^\\pL]', '', 'g')) * 10 >= length(b) * 7 and regexp_matches(b, '[aeiouyáéíóúüAEIOUYÁÉÍÓÚÜ]')))) as bad from u)"""


@query(f"with {NONWORDS} select doc_id, cast(n as integer) as n, cast(bad as integer) as bad from v")
def nonword_rules(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.nonwords(F.col("text")).alias("q")).select("doc_id", "q.n", "q.bad")


def _readings(spark, sf_dir):
    none, far = F.array().cast("array<struct<kind:string,value:int>>"), F.array().cast("array<struct<offset:int,candidates:array<struct<kind:string,value:int>>>>")
    docs = table(spark, sf_dir, "documents")
    finish = F.when(F.col("doc_id") % 17 == 0, "length").when(F.col("doc_id") % 19 == 0, "timeout").otherwise("stop")
    source = F.when(F.col("doc_id") % 3 == 0, "ocr").when(F.col("doc_id") % 3 == 1, "inherited-ocr").otherwise("born-digital")
    rules = T.failed_rules(F.col("text"), source, F.lit(True), finish, F.lit("en"), F.col("lang"), none, far)
    return docs.select(book_of().alias("book_id"), F.col("doc_id").alias("pdf_page"), rules.alias("rules_failed"), T.nonwords(F.col("text")).alias("q"))


RULES = f"""{NONWORDS},
k as (select *, doc_id % 3 < 2 as o, doc_id % 3 = 0 as own from v),
x as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id as pdf_page, n, bad, list_filter([
  case when own and doc_id % 17 = 0 then 'token-limit' end, case when own and doc_id % 17 != 0 and doc_id % 19 = 0 then 'page-timeout' end,
  case when length(trim(text)) < 40 then 'empty-ink' end, case when o and length(text) >= 1000 and lang != 'en' then 'language' end,
  case when o and n >= 50 and bad / n > 0.5 then 'nonwords' end, case when o then 'number-missing' end], lambda r: r is not null) as rules from k)"""


@query(f"with {RULES} select book_id, pdf_page, array_to_string(rules, ',') as rules from x where len(rules) > 0 and pdf_page not in (select doc_id from labels)")
def quality_queue(spark, sf_dir):
    solved = table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents"), "doc_id").select(book_of().alias("book_id"), F.col("doc_id").alias("pdf_page"))
    return quality.queue(_readings(spark, sf_dir), solved).select("book_id", "pdf_page", F.array_join("rules_failed", ",").alias("rules"))


@query(f"with {RULES}, r as (select unnest(rules) as reason from x) select reason, count(*) as n from r group by reason")
def quality_reasons(spark, sf_dir):
    return quality.reasons(_readings(spark, sf_dir))


@query(
    f"""with {NONWORDS}, s as (select lang, bad, row_number() over (partition by lang order by bad) - 1 as r, count(*) over (partition by lang) as m from v),
p as (select unnest([0.0, 0.5, 0.9, 0.95, 0.99, 1.0])::double as q)
select lang, q, cast(bad as integer) as value from s, p where r = floor((m - 1) * q)"""
)
def quality_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", T.nonwords(F.col("text"))["bad"].alias("bad"))
    return quality.indexed_quantiles(rows, "bad", ["lang"])


def _mentions(spark, sf_dir):
    """Documents with a sentence of mentions put before the text."""
    said = F.concat(F.lit("See Figure "), (F.col("doc_id") % 9).cast("string"), F.lit("."), (F.col("doc_id") % 4).cast("string"), F.lit(", 3.1 and 3.2; tablas 2-"), (F.col("doc_id") % 5).cast("string"), F.lit(" y 7; pp. "), (F.col("doc_id") % 50).cast("string"), F.lit("-99, chapter 4. "))
    return table(spark, sf_dir, "documents").select(book_of().alias("book_id"), "doc_id", F.concat(said, F.coalesce("text", F.lit(""))).alias("text"))


MENTIONED = f"""
d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id, cast(doc_id % 9 as varchar) || '.' || cast(doc_id % 4 as varchar) as f, '2-' || cast(doc_id % 5 as varchar) as t, cast(doc_id % 50 as varchar) as p from documents),
m as (select book_id, doc_id, unnest([('figure', f, 4), ('figure', '3.1', 16), ('figure', '3.2', 24), ('table', t, 29), ('table', '7', 42), ('page', p, 45), ('chapter', '4', 54 + length(p))]) as r from d)"""


@query(f"with {MENTIONED} select book_id, doc_id, r[1] as kind, r[2] as identifier, cast(r[3] as integer) as start from m")
def references_found(spark, sf_dir):
    found = navigation.find_references(_mentions(spark, sf_dir))
    return found.select("book_id", "doc_id", "kind", "identifier", "start")


def _resolved(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), "doc_id")
    page = F.col("doc_id").cast("int").alias("page")
    figures = docs.where("doc_id % 40 < 9").select("book_id", F.concat((F.col("doc_id") % 9).cast("string"), F.lit("-"), (F.col("doc_id") % 4).cast("string")).alias("identifier"), page, F.concat(F.lit("f"), "doc_id").alias("figure_id"))
    captions = docs.where("doc_id % 60 = 7").select("book_id", F.lit("7").alias("identifier"), page)
    headings = docs.where("doc_id % 100 = 4").select("book_id", F.lit("Chapter 4").alias("title"), F.lit(2).alias("depth"), page)
    printed = docs.where("doc_id % 50 = doc_id % 400").select("book_id", (F.col("doc_id") % 50).cast("string").alias("printed"), page)
    return navigation.resolve(navigation.find_references(_mentions(spark, sf_dir)), navigation.targets(figures, captions, headings, printed))


RESOLVED = f"""{MENTIONED},
g as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id from documents),
k as (select book_id, 'figure' as kind, cast(doc_id % 9 as varchar) || '-' || cast(doc_id % 4 as varchar) as key, doc_id as page, 'f' || doc_id as figure_id from g where doc_id % 40 < 9
  union select book_id, 'table', '7', doc_id, null from g where doc_id % 60 = 7
  union select book_id, 'chapter', '4', doc_id, null from g where doc_id % 100 = 4
  union select book_id, 'page', cast(doc_id % 50 as varchar), doc_id, null from g where doc_id % 50 = doc_id % 400),
o as (select book_id, kind, key, min(page) as target_page, min(figure_id) as figure_id from k group by book_id, kind, key having count(*) = 1),
z as (select m.book_id, doc_id, r[1] as kind, r[2] as identifier, cast(r[3] as integer) as start, cast(target_page as integer) as target_page, figure_id from m left join o on o.book_id = m.book_id and o.kind = r[1] and o.key = replace(r[2], '.', '-'))"""


@query(f"with {RESOLVED} select * from z")
def references_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir).select("book_id", "doc_id", "kind", "identifier", "start", "target_page", "figure_id")


@query(f"with {RESOLVED} select kind, count(target_page) as resolved, count_if(target_page is null) as unresolved from z group by kind")
def reference_counts(spark, sf_dir):
    return navigation.reference_counts(_resolved(spark, sf_dir))


@query(f"with {RESOLVED} select kind, count(*) as n from z where target_page is not null and kind != 'table' group by kind")
def precision_gate(spark, sf_dir):
    checked = [(k, i < good) for k, good in (("figure", 10), ("table", 8), ("page", 9)) for i in range(10)]
    checks = spark.createDataFrame(checked, "kind string, correct boolean")
    kept = navigation.precision_gate(_resolved(spark, sf_dir).where("target_page is not null"), checks)
    return kept.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id from documents)
select book_id, cast(doc_id as integer) as pdf_page, last_value(case when doc_id % 5 = 0 then cast(doc_id // 5 as varchar) end ignore nulls) over (partition by book_id order by doc_id rows unbounded preceding) as path from d"""
)
def breadcrumbs_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), F.col("doc_id").cast("int").alias("pdf_page"), F.when(F.col("doc_id") % 5 == 0, F.floor(F.col("doc_id") / 5).cast("string")).alias("path"))
    return passages.breadcrumbs(rows)


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as b, cast(doc_id % 3 as varchar) as s, lang, doc_id from documents),
p as (select b, [lang] as prefix, doc_id from d union all select b, [lang, s], doc_id from d)
select b as book_id, array_to_string(prefix, '>') as prefix, len(prefix)::integer as depth, min(doc_id) as page from p group by b, prefix"""
)
def contents_prefixes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), F.array("lang", (F.col("doc_id") % 3).cast("string")).alias("path"), F.col("doc_id").alias("page"))
    return passages.path_prefixes(rows).withColumn("prefix", F.array_join("prefix", ">"))


def _ingest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), F.sha2("text", 256).alias("id"), "doc_id")
    return rows, rows.where("doc_id % 2 = 0")


@query(
    """with i as (select sha256(text) as id, doc_id from documents),
g as (select id, count(*) as n, bool_or(doc_id % 2 = 0) as held from i group by id)
select sum(n)::bigint as passages, count(*) as distinct_ids, count_if(held) as present, sum(n)::bigint - count(*) as duplicates, count(*) - count_if(held) as inserted from g"""
)
def ingest_summary(spark, sf_dir):
    return store.ingest_summary(*_ingest(spark, sf_dir))


@query("select distinct sha256(text) as id from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)")
def ingest_insert_missing(spark, sf_dir):
    return store.insert_missing(*_ingest(spark, sf_dir)).select("id")


@query(
    f"""with c as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, sha256(text) as id, doc_id from documents),
i as (select book_id, id, count(*) as n from c group by book_id, id),
s as (select distinct table_name, id from c, (select unnest(['v4', 'v5']) as table_name) where doc_id % (case table_name when 'v4' then 2 else 1 end) = 0),
b as (select book_id, count(*) as ids, cast(sum(n) - count(*) as bigint) as duplicates from i group by book_id),
h as (select table_name, book_id, count(*) as stored from i join s using (id) group by table_name, book_id)
select t.table_name, b.book_id, ids, duplicates, coalesce(stored, 0) as stored, coalesce(stored, 0) = ids as complete
from b cross join (select distinct table_name from s) t left join h on h.table_name = t.table_name and h.book_id = b.book_id"""
)
def index_status(spark, sf_dir):
    rows, half = _ingest(spark, sf_dir)
    stored = half.select(F.lit("v4").alias("table_name"), "id").union(rows.select(F.lit("v5").alias("table_name"), "id"))
    return store.index_status(rows.select("book_id", "id"), stored)


@query(
    """select event_id as id, cast(ts as date) as day, user_id, case when l.doc_id is null then 'unlabelled' when l.toxic = 1 then 'out of the sources' else 'in scope' end as state
from events e left join labels l on l.doc_id = e.event_id where cast(ts as date) between date '2024-01-05' and date '2024-01-12'"""
)
def question_log_filter(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("asked_at"), "user_id")
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("log_id"), (F.col("toxic") == 1).alias("expect_not_found"))
    return labels.log_listing(log, own, "2024-01-05", "2024-01-12").select("id", F.to_date("asked_at").alias("day"), "user_id", "state")


@query(
    """with c as (select o_custkey as qid, l_suppkey as book, cast(l_partkey % 40 as integer) as a, l_linenumber as rank, l_orderkey as o, l_returnflag = 'R' as g, l_returnflag = 'N' as w
  from lineitem join orders on o_orderkey = l_orderkey),
p as (select qid, book, unnest(range(a, a + 3)) as page, cast(o * 10 + rank as bigint) as rank, case when w then 2 when g then 0 else 1 end as tier, g and not w as passed from c),
f as (select *, row_number() over (partition by qid, book, page order by tier, rank, page, book) as n from p)
select qid, book, cast(page as integer) as page, row_number() over (partition by qid order by tier, rank, page, book) as position, passed from f where n = 1"""
)
def suggested_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = (F.col("l_partkey") % 40).cast("int")
    flag = F.col("l_returnflag")
    candidates = rows.select(F.col("o_custkey").alias("qid"), F.col("l_suppkey").alias("book"), start.alias("pdf_start"), (start + 2).alias("pdf_end"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"), (flag == "R").alias("grade"), (flag == "N").alias("wider"))
    return labels.suggested_pages(candidates)


@query(
    """with o as (select o_custkey as log_id, o_orderstatus as book, cast(o_orderkey % 7 as integer) as page, o_orderkey from orders),
l as (select distinct log_id, book, page from o where o_orderkey % 2 = 0),
x as (select log_id, case when log_id % 14 = 0 then 'outside' else 'clear' end as action from (select distinct log_id from o) where log_id % 7 = 0),
k as (select * from l where log_id not in (select log_id from x)),
f as (select * from k where page != 3),
b as (select log_id, book, list_sort(list(distinct page)) as pages from f group by log_id, book)
select log_id, string_agg(book || ':' || array_to_string(pages, ','), ';' order by book) as evidence, false as expect_not_found from b group by log_id
union all select log_id, '' as evidence, true from x where action = 'outside'"""
)
def label_upserts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log_id"), F.col("o_orderstatus").alias("book"), (F.col("o_orderkey") % 7).cast("int").alias("page"), "o_orderkey")
    old = rows.where("o_orderkey % 2 = 0").select("log_id", "book", "page")
    action = F.when(F.col("log_id") % 14 == 0, "outside").otherwise("clear")
    whole = rows.where("log_id % 7 = 0").select("log_id", action.alias("action"), "book", "page").distinct()
    less = rows.where("log_id % 7 != 0 and page = 3").select("log_id", F.lit("remove").alias("action"), "book", "page").distinct()
    records = labels.label_pages(old, whole.unionByName(less))
    written = F.array_join(F.transform("evidence", lambda e: F.concat(e["book"], F.lit(":"), F.array_join(F.transform(e["pages"], lambda p: p.cast("string")), ","))), ";")
    return records.select("log_id", written.alias("evidence"), "expect_not_found")


@query(
    """with t as (select role, conv_id, turn, case role when 'user' then ['Part one', 'Resumen'] when 'assistant' then ['Glo sario', 'Notes'] else ['Índice'] end as path from conversations)
select conv_id, turn, case role when 'user' then 'summary' when 'assistant' then 'glossary' else 'content' end as kind, role not in ('user', 'assistant') as excluded from t"""
)
def passage_kinds(spark, sf_dir):
    path = F.when(F.col("role") == "user", F.array(F.lit("Part one"), F.lit("Resumen"))).when(F.col("role") == "assistant", F.array(F.lit("Glo sario"), F.lit("Notes"))).otherwise(F.array(F.lit("Índice")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.passage_kind(path).alias("kind"), T.excluded_section(path).alias("excluded"))


@query(
    """select p_partkey, 'e_v5r_' || substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_'), 1, 32) || '_' || substr(sha256(p_name), 1, 16) as name, p_partkey % 12 >= 5 as figures from part"""
)
def table_names(spark, sf_dir):
    version = F.concat(F.lit("v"), (F.col("p_partkey") % 12).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.table_name("v5", F.col("p_name"), roles=True).alias("name"), T.version_at_least(version, 5).alias("figures"))


@query(
    f"""with l as ({LINES}), k as (select book_id, pdf_page, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[0-9]+', '#', 'g') as key from l)
select book_id, md5(key) as key, count(distinct pdf_page) as n_pages from k group by book_id, key having count(distinct pdf_page) >= 2"""
)
def repeated_margins(spark, sf_dir):
    return passages.repeated_margins(lines(spark, sf_dir)).withColumn("key", F.md5("key"))


@query(
    """with b as (select l_returnflag as book_id, l_quantity as size, cast(sum(l_linenumber) as bigint) as chars, min(l_orderkey) as pos from lineitem group by l_returnflag, l_quantity)
select book_id, arg_max(size, chars * 1e9 - pos) as body_size from b group by book_id"""
)
def dominant_font(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("book_id"), F.col("l_quantity").alias("size"), F.col("l_linenumber").alias("chars"), F.col("l_orderkey").alias("pos"))
    return passages.dominant_size(rows)


@query(
    """with l as (select l_orderkey as page, l_extendedprice as y0, l_extendedprice + l_quantity as y1 from lineitem),
g as (select page, lead(y0) over (partition by page order by y0, y1) - y1 as gap from l)
select page, round(median(gap), 6) as gap from g where gap is not null group by page"""
)
def line_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("y0"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("y1"))
    return passages.line_gap(rows).withColumn("gap", F.round("gap", 6))


@query(
    """select l_orderkey as page, arg_min(l_linenumber, (case when l_returnflag = 'R' then 100000 else 0 end) + (l_partkey % 3) * 1000 + (case when l_linestatus = 'O' then 100 else 0 end) + l_linenumber) as n
from lineitem where l_returnflag != 'N' group by l_orderkey"""
)
def best_attempts(spark, sf_dir):
    rules = F.slice(F.array(F.lit("nonwords"), F.lit("language")), F.lit(1), (F.col("l_partkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("b").alias("book_id"), F.col("l_orderkey").alias("pdf_page"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("timed_out"),
        rules.alias("rules_failed"), (F.col("l_linestatus") == "O").alias("rotated"), (F.col("l_returnflag") == "N").alias("hinted"), F.lit("").alias("text"),
    )
    return quality.best_attempt(rows).select(F.col("pdf_page").alias("page"), "n")


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, cast(doc_id % 4 as integer) as pdf_page, cast(doc_id % 3 as varchar) as identifier, lang, doc_id from documents)
select doc_id, row_number() over (partition by book_id, pdf_page, identifier, lang order by doc_id) as occurrence from d"""
)
def figure_occurrences(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), (F.col("doc_id") % 4).cast("int").alias("pdf_page"), (F.col("doc_id") % 3).cast("string").alias("identifier"), F.col("lang").alias("text"), F.col("doc_id").alias("ord"))
    return passages.figure_ids(rows).select(F.col("ord").alias("doc_id"), "occurrence")


@query(
    """with s as (select c_custkey, c_acctbal as balance from customer where c_custkey % 2 = 0),
n as (select o_custkey as c_custkey, arg_max(o_totalprice, o_orderkey) as balance from orders group by o_custkey)
select c_custkey, balance from n union all select c_custkey, balance from s where c_custkey not in (select c_custkey from n)"""
)
def upsert_counts(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("balance"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return store.upsert(old, new, ["c_custkey"], "o_orderkey")


@query(
    """with s as (select c_custkey, c_name as text from customer where c_custkey % 2 = 0),
n as (select o_custkey as c_custkey, arg_min(o_orderpriority, o_orderkey) as text from orders group by o_custkey)
select c_custkey, text from s union all select c_custkey, text from n where c_custkey not in (select c_custkey from s)"""
)
def translation_cache(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("text"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("text"), "o_orderkey")
    return store.append_first(old, new, ["c_custkey"], "o_orderkey")


@query(
    """with r as (select conv_id, turn, case when turn % 3 = 0 then ' YES ' when turn % 3 = 1 then 'no' else text end as reply, role from conversations)
select conv_id, turn, case lower(trim(reply)) when 'yes' then true when 'no' then false end as grade, case role when 'user' then 'en' when 'assistant' then 'es' end as code from r"""
)
def grades_parsed(spark, sf_dir):
    reply = F.when(F.col("turn") % 3 == 0, " YES ").when(F.col("turn") % 3 == 1, "no").otherwise(F.col("text"))
    language = F.when(F.col("role") == "user", "English").when(F.col("role") == "assistant", "ES").otherwise("Latin")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_grade(reply).alias("grade"), T.language_code(language).alias("code"))


@query(
    """select doc_id, case when doc_id % 4 = 0 then true else false end as holds from documents"""
)
def answer_validity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    made = (
        F.when(F.col("doc_id") % 4 == 0, F.lit('{"sentences": [{"text": "It is so.", "citations": [1, 3]}]}'))
        .when(F.col("doc_id") % 4 == 1, F.lit('{"sentences": [{"text": "It is so. And so.", "citations": [1]}]}'))
        .when(F.col("doc_id") % 4 == 2, F.lit('{"sentences": [{"text": "It is so.", "citations": [9]}]}'))
        .otherwise(F.lit('{"sentences": [{"text": "It is so.", "citations": [true]}]}'))
    )
    return docs.select("doc_id", answers.answer_holds(answers.answer_of(made), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("holds"))


@query("select doc_id, 3 as n, length(text) as chars, substr(text, 3, 4) as linked from documents where length(text) >= 8")
def link_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 8)
    link = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("x").alias("target"))
    parts = docs.select("doc_id", T.link_segments(F.col("text"), F.array(link(4, 8), link(2, 6))).alias("s"))
    chars = F.aggregate("s", F.lit(0), lambda n, p: n + F.length(p["text"]))
    return parts.select("doc_id", F.size("s").alias("n"), chars.cast("bigint").alias("chars"), F.get("s", F.lit(1))["text"].alias("linked"))


@query()
def eval_quarantine(spark, sf_dir):
    """Every benchmark item as a record, some of them malformed by rule; the quarantine with its reasons."""
    good = '{"id": "q%s", "set_version": 1, "status": "%s", "question": "what", "language": "%s", "expect_not_found": false, "evidence": []}'
    item = F.col("item_id").cast("string")
    made = (
        F.when(F.col("item_id") % 5 == 0, F.format_string(good.replace("%s", "%1$s", 1).replace("%s", "lost", 1).replace("%s", "en"), item))
        .when(F.col("item_id") % 5 == 1, F.lit("{not json"))
        .otherwise(F.format_string(good.replace("%s", "%1$s", 1).replace("%s", "confirmed", 1).replace("%s", "es"), item))
    )
    return files.eval_lines(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), made.alias("value")))[1]


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id, case when doc_id % 3 = 0 then ' ' else lang end as caption, case when doc_id % 4 = 0 then '?' else cast(doc_id as varchar) end as identifier from documents)
select book_id, count(*) as figures, count_if(trim(caption) = '') as captionless, count_if(identifier = '?') as unnumbered from d group by book_id"""
)
def figure_counts(spark, sf_dir):
    caption, identifier = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("lang")), F.when(F.col("doc_id") % 4 == 0, "?").otherwise(F.col("doc_id").cast("string"))
    return layout.figure_counts(table(spark, sf_dir, "documents").select(book_of().alias("book_id"), caption.alias("caption"), identifier.alias("identifier")))


@query(
    f"""with d as (select source || '-' || cast(doc_id // {BOOK} as varchar) as book_id, doc_id, case when doc_id % 5 = 0 then null else cast(doc_id % 50 as varchar) end as printed,
  case when doc_id % 7 = 0 then '' when doc_id % 7 = 1 then '3' else cast(doc_id % 50 as varchar) end as pdf_label from documents),
f as (select book_id, 'method' as what, case when printed is null then 'none' else 'read' end as value from d
  union all select book_id, 'reason', 'no-header-number' from d where printed is null
  union all select book_id, 'source', case when doc_id % 3 = 0 then 'ocr' else 'born-digital' end from d
  union all select book_id, 'label', case when pdf_label = '' then 'absent' when printed is null then 'unverified' when pdf_label = printed then 'agree' else 'disagree' end from d
  union all select book_id, 'passage', case when doc_id % 4 = 1 then 'two pages' else 'other' end from d)
select book_id, what, value, count(*) as n from f group by book_id, what, value"""
)
def extraction_report(spark, sf_dir):
    n = (F.col("doc_id") % 50).cast("string")
    printed = F.when(F.col("doc_id") % 5 != 0, n)
    docs = table(spark, sf_dir, "documents").withColumn("book_id", book_of())
    pages = docs.select(
        "book_id", F.when(printed.isNull(), "none").otherwise("read").alias("method"), F.when(printed.isNull(), "no-header-number").alias("reason"), F.when(F.col("doc_id") % 3 == 0, "ocr").otherwise("born-digital").alias("text_source"),
        F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 7 == 1, "3").otherwise(n).alias("pdf_label"), printed.alias("printed"),
    )
    ranges = docs.select("book_id", F.col("doc_id").alias("pdf_start"), (F.col("doc_id") + F.col("doc_id") % 4).alias("pdf_end"))
    return layout.extraction_report(pages, ranges)


@query()
def reading_loops(spark, sf_dir):
    """Every document with a phrase repeated at its end where the id is even: how much of it a reading keeps."""
    docs = table(spark, sf_dir, "documents")
    read = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" "), F.repeat(F.lit("and so on, "), F.lit(40)))).otherwise(F.col("text"))
    return docs.select("doc_id", F.length("text").alias("chars"), F.length(layout.without_loop(read)).alias("kept"))


@query()
def heading_sections(spark, sf_dir):
    """Lines of every document with the section path that headings among them give."""
    rows = lines(spark, sf_dir).withColumns({"size": F.lit(10.0), "bookmark": F.when(F.col("pos") == 0, F.array(F.concat(F.lit("Chapter "), F.col("pdf_page").cast("string"))))})
    found = layout.sections(rows.select("book_id", "pdf_page", "pos", "text", "size", "bookmark"))
    return found.select("book_id", "pdf_page", "pos", F.array_join("path", " > ").alias("path"))


@query(
    """with r as (select conv_id, turn, case turn % 3 when 0 then true when 1 then false end as grade, case when turn % 2 = 0 then 'A-' else 'a:' end as mark from conversations)
select conv_id, turn, grade, 'prefix:' || mark as kind, cast(turn as integer) as value, mark || cast(turn + 1 as varchar) as next,
  case when turn > 8 then null else cast(turn as varchar) || '/8 (' || cast(cast(round_even(100.0 * turn / 8, 0) as integer) as varchar) || '%)' end as rate from r"""
)
def text_edges(spark, sf_dir):
    """Replies with line ends, numbers with prefixes of both cases and signs, and rates that fall on halves."""
    turn = F.col("turn")
    reply = F.when(turn % 3 == 0, "\n yes\r\n").when(turn % 3 == 1, "\u00a0NO\t").otherwise("yes\nno")
    number = T.printed_number(F.concat(F.lit("\t"), F.when(turn % 2 == 0, "A-").otherwise("a:"), turn.cast("string"), F.lit("\n")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_grade(reply).alias("grade"), number.alias("n"))
    following = T.format_number(F.col("n.kind"), F.col("n.value") + 1, F.lit("A-1"))
    return rows.select("conv_id", "turn", "grade", "n.kind", "n.value", following.alias("next"), F.when(turn <= 8, T.rate_text(turn, F.lit(8))).alias("rate"))


@query(
    f"""with p as (select source || '-' || cast(doc_id // {BOOK} as varchar) as b, doc_id, case when doc_id % 11 != 0 then cast(doc_id % 50 as varchar) end as printed,
  case when doc_id % 22 = 0 then 'hidden' when doc_id % 11 = 0 then 'no-header-number' end as reason from documents),
j as (select s.doc_id as id, p.doc_id as page, p.printed, p.reason, s.doc_id + 12 as last from p s left join p on p.b = s.b and p.doc_id between s.doc_id and s.doc_id + 12 where s.doc_id % 7 = 0),
g as (select id, max(printed) filter (page = id) as a, max(printed) filter (page = last) as z, string_agg(distinct reason, ';' order by reason) as reason from j group by id)
select id, case when reason is null then a end as first, case when reason is null then z end as last, reason from g"""
)
def printed_ranges(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(book_of().alias("book_id"), "doc_id")
    page = F.col("doc_id")
    pages = docs.select("book_id", page.alias("pdf_page"), F.when(page % 11 != 0, (page % 50).cast("string")).alias("printed"), F.when(page % 22 == 0, "hidden").when(page % 11 == 0, "no-header-number").alias("reason"))
    own = docs.where("doc_id % 7 = 0").select(page.alias("id"), "book_id", page.alias("pdf_start"), (page + 12).alias("pdf_end"))
    return passages.printed_ranges(own, pages)


@query()
def reading_order(spark, sf_dir):
    """Line items as blocks of their order's page, some over its full width, with their place in reading order."""
    x0 = (F.col("l_partkey") % 90).cast("double")
    wide = F.when(F.col("l_partkey") % 5 == 0, 80.0).when(F.col("l_partkey") % 3 == 0, 9.0).otherwise(30.0)
    blocks = table(spark, sf_dir, "lineitem").select(F.lit("b").alias("book_id"), F.col("l_orderkey").alias("pdf_page"), F.lit(100.0).alias("width"), x0.alias("x0"), (F.col("l_suppkey") % 30).cast("double").alias("y0"), (x0 + wide).alias("x1"), "l_linenumber")
    return layout.reading_order(blocks).select("pdf_page", "l_linenumber", "ord")
