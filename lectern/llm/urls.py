"""URL filters: host suffixes and path prefixes joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: Hex digits of a digest on which expressions and rules meet; the full digest decides.
SHORT = 8
#: Up to so many rules are broadcast; more are joined by shuffle.
BROADCAST_RULES = 10_000
#: Parts into which the pages that ask for one rule are dealt in that shuffle; every rule goes to each.
SALTS = 16


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepared(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> with labels, path_chars, digest, short, rank; of equal rules block wins.

    Null hosts or paths are empty; hosts are lower-cased (A-Z).
    """
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    one = rules.select(host.alias("rule_host"), path.alias("rule_path"), F.coalesce("verdict", F.lit("block")).alias("verdict"))
    one = one.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    full = digest(F.concat_ws("\n", "rule_host", "rule_path"))
    return one.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "verdict",
        F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.length("rule_path").alias("path_chars"),
        full.alias("rule_digest"),
        F.substring(full, 1, SHORT).alias("short"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """pages (id, url) -> (id, host, path, rule, verdict), one row for each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest
    rule (host and path together, then host) wins; without one, rule is null and the verdict
    ``default``. A url that is null or has no ``://`` has an empty host and path. Only those
    suffixes and prefixes are written out whose number of labels and length some rule has,
    which loses no rule, and costs a long path no more than the rules have lengths. Repeated
    rows are judged once and returned as often as they came; other columns are not read; no
    rules, or an empty table, give the default, or no rows.
    """
    ready = prepared(rules)
    shapes = ready.groupBy("labels").agg(F.sort_array(F.collect_set("path_chars")).alias("chars")).orderBy("labels").collect()
    few = ready.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    rows = (
        pages.select(F.col(id_col).alias("id"), "url")
        .groupBy("id", "url")
        .agg(F.count("*").alias("times"))
        .withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    )
    listed = ", ".join(f"named_struct('labels', {s['labels']}, 'chars', array({', '.join(map(str, s['chars']))}))" for s in shapes)
    known = F.expr(f"array({listed})") if shapes else F.array().cast("array<struct<labels:int,chars:array<int>>>")
    able = F.filter(known, lambda s: s["labels"] <= F.size(F.split("host", r"\.")))
    prefixes = lambda s: F.filter(s["chars"], lambda c: c <= F.length("path"))
    fits = F.flatten(F.transform(able, lambda s: F.transform(prefixes(s), lambda c: F.struct(s["labels"].alias("labels"), c.alias("path_chars")))))
    suffix = F.expr("case when p.labels = 0 then '' else substring_index(host, '.', -p.labels) end")
    prefix = F.expr("substring(path, 1, p.path_chars)")
    asked = (
        rows.select("id", "url", "times", "host", "path", F.explode_outer(fits).alias("p"))
        .withColumn("full", F.when(F.col("p").isNotNull(), digest(F.concat_ws("\n", suffix, prefix))))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    if few:
        met = asked.join(F.broadcast(ready), "short", "left")
    else:  # a rule that most pages ask for meets them in SALTS tasks
        asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
        met = asked.join(ready.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["short", "salt"], "left")
    met = met.withColumn("sure", F.col("full") == F.col("rule_digest"))
    best = F.when(F.col("sure"), F.struct((F.length("rule")).alias("n"), F.col("labels").alias("n_host"), "rule", "verdict"))
    judged = met.groupBy("id", "url", "times", "host", "path").agg(F.max(best).alias("best"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_"),
    ).drop("_")


#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages; null urls, repeats and ties as in judge_urls()."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"select * from values {listed} as t(host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE = {
    "op4_url_filters": r"""
with r as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
u as (
  select page_id, row_number() over () as k,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
  from r),
rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select u.*, h || p as rule, v,
    row_number() over (partition by k order by length(h || p) desc nulls last, length(h) desc) as n
  from u left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
""",
}
