"""URL filtering by nested host and path rules (native).

A sort-merge range join. A host becomes a reversed key whose labels end in a dot (``a.example.org`` is
``org.example.a.``), so that a rule's host and its subdomains are exactly the keys with the rule's key as
prefix: an interval. Intervals of prefixes nest or are apart. Sweeping the sorted keys, the rules that
cover a key are therefore the last rule that started and the rules around it - the stack of active rules
at that start - less those whose interval has ended meanwhile, which is to say whose key is no prefix.

The sweep runs over distinct hosts, not urls. It is dealt out by cell (the first two labels); a cell with
many hosts is salted, and its few rules are repeated for each salt, so no cell is swept by one task.
Rules above the cells (one label) enter as the stack that each cell starts with.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule. Rules
with an empty host fit nothing. Of rules that fit, the one with the longest text (host and path) wins;
equally long ones can only be repeats, of which ``block`` wins. No rule: ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lower_ascii, stored, table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
RULE_TYPE = "struct<key:string,host:string,path:string,verdict:string>"


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    return F.when(F.contains(url, F.lit("://")), lower_ascii(host)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.substr(url, F.length(rest) + 4)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), path).otherwise("")


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def cell_of(key: Column) -> Column:
    return F.concat(F.substring_index(key, ".", 2), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule host the rules of its own and of every host around it."""
    own = (
        rules.where(F.col("host") != "")
        .select(key_of(lower_ascii(F.col("host"))).alias("key"), lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .groupBy("key")
        .agg(F.sort_array(F.collect_set(F.struct("key", "host", "path", "verdict"))).alias("own"))
    )
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    around = own.select("key", F.posexplode(labels).alias("i", "_")).select(
        "key", F.expr("concat(substring_index(key, '.', i + 1), '.')").alias("outer")
    )
    return (
        around.join(own.select(F.col("key").alias("outer"), "own"), "outer")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("own")).alias("stack"))
    )


def sweep(hosts: DataFrame, rules: DataFrame, cell_rows: int = 50_000) -> DataFrame:
    """(host, active): the rules whose interval holds the host's key, for hosts that any rule covers."""
    stacks = rule_stacks(rules)
    keyed = hosts.select("host", key_of(F.col("host")).alias("key")).withColumn("cell", cell_of(F.col("key")))
    salts = keyed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("salts"))
    low = F.length("key") <= F.length(F.substring_index("key", ".", 1)) + 1
    top = stacks.where(low).select(F.col("key").alias("top"), F.col("stack").alias("top_stack"))
    inner = stacks.where(~low).withColumn("cell", cell_of(F.col("key")))
    # a cell starts with the stack of its first label, at every salt
    starts = (
        salts.withColumn("top", F.concat(F.substring_index("cell", ".", 1), F.lit(".")))
        .join(top, "top")
        .select("cell", "salts", F.lit("").alias("key"), F.col("top_stack").alias("stack"))
    )
    begun = inner.join(salts, "cell").select("cell", "salts", "key", "stack").unionByName(starts)
    opened = begun.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "stack",
        F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
    )
    passed = keyed.join(salts, "cell").select(
        "cell", F.pmod(F.xxhash64("host"), F.col("salts")).cast("int").alias("salt"), "key",
        F.lit(None).cast(f"array<{RULE_TYPE}>").alias("stack"), F.lit(1).alias("kind"), "host",
    )
    order = W.partitionBy("cell", "salt").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = opened.unionByName(passed).withColumn("stack", F.last("stack", ignorenulls=True).over(order))
    return (
        swept.where((F.col("kind") == 1) & F.col("stack").isNotNull())
        .select("host", F.filter("stack", lambda r: F.startswith(F.col("key"), r["key"])).alias("active"))
        .where(F.size("active") > 0)
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", hot_rows: int = 1_000_000) -> DataFrame:
    """Adds host, path, rule and verdict to rows with a ``url``; rules: (verdict, host, path).

    Hosts of at least hot_rows rows, of which there can't be many, get their rules by broadcast (of a measured
    size); rows of other hosts are joined by host. Rows without a host, or with a hot one, are spread by their url.
    """
    clash = [c for c in ("host", "path", "rule", "verdict") if c in pages.columns]
    urls = pages.drop(*clash).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    hosts = urls.select("host").where(F.col("host") != "").groupBy("host").agg(F.count("*").alias("_rows"))
    hosts = stored(hosts, "hosts")
    swept = stored(sweep(hosts.select("host"), rules), "swept").join(hosts, "host")
    hot = stored(hosts.where(F.col("_rows") >= hot_rows).select("host").join(swept, "host", "left").select("host", "active"), "hot")
    # a hot host's few rules are measured as text
    size = hot.agg(F.sum(F.octet_length("host") + F.coalesce(F.length(F.to_json("active")), F.lit(0)))).first()[0] or 0
    cold = swept.where(F.col("_rows") < hot_rows).select(F.col("host").alias("_host"), "active")
    if size > 32 << 20:  # then none is treated apart
        hot, cold = hot.limit(0), swept.select(F.col("host").alias("_host"), "active")
    found = urls.join(F.broadcast(hot.select("host", F.col("active").alias("_hot"), F.lit(True).alias("_is_hot"))), "host", "left")
    apart = (F.col("host") == "") | F.coalesce("_is_hot", F.lit(False))
    found = found.withColumns({"_apart": apart, "_key": F.when(apart, F.xxhash64("url").cast("string")).otherwise(F.col("host"))})
    found = found.join(cold.withColumn("_cold", F.lit(False)), (F.col("_key") == F.col("_host")) & (F.col("_apart") == F.col("_cold")), "left")
    fits = F.filter(F.coalesce("active", "_hot"), lambda r: F.startswith(F.col("path"), r["path"]))
    ranked = F.transform(
        fits, lambda r: F.struct(
            F.length(F.concat(r["host"], r["path"])).alias("n"), r["verdict"].alias("verdict"),
            F.concat(r["host"], r["path"]).alias("rule")),
    )
    return (
        found.withColumn("_won", F.array_max(ranked))
        .withColumns({"rule": F.col("_won.rule"), "verdict": F.coalesce(F.col("_won.verdict"), F.lit(default))})
        .select(*[c for c in pages.columns if c not in clash], "host", "path", "rule", "verdict")
    )


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules (verdict, host, path) as literals of the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("verdict", "host", "path"), r, strict=True)]) for r in rules])))


def op4_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = rule_table(spark)
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
with rules(verdict, host, path) as (values ('allow','org','/'), ('block','example.org','/es/'),
  ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
u as (select page_id,
  coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
f as (select page_id, max(struct_pack(n := length(r.host || r.path), verdict := r.verdict, rule := r.host || r.path)) as won
  from u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path) group by 1)
select u.page_id, u.host, u.path, f.won.rule as rule, coalesce(f.won.verdict, 'allow') as verdict
from u left join f using (page_id)
"""
