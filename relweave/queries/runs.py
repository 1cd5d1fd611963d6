"""Registered queries over evaluation runs and text functions. Runs are derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.functions.json_repair import repaired
from relweave.functions.text import answer_check, norm, similarity_from_distance, token_estimate, tokens
from relweave.plans.partitioning import spread
from relweave.runs import compare, history, summary
from relweave.runs.results import bad_statuses
from relweave.sources.generate import CHANNELS, STATES, check_commerce, commerce, order_stats

STATUS = {"view": "ok", "purchase": "ok", "click": "mismatch", "error": "error"}
_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in STATUS.items())
_BAD = ", ".join(f"'{s}'" for s in bad_statuses())

#: All results of all runs, the newest of each run and case.
_R = f"""
with e as (select event_id % 7 as run, event_id % 500 as id, case event_type {_CASE} else 'unchecked' end as status, event_id, ts, value from events),
 r as (select * from e qualify row_number() over (partition by run, id order by ts desc, event_id desc) = 1),
 base as (select * from r where run = 0 and id < 400), new as (select * from r where run = 1 and id >= 100)
"""


def _draw(salt: str, n: str) -> str:
    """A generated value in SQL: the first 15 digits of the MD5 of seed, column and key."""
    return f"(cast('0x' || substr(md5('42|{salt}|' || id), 1, 15) as bigint) % {n})"


def results(spark: SparkSession, sf: str) -> DataFrame:
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STATUS.items() for x in p]), F.col("event_type")), F.lit("unchecked"))
    e = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 7).alias("run"), (F.col("event_id") % 500).alias("id"), status.alias("status"), "event_id", "ts", "value")
    order = Window.partitionBy("run", "id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = e.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")
    parity = F.when(F.col("id") % 2 == 0, F.array(F.lit("even"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    return e.withColumns({"checked": F.col("status") != "unchecked", "duration_ms": F.floor(F.col("value") * 1000).cast("long"), "tags": parity, "reason": F.lit("")})


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = results(spark, sf)
    return r.filter("run = 0 and id < 400"), r.filter("run = 1 and id >= 100")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a history entry, also the older ones of a run."""
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STATUS.items() for x in p]), F.col("event_type")), F.lit("unchecked"))
    return spark.read.parquet(f"{sf}/events.parquet").select(
        (F.col("event_id") % 500).cast("string").alias("case_id"), (F.col("event_id") % 7).cast("string").alias("run_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ts"), status.alias("status"), F.lit("t").alias("tag"), F.lit("s").alias("scope_hash")
    )


_ENTRIES = f"""he as (select cast(event_id % 500 as varchar) case_id, cast(event_id % 7 as varchar) run_id, epoch(date_trunc('second', ts)) at_s, case event_type {_CASE} else 'unchecked' end as status from events),
 h1 as (select * from he qualify row_number() over (partition by case_id, run_id order by at_s desc, status) = 1),
 hn as (select *, row_number() over (partition by case_id order by at_s desc, run_id desc) recency from h1)"""
_H = f"with {_ENTRIES} "


def summarize(spark: SparkSession, sf: str) -> DataFrame:
    s = summary.summarize(_two(spark, sf)[0])
    return s.withColumns({c: F.round(c, 4) for c in ("avg_total_s", "median_total_s")})


def by_tag(spark: SparkSession, sf: str) -> DataFrame:
    return summary.by_tag(_two(spark, sf)[0]).select("tag", "total", "ok", "mismatch", "error", "unchecked", "checked_total", F.round("pass_rate", 6).alias("pass_rate"))


def worst(spark: SparkSession, sf: str) -> DataFrame:
    return summary.worst_tags(results(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 6))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    base, new = _two(spark, sf)
    planned = base.select(F.explode("tags").alias("tag"), "id")
    done = new.select(F.explode("tags").alias("tag"), "id", "status")
    return summary.tag_inventory(done, planned).withColumn("pass_rate", F.round("pass_rate", 6))


def status_of_runs(spark: SparkSession, sf: str) -> DataFrame:
    per = results(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("executed"), F.count_if(F.col("status").isin(bad_statuses())).alias("bad"))
    stopped, planned = F.col("run") == 6, F.when(F.col("run") == 5, 0).otherwise(F.col("executed"))
    return per.select("run", summary.run_status(stopped, planned, F.col("executed"), F.col("bad")).alias("status"), summary.exit_code(stopped, F.col("bad")).alias("code"))


def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    per = results(spark, sf).groupBy(F.col("run").cast("string").alias("run_id")).agg(
        F.count_if(F.col("status").isin(bad_statuses())).cast("string").alias("fail_count"), F.avg((F.col("status") == "ok").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("executed_total"), F.max("ts").cast("string").alias("ts")
    )
    rows = per.withColumns({"run_status": F.lit(""), "interrupted": F.col("run_id") == "3", "tag": F.lit(None).cast("string"), "planned_total": F.lit("500"), "missed_total": 500 - F.col("executed_total")})
    return history.run_stats(history.last_runs(rows, 5)).withColumns({"pass_rate": F.round("pass_rate", 6), "coverage": F.round("coverage", 6)})


def selection(spark: SparkSession, sf: str) -> DataFrame:
    cases = _two(spark, sf)[0].select(F.col("id").cast("string").alias("id"), "tags")
    return history.select_cases(cases, include_tags=["even"], exclude_ids=["2", "4"]).filter(history.name_matches(F.col("id"), "1*")).select("id")


def selection_by_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _two(spark, sf)[0].select(F.col("id").cast("string").alias("id")).filter(history.name_matches(F.col("id"), "re:^[12].*5$"))


def healed(spark: SparkSession, sf: str, passes: int = 2) -> DataFrame:
    return history.healed(history.newest_per_run(_entries(spark, sf), "t", "s"), passes)


def only_failed_flaky(spark: SparkSession, sf: str) -> DataFrame:
    as_text = lambda df: df.withColumn("id", F.col("id").cast("string"))
    base, new = map(as_text, _two(spark, sf))
    return history.only_failed(base, new, healed(spark, sf))


def effective_upsert(spark: SparkSession, sf: str) -> DataFrame:
    base, new = _two(spark, sf)
    return compare.upsert(base.select("id", "status", "run"), new)


def missed(spark: SparkSession, sf: str) -> DataFrame:
    base, new = _two(spark, sf)
    return history.only_missed(results(spark, sf), base, new.filter("id < 450"), overlay_scope="a", scope="a")


def text_norm(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/products.parquet").select("product_id", norm(F.col("category")).alias("category"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pick = lambda n, c: F.when(F.col("doc_id") % 4 == n, c)
    check = answer_check(F.col("text"), pick(0, F.col("text")), pick(1, F.lit("[0-9]{4}")), pick(2, F.lit("every")))
    return docs.select("doc_id", check.alias("c")).select("doc_id", "c.mode", "c.passed")


def json_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose properties, damaged in several ways, read as the undamaged ones do."""
    e = spark.read.parquet(f"{sf}/events.parquet").filter("props is not null")
    n = F.col("event_id") % 5
    damaged = (
        F.when(n == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(n == 1, F.replace("props", F.lit('"'), F.lit("'")))
        .when(n == 2, F.regexp_replace("props", r"\}$", ",}"))
        .when(n == 3, F.regexp_replace("props", r'"(\w+)"\s*:', "$1:"))
        .otherwise(F.regexp_replace("props", r"\}$", ""))
    )
    both = spread(e.select(n.alias("damage"), damaged.alias("d"), "props")).select("damage", repaired("d").alias("a"), repaired("props").alias("b"))
    return both.groupBy("damage").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same"))


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """As many orders as there are customers in the test tables."""
    n = spark.read.parquet(f"{sf}/customer.parquet").count()
    t = commerce(spark, n)
    check_commerce(t, n)
    return t["orders"].select("order_id", "customer_id", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"), "status", "channel", "order_total")


_DIFF = """, d as (select coalesce(b.id, n.id) as id, b.status as bs, n.status as ns,
   coalesce(b.status in ({bad}), false) as was, n.status is null or n.status in ({bad}) as now from base b full join new n on b.id = n.id)
 select id, bs as "from", coalesce(ns, 'missing') as "to", case when ns is null then 'missing in new results' else '' end as reason,
   case when not was and now then 'new_fail' when was and not now then 'fixed' when was and now then 'still_fail' end as outcome,
   bs is not null and (ns is null or bs <> ns) as changed, bs is null as is_new from d"""

QUERIES = {
    "runs_summarize": summarize,
    "runs_by_tag": by_tag,
    "runs_worst_tags": worst,
    "runs_tag_inventory": inventory,
    "runs_bad_count": lambda s, d: summary.bad_count(results(s, d), "any"),
    "runs_status": status_of_runs,
    "runs_stats": run_stats,
    "runs_diff": lambda s, d: compare.diff_runs(*_two(s, d)),
    "runs_count_deltas": lambda s, d: compare.count_deltas(*_two(s, d)).select("metric", *[F.round(c, 4).alias(c) for c in ("base", "new", "delta")]),
    "runs_coverage": lambda s, d: compare.coverage_counts(*_two(s, d)),
    "runs_effective_diff": lambda s, d: compare.effective_diff(*_two(s, d)),
    "runs_effective_upsert": effective_upsert,
    "runs_missed": lambda s, d: compare.missed(*_two(s, d)),
    "runs_only_missed": missed,
    "runs_only_failed": lambda s, d: history.only_failed(*_two(s, d)),
    "runs_only_failed_antiflake": only_failed_flaky,
    "runs_newest_per_run": lambda s, d: history.newest_per_run(_entries(s, d)).select("case_id", "run_id", "status", F.col("recency").cast("long").alias("recency")),
    "runs_antiflake": healed,
    "runs_selection": selection,
    "runs_selection_pattern": selection_by_pattern,
    "text_norm": text_norm,
    "text_tokens": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(tokens(F.col("text"))).alias("n")).filter("n >= 0"),
    "token_estimate": lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter("text is not null").select("doc_id", token_estimate(F.col("text")).alias("n")),
    "distance_to_similarity": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.round(similarity_from_distance(F.col("value") - 10), 9).alias("score")),
    "answer_check": answers,
    "dataset_stats": lambda s, d: order_stats(s.read.parquet(f"{d}/shop_orders.parquet"), "order_date", "status"),
    "json_extract_props": json_clean,
    "generated_commerce": generated,
}

SQL = {
    "runs_summarize": _R
    + "select count(*) as total, "
    + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("ok", "mismatch", "failed", "error", "skipped", "unchecked", "plan_only"))
    + ", count(*) filter (status in ('ok','mismatch','failed','error')) as checked_total, count(*) filter (status = 'ok') as checked_ok, round(avg(floor(value * 1000) / 1000), 4) as avg_total_s, round(quantile_cont(floor(value * 1000) / 1000, 0.5), 4) as median_total_s from base",
    "runs_by_tag": _R
    + """, t as (select 'all' as tag, * from base union all select 'even', * from base where id % 2 = 0)
 select tag, count(*) as total, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'mismatch') as mismatch, count(*) filter (status = 'error') as error, count(*) filter (status = 'unchecked') as unchecked,
  count(*) filter (status <> 'unchecked') as checked_total, round(count(*) filter (status = 'ok') / count(*), 6) as pass_rate from t group by 1""",
    "runs_worst_tags": _R
    + f""", t as (select 'all' as tag, * from r union all select 'even', * from r where id % 2 = 0)
 select tag, count(*) filter (status in ({_BAD})) as bad, round(count(*) filter (status = 'ok') / count(*), 6) as pass_rate from t group by 1""",
    "runs_tag_inventory": _R
    + f""", p as (select 'all' as tag, id from base union all select 'even', id from base where id % 2 = 0), x as (select 'all' as tag, id, status from new union all select 'even', id, status from new where id % 2 = 0)
 select coalesce(p.tag, x.tag) as tag, count(p.id) as planned, count(x.id) as executed, count(*) filter (x.id is null) as missed, count(*) filter (x.status in ({_BAD})) as bad,
  round(count(*) filter (x.status = 'ok') / count(x.id), 6) as pass_rate from p full join x on p.tag = x.tag and p.id = x.id group by 1""",
    "runs_bad_count": _R + "select count(*) filter (status in ('error', 'failed', 'mismatch', 'unchecked', 'plan_only')) as bad from r",
    "runs_status": _R
    + f"""select run, case when run = 6 then 'INTERRUPTED' when run = 5 then 'ERROR' when count(*) filter (status in ({_BAD})) > 0 then 'FAILED' else 'SUCCESS' end as status,
 case when run = 6 then 130 when count(*) filter (status in ({_BAD})) > 0 then 1 else 0 end as code from r group by 1""",
    "runs_stats": _R
    + f"""select cast(run as varchar) as run_id, case when run = 3 then 'INTERRUPTED' else 'UNKNOWN' end as status, '' as tag, count(*) filter (status in ({_BAD})) as bad,
 round(avg(case when status = 'ok' then 1.0 else 0.0 end), 6) as pass_rate, round(count(*) / 500.0, 6) as coverage, cast(500 - count(*) as double) as missed from r group by 1, 2, run order by max(ts) desc, 1 desc limit 5""",
    "runs_diff": _R + _DIFF.format(bad=_BAD),
    "runs_count_deltas": _R
    + ", m as ("
    + " union all ".join(
        f"select '{m}' as metric, (select cast({e} as double) from base) as base, (select cast({e} as double) from new) as new"
        for m, e in [("total", "count(*)"), *[(s, f"count(*) filter (status = '{s}')") for s in ("ok", "mismatch", "failed", "error", "skipped", "unchecked", "plan_only")], ("bad", f"count(*) filter (status in ({_BAD}))"), ("avg_total_s", "avg(floor(value * 1000) / 1000)"), ("median_total_s", "quantile_cont(floor(value * 1000) / 1000, 0.5)")]
    )
    + ") select metric, round(base, 4) as base, round(new, 4) as new, round(new - base, 4) as delta from m",
    "runs_coverage": _R + "select count(b.id) as base_total, count(n.id) as new_total, count(*) filter (n.id is null) as only_in_base, count(*) filter (b.id is null) as only_in_new from base b full join new n on b.id = n.id",
    "runs_effective_diff": _R
    + f""", d as (select n.id, b.status as f, n.status as t, coalesce(b.status in ({_BAD}), false) as was, n.status in ({_BAD}) as now from new n left join base b on n.id = b.id)
 select id, f as "from", t as "to", '' as reason, case when f is null then 'new_case' when not was and now then 'regressed' when was and not now then 'fixed' when was and now then 'changed_bad' else 'changed_other' end as change from d where f is null or f <> t""",
    "runs_effective_upsert": _R + "select id, status, run from new union all select id, status, run from base where id not in (select id from new)",
    "runs_missed": _R + "select id from base where id not in (select id from new)",
    "runs_only_missed": _R + "select distinct id from r where id not in (select id from base) and id not in (select id from new where id < 450)",
    "runs_only_failed": _R + f"select id from base where status in ({_BAD}) and id not in (select id from new where status not in ({_BAD})) union select id from new where status in ({_BAD})",
    "runs_only_failed_antiflake": _R
    + f""", {_ENTRIES}, h as (select case_id from hn where recency <= 2 group by 1 having count(*) = 2 and count(*) filter (status in ({_BAD})) = 0)
 select cast(id as varchar) as id from base where status in ({_BAD}) and not (id in (select id from new) and cast(id as varchar) in (select case_id from h))
 union select cast(id as varchar) from new where status in ({_BAD})""",
    "runs_antiflake": _H + f"select case_id from hn where recency <= 2 group by 1 having count(*) = 2 and count(*) filter (status in ({_BAD})) = 0",
    "runs_newest_per_run": _H + "select case_id, run_id, status, recency from hn",
    "runs_selection": _R + "select cast(id as varchar) as id from base where id % 2 = 0 and id not in (2, 4) and cast(id as varchar) like '1%'",
    "runs_selection_pattern": _R + "select cast(id as varchar) as id from base where regexp_matches(cast(id as varchar), '^[12].*5$')",
    "text_norm": r"select product_id, lower(regexp_replace(regexp_replace(category, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g'), '[\s\p{Z}\x{85}]+', ' ', 'g')) as category from products",
    "text_tokens": r"select doc_id, cast(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as int) as n from documents where text is not null",
    "token_estimate": "select doc_id, greatest(1, length(text) // 4) as n from documents where text is not null",
    "distance_to_similarity": "select event_id, round(case when value - 10 >= 0 then 1 / (1 + value - 10) else value - 10 end, 9) as score from events",
    "answer_check": "select doc_id, case when text is null then case doc_id % 4 when 1 then 'none' when 2 then 'none' end else case doc_id % 4 when 0 then 'exact' when 1 then 'regex' when 2 then 'contains' end end as mode, case when text is null then case when doc_id % 4 in (1, 2) then false end else case doc_id % 4 when 0 then true when 1 then regexp_matches(text, '[0-9]{4}') when 2 then contains(text, 'every') end end as passed from documents",
    "dataset_stats": 'select status as value, count(*) as n_rows, min(order_date) as "first", max(order_date) as "last" from shop_orders group by 1',
    "json_extract_props": "select event_id % 5 as damage, count(*) as n, count(*) as same from events where props is not null group by 1",
    "generated_commerce": f"""with n as (select count(*) n, greatest(200, count(*) // 3) p from customer),
 o as (select unnest(generate_series(1, n)) id, n, p from n),
 l as (select id, p, unnest(generate_series(1, {_draw('lines', '5')} + 1)) line from o), i as (select id as o, p, id * 5 + line - 5 as id from l),
 x as (select o, {_draw('product', 'p')} + 1 as product, {_draw('quantity', '4')} + 1 as q from i),
 y as (select o, q, product as id from x), z as (select o, round(q * ((({_draw('price', '49500')}) + 500) / 100), 2) as v from y),
 s as (select o, round(sum(v), 2) as order_total from z group by o)
 select id as order_id, {_draw('buyer', 'n')} + 1 as customer_id, strftime(date '2023-01-01' + cast({_draw('day', '730')} as int), '%Y-%m-%d') as order_date,
  {list(STATES)}[cast({_draw('status', '5')} + 1 as int)] as status, {list(CHANNELS)}[cast({_draw('channel', '3')} + 1 as int)] as channel, order_total from o join s on o = id""",
}
