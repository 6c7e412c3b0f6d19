"""The operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, decontaminate, exact_dedup, html_text, jaccard, language, line_dedup, packing, periodic, quality, substring_dedup, token_store, treaps
from .shared import documents


THRESHOLD = 0.7


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf_dir), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_pages(spark, sf_dir), language.train(documents(spark, sf_dir)))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(_pages(spark, sf_dir))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.round_trip(documents(spark, sf_dir))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # The text goes through the scorer only as far as it is needed there.
    out = quality.score(docs, model, carry=["doc_id"])
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), digest_all=True)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), "contaminated")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_fit.pack_best_fit(documents(spark, sf_dir), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.find_runs(periodic.with_periods(documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = out.withColumn("longest", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("(1000 * longest.length) div -longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_output": op5_token_output,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as sh
  from d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as u(i)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x as a, y as b from l union all select y, x from l),
r(node, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(root) as component_id from d left join n on n.doc_id = d.doc_id join r on r.node = d.doc_id group by all""",
    "op6_exact_dedup": f"""
with d as (select doc_id, {_FOLD} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)""",
    "op7_line_dedup": rf"""
with l as (
  select doc_id, i, string_split(coalesce(text, ''), chr(10))[i] as line
  from documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as u(i)),
k as (select doc_id, i, line, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
m as (select k.doc_id, i, line, f.key is not null and k.doc_id <> f.last as drop from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (drop) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not drop), '')) as kept_sha256
from m group by doc_id""",
    "op9_substring_dedup": rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') as win from d, unnest(range(1, len(w) - 33)) as u(i)),
r as (select doc_id, i from s where win in (select win from s group by win having count(*) > 1)),
c as (select distinct doc_id, i + o as p from r, unnest(range(0, 35)) as u(o)),
a as (select doc_id, list(p) as ps from c group by doc_id),
k as (select d.doc_id, len(w) as n, coalesce(len(ps), 0) as gone, list_filter(range(1, len(w) + 1), lambda x: not list_contains(coalesce(ps, []), x)) as keep, w
  from d left join a on a.doc_id = d.doc_id)
select doc_id, n as n_words, gone as n_removed, sha256(coalesce(array_to_string(list_transform(keep, lambda x: w[x]), ' '), '')) as kept_sha256 from k""",
    "op10_decontamination": rf"""
with d as (select doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(13, len(w)) as k, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as win
  from b, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) as u(i)),
ks as (select distinct k from bw),
dw as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as win from d, ks, unnest(range(1, len(w) - k + 2)) as u(i)),
h as (select doc_id, i, dw.k, item_id from dw join bw on bw.win = dw.win and bw.k = dw.k),
c as (select doc_id, count(distinct i + o) as n_hit from h, unnest(range(0, k)) as u(o) group by doc_id),
n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id""",
    "op13_ranked_search": rf"""
with d as (select doc_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
p as (select doc_id, t, count(*) as tf from d group by all),
n as (select doc_id, cast(sum(tf) as bigint) as n from p group by all),
s as (select count(*) as cn, cast(sum(n) as bigint) as cl from n),
f as (select t, cast(floor(1000 * ln(cast(2 * cn + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from p, s group by t, cn),
b as (select distinct item_id, unnest(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
c as (select item_id, p.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * cn) // cl)))) as bigint) as score
  from b join f using (t) join p using (t) join n on n.doc_id = p.doc_id, s group by all)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from c where score > 0) where rank <= 50""",
}
