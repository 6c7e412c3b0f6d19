"""Queries: search and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import search as S
from lodestar.operators import text_index as I
from lodestar.operators import trust as T
from lodestar.operators import vector_index as V
from lodestar.operators.graph import cut

from .registry import query
from .views import AS_OF_EPOCH, evidence, evidence_edges, evidence_nodes, evidence_vectors, oracle, table

TEXT = "the and tion"


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    """A stored vector as the query; a vector of zeros, which is like nothing, where it is missing."""
    found = table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()
    return list(found["embedding"]) if found else [0.0]


_DOT = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = {0}))"
_TOK = "list_filter(regexp_split_to_array(lower(coalesce(docstring, '')), '[^a-z0-9]+'), lambda x: x <> '')"


def bm25_sql(limit: str = "limit 100") -> str:
    return f"""bt as (select uid, {_TOK} as t from evidence),
bs as (select uid, len(t) as n, len(list_filter(t, lambda x: x = 'and')) as f0, len(list_filter(t, lambda x: x = 'the')) as f1, len(list_filter(t, lambda x: x = 'tion')) as f2 from bt),
ba as (select count(*) as docs, avg(n) as av, count(*) filter (f0 > 0) as d0, count(*) filter (f1 > 0) as d1, count(*) filter (f2 > 0) as d2 from bs),
keyword as (select uid,
  case when f0 > 0 then ln(1 + (docs - d0 + 0.5::double) / (d0 + 0.5::double)) * f0 * 2.2::double / (f0 + 1.2::double * (0.25::double + 0.75::double * n / av)) else 0 end
  + case when f1 > 0 then ln(1 + (docs - d1 + 0.5::double) / (d1 + 0.5::double)) * f1 * 2.2::double / (f1 + 1.2::double * (0.25::double + 0.75::double * n / av)) else 0 end
  + case when f2 > 0 then ln(1 + (docs - d2 + 0.5::double) / (d2 + 0.5::double)) * f2 * 2.2::double / (f2 + 1.2::double * (0.25::double + 0.75::double * n / av)) else 0 end as score
  from bs, ba where f0 + f1 + f2 > 0 order by score desc, uid {limit})"""


_VECTOR = f"vector as (select uid, {_DOT.format(0)} as score from evidence where embedding is not null order by score desc, uid limit 500)"
_STEP = """st as (select src as uid, dst as to_ from evidence_edges where type in ('DEFINES','HAS_COMPONENT','HAS_ASSET','CALLS','DEPENDS_ON')
  union all select dst, src from evidence_edges where type in ('DEFINES','HAS_COMPONENT','HAS_ASSET','CALLS','DEPENDS_ON'))"""
_FUSED = f"""with {_VECTOR}, {bm25_sql()},
fused as (select uid, max(score) as score, string_agg(distinct source, ',' order by source) as sources from
  (select uid, score, 'vector' as source from vector union select uid, score, 'keyword' from keyword) group by uid),
best as (select * from fused order by score desc, uid limit 20), {_STEP},
reach as (select uid, uid as to_ from best union all select best.uid, to_ from best join st on st.uid = best.uid),
near as (select reach.uid, list_sort(list(distinct name)) as neighbors from reach join evidence e on e.uid = to_ group by reach.uid),
hits as (select best.uid, score, sources, project, path, name, label, last_modified, coalesce(neighbors, []) as neighbors
  from best join evidence e on e.uid = best.uid left join near on near.uid = best.uid)"""
_FAULTS = """stale as (select 'STALE_DOC' as type, uid, floor((1706745600.0::double - last_modified) / 86400.0::double) as detail from hits
  where label = 'Document' and last_modified > 0 and floor((1706745600.0::double - last_modified) / 86400.0::double) > 90),
orph as (select 'ORPHANED_NODE' as type, uid, len(neighbors)::double as detail from hits where len(neighbors) < 2),
contra as (select 'CONTRADICTION' as type, a.uid, max((c.last_modified - a.last_modified) / 86400.0::double) as detail from hits a join hits c on list_contains(a.neighbors, c.name)
  where a.label = 'Document' and a.last_modified > 0 and c.label = 'Code' and c.last_modified > 0 and (c.last_modified - a.last_modified) / 86400.0::double > 30 group by a.uid),
cov as (select 'LOW_COVERAGE' as type, null as uid, count(*)::double as detail from hits having count(*) < 5),
f as (select * from stale union all select * from orph union all select * from contra union all select * from cov),
total as (select count(*) as faults, greatest(0.0::double, 100.0::double - coalesce(sum(case type when 'STALE_DOC' then 15 when 'ORPHANED_NODE' then 5 when 'CONTRADICTION' then 20 else 10 end), 0)) as confidence from f)"""


def _hits(spark, d, **options):
    return S.hybrid(evidence_nodes(spark, d), evidence_edges(spark, d), _vector(spark, d), TEXT, vectors=evidence_vectors(spark, d), **options)


@query("vector_topk", oracle(f"select uid, round({_DOT.format(0)}, 6) as score from evidence where embedding is not null order by {_DOT.format(0)} desc, uid limit 50", "evidence"))
def _(spark, d):
    return S.vector_topk(evidence_vectors(spark, d), _vector(spark, d), 50).select("uid", F.round("score", 6).alias("score"))


@query("vector_threshold", oracle(f"select uid, project, round({_DOT.format(3)}, 6) as score from evidence where embedding is not null and project = 'en' and {_DOT.format(3)} >= 0.1 order by {_DOT.format(3)} desc, uid limit 30", "evidence"))
def _(spark, d):
    return S.vector_topk(evidence(spark, d).where("project = 'en'"), _vector(spark, d, 3), 30, minimum=0.1).select("uid", "project", F.round("score", 6).alias("score"))


@query("vector_by_label", oracle(f"select vec_id, label, round({_DOT.format(0)}, 6) as score from embeddings where label = 3 order by {_DOT.format(0)} desc, vec_id limit 10"))
def _(spark, d):
    rows = table(spark, d, "embeddings").where("label = 3")
    return S.vector_topk(rows, _vector(spark, d), 10, key="vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


def _vector_index(spark, d):
    """An index of all vectors, the last quarter of which come as a second batch."""
    rows = table(spark, d, "embeddings")
    index = V.VectorIndex.create(rows.where("vec_id % 4 <> 3"), V.index_folder(spark), "vec_id", carry=["label"])
    index.add(rows.where("vec_id % 4 = 3"))
    return index


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


@query("vector_index_topk")
def _(spark, d):
    """The 50 nearest vectors of each vector whose id is divisible by 100, by an index that is asked for a recall of 0.95."""
    index = _vector_index(spark, d)
    probes = index.probes_for(_asked(spark, d), 50, 0.95)
    return index.search(_asked(spark, d), 50, probes).select(F.col("query").alias("query_id"), "vec_id", "rank", F.round("score", 6).alias("score"))


@query("vector_index_filtered")
def _(spark, d):
    """The same among the vectors of one label, with a least score."""
    index = _vector_index(spark, d)
    found = index.search(_asked(spark, d), 10, len(index.model.cells), where="label = 3", minimum=0.1)
    return found.select(F.col("query").alias("query_id"), "vec_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_topk", oracle(f"with {bm25_sql()} select uid, round(score, 6) as score from keyword", "evidence"))
def _(spark, d):
    return S.bm25(evidence_nodes(spark, d), TEXT, 100).select("uid", F.round("score", 6).alias("score"))


def _text_index(spark, d, batches: int = 3):
    """An index of all texts that came in batches."""
    index = I.TextIndex(spark)
    for i in range(batches):
        index.add(evidence_nodes(spark, d).where(F.col("doc_id") % batches == i))
    return index


@query("bm25_index_topk", oracle(f"with {bm25_sql()} select uid, round(score, 6) as score from keyword", "evidence"))
def _(spark, d):
    return _text_index(spark, d).search(TEXT, 100).select("uid", F.round("score", 6).alias("score"))


@query("hybrid_search", oracle(f"{_FUSED}, {_FAULTS}, own as (select uid, string_agg(type, ',' order by type) as faults from f where uid is not null group by uid) select hits.uid, round(score, 6) as score, sources, project, path, label, len(neighbors) as n_neighbors, coalesce(own.faults, '') as faults, confidence from hits left join own on own.uid = hits.uid, total", "evidence", "evidence_edges"))
def _(spark, d):
    out = T.assess(_hits(spark, d), AS_OF_EPOCH)
    return out.select("uid", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "project", "path", "label", F.size("neighbors").cast("long").alias("n_neighbors"), F.array_join("faults", ",").alias("faults"), "confidence")


@query("hybrid_neighbors", oracle(f"{_FUSED} select uid, array_to_string(neighbors, ',') as neighbors from hits", "evidence", "evidence_edges"))
def _(spark, d):
    return _hits(spark, d).select("uid", F.array_join("neighbors", ",").alias("neighbors"))


@query("rrf_fusion", oracle(f"""with {_VECTOR}, {bm25_sql()},
r as (select uid, 1.0::double / (60 + row_number() over (order by score desc, uid)) as part from vector union all select uid, 1.0::double / (60 + row_number() over (order by score desc, uid)) from keyword)
select uid, round(sum(part), 9) as score from r group by uid order by sum(part) desc, uid limit 50""", "evidence"))
def _(spark, d):
    vectors = evidence_vectors(spark, d)
    out = S.fuse_rrf({"vector": S.vector_topk(vectors, _vector(spark, d)).select("uid", "score"), "keyword": S.bm25(evidence_nodes(spark, d), TEXT)})
    return out.orderBy(F.desc("score"), "uid").limit(50).select("uid", F.round("score", 9).alias("score"))


@query("weighted_fusion", oracle(f"""with {_VECTOR}, {bm25_sql()},
a as (select uid, 0.7::double * case when (select max(score) > min(score) from vector) then (score - (select min(score) from vector)) / (select max(score) - min(score) from vector) else 1 end as part from vector),
b as (select uid, 0.3::double * case when (select max(score) > min(score) from keyword) then (score - (select min(score) from keyword)) / (select max(score) - min(score) from keyword) else 1 end as part from keyword)
select uid, round(sum(part), 6) as score from (select * from a union all select * from b) group by uid""", "evidence"))
def _(spark, d):
    hits = {"vector": cut(S.vector_topk(evidence_vectors(spark, d), _vector(spark, d)).select("uid", "score")), "keyword": cut(S.bm25(evidence_nodes(spark, d), TEXT))}
    return S.fuse_minmax(hits, {"vector": 0.7, "keyword": 0.3}).select("uid", F.round("score", 6).alias("score"))


@query("trust_faults", oracle(f"{_FUSED}, {_FAULTS} select type, uid, round(detail, 6) as detail from f", "evidence", "evidence_edges"))
def _(spark, d):
    return T.faults(_hits(spark, d), AS_OF_EPOCH).select("type", "uid", F.round("detail", 6).alias("detail"))


@query("trust_confidence", oracle(f"{_FUSED}, {_FAULTS} select faults, confidence from total", "evidence", "evidence_edges"))
def _(spark, d):
    return T.confidence(T.faults(_hits(spark, d), AS_OF_EPOCH))


@query("trust_basic", oracle(f"{_FUSED} select greatest(0.0::double, 100.0::double - coalesce(sum(case when label = 'Document' and floor((1706745600.0::double - last_modified) / 86400.0::double) > 90 then 15 else 0 end + case when len(neighbors) < 2 then 5 else 0 end), 0)) as confidence, count(*) as results from hits", "evidence", "evidence_edges"))
def _(spark, d):
    return T.basic(_hits(spark, d), AS_OF_EPOCH)


@query("staleness", oracle("select 'STALE_DOC' as type, uid, floor((1706745600.0::double - last_modified) / 86400.0::double) as detail from evidence where label = 'Document' and floor((1706745600.0::double - last_modified) / 86400.0::double) > 90", "evidence"))
def _(spark, d):
    return T.stale(evidence(spark, d), AS_OF_EPOCH)


_NEAR = """with st as (select src as uid, dst as to_ from evidence_edges union all select dst, src from evidence_edges),
reach as (select uid, uid as to_ from evidence union all select evidence.uid, to_ from evidence join st on st.uid = evidence.uid),
near as (select reach.uid, list_sort(list(distinct name)) as neighbors from reach join evidence e on e.uid = to_ group by reach.uid)"""


@query("orphans", oracle(f"{_NEAR} select uid, len(neighbors) as n from near where len(neighbors) < 4", "evidence", "evidence_edges"))
def _(spark, d):
    nodes = evidence(spark, d)
    return T.orphans(S.neighbours(nodes, nodes, evidence_edges(spark, d)), 4).select("uid", F.col("detail").cast("long").alias("n"))


@query("contradictions", oracle("""with step as (select src as uid, dst as to_ from evidence_edges where type = 'DEPENDS_ON')
select a.uid, round(max((b.last_modified - a.last_modified) / 86400.0::double), 6) as detail from evidence a join step on step.uid = a.uid join evidence b on b.uid = to_
where a.label = 'Document' and b.label = 'Document' and (b.last_modified - a.last_modified) / 86400.0::double > 30 group by a.uid""", "evidence", "evidence_edges"))
def _(spark, d):
    # On these tables a document's successors are documents; the second half of the pair stands in for code.
    nodes = evidence(spark, d).select("uid", "name", "label", "last_modified")
    near = evidence_edges(spark, d).where("type = 'DEPENDS_ON'").groupBy(F.col("src").alias("uid")).agg(F.collect_set("dst").alias("neighbors"))
    left = nodes.where("label = 'Document'").join(near, "uid")
    right = nodes.where("label = 'Document'").select("uid", "name", F.lit("Code").alias("label"), "last_modified", F.array().cast("array<string>").alias("neighbors"))
    return T.contradictions(left.select(*right.columns).unionByName(right)).select("uid", F.round("detail", 6).alias("detail"))


@query("freshness_buckets", oracle("""select case when (1706745600.0::double - last_modified) / 86400 < 7 then 'fresh' when (1706745600.0::double - last_modified) / 86400 < 30 then 'recent'
  when (1706745600.0::double - last_modified) / 86400 < 90 then 'aging' else 'stale' end as bucket, count(*) as n from evidence group by 1""", "evidence"))
def _(spark, d):
    from lodestar.functions.text import freshness

    return evidence(spark, d).groupBy(freshness(F.col("last_modified"), AS_OF_EPOCH).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("answer_confidence", oracle("select query_id, round(confidence / 100 * 0.7 + case when results > 0 then 0.1 else 0 end + least(evidence_count / 3, 1) * 0.2, 6) as full_score, round(confidence / 100 * 0.7 + least(evidence_count / 3, 1) * 0.3, 6) as plain_score from metrics", "metrics"))
def _(spark, d):
    from .views import metrics

    m = metrics(spark, d)
    a, c = F.col("confidence") / 100, F.col("evidence_count")
    return m.select("query_id", F.round(T.answer_confidence(a, c, F.col("results") > 0), 6).alias("full_score"), F.round(T.answer_confidence(a, c), 6).alias("plain_score"))


@query("evidence_packet", oracle(f"""{_FUSED} select case when count(*) = 0 then 'insufficient_evidence' else 'success' end as status, count(*) filter (label = 'Code') as code, count(*) filter (label = 'Document') as claims,
string_agg(uid, ',' order by score desc, path, uid) as ranked from hits""", "evidence", "evidence_edges"))
def _(spark, d):
    from lodestar.operators.packet import assemble

    return assemble(_hits(spark, d)).select("status", F.size("code_truth").cast("long").alias("code"), F.size("doc_claims").cast("long").alias("claims"), F.array_join("ranked", ",").alias("ranked"))


@query("source_mix", oracle(f"{_FUSED} select sources, count(*) as n from hits group by sources", "evidence", "evidence_edges"))
def _(spark, d):
    return _hits(spark, d).groupBy(F.array_join("sources", ",").alias("sources")).agg(F.count(F.lit(1)).alias("n"))
