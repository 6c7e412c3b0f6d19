"""Vector, keyword and hybrid search over evidence nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import with_totals
from .graph import cut


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(column: str, query: Sequence[float]) -> Column:
    """Cosine of an array column and a literal vector; the query's norm is folded into the literal."""
    norm = sum(float(x) * float(x) for x in query) ** 0.5 or 1.0
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    own = F.sqrt(dot(F.col(column), F.col(column)))
    return F.when(own > 0, dot(F.col(column), q) / own)


def vector_topk(nodes: DataFrame, query: Sequence[float], k: int = 500, key: str = "uid", column: str = "embedding", minimum: float | None = None) -> DataFrame:
    """The k nodes nearest to query, with score; filters on nodes apply before the cut, so the result is exact."""
    out = nodes.where(F.col(column).isNotNull()).withColumn("score", cosine(column, query))
    if minimum is not None:
        out = out.where(F.col("score") >= minimum)
    return out.orderBy(F.desc("score"), key).limit(k)


def bm25(nodes: DataFrame, query: str, k: int | None = 100, key: str = "uid", column: str = "docstring", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score by Okapi BM25 over lower-case ASCII words. Texts are split once; their counts, a row each, are written
    out and give both the totals and the scores."""
    words = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    docs = nodes.select(F.col(key), F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "[^a-z0-9]+").alias("_t"))
    n = F.size("_t") - F.when(F.get("_t", F.lit(0)) == "", 1).otherwise(0) - F.when((F.size("_t") > 1) & (F.element_at("_t", -1) == ""), 1).otherwise(0)
    sized = cut(docs.select(key, n.alias("_n"), *[(F.size("_t") - F.size(F.array_remove("_t", w))).alias(f"_f{i}") for i, w in enumerate(words)]))
    stats = sized.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(words))])
    hit = sized.where(sum((F.col(f"_f{i}") for i in range(len(words))), F.lit(0)) > 0)
    scored = with_totals(hit, stats)
    parts = []
    for i in range(len(words)):
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        parts.append(F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))).otherwise(0.0))
    out = scored.select(key, sum(parts, F.lit(0.0)).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(k) if k else out


def fuse_max(hits: dict[str, DataFrame], key: str = "uid") -> DataFrame:
    """One row per key: the largest score of any source, and the sources."""
    union = None
    for name, df in hits.items():
        part = df.select(key, "score", F.lit(name).alias("source"))
        union = part if union is None else union.unionByName(part)
    return union.distinct().groupBy(key).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))


def fuse_minmax(hits: dict[str, DataFrame], weights: dict[str, float], key: str = "uid") -> DataFrame:
    """Weighted sum of scores scaled to 0..1 within each source (1 if all are equal)."""
    union = None
    for name, df in hits.items():
        span = df.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        part = with_totals(df.select(key, "score"), span)
        scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(1.0)
        part = part.select(key, (scaled * weights.get(name, 1.0)).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.sum("part").alias("score"))


def fuse_rrf(hits: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = 60, key: str = "uid", most: int = 500) -> DataFrame:
    """Reciprocal rank fusion of the best `most` of each list: the sum of weight / (k + rank)."""
    union = None
    for name, df in hits.items():
        df = df.orderBy(F.desc("score"), key).limit(most)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), key))  # over the rows that the limit leaves
        part = df.select(key, (F.lit((weights or {}).get(name, 1.0)) / (k + rank)).alias("part"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.sum("part").alias("score"))


def neighbours(hits: DataFrame, nodes: DataFrame, edges: DataFrame, types: Sequence[str] | None = None, key: str = "uid") -> DataFrame:
    """hits with the sorted names of themselves and of what they touch by an edge of the given types, either way."""
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    step = e.select(F.col("src").alias(key), F.col("dst").alias("to")).unionByName(e.select(F.col("dst").alias(key), F.col("src").alias("to")))
    ids = hits.select(key)
    reached = ids.select(key, F.col(key).alias("to")).unionByName(ids.join(step, key))
    names = reached.join(nodes.select(F.col(key).alias("to"), F.col("name").alias("_name")), "to")
    near = names.groupBy(key).agg(F.array_sort(F.collect_set("_name")).alias("neighbors"))
    return hits.join(near, key, "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<string>")))


EXPANSION = ("DEFINES", "HAS_COMPONENT", "HAS_ASSET", "CALLS", "DEPENDS_ON")


def hybrid(nodes: DataFrame, edges: DataFrame, vector: Sequence[float], text: str, k_vector: int = 500, k_text: int = 100, k: int = 20, key: str = "uid", fusion: str = "max", types: Sequence[str] | None = EXPANSION, vectors: DataFrame | None = None) -> DataFrame:
    """Vector and keyword hits fused, the best k of them with the names of their neighbourhood.

    vectors holds key and embedding, if nodes do not. The k hits are written out before their details and neighbours
    are fetched, and again with these, so whatever is asked of them costs no further search.
    """
    hits = {"vector": vector_topk(nodes if vectors is None else vectors, vector, k_vector, key).select(key, "score"), "keyword": bm25(nodes, text, k_text, key)}
    if fusion == "rrf":
        fused = fuse_rrf(hits, key=key).withColumn("sources", F.lit(None).cast("array<string>"))
    elif fusion == "minmax":
        fused = fuse_minmax(hits, {"vector": 0.7, "keyword": 0.3}, key).withColumn("sources", F.lit(None).cast("array<string>"))
    else:
        fused = fuse_max(hits, key)
    best = cut(fused.orderBy(F.desc("score"), key).limit(k))
    info = nodes.select(key, "project", "path", "name", "label", "last_modified")
    return cut(neighbours(best.join(info, key), nodes, edges, types, key))
