"""Vector, neighbour and community queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import communities as C
from ..operators import components as U
from ..operators import neighbours as N
from ..session import stash, table


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    m = N.mean_vectors(_emb(spark, d), "label", "embedding")
    return m.select("label", "pos", F.round("mean", 6).alias("mean"), "n")


def profile_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the mean vectors of labels 0, 1 and 2 as the three profile parts; the 500 nearest."""
    c = N.centroids(_emb(spark, d).where("label in (0, 1, 2)"), "label", "embedding").agg(F.map_from_entries(F.collect_list(F.struct("label", "centroid"))).alias("m"))  # three entries
    x = _emb(spark, d).crossJoin(F.broadcast(c))
    cos = lambda k: V.cosine(F.col("embedding"), F.element_at("m", F.lit(k)))
    p = F.round(0.5 * cos(0) + 0.3 * cos(1) + 0.2 * cos(2), 6)
    return x.select("vec_id", p.alias("score")).orderBy(F.desc("score"), "vec_id").limit(500)


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 20."""
    return N.nearest(_emb(spark, d), _emb(spark, d).where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


def neighbor_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours above 0.2, at most 30, of the query vectors that are not in the sidecar yet (multiples of 40 are)."""
    q = _emb(spark, d).where("vec_id % 20 = 0 and vec_id % 40 <> 0")
    return N.nearest(_emb(spark, d), q, "vec_id", "embedding", 30, least=0.2).select(F.col("query").alias("src"), F.col("vec_id").alias("dst"), F.round("sim", 3).alias("score"), "rank")


def knn_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    n = N.nearest(_emb(spark, d), _emb(spark, d).where("vec_id % 20 = 0"), "vec_id", "embedding", 15)
    return N.undirected(n, "query", "vec_id", "sim")


def centroid_bars(spark: SparkSession, d: str) -> DataFrame:
    """Per label: members, and the percentile of their similarity to the centroid that a soft member must reach."""
    e = _emb(spark, d)
    s = e.join(N.centroids(e, "label", "embedding"), "label").select("label", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("sim"))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.expr("percentile(sim, 0.4)"), 5).alias("bar"), F.round(F.min("sim"), 5).alias("least"))


def soft_membership(spark: SparkSession, d: str) -> DataFrame:
    m = N.soft_members(_emb(spark, d), "vec_id", "embedding", "label")
    return m.groupBy("label").agg(F.count("*").alias("members"), F.count_if("is_primary").alias("primaries"))


def membership_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many groups vectors belong to."""
    m = N.soft_members(_emb(spark, d), "vec_id", "embedding", "label").groupBy("vec_id").agg(F.count("*").alias("groups"))
    return m.groupBy("groups").agg(F.count("*").alias("n"))


def vector_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Best similarity of a vector over all query variants (ids divisible by 20), the 50 best."""
    n = N.nearest(_emb(spark, d), _emb(spark, d).where("vec_id % 20 = 0"), "vec_id", "embedding", 30)
    return n.groupBy("vec_id").agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), "vec_id").limit(50)


def _coauthors(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, weight): authors named on one paper; a list names at most a handful."""
    p = table(spark, d, "digest_papers").select("id", F.explode(F.array_distinct(F.filter("authors", lambda x: x.rlike(r"\S") & ~x.rlike(r"(?i)^\s*et al")))).alias("name"))
    q = p.select("id", F.col("name").alias("b"))
    e = p.withColumnRenamed("name", "a").join(q, "id").where("a < b")
    return e.groupBy("a", "b").agg(F.count("*").cast("double").alias("weight"))


def coauthor_edges(spark: SparkSession, d: str) -> DataFrame:
    return _coauthors(spark, d)


def coauthor_components(spark: SparkSession, d: str) -> DataFrame:
    c = U.connected_components(_coauthors(spark, d), "a", "b")
    return c.groupBy("component").agg(F.count("*").alias("n"))


def coauthor_communities(spark: SparkSession, d: str) -> DataFrame:
    e = stash(_coauthors(spark, d))
    return C.merge_tiny(e, C.communities(e)).groupBy("community").agg(F.count("*").alias("n"))


def community_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Communities and modularity at three resolutions."""
    e = stash(_coauthors(spark, d))
    out = None
    for r in (0.5, 1.0, 2.0):
        one = C.modularity(e, C.communities(e, r), r).withColumn("resolution", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def _journal_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Co-author edges with each author's most frequent journal as a given community."""
    e = _coauthors(spark, d)
    j = table(spark, d, "digest_papers").where(F.col("journal").isNotNull()).select("journal", F.explode("authors").alias("node")).groupBy("node", "journal").agg(F.count("*").alias("n"))
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "journal"))).where("r = 1").select("node", F.col("journal").alias("community"))
    return e, best


def related_communities(spark: SparkSession, d: str) -> DataFrame:
    return C.related(*_journal_graph(spark, d))


def community_top_degree(spark: SparkSession, d: str) -> DataFrame:
    return C.central_members(*_journal_graph(spark, d))


def bridge_authors(spark: SparkSession, d: str) -> DataFrame:
    return C.bridges(*_journal_graph(spark, d))


def bridge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Authors on most shortest paths of the co-author graph, from one author in twenty as sources; the 30 first who touch another journal's authors."""
    e, parts = _journal_graph(spark, d)
    e = stash(e)
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    b = C.betweenness(e, nodes.where(F.pmod(F.xxhash64("node"), F.lit(20)) == 0))
    b = b.join(C.other_communities(e, parts), "node").select("node", "betweenness", F.size("others").alias("communities"))
    return b.orderBy(F.desc("betweenness"), "node").limit(30)


def label_cache_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Journals' member sets of 2024 against those of 2023: same set, near (Jaccard 0.05 and more) or to be labelled anew.

    The overlap is counted on shared members, so only sets with one in common meet.
    """
    m = table(spark, d, "digest_papers").where(F.col("journal").isNotNull()).select("journal", F.year("pub_date").alias("y"), F.explode("authors").alias("a")).where("a is not null").distinct()
    one = lambda y: m.where(F.col("y") == y).select("journal", "a")
    size = lambda x: x.groupBy("journal").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set("a")), "\n"), 256).alias("h"))
    new, old = one(2024), one(2023)
    both = new.join(old.withColumnRenamed("journal", "old"), "a").groupBy("journal", "old").agg(F.count("*").alias("k"))
    sn, so = size(new), size(old).select(F.col("journal").alias("old"), F.col("n").alias("m"), F.col("h").alias("oh"))
    j = both.join(sn, "journal").join(so, "old").withColumn("jaccard", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6))
    best = j.withColumn("r", F.row_number().over(Window.partitionBy("journal").orderBy(F.desc("jaccard"), "old"))).where("r = 1").select("journal", "old", "jaccard", (F.col("h") == F.col("oh")).alias("same"))
    reuse = F.when(F.col("same"), "same").when(F.col("jaccard") >= 0.05, "near").otherwise("new")
    return sn.select("journal").join(best, "journal", "left").select("journal", F.coalesce("jaccard", F.lit(0.0)).alias("jaccard"), reuse.alias("label"))


QUERIES = {f.__name__: f for f in (
    mean_vectors, profile_similarity, knn_topk, neighbor_sidecar, knn_graph_edges, centroid_bars, soft_membership, membership_histogram, vector_multi_query, coauthor_edges, coauthor_components, coauthor_communities,
    community_sweep, related_communities, community_top_degree, bridge_authors, bridge_betweenness, label_cache_reuse)}

NEAR = """x as (select vec_id, list_transform(embedding, lambda v: v::double) as v from embeddings), u as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from x),
  s as (select a.vec_id as query, b.vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) as sim from u a, u b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
  r as (select *, (row_number() over (partition by query order by sim desc, vec_id))::int as rank from s)"""
CENT = """m as (select label, pos, avg(x::double) as mean from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all),
  c as (select label, array_agg(mean order by pos) as c from m group by label), cn as (select label, c, sqrt(list_dot_product(c, c)) as n from c),
  x as (select vec_id, label as own, list_transform(embedding, lambda v: v::double) as v from embeddings),
  sims as (select vec_id, own, label, round(list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * n), 6) as sim from x, cn),
  bar as (select label, quantile_cont(sim, 0.4) as bar, count(*) as n, min(sim) as least from sims where own = label group by label),
  soft as (select vec_id, label, own = label as is_primary from sims join bar using (label) where sim >= bar or own = label)"""
COAUTHOR = r"""p as (select distinct id, a from (select id, unnest(authors) as a from digest_papers) where regexp_matches(a, '\S') and not regexp_matches(a, '(?i)^\s*et al')),
  e as (select x.a as a, y.a as b, count(*)::double as weight from p x join p y on x.id = y.id and x.a < y.a group by all),
  j as (select node, journal, row_number() over (partition by node order by count(*) desc, journal) as r from (select journal, unnest(authors) as node from digest_papers where journal is not null) group by node, journal),
  parts as (select node, journal as community from j where r = 1),
  ee as (select e.*, pa.community as ca, pb.community as cb from e join parts pa on pa.node = a join parts pb on pb.node = b)"""
ORACLE = {
    "mean_vectors": "select label, (pos - 1)::int as pos, round(avg(x::double), 6) as mean, count(*) as n from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by all",
    "profile_similarity": f"with {CENT} select vec_id, round(0.5 * max(raw) filter (label = 0) + 0.3 * max(raw) filter (label = 1) + 0.2 * max(raw) filter (label = 2), 6) as score from (select vec_id, label, list_dot_product(v, c) / (sqrt(list_dot_product(v, v)) * n) as raw from x, cn) group by vec_id order by score desc, vec_id limit 500",
    "knn_topk": f"with {NEAR} select query, vec_id, sim, rank from r where rank <= 10",
    "neighbor_sidecar": f"with {NEAR} select query as src, vec_id as dst, round(sim, 3) as score, rank from r where sim >= 0.2 and rank <= 30 and query % 40 <> 0",
    "knn_graph_edges": f"with {NEAR} select least(query, vec_id) as a, greatest(query, vec_id) as b, max(sim) as weight from r where rank <= 15 group by all having max(sim) > 0",
    "centroid_bars": f"with {CENT} select label, n, round(bar, 5) as bar, round(least, 5) as least from bar",
    "soft_membership": f"with {CENT} select label, count(*) as members, count(*) filter (is_primary) as primaries from soft group by label",
    "membership_histogram": f"with {CENT} select groups, count(*) as n from (select vec_id, count(*) as groups from soft group by vec_id) group by groups",
    "vector_multi_query": f"with {NEAR} select vec_id, max(sim) as sim from r where rank <= 30 group by vec_id order by sim desc, vec_id limit 50",
    "coauthor_edges": f"with {COAUTHOR} select * from e",
    "related_communities": f"""with {COAUTHOR}, w as (select least(ca, cb) as x, greatest(ca, cb) as y, round(sum(weight), 6) as weight from ee where ca <> cb group by all),
        b as (select x as community, y as other, weight from w union all select y, x, weight from w) select * from (select *, (row_number() over (partition by community order by weight desc, other desc))::int as rank from b) where rank <= 4""",
    "community_top_degree": f"""with {COAUTHOR}, d as (select community, node, round(sum(weight), 6) as degree from (select ca as community, unnest([a, b]) as node, weight from ee where ca = cb) group by all)
        select * from (select *, (row_number() over (partition by community order by degree desc, node))::int as rank from d) where rank <= 10""",
    "bridge_authors": f"""with {COAUTHOR}, o as (select a as node, ca as community, cb as o, weight from ee where ca <> cb union all select b, cb, ca, weight from ee where ca <> cb)
        select node, community, count(distinct o) as others, round(sum(weight), 6) as across from o group by all order by others desc, across desc, node limit 30""",
    "label_cache_reuse": """with m as (select distinct journal, year(pub_date) as y, a from (select journal, pub_date, unnest(authors) as a from digest_papers where journal is not null)), n as (select * from m where y = 2024 and a is not null), o as (select * from m where y = 2023 and a is not null),
        sn as (select journal, count(*) as n, string_agg(a, chr(10) order by a) as h from n group by journal), so as (select journal as old, count(*) as m, string_agg(a, chr(10) order by a) as oh from o group by journal),
        k as (select n.journal, o.journal as old, count(*) as k from n join o using (a) group by all), j as (select journal, old, round(k / (n + m - k), 6) as jaccard, h = oh as same from k join sn using (journal) join so using (old)),
        b as (select *, row_number() over (partition by journal order by jaccard desc, old) as r from j)
        select sn.journal, coalesce(jaccard, 0.0)::double as jaccard, case when same then 'same' when jaccard >= 0.05 then 'near' else 'new' end as label from sn left join (select * from b where r = 1) b using (journal)""",
}
