"""Vector, lexical and hybrid matching of whole tables of queries against whole corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as C
from ..plans.blocked import BLOCK_ROWS, cosine_topk, weighted_terms_topk
from ..plans.cells import CodeIndex, build_codes, code_candidates, pruned_cosine_topk, rescored
from ..plans.impact import ListSearch, sliced_bands, with_band
from ..plans.skew import top_per_key
from ..session import materialize

SCORE_DIGITS = 6
#: Cells that a query reads at least, candidates scored again for each match, and codes read for each of these.
ANN_PROBES = 16
ANN_RERANK = 8
ANN_READ = 8
#: A query reads the codes of a group of this size whole: cells tell little where vectors are equally far from each other.
ANN_WHOLE = 4096
ONE_PASS_POSTINGS = 1 << 24


def cosine_similarity(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    d = lambda x: x.cast("double")
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(a, b, lambda x, y: d(x) * d(y)))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: d(x) * d(x))))
    return F.try_divide(dot, norm(a) * norm(b))


def _limits(queries: DataFrame, k: int | str, threshold: float | str) -> DataFrame:
    k_ = F.col(k) if isinstance(k, str) else F.lit(k)
    t_ = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    return queries.withColumn("k", k_.cast("int")).withColumn("_threshold", t_.cast("double"))


def vector_topk(queries: DataFrame, nodes: DataFrame, group: list[str], query_id: str, node_id: str,
                k: int | str = C.MAX_MATCHES, threshold: float | str = C.MATCHER_THRESHOLD,
                query_vec: str = "embedding", node_vec: str = "embedding", pruned: bool | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query the best ``k`` nodes of its group at or above ``threshold`` (numbers or columns
    of queries). Cutting to k first gives the same rows: the order is by similarity.

    Nodes are placed in cells, and blocks whose bound is below the threshold or the k-th score of the nearest block are
    not read (``pruned``; by default where a group has more than one block of nodes, since one block can't be skipped)."""
    q = _limits(queries, k, threshold)
    if pruned is None:
        largest = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
        pruned = (largest or 0) > block_rows
    if pruned:
        best, _ = _pruned(q, nodes, group, query_id, node_id, query_vec, node_vec, k, block_rows=block_rows)
    else:
        best = cosine_topk(q, nodes, group, query_id, node_id, query_vec, node_vec, "k", SCORE_DIGITS, max_k=_largest(q, k))
    return (best.join(q.select(*group, query_id, "_threshold"), [*group, query_id])
            .filter(F.col("similarity") >= F.col("_threshold")).drop("_threshold"))


def _largest(q: DataFrame, k: int | str) -> int:
    return k if isinstance(k, int) else int(q.agg(F.max("k")).first()[0] or 0)


def _pruned(q, nodes, group, query_id, node_id, query_vec, node_vec, k, **options):
    return pruned_cosine_topk(q, nodes, group, query_id, node_id, query_vec, node_vec, "k", SCORE_DIGITS, _largest(q, k), "_threshold", **options)


def block_pruning(queries: DataFrame, nodes: DataFrame, group: list[str], query_id: str, node_id: str,
                  k: int | str = C.MAX_MATCHES, threshold: float | str = C.MATCHER_THRESHOLD,
                  query_vec: str = "embedding", node_vec: str = "embedding", **options) -> DataFrame:
    """(queries, scored_pairs, all_pairs): pairs of a query and a block of its group that the exact search reads."""
    q = _limits(queries, k, threshold)
    _, pairs = _pruned(q, nodes, group, query_id, node_id, query_vec, node_vec, k, **options)
    scored = pairs.agg(F.count(F.lit(1)).alias("scored_pairs"))
    blocks = pairs.select(*group, "_cell", "_sub").distinct()
    sizes = blocks.groupBy(*group).agg(F.count(F.lit(1)).alias("_blocks"))
    asked = q.groupBy(*group).agg(F.count(F.lit(1)).alias("_queries"))
    met = asked.join(sizes, group) if group else asked.crossJoin(sizes)       # one row each
    total = met.agg(F.sum("_queries").alias("queries"), F.sum(F.col("_queries") * F.col("_blocks")).alias("all_pairs"))
    return total.crossJoin(scored).select("queries", "scored_pairs", "all_pairs")


def vector_topk_ann(queries: DataFrame, nodes: DataFrame, group: list[str], query_id: str, node_id: str,
                    k: int = C.MAX_MATCHES, cells: int | None = None, probes: int = ANN_PROBES, rerank: int | None = None,
                    query_vec: str = "embedding", node_vec: str = "embedding", index: CodeIndex | None = None) -> DataFrame:
    """Approximate neighbours from an index of product codes in cells (``index``, or one built here): the ``rerank``
    nearest by their codes are scored again with their vectors. A query reads ``probes`` cells and more of them until
    these hold ANN_READ times ``rerank`` vectors of its group, and ANN_WHOLE at least, so a small group is searched whole."""
    rerank = rerank or ANN_RERANK * k
    index = index or build_codes(nodes, group, node_id, node_vec, cells)
    own = [F.col(g).alias(g) for g in group]
    q = materialize(queries.select(*own, F.col(query_id).alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv"),
                                   F.lit(k).alias("_k")), "ann-queries")
    near = materialize(code_candidates(q, index, max(ANN_READ * rerank, ANN_WHOLE), probes, rerank), "candidates")
    vectors = nodes.select(*own, F.col(node_id).alias("_nid"), F.col(node_vec).alias("_nv"))
    scored = rescored(q, near, vectors, group, SCORE_DIGITS).withColumnsRenamed({"_qid": query_id, "_nid": node_id})
    return rank_per(scored, [*group, query_id], "similarity", node_id, k)


def ann_recall(found: DataFrame, exact: DataFrame, group: list[str], query_id: str, node_id: str) -> DataFrame:
    """(group, wanted, recalled): exact matches, and how many of them the approximate search found."""
    hit = found.select(*group, query_id, node_id, F.lit(1).alias("_hit"))
    return (exact.join(hit, [*group, query_id, node_id], "left").groupBy(*group)
            .agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("recalled")))


# --------------------------------------------------------------------------- lexical
def tokens(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def bm25_index(docs: DataFrame, doc_id: str, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """Postings (field, doc_id, term, tf, dl) of the whole corpus; write them as a table to search
    them more than once. For a single search, ``terms`` (term) leaves out all others before the shuffle."""
    def one(field: str) -> DataFrame:
        return (docs.select(F.lit(field).alias("field"), F.col(doc_id).alias("doc_id"), tokens(field).alias("_t"))
                .withColumn("dl", F.size("_t").cast("bigint")))
    rows = reduce(DataFrame.unionByName, [one(f) for f in fields])
    words = rows.select("field", "doc_id", "dl", F.explode("_t").alias("term"))
    if terms is not None:
        words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return (words.groupBy("field", "doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf")))


def bm25_stats(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(field, docs, avgdl); documents without a token count too."""
    n = docs.agg(F.count(F.lit(1)).alias("docs"))
    total = postings.groupBy("field").agg(F.sum("tf").alias("_t"))
    return total.join(F.broadcast(n)).select("field", "docs", (F.col("_t") / F.col("docs")).alias("avgdl"))   # n: one row


def field_stats(docs: DataFrame, fields: list[str]) -> DataFrame:
    """bm25_stats in one pass over the documents, without an index of them."""
    sizes = docs.select(*[F.coalesce(F.size(tokens(f)), F.lit(0)).cast("bigint").alias(f) for f in fields])
    one = sizes.agg(F.count(F.lit(1)).alias("docs"), *[F.sum(f).alias(f) for f in fields])
    per = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("_t")) for f in fields]))
    return (one.select("docs", per.alias("_f")).where(F.col("_f._t") > 0)
            .select("_f.field", "docs", (F.col("_f._t") / F.col("docs")).alias("avgdl")))


def bm25_search(queries: DataFrame, query_id: str, query_text: str, postings: DataFrame, stats: DataFrame,
                k: int = C.MAX_MATCHES, docs: DataFrame | None = None, boosts: dict[str, float] | None = None,
                k1: float = C.BM25_K1, b: float = C.BM25_B, lists: bool | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): best 2*k documents per query, the score being that of the best
    boosted field; with ``docs`` (doc_id, project_id) only documents of the query's own project.
    Statistics stay those of the whole index.

    Only postings of query terms take part, and of these only the bands of each list whose impact can still matter
    (``lists``). By default, queries of one block over few postings are scored in one pass over all of these instead,
    which costs less than finding out what to leave out; the rows are the same."""
    boosts = boosts or C.BM25_FIELD_BOOSTS
    terms = (queries.select(F.col(query_id).alias("query"), F.explode(tokens(query_text)).alias("term"))
             .groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf")))
    wanted = postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    boost = F.coalesce(*[F.when(F.col("field") == name, F.lit(float(x))) for name, x in boosts.items()], F.lit(1.0))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = (terms.join(df, "term").join(F.broadcast(stats), "field")              # stats: one row per field
               .select("query", "field", "term", (idf * F.col("qtf") * boost).alias("w")))
    tf = F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    entries = wanted.join(F.broadcast(stats), "field").select("field", "term", F.col("doc_id").alias("node"), tf.alias("f"))
    group: list[str] = []
    if docs is not None:
        group = ["project_id"]
        weights = weights.join(queries.select(F.col(query_id).alias("query"), "project_id"), "query")
        entries = entries.join(docs.select(F.col("doc_id").alias("node"), "project_id"), "node")
    weights = materialize(weights, "weights")
    if group:                   # a word of one project's queries is no reason to carry its postings in all others
        entries = entries.join(weights.select(*group, "field", "term").distinct(), [*group, "field", "term"], "left_semi")
    entries = materialize(with_band(entries, k1 + 1), "query-postings")
    if lists is None:
        lists = weights.select("query").distinct().count() > BLOCK_ROWS or entries.count() > ONE_PASS_POSTINGS
    if lists:
        found = ListSearch(weights, *sliced_bands(entries, group), group, C.CANDIDATE_FACTOR * k, SCORE_DIGITS).top()
        found = found.withColumnsRenamed({"query": query_id, "node": "doc_id"})
    else:
        found = weighted_terms_topk(weights.withColumnRenamed("query", query_id), entries.withColumnRenamed("node", "doc_id"), group,
                                    query_id, "doc_id", C.CANDIDATE_FACTOR * k, SCORE_DIGITS)
    return found.select(*group, query_id, "doc_id", "score", "rank")


def rank_per(df: DataFrame, keys: list[str], score: str, tie: str, n: int, out: str = "rank") -> DataFrame:
    return top_per_key(df, keys, [F.col(score).desc(), F.col(tie)], n, out)


# --------------------------------------------------------------------------- fusion
def hybrid_union(lex: DataFrame, vec: DataFrame, query_id: str, k: int = C.MAX_MATCHES,
                 keyword_threshold: float = C.BM25_THRESHOLD, vector_threshold: float = C.VECTOR_THRESHOLD) -> DataFrame:
    """Documents passing either threshold, ordered by max(bm25/10, cosine), best ``k`` per query,
    with the similarity that is reported for them. lex has ``score``, vec has ``similarity``."""
    l = lex.filter(F.col("score") >= keyword_threshold).select(query_id, "doc_id", F.col("score").alias("_k"))
    v = vec.filter(F.col("similarity") >= vector_threshold).select(query_id, "doc_id", F.col("similarity").alias("_v"))
    both = l.join(v, [query_id, "doc_id"], "full").select(
        query_id, "doc_id",
        F.coalesce("_k", F.lit(0.0)).alias("keyword_score"), F.coalesce("_v", F.lit(0.0)).alias("vector_score"),
        F.when(F.col("_v").isNull(), "keyword").when(F.col("_k").isNull(), "vector").otherwise("both").alias("match_type"))
    scored = both.withColumn("_best", F.greatest(F.col("keyword_score") / 10.0, F.col("vector_score")))
    reported = F.greatest(F.least(F.lit(0.5) + F.col("keyword_score") / 12.0, F.lit(1.0)), F.col("vector_score"))
    return (rank_per(scored, [query_id], "_best", "doc_id", k)
            .withColumn("similarity", F.round(reported, SCORE_DIGITS)).drop("_best"))


def hybrid_rrf(lex: DataFrame, vec: DataFrame, query_id: str, n: int, k: int = C.RRF_K,
               vector_boost: float = C.RRF_VECTOR_BOOST) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (column ``rank``)."""
    l = lex.select(query_id, "doc_id", F.col("rank").alias("_l"))
    v = vec.select(query_id, "doc_id", F.col("rank").alias("_v"))
    part = lambda r, boost: F.coalesce(F.lit(float(boost)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    fused = l.join(v, [query_id, "doc_id"], "full").select(
        query_id, "doc_id", F.round(part("_l", 1.0) + part("_v", vector_boost), 9).alias("score"))
    return rank_per(fused, [query_id], "score", "doc_id", n)


def hybrid_matches(lex: DataFrame, vec: DataFrame, query_id: str, k: int = C.MAX_MATCHES, **thresholds) -> DataFrame:
    """Hybrid hits of needs: fetch 2*k by the best raw score, order again by the reported similarity,
    keep ``k``."""
    wide = hybrid_union(lex, vec, query_id, C.CANDIDATE_FACTOR * k, **thresholds)
    return rank_per(wide.drop("rank"), [query_id], "similarity", "doc_id", k)


def match_needs(needs: DataFrame, matches: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(matches, hits per need with zeros): needs without a hit stay with 0."""
    hits = matches.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))
    return matches, needs.select(*keys).join(hits, keys, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def threshold_refilter(matches: DataFrame, keys: list[str], node_id: str, k: int, threshold: float) -> DataFrame:
    """Of the best 3*k matches those at or above the threshold, best ``k``, with a percentage."""
    wide = matches.filter(F.col("rank") <= C.REFILTER_FACTOR * k).filter(F.col("similarity") >= threshold)
    return (rank_per(wide.drop("rank"), keys, "similarity", node_id, k)
            .withColumn("percent", F.floor(F.col("similarity") * 1000 + 0.5) / 10))


def index_stats(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    d = nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"))
    v = vectors.groupBy("project_id").agg(F.count(F.lit(1)).alias("embeddings"))
    return d.join(v, "project_id", "full").select(
        "project_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("embeddings", F.lit(0)).alias("embeddings"))
