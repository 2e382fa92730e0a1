"""Queries of the library over the driver's tables, and their SQL.

Scores are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import blocks, fusion, text
from brindle.functions import vectors as V
from brindle.operators import clusters, encoders, labels, large_clusters, linear, negatives, routing
from brindle.plans import model, parts
from brindle.sources import files, variables

WIDTH = 64


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions m with label l and vector e of doubles."""
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("m"), F.col("label").alias("l"), V.doubles(F.col("embedding")).alias("e"))


def _z(x: DataFrame) -> DataFrame:
    return labels.pifa_dense(x, "e", "l")


def _r(c, digits: int = 6):
    return F.round(c, digits)


# SQL: mentions, their long form, label embeddings
_SQL_X = "x AS (SELECT vec_id AS m, label AS l, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SQL_Z = f"""{_SQL_X}, xl AS (SELECT m, l, unnest(range(1, 65)) AS i, unnest(e) AS v FROM x),
 s AS (SELECT l, i, sum(v) AS v FROM xl GROUP BY l, i), sn AS (SELECT l, sqrt(sum(v * v)) AS n FROM s GROUP BY l),
 z1 AS (SELECT s.l, i, v / (n + 1e-10) AS v FROM s JOIN sn USING (l)), zn AS (SELECT l, sqrt(sum(v * v)) AS n FROM z1 GROUP BY l),
 zl AS (SELECT z1.l, i, CASE WHEN n = 0 THEN v ELSE v / n END AS v FROM z1 JOIN zn USING (l)), z AS (SELECT l, list(v ORDER BY i) AS z FROM zl GROUP BY l)"""


def _tfidf_sql(table: str, key: str, column: str, bigrams: bool, max_features: int | None = None) -> str:
    pairs = f" UNION ALL SELECT {key}, w[k] || ' ' || w[k + 1] FROM (SELECT {key}, w, unnest(range(1, len(w))) AS k FROM tok)" if bigrams else ""
    most = f" ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""tok AS (SELECT {key}, regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM {table}),
 tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM tok{pairs}) GROUP BY ALL), n AS (SELECT count(*) AS n FROM {table}),
 df AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) <= 0.98 * any_value(n){most}),
 raw AS (SELECT {key}, term, tf * idf AS v FROM tf JOIN df USING (term)), rn AS (SELECT {key}, sqrt(sum(v * v)) AS n FROM raw GROUP BY {key}),
 w AS (SELECT raw.{key}, term, v / rn.n AS v FROM raw JOIN rn USING ({key}))"""


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# reading and labels


@query("SELECT p_brand AS label, string_agg(p_name, '|' ORDER BY p_partkey) AS corpus, count(*) AS n FROM part GROUP BY p_brand")
def group_mentions(spark, d):
    grouped = files.group_texts(_t(spark, d, "part"), "p_brand", "p_name", "p_partkey")
    return grouped.select(F.col("p_brand").alias("label"), F.array_join("corpus", "|").alias("corpus"), F.size("corpus").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def concat_by_id(spark, d):
    return files.concat_texts(_t(spark, d, "conversations"), "conv_id", "text", "turn")


_POSITION = """g AS (SELECT p_size, string_agg(p_name, '|' ORDER BY p_partkey) AS corpus FROM part GROUP BY p_size),
 gp AS (SELECT row_number() OVER (ORDER BY p_size) - 1 AS label_pos, corpus FROM g), b AS (SELECT row_number() OVER (ORDER BY p) - 1 AS label_pos, p AS label FROM (SELECT DISTINCT p_name AS p FROM part))"""


@query(f"WITH {_POSITION} SELECT label_pos, label, corpus FROM gp JOIN b USING (label_pos)")
def label_position_join(spark, d):
    part = _t(spark, d, "part")
    grouped = files.group_texts(part, "p_size", "p_name", "p_partkey")
    known = files.ranked(part.select(F.col("p_name").alias("label")).distinct(), "label", "label_pos")
    return files.attach_labels(grouped, known, "p_size").select("label_pos", "label", F.array_join("corpus", "|").alias("corpus"))


@query("SELECT row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS mention_id, p_brand AS label, p_name AS text FROM part")
def flatten_synonyms(spark, d):
    part = _t(spark, d, "part")
    grouped = files.group_texts(part, "p_brand", "p_name", "p_partkey")
    placed = labels.label_dictionary(grouped, "p_brand").withColumnRenamed("label_id", "label_pos")
    return files.flatten(grouped.withColumnRenamed("p_brand", "label").join(placed, "label"))


@query("SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL)")
def label_dictionary(spark, d):
    return labels.label_dictionary(_t(spark, d, "documents"), "source")


@query("WITH d AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT source AS label FROM documents WHERE source IS NOT NULL)) SELECT DISTINCT doc_id, label_id FROM documents JOIN d ON source = label")
def label_matrix(spark, d):
    docs = _t(spark, d, "documents")
    return labels.label_matrix(docs, "doc_id", "source", labels.label_dictionary(docs, "source"))


# text


@query(f"WITH {_tfidf_sql('part', 'p_partkey', 'p_name', True)} SELECT p_partkey, term, tf FROM tf")
def tokenize_ngrams(spark, d):
    return text.terms(_t(spark, d, "part"), "p_partkey", "p_name")


@query(f"WITH {_tfidf_sql('documents', 'doc_id', 'text', False)} SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY doc_id")
def tokenize_documents(spark, d):
    return text.terms(files.spread(_t(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 1, 1).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("words"))


@query(f"WITH {_tfidf_sql('documents', 'doc_id', 'text', False, 2000)} SELECT term, df, cf, round(idf, 6) AS idf FROM df")
def doc_freq_pruned(spark, d):
    docs = _t(spark, d, "documents")
    found = text.document_frequencies(text.terms(files.spread(docs.select("doc_id", "text")), "doc_id", "text", 1, 1), docs.count(), max_features=2000)
    return found.select("term", "df", "cf", _r("idf").alias("idf"))


def _part_weights(spark, d):
    part = _t(spark, d, "part")
    tf = text.terms(part, "p_partkey", "p_name")
    return part, text.weights(tf, text.document_frequencies(tf, part.count()), "p_partkey")


@query(f"WITH {_tfidf_sql('part', 'p_partkey', 'p_name', True)} SELECT p_partkey, term, round(v, 6) AS value FROM w")
def tfidf_weights(spark, d):
    return _part_weights(spark, d)[1].withColumn("value", _r("value"))


_SQL_PIFA_PART = f"""{_tfidf_sql("part", "p_partkey", "p_name", True)}, ps AS (SELECT p_brand AS l, term, sum(v) AS v FROM w JOIN part USING (p_partkey) GROUP BY ALL),
 pn AS (SELECT l, sqrt(sum(v * v)) AS n FROM ps GROUP BY l), pz1 AS (SELECT ps.l, term, v / (n + 1e-10) AS v FROM ps JOIN pn USING (l)), pn2 AS (SELECT l, sqrt(sum(v * v)) AS n FROM pz1 GROUP BY l),
 pz AS (SELECT pz1.l, term, v / n AS v FROM pz1 JOIN pn2 USING (l))"""


def _part_pifa(spark, d):
    part, w = _part_weights(spark, d)
    w = files.checkpointed(w)  # weights are read twice: in labels' embeddings, and in products with them
    x = w.select(F.col("p_partkey").alias("mention_id"), F.col("term").alias("feature"), "value")
    y = part.select(F.col("p_partkey").alias("mention_id"), F.col("p_brand").alias("label_id"))
    return x, files.checkpointed(labels.pifa(x, y))


@query(f"WITH {_SQL_PIFA_PART} SELECT l AS label, term, round(v, 6) AS value FROM pz")
def pifa_tfidf(spark, d):
    return _part_pifa(spark, d)[1].select(F.col("label_id").alias("label"), F.col("feature").alias("term"), _r("value").alias("value"))


@query(f"""WITH {_SQL_PIFA_PART}, dots AS (SELECT w.p_partkey, pz.l, sum(w.v * pz.v) AS s FROM w JOIN pz USING (term) GROUP BY ALL),
 every AS (SELECT p_partkey, l, coalesce(s, 0) AS s FROM part CROSS JOIN (SELECT DISTINCT l FROM pz) LEFT JOIN dots USING (p_partkey, l))
 SELECT p_partkey, l AS label, round(s, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY round(s, 6) DESC, l) AS k FROM every) WHERE k <= 5""")
def cosine_topk_tfidf(spark, d):
    """Labels that share no term with a query score 0, and fill up where there are fewer others."""
    x, z = _part_pifa(spark, d)
    dots = blocks.top_sparse_products(x, z, "mention_id", "label_id", 5)
    asked = _t(spark, d, "part").select(F.col("p_partkey").alias("mention_id"))
    top = V.top_k_of_candidates(dots, asked, z, "mention_id", "label_id", 5)
    return top.select(F.col("mention_id").alias("p_partkey"), F.col("label_id").alias("label"), _r("score").alias("score"), "rank")


# vectors


@query(f"WITH {_SQL_Z} SELECT l AS label, i - 1 AS feature, round(v, 6) AS value FROM zl")
def pifa_dense(spark, d):
    return _z(_x(spark, d)).select(F.col("l").alias("label"), F.posexplode("z").alias("feature", "value")).select("label", F.col("feature").cast("long").alias("feature"), _r("value").alias("value"))


@query(f"WITH {_SQL_X} SELECT m AS vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM x")
def row_norms(spark, d):
    return _x(spark, d).select(F.col("m").alias("vec_id"), _r(V.norm(F.col("e"))).alias("norm"))


@query(f"WITH {_SQL_X} SELECT m AS vec_id, f - 1 AS feature, round(v / n, 6) AS value FROM (SELECT m, unnest(range(1, 65)) AS f, unnest(e) AS v, sqrt(list_dot_product(e, e)) AS n FROM x)")
def l2_normalise(spark, d):
    rows = _x(spark, d).select(F.col("m").alias("vec_id"), F.posexplode(V.unit(F.col("e"))).alias("feature", "value"))
    return rows.select("vec_id", F.col("feature").cast("long").alias("feature"), _r("value").alias("value"))


def _scores(spark, d):
    x = _x(spark, d)
    return V.pairs_with_all(x, _z(x).withColumnRenamed("l", "label"), WIDTH).withColumn("score", V.dot(F.col("e"), F.col("z")))


def _both(spark, d):
    """Mentions and label embeddings, as products in blocks take them."""
    x = _x(spark, d)
    return x.select("m", F.col("e").alias("vec")), _z(x).withColumnRenamed("l", "label")


_SQL_SCORES = f"{_SQL_Z}, sc AS (SELECT m, x.l AS l, z.l AS label, e, z, list_dot_product(e, z) AS score FROM x CROSS JOIN z)"


@query(f"WITH {_SQL_SCORES} SELECT m AS vec_id, label, round(score, 6) AS score FROM sc")
def inner_product_scores(spark, d):
    return _scores(spark, d).select(F.col("m").alias("vec_id"), "label", _r("score").alias("score"))


@query(f"WITH {_SQL_SCORES} SELECT vec_id, label, score, rank FROM (SELECT m AS vec_id, label, round(list_cosine_similarity(e, z), 6) AS score, row_number() OVER (PARTITION BY m ORDER BY round(list_cosine_similarity(e, z), 6) DESC, label) AS rank FROM sc) WHERE rank <= 3")
def cosine_topk_dense(spark, d):
    top = blocks.top_products(*_both(spark, d), "m", "label", 3, 6, cosine=True)
    return top.select(F.col("m").alias("vec_id"), "label", _r("score").alias("score"), "rank")


# clusters

_STEPS = 3


def _lloyd_sql() -> str:
    parts = [f"{_SQL_X}, c0 AS (SELECT m AS k, e AS c FROM x WHERE m < 4)"]
    for n in range(_STEPS):
        parts.append(f"a{n} AS (SELECT m, l, e, k AS cluster FROM (SELECT m, l, e, k, row_number() OVER (PARTITION BY m ORDER BY round(list_dot_product(e, c) / sqrt(list_dot_product(c, c)), 9) DESC, k) AS r FROM x CROSS JOIN c{n}) WHERE r = 1)")
        if n < _STEPS - 1:
            parts.append(f"c{n + 1} AS (SELECT cluster AS k, list(v ORDER BY i) AS c FROM (SELECT cluster, i, avg(v) AS v FROM (SELECT cluster, unnest(range(1, 65)) AS i, unnest(e) AS v FROM a{n}) GROUP BY cluster, i) GROUP BY cluster)")
    return ", ".join(parts)


_SQL_LLOYD = _lloyd_sql()


def _lloyd(spark, d):
    x = _x(spark, d)
    start = [r["e"] for r in x.filter("m < 4").orderBy("m").select("e").collect()]
    return clusters.lloyd(x, start, _STEPS)


@query(f"WITH {_SQL_LLOYD} SELECT m AS vec_id, CAST(cluster AS INTEGER) AS cluster FROM a2")
def lloyd_assign(spark, d):
    return _lloyd(spark, d).select(F.col("m").alias("vec_id"), "cluster")


@query(f"WITH {_SQL_LLOYD} SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS size FROM a2 GROUP BY 1")
def cluster_histogram(spark, d):
    return clusters.histogram(_lloyd(spark, d))


@query(f"WITH {_SQL_LLOYD}, h AS (SELECT cluster, count(*) AS size, min(m) AS f FROM a2 GROUP BY 1 HAVING count(*) >= 20) SELECT CAST(cluster AS INTEGER) AS cluster, row_number() OVER (ORDER BY f) - 1 AS new_id, size FROM h WHERE (SELECT count(*) FROM h) > 1")
def valid_clusters(spark, d):
    found = clusters.valid_clusters(_lloyd(spark, d), 20, "m")
    return found.select("cluster", F.col("new_id").cast("long").alias("new_id"), "size")


@query(f"WITH {_SQL_LLOYD} SELECT CAST(cluster AS INTEGER) AS cluster, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS labels FROM a2 GROUP BY 1")
def cluster_label_members(spark, d):
    return clusters.members(_lloyd(spark, d), "m").select("cluster", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


def _label_clusters(spark, d):
    own = _t(spark, d, "embeddings").select(F.col("label").alias("label_id")).distinct()
    return own.withColumn("cluster", (F.col("label_id") % 3).cast("int"))


_SQL_LC = "lc AS (SELECT DISTINCT label, CAST(label % 3 AS INTEGER) AS cluster FROM embeddings)"


@query(f"WITH {_SQL_LC} SELECT DISTINCT vec_id, cluster FROM embeddings JOIN lc USING (label)")
def mention_cluster_matrix(spark, d):
    y = _t(spark, d, "embeddings").select(F.col("vec_id").alias("mention_id"), F.col("label").alias("label_id"))
    return labels.mention_clusters(y, _label_clusters(spark, d)).withColumnRenamed("mention_id", "vec_id")


# routing: matchers are the embeddings of all labels; a label belongs to the cluster of its number, four apart


def _matched(spark, d):
    x = _x(spark, d)
    z = _z(x).withColumnRenamed("l", "cluster")
    return V.pairs_with_all(x, z, WIDTH).withColumn("score", V.sigmoid(4 * V.dot(F.col("e"), F.col("z"))))


_SQL_M = f"{_SQL_Z}, mt AS (SELECT m, x.l AS l, e, z.l AS cluster, 1 / (1 + exp(-4 * list_dot_product(e, z.z))) AS score FROM x CROSS JOIN z)"


@query(f"WITH {_SQL_M} SELECT m AS vec_id, round(sum(CASE WHEN cluster = l THEN score ELSE 0 END), 6) AS own_score, round(sum(score), 6) AS sum_score, round(max(score), 6) AS max_score FROM mt GROUP BY m")
def routing_features(spark, d):
    got = routing.routing_features(_matched(spark, d).withColumn("own", F.col("cluster") == F.col("l")), "m")
    return got.select(F.col("m").alias("vec_id"), *(_r(c).alias(c) for c in ("own_score", "sum_score", "max_score")))


@query(f"WITH {_SQL_SCORES} SELECT label, round(sum(score) / (SELECT count(*) FROM x), 6) AS mean_score, round(sum(score), 6) AS sum_score, round(max(score), 6) AS max_score FROM sc GROUP BY label")
def label_affinity(spark, d):
    x = _x(spark, d)
    node = F.lit(0).cast("long").alias("node")
    got = blocks.affinity(x.select(node, F.col("m").alias("mention_id"), F.col("e").alias("vec")), _z(x).select(node, F.col("l").alias("label_id"), "z"), ["node"])
    return got.select(F.col("label_id").cast("int").alias("label"), _r("mean").alias("mean_score"), _r("total").alias("sum_score"), _r("most").alias("max_score"))


def _top_clusters(spark, d, k):
    return V.top_k(_matched(spark, d), "m", "score", k, "cluster", 6)


_SQL_TOP = f"{_SQL_M}, tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, cluster) AS rank FROM mt) WHERE rank <= 2)"


@query(f"WITH {_SQL_TOP} SELECT m AS vec_id, cluster, round(score, 6) AS score, rank FROM tp")
def topk_clusters(spark, d):
    return _top_clusters(spark, d, 2).select(F.col("m").alias("vec_id"), "cluster", _r("score").alias("score"), "rank")


@query(f"WITH {_SQL_TOP} SELECT m AS vec_id, cluster, 1 AS value FROM tp")
def topb_mask(spark, d):
    return _top_clusters(spark, d, 2).select(F.col("m").alias("vec_id"), "cluster", F.lit(1).alias("value"))


_SQL_L4 = "l4 AS (SELECT DISTINCT label, CAST(label % 4 AS INTEGER) AS cluster FROM embeddings)"


def _four(spark, d):
    """Labels of the table in four clusters."""
    own = _t(spark, d, "embeddings").select(F.col("label").alias("label_id")).distinct()
    return own.withColumn("cluster", (F.col("label_id") % 4).cast("int"))


@query(f"WITH {_SQL_TOP}, {_SQL_L4} SELECT DISTINCT m AS vec_id, label FROM tp JOIN l4 USING (cluster)")
def candidate_labels(spark, d):
    got = routing.candidate_labels(_top_clusters(spark, d, 2).withColumnRenamed("m", "query_id"), _four(spark, d))
    return got.select(F.col("query_id").alias("vec_id"), F.col("label_id").alias("label"))


def _fused(spark, d, how):
    """Candidates of a mention with matcher and ranker scores; labels 8 and 9 have no ranker."""
    top = _top_clusters(spark, d, 2).select("m", "e", "cluster", F.col("score").alias("matcher")).join(F.broadcast(_four(spark, d)), "cluster")
    models = _z(_x(spark, d)).filter("l < 8").select(F.col("l").alias("label_id"), F.col("z").alias("w"))
    scored = routing.with_default(top, models, V.sigmoid(3 * V.dot(F.col("e"), F.col("w"))))
    return scored.withColumn("score", fusion.fuse(how, F.col("matcher"), F.col("ranker")))


_SQL_FUSED = f"{_SQL_TOP}, {_SQL_L4}, fu AS (SELECT tp.m, l4.label, tp.cluster, tp.score AS matcher, coalesce(1 / (1 + exp(-3 * list_dot_product(e, z.z))), 1.0) AS ranker FROM tp JOIN l4 USING (cluster) LEFT JOIN z ON z.l = l4.label AND z.l < 8), fc AS (SELECT m, label, cluster, ranker, greatest(least(matcher, 1), 1e-6) AS a, greatest(least(ranker, 1), 1e-6) AS b FROM fu)"


def _fusion_rows(df):
    return df.select(F.col("m").alias("vec_id"), F.col("label_id").alias("label"), _r("score").alias("score"))


@query(f"WITH {_SQL_FUSED} SELECT m AS vec_id, label, round(pow(0.5 * pow(a, 3) + 0.5 * pow(b, 3), 1.0 / 3), 6) AS score FROM fc")
def fusion_lp(spark, d):
    return _fusion_rows(_fused(spark, d, "lp_fusion"))


@query(f"WITH {_SQL_FUSED} SELECT m AS vec_id, label, round(pow(a, 0.5) * pow(b, 0.5), 6) AS score FROM fc")
def fusion_geometric(spark, d):
    return _fusion_rows(_fused(spark, d, "geometric"))


@query(f"WITH {_SQL_FUSED} SELECT m AS vec_id, label, round(ranker, 6) AS ranker FROM fc")
def missing_ranker_default(spark, d):
    return _fused(spark, d, "geometric").select(F.col("m").alias("vec_id"), F.col("label_id").alias("label"), _r("ranker").alias("ranker"))


# beam over regions and nations: probabilities from a query's number and the node's


@query("""WITH q AS (SELECT c_custkey AS q FROM customer), r AS (SELECT q, r_regionkey AS node, 1 / (1 + exp(-(((q * 7 + r_regionkey * 13) % 11) - 5.0) / 3)) AS p FROM q, region),
 b1 AS (SELECT q, node, ln(greatest(p, 1e-9)) AS s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(ln(greatest(p, 1e-9)), 9) DESC, node) AS k FROM r) WHERE k <= 2),
 n AS (SELECT q, n_nationkey AS node, s + ln(greatest(1 / (1 + exp(-(((q * 5 + n_nationkey * 3) % 13) - 6.0) / 3)), 1e-9)) AS s FROM b1 JOIN nation ON n_regionkey = node)
 SELECT q AS query_id, node AS nation, round(s, 6) AS logscore, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, node) AS k FROM n) WHERE k <= 3""")
def beam_two_layer(spark, d):
    asked = _t(spark, d, "customer").select(F.col("c_custkey").alias("q"))
    regions = _t(spark, d, "region").select(F.col("r_regionkey").alias("node"))
    edges = _t(spark, d, "nation").select(F.col("n_regionkey").alias("node"), F.col("n_nationkey").alias("child"))
    p1 = V.sigmoid(((F.col("q") * 7 + F.col("node") * 13) % 11 - 5.0) / 3)
    # five regions, as the tree's first layer
    first = asked.crossJoin(F.broadcast(regions)).withColumn("s", fusion.path_score(F.lit(0.0), p1))
    kept = V.top_k(first, "q", "s", 2, "node", 9).drop("rank")
    p2 = V.sigmoid(((F.col("q") * 5 + F.col("child") * 3) % 13 - 6.0) / 3)
    second = kept.join(edges, "node").withColumn("s", fusion.path_score(F.col("s"), p2))
    return V.top_k(second, "q", "s", 3, "child", 9).select(F.col("q").alias("query_id"), F.col("child").alias("nation"), _r("s").alias("logscore"), "rank")


_SQL_LEAVES = f"{_SQL_SCORES}, lv AS (SELECT m, label, score * (1 + leaf * 0.1 * (1 - 2 * ((m + label) % 2))) AS score FROM sc, (SELECT unnest([0, 1]) AS leaf)), mm AS (SELECT m, label, max(score) AS score FROM lv GROUP BY ALL HAVING max(score) > 0)"


def _merged(spark, d):
    leaves = _scores(spark, d).select(F.col("m").alias("query_id"), F.col("label").alias("label_id"), "score", F.explode(F.array(F.lit(0), F.lit(1))).alias("leaf"))
    leaves = leaves.withColumn("score", F.col("score") * (1 + F.col("leaf") * 0.1 * (1 - 2 * ((F.col("query_id") + F.col("label_id")) % 2))))
    return routing.max_merge(leaves)


@query(f"WITH {_SQL_LEAVES} SELECT m AS query_id, label AS label_id, round(score, 6) AS score FROM mm")
def max_merge_leaves(spark, d):
    return _merged(spark, d).withColumn("score", _r("score"))


@query(f"WITH {_SQL_LEAVES} SELECT m AS query_id, label AS label_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, label) AS rank FROM mm) WHERE rank <= 4")
def global_topk(spark, d):
    return V.top_k(_merged(spark, d), "query_id", "score", 4, "label_id", 6).withColumn("score", _r("score"))


# negatives


def _pool(spark, d):
    """Negatives of each label among all mentions, with cosine, inner product and a portable random key."""
    scored = _scores(spark, d).withColumn("cos", _r(F.col("score") / (V.norm(F.col("e")) + 1e-12), 9)).withColumn("ip", _r("score", 9))
    counts = _x(spark, d).groupBy(F.col("l").alias("label")).agg(F.count("*").alias("n_pos"))
    total = counts.agg(F.sum("n_pos")).first()[0]
    counts = routing.trainable(counts.withColumn("available", F.lit(total) - F.col("n_pos")), "n_pos", "available", 2)
    mixed = (F.col("m") * 7919 + F.col("label") * 104729 + 12345) % 1000003
    return scored.filter("l <> label").join(F.broadcast(counts), "label").select("label", "m", "n_neg", "cos", "ip", mixed.alias("draw"))


_SQL_POOL = f"""{_SQL_SCORES}, cn AS (SELECT l AS label, count(*) AS n_pos, least(count(*) * 2, (SELECT count(*) FROM x) - count(*)) AS n_neg FROM x GROUP BY l), ok AS (SELECT * FROM cn WHERE n_pos >= 2 AND n_neg >= 2),
 pl AS (SELECT label, m, n_neg, round(score / (sqrt(list_dot_product(e, e)) + 1e-12), 9) AS c, round(score, 9) AS ip, (m * 7919 + label * 104729 + 12345) % 1000003 AS draw FROM sc JOIN ok USING (label) WHERE l <> label)"""


def _draw(epoch, labels_, mentions):
    """Portable random keys."""
    return (mentions[:, None] * 7919 + labels_[None] * 104729 + 12345 * epoch) % 1000003


def _chosen(spark, d, epochs):
    """Negatives of each label among all mentions, by bounded heaps."""
    x = _x(spark, d)
    counts = x.groupBy(F.col("l").alias("label")).agg(F.count("*").alias("n_pos")).withColumn("available", F.lit(x.count()) - F.col("n_pos"))
    counts = routing.trainable(counts, "n_pos", "available", 2)
    place = [F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("cluster")]
    own = _z(x).join(counts.withColumnRenamed("label", "l"), "l").select(*place, F.col("l").alias("label_id"), "z", "n_neg")
    rows = x.select(*place, F.col("m").alias("mention_id"), F.col("e").alias("vec"), F.array("l").alias("own"))
    found = negatives.choose(own, rows, epochs, _draw)
    return found.select(F.col("label_id").cast("int").alias("label"), F.col("mention_id").alias("vec_id"), "epoch")


@query(f"""WITH {_SQL_POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, m) AS r1, row_number() OVER (PARTITION BY label ORDER BY c DESC, m) AS r2, round_even(0.7 * n_neg, 0) AS q1 FROM pl),
 p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) AS n FROM k WHERE r1 <= q1 OR r2 <= n_neg - q1) SELECT label, m AS vec_id FROM p WHERE n <= n_neg""")
def negatives_warm(spark, d):
    """Warm epochs: seven tenths at random, the rest of greatest cosine."""
    return _chosen(spark, d, [[(0.7, "draw"), (0.3, "cos")]]).select("label", "vec_id")


@query(f"""WITH {_SQL_POOL}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ip DESC, m) AS r1, row_number() OVER (PARTITION BY label ORDER BY c DESC, m) AS r2, round_even(0.6 * n_neg, 0) AS q1, round_even(0.3 * n_neg, 0) AS q2 FROM pl),
 t AS (SELECT *, r1 <= q1 OR r2 <= q2 AS taken FROM k), u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY taken, draw, m) AS r3 FROM t),
 p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m) AS n FROM u WHERE taken OR r3 <= n_neg - q1 - q2) SELECT label, m AS vec_id FROM p WHERE n <= n_neg""")
def negatives_hard(spark, d):
    """Hard epochs: by inner product, by cosine, and the rest at random among those not taken."""
    phases = [(0.6, [("ip", True), ("m", False)]), (0.3, [("cos", True), ("m", False)]), (None, [("draw", False), ("m", False)])]
    return routing.pick_negatives(_pool(spark, d), phases, "label", "m").withColumnRenamed("m", "vec_id")


_SQL_EPOCHS = f"""{_SQL_POOL}, ep AS (SELECT pl.*, epoch, (m * 7919 + label * 104729 + 12345 * epoch) % 1000003 AS d, round_even(0.7 * n_neg, 0) AS w1, round_even(0.3 * n_neg, 0) AS w2, round_even(0.6 * n_neg, 0) AS h1, round_even(0.3 * n_neg, 0) AS h2 FROM pl, (SELECT unnest([1, 2, 3]) AS epoch)),
 er AS (SELECT *, row_number() OVER (w ORDER BY d, m) AS rd, row_number() OVER (w ORDER BY c DESC, m) AS rc, row_number() OVER (w ORDER BY ip DESC, m) AS ri FROM ep WINDOW w AS (PARTITION BY epoch, label)),
 et AS (SELECT *, CASE WHEN epoch <= 2 THEN rd <= w1 OR rc <= w2 ELSE ri <= h1 OR rc <= h2 END AS taken FROM er),
 eu AS (SELECT *, row_number() OVER (PARTITION BY epoch, label ORDER BY taken, d, m) AS rr FROM et),
 ev AS (SELECT *, row_number() OVER (PARTITION BY epoch, label ORDER BY m) AS n FROM eu WHERE taken OR epoch > 2 AND rr <= n_neg - h1 - h2)"""


@query(f"WITH {_SQL_EPOCHS} SELECT label, m AS vec_id, CAST(epoch AS INTEGER) AS epoch FROM ev WHERE n <= n_neg")
def negatives_epochs(spark, d):
    """Two warm epochs and a hard one, from one pass of the mentions by the labels."""
    return _chosen(spark, d, model.epoch_phases({"E_warm": 2}, 3))


@query("WITH c AS (SELECT label, count(*) AS positives FROM embeddings GROUP BY label) SELECT label, positives, (SELECT count(*) FROM embeddings) - positives AS available, least(positives * 15, (SELECT count(*) FROM embeddings) - positives) AS n_neg FROM c WHERE positives >= 2 AND least(positives * 15, (SELECT count(*) FROM embeddings) - positives) >= 2")
def trainable_labels(spark, d):
    x = _t(spark, d, "embeddings")
    counts = x.groupBy("label").agg(F.count("*").alias("positives")).withColumn("available", F.lit(x.count()) - F.col("positives"))
    return routing.trainable(counts, "positives", "available")


@query(f"WITH {_SQL_TOP}, {_SQL_L4} SELECT m AS vec_id, cluster FROM tp UNION SELECT vec_id, cluster FROM embeddings JOIN l4 USING (label)")
def mask_union(spark, d):
    y = _t(spark, d, "embeddings").select(F.col("vec_id").alias("m"), F.col("label").alias("label_id"))
    got = routing.mask_union(_top_clusters(spark, d, 2).select("m", "cluster"), labels.mention_clusters(y, _four(spark, d), "m"))
    return got.withColumnRenamed("m", "vec_id")


# evaluation: the gold codes of a vector are its own label and the next one, the first after the last


def _gold(spark, d):
    x = _t(spark, d, "embeddings")
    following = (F.col("label") + 1) % (x.agg(F.max("label")).first()[0] + 1)
    return x.select(F.col("vec_id").alias("query_id"), F.array(F.col("label").cast("string"), following.cast("string")).alias("codes"))


@query("SELECT vec_id AS query_id, CAST(label AS VARCHAR) || '|' || CAST((label + 1) % (SELECT max(label) + 1 FROM embeddings) AS VARCHAR) AS codes FROM embeddings WHERE label < (SELECT max(label) FROM embeddings) - 3")
def gold_filter(spark, d):
    own = _t(spark, d, "embeddings").select("label").distinct()
    known = own.filter(F.col("label") < own.agg(F.max("label")).first()[0] - 3).select(F.col("label").cast("string").alias("label"))
    return routing.known_gold(_gold(spark, d), known).select("query_id", F.array_join("codes", "|").alias("codes"))


def _hits(spark, d):
    found = blocks.top_products(*_both(spark, d), "m", "label", 3, 6)
    top = found.select(F.col("m").alias("query_id"), F.col("label").cast("string").alias("label"))
    return routing.hit_counts(top, _gold(spark, d))


_SQL_HITS = f"{_SQL_SCORES}, t3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 6) DESC, label) AS k FROM sc) WHERE k <= 3), hits AS (SELECT m AS query_id, CAST(count(*) FILTER (WHERE label = l OR label = (l + 1) % (SELECT max(label) + 1 FROM embeddings)) AS INTEGER) AS hits FROM t3 GROUP BY m)"


@query(f"WITH {_SQL_HITS} SELECT query_id, hits FROM hits")
def hit_counts(spark, d):
    return _hits(spark, d)


@query(f"WITH {_SQL_HITS} SELECT hits, count(*) AS queries FROM hits GROUP BY hits")
def hit_histogram(spark, d):
    return routing.hit_histogram(_hits(spark, d))


@query(f"WITH {_SQL_HITS} SELECT count(*) AS queries, round(avg(hits), 6) AS mean_hits FROM hits")
def hit_mean(spark, d):
    return _hits(spark, d).agg(F.count("*").alias("queries"), _r(F.avg("hits")).alias("mean_hits"))


# a tree of two layers with given coefficients: searched by the same code as a trained one


_DEPTH, _BEAM, _TOP = 2, 1, 4


def _tree(spark, d):
    """Root clusters are labels modulo 2; those of its children labels // 2 modulo 2. Matchers and rankers come from label embeddings; the
    two greatest labels have no ranker."""
    z = _z(_x(spark, d)).select(F.col("l").cast("long").alias("label_id"), "z")
    z = files.checkpointed(z)
    more = lambda *c: F.array(*(F.lit(float(v)) if isinstance(v, (int, float)) else v for v in c))
    wide = z.select((F.col("label_id") % 2 + 1).alias("node"), "label_id", F.concat("z", more(F.col("label_id") * 0.1, 0.2, 0.3)).alias("z"))
    root = z.select(F.lit(0).cast("long").alias("node"), "label_id", (F.col("label_id") % 2).cast("int").alias("cluster"))
    below = wide.select("node", "label_id", (F.floor(F.col("label_id") / 2) % 2).cast("int").alias("cluster"))
    of = root.unionByName(below)
    parts_ = of.join(z, "label_id").select("node", "cluster", F.posexplode("z").alias("k", "v")).groupBy("node", "cluster", "k").agg(F.avg("v").alias("v"))
    means = parts_.groupBy("node", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("z"))
    coef = F.when(F.col("node") == 0, F.transform("z", lambda v: v * 4)).otherwise(F.concat(F.transform("z", lambda v: v * 3), more(0.5, -0.25, 0.125)))
    none = F.lit(None).cast("string").alias("model")
    matchers = means.select("node", "cluster", coef.alias("coef"), F.when(F.col("node") == 0, F.col("cluster") * 0.1).otherwise(F.lit(0.0)).alias("intercept"), none)
    most = z.agg(F.max("label_id")).first()[0]
    rankers = wide.filter(F.col("label_id") < most - 1).select("node", "label_id", F.concat(F.transform("z", lambda v: v * 2), F.transform("z", lambda v: v * 0.5)).alias("coef"), F.lit(-0.2).alias("intercept"), none)
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "node long, cluster int, child long")
    names = z.select("label_id", F.concat(F.lit("L"), F.col("label_id").cast("string")).alias("label"))
    node_labels = z.select(F.lit(0).cast("long").alias("node"), "label_id", "z").unionByName(wide)
    return model.XModel.from_tables(_DEPTH, dictionary=names, embeddings=z, clusters=of, matchers=matchers, rankers=rankers, edges=edges, node_labels=node_labels)


def _asked(spark, d):
    return _x(spark, d).select(F.col("m").alias("query_id"), F.col("e").alias("vec"))


def _means(of: str) -> str:
    return f"SELECT {of} AS cluster, i, avg(v) AS v FROM (SELECT l, unnest(range(1, 65)) AS i, unnest(z) AS v FROM z)"


_SQL_ROOT = f"""{_SQL_Z}, m0 AS (SELECT cluster, list(v ORDER BY i) AS c FROM ({_means("l % 2")} GROUP BY 1, 2) GROUP BY 1),
 p0 AS (SELECT m, cluster, e, 1 / (1 + exp(-(4 * list_dot_product(e, c) + 0.1 * cluster))) AS p FROM x CROSS JOIN m0)"""
_SQL_TREE = f"""{_SQL_ROOT}, s0 AS (SELECT *, sum(p) OVER (PARTITION BY m) AS total, max(p) OVER (PARTITION BY m) AS most, row_number() OVER (PARTITION BY m ORDER BY round(p, 9) DESC, cluster) AS k FROM p0),
 b0 AS (SELECT m, cluster + 1 AS node, list_concat(e, [p, total, most]) AS raw FROM s0 WHERE k <= {_BEAM}),
 v1 AS (SELECT m, node, list_transform(raw, lambda t: t / sqrt(list_dot_product(raw, raw))) AS vec FROM b0),
 m1 AS (SELECT node, cluster, list_concat(list_transform(list(v ORDER BY i), lambda t: t * 3), [0.5, -0.25, 0.125]) AS c FROM (SELECT l % 2 + 1 AS node, CAST(floor(l / 2) AS INTEGER) % 2 AS cluster, i, avg(v) AS v FROM (SELECT l, unnest(range(1, 65)) AS i, unnest(z) AS v FROM z) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 p1 AS (SELECT m, v1.node, cluster, vec, 1 / (1 + exp(-list_dot_product(vec, c))) AS p FROM v1 JOIN m1 USING (node)),
 zw AS (SELECT l, l % 2 + 1 AS node, CAST(floor(l / 2) AS INTEGER) % 2 AS cluster, list_concat(z, [CAST(l * 0.1 AS DOUBLE), 0.2, 0.3]) AS z FROM z),
 re AS (SELECT m, p1.node, l, p, CASE WHEN l < (SELECT max(l) FROM z) - 1 THEN 1 / (1 + exp(-(2 * list_dot_product(vec, zw.z) + 0.5 * list_dot_product(zw.z, zw.z) - 0.2))) ELSE 1.0 END AS r FROM p1 JOIN zw USING (node, cluster)),
 fu AS (SELECT m, l, node, pow(greatest(least(p, 1), 1e-6), 0.5) * pow(greatest(least(r, 1), 1e-6), 0.5) AS score FROM re)"""


@query(f"WITH {_SQL_ROOT} SELECT m AS query_id, cluster, round(p, 6) AS score FROM p0")
def matcher_scores(spark, d):
    tree = _tree(spark, d)
    x = _asked(spark, d).withColumn("node", F.lit(0).cast("long"))
    return parts.Matcher(tree.matchers).predict_proba(x).select("query_id", "cluster", _r("score").alias("score"))


@query(f"WITH {_SQL_TREE} SELECT m AS query_id, l AS label_id, CAST(node AS BIGINT) AS leaf, round(score, 6) AS score FROM fu")
def tree_search(spark, d):
    found = _tree(spark, d).search(_asked(spark, d), beam_size=_BEAM)
    return found.select("query_id", "label_id", "leaf", _r("score").alias("score"))


def _root_layer(spark, d):
    """Vectors and labels of the root's two children."""
    tree, x = _tree(spark, d), _x(spark, d)
    root = F.col("node") == 0
    rows = x.select(F.lit(0).cast("long").alias("node"), F.col("m").alias("mention_id"), F.col("e").alias("vec"))
    scores = files.checkpointed(model.cluster_scores(rows, tree.matchers.filter(root), None, "mention_id"))
    y = x.select(F.col("m").alias("mention_id"), F.col("l").cast("long").alias("label_id"))
    return tree._children(y, tree.node_labels.filter(root), tree.clusters.filter(root), scores, tree.edges.filter(root))


def _cells(rows, key, vec):
    return rows.select("node", key, F.posexplode(vec).alias("feature", "value")).select("node", key, F.col("feature").cast("long").alias("feature"), _r("value").alias("value"))


_SQL_CHILD = f"""{_SQL_ROOT}, cx AS (SELECT m, x.l % 2 + 1 AS node, e, z.z AS z, z.l AS label FROM x JOIN z ON z.l % 2 = x.l % 2),
 cz AS (SELECT node, label, list_concat(any_value(z), [avg(list_dot_product(e, z)), sum(list_dot_product(e, z)), max(list_dot_product(e, z))]) AS w FROM cx GROUP BY node, label),
 cm AS (SELECT x.m, x.l % 2 + 1 AS node, list_concat(x.e, [max(p) FILTER (WHERE cluster = x.l % 2), sum(p), max(p)]) AS w FROM x JOIN p0 ON p0.m = x.m GROUP BY x.m, x.l, x.e)"""


@query(f"WITH {_SQL_CHILD} SELECT CAST(node AS BIGINT) AS node, CAST(label AS BIGINT) AS label_id, i - 1 AS feature, round(v / n, 6) AS value FROM (SELECT node, label, unnest(range(1, 68)) AS i, unnest(w) AS v, sqrt(list_dot_product(w, w)) AS n FROM cz)")
def children_labels(spark, d):
    """Labels of the next layer: mean, sum and greatest affinity to their node's mentions."""
    return _cells(_root_layer(spark, d)[1], "label_id", "z")


@query(f"WITH {_SQL_CHILD} SELECT CAST(node AS BIGINT) AS node, m AS mention_id, i - 1 AS feature, round(v / n, 6) AS value FROM (SELECT node, m, unnest(range(1, 68)) AS i, unnest(w) AS v, sqrt(list_dot_product(w, w)) AS n FROM cm)")
def children_mentions(spark, d):
    """Mentions of the next layer: their own cluster's score, the sum and the greatest."""
    return _cells(_root_layer(spark, d)[0], "mention_id", "vec")


_SQL_PER_LEAF = f"""{_SQL_TREE}, lf AS (SELECT *, row_number() OVER (PARTITION BY m, node ORDER BY round(score, 9) DESC, l) AS k FROM fu), mx AS (SELECT m, l, max(score) AS score FROM lf WHERE k <= {_TOP} GROUP BY m, l HAVING max(score) > 0)
 SELECT m AS query_id, rank, l AS label_id, 'L' || l AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 9) DESC, l) AS rank FROM mx) WHERE rank <= {_TOP}"""


def _best(rows):
    return rows.select("query_id", "rank", F.col("label_id").cast("int").alias("label_id"), "label", _r("score").alias("score"))


@query(f"WITH {_SQL_PER_LEAF}")
def tree_predict(spark, d):
    return _best(_tree(spark, d).predict_vectors(_asked(spark, d), topk=_TOP, beam_size=_BEAM))


@query(f"WITH {_SQL_PER_LEAF}")
def tree_saved(spark, d):
    """The same of a model that was saved and loaded."""
    folder = files.scratch(spark, "tree")
    _tree(spark, d).save(folder)
    return _best(model.XModel.load(spark, folder).predict_vectors(_asked(spark, d), topk=_TOP, beam_size=_BEAM))


@query(f"""WITH {_SQL_TREE}, un AS (SELECT DISTINCT m, l FROM fu), co AS (SELECT m, l, list_dot_product(e, z.z) / ((sqrt(list_dot_product(e, e)) + 1e-12) * (sqrt(list_dot_product(z.z, z.z)) + 1e-12)) AS score FROM un JOIN (SELECT m, e FROM x) USING (m) JOIN z USING (l))
 SELECT m AS query_id, rank, l AS label_id, 'L' || l AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(score, 9) DESC, l) AS rank FROM co) WHERE rank <= {_TOP}""")
def tree_global(spark, d):
    """Labels that the beam reaches, ranked by cosine."""
    return _best(_tree(spark, d).predict_vectors(_asked(spark, d), topk=_TOP, beam_size=_BEAM, topk_mode="global"))


_SQL_NODE = f"""{_SQL_ROOT}, t0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY round(p, 9) DESC, cluster) AS k FROM p0) WHERE k <= 1), n0 AS (SELECT m, z.l, round(pow((0.5 * pow(greatest(least(p, 1), 1e-6), 3) + 0.5), 1.0 / 3), 6) AS score FROM t0 JOIN z ON z.l % 2 = cluster),
 r0 AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, l) AS rank FROM n0)"""


@query(f"WITH {_SQL_NODE} SELECT m AS query_id, rank, CAST(l AS BIGINT) AS label_id, score FROM r0 WHERE rank <= 3")
def node_predict(spark, d):
    """The root alone, whose labels have no rankers."""
    return _tree(spark, d).predict_node(0, _asked(spark, d), beam_size=1, topk=3).withColumn("score", _r("score"))


@query(f"WITH {_SQL_NODE} SELECT m AS query_id, string_agg(CAST(l AS VARCHAR), '|' ORDER BY l) AS labels, round(sum(score), 4) AS total FROM r0 WHERE rank <= 3 GROUP BY m")
def node_predict_matrix(spark, d):
    rows = _tree(spark, d).predict_node(0, _asked(spark, d), beam_size=1, topk=3, as_matrix=True)
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return rows.select("query_id", F.array_join(F.transform("labels", lambda x: x.cast("string")), "|").alias("labels"), F.round(total, 4).alias("total"))


@query(f"""WITH {_SQL_TREE}, fv AS (SELECT m, list_concat(e, [0.5, 1.0, 0.6]) AS vec FROM x), fr AS (SELECT z FROM zw WHERE node = 1 AND l < (SELECT max(l) FROM z) - 1 ORDER BY l LIMIT 1),
 fp AS (SELECT m, cluster, vec, 1 / (1 + exp(-list_dot_product(vec, c))) AS p FROM fv, m1 WHERE node = 1),
 ff AS (SELECT m, fp.cluster, p, 1 / (1 + exp(-(2 * list_dot_product(vec, fr.z) + 0.5 * list_dot_product(zw.z, fr.z) - 0.2))) AS r FROM fp JOIN zw ON zw.node = 1 AND zw.cluster = fp.cluster, fr)
 SELECT m AS query_id, cluster, round(sum(pow(0.5 * pow(p, 3) + 0.5 * pow(greatest(least(r, 1), 1e-6), 3), 1.0 / 3)), 6) AS score FROM ff GROUP BY ALL""")
def fused_clusters(spark, d):
    """Scores of clusters by one ranker for all labels of a node."""
    wide = _asked(spark, d).withColumn("vec", F.concat("vec", F.array(F.lit(0.5), F.lit(1.0), F.lit(0.6))))
    return _tree(spark, d).fused_clusters(1, wide).withColumn("score", _r("score"))


@query(f"WITH {_SQL_ROOT} SELECT m AS query_id, cluster, round(p * (SELECT count(*) FROM z WHERE l % 2 = cluster), 6) AS score FROM p0")
def fused_without_rankers(spark, d):
    """The same of the root, whose labels have no rankers."""
    return _tree(spark, d).fused_clusters(0, _asked(spark, d)).withColumn("score", _r("score"))


def _kept_part(spark, kind, part):
    folder = files.scratch(spark, "part")
    part.save(folder)
    return kind.load(spark, folder)


@query(f"WITH {_SQL_ROOT} SELECT m AS query_id, cluster, round(p, 6) AS score FROM p0")
def matcher_saved(spark, d):
    matcher = _kept_part(spark, parts.Matcher, parts.Matcher(_tree(spark, d).matchers))
    return matcher.predict_proba(_asked(spark, d).withColumn("node", F.lit(0).cast("long"))).select("query_id", "cluster", _r("score").alias("score"))


@query(f"WITH {_SQL_TREE} SELECT m AS query_id, l AS label_id, round(r, 6) AS score FROM re")
def ranker_saved(spark, d):
    """Rankers of the labels that the beam reaches, on the vectors of their node."""
    tree = _tree(spark, d)
    ranker = _kept_part(spark, parts.Ranker, parts.Ranker(tree.rankers))
    first = parts.Matcher(tree.matchers).predict_proba(_asked(spark, d).withColumn("node", F.lit(0).cast("long")))
    by = Window.partitionBy("query_id")
    scored = first.withColumn("sum", F.sum("score").over(by)).withColumn("max", F.max("score").over(by))
    on = V.top_k(scored, "query_id", "score", _BEAM, "cluster", 9).join(tree.edges, ["node", "cluster"])
    vec = V.unit(F.concat("vec", F.array("score", "sum", "max")))
    pairs = on.select("query_id", F.col("child").alias("node"), vec.alias("vec")).join(tree.clusters.filter("node > 0").select("node", "label_id"), "node")
    return ranker.predict_proba(pairs, tree.node_labels).select("query_id", "label_id", _r("score").alias("score"))


@query(f"WITH {_SQL_Z}, q AS (SELECT l % 2 AS cluster, i, avg(v) AS v FROM (SELECT l, unnest(range(1, 65)) AS i, unnest(z) AS v FROM z) GROUP BY ALL) SELECT cluster, i - 1 AS feature, round(v, 6) AS value FROM q")
def clustering_saved(spark, d):
    tree = _tree(spark, d)
    held = _kept_part(spark, parts.Clustering, parts.Clustering(tree.clusters.filter("node = 0")))
    found = held.centroids(tree.node_labels)
    return found.select("cluster", F.posexplode("centroid").alias("feature", "value")).select("cluster", F.col("feature").cast("long").alias("feature"), _r("value").alias("value"))


# readers: the tables are written as the files that they read


def _written(spark, rows, column="value"):
    folder = files.scratch(spark, "file")
    rows.select(F.col(column).alias("value")).write.text(folder)
    return folder


def _part_lines(spark, d):
    part = _t(spark, d, "part").orderBy("p_partkey")
    return _written(spark, part.select(F.concat_ws("\t", F.col("p_size").cast("string"), "p_name").alias("value")))


@query("SELECT p_size AS group_id, string_agg(p_name, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_size")
def read_grouped(spark, d):
    return files.read_grouped(spark, _part_lines(spark, d)).withColumn("group_id", F.col("group_id").cast("int"))


@query("SELECT p_size AS group_id, string_agg(CASE WHEN p_partkey % 3 = 0 THEN 'nan' ELSE p_name END, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_size")
def read_grouped_missing(spark, d):
    """Lines of which some have no text, which is read as a word."""
    part = _t(spark, d, "part").orderBy("p_partkey")
    lines = part.select(F.concat_ws("\t", F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name"))).alias("value"))
    return files.read_grouped(spark, _written(spark, lines), missing="nan").withColumn("group_id", F.col("group_id").cast("int"))


@query("SELECT p_brand AS group_id, string_agg(CASE WHEN p_partkey % 3 = 0 THEN p_name || '\t\"' || p_type || '\"' ELSE p_name END, ' ' ORDER BY p_partkey) AS text FROM part GROUP BY p_brand")
def read_grouped_names(spark, d):
    """Ids that are texts, in a folder of files of different sizes, and fields with tabs and quotes."""
    part = _t(spark, d, "part").orderBy("p_partkey")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('\t""'), "p_type", F.lit('"""'))).otherwise(F.col("p_name"))
    return files.read_grouped(spark, _written(spark, part.select(F.concat_ws("\t", "p_brand", name).alias("value"))))


@query("SELECT n_nationkey, n_name, 0.5 * n_regionkey + 1 AS weight, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def kept_variables(spark, d):
    """A table, an array, a list and a dictionary that were kept and loaded."""
    store = variables.KeptVariables(spark)
    regions = {str(r["r_regionkey"]): r["r_name"] for r in _t(spark, d, "region").collect()}  # five rows by the tables' definition
    keys = sorted(map(int, regions))
    held = [store.save(v) for v in (_t(spark, d, "nation"), np.array(keys) * 0.5 + 1, keys, regions)]
    nation, weights, keys, regions = (store.load(path) for path in held)
    names = spark.createDataFrame([(k, float(w), regions[str(k)]) for k, w in zip(keys, weights, strict=True)], "n_regionkey long, weight double, region string")
    return nation.join(F.broadcast(names), "n_regionkey").select("n_nationkey", "n_name", "weight", "region")


@query("WITH b AS (SELECT row_number() OVER (ORDER BY b) - 1 AS label_pos, b AS label FROM (SELECT DISTINCT p_type AS b FROM part)) SELECT label_pos, label FROM b")
def read_labels(spark, d):
    names = _t(spark, d, "part").select(F.col("p_type").alias("value")).distinct().orderBy("value")
    return files.read_labels(spark, _written(spark, names.select(F.concat(F.lit(" \t"), F.col("value"), F.lit(" \t ")).alias("value"))))


@query(f"WITH {_POSITION} SELECT label_pos, label, corpus FROM gp JOIN b USING (label_pos)")
def read_labelled(spark, d):
    names = _written(spark, _t(spark, d, "part").select(F.col("p_name").alias("value")).distinct().orderBy("value"))
    rows = files.read_labelled(spark, _part_lines(spark, d), names)
    return rows.select("label_pos", "label", F.array_join("corpus", "|").alias("corpus"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS query_id, CAST(label AS VARCHAR) || ';' || CAST(label + 1 AS VARCHAR) AS codes FROM embeddings")
def read_gold(spark, d):
    x = _t(spark, d, "embeddings").orderBy("vec_id")
    lines = x.select(F.concat_ws("|", F.col("label").cast("string"), (F.col("label") + 1).cast("string")).alias("value"))
    return files.read_gold(spark, _written(spark, lines)).select("query_id", F.array_join("codes", ";").alias("codes"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS query_id, p_name AS text FROM part")
def read_queries(spark, d):
    return files.read_queries(spark, _written(spark, _t(spark, d, "part").orderBy("p_partkey"), "p_name"))


@query("SELECT p_brand AS code FROM part WHERE p_size % 5 > 0")
def extract_codes(spark, d):
    folder = files.scratch(spark, "codes")
    code = F.when(F.col("p_size") % 5 > 0, F.col("p_brand"))
    _t(spark, d, "part").select("p_partkey", code.alias("code")).write.csv(f"{folder}/in", sep="\t", header=True)
    files.extract_codes(spark, f"{folder}/in", f"{folder}/out")
    return spark.read.text(f"{folder}/out").withColumnRenamed("value", "code")


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def debug_tables(spark, d):
    folder = files.scratch(spark, "debug")
    files.write_debug_tables({"supplier": _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")}, folder)
    return spark.read.csv(f"{folder}/supplier", header=True, schema="s_suppkey bigint, s_name string, s_acctbal double").withColumn("s_acctbal", F.round("s_acctbal", 2))


# pieces of the node's work


@query(f"WITH {_SQL_Z} SELECT DISTINCT vec_id, l AS label FROM embeddings JOIN z ON z.l = label WHERE l % 2 = 1")
def node_slice(spark, d):
    """Rows of a node: its labels' columns, the mentions that have one of them, and their vectors."""
    y = _t(spark, d, "embeddings").select(F.col("vec_id").alias("mention_id"), F.col("label").alias("label_id"))
    x = _x(spark, d).select(F.col("m").alias("mention_id"), F.col("e").alias("vec"))
    own = _four(spark, d).filter("label_id % 2 = 1")
    held = labels.node_pairs(y, own).select("mention_id", "label_id")
    return held.join(x, "mention_id").select(F.col("mention_id").alias("vec_id"), F.col("label_id").alias("label"))


@query(f"WITH {_SQL_X}, w AS (SELECT m, list_concat(list_transform(e, lambda t: t * 0.5), [1.0, CAST(l AS DOUBLE)]) AS w FROM x) SELECT m AS vec_id, i - 1 AS feature, round(v, 6) AS value FROM (SELECT m, unnest(range(1, 67)) AS i, unnest(w) AS v FROM w) WHERE v <> 0")
def stacked_features(spark, d):
    """Features of two tables side by side."""
    x = _x(spark, d)
    left = V.to_long(x.withColumn("e", F.transform("e", lambda v: v * 0.5)), "e", "m")
    right = V.to_long(x.withColumn("e", F.array(F.lit(1.0), F.col("l").cast("double"))), "e", "m")
    return V.stack(left, right, widths=[WIDTH, 2]).select(F.col("m").alias("vec_id"), F.col("feature").cast("long").alias("feature"), _r("value").alias("value"))


@query(f"WITH {_SQL_X} SELECT m AS vec_id, string_agg(CAST(round(v, 4) AS VARCHAR), ' ' ORDER BY i) AS cells FROM (SELECT m, i, CASE WHEN i <= 64 THEN round(e[i], 1) + 0.0 ELSE 0.0 END AS v FROM x, (SELECT unnest(range(1, 71)) AS i)) GROUP BY m")
def matched_width(spark, d):
    """Vectors of another width: what is missing is zero."""
    long = V.to_long(_x(spark, d), "e", "m")
    wide = V.to_dense(long, 70, "m")
    return wide.select(F.col("m").alias("vec_id"), F.array_join(F.transform("vector", lambda v: F.when(F.round(v, 1) == 0, F.lit(0.0)).otherwise(F.round(v, 1)).cast("string")), " ").alias("cells"))


_SQL_OPT = """tok AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]{2,}'), lambda t: t <> 'red') AS w FROM part),
 tf AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(w) AS term FROM tok) GROUP BY ALL), n AS (SELECT count(*) AS n FROM part),
 df AS (SELECT term, ln(any_value(n) / count(*)) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) >= 0.001 * any_value(n) AND count(*) <= 0.9 * any_value(n)),
 raw AS (SELECT p_partkey, term, (1 + ln(tf)) * idf AS v FROM tf JOIN df USING (term))"""


@query(f"WITH {_SQL_OPT} SELECT p_partkey, term, round(v / sum(v) OVER (PARTITION BY p_partkey), 6) AS value FROM raw")
def tfidf_options(spark, d):
    """Stop words, bounds below and above, plain idf, sublinear counts, sums of 1."""
    part = _t(spark, d, "part")
    tf = text.terms(part, "p_partkey", "p_name", 1, 1, stop=["red"])
    known = text.document_frequencies(tf, part.count(), 0.9, min_df=0.001, smooth=False)
    return text.weights(tf, known, "p_partkey", sublinear=True, norm="l1").select("p_partkey", "term", _r("value").alias("value"))


@query(f"WITH {_SQL_X}, xl AS (SELECT m, unnest(range(1, 65)) AS i, unnest(e) AS v FROM x), g AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS v FROM xl a JOIN xl b USING (m) GROUP BY a.i, b.i) SELECT round(sum(CASE WHEN i = j THEN v ELSE 0 END), 4) AS squares, round(sum(v * v), 2) AS fourths FROM g")
def svd_moments(spark, d):
    """Sums of the second and fourth powers of all singular values, which the products of the columns give too."""
    rows = _x(spark, d).select(F.sequence(F.lit(0), F.lit(WIDTH - 1)).alias("features"), F.col("e").alias("values"))
    _, s = encoders.singular_vectors(rows, WIDTH, WIDTH)
    return spark.createDataFrame([(round(float((s**2).sum()), 4), round(float((s**4).sum()), 2))], "squares double, fourths double")


# fitted models: checked by tests, as SQL can't express them


@query()
def svd_reduce(spark, d):
    """Singular values of the embeddings."""
    rows = _x(spark, d).select(F.sequence(F.lit(0), F.lit(WIDTH - 1)).alias("features"), F.col("e").alias("values"))
    _, values = encoders.singular_vectors(rows, WIDTH, 16)
    return spark.createDataFrame([(k, float(round(v, 6))) for k, v in enumerate(values)], "component int, value double")


@query()
def kmeans_ml(spark, d):
    """Cosine k-means in rounds over all vectors, as of a node of any size."""
    rows = _x(spark, d).select(F.lit(0).cast("long").alias("node"), F.col("m").alias("label_id"), F.col("e").alias("z"))
    centres, prices, _ = large_clusters.centres_of(rows, 8, "k-means++", True, 50, 1e-4, 1)
    return large_clusters.assigned(rows, centres, prices, True).select(F.col("label_id").alias("vec_id"), "cluster")


@query()
def balanced_kmeans(spark, d):
    nodes = _x(spark, d).select((F.col("l") % 2).cast("long").alias("node"), F.col("m").alias("label_id"), F.col("e").alias("z"))
    return clusters.cluster_nodes(nodes, {"type": "balancedkmeans", "kwargs": {"n_clusters": 4}}, 10)


def _matcher(spark, d):
    x = _x(spark, d).select(F.lit(0).cast("long").alias("node"), F.col("m").alias("mention_id"), F.col("e").alias("vec"))
    y = _x(spark, d).select("m", F.col("l").alias("label_id")).join(_four(spark, d), "label_id")
    targets = y.groupBy(F.lit(0).cast("long").alias("node"), F.col("m").alias("mention_id")).agg(F.collect_set("cluster").alias("clusters"))
    # kept, as a join that deals one node's rows to many tasks would fit its matchers in each of them
    return x, files.checkpointed(model.fit_matchers(x, targets, {"type": "sklearnlogisticregression"}))


_CURVES = 5
_SQL_CURVES = f"""{_SQL_X}, o AS (SELECT m, CAST(l % 4 AS INTEGER) AS own, list_concat(e, [1.0]) AS e FROM x), k AS (SELECT DISTINCT own AS cluster FROM o),
 w AS (SELECT cluster, list((((i * 7 + cluster * 3) % 11) - 5) * 0.1 ORDER BY i) AS w FROM k, (SELECT unnest(range(0, 65)) AS i) GROUP BY cluster),
 p AS (SELECT cluster, e, CAST(own = cluster AS INTEGER) AS y, 1 / (1 + exp(-list_dot_product(e, w))) AS p FROM o, w),
 v AS (SELECT cluster, -1 AS i, -1 AS j, sum(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)) AS v FROM p GROUP BY cluster
  UNION ALL SELECT cluster, i - 1, -1, sum((p - y) * e[i]) FROM p, (SELECT unnest(range(1, 66)) AS i) GROUP BY cluster, i
  UNION ALL SELECT cluster, i - 1, j - 1, sum(p * (1 - p) * e[i] * e[j]) FROM p, (SELECT unnest(range(1, 66)) AS i), (SELECT unnest(range(1, 66)) AS j) GROUP BY cluster, i, j)"""


@query(f"WITH {_SQL_CURVES} SELECT cluster, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v, {_CURVES}) AS value FROM v")
def matcher_sums(spark, d):
    """What a step of the matchers' fit is made of: losses (i and j are -1), slopes (j is -1) and curvatures at given coefficients."""
    rows = _x(spark, d).select(F.lit(0).cast("long").alias("node"), F.col("e").alias("vec"), F.array((F.col("l") % 4).cast("int")).alias("clusters"))
    own = sorted(r[0] for r in rows.select(F.get("clusters", 0)).distinct().collect())  # four at most
    coef = np.array([[((i * 7 + c * 3) % 11 - 5) * 0.1 for i in range(WIDTH + 1)] for c in own])
    got = linear.sums(rows, {0: (own, coef, np.ones((len(own), 2)))})
    n = WIDTH + 1

    def cells(batches):
        for batch in batches:
            for cluster, chunk, sums in zip(batch["cluster"], batch["chunk"], batch["sums"], strict=True):
                at = np.arange(chunk * linear.PER_CHUNK, chunk * linear.PER_CHUNK + len(sums) // 8)
                i = np.where(at == 0, -1, np.where(at <= n, at - 1, (at - n - 1) // n))
                j = np.where(at <= n, -1, (at - n - 1) % n)
                yield pd.DataFrame({"cluster": np.full(len(at), cluster, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "value": np.frombuffer(sums)})

    return got.mapInPandas(cells, "cluster int, i int, j int, value double").withColumn("value", _r("value", _CURVES))


@query()
def matcher_fit_predict(spark, d):
    x, fitted = _matcher(spark, d)
    scored = x.join(fitted, "node").withColumn("score", _r(model.probability(F.col("vec"), True)))
    return scored.select(F.col("mention_id").alias("vec_id"), "cluster", "score")


@query()
def ranker_fit_predict(spark, d):
    x = _x(spark, d).select(F.lit(0).cast("long").alias("node"), F.col("m").alias("mention_id"), F.col("e").alias("vec"))
    y = _x(spark, d).select(F.col("m").alias("mention_id"), F.col("l").cast("long").alias("label_id"))
    z = _z(_x(spark, d)).select(F.lit(0).cast("long").alias("node"), F.col("l").cast("long").alias("label_id"), "z")
    of = _four(spark, d).select(F.lit(0).cast("long").alias("node"), F.col("label_id").cast("long").alias("label_id"), "cluster")
    pool = model.ranker_pool(x, y, z, of, None, {"E_warm": 2}, 4)
    config = {"type": "sklearnsgdclassifier", "kwargs": {"loss": "log_loss", "random_state": 1}}
    # all pairs of a mention and a label of its clusters
    pairs = labels.mention_clusters(y, of).join(of, "cluster").select("node", "mention_id", "label_id").distinct().join(x, ["node", "mention_id"])
    scored = parts.Ranker.train(pool, x, z, config, 4).predict_proba(pairs, z)
    return scored.select(F.col("mention_id").alias("vec_id"), "label_id", _r("score").alias("score"))


@query()
def xmodel_train_predict(spark, d):
    """A tree of two layers over part names, and the five best brands of each name."""
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("long").alias("mention_id"), F.col("p_name").alias("text"), F.col("p_brand").alias("label"))
    fitted = model.XModel(dimension_config={"kwargs": {"n_components": 24}}, clustering_config={"type": "balancedkmeans", "kwargs": {"n_clusters": 2}}, ranker_config={"type": "sklearnsgdclassifier", "kwargs": {"loss": "log_loss"}, "cur_config": {"neg_mult": 2}}, min_leaf_size=4, depth=2).train(part)
    asked = part.groupBy("text").agg(F.min("mention_id").alias("query_id"))
    return fitted.predict(asked).withColumn("score", _r("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF, label embeddings and cosine top five of part names."""
    return cosine_topk_tfidf(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
