"""How distinctive each term of a record is, by smoothed language-model divergence.

``p(t|C)`` is the share of ``t`` among all tokens, ``p(t|d) = (tf + mu p(t|C)) / (|d| + mu)`` the Dirichlet-smoothed
share in a record. A term's score is its contribution to the relative entropy, ``p(t|d) ln(p(t|d) / p(t|C))``. Terms of
fewer than ``min_df`` records are shared by nobody and score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CODE_TOKENS_SQL, term_counts
from ..session import cut, written

MU = 200.0
MIN_DF = 2
#: Terms that at least one in HOT records hold are joined by broadcast: there are at most HOT x (mean terms a record).
HOT = 200


def term_scores(records: DataFrame, key: str, text: str, mu: float = MU, min_df: int = MIN_DF) -> DataFrame:
    """``key, term, tf, df, score`` for every record and each of its terms; statistics cover all records.

    Records with equal keys are scored each for itself. The counts are written once to the shared folder.
    """
    counted = written(term_counts(records, key, text), "terms")
    tf = counted.select(key, "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    stats = cut(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    total = stats.agg(F.sum("cf")).first()[0] or 1
    # frequent terms would put most rows into a few tasks; they are few, so they go to every task instead
    docs = max(counted.count() / HOT, 50)
    hot = F.broadcast(stats.where(F.col("df") >= docs).select(F.col("term").alias("hot_term"), F.col("df").alias("hdf"), F.col("cf").alias("hcf")))
    known = tf.join(hot, F.col("term") == F.col("hot_term"), "left")
    rest = known.where("hdf is null").drop("hot_term", "hdf", "hcf").join(stats.where(F.col("df") < docs), "term")
    joined = known.where("hdf is not null").select(key, "dl", "term", "tf", F.col("hdf").alias("df"), F.col("hcf").alias("cf")).unionByName(rest.select(key, "dl", "term", "tf", "df", "cf"))
    pc = F.col("cf") / total
    pd_ = (F.col("tf") + F.lit(mu) * pc) / (F.col("dl") + F.lit(mu))
    score = F.when(F.col("df") >= min_df, pd_ * F.log(pd_ / pc)).otherwise(F.lit(0.0))
    return joined.select(key, "term", "tf", "df", F.round(score, 6).alias("score"))


def top_terms(scores: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The ``k`` most characteristic terms of each record; ties by term."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return scores.where("score > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "term", "score")


_SQL = f"""
tok as (select snippet_id, unnest({CODE_TOKENS_SQL.format("text")}) term from snippet_text),
tf as (select snippet_id, term, count(*) tf from tok group by 1, 2),
tfl as (select *, sum(tf) over (partition by snippet_id) dl from tf),
st as (select term, count(*) df, sum(tf) cf from tf group by 1),
n as (select sum(cf) total from st),
j as (select snippet_id, term, tf, df, (tf + {MU} * (cf / total)) / (dl + {MU}) p, cf / total c from tfl join st using (term), n),
scores as (select snippet_id, term, tf, df, round(case when df >= {MIN_DF} then p * ln(p / c) else 0.0 end, 6) score from j)
"""

SQL = {
    "p5_scores": f"with {_SQL} select * from scores",
    "p5_top_terms": f"""with {_SQL} select snippet_id, rank, term, score from (
        select *, row_number() over (partition by snippet_id order by score desc, term) as rank from scores where score > 0) where rank <= 5""",
}
