"""BM25 over documents counted once, with statistics per term.

``idf = ln(N - df + 0.5) - ln(df + 0.5)``; a negative one becomes ``EPSILON`` times the mean idf of all terms. A term
weighs ``idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len / avglen))`` in a document; a query's score is the sum over
its terms, repeats counting, and only scores above 0 are results. Ties of the score rounded to six digits go by id.

Search packs documents into blocks, each with its own postings, and queries into blocks with the weights of their terms.
Every block of documents meets every block of queries; only the latter are copied. A task keeps the best ``k`` of each
query over all blocks it is given, so postings are never shuffled, and what leaves it are results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import term_counts
from ..session import block_pairs, cut, written
from .ranking import Best

# fixed values: the usual parameters
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Documents in one block, queries scored at once, and contributions that are added up in one step.
HELD, ASKED, STEP = 4096, 512, 4_000_000
#: How often ASKED queries lie in one block.
SPREAD = 8
#: Results that a task keeps before it hands them on.
KEPT = 4_000_000


@dataclass
class Bm25Index:
    """``docs``: id, dl, terms, tfs; ``terms``: term, df, idf; ``avg_len`` of all documents."""

    docs: DataFrame
    terms: DataFrame
    avg_len: float

    @property
    def postings(self) -> DataFrame:
        """``id, term, tf, weight``: the inverted view."""
        tf = self.docs.select("id", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
        w = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.avg_len)))
        return tf.join(self.terms, "term").select("id", "term", "tf", w.alias("weight"))

    def save(self, path: str) -> None:
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.sparkSession.createDataFrame([(self.avg_len,)], "avg_len double").write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bm25Index:
        return Bm25Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/stats").first()[0])


def build(corpus: DataFrame, id_col: str, text: str) -> Bm25Index:
    """Index a corpus of unique ids; statistics cover exactly its documents, also those without a token."""
    docs = written(term_counts(corpus, id_col, text).withColumnRenamed(id_col, "id"), "bm25")
    sums = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = cut(df.withColumn("raw", F.log(F.lit(sums["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(docs, terms, sums["avg"] or 1.0)


def search(index: Bm25Index, queries: DataFrame, query_id: str, text: str, k: int = 10) -> DataFrame:
    """``query_id, id, score, rank`` of the ``k`` best documents of every query; queries without a known term have none."""
    kind, doc_kind = queries.schema[query_id].dataType.simpleString(), index.docs.schema["id"].dataType.simpleString()
    q = written(term_counts(queries.select(F.col(query_id).alias("query_id"), F.col(text).alias("query_text")), "query_id", "query_text").where("dl > 0"), "asked")
    n_blocks = max(1, -(-q.count() // (ASKED * SPREAD)))
    asked = q.select("query_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).join(index.terms.select("term", "idf"), "term")
    asked = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("qblock"), "query_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked = asked.groupBy("qblock").applyInPandas(_asked_block, f"qblock int, qids array<{kind}>, qterms array<string>, qat binary, qterm binary, qw binary")
    held = _held_blocks(index.docs.where("dl > 0"), HELD)
    avg, step = index.avg_len, ASKED
    return top_k(block_pairs(held, asked, ["qids", "qterms", "qat", "qterm", "qw"]).mapInArrow(lambda batches: _best(batches, k, avg, step), f"query_id {kind}, id {doc_kind}, score double"), k)


def _asked_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the queries of a block: their terms by number, in order of query."""
    at, qids = pd.factorize(pdf["query_id"])
    term, names = pd.factorize(pdf["term"])
    order = np.argsort(at, kind="stable")
    packed = [x[order].tobytes() for x in (at.astype(np.int32), term.astype(np.int32), pdf["w"].to_numpy(np.float64))]
    return pd.DataFrame([(pdf["qblock"].iloc[0], list(qids), list(names), *packed)], columns=["qblock", "qids", "qterms", "qat", "qterm", "qw"])


def _held_blocks(docs: DataFrame, rows: int) -> DataFrame:
    """``ids, dl, names, starts, at, tf``: a row for each block of documents, with the postings of its terms."""

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = t["terms"].chunk(0)
            found = pc.dictionary_encode(lists.flatten())
            number = found.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            at = np.repeat(np.arange(t.num_rows, dtype=np.int32), pc.list_value_length(lists).to_numpy())
            starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(found.dictionary)))])
            tf = t["tfs"].chunk(0).flatten().to_numpy()
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            cols = [one(t["id"].chunk(0)), blob(t["dl"].to_numpy(), np.float64), one(found.dictionary), blob(starts, np.int64), blob(at[order], np.int32), blob(tf[order], np.int32)]
            return pa.RecordBatch.from_arrays(cols, ["ids", "dl", "names", "starts", "at", "tf"])

        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, rows - sum(x.num_rows for x in held))
                held.append(part)
                a += part.num_rows
                if sum(x.num_rows for x in held) == rows:
                    yield out()
        if held:
            yield out()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "dl", "terms", "tfs").mapInArrow(pack, f"ids array<{kind}>, dl binary, names array<string>, starts binary, at binary, tf binary")


def _best(batches, k: int, avg: float, step: int):
    """The ``k`` best documents of each query over all pairs of blocks that come in."""
    last, block, best = None, None, {}

    def out() -> list[pa.RecordBatch]:
        made = []
        for qids, found in best.values():
            i, ids, score = found.take()
            made.append(pa.RecordBatch.from_arrays([qids.take(pa.array(i)), pa.array(ids, block.kind), pa.array(score)], ["query_id", "id", "score"]))
        best.clear()
        return made

    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            key = row["at"].as_buffer(), row["ids"].values
            # the pairs of one block of documents come one after another
            if last is None or not (key[0].equals(last[0]) and key[1].equals(last[1])):
                last, block = key, _Block(row, avg)
            qids, names = row["qids"].values, row["qterms"].values
            q_at, q_term, q_w = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("qat", np.int32), ("qterm", np.int32), ("qw", np.float64)))
            number = row["qblock"].as_py()
            if number not in best:
                if sum(len(f) for _, f in best.values()) + min(k, HELD) * len(qids) > KEPT:
                    yield from out()
                best[number] = qids, Best(len(qids), k, 4e-7)
            place = pc.fill_null(pc.index_in(names, value_set=block.names), -1).to_numpy(zero_copy_only=False)[q_term]
            known = place >= 0
            q_at, place, q_w = q_at[known], place[known], q_w[known]
            for a in range(0, len(qids), step):
                lo, hi = np.searchsorted(q_at, [a, a + step])
                if lo < hi:
                    s = block.scores(q_at[lo:hi] - a, place[lo:hi], q_w[lo:hi], min(step, len(qids) - a))
                    best[number][1].add(s, block.ids, a)
        if sum(len(f) for _, f in best.values()) > KEPT:
            yield from out()
    if best:
        yield from out()


class _Block:
    """A block of documents, in order of id, with the weights of its postings."""

    def __init__(self, row, avg: float):
        ids = row["ids"].values
        self.kind = ids.type
        ids = ids.to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        turned = np.empty(len(ids), np.int64)
        turned[order] = np.arange(len(ids))
        self.ids, self.names = ids[order], row["names"].values
        dl, at, tf = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("dl", np.float64), ("at", np.int32), ("tf", np.int32)))
        self.start = np.frombuffer(row["starts"].as_buffer(), np.int64)
        self.n, self.at = np.diff(self.start), turned[at]
        self.w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[at] / avg))

    def __getitem__(self, term: int) -> slice:
        return slice(self.start[term], self.start[term + 1])

    def scores(self, q_at: np.ndarray, term: np.ndarray, q_w: np.ndarray, n_queries: int) -> np.ndarray:
        """Queries beside documents; ``q_at`` is in order."""
        wide = len(self.ids)
        # terms of many documents and queries as one matrix product, the others by their pairs
        asked = np.bincount(term, minlength=len(self.n))
        hot = np.flatnonzero((self.n * asked > 20_000) & (self.n * 8 > wide))
        column = np.full(len(self.n), -1)
        column[hot] = np.arange(len(hot))
        s = np.zeros((n_queries, wide))
        of = column[term]
        for a in range(0, len(hot), 256):
            part = hot[a : a + 256]
            m, q = np.zeros((len(part), wide)), np.zeros((n_queries, len(part)))
            for i, t in enumerate(part):
                m[i, self.at[self[t]]] = self.w[self[t]]
            own = (of >= a) & (of < a + len(part))
            q[q_at[own], of[own] - a] = q_w[own]
            s += q @ m
        rest = np.flatnonzero(of < 0)
        sizes = self.n[term[rest]]
        ends = np.cumsum(sizes)
        a = 0
        while a < len(rest):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP)))
            e, n = rest[a:b], sizes[a:b]
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[term[e]], n)
            lo, hi = q_at[e[0]], q_at[e[-1]] + 1
            cell = np.repeat((q_at[e].astype(np.int64) - lo) * wide, n) + self.at[off]
            s[lo:hi] += np.bincount(cell, np.repeat(q_w[e], n) * self.w[off], (hi - lo) * wide).reshape(-1, wide)
            a = b
        return s


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query by rounded score, then id."""
    s = scored.withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
