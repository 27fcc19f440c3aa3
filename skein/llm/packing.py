"""Filling containers of fixed capacity: best fit over bins ordered by what is left in them, under conflicts.

Every bin carries two bitmaps, of the sources and of the duplicate clusters in it. An item goes into the tightest bin
it fits that holds no copy of it and no source it must not meet; the search walks from the exact residual upwards
until a compatible bin is found. Items above the capacity are cut into full containers and a rest.

Documents are spread over blocks of about ``BLOCK`` items by a hash of what they are, so no source, cluster or length
can fill a task and no layout of the files changes the result. Each block is packed for itself, largest items first.
What lies in containers that a block leaves well short of full is packed once more, over all blocks together.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import clean_source
from .tokens import count_tokens

BLOCK = 8192
#: Containers less full than this after the first round are opened again for the second.
FULL = 0.99
#: Sources that never share a container: a chat does not follow upon a code file.
APART = (("code_files", "chat_exports"),)


class Bins:
    """Bins of one capacity, reachable by residual; a bit of ``filled`` says whether a residual has any bin."""

    def __init__(self, capacity: int):
        self.capacity, self.at, self.filled, self.bins = capacity, {}, 0, []

    def place(self, size: int, source: int = 0, cluster: int = 0, shy: int = 0) -> int:
        """The bin for an item. ``source`` and ``cluster`` are its bits, ``shy`` the bits of sources it must not meet."""
        up = self.filled >> size
        left = size
        while up:
            step = (up & -up).bit_length() - 1
            left += step
            here = self.at[left]
            for i in range(len(here) - 1, -1, -1):
                b = here[i]
                if not (b[1] & shy or b[2] & cluster or b[3] & source):
                    here[i] = here[-1]
                    here.pop()
                    if not here:
                        self.filled &= ~(1 << left)
                    return self._put(b, left - size, source, cluster, shy)
            up >>= step + 1
            left += 1
        b = [len(self.bins), 0, 0, 0]
        self.bins.append(b)
        return self._put(b, self.capacity - size, source, cluster, shy)

    def _put(self, b: list, left: int, source: int, cluster: int, shy: int) -> int:
        b[1] |= source
        b[2] |= cluster
        b[3] |= shy
        self.at.setdefault(left, []).append(b)
        self.filled |= 1 << left
        return b[0]


def pack(sizes: list[int], capacity: int, sources: list[str | None] | None = None, clusters: list | None = None, apart: tuple[tuple[str, str], ...] = (), max_copies: int = 1) -> list[tuple[int, int, int, int]]:
    """``(item, part, bin, tokens)`` for each item or part of one, items being placed largest first, then as they come.

    A bin holds at most ``max_copies`` members of a cluster (None: no cluster), however many there are. Items of size
    0 go anywhere. ``apart`` lists pairs of sources that never share a bin.
    """
    if capacity < 1 or max_copies < 1:
        raise ValueError("capacity and max_copies must be positive")
    n = len(sizes)
    sources, clusters = sources or [None] * n, clusters or [None] * n
    names = {s: i for i, s in enumerate(dict.fromkeys(x for pair in apart for x in pair))}
    shy = Counter()
    for a, b in apart:
        shy[a] |= 1 << names[b]
        shy[b] |= 1 << names[a]
    many = Counter(c for c, s in zip(clusters, sizes) if c is not None and s > 0)
    seen, bit = Counter(), {}
    bins, out = Bins(capacity), []
    for i in sorted(range(n), key=lambda i: (-(sizes[i] % capacity if sizes[i] > capacity else sizes[i]), i)):
        size, part, src = int(sizes[i]), 0, sources[i]
        own, away = 1 << names[src] if src in names else 0, shy[src]
        while size > capacity:
            out.append((i, part, bins.place(capacity, own, 0, away), capacity))
            size, part = size - capacity, part + 1
        cluster = 0
        if many[clusters[i]] > max_copies and size:
            # dealt in turn to as many classes as a bin may hold copies, each class kept apart in itself
            group = (clusters[i], seen[clusters[i]] % max_copies)
            seen[clusters[i]] += 1
            cluster = 1 << bit.setdefault(group, len(bit))
        out.append((i, part, bins.place(size, own, cluster, away), size))
    return out


def cluster_key(text: Column) -> Column:
    """Texts are copies of each other if they have the same letters: case, digits, punctuation and layout don't count.

    Texts without a letter a to z are copies only where they are equal, empty ones and nulls never.
    """
    bare = F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))
    return F.when(text != "", F.xxhash64(F.when(bare != "", bare).otherwise(text)))


def pack_documents(docs: DataFrame, specs: DataFrame, block: int = BLOCK, apart: tuple[tuple[str, str], ...] = APART, max_copies: int = 1) -> DataFrame:
    """``container, container_id, doc_id, part, token_start, n_tokens``: every document, or each part, for every spec.

    Null and empty texts have 0 tokens. Repeated rows are items of their own. ``container_id`` is unique within a
    container kind. Specs without a positive capacity raise. The same rows give the same containers, in whatever order
    or files they come.
    """
    caps = {r["container"]: int(r["capacity_tokens"]) for r in specs.select("container", "capacity_tokens").collect()}  # a fixed table
    if any(c < 1 for c in caps.values()):
        raise ValueError("capacity must be positive")
    key = ["doc_id", "source", "cluster", "size"]
    sized = docs.select("doc_id", clean_source(F.col("source")).alias("source"), cluster_key(F.col("text")).alias("cluster"), count_tokens(F.col("text")).alias("size"))
    # repeated rows get numbers, so that the block of each follows from the row alone
    items = cut(sized.groupBy(*key).agg(F.count("*").alias("n"))).withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).drop("n")
    total = items.count()
    first = _round(items.withColumn("container", F.explode(F.array(*[F.lit(c) for c in caps]))).withColumn("part", F.lit(0)) if caps else items.withColumn("container", F.lit("")).where("false").withColumn("part", F.lit(0)), total, block, caps, apart, max_copies)
    first = cut(first)
    left = first.where("again")
    second = _round(left.select(*key[:3], F.col("n_tokens").alias("size"), "copy", "container", "part"), left.count(), block, caps, apart, max_copies)
    done = lambda df, odd: df.select("container", (F.col("container_id") * 2 + odd).alias("container_id"), "doc_id", "part", (F.col("part").cast("long") * _of(caps)).alias("token_start"), "n_tokens")
    return done(first.where("not again"), 0).unionByName(done(second, 1))


def _of(caps: dict[str, int]):
    return F.coalesce(*[F.when(F.col("container") == k, F.lit(v)) for k, v in caps.items()], F.lit(0))


def _round(items: DataFrame, total: int, block: int, caps: dict[str, int], apart: tuple, max_copies: int) -> DataFrame:
    """Pack items in blocks; ``again`` marks those in bins that are less than ``FULL`` full."""
    blocks = max(1, -(-total // block))
    items = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "source", "cluster", "size", "copy"), F.lit(blocks)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "source", "cluster", "copy", "part"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        cap, at = caps[pdf["container"].iloc[0]], int(pdf["block"].iloc[0])
        clusters = [None if pd.isna(c) else int(c) for c in pdf["cluster"]]
        rows = np.array(pack(pdf["size"].tolist(), cap, pdf["source"].tolist(), clusters, apart, max_copies), dtype=np.int64).reshape(-1, 4)
        fill = np.bincount(rows[:, 2], weights=rows[:, 3])
        out = pdf.iloc[rows[:, 0]][["container", "doc_id", "source", "cluster", "copy"]].reset_index(drop=True)
        out["part"] = pdf["part"].to_numpy()[rows[:, 0]] + rows[:, 1]
        out["container_id"], out["n_tokens"], out["again"] = rows[:, 2] * blocks + at, rows[:, 3], fill[rows[:, 2]] < FULL * cap
        return out

    kind = "container string, doc_id long, source string, cluster long, copy long, part int, container_id long, n_tokens long, again boolean"
    return items.groupBy("container", "block").applyInPandas(run, kind)


def checks(docs: DataFrame, packed: DataFrame, specs: DataFrame, apart: tuple[tuple[str, str], ...] = APART) -> DataFrame:
    """Per container kind what must be 0 or equal: documents missing, tokens in and out, containers above the capacity,
    documents cut though they fit, gaps between parts, copies that share a container, sources that must not meet."""
    d = docs.select("doc_id", clean_source(F.col("source")).alias("source"), cluster_key(F.col("text")).alias("cluster"), count_tokens(F.col("text")).alias("size"))
    d = cut(d.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("cluster").alias("cluster"), F.sum("size").alias("size")))
    packed = cut(packed)
    spec = F.broadcast(specs.select("container", "capacity_tokens"))
    bins = packed.groupBy("container", "container_id").agg(F.sum("n_tokens").alias("t")).join(spec, "container")
    bins = bins.groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("n_over"))
    each = packed.groupBy("container", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("parts"), F.max("part").alias("last"))
    each = each.join(d, "doc_id").join(spec, "container").groupBy("container").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("t") != F.col("size")).alias("n_wrong_tokens"), F.count_if((F.col("parts") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_cut_though_fitting"),
        F.count_if(F.col("parts") != F.col("last") + 1).alias("n_gaps"),
    )
    held = packed.where("n_tokens > 0").join(d.select("doc_id", "source", "cluster"), "doc_id").join(spec, "container").where("n_tokens < capacity_tokens")
    twice = held.groupBy("container", "container_id", "cluster").agg(F.count("*").alias("n")).where("cluster is not null and n > 1").groupBy("container").agg(F.count("*").alias("n_copies_together"))
    mask = sum((F.lit(1 << i) * F.col("source").eqNullSafe(F.lit(s)).cast("int") for i, s in enumerate(dict.fromkeys(x for p in apart for x in p))), F.lit(0))
    names = {s: i for i, s in enumerate(dict.fromkeys(x for p in apart for x in p))}
    met = held.groupBy("container", "container_id").agg(F.bit_or(mask).alias("m"))
    clash = F.lit(False)
    for a, b in apart:
        both = (1 << names[a]) | (1 << names[b])
        clash = clash | (F.col("m").bitwiseAND(F.lit(both)) == both)
    met = met.groupBy("container").agg(F.count_if(clash).alias("n_sources_together"))
    out = spec.join(each, "container", "left").join(bins, "container", "left").join(twice, "container", "left").join(met, "container", "left")
    zeros = ["n_docs", "n_wrong_tokens", "n_cut_though_fitting", "n_gaps", "n_over", "n_copies_together", "n_sources_together"]
    return out.select("container", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zeros])


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per container kind: containers, tokens, share filled, and the largest content."""
    each = packed.groupBy("container", "container_id").agg(F.sum("n_tokens").alias("t"))
    sums = each.groupBy("container").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return sums.join(F.broadcast(specs), "container").select("container", "n_containers", "n_tokens", "fullest", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("filled"))


SQL = {
    "p6_checks": """select c.container, (select count(distinct doc_id) from documents) n_docs, cast(0 as bigint) n_wrong_tokens, cast(0 as bigint) n_cut_though_fitting, cast(0 as bigint) n_gaps,
        cast(0 as bigint) n_over, cast(0 as bigint) n_copies_together, cast(0 as bigint) n_sources_together from container_specs c""",
}
