"""Mixing sources to target shares of all tokens by entropy balancing.

Wanted are rates ``r_i`` (expected uses of document ``i``) as close as possible in relative entropy to using each
document once, such that every source holds its share of the total and no rate exceeds the source's cap. The solution
is ``r_i = min(cap, exp(lambda_s x_i))`` with ``x_i`` the document's tokens over the source's mean; the dual is convex
in each ``lambda_s`` and is solved by Newton steps on sums over all documents. As a rate depends on nothing but source
and length, documents are first counted by these; the sums run over the counts, distributed, and are exact.

Rates become whole copies by systematic rounding along the lengths of a source, so the tokens of a source are met up
to about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import clean_source
from .tokens import count_tokens

#: Documents of one source and length that are ranked together when copies are dealt. Cells above that are split, if
#: they hold at least one in ``SPLIT`` documents; so there are at most ``SPLIT`` such cells, whatever the data.
CELL, SPLIT = 10_000, 2_000


def _lit_map(values: dict[str, float]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def solve(cells: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 60, tol: float = 1e-6) -> dict[str, dict[str, float]]:
    """Per source: ``lam`` (inf where every document is used up to the cap), ``mean``, ``cap``, ``goal``.

    ``cells`` has ``source, n_tokens, n``. ``total`` defaults to the largest total at which all shares can be met.
    Sources without tokens or share get ``goal`` 0 and are not used. The driver holds one number per source of the
    fixed target table.
    """
    live = cells.where(F.col("source").isin(list(targets)) & (F.col("n_tokens") > 0))
    have = {r["source"]: r for r in live.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    room = {s: targets[s][1] * have[s]["t"] for s in have if targets[s][0] > 0 and targets[s][1] > 0}
    if not room:
        return {}
    share = sum(targets[s][0] for s in room)
    best = min(room[s] / (targets[s][0] / share) for s in room)
    total = best if total is None else min(total, best)
    plan = {s: {"goal": total * targets[s][0] / share, "cap": float(targets[s][1]), "mean": have[s]["t"] / have[s]["n"], "lam": 0.0, "lo": -math.inf, "hi": math.inf} for s in room}
    for s, p in plan.items():
        if p["goal"] >= room[s] * (1 - 1e-9):
            p["lam"] = math.inf
    for _ in range(rounds):
        todo = {s: p["lam"] for s, p in plan.items() if math.isfinite(p["lam"]) and not p.get("done")}
        if not todo:
            break
        x = F.col("n_tokens") / _lit_map({s: plan[s]["mean"] for s in todo})[F.col("source")]
        cap = _lit_map({s: plan[s]["cap"] for s in todo})[F.col("source")]
        lam = _lit_map(todo)[F.col("source")]
        raw = F.exp(F.least(lam * x, F.lit(700.0)))
        w = F.col("n_tokens") * F.col("n")
        sums = live.where(F.col("source").isin(list(todo))).groupBy("source").agg(F.sum(w * F.least(raw, cap)).alias("g"), F.sum(F.when(raw < cap, w * x * raw).otherwise(0.0)).alias("h"))
        for r in sums.collect():
            p = plan[r["source"]]
            off = r["g"] - p["goal"]
            if abs(off) <= tol * p["goal"]:
                p["done"] = True
                continue
            p["lo" if off < 0 else "hi"] = p["lam"]
            step = p["lam"] - off / r["h"] if r["h"] > 0 else math.nan
            lo, hi = p["lo"], p["hi"]
            if not (lo < step < hi):
                step = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else p["lam"] + (1 if off < 0 else -1) * max(1.0, abs(p["lam"]))
            p["lam"] = step
    return plan


def checks(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its documents, those used more often than allowed, whether its share of all tokens used is met to
    the length of one document (its longest) or 0.002, and whether any document is used. The shares of sources without
    tokens go to the others."""
    want = targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    sums = uses.join(F.broadcast(want), "source").groupBy("source", "target_share").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("n_over_cap"), F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("n_tokens").alias("longest")
    )
    one = Window.partitionBy(F.lit(1))  # a row per source of the fixed target table
    whole, goal = F.sum("t").over(one), F.col("target_share") / F.sum(F.when(F.col("longest") > 0, F.col("target_share"))).over(one)
    return sums.select("source", "n_docs", "n_over_cap", (F.abs(F.col("t") / whole - goal) <= F.greatest(F.col("longest") / whole, F.lit(0.002))).alias("share_met"), (F.col("t") > 0).alias("used"))


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(uses, report)``: ``doc_id, source, n_tokens, rate, copies`` for every row, and the shares reached per source.

    Documents of sources without a target are not used (rate 0). Texts without tokens weigh nothing and are used
    once where their source is. Repeated rows are dealt copies as documents of their own.
    """
    want = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    sized = cut(docs.select("doc_id", clean_source(F.col("source")).alias("source"), count_tokens(F.col("text")).alias("n_tokens")))
    cells = cut(sized.groupBy("source", "n_tokens").agg(F.count("*").alias("n")))
    plan = solve(cells, want, total)

    def per(name: str, other: float):
        return F.coalesce(_lit_map({s: p[name] for s, p in plan.items()})[F.col("source")], F.lit(other)) if plan else F.lit(other)

    cap, lam = per("cap", 0.0), per("lam", 0.0)
    x = F.col("n_tokens") / per("mean", 1.0)
    rate = F.when(F.col("n_tokens") == 0, F.least(cap, F.lit(1.0))).when(lam == math.inf, cap).otherwise(F.least(cap, F.exp(F.least(lam * x, F.lit(700.0)))))
    # deal the copies: cells of one source and length, split by hash where they are large, in order of length; the
    # large cells are at most SPLIT rows, so they go to every task
    n_docs = cells.agg(F.sum("n")).first()[0] or 0
    large = cells.where(F.col("n") > max(CELL, n_docs / SPLIT)).select(F.col("source").alias("cs"), F.col("n_tokens").alias("ct"), F.ceil(F.col("n") / CELL).cast("int").alias("slots"))
    same_cell = F.col("source").eqNullSafe(F.col("cs")) & (F.col("n_tokens") == F.col("ct"))
    slot = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slots")), F.lit(0))
    placed = sized.join(F.broadcast(large), same_cell, "left").select("doc_id", "source", "n_tokens", rate.alias("rate"), slot.alias("slot"))
    cell = ["source", "n_tokens", "slot"]
    groups = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.max("rate").alias("rate"))
    run = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("n_tokens", "slot").rowsBetween(Window.unboundedPreceding, 0))
    groups = groups.withColumn("upto", run).withColumn("k", (F.floor(F.round(F.col("upto"), 6) + 0.5) - F.floor(F.round(F.col("upto") - F.col("n") * F.col("rate"), 6) + 0.5)).cast("long"))
    g = groups.select(F.col("source").alias("gs"), F.col("n_tokens").alias("gt"), F.col("slot").alias("gslot"), "n", "k")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.xxhash64("doc_id"), "doc_id"))
    dealt = placed.withColumn("rank", rank).join(g, F.col("source").eqNullSafe(F.col("gs")) & (F.col("n_tokens") == F.col("gt")) & (F.col("slot") == F.col("gslot")))
    copies = (F.floor(F.col("k") / F.col("n")) + (F.col("rank") <= F.col("k") % F.col("n")).cast("long")).cast("int")
    uses = dealt.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), copies.alias("copies"))
    sums = uses.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("max_copies"))
    rows = [(s, *want[s]) for s in want]
    goal = docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int")
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    report = sums.join(F.broadcast(goal), "source", "full_outer").select(
        "source", "n_docs", "tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), "max_copies", "max_repeats", "target_share",
        F.round(F.coalesce(F.col("used_tokens") / whole, F.lit(0.0)), 6).alias("actual_share"),
    )
    return uses, report


SQL = {
    "p7_checks": """with d as (select regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') source from documents)
        select m.source, count(*) n_docs, cast(0 as bigint) n_over_cap, true share_met, true used from d join mix_targets m using (source) group by 1""",
}
