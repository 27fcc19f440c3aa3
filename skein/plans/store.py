"""A versioned, content-addressed snippet index in Parquet.

Each indexed version appends to the tables only what it changes: new texts and vectors, the file listing's changes, and
the states of rows that were opened, closed or got new line numbers. A row's latest state holds, so readers merge on
reading; ``compact`` folds the appended parts into one. A step is published by a manifest of its own number, written
under another name and then renamed. Readers open the highest manifest that is complete; a run that fails at any point
leaves the step before as it was. Rows hold half-open ranges ``[seq_added, seq_removed)``; texts and vectors are stored
once per content.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import hashed_bow
from ..functions.text import vector_id
from ..operators import dense, diff, extract, fusion, lineage, sparse
from ..operators.ranking import LARGEST, row_number_of_few, spread_row_number
from ..session import shuffles_dropped, written
from ..sources.code_files import changed_files

ROWS = "row_id long, snippet_id string, file_path string, qualname string, kind string, language string, ordinal int, line_start int, line_end int, version_added string, version_removed string, seq_added int, seq_removed int, lineage_id long"
#: ``at`` is the version that wrote a state; the listing keeps removed files with a null hash.
SCHEMAS = {
    "versions": "seq int, version string, indexed_at string, n_files long, n_snippets long, diff_json string",
    "files": "file_path string, file_hash string, at int",
    "rows": f"{ROWS}, at int",
    "texts": "snippet_id string, vector_id long, text string, v array<double>",
    "links": "old_snippet_id string, new_snippet_id string, file_path string, qualname string, version string",
}
#: Layout of the tables; stores of an older layout are brought up when they are opened.
LAYOUT = 2
#: Parts of the row table from which on it is compacted before the next version.
PARTS = 32
#: Changed files, or new texts, of which no more go to every task; beyond that Spark pairs partitions.
SENT = 200_000


@dataclass
class IndexStats:
    version: str
    seq: int
    files_total: int = 0
    files_changed: int = 0
    files_parsed: int = 0
    snippets_total: int = 0
    texts_embedded: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def total_seconds(self) -> float:
        return sum(self.seconds.values())


class VersionedIndex:
    """``embed(df, id, text)`` gives ``id, v``; the same function embeds queries."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame, str, str], DataFrame] = hashed_bow, strip_comments: bool = False):
        self.spark, self.path, self.embed, self.strip_comments = spark, path.rstrip("/"), embed, strip_comments
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.manifest = self._read() or {"step": 0, "tables": {}, "floor": 1, "layout": LAYOUT}
        self._bm25: dict[tuple[int, int], sparse.Bm25Index] = {}
        self._rows: dict[tuple[int, int], DataFrame] = {}
        if self.manifest.get("layout") != LAYOUT:
            # older rows know no lineage: the column is added by reading with the schema, and filled from the ranges
            self.manifest["layout"] = LAYOUT
            self.backfill_lineage()

    # ---- storage
    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _steps(self) -> list[int]:
        """Numbers of the manifests, highest first."""
        if not self._fs.exists(self._fs_path):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._fs_path)]
        return sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit()), reverse=True)

    def _read(self) -> dict | None:
        for step in self._steps():
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/manifest-{step}.json").collect())
            try:
                found = json.loads(text)
            except ValueError:
                continue
            if found.get("step") == step:
                return found
        return None

    def _publish(self, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, **meta) -> None:
        """Write tables, anew or as further parts, and make them the store's state by one rename.

        A table may be a function that makes it, or None where there is nothing to write.
        """
        step = max([self.manifest["step"], *self._steps()[:1]]) + 1
        new = {**self.manifest, **meta, "step": step, "tables": dict(self.manifest["tables"])}

        def put(name: str, made: DataFrame | Callable[[], DataFrame | None]) -> str | None:
            df = made if isinstance(made, DataFrame) else made()
            if df is None:
                return None
            self._write(name, df, f"step-{step}/{name}")
            return name

        with shuffles_dropped(self.spark), ThreadPoolExecutor(5) as pool:  # the tables of a step don't depend on each other
            there = list(pool.map(lambda x: put(*x), [*(replace or {}).items(), *(append or {}).items()]))
        for name in filter(None, there):
            before = [] if name in (replace or {}) else new["tables"].get(name, [])
            new["tables"][name] = [*before, f"step-{step}/{name}"]
        tmp, final = self._p(f"manifest-{step}.tmp"), self._p(f"manifest-{step}.json")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            raise RuntimeError(f"step {step} was published by another writer")
        self.manifest = new
        self._bm25.clear()
        self._rows.clear()

    def _write(self, name: str, df: DataFrame, at: str) -> None:
        if "at" not in df.columns and "at int" in SCHEMAS[name]:
            df = df.withColumn("at", F.lit(self.manifest.get("seq", 0)))
        df.write.mode("overwrite").parquet(f"{self.path}/{at}")

    def _drop_unused(self) -> None:
        """Remove manifests before the current one and the parts that only they name. Readers of those must open again."""
        for step in self._steps():
            if step < self.manifest["step"]:
                self._fs.delete(self._p(f"manifest-{step}.json"), False)
        used = {p for parts in self.manifest["tables"].values() for p in parts}
        for step in self._fs.listStatus(self._fs_path):
            name = step.getPath().getName()
            if step.isDirectory() and name.startswith("step-"):
                parts = [f"{name}/{t.getPath().getName()}" for t in self._fs.listStatus(step.getPath())]
                for p in parts:
                    if p not in used:
                        self._fs.delete(self._p(p), True)
                if not used.intersection(parts):
                    self._fs.delete(step.getPath(), True)

    def _parts(self, name: str) -> DataFrame:
        at = self.manifest["tables"].get(name)
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{p}" for p in at])

    def table(self, name: str, paths: DataFrame | None = None) -> DataFrame:
        """A table as of the last step; of rows and files the latest states, of those of the files ``paths`` if given.

        As no state of a row names another file, others are left out before states are merged.
        """
        df = self._parts(name)
        if paths is not None:
            df = df.join(paths, "file_path", "left_semi")
        if name not in ("rows", "files"):
            return df
        key = "row_id" if name == "rows" else "file_path"
        cols = [c for c in df.columns if c != "at"]
        if len(self.manifest["tables"].get(name, [])) > 1:
            df = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), "at").alias("s")).select(key, "s.*")
        return (df.where("file_hash is not null") if name == "files" else df).select(cols)

    def compact(self) -> None:
        """Fold the parts of every table into one, and free what no manifest names any more."""
        self._publish({n: self.table(n) for n in self.manifest["tables"]})
        self._drop_unused()

    def copy_to(self, path: str) -> VersionedIndex:
        """A branch of the index: the same tables under another path."""
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._fs_path, self._fs, self.spark._jvm.org.apache.hadoop.fs.Path(path), False, self.spark._jsc.hadoopConfiguration())
        return VersionedIndex(self.spark, path, self.embed, self.strip_comments)

    # ---- versions
    def versions(self) -> DataFrame:
        return self.table("versions").orderBy("seq")

    def seq(self, version: str | None = None) -> int:
        """The number of a version (None: the latest). An empty store is a ValueError, an unknown label a KeyError."""
        if version is None:
            if not self.manifest.get("seq"):
                raise ValueError("nothing is indexed yet")
            return self.manifest["seq"]
        row = self.table("versions").where(F.col("version") == version).select("seq").first()
        if row is None:
            raise KeyError(version)
        return row["seq"]

    def range(self, as_of: str | None = None, between: tuple[str, str] | None = None) -> tuple[int, int, bool]:
        """First and last version a search covers, and whether it spans several. Vacuumed versions are a ValueError."""
        if as_of is not None and between is not None:
            raise ValueError("as_of or between, not both")
        floor = self.manifest["floor"]
        if between is not None:
            lo, hi, multi = self.seq(between[0]), self.seq(between[1]), True
            if lo > hi:
                raise ValueError("between is not in version order")
        elif as_of == "all":
            return floor, self.seq(), True
        else:
            lo = hi = self.seq(as_of)
            multi = False
        if lo < floor:
            raise ValueError("a version was vacuumed and can no longer be searched")
        return lo, hi, multi

    def index_version(self, files: DataFrame, version: str, indexed_at: str | None = None) -> IndexStats:
        """Index a full listing ``file_path, content, file_hash``; only changed files are parsed, only new texts embedded."""
        made = lambda paths: extract.snippets(files.join(paths, "file_path", "left_semi"), self.strip_comments)
        return self.index_snippets(files, made, version, indexed_at)

    def index_snippets(self, files: DataFrame, snippets: Callable[[DataFrame], DataFrame], version: str, indexed_at: str | None = None, texts: DataFrame | None = None) -> IndexStats:
        """Index a full listing ``file_path, file_hash`` whose ``Snippet`` records ``snippets(paths)`` gives for some files.

        Where ``texts`` (snippet_id, text) is given the records need no text, and only texts that are new are fetched.
        Work and writes grow with what changed; of the store only the current rows of changed files are looked at.
        """
        if len(self.manifest["tables"].get("rows", [])) >= PARTS:
            self.compact()
        if self.table("versions").where(F.col("version") == version).limit(1).count():
            raise ValueError(f"version {version!r} is indexed already")
        seq = self.manifest.get("seq", 0) + 1
        stats = IndexStats(version, seq)
        tmp = f"{self.path}/tmp-{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            """Stages are tables too: their plans stay short, their sizes are known, and a lost executor takes nothing along."""
            at = f"{tmp}/{uuid.uuid4().hex}"
            with shuffles_dropped(self.spark):
                df.write.parquet(at)
            return self.spark.read.schema(df.schema).parquet(at)

        @contextmanager
        def phase(name: str):
            t = time.perf_counter()
            yield
            stats.seconds[name] = round(stats.seconds.get(name, 0) + time.perf_counter() - t, 3)

        key, cols = diff.KEY, [c.split(" ")[0] for c in ROWS.split(", ")]
        sent = lambda df, n: F.broadcast(df) if n <= SENT else df
        try:
            with phase("scan"):
                changed = keep(changed_files(self.table("files"), files, with_hash=True))
                n = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
                stats.files_changed = sum(n.values())
                stats.files_parsed = stats.files_changed - n.get("removed", 0)
                stats.files_total = self.manifest.get("n_files", 0) + n.get("new", 0) - n.get("removed", 0)
            with phase("parse"):
                parsed = sent(changed.where("change <> 'removed'").select("file_path"), stats.files_parsed)
                new = snippets(parsed).select(*key, "kind", "language", "line_start", "line_end", "snippet_id", *(["text"] if texts is None else []))
                affected = self.table("rows", sent(changed.select("file_path"), stats.files_changed)).where("seq_removed is null")
                with ThreadPoolExecutor(2) as pool:
                    new, affected = pool.map(keep, (new, affected))
                    n_new, n_affected = pool.map(lambda x: x.count(), (new, affected))
                few = n_new + n_affected <= LARGEST
            with phase("diff"):
                d = keep(diff.diff_snippets(affected, new, few=few))
                c = diff.counts(d).first()
                counts = {k: int(c[k] or 0) for k in ("added", "deleted", "unchanged", "modified", "moved")}
                there = counts["deleted"] + counts["unchanged"] + counts["modified"] + counts["moved"]
                counts["unchanged"] += self.manifest.get("n_snippets", 0) - there
                stats.counts = counts
                stats.snippets_total = counts["added"] + counts["unchanged"] + counts["modified"] + counts["moved"]
                ends = d.where("old_file_path is not null").select("change_class", *[F.col(f"old_{k}").alias(k) for k in key], *[F.col(f"new_{k}").alias(f"n_{k}") for k in key])
                state = affected.join(ends, key)
                gone = state.where("change_class <> 'unchanged'").withColumns({"version_removed": F.lit(version), "seq_removed": F.lit(seq)}).select(cols)
                lines = new.select(*key, F.col("line_start").alias("ls"), F.col("line_end").alias("le"))
                shifted = state.where("change_class = 'unchanged'").join(lines, key).where("not (line_start <=> ls and line_end <=> le)")
                shifted = shifted.withColumns({"line_start": F.col("ls"), "line_end": F.col("le")}).select(cols)
                starts = d.where("new_file_path is not null and change_class <> 'unchanged'").select(*[F.col(f"new_{k}").alias(k) for k in key], *[F.col(f"old_{k}").alias(f"o_{k}") for k in key])
                line = affected.select(*[F.col(k).alias(f"o_{k}") for k in key], F.col("lineage_id").alias("old_lineage"))
                starts = new.drop("text").join(starts, key).join(line, [f"o_{k}" for k in key], "left")
                base = self.manifest.get("last_row_id", 0)
                numbered = (row_number_of_few if few else spread_row_number)(starts.withColumn("_g", F.lit(0)), ["_g"], key).withColumn("row_id", F.lit(base).cast("long") + F.col("rn"))
                opened = numbered.withColumns(
                    {"ordinal": F.col("ordinal").cast("int"), "version_added": F.lit(version), "version_removed": F.lit(None).cast("string"), "seq_added": F.lit(seq), "seq_removed": F.lit(None).cast("int"), "lineage_id": F.coalesce("old_lineage", "row_id")}
                ).select(cols)
                n_opened = counts["added"] + counts["modified"] + counts["moved"]
                links = d.where("change_class = 'modified'").select("old_snippet_id", "new_snippet_id", F.col("new_file_path").alias("file_path"), F.col("new_qualname").alias("qualname"), F.lit(version).alias("version"))

            def embedded() -> DataFrame | None:
                """New texts with their vectors; rows, listing and links are written meanwhile."""
                with phase("embed"):
                    want = d.where("change_class in ('added', 'modified') and new_snippet_id is not null").select(F.col("new_snippet_id").alias("snippet_id")).distinct()
                    want = want.join(self.table("texts").select("snippet_id"), "snippet_id", "left_anti")
                    if texts is None:
                        fresh = new.select("snippet_id", "text").join(want, "snippet_id", "left_semi")
                    else:
                        want = keep(want)
                        fresh = want.join(texts.join(F.broadcast(want), "snippet_id", "left_semi") if n_opened <= SENT else texts, "snippet_id", "left").select("snippet_id", "text")
                    fresh = keep(fresh.dropDuplicates(["snippet_id"]))
                    stats.texts_embedded = fresh.count()
                    made = fresh if stats.texts_embedded else fresh.limit(0)
                    vec = self.embed(made, "snippet_id", "text").select(F.col("id").alias("snippet_id"), F.col("v").cast("array<double>").alias("v"))
                    stored = fresh.join(vec, "snippet_id").select("snippet_id", vector_id(F.col("snippet_id")).alias("vector_id"), "text", "v")
                return stored if stats.texts_embedded or seq == 1 else None

            with phase("write"):
                row = self.spark.createDataFrame([(seq, version, indexed_at, stats.files_total, stats.snippets_total, json.dumps(counts))], SCHEMAS["versions"])
                listed = changed.select("file_path", F.when(F.col("change") != "removed", F.col("file_hash")).alias("file_hash"))
                at = F.lit(seq).alias("at")
                parts = {"rows": gone.unionByName(shifted).unionByName(opened).select("*", at), "files": listed.select("*", at), "versions": row}
                parts |= {"links": links} if counts["modified"] or seq == 1 else {}
                # a handful of rows makes one file; a first load keeps its partitions
                parts = {k: v.coalesce(1) if stats.files_changed < 1000 else v for k, v in parts.items()} | {"texts": embedded}
                self._publish(append=parts, seq=seq, n_files=stats.files_total, n_snippets=stats.snippets_total, last_row_id=base + n_opened)
            # embedding has its own line
            stats.seconds["write"] = round(max(0.0, stats.seconds["write"] - stats.seconds["embed"]), 3)
        finally:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(tmp), True)
        return stats

    # ---- reading
    def valid_rows(self, version: str | None = None) -> DataFrame:
        return lineage.as_of(self.table("rows"), self.seq(version)).orderBy("file_path", "line_start")

    def lineage(self) -> DataFrame:
        return self.table("links")

    def _labelled(self, rows: DataFrame) -> DataFrame:
        """Rows with ``valid_through``, the label of the last version at which they were valid."""
        label = self.table("versions").select(F.col("seq").alias("_seq"), F.col("version").alias("valid_through"))
        return rows.join(label, F.coalesce(F.col("seq_removed") - 1, F.lit(self.manifest.get("seq", 0))) == F.col("_seq"), "left").drop("_seq")

    def _rows_of(self, lo: int, hi: int) -> DataFrame:
        """Labelled rows of a range with the ids of their vectors; states are merged once until the next step."""
        if (lo, hi) not in self._rows:
            rows = self._labelled(lineage.between(self.table("rows"), lo, hi)).withColumn("vector_id", vector_id(F.col("snippet_id")))
            self._rows[lo, hi] = written(rows, "rows")
        return self._rows[lo, hi]

    def _bm25_of(self, lo: int, hi: int) -> sparse.Bm25Index:
        """Statistics cover the distinct texts valid in the range, never the whole store."""
        if (lo, hi) not in self._bm25:
            ids = self._rows_of(lo, hi).select("snippet_id").distinct()
            self._bm25[lo, hi] = sparse.build(self.table("texts").join(ids, "snippet_id", "left_semi"), "vector_id", "text")
        return self._bm25[lo, hi]

    def search(self, query: str, k: int = 10, as_of: str | None = None, between: tuple[str, str] | None = None, use_bm25: bool = True, bm25_weight: float = 0.3, candidates: int = 100, group_by_lineage: bool | None = None) -> DataFrame:
        """``search_many`` for one question, in order of rank."""
        asks = self.spark.createDataFrame([(0, query)], "query_id long, text string")
        return self.search_many(asks, k, as_of, between, use_bm25, bm25_weight, candidates, group_by_lineage).drop("query_id").orderBy("rank", "file_path", "line_start")

    def search_many(self, queries: DataFrame, k: int = 10, as_of: str | None = None, between: tuple[str, str] | None = None, use_bm25: bool = True, bm25_weight: float = 0.3, candidates: int = 100, group_by_lineage: bool | None = None) -> DataFrame:
        """Rank the snippets of a version or a range for each of ``queries`` (query_id, text).

        Ungrouped, ``k`` texts are taken and each of their places is a row. Grouped, a row is a lineage: the score of its
        best version beside its latest, and the pool of candidates doubles until every query has ``k`` lineages or all
        texts are in it; lists of all texts are made once, when the first pool was too small, and then only cut.
        """
        lo, hi, multi = self.range(as_of, between)
        grouped = multi if group_by_lineage is None else group_by_lineage
        rows = self._rows_of(lo, hi)
        pool = dense.allowed(self.table("texts").select(F.col("vector_id").alias("id"), "v"), rows.select(F.col("vector_id").alias("id")))
        size = rows.select("vector_id").distinct().count()
        ask = self.embed(queries.select(F.col("query_id").alias("id"), "text"), "id", "text")
        lists = lambda n: [dense.search(pool, ask, max(n, 1))] + ([sparse.search(self._bm25_of(lo, hi), queries, "query_id", "text", max(n, 1))] if use_bm25 else [])
        cand = max(candidates, 4 * k) if grouped else candidates
        made = [lists(min(cand, size))]

        def ranked_at(n: int, _=None) -> DataFrame:
            if n > cand and len(made) == 1:
                made.append([written(x, "ranked") for x in lists(size)])
            cuts = [x.where(F.col("rank") <= n) for x in made[-1]]
            return fusion.fuse(cuts, [1.0, bm25_weight]) if use_bm25 else cuts[0]

        if not grouped:
            hit = ranked_at(cand).where(F.col("rank") <= k).join(rows, F.col("id") == F.col("vector_id"))
            return hit.select("query_id", "rank", "score", *[c.split(" ")[0] for c in ROWS.split(", ")], "valid_through")
        out = lineage.widened(ranked_at, queries, rows, k, cand, size, ("kind", "line_start", "line_end", "version_added", "version_removed", "valid_through"), "version_added")
        labels = self.table("versions").select(F.col("seq").alias("matched_seq"), F.col("version").alias("matched_version"))
        return out.join(labels, "matched_seq", "left").drop("shown_seq", "seq_removed")

    @staticmethod
    def describe_result(r: dict) -> str:
        """One line for a result row: where it is, which versions it covers and which one matched."""
        # fixed values: the wording of result lines
        place = f"{r['file_path']}:{r.get('line_start')}-{r.get('line_end')}  {r['qualname']}"
        span = lineage.span(r["version_added"], r["valid_through"])
        if r.get("n_versions") is None:
            return f"{place}  [{span}]"
        n = r["n_versions"]
        names = f"{n} version{'' if n == 1 else 's'}" + (f": {', '.join(r['versions'])}" if n > 1 else "")
        how = f"matched on the wording of {r['matched_version']}" if r["matched_differs"] else "matched on this version"
        return f"{place}  [{names}]  showing {span}, {how}"

    def history(self, name: str | None, file_path: str | None = None, with_diffs: bool = False) -> DataFrame:
        """The rows of every lineage that ever had a function of that name (None: of all lineages), in version order.

        Lineages come by place of their latest member. ``valid_through`` is a label.
        """
        all_rows = self.table("rows")
        rows = all_rows if name is None else lineage.named(all_rows, name, file_path)
        h = lineage.history(rows, ["kind", "line_start", "line_end", "version_added", "version_removed"]).drop("valid_through")
        h = self._labelled(h)
        if with_diffs:
            h = lineage.unified_diffs(h, self.table("texts").select("snippet_id", "text"), "version_added")
        whole = Window.partitionBy("lineage_id")
        latest = F.max_by(F.struct("file_path", "qualname"), F.struct("seq_added", "row_id")).over(whole)
        h = h.withColumn("lineage_place", latest).withColumn("n_versions", F.count("*").over(whole))
        return h.orderBy("lineage_place.file_path", "lineage_place.qualname", "lineage_id", "seq_added", "row_id")

    # ---- upkeep
    def backfill_lineage(self) -> int:
        """Give rows without a lineage the one their ranges tell; the number of rows changed."""
        rows = self.table("rows")
        missing = rows.where("lineage_id is null").count()
        if missing:
            found = lineage.backfill(rows)
            fixed = rows.join(found, "row_id").withColumn("lineage_id", F.coalesce("lineage_id", "new_lineage_id")).select(rows.columns)
            self._publish({"rows": fixed})
        return missing

    def vacuum(self, keep_since: str | None = None) -> dict[str, int]:
        """Remove texts that no version from ``keep_since`` on needs, and their bytes. The floor of searches never goes down."""
        floor = max(self.seq(keep_since), self.manifest["floor"])
        kept, gone = lineage.live_texts(self.table("texts"), self.table("rows"), floor)
        out = {"vectors_removed": gone.count(), "vectors_kept": kept.count()}
        self._publish({"texts": kept}, floor=floor)
        self._drop_unused()
        return out


def equivalent(a: VersionedIndex, b: VersionedIndex, queries: DataFrame | None = None, k: int = 100, tolerance: float = 1e-3) -> bool:
    """Do two stores hold the same valid rows, and the content of each? (Of equal contents one layout is kept.)

    With ``queries`` (query_id, text) the scores of their best ``k`` places are compared too: equal places may differ by
    ``tolerance``, and a place only one store returns must score at most that much above the lowest score of its query.
    """
    place = ["file_path", "qualname", "ordinal"]
    cols = [*place, "snippet_id", "line_start", "line_end"]
    x, y = a.valid_rows().select(cols), b.valid_rows().select(cols)
    s, t = a.table("texts").select("snippet_id"), b.table("texts").select("snippet_id")
    live = lambda i, d: d.join(i.valid_rows().select("snippet_id").distinct(), "snippet_id", "left_semi")
    s, t = live(a, s), live(b, t)
    if not all(p.exceptAll(q).isEmpty() for p, q in ((x, y), (y, x), (s, t), (t, s))):
        return False
    if queries is None:
        return True
    found = [i.search_many(queries, k, use_bm25=False).select("query_id", *place, F.col("score").alias(c)) for i, c in ((a, "sa"), (b, "sb"))]
    least = [f.groupBy("query_id").agg(F.min(c).alias(f"least_{c}")) for f, c in zip(found, ("sa", "sb"))]
    both = found[0].join(found[1], ["query_id", *place], "full_outer").join(least[0], "query_id", "left").join(least[1], "query_id", "left")
    apart = F.abs(F.col("sa") - F.col("sb")) > tolerance
    alone = (F.col("sa").isNull() | F.col("sb").isNull()) & (F.coalesce("sa", "sb") > F.greatest("least_sa", "least_sb") + tolerance)
    return both.where(apart | alone).isEmpty()
