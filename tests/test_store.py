"""Incremental indexing, time travel, lineages and histories over a small timeline."""

import pytest
from pyspark.sql import functions as F

from skein.plans.store import VersionedIndex, equivalent
from skein.streaming.versions import index_stream

A1 = '''import json

def parse_config(path):
    with open(path) as f:
        return json.load(f)

def load_data(path):
    return open(path).read()

print(parse_config("x"))
'''
A2 = A1.replace("return json.load(f)", "data = json.load(f)\n        return data or {}") + '''
def validate_input(x):
    if x is None:
        raise ValueError("input too long")
    return x
'''
B1 = '''class Store:
    def save_record(self, r):
        self.rows.append(r)

    def delete_record(self, r):
        self.rows.remove(r)

def render_page(x):
    return "<p>" + x + "</p>"
'''
B2 = B1.replace('''    def delete_record(self, r):
        self.rows.remove(r)

''', "")
C1 = "def compute_total(xs):\n    return sum(x.price for x in xs)\n"
D1 = "def fmt(x):\n    return '%s' % x\n"
D2 = "def fmt(x):\n\n    return   '%s' % x\n"
E1 = "def helper(a, b):\n    return a or b\n"
V1 = {"a.py": A1, "b.py": B1, "c.py": C1, "d.py": D1, "e.py": E1}
V2 = {"a.py": A2, "b.py": B2, "utils.py": C1, "d.py": D2, "e.py": E1}
V3 = {**V2, "a.py": A1}


def listing(spark, files):
    df = spark.createDataFrame(list(files.items()), "file_path string, content string")
    return df.select("file_path", F.col("content").cast("binary").alias("content"), F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    ix = VersionedIndex(spark, str(tmp_path_factory.mktemp("store")))
    ix.stats = [ix.index_version(listing(spark, v), n) for n, v in (("v1", V1), ("v2", V2), ("v3", V3))]
    return ix


def test_counts(index):
    one, two, three = index.stats
    assert (one.files_total, one.files_parsed, one.counts["added"], one.texts_embedded) == (5, 5, 9, 9)
    assert two.counts == {"added": 1, "deleted": 1, "unchanged": 6, "modified": 1, "moved": 1}
    assert (two.files_changed, two.files_parsed, two.texts_embedded) == (5, 4, 2)
    assert three.counts["modified"] == 1 and three.counts["deleted"] == 1 and three.texts_embedded == 0


def test_ranges(index):
    closed = {(r["qualname"], r["version_added"], r["version_removed"]) for r in index.table("rows").where("seq_removed is not null").collect()}
    assert {("parse_config", "v1", "v2"), ("Store.delete_record", "v1", "v2"), ("compute_total", "v1", "v2")} <= closed
    assert index.valid_rows("v1").count() == 9
    with pytest.raises(KeyError):
        index.seq("v9")
    with pytest.raises(ValueError):
        index.range("v1", ("v1", "v2"))
    with pytest.raises(ValueError):
        index.range(between=("v2", "v1"))


def test_history(index):
    h = index.history("parse_config", with_diffs=True).collect()
    assert [r["change"] for r in h] == ["added", "modified", "reverted"]
    assert "+        return data or {}" in h[1]["diff"] and h[0]["diff"] is None
    assert [r["change"] for r in index.history("compute_total").orderBy("seq_added").collect()] == ["added", "moved"]


def test_search(index):
    top = index.search("save record", k=3).collect()
    assert top[0]["qualname"] == "Store.save_record"
    old = index.search("input too long", k=2, as_of="all").collect()
    assert old[0]["qualname"] == "validate_input" and old[0]["n_versions"] == 1
    many = index.search("parse config json", k=9, as_of="all").collect()
    assert len({r["lineage_id"] for r in many}) == len(many)
    assert all("showing" in index.describe_result(r.asDict()) for r in many)


def test_incremental_equals_fresh(spark, index, tmp_path):
    fresh = VersionedIndex(spark, str(tmp_path / "fresh"))
    fresh.index_version(listing(spark, V3), "only")
    assert equivalent(index, fresh)


def test_backfill_and_vacuum(spark, index, tmp_path):
    copy = index.copy_to(str(tmp_path / "copy"))
    want = {r["row_id"]: r["lineage_id"] for r in copy.table("rows").collect()}
    rows = copy.table("rows").withColumn("lineage_id", F.lit(None).cast("long"))
    copy._publish({"rows": rows})
    assert copy.backfill_lineage() == len(want)
    assert {r["row_id"]: r["lineage_id"] for r in copy.table("rows").collect()} == want
    assert copy.vacuum()["vectors_removed"] == 3
    with pytest.raises(ValueError):
        copy.search("x", as_of="v1")
    note = [r["diff_note"] for r in copy.history("parse_config", with_diffs=True).collect()]
    assert note[1].startswith("unavailable")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(v, p, c) for v, fs in (("v1", V1), ("v2", V2)) for p, c in fs.items()]
    spark.createDataFrame(rows, "version string, file_path string, content string").write.parquet(str(src))
    ix = VersionedIndex(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema("version string, file_path string, content string").parquet(str(src))
    index_stream(stream, ix, str(tmp_path / "cp")).awaitTermination(120)
    assert [r["version"] for r in ix.versions().collect()] == ["v1", "v2"]
