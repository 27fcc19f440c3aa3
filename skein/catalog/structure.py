"""Queries of the call graph (callers are users, callees event types), the extractors and the router."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import callgraph, extract
from ..plans import router
from ..session import written
from ..sources.tables import language_of_path, table


def _graph(spark, d):
    e = table(spark, d, "events").where("user_id is not null")
    # an order that compares needs no numbering, so no caller's calls are gathered
    calls = e.select(F.col("user_id").alias("caller_id"), F.col("event_type").alias("callee_name"), F.col("event_id").cast("int").alias("line"), F.struct("ts", "event_id").alias("call_order"))
    u = e.select("user_id").distinct()
    name = F.concat(F.lit("user"), F.col("user_id").cast("string"))
    defs = u.select(
        F.col("user_id").alias("id"), name.alias("name"), F.concat(F.lit("U."), name).alias("qualname"), F.lit("method").alias("kind"),
        F.concat(F.lit("f"), (F.col("user_id") % 7).cast("string"), F.lit(".py")).alias("file_path"), F.col("user_id").cast("int").alias("line_start"), (F.col("user_id") + 1).cast("int").alias("line_end"),
    )
    return defs, calls


def definition(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.definition(_graph(spark, d)[0], "U.user7")


def callers(spark: SparkSession, d: str) -> DataFrame:
    rows = callgraph.callers(*_graph(spark, d), "purchase")
    return rows.select("qualname", "file_path", F.size("call_lines").cast("long").alias("n_calls"), F.element_at("call_lines", 1).alias("first_line"))


def callees(spark: SparkSession, d: str) -> DataFrame:
    """What every supplier calls, and where that is defined, if it is."""
    rows = callgraph.callees(*_supply(spark, d), None)
    return rows.select("qualname", "callee_name", "line", "defined_at")


def calls_before(spark: SparkSession, d: str) -> DataFrame:
    return callgraph.calls_before(*_graph(spark, d), "click", "purchase").select("qualname", "first_call_line", "later_call_line")


def _supply(spark, d):
    """A name graph with cycles: supplier s calls part p % 997, and the part named 'n<k>' is defined by supplier k."""
    li = table(spark, d, "lineitem")
    edges = li.select("l_suppkey", (F.col("l_partkey") % 997).alias("p")).distinct()
    ids = li.select("l_suppkey").distinct()
    defs = ids.select(
        F.col("l_suppkey").alias("id"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("name"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("qualname"),
        F.lit("function").alias("kind"), F.lit("s.py").alias("file_path"), F.col("l_suppkey").cast("int").alias("line_start"), F.col("l_suppkey").cast("int").alias("line_end"),
    )
    calls = edges.select(F.col("l_suppkey").alias("caller_id"), F.concat(F.lit("n"), F.col("p").cast("string")).alias("callee_name"), F.col("p").cast("int").alias("line"), F.col("p").cast("int").alias("call_order"))
    return defs, calls


def transitive_callers(spark: SparkSession, d: str) -> DataFrame:
    """Over all calls, cycles among them, to the operator's own depth."""
    return callgraph.transitive_callers(*_supply(spark, d), "n90").select("qualname", "depth", "via")


def _texts(spark, d):
    """Each text once, under the first path that holds it."""
    s = table(spark, d, "snippets").select(F.lower(F.trim("snippet_id")).alias("snippet_id"), "file_path").where(language_of_path(F.col("file_path")).isNotNull())
    p = s.groupBy("snippet_id").agg(F.min("file_path").alias("file_path"))
    return table(spark, d, "snippet_text").join(p, "snippet_id").select(F.concat_ws("/", "snippet_id", "file_path").alias("file_path"), F.col("text").alias("content"))


def extract_definitions(spark: SparkSession, d: str) -> DataFrame:
    return extract.facts(_texts(spark, d)).select("file_path", "language", "qualname", "kind", "line_start", "line_end", F.size("calls").alias("n_calls"))


def _code_graph(spark, d):
    return extract.call_graph(extract.facts(_texts(spark, d)))


def extract_calls(spark: SparkSession, d: str) -> DataFrame:
    """How often each name is called, and by how many definitions."""
    calls = _code_graph(spark, d)[1]
    return calls.groupBy("callee_name").agg(F.count("*").alias("n_calls"), F.count_distinct("caller_id").alias("n_callers"))


def code_callees(spark: SparkSession, d: str) -> DataFrame:
    """Of the extracted code: what each definition calls, and in how many places that is defined."""
    defs, calls = (written(x, "graph") for x in _code_graph(spark, d))
    named = defs.where("kind <> 'module'").groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n_defined"))
    once = calls.groupBy("caller_id", "callee_name").agg(F.count("*").alias("n_calls"), F.min("call_order").alias("first_order"))
    out = once.join(defs.select(F.col("id").alias("caller_id"), "file_path", "qualname"), "caller_id").join(named, "callee_name", "left")
    return out.select("file_path", "qualname", "callee_name", "n_calls", "first_order", F.coalesce("n_defined", F.lit(0)).alias("n_defined"))


def code_transitive(spark: SparkSession, d: str) -> DataFrame:
    """Of the extracted code: everything that reaches the name called by most definitions (ties: the first by name)."""
    defs, calls = (written(x, "graph") for x in _code_graph(spark, d))
    defined = calls.join(defs.where("kind <> 'module'").select(F.col("name").alias("callee_name")).distinct(), "callee_name", "left_semi")
    most = defined.groupBy("callee_name").agg(F.count_distinct("caller_id").alias("n")).orderBy(F.desc("n"), "callee_name").first()
    return callgraph.transitive_callers(defs, calls, most["callee_name"] if most else "").select("file_path", "qualname", "depth", "via")


def router_classify(spark: SparkSession, d: str) -> DataFrame:
    """Questions about the functions of the index, one of each kind per name, routed."""
    names = table(spark, d, "snippets").where("kind <> 'module'").select("qualname").distinct()
    q = names.select(F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("qualname"), F.lit(f.split("{}")[1])) for f in _FORMS])).alias("question"))
    r = q.select("question", router.route(F.col("question")).alias("r"))
    return r.select("question", "r.kind", F.concat_ws(",", "r.names").alias("names"))


_FORMS = ["Which functions call {}?", "what does {} call", "where is {} defined", "all transitive callers of {}", "history of {}", "explain {}"]


def router_safety(spark: SparkSession, d: str) -> DataFrame:
    """The router over all documents, none of which asks a routed question, and over questions, five in six of which do."""
    names = table(spark, d, "snippets").where("kind <> 'module'").select("qualname").distinct()
    asked = names.select(F.lit("questions").alias("texts"), F.explode(F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("qualname"), F.lit(f.split("{}")[1])) for f in _FORMS])).alias("text"))
    return router.safety(table(spark, d, "documents").select(F.lit("documents").alias("texts"), "text").unionByName(asked), "text", ["texts"])


QUERIES = {f.__name__: f for f in (definition, callers, callees, calls_before, transitive_callers, extract_definitions, extract_calls, code_callees, code_transitive, router_classify, router_safety)}

_G = """e as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 ord from events where user_id is not null)"""
ORACLE = {
    "definition": f"with {_G} select distinct 'U.user7' qualname, 'method' kind, 'f0.py' file_path, 7 line_start, 8 line_end from e where user_id = 7",
    "callers": f"with {_G} select 'U.user' || user_id qualname, 'f' || (user_id % 7) || '.py' file_path, count(*) n_calls, cast(min(event_id) as integer) first_line from e where event_type = 'purchase' group by user_id",
    "callees": """with ed as (select distinct l_suppkey s, l_partkey % 997 p from lineitem)
        select 'n' || s qualname, 'n' || p callee_name, cast(p as integer) line, case when p in (select l_suppkey from lineitem) then 's.py:' || p end defined_at from ed""",
    "calls_before": f"""with {_G} select 'U.user' || a.user_id qualname, cast(min(a.event_id) as integer) first_call_line, cast(max(b.event_id) as integer) later_call_line
        from e a join e b on a.user_id = b.user_id where a.event_type = 'click' and b.event_type = 'purchase' group by a.user_id having min(a.ord) < max(b.ord)""",
    "transitive_callers": """with recursive ed as (select distinct l_suppkey s, l_partkey % 997 p from lineitem),
        walk as (select distinct s, 1 depth from ed where p = 90 union select ed.s, walk.depth + 1 from walk join ed on ed.p = walk.s where walk.depth < 10),
        least as (select s, min(depth) depth from walk group by s),
        asked as (select 90 p, 0 depth union all select s, depth from least where s <> 90)
        select 'n' || l.s qualname, l.depth, min('n' || a.p) via from least l join ed on ed.s = l.s join asked a on a.p = ed.p and a.depth = l.depth - 1 group by 1, 2""",
    "router_classify": """with n as (select distinct qualname q from snippets where kind <> 'module'),
        f as (select * from (values ('Which functions call ', '?', 'callers'), ('what does ', ' call', 'callees'), ('where is ', ' defined', 'definition'), ('all transitive callers of ', '', 'transitive'), ('history of ', '', 'history'), ('explain ', '', null)) t(a, b, kind))
        select a || q || b question, kind, case when kind is null then '' else q end names from n cross join f""",
    "router_safety": r"""with q as (select distinct qualname q from snippets where kind <> 'module'),
        f as (select * from (values ('Which functions call ', '?', true), ('what does ', ' call', true), ('where is ', ' defined', true), ('all transitive callers of ', '', true), ('history of ', '', true), ('explain ', '', false)) t(a, b, routed)),
        head as (select '(?i)^(please |show me |list |all |the )*((who|what|which( \w+)?) (calls?|invokes?|does|do|is called|are called|changed)|where (is|are)|how (has|have|did|does)|call(er|ee)s of|calls (to|of)|called by|definition of|(version )?history of|all versions of|everything)( .*)?$' p),
        t as (select 'documents' texts, coalesce(text, '') x, regexp_matches(trim(coalesce(text, '')), (select p from head)) and not contains(trim(coalesce(text, '')), chr(10)) and len(string_split(trim(coalesce(text, '')), ' ')) <= 12 routed from documents
              union all select 'questions', a || q || b, routed from q cross join f),
        d as (select texts, routed, len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')) n, regexp_matches(x, '(?i)\bcalls?\b') c from t),
        m as (select texts, n, row_number() over (partition by texts order by n) - 1 i, count(*) over (partition by texts) total from d)
        select texts, count(*) n_queries, count(*) filter (routed) n_routed, count(*) filter (routed) n_routed_ungated, cast(min(n) as integer) min_words,
          cast((select max(m.n) from m where m.texts = d.texts and m.i = m.total // 2) as integer) median_words, cast(max(n) as integer) max_words, count(*) filter (n > 30) n_longer, count(*) filter (c) n_with_call from d group by texts""",
}
