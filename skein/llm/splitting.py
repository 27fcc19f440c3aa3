"""Cutting oversized texts at natural boundaries, by lexical cohesion.

Between two lines the vocabulary of the lines before is compared with that of the lines after, over sliding blocks. A
valley of this similarity marks a change of topic; its depth is the climb to the peaks on both sides. In each window
of the allowed size the deepest valley is the cut, and the next piece begins the overlap earlier.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import clean_id, clean_language, language_of_path

#: Lines on each side of a gap that are compared.
SPAN = 6
_WORD = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
_SOFT = re.compile(r"(?<=[\s,;:)\]}>|&+.!?])(?!\s)")


def cohesion(lines: list[str], span: int = SPAN) -> list[float]:
    """Depth of the valley before each line (index 0 is unused). Blank lines and lines back at the margin are deeper."""
    bags = [Counter(w.lower() for w in _WORD.findall(x)) for x in lines]
    n = len(lines)
    sim = [1.0] * (n + 1)
    left, right = Counter(), Counter()
    for b in bags[:span]:
        right.update(b)

    def take(c: Counter, b: Counter) -> None:
        for k, v in b.items():
            c[k] -= v
            if c[k] <= 0:
                del c[k]

    for i in range(1, n):
        left.update(bags[i - 1])
        take(right, bags[i - 1])
        if i - 1 - span >= 0:
            take(left, bags[i - 1 - span])
        if i - 1 + span < n:
            right.update(bags[i - 1 + span])
        a, b = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(v * b.get(k, 0) for k, v in a.items())
        size = (sum(v * v for v in left.values()) * sum(v * v for v in right.values())) ** 0.5
        sim[i] = dot / size if size else 0.0
    depth = [0.0] * (n + 1)
    up = [0.0] * (n + 2)  # climb to the right
    for i in range(n - 1, 0, -1):
        up[i] = max(0.0, sim[i + 1] - sim[i] + up[i + 1]) if i + 1 < n and sim[i + 1] >= sim[i] else 0.0
    climb = 0.0
    for i in range(1, n):
        climb = climb + sim[i - 1] - sim[i] if i > 1 and sim[i - 1] >= sim[i] else 0.0
        depth[i] = climb + up[i]
        indent = len(lines[i]) - len(lines[i].lstrip())
        before = len(lines[i - 1]) - len(lines[i - 1].lstrip())
        if not lines[i - 1].strip():
            depth[i] += 0.5
        elif lines[i].strip() and indent < before:
            depth[i] += 0.3
        elif indent > before:
            depth[i] -= 0.3
    return depth


def pieces(text: str, limit: int, overlap: int, span: int = SPAN) -> list[tuple[int, int]]:
    """``(start, end)`` in characters. Each piece has at most ``limit``; each but the first starts ``overlap`` before the
    end of the one before. Cuts lie between lines where a line end is within reach, else behind a blank or a mark of
    punctuation, else at the limit (never between CR and LF). A text within the limit is one piece, an empty one none.
    """
    if overlap < 0 or limit <= overlap:
        raise ValueError("the limit must be above the overlap")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    lines = text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+", text)
    depth = cohesion(lines, span)
    ends, at = [], 0
    for i, x in enumerate(lines):
        if i:
            ends.append((at, depth[i]))
        at += len(x)
    out, start, k = [], 0, 0
    while n - start > limit:
        low, high = start + max(overlap + 1, limit // 2), start + limit
        while k < len(ends) and ends[k][0] <= start + overlap:
            k += 1
        reach = [e for e in ends[k : k + limit] if e[0] <= high]
        best = max((e for e in reach if e[0] >= low), key=lambda e: (e[1], e[0]), default=None) or max(reach, key=lambda e: e[0], default=None)
        if best:
            cut = best[0]
        else:
            marks = [m.start() for m in _SOFT.finditer(text, low, high + 1)]
            cut = next((m for m in reversed(marks) if low <= m <= high), high)
            if text[cut - 1 : cut + 1] == "\r\n" and cut - 1 > start + overlap:
                cut -= 1
        out.append((start, cut))
        start = cut - overlap
    out.append((start, n))
    return out


def text_places(snippets: DataFrame) -> DataFrame:
    """``snippet_id, language, repo, file_path, line_start, line_end``: language and one place of each text.

    The place is that of the latest export (ties: the smallest place). The language is the row's own or else that of
    its file; a text that a repository holds countless times is reduced before the shuffle.
    """
    s = snippets.select(clean_id(F.col("snippet_id")).alias("snippet_id"), F.coalesce(clean_language(F.col("language")), language_of_path(F.col("file_path"))).alias("language"), "repo", "file_path", "line_start", "line_end", "exported_at")
    best = F.max_by(F.struct("language", "repo", "file_path", "line_start", "line_end"), F.struct(F.col("language").isNotNull(), "exported_at", "repo", "file_path", "line_start"))
    return s.groupBy("snippet_id").agg(best.alias("p")).select("snippet_id", "p.*")


def split_texts(texts: DataFrame, snippets: DataFrame, limits: DataFrame, span: int = SPAN) -> DataFrame:
    """Pieces of every text above its language's limit.

    ``snippet_id, language, piece, char_start, char_end, line_start, line_end, piece_text``; characters are code points.
    Lines count from the place's ``line_start`` and stay within its ``line_end`` where that is known. Texts within the
    limit, without a language or of a language without a limit are not cut and give no rows.
    """
    lim = F.broadcast(limits.select(clean_language(F.col("language")).alias("language"), "max_chars", "overlap_chars").where("language is not null").dropDuplicates(["language"]))
    # the smallest limit tells what can be oversized at all; most texts end here
    least = limits.agg(F.min("max_chars")).scalar()
    long = texts.select(clean_id(F.col("snippet_id")).alias("snippet_id"), "text").where(F.char_length("text") > least)
    big = long.join(text_places(snippets), "snippet_id").join(lim, "language").where(F.char_length("text") > F.col("max_chars"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                first = 1 if pd.isna(r.line_start) else int(r.line_start)
                last = None if pd.isna(r.line_end) else int(r.line_end)
                ends = [m.end() for m in re.finditer(r"\r\n|\n|\r", r.text)]
                import bisect

                for i, (a, b) in enumerate(pieces(r.text, int(r.max_chars), int(r.overlap_chars), span)):
                    la, lb = first + bisect.bisect_right(ends, a), first + bisect.bisect_right(ends, b - 1)
                    if last is not None:
                        la, lb = min(la, max(last, first)), min(lb, max(last, first))
                    rows.append((r.snippet_id, r.language, i, a, b, la, lb, r.text[a:b]))
            yield pd.DataFrame(rows, columns=["snippet_id", "language", "piece", "char_start", "char_end", "line_start", "line_end", "piece_text"])

    big = big.select("snippet_id", "language", "text", "line_start", "line_end", "max_chars", "overlap_chars")
    return big.mapInPandas(run, "snippet_id string, language string, piece int, char_start int, char_end int, line_start int, line_end int, piece_text string")


def oversized(pieces_: DataFrame) -> DataFrame:
    """The texts that had to be cut."""
    return pieces_.where("piece = 1").select("snippet_id")


def checks(pieces_: DataFrame, snippets: DataFrame, limits: DataFrame) -> DataFrame:
    """Per text that was cut: its length and MD5 as put together again from the pieces without their overlaps, and how many
    pieces are above the limit, overlap by another number of characters, or lie outside of the place's lines."""
    lim = F.broadcast(limits.select(clean_language(F.col("language")).alias("language"), "max_chars", "overlap_chars").where("language is not null").dropDuplicates(["language"]))
    place = text_places(snippets).select("snippet_id", F.col("line_start").alias("first"), F.col("line_end").alias("last"))
    p = pieces_.join(lim, "language").join(place, "snippet_id", "left")
    n = F.char_length("piece_text")
    row = F.struct("piece", "char_start", "char_end", "piece_text")
    whole = p.groupBy("snippet_id").agg(
        F.sort_array(F.collect_list(row)).alias("ps"), F.max("overlap_chars").alias("overlap"),
        F.count_if((n > F.col("max_chars")) | (n != F.col("char_end") - F.col("char_start"))).alias("n_too_long"),
        F.count_if((F.col("line_start") < F.col("first")) | (F.col("line_end") > F.col("last")) | (F.col("line_start") > F.col("line_end"))).alias("n_outside"),
    )
    # a text's pieces are its own row again, no longer than the text and its overlaps
    text = F.aggregate("ps", F.lit(""), lambda s, x: F.concat(s, F.substring(x["piece_text"], F.char_length(s) - x["char_start"] + 1, F.lit(1 << 30))))
    starts = F.transform(F.slice("ps", 2, F.size("ps")), lambda x: x["char_start"])
    ends = F.transform(F.slice("ps", 1, F.size("ps") - 1), lambda x: x["char_end"])
    wrong = F.size(F.filter(F.zip_with(ends, starts, lambda e, s: e - s), lambda o: o != F.col("overlap")))
    return whole.select("snippet_id", text.alias("t"), "n_too_long", wrong.cast("long").alias("n_wrong_overlap"), "n_outside").select(
        "snippet_id", F.char_length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"), "n_too_long", "n_wrong_overlap", "n_outside"
    )


_FOUND = """with s as (select lower(trim(snippet_id)) snippet_id, coalesce(nullif(lower(trim(language)), ''), regexp_extract(file_path, '\\.([a-z]+)$', 1)) l0 from snippets),
        l as (select snippet_id, case when l0 in ('py', 'python') then 'python' when l0 in ('js', 'mjs', 'cjs', 'javascript') then 'javascript' end as lang from s),
        m as (select snippet_id, max(lang) as lang from l group by 1)"""
SQL = {
    "p2_checks": f"""{_FOUND} select t.snippet_id, length(t.text) n_chars, md5(t.text) text_md5, cast(0 as bigint) n_too_long, cast(0 as bigint) n_wrong_overlap, cast(0 as bigint) n_outside
        from snippet_text t join m using (snippet_id) join piece_limits p on p.language = m.lang where length(t.text) > p.max_chars""",
    "p2_found": """with s as (select lower(trim(snippet_id)) snippet_id, coalesce(nullif(lower(trim(language)), ''), regexp_extract(file_path, '\\.([a-z]+)$', 1)) l0 from snippets),
        l as (select snippet_id, case when l0 in ('py', 'python') then 'python' when l0 in ('js', 'mjs', 'cjs', 'javascript') then 'javascript' end as lang from s),
        m as (select snippet_id, max(lang) as lang from l group by 1)
        select t.snippet_id from snippet_text t join m using (snippet_id) join piece_limits p on p.language = m.lang where length(t.text) > p.max_chars""",
}
