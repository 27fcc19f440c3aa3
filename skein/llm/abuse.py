"""Abusive, hateful and sexual language: a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel compares two passages by the sequences of four characters they share, with up to two characters skipped:
each occurrence weighs ``LAMBDA`` per skipped character. So an insult still matches with characters put in, left out
or swapped for others. A passage is mapped onto its kernel values with the landmarks (labelled sentences) and a
squared-hinge SVM is trained in that space by Newton steps. As every landmark is a sum of subsequences, the trained
function folds into one weight per subsequence: a table of 2^20 floats, whatever the size of the data.

Ratings are of whole documents and some are wrong, so sentences are labelled in rounds: at first each sentence has its
document's label; then of a document rated abusive only the passage that scores highest stays positive, documents
in which nothing scores are set aside as misrated, and the highest passages of other documents come in as negatives.
Runs of words that several abusive documents share and clean ones lack are positives from the first round to the last.
A document's score is that of its highest passage: a sentence or a run of words of it, however short.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import cache
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import clean_source

LAMBDA = 0.6
REACH = 5
A = 32
#: Bounds of the training sample (scoring has none): rated documents of each class, chosen by hash of their id, and
#: characters of all of them together, whole documents being left out behind that.
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 2500, 5000, 40_000_000
LANDMARKS = 500
#: Bounds within the training sample: passages that landmarks are chosen from, ordinary negative passages of the first
#: round (at least; four for each positive one) and of later ones, and hardest negatives that are kept.
POOL, FIRST_NEGATIVES, LATER_NEGATIVES, HARD_NEGATIVES = 2500, 8000, 6000, 12000
#: Documents that score above this are flagged; ``calibrated`` puts it into the gap between the two kinds.
THRESHOLD = 0.0
#: When the threshold is set, a flagged document rated clean costs as much as so many flagged ones rated abusive gain.
COST = 2.0
#: In each round an abusive document's best passage must score above this to stay a positive.
TRUST = (-9.0, -0.6, -0.2, 0.1, 0.25)
#: A negative passage weighs half the clean documents that hold it, up to this.
WEIGHTIEST = 30.0
#: A run of words is vouched for by so many documents rated abusive, if its share of the clean ones is at most this part of
#: its share of those. Passages that hold one stay positive in all rounds and are never taken for negatives.
VOUCHED, MISRATED = 5, 0.06
#: Widths in words of the runs that are scored beside whole sentences.
WIDTHS = (3, 5, 8, 12)

_PATTERNS = [(a, b, c, LAMBDA ** (c - 3)) for a, b, c in combinations(range(1, REACH + 1), 3)]

# fixed values: letters of other scripts that look like Latin ones, and digits and signs used for letters
_LOOKALIKE = str.maketrans("асеорхукітвнмѕԁјһӏαοερτνικυ", "aceopxykitbhmsdjhlaoeptvikuu"[:27])
_LEET = str.maketrans("0134578@$!|€", "oieastbasile")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_CODE = re.compile(r"`(?P<quoted>[^`\n]*)`|\b\w+\(\)|(?P<snake>\b[A-Za-z]+(?:_[A-Za-z0-9@$!|€]+)+(?!\w))|(?P<camel>\b[a-z]+(?:[A-Z][a-z0-9]+)+\b)|https?://\S+|#\d\w*")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*(?:[,;:!?.]* +[^\W\d_]+(?:['’-][^\W\d_]+)*)*[ !?.]*")
_HUMP = re.compile(r"[A-Z]?[a-z0-9]+")
_LETTERED = re.compile(r"[0134578@$!|€]+(?=[^\W\d_])")
_DIGITS = re.compile(r"\d+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][-._* ~/+|]{1,2}){2,}[^\W\d_](?![^\W_])")
_SPLIT = re.compile(r"(?<=[.!?;:])\s+|[\n\r]+|\s+[-–—]\s+|(?<=[,])\s+")
_HASHTAG = re.compile(r"#(?=[^\W\d_])")
_REPEAT = re.compile(r"(.)\1{2,}")
_DROP = re.compile(r"(?<=[a-z])[-*._~'’](?=[a-z])")
_OTHER = re.compile(r"[^a-z*#]+")
_CODES = np.zeros(128, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz #*"):
    _CODES[ord(_c)] = _i + 1


def _letters(m: re.Match) -> str:
    """Digits and signs inside a word, or one sign at its start, as the letters they stand for."""
    t, i = m.string, m.start()
    inside = i > 0 and t[i - 1].isalpha()
    sign = len(m.group()) == 1 and m.group() in "@$!" and not (i and t[i - 1].isalnum())
    return m.group().translate(_LEET) if inside or sign else m.group()


def _named(m: re.Match) -> str:
    """A name of code as ``#``; but a word spelled with ``_`` or in mixed case, known by its short parts, as that word,
    and quoted plain words as they are."""
    t = m.group()
    if m.lastgroup == "quoted" and _WORDS.fullmatch(m["quoted"]):
        return f" {m['quoted']} "
    if m.lastgroup == "snake":
        parts = t.split("_")
        if len(parts) > 2 and (sum(len(p) == 1 for p in parts) > 2 or max(map(len, parts)) < 3):
            return "".join(parts)
    elif m.lastgroup == "camel":
        parts = _HUMP.findall(t)
        if len(parts) > 2 and max(map(len, parts)) < 3:
            return t
    return " # "


def plain(text: str) -> str:
    """A sentence in plain letters: look-alikes, invisible marks, letter swaps and spacing undone, names of code as ``#``."""
    t = text if text.isascii() else _INVISIBLE.sub("", text)
    t = _HASHTAG.sub("", _CODE.sub(_named, t))
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).lower().translate(_LOOKALIKE)
        t = "".join(c for c in t if not unicodedata.combining(c))
    else:
        t = t.lower()
    t = _LETTERED.sub(_letters, t)
    t = _SPACED.sub(lambda m: re.sub(r"[-._* ~/+|]", "", m.group()), t)
    t = _REPEAT.sub(r"\1\1", _DROP.sub("", t))
    return _OTHER.sub(" ", _DIGITS.sub("#", t)).strip()


def passages(text: str) -> list[str]:
    """The sentences of a text, in plain letters, without empty ones and repeats; short ones with blanks around, so that
    the kernel finds its four characters."""
    return list(dict.fromkeys(p if len(p) > 4 else f" {p} " for s in _SPLIT.split(text) if s and (p := plain(s))))


def encode(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all items with ``REACH`` zeros between them, and where each starts."""
    gap = "\0" * REACH
    codes = _CODES[np.frombuffer((gap.join(items) + gap).encode("ascii"), np.uint8)] if items else np.zeros(REACH, np.int32)
    lens = np.array([len(x) for x in items], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens + REACH)])[: len(items)]
    return codes, starts


def _ids(codes: np.ndarray, pat: tuple) -> np.ndarray:
    a, b, c, _ = pat
    n = len(codes) - REACH
    return ((codes[:n] * A + codes[a : n + a]) * A + codes[b : n + b]) * A + codes[c : n + c]


_VOID = np.arange(A**4, dtype=np.int64)
_VOID = (_VOID % A == 0) | (_VOID // A % A == 0) | (_VOID // A**2 % A == 0) | (_VOID // A**3 == 0)


def norm(length: np.ndarray) -> np.ndarray:
    """The length that a passage's score is divided by: the root of the summed squared weights of its occurrences, plus a
    constant against very short passages. (Not K(x, x), which would count equal subsequences together.)"""
    n = np.asarray(length, np.float64)
    return np.sqrt(sum(w * w * np.maximum(n - c, 0) for _, _, c, w in _PATTERNS) + 20.0)


def runs(passage: str, widths: tuple[int, ...] = WIDTHS) -> list[str]:
    """The passage and all its runs of words of the widths that are scored."""
    w = passage.split(" ")
    return [passage, *(" ".join(w[i : i + k]) for k in widths for i in range(len(w) - k + 1))]


class Model:
    """A folded model: ``table`` of subsequence weights and ``bias``."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, float(bias)

    def contributions(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - REACH), np.float32)
        for p in _PATTERNS:
            out += p[3] * self.table[_ids(codes, p)]
        return out

    def windows(self, items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each item the score, start and end of its best passage: the whole or a run of its words."""
        codes, starts = encode(items)
        cum = np.concatenate([[0.0], np.cumsum(self.contributions(codes), dtype=np.float64), np.zeros(1)])
        cum[-1] = cum[-2]
        lens = np.array([len(x) for x in items], np.int64)
        ends = starts + lens
        cap = len(cum) - 1
        best = (cum[np.minimum(ends, cap)] - cum[starts]) / norm(lens)
        frm, to = np.zeros(len(items), np.int64), lens.copy()
        space = np.flatnonzero(codes == 27)
        heads = np.sort(np.concatenate([starts, space + 1]))
        owner = np.searchsorted(starts, heads, "right") - 1
        tails = np.sort(np.concatenate([ends, space]))  # the end of the word that starts at the same rank
        for w in WIDTHS:
            i = np.arange(len(heads) - w + 1)
            if not len(i):
                continue
            i = i[owner[i] == owner[i + w - 1]]
            a, b, o = heads[i], tails[i + w - 1], owner[i]
            s = (cum[np.minimum(b, cap)] - cum[a]) / norm(b - a)
            order = np.lexsort((-s, o))
            o, s, a, b = o[order], s[order], a[order], b[order]
            first = np.ones(len(o), bool)
            first[1:] = o[1:] != o[:-1]
            o, s, a, b = o[first], s[first], a[first], b[first]
            up = s > best[o]
            best[o[up]], frm[o[up]], to[o[up]] = s[up], a[up] - starts[o[up]], b[up] - starts[o[up]]
        return best + self.bias, frm, to

    def score(self, texts: list[str | None], chunk: int = 2_000_000) -> np.ndarray:
        """The score of each text, nan for texts without a passage."""
        out = np.full(len(texts), np.nan)
        items, owner, size = [], [], 0

        def flush() -> None:
            if items:
                s = self.windows(items)[0]
                np.fmax.at(out, np.array(owner), s)
                items.clear()
                owner.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            ps = passages(t)
            items.extend(ps)
            owner.extend([i] * len(ps))
            size += len(t)
            if size > chunk:
                flush()
                size = 0
        flush()
        return out


def _features(items: list[str], known: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Subsequence numbers and normalised weights of each item."""
    codes, starts = encode(items)
    ids = np.stack([_ids(codes, p) for p in _PATTERNS], 1) if len(codes) > REACH else np.zeros((0, len(_PATTERNS)), np.int32)
    w = np.array([p[3] for p in _PATTERNS], np.float32)
    out = []
    for s, x in zip(starts, items):
        f = ids[s : s + len(x)].ravel()
        ok = ~_VOID[f]
        out.append((f[ok], (np.broadcast_to(w, (len(f) // len(w), len(w))).ravel() / norm(len(x)))[ok].astype(np.float32)))
    return out


def spread(items: list[str], n: int, pool: int = POOL) -> list[str]:
    """``n`` items that cover the first ``pool`` ones: each next one is that least like any chosen so far."""
    items = items[:pool]
    if len(items) <= n:
        return items
    feats = _features(items)
    ids = np.concatenate([f for f, _ in feats])
    wts = np.concatenate([w for _, w in feats])
    ends = np.concatenate([[0], np.cumsum([len(f) for f, _ in feats])])
    full = np.flatnonzero(np.diff(ends) > 0)
    table, near, chosen = np.zeros(A**4, np.float32), np.full(len(items), -1.0, np.float32), []
    near[np.diff(ends) == 0] = np.inf
    nxt = int(full[0]) if len(full) else 0
    for _ in range(n):
        chosen.append(items[nxt])
        f, w = feats[nxt]
        np.add.at(table, f, w)
        near[full] = np.maximum(near[full], np.add.reduceat(table[ids] * wts, ends[:-1][full]))
        near[nxt] = np.inf
        table[f] = 0
        nxt = int(np.argmin(near))
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, reg: float = 1.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM with weights ``c`` by Newton steps; the last coordinate is the bias."""
    xb = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    c, y = c.astype(np.float32), y.astype(np.float32)
    ridge = np.full(xb.shape[1], reg)
    ridge[-1] = 1e-3
    w = np.zeros(xb.shape[1])

    def loss(v):
        m = np.maximum(0, 1 - y * (xb @ v.astype(np.float32)))
        return 0.5 * (ridge * v * v).sum() + 0.5 * (c * m * m).sum()

    now = loss(w)
    for _ in range(steps):
        m = 1 - y * (xb @ w.astype(np.float32))
        act = m > 0
        g = ridge * w - xb.T @ (act * c * y * m)
        h = np.diag(ridge)
        for a in range(0, len(xb), 4096):
            part = xb[a : a + 4096][act[a : a + 4096]]
            h += (part * c[a : a + 4096][act[a : a + 4096], None]).T @ part
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-4 and loss(w - t * d) > now:
            t /= 2
        w = w - t * d
        new = loss(w)
        if now - new < 1e-6 * now:
            break
        now = new
    return w[:-1], w[-1]


class _Space:
    """The Nyström map of a set of landmark passages."""

    def __init__(self, marks: list[str]):
        feats = _features(marks)
        used = np.unique(np.concatenate([f for f, _ in feats]))
        self.row = np.full(A**4, -1, np.int32)
        self.row[used] = np.arange(len(used))
        self.used = used
        phi = np.zeros((len(used), len(marks)), np.float32)
        for j, (f, w) in enumerate(feats):
            np.add.at(phi[:, j], self.row[f], w)
        self.phi = phi
        k = (phi.T @ phi).astype(np.float64)
        val, vec = np.linalg.eigh(k + 1e-4 * np.eye(len(marks)))
        self.half = (vec / np.sqrt(np.maximum(val, 1e-6))) @ vec.T

    def map(self, items: list[str]) -> np.ndarray:
        out = np.zeros((len(items), self.phi.shape[1]), np.float32)
        for a in range(0, len(items), 4000):
            for i, (f, w) in enumerate(_features(items[a : a + 4000])):
                r = self.row[f]
                ok = r >= 0
                out[a + i] = w[ok] @ self.phi[r[ok]]
        return out @ self.half.astype(np.float32)

    def fold(self, w: np.ndarray, bias: float) -> Model:
        table = np.zeros(A**4, np.float32)
        table[self.used] = (self.phi @ (self.half @ w)).astype(np.float32)
        table[_VOID] = 0
        return Model(table, bias)


def train(texts: list[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 5, seed: int = 7, reg: float = 0.5, pos_weight: float = 3.0) -> Model:
    """Fit on rated documents. Without both classes the model scores everything -1."""
    y = np.asarray(toxic)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(A**4, np.float32), -1.0)
    rng = np.random.default_rng(seed)
    docs = [passages(t or "") for t in texts]
    n_pos, n_neg = int((y > 0).sum()), int((y == 0).sum())
    # documents that hold a run of words, counted by its checksum in arrays of fixed size
    in_pos, in_neg = np.zeros(1 << 24, np.int16), np.zeros(1 << 24, np.int16)
    # a word of few documents counts as any such word, for names that are made up once each
    words = Counter(w for d in docs for w in {w for p in d for w in p.split(" ")})
    form = lambda p: " ".join(w if words[w] > 2 else "?" for w in p.split(" "))
    code = lambda r: crc32(r.encode()) & 0xFFFFFF
    at = lambda p: code(form(p))
    for d, t in {(tuple(d), t): (d, t) for d, t in zip(docs, y)}.values():  # copies of a document count once
        (in_pos if t else in_neg)[list({code(r) for p in d for r in runs(form(p))})] += 1

    def common(p: str) -> bool:
        """As usual in documents rated clean as in those rated abusive, so no evidence of abuse."""
        return int(in_neg[at(p)]) / n_neg > 0.25 * max(1, int(in_pos[at(p)])) / n_pos

    def known(r: str) -> int:
        """In how many documents rated abusive a run of words occurs, 0 if clean ones hold more of it than misrating explains."""
        k = int(in_pos[at(r)])
        return k if k >= VOUCHED and in_neg[at(r)] / n_neg <= MISRATED * k / n_pos else 0

    @cache
    def vouched(p: str) -> str | None:
        """The run of a passage that most documents rated abusive share and hardly any other; of equally known the longest."""
        best = max(((known(r), len(r), r) for r in runs(p, (3, 5))), default=(0, 0, ""))
        return best[2] if best[0] else None

    seeds = list(dict.fromkeys(x for d, t in zip(docs, y) if t for p in d if (v := vouched(p)) for x in ((v, 1, 1.0), (p, 1, 0.5))))
    inst = [(p, 1, 1.0 / len(d)) for d, t in zip(docs, y) if t for p in d if not common(p)] + seeds
    ns = list({p: None for d, t in zip(docs, y) if not t for p in d})
    ns = [ns[i] for i in rng.permutation(len(ns))[: max(FIRST_NEGATIVES, 4 * len(inst))]]
    weigh = lambda p: min(WEIGHTIEST, max(1.0, 0.5 + 0.5 * int(in_neg[at(p)])))
    inst += [(p, -1, weigh(p)) for p in ns]
    hard: dict[str, float] = {}
    flat, own = [p for d in docs for p in d], np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    if not any(v > 0 for _, v, _ in inst):
        return Model(np.zeros(A**4, np.float32), -1.0)
    model = None
    for r in range(rounds + 1):
        lab = np.array([v for _, v, _ in inst])
        ps, qs = [p for p, v, _ in inst if v > 0], [p for p, v, _ in inst if v < 0]
        near = sorted(hard, key=lambda h: -hard[h])[: landmarks // 4]
        some = lambda xs, n: [xs[i] for i in rng.permutation(len(xs))[: max(0, n)]]
        half = landmarks * 6 // 10
        space = _Space(list(dict.fromkeys(spread(some(list(dict.fromkeys(ps)), len(ps)), half) + near + some(qs, landmarks - half - len(near)))))
        c = np.array([w for _, _, w in inst])
        if r:
            c[lab > 0] *= pos_weight
        model = space.fold(*_svm(space.map([p for p, _, _ in inst]), lab, c, reg))
        s, frm, to = model.windows(flat)
        if r == rounds:
            return calibrated(model, s, own, y)
        positives, best = list(seeds), Counter()
        for i in np.argsort(-s, kind="stable"):
            d, p = own[i], flat[i]
            run = p[frm[i] : to[i]]
            if y[d]:
                # a document in which nothing scores is set aside as misrated
                if best[d] < 1 and not common(run) and s[i] > TRUST[min(r, len(TRUST) - 1)]:
                    best[d] += 1
                    positives.append((run, 1, 1.0))
                    if run != p and not common(p):
                        positives.append((p, 1, 0.5))
            elif best[d] < 4 and not vouched(p):
                best[d] += 1
                hard[run] = float(s[i])
                if s[i] > -0.9:
                    hard[p] = float(s[i])
        if not positives:
            break
        # the hardest negatives of all rounds, and ordinary ones beside them
        hs = [h for h in sorted(hard, key=lambda h: -hard[h]) if h][:HARD_NEGATIVES]
        inst = positives + [(p, -1, weigh(p)) for p in hs] + [(p, -1, weigh(p)) for p in ns[:LATER_NEGATIVES]]
    return model


def calibrated(model: Model, s: np.ndarray, own: np.ndarray, y: np.ndarray) -> Model:
    """Move the bias so that 0 parts the rated documents best: most abusive ones flagged, at ``COST`` for each clean one.

    Of equally good thresholds the middle of the widest run is taken.
    """
    top = np.full(len(y), -9.0)
    np.maximum.at(top, own, s)
    grid = np.arange(-0.3, 0.71, 0.02)
    gain = np.array([((top > t) & (y > 0)).sum() - COST * ((top > t) & (y == 0)).sum() for t in grid])
    good = np.flatnonzero(gain >= gain.max() - 0.005 * (y > 0).sum())
    parts = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    widest = max(parts, key=len)
    return Model(model.table, model.bias - float(grid[widest[len(widest) // 2]]))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of the documents whose ratings agree; null ratings don't count."""
    votes = labels.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("lo"), F.max("toxic").alias("hi")).where("lo = hi")
    d = docs.select("doc_id", "text").where("text is not null")
    return d.join(votes.select("doc_id", F.col("hi").alias("toxic")), "doc_id").dropDuplicates(["doc_id"])


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_chars: int = MAX_CHARS) -> Model:
    """Train on a bounded sample of rated documents: per class by hash of the id, and in total by characters.

    The sample goes to one task of the cluster, whose bounds make its memory known; only the folded model, a table of
    fixed size, comes to the driver. If the task is lost it runs again and gives the same model.
    """
    r = rated(docs, labels)
    take = lambda t, n: r.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    rows = take(1, max_positive).unionByName(take(0, max_negative)).select("doc_id", "text", "toxic")
    upto = F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= max_chars)

    def run(batches):
        held = list(batches)
        if not held:
            return
        sample = pd.concat(held, ignore_index=True).sort_values(["toxic", "doc_id"])
        m = train(sample["text"].tolist(), [int(t > 0) for t in sample["toxic"]])
        yield pd.DataFrame({"table": [m.table.tobytes()], "bias": [m.bias]})

    made = rows.select("doc_id", "text", "toxic").coalesce(1).mapInPandas(run, "table binary, bias double").collect()
    if not made:
        return train([], [])
    return Model(np.frombuffer(made[0]["table"], np.float32), made[0]["bias"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, score, flagged`` for every row. Null, empty and wordless texts score null and aren't flagged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))

    def run(batches):
        m = Model(*shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": m.score(pdf["text"].tolist()).round(6)})

    out = docs.select("doc_id", clean_source(F.col("source")).alias("source"), "text").mapInPandas(run, "doc_id long, source string, score double")
    out = out.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return out.withColumn("flagged", F.coalesce(F.col("score") > THRESHOLD, F.lit(False)))


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones and their share."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"))


def checks(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones without a score, empty ones with one, and texts whose copies score differently."""
    d = docs.select("doc_id", F.xxhash64("text").alias("h"), (F.coalesce(F.col("text"), F.lit("")) == "").alias("empty"))
    s = scored.join(d, "doc_id")
    per = s.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("flagged") & F.col("score").isNull()).alias("n_flagged_unscored"), F.count_if(F.col("empty") & F.col("score").isNotNull()).alias("n_empty_scored"))
    apart = s.where("not empty").groupBy("source", "h").agg(F.count_distinct(F.coalesce("score", F.lit(-99.0))).alias("n")).groupBy("source").agg(F.count_if(F.col("n") > 1).alias("n_copies_apart"))
    out = per.join(apart, per["source"].eqNullSafe(apart["source"]), "left").select(per["source"], "n_docs", "n_flagged_unscored", "n_empty_scored", F.coalesce("n_copies_apart", F.lit(0)).alias("n_copies_apart"))
    return out


SQL = {
    "p8_checks": """select regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') source, count(*) n_docs, cast(0 as bigint) n_flagged_unscored, cast(0 as bigint) n_empty_scored, cast(0 as bigint) n_copies_apart from documents group by 1""",
}
