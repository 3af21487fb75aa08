"""Records that break off (p8).

Labels are made, not given: all values are cut artificially, by a length limit and anywhere, bare or with white space or
a mark after the cut; the values as they stand are the negatives, but for those that end at their source's limit, which
are left out. A logistic regression over hashed features of the closing characters, punctuation, last line and
length-to-limit is trained on both. Values that a model trained on the other folds takes for cut are taken from the
negatives, and it is trained again. Every record trains and is scored. The prior of the cut class is fitted to the scores
out of fold, apart for values that end at a limit.

Each step of the training adds up its gradients over all rows: up to ``driver_rows`` rows on the driver, beyond in Spark,
where only sums of a fixed size come back, at most ``TASKS`` a step.

Limits are found over all documents: the length that most of a source's distinct texts share, if at least ``spike`` do,
and every other length that stands out against its neighbours, once trailing white space and marks are gone (copies of
one text count once). Values without a source may come from any: they are held against the limits of all sources.

Defined cases: null texts are no records of this question and come out with a null score; empty texts and texts of
white space count as intact; sources are compared as they stand, null being a source of its own; repeated rows are
scored alike; only the last ``TAIL`` characters and the length are looked at, since that is where a cut shows.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioquarry.plans.runtime import cut, small

TAIL, BITS, FOLDS = 240, 15, 3
#: Sums that come to the driver in a step at most, rows a gradient takes at once, bins of logits (``1 / FINE`` wide, up to ``WIDE`` either way).
TASKS, SLAB, FINE, WIDE = 64, 4096, 256, 40
#: Marks that systems set after a cut.
MARKS = ("...", "..", "…", "[more]", "[...]", "[…]", "[truncated]", "[cut]", "[continued]", "(more)", "(cont'd)", "(cont'd", "(continued)", "(continued", ">>>")
_MARK = r"(\s*(\.{2,}|…|\[(more|\.\.\.|…|truncated|cut|continued)\]?|\((more|cont'd|continued)\)?|>>>))?\s*$"
_MARK_RE = re.compile(_MARK)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_STOP = re.compile(r"[.!?…:;][\"')\]»”]?(?=\s|$)")


def _shape(s: str) -> str:
    out = []
    for c in s:
        k = "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "_" if c.isspace() else c
        out.append(k)
    return "".join(out)


def _short(shape: str) -> str:
    return re.sub(r"(.)\1+", r"\1", shape)


def _log(n: int) -> int:
    return int(n).bit_length()


def at_limit(tail: str, length: int, extra: int, limit: int) -> bool:
    """Whether a value of ``length`` characters and ``length + extra`` bytes ends where the limit would cut it, in either unit."""
    mark = len(_MARK_RE.search(tail).group())
    return bool(limit) and any(n >= limit and limit - 3 <= n - mark <= limit or n < limit and limit - 3 <= n and extra > 0 for n in (length, length + extra))


def limit_of(tail: str, length: int, extra: int, limits) -> int:
    """The limit among ``limits`` at which the value ends; where it ends at none the first of them, and 0 without any."""
    return next((int(k) for k in limits if at_limit(tail, length, extra, int(k))), int(limits[0]) if len(limits) else 0)


def features(tail: str, length: int, extra: int, source: str, limit: int) -> list[int]:
    """Hashed features of a value's last characters, its length (``extra``: bytes beyond characters) and its source's limit (0: none)."""
    at = _MARK_RE.search(tail).start()
    core, mark = tail[:at], tail[at:]
    cut_here = at_limit(tail, length, extra, limit)
    lines = core.rsplit("\n", 1)
    last = lines[-1].strip()
    whole = len(lines) > 1 or length <= TAIL
    quoted = last[:1] in (">", "|")
    body = last.lstrip(">| \t")
    before = lines[0].rstrip() if len(lines) > 1 else ""
    gap = len(lines) > 1 and lines[0].rstrip(" \t>|").endswith("\n")
    words = _WORD.findall(body[-120:])
    end = core[-1:] if not core[-1:].isalnum() else _shape(core[-1:])
    prev = before[-1:] if not before[-1:].isalnum() else _shape(before[-1:])
    w1 = words[-1].lower() if words else ""
    w2 = words[-2].lower() if len(words) > 1 else ""
    first = words[0].lower() if words and whole else "?"
    stops = [m.end() for m in _STOP.finditer(body)]
    since = len(body) - stops[-1] if stops else len(body) if whole else 999
    count = min(len(words), 15) if whole else 20
    lead = _short(_shape(body[:24]))[:7] if whole else "?"
    kind = mark.strip()
    tag = "L" if cut_here else "l"
    shape = _short(_shape(body))[-7:]
    out = [
        f"e{end}", f"t{tag}", f"te{tag}{end}", f"k{kind}", f"ke{kind}{end}{tag}", f"kw{bool(kind)}{w1}", f"b{mark[:1].isspace()}{end}",
        f"s4{_shape(core[-4:])}", f"s8{_short(_shape(core[-8:]))}", f"w{w1}|{end}", f"ww{w2}|{w1}", f"x3{core[-3:].lower()}", f"x4{core[-4:].lower()}", f"x5{core[-5:].lower()}",
        f"n{count}{end}", f"f{first}{count // 4}", f"fe{first}{end}", f"ld{lead}{end}", f"sh{shape}", f"shn{shape}{min(count, 8)}", f"p{prev}{gap}", f"pe{prev}{end}{min(count, 6)}{lead[:1]}",
        f"d{_log(since)}{end}", f"ds{since == 0}{quoted}", f"ln{_log(len(body)) if whole else 99}{end}", f"src{source}{end}", f"st{source}{tag}", f"q{quoted}{end}", f"wl{len(w1)}{end}", f"up{w1 and words[-1][0].isupper()}{w2 and words[-2][0].isupper()}{min(count, 6)}",
        f"all{prev}{lead[:2]}{min(count, 8)}{end}", f"ff{first}{words[1].lower() if len(words) > 1 else ''}{end}", f"fc{first}{min(count, 6)}",
    ]
    return [xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in out]


N_FEATURES = len(features("a", 1, 0, "", 0))


def cut_variants(text: str, limit: int, seed: int) -> list[tuple[str, int, int]]:
    """Artificially cut values of ``text``: one in transfer, one by a limit; (tail, length, limit)."""
    rng = np.random.default_rng(seed & 0xFFFFFFFF)
    n, out = len(text), []
    places = [int(rng.integers(max(10, n // 10), n - 3)) if n > 40 else 0, limit if 0 < limit < n - 1 else int(rng.integers(max(10, n // 3), n - 3)) if n > 40 else 0]
    for by_limit, p in enumerate(places):
        if p <= 0:
            continue
        head = text[:p]
        if re.search(r"[.!?…]\s*$", head):  # nothing shows there
            continue
        after = ("", "", "", "", " ", "\n", "\n\n", "...", "…", " [more]", " (cont'd)", "..", " ...", " [truncated]", "\ufffd", "\ufffd\n")[int(rng.integers(0, 16))]
        cut_value = head + after
        out.append((cut_value[-TAIL:], len(cut_value), p if by_limit else limit))
    return out


def find_limits(docs: DataFrame, spike: float = 0.03, least: int = 5) -> DataFrame:
    """``source_key``, ``limit``: over all documents, every stripped length of a source that is its most common one and shared
    by ``spike`` of its texts, or that stands out against the lengths around it; ``least`` texts share it.

    A length up to 3 below a limit that as many share belongs to that limit (``at_limit``). Only counts by length are sorted.
    """
    d = docs.select(F.coalesce("source", F.lit("")).alias("source_key"), "text").where("length(text) > 0")
    tail = F.expr(f"right(text, {TAIL})")
    core = F.length("text") - F.length(tail) + F.length(F.regexp_replace(tail, _MARK, ""))
    texts = d.select("source_key", core.alias("size"), F.xxhash64("text").alias("h")).groupBy("source_key", "size", "h").agg(F.lit(1).alias("one"))
    sizes = texts.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    source = Window.partitionBy("source_key")
    by = source.orderBy("size")
    # The mean of the lengths 4 to 28 away on both sides, those that exist; a chance count is hardly ever beyond the bound.
    around = F.sum("n").over(by.rangeBetween(-28, 28)) - F.sum("n").over(by.rangeBetween(-3, 3))
    mean = around / (25 + F.least(F.lit(25), F.greatest(F.lit(0), F.col("size") - 4)))
    stands = F.col("n") >= 3 * mean + 5 * F.sqrt(mean) + 2
    common = (F.col("size") == F.max(F.struct("n", "size")).over(source)["size"]) & (F.col("n") >= F.sum("n").over(source) * spike)
    found = sizes.withColumn("_f", stands | common).where(F.col("_f") & (F.col("n") >= least))
    found = found.withColumn("_above", F.max("n").over(by.rangeBetween(1, 3))).where("_above is null or _above < n")
    return found.select("source_key", F.col("size").cast("int").alias("limit"))


def limit_sets(limits: DataFrame) -> DataFrame:
    """``source_key``, ``limits`` of each source; the null source gets those of all."""
    every = limits.select(F.lit("").alias("source_key"), "limit")
    return limits.unionByName(every).groupBy("source_key").agg(F.sort_array(F.collect_set("limit"), asc=False).alias("limits"))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, shift: float = 0.0, limit_shift: float = 0.0):
        self.weights, self.bias, self.shift, self.limit_shift = weights, bias, shift, limit_shift

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].sum(1) + self.bias


#: Training rows: features, label (0 as it stands, 1 cut, 2 ends at a limit, 3 as it stands but taken for cut) and fold, in the order of fold and label.
Block = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> dict:
    order = np.lexsort((y, fold))
    return {"x": [x[order].astype(np.uint16).tobytes()], "y": [y[order].astype(np.int8).tobytes()], "f": [fold[order].astype(np.int8).tobytes()]}


def _block(r) -> Block:
    return np.frombuffer(r.x, np.uint16).reshape(-1, N_FEATURES), np.frombuffer(r.y, np.int8), np.frombuffer(r.f, np.int8)


class Rows:
    """All training rows in blocks, on the driver where they are ``driver_rows`` or fewer, else in Spark; sums differ by the order of their terms alone."""

    SCHEMA = "x binary, y binary, f binary"

    def __init__(self, data: DataFrame, driver_rows: int):
        self.data = cut(data)
        self.count = self.data.agg(F.sum(F.length("y"))).first()[0] or 0
        self.blocks = [_block(r) for r in self.data.collect()] if self.count <= driver_rows else None

    def total(self, f: Callable[..., np.ndarray]) -> np.ndarray:
        """The sum of the vectors ``f(x, y, fold)`` of all blocks."""
        if self.blocks is not None:
            return sum(f(*b) for b in self.blocks)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if not gc.get_freeze_count():
                gc.freeze()  # a worker collects garbage after each task: this spares it going through the modules each time
            s = None
            for pdf in batches:
                for r in pdf.itertuples():
                    v = f(*_block(r))
                    s = v if s is None else s + v
            if s is not None:
                yield pd.DataFrame({"s": [s.astype(np.float64).tobytes()]})

        tasks = min(TASKS, self.data.sparkSession.sparkContext.defaultParallelism)
        return sum(np.frombuffer(r.s) for r in self.data.coalesce(tasks).mapInPandas(run, "s binary").collect())

    def relabelled(self, f: Callable[..., np.ndarray]) -> None:
        """Labels become ``f(x, y, fold)``."""
        if self.blocks is not None:
            self.blocks = [_block(pd.DataFrame(_packed(x, f(x, y, fold), fold)).iloc[0]) for x, y, fold in self.blocks]
            return

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    x, y, fold = _block(r)
                    yield pd.DataFrame(_packed(x, f(x, y, fold), fold))

        self.data = cut(self.data.mapInPandas(run, self.SCHEMA))

    def tally(self) -> np.ndarray:
        """Rows by fold and label."""
        return self.total(lambda x, y, fold: np.bincount(fold.astype(np.intp) * 4 + y, minlength=4 * FOLDS)).reshape(FOLDS, 4)


def logits(models: list[Model], x: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The score of each row by its fold's model."""
    z = np.zeros(len(x))
    for i in range(0, len(x), SLAB):
        for k, m in enumerate(models):
            own = np.flatnonzero(fold[i : i + SLAB] == k) + i
            z[own] = m.logit(x[own].astype(np.intp))
    return z


def gradients(w: np.ndarray, b: np.ndarray, on: np.ndarray, share: np.ndarray) -> Callable[..., np.ndarray]:
    """Of the log loss of each model (a row of ``w``) over the rows of label 0 and 1 in its folds (``on``), weighted by class (``share``); the bias comes last."""

    def of(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), w.shape[1] + 1))
        key = fold.astype(np.intp) * 4 + y
        for k in range(FOLDS):
            lo, hi = np.searchsorted(key, (4 * k, 4 * k + 2))
            for i in range(lo, hi, SLAB):
                xs, ys = x[i : min(hi, i + SLAB)].astype(np.intp), y[i : min(hi, i + SLAB)]
                for j in np.flatnonzero(on[:, k]):
                    z = np.clip(w[j].take(xs).sum(1) + b[j], -30, 30)
                    g = (1 / (1 + np.exp(-z)) - ys) * share[j].take(ys)
                    out[j, :-1] += np.bincount(xs.ravel(), weights=np.repeat(g, xs.shape[1]), minlength=w.shape[1])
                    out[j, -1] += g.sum()
        return out.ravel()

    return of


def fit(rows: Rows, on: np.ndarray, l2: float = 1e-5, rounds: int = 120, rate: float = 0.08) -> list[Model]:
    """Adam on the mean log loss over all rows, both classes weighing half; model ``j`` learns from the folds ``on[j]``, if they have both."""
    counts = on.astype(float) @ rows.tally()[:, :2]
    on = on & (counts > 0).all(1, keepdims=True)
    share = 0.5 / np.maximum(1, counts)
    p = np.zeros((len(on), (1 << BITS) + 1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1 if on.any() else 1):
        grad = rows.total(gradients(p[:, :-1], p[:, -1], on, share)).reshape(p.shape)
        grad[:, :-1] += l2 * p[:, :-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return [Model(q[:-1], float(q[-1])) for q in p]


def prevalence_shift(logits: np.ndarray, n: np.ndarray) -> float:
    """Log-odds shift from equal classes to the prior that the scores themselves imply (EM); ``n`` records have each score."""
    if not n.sum():
        return 0.0
    share = 0.1
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(logits + np.log(share / (1 - share)), -30, 30)))
        share = float(np.clip(np.average(p, weights=n), 1e-3, 0.5))
    return float(np.log(share / (1 - share)))


def binned(z: np.ndarray) -> np.ndarray:
    """Sums and counts of logits by bin: all of them count, and a bin's mean stands for them."""
    z = np.clip(z, -WIDE, WIDE)
    at = np.rint((z + WIDE) * FINE).astype(np.intp)
    return np.concatenate([np.bincount(at, weights=z, minlength=2 * WIDE * FINE + 1), np.bincount(at, minlength=2 * WIDE * FINE + 1)])


def training_rows(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Blocks of rows of all documents with text: as they stand, and cut."""
    texts = docs.where("length(trim(text)) > 0")
    keep = texts.withColumn("source_key", F.coalesce("source", F.lit(""))).select("doc_id", "text", "source_key").join(small(limit_sets(limits)), "source_key", "left").select("doc_id", "text", "source_key", F.coalesce("limits", F.array().cast("array<int>")).alias("limits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys, folds = [], [], []
            for d, t, s, limits in zip(pdf["doc_id"], pdf["text"], pdf["source_key"], pdf["limits"]):
                extra, fold = len(t.encode("utf-8", "replace")) - len(t), xxhash.xxh32_intdigest(t[-60:].encode("utf-8", "replace")) % FOLDS  # copies share a fold
                limit = limit_of(t[-TAIL:], len(t), extra, limits)
                xs.append(features(t[-TAIL:], len(t), extra, s, limit))
                ys.append(2 if at_limit(t[-TAIL:], len(t), extra, limit) else 0)
                folds.append(fold)
                if _STOP.search(t.rstrip()[-3:]) is None and len(t) > 0 and t.rstrip()[-1:].isalnum():
                    continue  # it may itself be cut: no positives are made of it
                seed = (0 if d is None or d != d else int(d)) * 2654435761 + 7
                shorter = [int(k) for k in limits if k < len(t) - 1]  # each limit cuts its share of the longer values
                for tail, length, by in cut_variants(t, shorter[seed // 7 % len(shorter)] if shorter else limit, seed):
                    by = limit_of(tail, length, 0, limits)
                    xs.append(features(tail, length, 0, s, by))
                    ys.append(1)
                    folds.append(fold)
            yield pd.DataFrame(_packed(np.array(xs, dtype=np.int32).reshape(-1, N_FEATURES), np.array(ys, dtype=np.int8), np.array(folds, dtype=np.int8)))

    return keep.mapInPandas(run, Rows.SCHEMA)


def train(docs: DataFrame, limits: DataFrame, driver_rows: int = 50_000) -> Model:
    """Train on all documents; the rows of up to ``driver_rows`` are gathered, else only sums over them."""
    rows = Rows(training_rows(docs, limits), driver_rows)
    if not rows.count or not (rows.tally()[:, :2].sum(0) > 0).all():
        return Model(np.zeros(1 << BITS), -1.0)
    others = ~np.eye(FOLDS, dtype=bool)
    for _ in range(2):
        models = fit(rows, others)
        rows.relabelled(lambda x, y, fold, models=models: np.where((y == 1) | (y == 2), y, np.where(logits(models, x, fold) < 0, 0, 3)))
        if not rows.tally()[:, 0].any():
            rows.relabelled(lambda x, y, fold: np.where(y == 3, 0, y))
            break
    model = fit(rows, np.ones((1, FOLDS), dtype=bool))[0]
    own = [model] * FOLDS
    bins = rows.total(lambda x, y, fold: np.concatenate([binned(logits(ms, x[k], fold[k])) for ms, k in ((models, (y == 0) | (y == 3)), (own, y == 2))]))
    z, n, limit_z, limit_n = bins.reshape(4, -1)
    model.shift, model.limit_shift = prevalence_shift(z / np.maximum(1, n), n), prevalence_shift(limit_z / np.maximum(1, limit_n), limit_n)
    return model


def score(docs: DataFrame, limits: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``source``, ``truncated_score`` (null for null texts) of every record."""
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.expr(f"right(text, {TAIL})").alias("_tail"), F.length("text").alias("_n"), (F.octet_length("text") - F.length("text")).alias("_x"), F.coalesce("source", F.lit("")).alias("source_key"))
    d = d.join(small(limit_sets(limits)), "source_key", "left").select("doc_id", "source", "_tail", "_n", "_x", "source_key", F.coalesce("limits", F.array().cast("array<int>")).alias("limits"))
    weights, bias, shift, limit_shift = model.weights.astype(np.float32), model.bias, model.shift, model.limit_shift

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(weights, bias)
        for pdf in batches:
            out = pdf[["doc_id", "source"]].copy()
            got = np.full(len(pdf), np.nan)
            some = [i for i, t in enumerate(pdf["_tail"]) if isinstance(t, str)]
            full = [i for i in some if pdf["_tail"].iat[i].strip()]
            got[some] = 0.0
            if full:
                part = pdf.iloc[full]
                own = [limit_of(t, int(n), int(e), limits) for t, n, e, limits in zip(part["_tail"], part["_n"], part["_x"], part["limits"])]
                x = np.array([features(t, int(n), int(e), s, limit) for t, n, e, s, limit in zip(part["_tail"], part["_n"], part["_x"], part["source_key"], own)], dtype=np.int32)
                ends = np.array([at_limit(t, int(n), int(e), limit) for t, n, e, limit in zip(part["_tail"], part["_n"], part["_x"], own)])
                got[full] = 1 / (1 + np.exp(-np.clip(m.logit(x) + np.where(ends, limit_shift, shift), -30, 30)))
            out["truncated_score"] = pd.Series(got, index=pdf.index).astype(object).where(~np.isnan(got), None).astype("Float64")
            yield out

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = d.mapInPandas(run, "doc_id string, source string, truncated_score double")
    return out.select(F.col("doc_id").cast(kind["doc_id"]).alias("doc_id"), "source", "truncated_score")


def detect(docs: DataFrame, driver_rows: int = 50_000) -> DataFrame:
    """Scores of every record; ``truncated`` is a score over one half."""
    docs = docs.select("doc_id", "source", "text")
    limits = cut(find_limits(docs))
    return score(docs, limits, train(docs, limits, driver_rows)).withColumn("truncated", F.col("truncated_score") > 0.5)


def rates(scored: DataFrame) -> DataFrame:
    """Records, truncated records and their rate by source."""
    return scored.where("truncated_score is not null").groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("truncated").cast("long")).alias("truncated_records")).withColumn("rate", F.col("truncated_records") / F.col("records"))
