"""Consensus of several annotators by minimax conditional entropy (p5).

Annotator i labels item j of class c as k with probability proportional to exp(sigma[i, c, k] + tau[j, c, k]), the form
that minimax conditional entropy gives; sigma and tau are the multipliers of the annotator and the item constraints. The
regularised dual

    sum over items of log sum over c of prior[c] x product of the votes' probabilities - alpha/2 |sigma|^2 - beta/2 |tau|^2

is ascended by blocks of coordinates: the label posteriors, the tilts of each item (one coordinate after another, with a
step that cannot lower the dual), and the tilts of all annotators (a Newton step for each annotator and class, which don't
touch each other's votes). Each pass returns the dual, the gradient and the curvature of sigma, summed over the items; a
step that lowered the dual is halved and tried again, so ``dual`` rises from pass to pass until it rises no more.

``alpha`` and ``beta`` are fitted unless given: on a sample of ``tuning`` items, chosen by a hash of their ids, one vote
of each item is hidden, and the values that foretell the hidden votes best are taken; between values that differ by less
than a standard error, the stronger regularisation. The sample's tilts are where the ascent over all items starts.

The votes are packed once into arrays (a row holds those of some 50,000 items), so that a pass is arithmetic on whole
arrays. Only sigma and the class shares live between passes, so a lost task is simply run again. Annotators up to
``max_annotators`` have their tilts on the driver; beyond that the tilts are a table that is joined to the votes.

Defined cases: of an annotator's entries on an item the latest with a label counts (entries of the same time: the
greatest label), names compared without case and outer blanks; entries without name, time or label don't count; items
without labels get no consensus; rows delivered twice add nothing; ties in the posterior go to the greater label.
Agreement is reported apart from the model: the share of pairs of an item's annotators that agree (null for one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.plans.runtime import cut

ALPHAS, BETAS, OFF = (0.1, 1.0, 10.0), (0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0), float("inf")
PACK = 50_000  # items in a packed row


def latest_votes(results: DataFrame) -> DataFrame:
    """``item``, ``judge``, ``label`` (0 or 1) from histories of verdicts; hashed by item, so that what follows needs no other shuffle."""
    h = results.select(F.col("result_id").alias("item"), F.explode("judge_history").alias("h"))
    h = h.select("item", F.lower(F.trim("h.judge")).alias("judge"), F.col("h.judged_at").alias("at"), F.col("h.verdict").cast("int").alias("label"))
    h = h.where("item is not null and label is not null and at is not null and judge <> ''").repartition("item")
    return h.groupBy("item", "judge").agg(F.max_by("label", F.struct("at", "label")).alias("label"))


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the last axis, which is short: label by label."""
    parts = [x[..., a] for a in range(x.shape[-1])]
    top = parts[0]
    for part in parts[1:]:
        top = np.maximum(top, part)
    whole = sum(np.exp(part - top) for part in parts)
    return x - (top + np.log(whole))[..., None]


class Votes:
    """Votes in order of their items: item j has those from ``start[j]`` to ``start[j + 1]``, one at least."""

    def __init__(self, sizes: np.ndarray, judge: np.ndarray, label: np.ndarray):
        self.n, self.judge, self.label = len(sizes), judge, label.astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.item = np.repeat(np.arange(self.n), sizes)

    def per_item(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.item, column, self.n) for column in x.T], axis=1)

    def majority(self, k: int) -> np.ndarray:
        q = self.per_item(np.eye(k)[self.label]) + 0.1
        return q / q.sum(1, keepdims=True)

    def fit_items(self, sigma: np.ndarray, prior: np.ndarray, beta: float, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Posteriors (n, K), item tilts (n, K, K), log probabilities (votes, K, K) and dual, for the tilts ``sigma`` of each vote's annotator."""
        k = len(prior)
        tau = np.zeros((self.n, k, k))
        logp = _log_softmax(sigma)
        votes = np.arange(len(self.label))
        count = np.diff(self.start).astype(float)[:, None]
        for turn in range(1 if beta == OFF else rounds + 1):
            joint = np.log(prior) + self.per_item(logp[votes, :, self.label])
            top = joint.max(1, keepdims=True)
            whole = top + np.log(np.exp(joint - top).sum(1, keepdims=True))
            q = np.exp(joint - whole)
            if beta == OFF or turn == rounds:
                break
            for c in range(k):  # a coordinate's curvature is at most a quarter of the votes' weight, plus beta
                seen = self.per_item((self.label == c).astype(float)[:, None] - np.exp(logp[:, :, c]))
                tau[:, :, c] += (q * seen - beta * tau[:, :, c]) / (q * count / 4 + beta)
                logp = _log_softmax(sigma + tau[self.item])
        return q, tau, logp, float(whole.sum()) - (0.0 if beta == OFF else beta / 2 * float((tau**2).sum()))

    def sums(self, q: np.ndarray, logp: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Gradient (m, K, K) and curvature (m, K, K, K) of the tilts of ``m`` annotators."""
        k = q.shape[1]
        p, w = np.exp(logp), q[self.item]
        g, h = np.zeros((m, k, k)), np.zeros((m, k, k, k))
        for c in range(k):
            for a in range(k):
                g[:, c, a] = np.bincount(self.judge, w[:, c] * ((self.label == a) - p[:, c, a]), m)
                for b in range(a, k):
                    h[:, c, a, b] = h[:, c, b, a] = np.bincount(self.judge, w[:, c] * p[:, c, a] * ((a == b) - p[:, c, b]), m)
        return g, h


def _newton(g: np.ndarray, h: np.ndarray, sigma: np.ndarray, alpha: float) -> np.ndarray:
    """The Newton step of every annotator and class, which has ``alpha`` to keep it invertible."""
    k = sigma.shape[-1]
    return np.clip(np.linalg.solve(h + alpha * np.eye(k), (g - alpha * sigma)[..., None])[..., 0], -2, 2)


class Ascent:
    """Newton steps on sigma, halved where they lowered the dual: give it each pass's sums, it gives the next sigma."""

    def __init__(self, sigma: np.ndarray, prior: np.ndarray, alpha: float, tolerance: float):
        self.sigma, self.prior, self.alpha, self.tolerance = sigma, prior, alpha, tolerance
        self.best: tuple | None = None  # sigma, prior, dual, step, next prior
        self.scale, self.done, self.dual = 1.0, False, []

    def take(self, dual: float, g: np.ndarray, h: np.ndarray, mass: np.ndarray) -> None:
        dual -= self.alpha / 2 * float((self.sigma**2).sum())
        if self.best is not None and dual < self.best[2]:
            self.scale /= 2
            self.done = self.scale < 1 / 64
        else:
            self.done = self.best is not None and dual - self.best[2] <= self.tolerance * (1 + abs(dual))
            self.scale = min(1.0, self.scale * 2)
            self.dual.append(dual)
            self.best = (self.sigma, self.prior, dual, _newton(g, h, self.sigma, self.alpha), mass / mass.sum() if mass.sum() else self.prior)
        sigma, prior, _, step, shares = self.best
        self.sigma, self.prior = (sigma, prior) if self.done else (sigma + self.scale * step, np.clip(prior + self.scale * (shares - prior), 1e-6, 1))
        self.prior = self.prior / self.prior.sum()


def fit_here(v: Votes, m: int, k: int, alpha: float, beta: float, passes: int = 40, tolerance: float = 1e-6) -> Ascent:
    """The ascent over votes that are all here, from the majority's labels."""
    first = np.zeros((m, k, k))
    np.add.at(first, v.judge, v.majority(k)[v.item][:, :, None] * np.eye(k)[v.label][:, None, :])
    sigma = np.log(first + 1.0)
    at = Ascent(sigma - sigma.mean(-1, keepdims=True), np.full(k, 1 / k), alpha, tolerance)
    for _ in range(passes):
        q, _, logp, dual = v.fit_items(at.sigma[v.judge], at.prior, beta)
        at.take(dual, *v.sums(q, logp, m), q.sum(0))
        if at.done:
            break
    at.sigma, at.prior = at.best[:2]
    return at


def tune(v: Votes, m: int, k: int, alpha: float | None, beta: float | None) -> tuple[float, float]:
    """``alpha`` and ``beta``, where not given, by the likelihood of one hidden vote an item."""
    sizes = np.diff(v.start)
    hide = v.start[:-1] + (np.arange(v.n) * 2654435761 >> 7) % sizes
    hide = hide[sizes > 1]
    keep = np.ones(len(v.label), bool)
    keep[hide] = False
    seen = Votes(sizes - (sizes > 1), v.judge[keep], v.label[keep])
    who = v.item[hide]
    if len(hide) < 50:
        return 1.0 if alpha is None else alpha, BETAS[-1] if beta is None else beta

    def score(a: float, b: float) -> np.ndarray:
        at = fit_here(seen, m, k, a, b, 15, 1e-5)
        q, tau, _, _ = seen.fit_items(at.sigma[seen.judge], at.prior, b)
        p = np.exp(_log_softmax(at.sigma[v.judge[hide]] + tau[who]))
        return np.log((q[who] * np.take_along_axis(p, v.label[hide][:, None, None], 2)[:, :, 0]).sum(1))

    def best(values, of) -> float:
        got = [(x, of(x)) for x in values]
        top = max(got, key=lambda x: x[1].mean())[1]
        return max(x for x, s in got if (top - s).mean() <= (top - s).std() / np.sqrt(len(s)))

    if beta is None:
        beta = best(BETAS, lambda b: score(1.0 if alpha is None else alpha, b))
    if alpha is None:
        alpha = best(ALPHAS, lambda a: score(a, beta))
    return alpha, beta


PACKED = "n int, sizes binary, judges binary, labels binary, items array<string>"


class Consensus:
    def __init__(self, votes: DataFrame, labels: int = 2, alpha: float | None = None, beta: float | None = None, passes: int = 40, tolerance: float = 1e-6, tuning: int = 4000, max_annotators: int = 1_000_000):
        self.spark, self.k = votes.sparkSession, labels
        self.kind = dict(votes.dtypes)["item"]
        votes = votes.select(F.col("item").cast("string").alias("item"), F.xxhash64("judge").alias("j"), "judge", "label")
        self.names = votes.select("j", "judge")
        self.packed = cut(self._pack(votes.select("item", "j", "label")))
        codes = self.packed.mapInPandas(self._codes, "j bigint").distinct().limit(max_annotators + 1).collect()
        self.far = len(codes) > max_annotators  # then their tilts are a table
        self.codes = np.array([] if self.far else sorted(r.j for r in codes), dtype=np.int64)
        n = self.packed.agg(F.sum("n")).first()[0] or 0
        self.m, self.dual = len(self.codes), []
        self.sigma, self.prior, self.alpha, self.beta = np.zeros((self.m, labels, labels)), np.full(labels, 1 / labels), alpha or 1.0, beta or BETAS[-1]
        if not n:
            return
        sample = self._sample(min(1.0, tuning / n))
        here, place = np.unique(sample.judge, return_inverse=True)
        local = Votes(np.diff(sample.start), place, sample.label)
        self.alpha, self.beta = tune(local, len(here), labels, alpha, beta)
        start = fit_here(local, len(here), labels, self.alpha, self.beta)
        if self.far:
            self._ascend_far(here, start, passes, tolerance)
            return
        sigma = np.zeros((self.m, labels, labels))
        sigma[np.searchsorted(self.codes, here)] = start.sigma
        at = Ascent(sigma, start.prior, self.alpha, tolerance)
        for _ in range(passes):
            at.take(*self._pass(at.sigma, at.prior))
            if at.done:
                break
        self.sigma, self.prior, self.dual = at.best[0], at.best[1], at.dual

    @staticmethod
    def _pack(coded: DataFrame) -> DataFrame:
        """Rows of the arrays of up to ``PACK`` items; an item's votes stand together in its partition."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def row(pdf: pd.DataFrame) -> pd.DataFrame:
                item = pdf["item"].to_numpy()
                edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
                sizes = np.diff(np.append(edge, len(item))).astype(np.int32)
                return pd.DataFrame({"n": [len(edge)], "sizes": [sizes.tobytes()], "judges": [pdf["j"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int8).tobytes()], "items": [item[edge].tolist()]})

            held: list[pd.DataFrame] = []
            size = 0
            for pdf in batches:
                held.append(pdf)
                size += len(pdf)
                if size >= PACK * 4:
                    whole = pd.concat(held, ignore_index=True)
                    last = (whole["item"] == whole["item"].iat[-1]).to_numpy()  # more of this item's votes may come
                    if not last.all():
                        yield row(whole[~last])
                        whole = whole[last]
                    held, size = [whole], len(whole)
            if size:
                yield row(pd.concat(held, ignore_index=True))

        return coded.repartition("item").sortWithinPartitions("item", "j").mapInPandas(run, PACKED)

    @staticmethod
    def _codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"j": np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in pdf["judges"])]))})

    @staticmethod
    def _votes(r) -> Votes:
        return Votes(np.frombuffer(r.sizes, np.int32), np.frombuffer(r.judges, np.int64), np.frombuffer(r.labels, np.int8))

    def _sample(self, share: float) -> Votes:
        """Votes of about ``share`` of the items, chosen by a hash of their ids; bounded by ``tuning``."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    v = Consensus._votes(r)
                    take = pd.util.hash_array(np.array(r.items, dtype=object)) % (1 << 30) < share * (1 << 30)
                    of = take[v.item]
                    yield pd.DataFrame({"sizes": [np.diff(v.start)[take].astype(np.int32).tobytes()], "judges": [v.judge[of].tobytes()], "labels": [v.label[of].astype(np.int8).tobytes()]})

        rows = self.packed.mapInPandas(run, "sizes binary, judges binary, labels binary").collect()
        return Votes(*(np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("sizes", np.int32), ("judges", np.int64), ("labels", np.int8))))

    def _pass(self, sigma: np.ndarray, prior: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """The dual of all items without the annotators' term, and the sums that the next step needs."""
        beta, m, k, codes = self.beta, self.m, self.k, self.codes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, g, h, mass = 0.0, np.zeros((m, k, k)), np.zeros((m, k, k, k)), np.zeros(k)
            for pdf in batches:
                for r in pdf.itertuples():
                    v = Consensus._votes(r)
                    v.judge = np.searchsorted(codes, v.judge)
                    q, _, logp, dual = v.fit_items(sigma[v.judge], prior, beta)
                    dg, dh = v.sums(q, logp, m)
                    total, g, h, mass = total + dual, g + dg, h + dh, mass + q.sum(0)
            yield pd.DataFrame({"s": [np.concatenate([[total], mass, g.ravel(), h.ravel()]).tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            got = sum(np.frombuffer(x) for pdf in batches for x in pdf["s"])
            if not isinstance(got, int):
                yield pd.DataFrame({"s": [got.tobytes()]})

        sums = self.packed.select("sizes", "judges", "labels").mapInPandas(run, "s binary")
        if self.packed.rdd.getNumPartitions() > 64:  # a second level of sums, so that the driver gets a few rows
            sums = sums.repartition(8).mapInPandas(add, "s binary")
        s = sum(np.frombuffer(r.s) for r in sums.collect())
        cut_at = 1 + k + m * k * k
        return float(s[0]), s[1 + k : cut_at].reshape(m, k, k), s[cut_at:].reshape(m, k, k, k), s[1 : 1 + k]

    # Annotators beyond the bound: the same passes with their tilts in a table (j, sigma).

    def _with_sigma(self, sigma: DataFrame) -> DataFrame:
        """The packed rows' votes with the tilts of each vote's annotator, packed again."""
        k = self.k

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    v = Consensus._votes(r)
                    yield pd.DataFrame({"item": np.array(r.items, dtype=object)[v.item], "j": v.judge, "label": v.label})

        votes = self.packed.mapInPandas(unpack, "item string, j bigint, label int").join(sigma, "j", "left")
        votes = votes.withColumn("sigma", F.coalesce("sigma", F.array(*[F.lit(0.0)] * (k * k))))
        return votes.repartition("item").sortWithinPartitions("item", "j")

    @staticmethod
    def _items_of(batches: Iterator[pd.DataFrame], k: int):
        """(items, votes, their annotators' tilts) of whole items."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf["item"] == pdf["item"].iat[-1]).to_numpy() if len(pdf) else np.zeros(0, bool)
            rest, pdf = pdf[last], pdf[~last]
            if len(pdf):
                yield Consensus._one(pdf, k)
        if rest is not None and len(rest):
            yield Consensus._one(rest, k)

    @staticmethod
    def _one(pdf: pd.DataFrame, k: int):
        item = pdf["item"].to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        v = Votes(np.diff(np.append(edge, len(item))), pdf["j"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64))
        return item[edge], v, np.stack(pdf["sigma"].to_numpy()).reshape(-1, k, k)

    def _ascend_far(self, here: np.ndarray, start: Ascent, passes: int, tolerance: float) -> None:
        k, alpha, beta = self.k, self.alpha, self.beta
        sigma = self.spark.createDataFrame([(int(j), s.ravel().tolist()) for j, s in zip(here, start.sigma)], "j bigint, sigma array<double>")
        prior = start.prior
        for _ in range(passes):

            def run(batches: Iterator[pd.DataFrame], prior=prior) -> Iterator[pd.DataFrame]:
                for _, v, s in Consensus._items_of(batches, k):
                    q, _, logp, dual = v.fit_items(s, prior, beta)
                    names, v.judge = np.unique(v.judge, return_inverse=True)
                    g, h = v.sums(q, logp, len(names))
                    yield pd.DataFrame({"whole": [False] * len(names) + [True], "j": np.append(names, 0), "s": [*(np.concatenate([a.ravel(), b.ravel()]).tolist() for a, b in zip(g, h)), [dual, *q.sum(0)]]})

            sums = cut(self._with_sigma(sigma).mapInPandas(run, "whole boolean, j bigint, s array<double>"))
            at = sums.select("whole", "j", F.posexplode("s").alias("p", "x")).groupBy("whole", "j", "p").agg(F.sum("x").alias("x"))
            whole = {r.p: r.x for r in at.where("whole").collect()}
            per = at.where("not whole").groupBy("j").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda z: z["x"]).alias("s")).join(sigma, "j", "left")

            def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        s = np.stack(pdf["s"].to_numpy())
                        old = np.stack([np.zeros(k * k) if x is None else np.asarray(x) for x in pdf["sigma"]]).reshape(-1, k, k)
                        new = old + _newton(s[:, : k * k].reshape(-1, k, k), s[:, k * k :].reshape(-1, k, k, k), old, alpha)
                        yield pd.DataFrame({"j": pdf["j"], "sigma": list(new.reshape(-1, k * k)), "old": (old**2).sum((1, 2))})

            new = cut(per.mapInPandas(step, "j bigint, sigma array<double>, old double"))
            dual = whole[0] - alpha / 2 * (new.agg(F.sum("old")).first()[0] or 0.0)
            if self.dual and dual - self.dual[-1] <= tolerance * (1 + abs(dual)):
                break
            self.dual.append(dual)
            self.sigma_far, self.prior = sigma, prior
            sigma, prior = new.select("j", "sigma"), np.array([whole[1 + c] for c in range(k)]) / sum(whole[1 + c] for c in range(k))

    def consensus(self) -> DataFrame:
        """``item``, ``consensus``, ``confidence``, ``votes`` and ``agreement``."""
        sigma, prior, beta, k, far, codes = self.sigma, self.prior, self.beta, self.k, self.far, self.codes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if far:
                parts = Consensus._items_of(batches, k)
            else:
                parts = ((r.items, v, sigma[np.searchsorted(codes, v.judge)]) for pdf in batches for r in pdf.itertuples() for v in [Consensus._votes(r)])
            for items, v, s in parts:
                q, *_ = v.fit_items(s, prior, beta)
                counts = v.per_item(np.eye(k)[v.label])
                n = counts.sum(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    agreement = (counts * (counts - 1)).sum(1) / (n * (n - 1))
                agreement = [None if x != x else float(x) for x in agreement]
                yield pd.DataFrame({"item": np.array(items, dtype=object), "consensus": k - 1 - q[:, ::-1].argmax(1), "confidence": q.max(1), "votes": n.astype(int), "agreement": pd.Series(agreement, dtype="float64")})

        out = (self._with_sigma(self.sigma_far) if far else self.packed).mapInPandas(run, "item string, consensus int, confidence double, votes int, agreement double")
        return out.withColumn("item", F.col("item").cast(self.kind))

    def reliability(self) -> DataFrame:
        """``judge`` and the chance that they give each class its own label, on an item without tilts."""
        k = self.k
        sigma = self.sigma_far if self.far else self.spark.createDataFrame([(int(j), x.ravel().tolist()) for j, x in zip(self.codes, self.sigma)], "j bigint, sigma array<double>")
        s = self.names.distinct().join(sigma, "j", "left").withColumn("sigma", F.coalesce("sigma", F.array(*[F.lit(0.0)] * (k * k))))
        tilt = lambda c, label: F.element_at("sigma", c * k + label + 1)
        right = [(1 / sum((F.exp(tilt(c, label) - tilt(c, c)) for label in range(k)), F.lit(0.0))).alias(f"right_on_{c}") for c in range(k)]
        return s.select("judge", *right)
