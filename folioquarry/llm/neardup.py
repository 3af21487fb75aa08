"""Near-duplicate texts by a chosen-path similarity join (p2).

A text is the set of its runs of ``k`` consecutive words. Texts with the same set are collapsed first: one
representative each goes into the join. A path is a sequence of sampled tokens: at each step a text with n tokens keeps those
whose hash along the path falls under ``branch / n``, so that two texts of the wanted similarity step into the same
bucket with an expected ``branch`` x their overlap of tokens. Buckets of at most ``bucket`` texts are compared by brute
force (sizes, then a sketch of 128 one-bit minhashes); larger ones are split by a further step of the path. Whole runs
with other seeds are repeated until the target recall: first as many as bring the chance to miss a pair at the threshold
below 1 - ``recall``, then, as long as the recall estimated from the verified pairs is below it, as many again. The
estimate is that of capture and recapture (Chao): from the pairs that one run found and those that two found follows
how many none has found. Candidates are verified on their whole token sets.

The first two steps of every path depend on the text alone and are made in the one pass that reads the texts; deeper
steps, which only texts in large buckets take, read those texts again. After ``max_depth`` steps a bucket that is still
large consists of texts that share nearly everything, and is compared whole, in blocks of ``bucket`` texts, each pair of
blocks under a key of its own: no text is dropped, no bucket capped, and no task gets one whole.

Defined cases: null texts are not taken; texts of fewer than ``k`` words have an empty set, which is similar to nothing;
repeated and very long texts are taken whole; doc ids that occur twice count once; an empty table gives no pairs.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm import hashing as H
from folioquarry.operators.graph import components
from folioquarry.plans.runtime import cut, spread

ASCII_WORD = re.compile(r"[a-z0-9]+")
SKETCH = 128
_SEEDS = (H.mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SLAB = 4096


def token_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words; a word is a run of ``[a-z0-9]`` in the lower-cased text."""
    return np.unique(H.shingles(H.hashed(ASCII_WORD.findall(text.lower())), k))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """128 one-bit minhashes as two 64-bit words: two sets of similarity s agree on (1 + s) / 2 of the bits."""
    best = np.full(SKETCH, np.iinfo(np.uint32).max, dtype=np.uint32)
    low = (tokens >> np.uint64(16)).astype(np.uint32)  # 32-bit arithmetic is vectorised by the processor
    for lo in range(0, len(low), _SLAB):
        h = low[lo : lo + _SLAB][None, :] * _SEEDS[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(1), out=best)
    bits = (np.bitwise_count(best) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.uint64)


def step(tokens: np.ndarray, paths: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the buckets that one more step from each of ``paths`` leads to, and the number of the path that each continues."""
    limit = np.uint64(min(1.0, branch / len(tokens)) * float((1 << 64) - 2048))
    keys, whose = [], []
    with np.errstate(over="ignore"):
        for lo in range(0, len(tokens), _SLAB * 8):
            h = tokens[lo : lo + _SLAB * 8][None, :] ^ paths[:, None]
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            row, col = np.nonzero(h <= limit)
            keys.append(H.mix(h[row, col] + paths[row] * np.uint64(0x9E3779B97F4A7C15)))
            whose.append(row)
    return np.concatenate(keys), np.concatenate(whose)


class PathJoin:
    def __init__(self, docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (8, 10), recall: float = 0.995, branch: float = 3.0, bucket: int = 1024, broadcast_rows: int = 200_000, max_depth: int = 8, id_col: str = "doc_id", runs: int | None = None):
        self.k, self.branch, self.bucket, self.max_depth, self.id = k, branch, bucket, max_depth, id_col
        self.num, self.den = threshold
        self.broadcast_rows = broadcast_rows
        t = self.num / self.den
        # A pair at the threshold shares at least t x the larger set: so many of its tokens are chosen by both on average.
        # It must go on over two or more steps, hence the chance of survival of the branching process.
        alive = 1.0
        for _ in range(3):
            alive = 1 - math.exp(-branch * t * alive)
        self.runs = runs or max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))
        # One-bit minhashes: disagreements of a pair at the threshold, plus four and a half standard deviations.
        off = (1 - t) / 2 * SKETCH
        self.off = int(off + 4.5 * math.sqrt(off * (1 - off / SKETCH)))
        self.texts = docs.select(F.col(id_col).alias("id"), "text").where("text is not null and id is not null")
        self.profile = cut(self._profile(0))
        self.repeated = self.profile.groupBy("id").count().where("count > 1").limit(1).count() > 0
        self.reps = cut(self._representatives(self.profile))
        self.target, self.estimate, self.done = recall, None, None

    @staticmethod
    def _representatives(profile: DataFrame) -> DataFrame:
        same = profile.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "k1", "r1", "p2", "k2", "r2", "b1", "b2")).alias("r"))
        return same.select("s1", "s2", "n", "r.*")

    def _profile(self, turn: int) -> DataFrame:
        """Size, digests, sketch and the first two steps of the paths of every text, for the runs of a turn."""
        k, branch, runs = self.k, self.branch, self.runs
        seeds = H.mix((np.arange(101, 101 + runs, dtype=np.uint64) + np.uint64(turn * runs)) * np.uint64(0x9E3779B97F4A7C15))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i, text in zip(pdf["id"], pdf["text"]):
                    t = token_set(text, k)
                    if not len(t):
                        rows.append((i, 0, 0, 0, 0, 0, None, None, None, None, None))
                        continue
                    b = H.signed(sketch(t))
                    with np.errstate(over="ignore"):
                        s1, s2 = H.signed(np.array([t.sum(dtype=np.uint64), H.mix(t).sum(dtype=np.uint64)]))
                    first, run_of = step(t, seeds, branch)
                    run_of = run_of.astype(np.int32)
                    second, of = step(t, first, branch) if len(first) else (first, np.zeros(0, np.int64))
                    rows.append((i, len(t), s1, s2, b[0], b[1], H.signed(first), run_of, H.signed(first[of]), H.signed(second), run_of[of]))
                yield pd.DataFrame(rows, columns=["id", "n", "s1", "s2", "b1", "b2", "k1", "r1", "p2", "k2", "r2"])

        kind = dict(self.texts.dtypes)["id"]
        return spread(self.texts, "id").mapInPandas(run, f"id {kind}, n int, s1 bigint, s2 bigint, b1 bigint, b2 bigint, k1 array<bigint>, r1 array<int>, p2 array<bigint>, k2 array<bigint>, r2 array<int>")

    def _compare(self, rows: DataFrame) -> DataFrame:
        """Pairs within the buckets of ``rows`` (key, run, id, n, b1, b2) that sizes and sketches let pass."""
        return self._pairs(rows.alias("x"), rows.alias("y"))

    def _pairs(self, x: DataFrame, y: DataFrame) -> DataFrame:
        near = (F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))) <= self.off
        sizes = (F.col("x.n") * self.den >= F.col("y.n") * self.num) & (F.col("y.n") * self.den >= F.col("x.n") * self.num)
        return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & sizes & near).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.run").alias("run"))

    def _blocks(self, rows: DataFrame, sizes: DataFrame) -> DataFrame:
        """Pairs within large buckets: a text meets each block of its bucket under a key of the two blocks."""
        many = F.ceil(F.col("c") / self.bucket).cast("int")
        r = rows.join(sizes, "key").withColumn("m", many).withColumn("own", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        cols = ("run", "id", "n", "b1", "b2")
        x, y = (r.select(F.xxhash64("key", *pair).alias("key"), *cols).alias(side) for side, pair in (("x", ("own", "other")), ("y", ("other", "own"))))
        return self._pairs(x, y)

    def _near_texts(self, few: DataFrame, weight=None) -> DataFrame:
        """The texts of ``few`` (written already), which goes to the texts if its counted rows (and array elements) allow, so that these aren't shuffled."""
        held = few.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0] or 0
        return self.texts.join(F.broadcast(few) if held <= self.broadcast_rows else few, "id")

    def _deeper(self, rows: DataFrame) -> DataFrame:
        """One more step for the (key, id, ...) of large buckets; the texts are read again."""
        k, branch = self.k, self.branch
        paths = cut(rows.groupBy("id", "n", "b1", "b2").agg(F.collect_set(F.struct("key", "run")).alias("paths")))  # a few paths per text

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for text, i, n, b1, b2, ps in zip(pdf["text"], pdf["id"], pdf["n"], pdf["b1"], pdf["b2"], pdf["paths"]):
                    t = token_set(text, k)
                    keys, of = step(t, np.array([p["key"] for p in ps], dtype=np.int64).view(np.uint64), branch)
                    out.extend((x, ps[j]["run"], i, n, b1, b2) for x, j in zip(H.signed(keys).tolist(), of.tolist()))
                yield pd.DataFrame(out, columns=["key", "run", "id", "n", "b1", "b2"])

        kind = dict(self.texts.dtypes)["id"]
        return self._near_texts(paths, F.size("paths") + 4).mapInPandas(run, f"key bigint, run int, id {kind}, n int, b1 bigint, b2 bigint")

    def candidates(self, reps: DataFrame) -> DataFrame:
        """Pairs of representatives that some bucket brought together, and in how many runs one did (``hits``)."""
        found = None
        rows = reps.select(F.explode(F.arrays_zip("k1", "r1")).alias("z"), "id", "n", "b1", "b2").select(F.col("z.k1").alias("key"), F.col("z.r1").alias("run"), "id", "n", "b1", "b2")
        for depth in range(1, self.max_depth + 1):
            sizes = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
            last = depth == self.max_depth
            small = rows.join(sizes.where(F.col("c") <= self.bucket).select("key"), "key", "left_semi")
            got = self._compare(small)
            got = cut(got.unionByName(self._blocks(rows, sizes.where(F.col("c") > self.bucket))) if last else got)
            found = got if found is None else found.unionByName(got)
            large = sizes.where(F.col("c") > self.bucket).select("key")
            if last or not large.limit(1).count():
                break
            if depth == 1:
                deep = reps.select(F.explode(F.arrays_zip("p2", "k2", "r2")).alias("z"), "id", "n", "b1", "b2").select(F.col("z.p2").alias("path"), F.col("z.k2").alias("key"), F.col("z.r2").alias("run"), "id", "n", "b1", "b2")
                rows = cut(deep.join(large.withColumnRenamed("key", "path"), "path", "left_semi").drop("path"))
            else:
                rows = cut(self._deeper(rows.join(large, "key", "left_semi")))
        return found.groupBy("a", "b").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, run % 64)"))).alias("hits"))

    def pairs(self) -> DataFrame:
        """Verified pairs of representatives: ``a`` < ``b``, ``shared``, ``total``; runs are repeated until the estimated recall is the target's."""
        turn, reps = 0, self.reps
        while self.done is None or self.estimate < self.target:
            if turn:
                reps = cut(self._representatives(cut(self._profile(turn))))
            cand = cut(self.candidates(reps))
            if turn:  # what is verified is counted, the rest is verified
                again = self.done.join(cand.withColumnRenamed("hits", "more"), ["a", "b"], "left")
                old = again.select("a", "b", "shared", "total", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"))
                self.done = cut(old.unionByName(self._verified(cut(cand.join(self.done.select("a", "b"), ["a", "b"], "left_anti")))))
            else:
                self.done = cut(self._verified(cand))
            c = self.done.agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("hits") == 1).alias("f1"), F.count_if(F.col("hits") == 2).alias("f2")).first()
            unseen = c.f1 * (c.f1 - 1) / (2 * (c.f2 + 1))
            self.estimate = c.s / (c.s + unseen) if c.s else 1.0
            turn += 1
        self.turns = turn
        return self.done.select("a", "b", "shared", "total")

    def _verified(self, cand: DataFrame) -> DataFrame:
        """The pairs (written already) whose whole token sets are as similar as asked."""
        k = self.k
        ids = cut(cand.select(F.col("a").alias("id")).unionByName(cand.select(F.col("b").alias("id"))).distinct())

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"id": pdf["id"], "tokens": [H.signed(token_set(t, k)) for t in pdf["text"]]})

        kind = dict(self.texts.dtypes)["id"]
        tokens = cut(self._near_texts(ids).mapInPandas(run, f"id {kind}, tokens array<bigint>"))
        tokens = tokens.groupBy("id").agg(F.min("tokens").alias("tokens")) if self.repeated else tokens
        x = cand.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
        x = x.select("a", "b", "hits", F.size(F.array_intersect("ta", "tb")).alias("shared"), (F.size("ta") + F.size("tb")).alias("sum"))
        return x.select("a", "b", "hits", "shared", (F.col("sum") - F.col("shared")).alias("total")).where(F.col("shared") * self.den >= F.col("total") * self.num)

    def members(self) -> DataFrame:
        """``rep``, ``id``: which representative stands for each text with tokens."""
        return self.profile.where("n > 0").join(self.reps.select("s1", "s2", "n", F.col("id").alias("rep")), ["s1", "s2", "n"]).select("rep", "id").distinct()

    def found(self) -> DataFrame:
        """All pairs of ids, copies expanded: ``a`` < ``b``."""
        m = cut(self.members())
        p = self.pairs().select("a", "b")
        wide = p.join(m.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(m.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
        across = wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        several = m.join(m.groupBy("rep").count().where("count > 1").select("rep"), "rep", "left_semi")
        x, y = several.alias("x"), several.alias("y")
        within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        return across.unionByName(within)

    def classes(self) -> DataFrame:
        """``id``, ``class_id`` (the least id its links reach) and ``links`` (how many texts are similar to it), one row per text; copies aren't expanded."""
        m = cut(self.members())
        p = cut(self.pairs().select("a", "b"))
        comp = components(p, "a", "b", nodes=self.reps.select(F.col("id").alias("node")))
        size = m.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
        both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = both.join(size.select(F.col("rep").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
        per = comp.join(size.withColumnRenamed("rep", "node"), "node").join(links.withColumnRenamed("a", "node"), "node", "left")
        per = per.select(F.col("node").alias("rep"), F.col("component").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
        return m.join(per, "rep").select("id", "class_id", "links")
