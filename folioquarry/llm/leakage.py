"""Evaluation passages in training text (p6).

Items and documents are compared by SimHash windows of several sizes: the unit of ``width`` words (12, the shortest run
that counts as a leak), which finds items that occur only in part, and item-sized windows, the largest of ``SIZES`` that
fits the item, which find whole items with small edits all over, where no unit is left intact. Every window of an item is
indexed; a document's windows are taken at every word for the unit and at every ``STRIDE``-th for the item-sized ones
(an item has a window for each of the ``STRIDE`` alignments).

A 64-bit fingerprint is indexed four times, by blocks of 16 bits. Two fingerprints within ``radius`` bits agree on some
block but for ``radius // 4`` bits, so looking up a block with all so many bits flipped finds every window within the
radius: 3 for units, 7 for item-sized windows. Each candidate is then verified by exact weighted-shingle similarity
(shingles of five words, weighted by their rarity among all items): the share of the unit's weight that the document's
window has, or the share of the whole item's weight that the stretch it lines up with has. Only pairs with either share
of ``least`` (0.8) or more come out, with the longest run of equal words on the diagonals verified.

Documents are scanned without a shuffle. The items are the stated query set; as fingerprints they go to the tasks in
blocks of about ``block_words`` words (five million are some 200 MB in a task), one pass over the documents for each
block, so that test material of up to some 100,000 passages takes one pass.

Defined cases: items without an id are left out; null and empty texts and passages of fewer than ``width`` words match
nothing; items delivered twice come out once; long texts are scanned whole, ``SLICE`` words at a time with overlap.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquarry.llm import hashing as H
from folioquarry.plans.runtime import cut, spread

WIDTH, RADIUS, SHINGLE, LEAST = 12, 3, 5, 0.8
SIZES, STRIDE, ITEM_RADIUS = (24, 48, 96), 8, 7
SLICE, PAIRS = 100_000, 2_000_000


class HammingIndex:
    """64-bit fingerprints by four blocks of 16 bits: all within ``radius`` bits of one looked up are found."""

    def __init__(self, sims: np.ndarray, radius: int):
        self.sims, self.radius = sims, radius
        flips = [0]
        for k in range(1, radius // 4 + 1):
            flips += [sum(1 << b for b in at) for at in combinations(range(16), k)]
        self.flips = np.array(flips, dtype=np.uint16)
        self.tables = []
        for b in range(4):
            key = self._key(sims, b)
            offsets = np.zeros((1 << 16) + 1, dtype=np.int64)
            np.cumsum(np.bincount(key, minlength=1 << 16), out=offsets[1:])
            self.tables.append((np.argsort(key, kind="stable").astype(np.int32), offsets, np.diff(offsets) > 0))

    @staticmethod
    def _key(sims: np.ndarray, b: int) -> np.ndarray:
        return (sims >> np.uint64(16 * b)).astype(np.uint16)

    def near(self, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (number in ``sims``, number in the index) within the radius, in order, once each."""
        found, many = [np.zeros(0, dtype=np.int64)], max(1, len(self.sims))
        for b, (order, offsets, filled) in enumerate(self.tables if len(self.sims) else ()):
            keys = self._key(sims, b)
            for flip in self.flips:
                key = keys ^ flip
                hit = np.flatnonzero(filled[key])
                if not len(hit):
                    continue
                lo = offsets[key[hit]]
                n = offsets[key[hit].astype(np.int64) + 1] - lo
                ends = np.cumsum(n)
                at = 0
                while at < len(hit):  # at most PAIRS pairs at once, or one fingerprint's
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
                    part = n[at:to]
                    who = np.repeat(hit[at:to], part)
                    which = order[np.repeat(lo[at:to], part) + np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)]
                    close = np.bitwise_count(sims[who] ^ self.sims[which]) <= self.radius
                    found.append(who[close] * many + which[close])
                    at = to
        pairs = np.unique(np.concatenate(found))
        return pairs // many, pairs % many


class ItemIndex:
    """The windows of a block of items: (id, word hashes, weight of the shingle at each word)."""

    def __init__(self, items: list[tuple], width: int = WIDTH, radius: int = RADIUS, item_radius: int = ITEM_RADIUS):
        self.width, self.ids = width, [i for i, _, _ in items]
        self.words = [h for _, h, _ in items]
        self.weights = [w for _, _, w in items]
        self.shingles = [H.shingles(h, SHINGLE) for h in self.words]
        self.levels: list[tuple[int, int, HammingIndex, np.ndarray, np.ndarray]] = []
        for size in (width, *SIZES):
            step = 1 if size == width else STRIDE
            mine = [k for k, h in enumerate(self.words) if len(h) >= size and (size == width or size == max((s for s in SIZES if s + STRIDE - 1 <= len(h)), default=0))]
            if not mine or size != width and item_radius < 0:
                continue
            sims = [H.window_simhash(self.words[k], size) for k in mine]
            of = np.repeat(np.array(mine), [len(s) for s in sims])
            start = np.concatenate([np.arange(len(s)) for s in sims])
            if size != width or radius >= 0:
                self.levels.append((size, step, HammingIndex(np.concatenate(sims), radius if size == width else item_radius), of, start))

        every = np.concatenate([*self.shingles, np.zeros(0, np.uint64)])
        self.known, first = np.unique(every, return_index=True)
        self.known_weight = np.concatenate([*(w[: len(x)] for w, x in zip(self.weights, self.shingles)), np.zeros(0, np.float32)])[first].astype(np.float64)
        self.sizes = np.array([len(h) for h in self.words])
        self.totals = np.array([w.sum(dtype=np.float64) for w in self.weights])
        self.maybe = np.zeros(1 << max(16, (len(every) * 16).bit_length()), dtype=bool)
        self.maybe[self.known & np.uint64(len(self.maybe) - 1)] = True

    def held(self, h: np.ndarray) -> np.ndarray:
        """Running sums over the shingles of ``h`` of the weights they have among the items: they bound what a stretch can share with an item."""
        shingles = H.shingles(h, SHINGLE)
        weight = np.zeros(len(shingles) + 1)
        at = np.flatnonzero(self.maybe[shingles & np.uint64(len(self.maybe) - 1)])
        place = np.minimum(np.searchsorted(self.known, shingles[at]), max(0, len(self.known) - 1))
        same = self.known[place] == shingles[at] if len(self.known) else np.zeros(0, bool)
        weight[at[same] + 1] = self.known_weight[place[same]]
        return np.cumsum(weight)

    def unit(self, h: np.ndarray, i: int, k: int, j: int) -> float:
        """Share of the shingle weight of the item's window at ``j`` that the document's window at ``i`` has."""
        if np.array_equal(h[i : i + self.width], self.words[k][j : j + self.width]):
            return 1.0
        return self._share(k, j, j + self.width - SHINGLE + 1, h[i : i + self.width])

    def whole(self, h: np.ndarray, i: int, k: int, j: int) -> float:
        """Share of the item's shingle weight found where it lines up with the document."""
        size = len(self.words[k])
        lo = max(0, i - j - size // 8)
        return self._share(k, 0, len(self.shingles[k]), h[lo : i - j + size + size // 8])

    def _share(self, k: int, a: int, b: int, stretch: np.ndarray) -> float:
        weights = self.weights[k][a:b]
        held = np.isin(self.shingles[k][a:b], H.shingles(stretch, SHINGLE))
        total = float(weights.sum())
        return float(weights[held].sum()) / total if total else 0.0

    def run(self, h: np.ndarray, diagonal: int, k: int) -> int:
        """Longest run of equal words that item ``k`` and the document share on a diagonal (document place less item place)."""
        words = self.words[k]
        a, b = max(0, -diagonal), min(len(words), len(h) - diagonal)
        edge = np.flatnonzero(~np.concatenate([[False], h[a + diagonal : b + diagonal] == words[a:b], [False]]))
        return int(np.diff(edge).max() - 1)


def scan(texts: list[str], index: ItemIndex, least: float = LEAST) -> list[tuple[int, int, int, float, float]]:
    """(text number, item number, longest run, unit share, item share) of the verified pairs of texts and items."""
    hs = [H.hashed(H.words(t)) for t in texts]
    found: dict[tuple[int, int], list] = {}
    at = 0
    while at < len(hs):
        end, size = at, 0
        while end < len(hs) and (end == at or size + len(hs[end]) <= SLICE):
            size += len(hs[end])
            end += 1
        first = np.cumsum([0] + [len(h) for h in hs[at:end]])
        every = np.concatenate(hs[at:end])
        held = index.held(every) if len(every) else np.zeros(1)
        for width, step, near, of, start in index.levels:
            for lo in range(0, max(1, len(every) - width + 1), SLICE):
                who, which = near.near(H.window_simhash(every[lo : lo + SLICE + width - step], width, step))
                who = lo + who * step
                doc = np.searchsorted(first, who, side="right") - 1
                inside = who + width <= first[doc + 1]  # not over the edge of two texts
                if width != index.width and len(who):  # exactly those whose stretch may reach ``least`` of the item's weight
                    size = index.sizes[of[which]]
                    a, b = np.clip([who - start[which] - size // 8, who - start[which] + size + size // 8], 0, len(held) - 1)
                    inside &= held[b] - held[a] >= (least - 1e-6) * index.totals[of[which]]
                for w, d, j in zip(who[inside].tolist(), doc[inside].tolist(), which[inside].tolist()):
                    h, i, k, p = hs[at + d], w - int(first[d]), int(of[j]), int(start[j])
                    got = found.setdefault((at + d, k), [0.0, 0.0, set(), set()])
                    if (width, i - p) in got[2]:  # this diagonal is verified
                        continue
                    unit = index.unit(h, i, k, p) if width == index.width else 0.0
                    whole = index.whole(h, i, k, p) if width != index.width else 0.0
                    got[0], got[1] = max(got[0], unit), max(got[1], whole)
                    if unit >= least or whole >= least:
                        got[2].add((width, i - p))
                        got[3].add(i - p)
        at = end
    out = []
    for (d, k), (unit, whole, _, diagonals) in found.items():
        if diagonals:
            runs = [(index.run(hs[d], x, k), x) for x in diagonals]
            run, x = max(runs)
            out.append((d, k, run, unit, max(whole, index.whole(hs[d], max(0, x), k, max(0, -x)))))
    return out


def prepared(items: DataFrame) -> DataFrame:
    """``item_id``, ``words`` (hashes) and ``weights`` (of the shingle at each word, by its rarity among all items) of every item, once each."""
    kind = dict(items.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hs = [H.hashed(H.words(t)) for t in pdf["passage"]]
            yield pd.DataFrame({"item_id": pdf["item_id"], "words": [H.signed(h) for h in hs], "shingles": [H.signed(H.shingles(h, SHINGLE)) for h in hs]})

    given = items.where("item_id is not null and length(passage) > 0").select("item_id", "passage").distinct()
    w = cut(given.mapInPandas(run, f"item_id {kind}, words array<bigint>, shingles array<bigint>").where(F.size("words") > 0))
    w = w.withColumn("copy", F.xxhash64("words"))
    pos = w.select("item_id", "copy", F.posexplode("shingles").alias("p", "s"))
    n = w.agg(F.count_distinct("item_id")).first()[0]
    rarity = pos.groupBy("s").agg(F.count_distinct("item_id").alias("df"))
    weights = pos.join(rarity, "s").groupBy("item_id", "copy").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.log1p(F.lit(n) / F.col("df")).cast("float").alias("w")))), lambda x: x["w"]).alias("weights"))  # one passage
    return w.join(weights, ["item_id", "copy"], "left").select("item_id", "words", F.coalesce("weights", F.array().cast("array<float>")).alias("weights"))


_LAST: dict = {}  # the index a Python worker built last


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, radius: int = RADIUS, item_radius: int = ITEM_RADIUS, block_words: int = 5_000_000, least: float = LEAST) -> DataFrame:
    """``item_id``, ``doc_id``, ``longest_run``, ``unit_share`` and ``item_share`` of items and the documents that hold them, whole or in part."""
    kind = {f.name: f.dataType.simpleString() for f in [*docs.schema.fields, *items.schema.fields]}
    schema = "item int, doc_id string, longest_run int, unit_share double, item_share double"
    # Ids pass Python as strings: with nulls they would become floats there.
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("length(text) > 0")
    texts = spread(texts, "doc_id")
    ready = cut(prepared(items))
    words = ready.agg(F.sum(F.size("words"))).first()[0] or 0
    n, out = -(-words // block_words), None
    empty = docs.sparkSession.createDataFrame([], f"item_id {kind['item_id']}, doc_id {kind['doc_id']}, longest_run int, unit_share double, item_share double")
    for b in range(n):
        block = [(r.item_id, np.array(r.words, np.int64).view(np.uint64), np.array(r.weights, np.float32)) for r in ready.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect()]  # about ``block_words`` words
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], block=block, name=name) -> Iterator[pd.DataFrame]:
            if name not in _LAST:
                _LAST.clear()
                _LAST[name] = ItemIndex(block, width, radius, item_radius)
            index = _LAST[name]
            for pdf in batches:
                ids = pdf["doc_id"].to_numpy()
                got = scan(pdf["text"].tolist(), index, least)
                yield pd.DataFrame([(k, ids[d], r, u, w) for d, k, r, u, w in got], columns=["item", "doc_id", "longest_run", "unit_share", "item_share"])

        ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _, _) in enumerate(block)], f"item int, item_id {kind['item_id']}")
        part = texts.mapInPandas(run, schema).join(F.broadcast(ids), "item")  # at most ``block_words`` rows, by far fewer
        part = part.select("item_id", F.col("doc_id").cast(kind["doc_id"]).alias("doc_id"), "longest_run", "unit_share", "item_share")
        out = part if out is None else out.unionByName(part)
    return (empty if out is None else out).groupBy("item_id", "doc_id").agg(F.max("longest_run").alias("longest_run"), F.max("unit_share").alias("unit_share"), F.max("item_share").alias("item_share"))
