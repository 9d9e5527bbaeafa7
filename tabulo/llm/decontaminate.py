"""Benchmark decontamination (operator 1): BM25 inverted index of the test items, searched with block-max
WAND by every passage of every document.

Items are the indexed documents; a passage (overlapping windows of words, twice the longest item, so that
every item fits whole into one) is a query of its distinct words.  An item's impacts are divided by the
score that the item gives itself, so one THRESHOLD holds for all.  Every item over the threshold is
retrieved; there is no top-k.  A passage whose words cannot add up to the threshold is passed over by one
running sum.  Retrieved pairs are then verified on word sequences: the share of the question's GRAM-word
runs, and of the answer's ANSWER_GRAM-word runs, that the passage contains.  The answer is an item's last line, or
its last sentence if it has one line; an item of one sentence is all question.

The index is built from at most SHARD_BYTES of item texts at a time and broadcast; more items make more
shards, each with its own pass, with the statistics and the longest item of all items, so the shards change no
result.  Documents are never shuffled.

Edge cases: null or empty texts and items match nothing; items with equal text are found each; repeated rows
and null ids of documents are reported per row; words are runs of letters, digits and underscores, lower case;
other columns are ignored here and kept by remove_contaminated.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK = 32
#: neighbouring items that share one bound before the search
AREA = 4
GRAM, ANSWER_GRAM = 5, 3
OVERLAP = 0.5
SHARD_BYTES = 8 << 20
MIN_PASSAGE = 64
WORD = r"\w+"
_words = re.compile(WORD).findall


def parts(item: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    lines = [x for x in item.lower().split("\n") if _words(x)]
    if len(lines) < 2:
        lines = [x for x in re.split(r"(?<=[.!?])\s+", item.lower()) if _words(x)]
    if len(lines) < 2:
        return _words(item.lower()), []
    return _words("\n".join(lines[:-1])), _words(lines[-1])


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


class Index:
    """Postings of one shard, by term: item numbers and impacts, with the largest impact of each block."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, mean_len: float, doc_freq: dict[str, int], longest: int = 0):
        """longest: words of the longest item of all shards (0: of these items)."""
        self.ids = [i for i, _ in items]
        self.parts = [parts(t) for _, t in items]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for number, (q, a) in enumerate(self.parts):
            tf = Counter(q + a)
            norm = K1 * (1 - B + B * sum(tf.values()) / max(mean_len, 1e-9))
            impact = {w: np.log1p((n_items - doc_freq[w] + 0.5) / (doc_freq[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in tf.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                postings[w].append((number, x / own))
        self.term = {w: i for i, w in enumerate(postings)}
        self.items = [[n for n, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.blocks = [[max(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = np.array([max(x) for x in self.blocks] + [0.0])  # the last is for words outside the index
        # the largest impact of each term in each area of items, term after term
        areas = []
        for p in postings.values():
            most: dict[int, float] = {}
            for n, x in p:
                most[n // AREA] = max(x, most.get(n // AREA, 0.0))
            areas.append(sorted(most.items()))
        self.from_ = np.concatenate([[0], np.cumsum([len(a) for a in areas])]).astype(np.int64)
        self.area = np.array([n for a in areas for n, _ in a], np.int64)
        self.area_most = np.array([x for a in areas for _, x in a], np.float64)
        self.longest = longest or max([len(q) + len(a) for q, a in self.parts], default=0)

    def areas(self, terms: np.ndarray, threshold: float) -> list[int]:
        """Areas of which an item may reach the threshold: the terms' largest impacts there, summed."""
        first, size = self.from_[terms], self.from_[terms + 1] - self.from_[terms]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.flatnonzero(np.bincount(self.area[at], self.area_most[at]) >= threshold - 1e-9).tolist() if len(at) else []

    def search(self, terms: list[int], threshold: float, areas: list[int] | None = None) -> list[tuple[int, float]]:
        """All items whose summed impact over the distinct terms reaches the threshold; areas: where such items can be."""
        at = dict.fromkeys(terms, 0)
        heap = [(self.items[t][0], t) for t in at]
        heapq.heapify(heap)
        found = []
        while heap:
            # cursors in the order of their items, up to the pivot
            front, bound = [], 0.0
            while heap and bound < threshold:
                item, t = heapq.heappop(heap)
                front.append((item, t))
                bound += self.most[t]
            if bound < threshold:
                break
            pivot = front[-1][0]
            while heap and heap[0][0] == pivot:
                front.append(heapq.heappop(heap))
            if areas is not None:
                here = bisect_left(areas, pivot // AREA)
                if here == len(areas):
                    break
                if areas[here] * AREA > pivot:  # on to the next area that can reach the threshold
                    for _, t in front:
                        if self._seek(at, t, areas[here] * AREA) < len(self.items[t]):
                            heapq.heappush(heap, (self.items[t][at[t]], t))
                    continue
            live = [t for _, t in front if self._seek(at, t, pivot) < len(self.items[t])]
            if sum(self.blocks[t][at[t] // BLOCK] for t in live) < threshold:
                # nothing up to the end of these blocks can reach it, nor before the next cursor's item
                ends = [self.items[t][min(len(self.items[t]), (at[t] // BLOCK + 1) * BLOCK) - 1] + 1 for t in live]
                target = max(pivot + 1, min(ends + [heap[0][0] if heap else len(self.ids)]))
            else:
                score = sum(self.impacts[t][at[t]] for t in live if self.items[t][at[t]] == pivot)
                if score >= threshold:
                    found.append((pivot, score))
                target = pivot + 1
            for _, t in front:
                if self._seek(at, t, target) < len(self.items[t]):
                    heapq.heappush(heap, (self.items[t][at[t]], t))
        return found

    def _seek(self, at: dict[int, int], t: int, target: int) -> int:
        at[t] = bisect_left(self.items[t], target, at[t])
        return at[t]


def contaminated_items(text: str, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
    """(item number, score, question overlap, answer overlap, first word of the passage) of the best passage per item."""
    words = _words(text.lower())
    outside = len(index.term)
    get = index.term.get
    ids = np.fromiter((get(w, outside) for w in words), np.int64, len(words))
    reach = np.concatenate([[0.0], np.cumsum(index.most[ids])])
    stride = max(MIN_PASSAGE, index.longest)
    best: dict[int, tuple] = {}
    for start in range(0, max(1, len(words) - stride), stride):
        end = min(len(words), start + 2 * stride)
        if reach[end] - reach[start] < threshold - 1e-9:
            continue
        terms = np.unique(ids[start:end])
        terms = terms[terms < outside]
        if index.most[terms].sum() < threshold - 1e-9 or not (areas := index.areas(terms, threshold)):
            continue
        passage = words[start:end]
        for item, score in index.search(terms.tolist(), threshold, areas):
            q, a = index.parts[item]
            seen = tuple(_overlap(part, passage, n) for part, n in ((q, GRAM), (a, ANSWER_GRAM)))
            if min(seen) >= overlap and (item not in best or (score, -start) > (best[item][1], -best[item][4])):
                best[item] = (item, score, *seen, start)
    return [best[i] for i in sorted(best)]


def _overlap(part: list[str], passage: list[str], n: int) -> float:
    wanted = grams(part, n)
    return len(wanted & grams(passage, min(n, len(part)))) / len(wanted) if wanted else 1.0


HITS = "item_id bigint, score double, question_overlap double, answer_overlap double, start_word int"


def _indexes(items: DataFrame, id_: str, text: str):
    """One index after another, each of at most SHARD_BYTES of items (or one item)."""
    # as Python lower-cases and cuts; a task adds up its own words first
    rows = items.select(F.col(id_).cast("bigint").alias("i"), text_of(text).alias("t")).where(F.lower("t").rlike(r"(?U)\w"))

    def tokens(batches):
        for b in batches:
            lists = [_words(t.lower()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], names=["w"])

    lists = rows.select("t").mapInArrow(tokens, "w array<string>")
    n, mean_len, longest = lists.agg(F.count("*"), F.avg(F.size("w")), F.max(F.size("w"))).first()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0]
    shards = max(1, -(-(size or 0) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("i", "t"), F.lit(shards))
    freq = lists.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").count()
    for s in range(shards):
        own = rows.where(shard == s) if shards > 1 else rows
        texts = [(r.i, r.t) for r in own.sort("i", "t").collect()]  # about SHARD_BYTES
        words = own.select("t").mapInArrow(tokens, "w array<string>").select(F.explode("w").alias("w")).distinct()
        yield Index(texts, n, mean_len or 0.0, {r["w"]: r["count"] for r in freq.join(words, "w").collect()}, longest or 0)


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                      doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs and item that it contains: the columns `keep` of docs, then HITS."""
    spark, hits, found = docs.sparkSession, fresh(docs, "_hits"), None
    for index in _indexes(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(index)

        @F.arrow_udf(f"array<struct<{HITS.replace(' ', ':').replace(',:', ',')}>>")
        def search(texts: pa.Array) -> pa.Array:
            own = sent.value
            names = [c.split()[0] for c in HITS.split(", ")]
            kind = pa.list_(pa.struct(list(zip(names, [pa.int64(), *[pa.float64()] * 3, pa.int32()]))))
            return pa.array([[dict(zip(names, (own.ids[h[0]], *h[1:]))) for h in contaminated_items(t, own, threshold, overlap)] for t in texts.to_pylist()], kind)

        part = docs.select(*keep, F.explode(search(text_of(doc_text))).alias(hits)).select(*keep, f"{hits}.*")
        found = part if found is None else found.unionByName(part)
    return found


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                        doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without those that contain an item; a filter on each row, no join."""
    spark = docs.sparkSession
    for index in _indexes(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(index)

        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            return pa.array([not contaminated_items(t, sent.value, threshold, overlap) for t in texts.to_pylist()], pa.bool_())

        docs = docs.where(clean(text_of(doc_text)))
    return docs
