"""Exact BM25 top-k search with block-max WAND over inverted indexes, a shard at a time.

A shard is a slice of one partition's documents. Its index is built in the task that reads it and answers one block of
queries after the other, so documents are not shuffled; only each shard's k best for a query are, to be merged. Scores use the
statistics of all documents, so shards agree and the merge is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, slices
from .words import Words

K1, B = 1.2, 0.75
#: Documents of a shard, and of a block of its index (blocks have one upper bound for each of their terms).
SHARD, BLOCK = 16_384, 64
#: Terms in at least this share of a shard's documents have their weights in rows of a matrix, not in postings: the most
#: frequent ones, as far as the matrix has no more cells than that (64 MB).
DENSE, CELLS = 1 / 16, 1 << 23
#: A block of queries is at most so many, with so many terms in all (some 50 MB), and goes to all executors.
QUERIES, QUERY_TERMS = 8_192, 3_000_000
#: Blocks that an index answers once it is built; half their size each, as a rule, so some 200 MB of a task.
AT_ONCE = 8
#: Queries that a shard scores at once on frequent terms.
TOGETHER = 64


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text: (text, term, times), by text and then term; and the number of words of each text."""
    doc, term, times, length = [], [], [], []
    for a, b in slices(texts):
        words = Words(texts[a:b], lower=True)
        order = np.lexsort((words.hash, words.doc))
        d, t = words.doc[order], words.hash[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(first)
        doc.append(d[at] + a)
        term.append(t[at])
        times.append(np.diff(np.append(at, len(d))))
        length.append(np.diff(words.first))
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return join(doc, np.int64), join(term, np.uint64), join(times, np.int64), join(length, np.int64)


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """term (hash) and df, the number of documents with it; the row without a term has the numbers of documents (df) and words
    (words). A task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, docs_seen, words = np.empty(0, np.uint64), np.empty(0, np.int64), 0, 0
        for batch in batches:
            _, term, _, length = _counts([t or "" for t in batch.column(0).to_pylist()])
            docs_seen, words = docs_seen + len(length), words + int(length.sum())
            own, times = np.unique(term, return_counts=True)
            found, at = np.unique(np.concatenate([found, own]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(found)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *found.view(np.int64).tolist()], pa.int64()), pa.array([docs_seen, *n.tolist()], pa.int64()), pa.array([words] + [0] * len(n), pa.int64())],
            names=["term", "df", "words"],
        )

    return docs.select(text).mapInArrow(run, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """query, term, times: a row for each distinct term of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term, times, _ = _counts([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(term.view(np.int64)), pa.array(times)], names=["query", "term", "times"])

    slim = queries.select(F.col(key), F.col(text))
    return slim.mapInArrow(run, f"query {slim.schema[0].dataType.simpleString()}, term long, times long")


class Shard:
    """The inverted index of some documents: BM25 weights by term, and each term's largest weight in each block."""

    def __init__(self, texts: list[str], mean_length: float) -> None:
        self.n = len(texts)
        doc, term, times, length = _counts(texts)
        # documents of a language stand together, so that few blocks have high bounds for a query in another one
        self.number = self._alike(doc, term, length)
        place = np.empty(self.n, np.int64)
        place[self.number] = np.arange(self.n)
        weight = times * (K1 + 1) / (times + K1 * (1 - B + B * length[doc] / mean_length))
        doc = place[doc]
        order = np.lexsort((doc, term))
        self.terms, start = np.unique(term[order], return_index=True)
        self.start = np.append(start, len(term))
        self.doc, self.weight = doc[order], weight[order]
        size = np.diff(self.start)
        self.dense = np.full(len(self.terms), -1, np.int64)
        often = np.flatnonzero(size >= max(8, DENSE * self.n))
        self.blocks = -(-self.n // BLOCK)
        often = often[np.argsort(-size[often], kind="stable")][: CELLS // max(1, self.blocks * BLOCK)]
        self.dense[often] = np.arange(len(often))
        # by document for exact scores, by term and with half the digits for all documents at once
        self.exact = np.zeros((self.blocks * BLOCK, len(often)))
        for row, t in enumerate(often):
            at = slice(self.start[t], self.start[t + 1])
            self.exact[self.doc[at], row] = self.weight[at]
        self.matrix = np.ascontiguousarray(self.exact.T, np.float32)
        #: How far, at most, a sum of products in single precision is off, as a share; all that is added is positive.
        self.slack = 1e-6 + len(often) * 2.0**-23
        # postings of a term in one block are a run, with the largest weight in it
        block = self.doc // BLOCK
        of_term = np.repeat(np.arange(len(self.terms)), size)
        first = np.ones(len(block), bool)
        first[1:] = (block[1:] != block[:-1]) | (of_term[1:] != of_term[:-1])
        at = np.flatnonzero(first)
        self.run = np.append(at, len(block))
        self.bound_block = block[at]
        self.bound = np.maximum.reduceat(self.weight, at) if len(at) else self.weight
        self.bound_start = np.searchsorted(at, self.start)

    @staticmethod
    def _alike(doc: np.ndarray, term: np.ndarray, length: np.ndarray) -> np.ndarray:
        """An order of documents: by which of the most frequent terms (of some documents) they have, then by length."""
        some, times = np.unique(term[: np.searchsorted(doc, 1024)], return_counts=True)
        has = np.zeros(len(length), np.int64)
        for t in some[np.argsort(-times, kind="stable")[:12]]:
            has *= 2
            has[doc[term == t]] += 1
        return np.lexsort((length, has))

    @staticmethod
    def _spread(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of ranges, and the ranges' sizes."""
        n = stop - start
        return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n), n

    def answers(self, queries: list[tuple[object, np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """For each query (name, terms, factors) its name and what ``best`` gives; ``floor`` has a score for each, as there. Frequent
        terms are scored for TOGETHER queries at once, by a matrix product."""
        for a in range(0, len(queries), TOGETHER):
            part = queries[a : a + TOGETHER]
            factors, rare = np.zeros((len(part), len(self.matrix))), []
            for i, (_, terms, factor) in enumerate(part):
                at = np.searchsorted(self.terms, terms)
                at[at == len(self.terms)] = 0
                hit = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
                at, factor = at[hit], factor[hit]
                row = self.dense[at]
                factors[i, row[row >= 0]] = factor[row >= 0]
                rare.append((at[row < 0], factor[row < 0]))
            dense = factors.astype(np.float32) @ self.matrix
            top = dense.reshape(len(part), self.blocks, BLOCK).max(2, initial=0)
            for i, (name, _, _) in enumerate(part):
                yield name, *self.best(dense[i], top[i], factors[i], *rare[i], k, 0.0 if floor is None else floor[a + i])

    def best(self, dense: np.ndarray, top: np.ndarray, factors: np.ndarray, rare: np.ndarray, factor: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Documents with the k best scores, ties at the k-th included, and those scores; only scores above 0 count, and none below
        ``floor``, which k documents elsewhere reach.

        Every block has an upper bound: the largest score of frequent terms in it (``top``), and the sum of the other terms' largest
        weights in it. The blocks of the highest bounds are scored first; once there are k scores, only blocks whose bound
        reaches the k-th (the pivot of block-max WAND) are scored. What frequent terms give (``dense``) is off by ``slack`` at most, so
        documents that may be among the best are scored again, exactly.
        """
        place, n = self._spread(self.bound_start[rare], self.bound_start[rare + 1])
        block, factor = self.bound_block[place], np.repeat(factor, n)
        upper = (top + np.bincount(block, self.bound[place] * factor, self.blocks)) * (1 + self.slack)
        threshold = floor * (1 - 1e-9) - 1e-9
        doc, about, others, left = np.empty(0, np.int64), np.empty(0), np.empty(0), upper > 0
        step = max(4, -(-2 * k // BLOCK))
        while True:
            live = left & (upper >= threshold)
            if threshold <= 0 and step < self.blocks:  # no score is known yet
                first = np.zeros(self.blocks, bool)
                first[np.argpartition(-upper, step)[:step]] = True
                live &= first
            if not live.any():
                break
            left &= ~live
            runs = live[block]
            at, m = self._spread(self.run[place[runs]], self.run[place[runs] + 1])
            score = np.bincount(self.doc[at], self.weight[at] * np.repeat(factor[runs], m), len(dense))
            own = np.flatnonzero(np.repeat(live, BLOCK)[: self.n])
            doc, others = np.concatenate([doc, own]), np.concatenate([others, score[own]])
            about = np.concatenate([about, score[own] + dense[own]])
            if len(about) > k:
                threshold = max(threshold, np.partition(about, -k)[-k] * (1 - self.slack))
                keep = about >= threshold * (1 - self.slack)
                doc, about, others = doc[keep], about[keep], others[keep]
            if threshold <= 0:
                step = self.blocks
        keep = about > 0
        doc, score = doc[keep], others[keep] + self.exact[doc[keep]] @ factors
        kth = np.partition(score, -k)[-k] if len(score) > k else 0.0
        keep = score >= max(kth, floor) * (1 - 1e-9) - 1e-9
        return self.number[doc[keep]], score[keep]


def _order_of(keys: pa.Array) -> np.ndarray:
    """Each key's place among all in ascending order, nulls last."""
    order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place


def _cut(doc: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of a shard by rounded score and then key, which is the order of the merge: no more of it can be among the k best
    of all, however many documents tie."""
    score = np.round(score, 9)
    best = np.lexsort((place[doc], -score))[:k]
    return doc[best], score[best]


def _asked(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Queries with their terms as arrays: names, where each one's terms begin and end, terms, factors."""
    rows = rows.combine_chunks()
    names, lists = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    start = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    terms, factors = (np.array(c, kind) for c, kind in zip(lists.flatten().flatten(), (np.int64, np.float64)))
    return names, start, terms.view(np.uint64), factors


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k documents with the highest BM25 scores for each query: query, rank (from 1), the document's key, score.

    Words are lower-cased in A to Z and separated by white space; a query's repeated words count as often. A query finds only
    documents that share a word with it, so a null or empty one finds none; ties go to the smaller key. Scores are
    compared as rounded to nine decimals. Documents with a null key can be found (last among ties); queries with a null key are
    left out; repeated rows are documents of their own; empty tables give an empty table; other columns are dropped.
    """
    spark = docs.sparkSession

    stats = checkpoint(statistics(docs, text))
    n, total = (stats.filter("term IS NULL").select("df", "words").first() or (0, 0))[:2]
    mean_length = max(1.0, total / max(1, n))
    terms = query_terms(queries.filter(F.col(key).isNotNull()).dropDuplicates([key]), key, text)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(stats.select("term", "df"), "term").select("query", "term", (F.col("times") * idf).alias("factor"))
    held = checkpoint(weighted.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "factor"))).alias("t"), F.count(F.lit(1)).alias("n")))
    # blocks of queries: as many as their number and their terms ask for
    n_queries, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_blocks = max(1, -(-n_queries // (QUERIES // 2)), -(-n_terms // (QUERY_TERMS // 2)))
    blocked = checkpoint(held.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks))))
    slim = docs.select(F.col(key), F.col(text))
    kind = slim.schema[0].dataType.simpleString()
    found: DataFrame | None = None
    for first in range(0, n_blocks, AT_ONCE):
        blocks = [spark.sparkContext.broadcast(_asked(blocked.filter(F.col("block") == b).select("query", "t").toArrow())) for b in range(first, min(n_blocks, first + AT_ONCE))]

        def answer(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            # the best scores of each query in this task so far: what is below the least of them isn't among the best of all
            held = [np.zeros((len(shared.value[0]), k)) for shared in blocks]
            for batch in batches:
                for a in range(0, batch.num_rows, SHARD):
                    part = batch.slice(a, SHARD)
                    shard = Shard([t or "" for t in part.column(1).to_pylist()], mean_length)
                    place = _order_of(part.column(0))
                    for shared, best in zip(blocks, held):
                        names, start, terms, factors = shared.value
                        asked = [(i, terms[x:y], factors[x:y]) for i, (x, y) in enumerate(zip(start[:-1], start[1:]))]
                        query, doc, score = [], [], []
                        for i, d, s in shard.answers(asked, k, best.min(1, initial=np.inf)):
                            d, s = _cut(d, s, place, k)
                            if len(d):
                                best[i] = np.partition(np.concatenate([best[i], s]), -k)[-k:]
                                query.append(np.full(len(d), i))
                                doc.append(d)
                                score.append(s)
                        if query:
                            own = part.column(0).take(pa.array(np.concatenate(doc)))
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(query))), own, pa.array(np.concatenate(score))], names=["query", "doc", "score"])

        part = slim.mapInArrow(answer, f"query {kind}, doc {kind}, score double")
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
        ranked = checkpoint(part.withColumn("rank", best).filter(F.col("rank") <= k))
        found = ranked if found is None else found.union(ranked)
    return found.select("query", "rank", F.col("doc").alias(key), "score")
