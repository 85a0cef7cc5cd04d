"""Held-out test items that occur in a training corpus."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .words import folded, is_divided, split, spread, undivided, words

RUN = 12  # successive words of an item that make a leak
PASSAGE, STRIDE = 24, 12  # words; every run of RUN lies whole in some passage
BLOCK = 16  # items of a block, for the block maxima
GRAM = 3  # words of a term of the index
RUN_TERMS, PASSAGE_TERMS = RUN - GRAM + 1, PASSAGE - GRAM + 1
K1, B = 1.2, 0.75
SLICE = 400_000  # words that are searched together
TOGETHER = 4096  # passages whose cursors move together

#: Bytes of item texts that one index covers, and bytes of indexes that are sent to the tasks at a time.
SHARD_BYTES = 8 << 20
SENT_BYTES = 256 << 20

#: The words that begin the answer of an item.
ANSWER_MARKS = frozenset({"answer", "antwort", "réponse"})


def _windows(row: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(row, RUN_TERMS)


def _distinct_sums(terms: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Sums of ``worth`` over the last axis, in which each term counts once."""
    order = np.argsort(terms, axis=-1, kind="stable")
    ordered, worth = np.take_along_axis(terms, order, axis=-1), np.take_along_axis(worth, order, axis=-1)
    worth[..., 1:][ordered[..., 1:] == ordered[..., :-1]] = 0
    return worth.sum(axis=-1, dtype=np.float64)


class Index:
    """Inverted index of items: postings with BM25 weights, and the maxima of these by block of items.

    A term is GRAM successive words, so lists are short and few items share them. Postings are kept as sorted numbers
    ``term * n + item``, so a seek in any number of lists is one binary search. An item's threshold is the least score that
    a passage with RUN successive words of it can have; a passage's is the least that such a run of its own must score in
    any item that holds its terms. Retrieval above both loses no leak. The size is in proportion to the items' words.
    """

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        texts = [(i, words(t)) for i, t in items]
        texts = sorted((x for x in texts if len(x[1]) >= RUN), key=lambda x: x[1])  # like items share blocks
        self.ids = np.array([i for i, _ in texts], np.int64)
        self.n = n = len(texts)
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws))}
        self.n_words = len(self.vocabulary)  # also the number of an unknown word
        self.tokens = np.array([self.vocabulary[w] for _, ws in texts for w in ws], np.int32)
        sizes = np.array([len(ws) for _, ws in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.answers = np.array([next((k for k, w in enumerate(ws) if w in ANSWER_MARKS), len(ws)) for _, ws in texts], np.int64)
        if not n:
            return
        owners = np.repeat(np.arange(n), sizes)
        codes = self._codes(self.tokens)
        inside = owners[GRAM - 1 :] == owners[: len(owners) - GRAM + 1]
        self.codes, terms = np.unique(codes[inside], return_inverse=True)
        self.n_terms = len(self.codes)  # also the number of an unknown term, whose list is empty
        owners = owners[: len(inside)][inside]
        self.keys, place, tf = np.unique(terms * n + owners, return_inverse=True, return_counts=True)
        term, item = np.divmod(self.keys, n)
        df = np.bincount(term, minlength=self.n_terms)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / sizes.mean())
        self.weights = (idf[term] * tf * (K1 + 1) / (tf + norm[item])).astype(np.float32)
        self.first = np.concatenate([[0], np.cumsum(df), [len(self.keys)]]).astype(np.int32 if len(self.keys) < 1 << 31 else np.int64)
        self.upper = np.append(np.maximum.reduceat(self.weights, self.first[:-2]), [0]).astype(np.float32)
        self.lower = np.append(np.minimum.reduceat(self.weights, self.first[:-2]), [0]).astype(np.float32)

        self.thresholds = np.zeros(n, np.float32)
        ends = np.cumsum(sizes - GRAM + 1)
        for j in range(n):
            own = slice(ends[j] - sizes[j] + GRAM - 1, ends[j])
            self.thresholds[j] = _distinct_sums(_windows(terms[own]), _windows(self.weights[place[own]])).min() * (1 - 1e-5)
        self.least = float(self.thresholds.min())
        self.n_blocks = -(-n // BLOCK)
        self.block_thresholds = np.minimum.reduceat(self.thresholds, np.arange(0, n, BLOCK))
        long = df[term] > BLOCK  # a short list's greatest weight serves for its blocks
        in_block = term[long] * self.n_blocks + item[long] // BLOCK
        begins = np.flatnonzero(np.diff(in_block, prepend=-1))
        self.block_keys = in_block[begins]
        self.block_maxima = np.maximum.reduceat(self.weights[long], begins) if len(begins) else np.zeros(0, np.float32)

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for the GRAM words from each position on, the same for the same words."""
        out = np.zeros(max(len(ids) - GRAM + 1, 0), np.int64)
        for k in range(GRAM):
            out = out * (self.n_words + 1) + ids[k : len(ids) - GRAM + 1 + k]
        return out

    def _terms(self, ids: np.ndarray) -> np.ndarray:
        """The term from each position on, ``n_terms`` for one that no item holds."""
        codes = self._codes(ids)
        place = np.minimum(np.searchsorted(self.codes, codes), self.n_terms - 1)
        return np.where(self.codes[place] == codes, place, self.n_terms)

    def _passages(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where passages begin, their distinct terms and their thresholds; terms that no leak can hold are left out.

        A run that leaks has only terms of the index, and their greatest weights reach the least threshold.
        """
        known = np.concatenate([[0], np.cumsum(terms < self.n_terms)])
        worth = np.concatenate([[0.0], np.cumsum(self.upper[terms], dtype=np.float64)])
        can = known[RUN_TERMS:] - known[:-RUN_TERMS] == RUN_TERMS
        can &= worth[RUN_TERMS:] - worth[:-RUN_TERMS] >= self.least * (1 - 1e-5)
        inside = np.zeros(len(terms) + 1, np.int32)
        np.add.at(inside, np.flatnonzero(can), 1)
        np.add.at(inside, np.flatnonzero(can) + RUN_TERMS, -1)
        held = np.where(np.cumsum(inside[:-1]) > 0, terms, self.n_terms)
        some = np.concatenate([[0], np.cumsum(can)])
        starts = np.arange(0, len(terms) - PASSAGE_TERMS + 1, STRIDE)
        starts = starts[some[starts + PASSAGE - RUN + 1] > some[starts]]
        own = held[starts[:, None] + np.arange(PASSAGE_TERMS)]
        runs = np.lib.stride_tricks.sliding_window_view(own, RUN_TERMS, axis=1)
        sums = _distinct_sums(runs, self.lower[runs])
        sums[~can[starts[:, None] + np.arange(PASSAGE - RUN + 1)]] = np.inf
        least = np.maximum(sums.min(axis=1, initial=np.inf) * (1 - 1e-5), self.least)
        own.sort(axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = self.n_terms
        own.sort(axis=1)
        return starts, own[:, : max(1, int((own < self.n_terms).sum(axis=1).max(initial=0)))], least

    def _items(self, at: np.ndarray, base: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The items at cursors, n for a list that has ended."""
        return np.where(at < end, self.keys[np.minimum(at, len(self.keys) - 1)] - base, self.n)

    def _most(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The greatest weight of terms in blocks."""
        out = self.upper[term].copy()
        rows = np.flatnonzero(self.first[term + 1] - self.first[term] > BLOCK)
        if len(rows):
            wanted = term[rows] * self.n_blocks + block[rows]
            place = np.minimum(np.searchsorted(self.block_keys, wanted), len(self.block_keys) - 1)
            out[rows] = np.where(self.block_keys[place] == wanted, self.block_maxima[place], 0)
        return out

    def retrieved(self, terms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block-max WAND for many passages at once: (row of ``terms``, item) of all items that reach the item's threshold
        and the passage's (``least``).

        In each round every passage finds its pivot, the first item at which the upper bounds of the lists so far reach the
        passage's threshold. If the maxima of the pivot's block can't reach the threshold of the block, the cursors skip to
        the end of the block or to the next list's item; else they move to the pivot, which is scored.
        """
        who = np.arange(len(terms))
        base, end, at = terms * self.n, self.first[terms + 1], self.first[terms].astype(np.int64)
        item, upper = self._items(at, base, end), self.upper[terms]
        rows, items = [], []
        while len(who):
            order = np.argsort(item, axis=1, kind="stable")
            reach = np.cumsum(np.take_along_axis(upper, order, axis=1), axis=1) >= least[:, None]
            pivot = np.take_along_axis(item, np.take_along_axis(order, reach.argmax(axis=1)[:, None], axis=1), axis=1)
            alive = reach[:, -1] & (pivot[:, 0] < self.n)
            if not alive.all():
                who, terms, base, end, at, item, upper, pivot, least = (x[alive] for x in (who, terms, base, end, at, item, upper, pivot, least))
                if not len(who):
                    break
            block = pivot[:, 0] // BLOCK
            r, c = np.nonzero(item <= pivot)
            bound = np.bincount(r, self._most(terms[r, c], block[r]), minlength=len(who))
            good = bound >= np.maximum(self.block_thresholds[block], least)
            beyond = np.where(item > pivot, item, self.n).min(axis=1)
            target = np.where(good, pivot[:, 0], np.minimum((block + 1) * BLOCK, beyond))
            r, c = np.nonzero(item < target[:, None])
            at[r, c] = np.minimum(np.searchsorted(self.keys, base[r, c] + target[r]), end[r, c])
            item[r, c] = self._items(at[r, c], base[r, c], end[r, c])
            r, c = np.nonzero((item == pivot) & good[:, None])
            score = np.bincount(r, self.weights[at[r, c]], minlength=len(who))
            hit = good & (score >= np.maximum(self.thresholds[pivot[:, 0]], least))
            rows.append(who[hit])
            items.append(pivot[hit, 0])
            at[r, c] += 1
            item[r, c] = self._items(at[r, c], base[r, c], end[r, c])
        none = np.zeros(0, np.int64)
        return np.concatenate(rows or [none]), np.concatenate(items or [none])

    def verified(self, passage: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the passage and in the item at which runs of RUN equal words begin."""
        own = self.tokens[self.starts[item] : self.starts[item + 1]]
        same = own[:, None] == passage[None, :]
        high, wide = len(own) - RUN + 1, len(passage) - RUN + 1
        run = same[:high, :wide].copy()
        for k in range(1, RUN):
            run &= same[k : high + k, k : wide + k]
        inner, at = np.nonzero(run)
        return at, inner

    def found(self, ids: np.ndarray) -> dict[tuple[int, int], tuple[list, list]]:
        """Leaks in a row of word numbers, ``n_words`` for unknown ones: (passage's position, item) -> positions of runs in
        the row and in the item. The row may hold several documents with at least PASSAGE unknown words between them."""
        out: dict[tuple[int, int], tuple[list, list]] = {}
        if len(ids) < RUN or not self.n:
            return out
        ids = np.concatenate([ids, np.full(PASSAGE, self.n_words, ids.dtype)])
        starts, terms, least = self._passages(self._terms(ids))
        for a in range(0, len(starts), TOGETHER):
            rows, items = self.retrieved(terms[a : a + TOGETHER], least[a : a + TOGETHER])
            for r, item in zip(rows, items, strict=True):
                begin = int(starts[a + r])
                at, inner = self.verified(ids[begin : begin + PASSAGE], int(item))
                if len(at):
                    out[begin, int(item)] = (begin + at, inner)
        return out


def _stretch(begins: np.ndarray) -> int:
    """Words of the longest stretch that runs beginning at ``begins`` cover."""
    ends = np.flatnonzero(np.diff(begins) != 1)
    return int(np.diff(np.concatenate([[-1], ends, [len(begins) - 1]])).max()) + RUN - 1


def _leaks(index: Index, docs: list, rows: list[list[int]]) -> Iterator[tuple]:
    gap = [index.n_words] * PASSAGE
    flat: list[int] = []
    firsts = []
    for row in rows:
        firsts.append(len(flat))
        flat += row
        flat += gap
    begins = np.array(firsts)
    met: dict[tuple[int, int], list] = {}
    for (begin, item), runs in index.found(np.array(flat, np.int64)).items():
        met.setdefault((int(np.searchsorted(begins, begin + PASSAGE - 1, side="right")) - 1, item), []).append(runs)
    for (d, item), runs in met.items():
        in_doc = np.unique(np.concatenate([r[0] for r in runs]))
        covered = np.unique(np.concatenate([r[1] for r in runs])[:, None] + np.arange(RUN))
        size, answer = int(index.starts[item + 1] - index.starts[item]), int(index.answers[item])
        question = float((covered < answer).sum() / answer) if answer else None
        answered = float((covered >= answer).sum() / (size - answer)) if answer < size else None
        yield docs[d], int(index.ids[item]), _stretch(in_doc), len(covered) / size, question, answered


OUT = "item_id bigint, longest_run int, item_share double, question_share double, answer_share double"


def _scan(indexes: list[Index]):
    """A function over batches of documents: each text is split once and searched in every index."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs: list = []
            rows: list[list[list[int]]] = [[] for _ in indexes]
            held = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = folded(value.as_py())
                whole = None if is_divided(text) else split(text)
                for index, own in zip(indexes, rows, strict=True):
                    get, unknown = index.vocabulary.get, index.n_words
                    own.append([get(w, unknown) for w in (split(undivided(text, index.vocabulary)) if whole is None else whole)])
                    held += len(own[-1])
                docs.append(doc)
                if held > SLICE:
                    for index, own in zip(indexes, rows, strict=True):
                        out += _leaks(index, docs, own)
                    docs, rows, held = [], [[] for _ in indexes], 0
            for index, own in zip(indexes, rows, strict=True):
                out += _leaks(index, docs, own)
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["_doc", "item_id", "longest_run", "item_share", "question_share", "answer_share"])

    return walk


def _built(items: DataFrame, shard_bytes: int) -> DataFrame:
    """A row for each shard of the items with its index, built in tasks of their own: ``_shard``, ``_index`` (pickled)."""
    size = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))

    def build(table: pa.Table) -> pa.Table:
        index = Index(list(zip(table["_item"].to_pylist(), table["_text"].to_pylist(), strict=True)))
        return pa.table({"_shard": table["_shard"][:1], "_index": pa.array([pickle.dumps(index, protocol=5)], pa.binary())})

    placed = items.withColumn("_shard", F.pmod(F.xxhash64("_item", "_text"), F.lit(shards)))
    return staged(placed.groupBy("_shard").applyInArrow(build, "_shard bigint, _index binary"))


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    shard_bytes: int = SHARD_BYTES,
    sent_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Documents that hold at least 12 successive words of an item: doc_id, item_id, ``longest_run`` (words), ``item_share``,
    ``question_share`` and ``answer_share`` (shares of the item's words, of those before its answer and of its answer that
    lie in such runs; null where it has no such part).

    Method: a BM25 inverted index of the items with block maxima, whose terms are three successive words; every passage of
    every document (24 words, every 12) is a query of block-max WAND, which retrieves all items at or above the
    thresholds, without a limit. These are the least scores that a passage with 12 successive words of an item can have,
    so no leak is lost. Each retrieved pair is verified word for word, with the parts of question and answer it covers.

    The items are split by a hash into shards of about ``shard_bytes`` of text, whose indexes are built in tasks. Indexes
    of at most ``sent_bytes``, measured, go to the tasks at a time, which split each text once and search all of them;
    more items make further passes of that size, the result of each written before the next is sent. Documents are only
    scanned: no shuffle but for the verified rows.

    Null and empty texts and items of fewer than 12 words have no leaks (see ``searched_items``). Item ids must be bigint
    or int; rows that repeat give repeated documents one row for each id and item (the longest run). Extra columns are
    ignored.
    """
    spark = docs.sparkSession
    kept = items.select(F.col(item_id).cast("bigint").alias("_item"), F.col(item_text).alias("_text")).where("_item is not null and _text is not null")
    built = _built(kept.distinct(), shard_bytes)
    groups: list[list[int]] = []
    room = 0
    for r in built.select("_shard", F.octet_length("_index").alias("size")).orderBy("_shard").collect():
        if not groups or r["size"] > room:
            groups.append([])
            room = sent_bytes
        groups[-1].append(r["_shard"])
        room -= r["size"]
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    kind = dict(rows.dtypes)["_doc"]
    rows = spread(rows)
    found = None
    for group in groups or [[]]:
        indexes = [pickle.loads(r["_index"]) for r in built.where(F.col("_shard").isin(group)).select("_index").toLocalIterator()]
        sent = spark.sparkContext.broadcast(indexes)
        own = rows.mapInArrow(lambda batches, sent=sent: _scan(sent.value)(batches), f"_doc {kind}, {OUT}")
        if len(groups) > 1:
            own = staged(own)
            sent.destroy()
        found = own if found is None else found.unionByName(own)
    best = found.groupBy("_doc", "item_id").agg(*[F.max(c).alias(c) for c in ("longest_run", "item_share", "question_share", "answer_share")])
    return best.select(F.col("_doc").alias(doc_id), "item_id", "longest_run", "item_share", "question_share", "answer_share").withColumnRenamed("item_id", item_id)


def searched_items(items: DataFrame, leaks: DataFrame, item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """Every item with ``n_words``, ``searchable`` (it has the 12 words of a leak) and ``n_docs``, the documents that hold it.

    An id that repeats has the words of its longest text. Null texts have 0 words; null ids are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["_item", "n_words"])

    rows = items.select(F.col(item_id).cast("bigint").alias("_item"), F.col(item_text).alias("_text")).where("_item is not null")
    sizes = rows.mapInArrow(count, "_item bigint, n_words bigint").groupBy("_item").agg(F.max("n_words").alias("n_words"))
    hits = leaks.groupBy(F.col(item_id).cast("bigint").alias("_hit")).agg(F.count(F.lit(1)).alias("n_docs"))
    both = sizes.join(hits, F.col("_item") == F.col("_hit"), "left")
    return both.select(F.col("_item").alias(item_id), "n_words", (F.col("n_words") >= RUN).alias("searchable"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
