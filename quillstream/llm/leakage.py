"""Held-out texts inside a corpus, whole or in part, found by latent semantic retrieval.

Documents and items are cut into short passages of words.  TF-IDF weights over hashed features, counted on all
documents, are projected on the leading singular vectors of the corpus, which a randomised SVD finds in distributed
passes over a sample of the passages, taken from all documents alike by hash and of bounded size (sums of fixed size
leave each of a fixed number of tasks).  Passages whose latent vector has a high cosine with a passage of an item make
candidates; every passage of every document is searched against all items in blocks.  A candidate counts if
the longest common subsequence of the item's words and one stretch of the document's holds half of the item, and, where
that alone could be a likeness of style, if the stretch gives away one of the item's answers: names and numbers that
hardly any other item has.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import skew, storage

#: Passages that the singular vectors are fitted on, about, and the tasks that they are summed up in at most.
BASIS_PASSAGES, BASIS_TASKS = 32_768, 64
#: Hashed features, dimensions kept, extra directions of the randomised range finder, its passes.
FEATURES, DIMENSIONS, EXTRA, PASSES = 1 << 14, 96, 16, 2
#: Words of a passage, and between the starts of passages when searching.
PASSAGE, STEP = 24, 12
#: The least cosine of candidates.
COSINE = 0.5
#: Share of an item's words that a stretch must hold in order; from this share on no answer is asked for; items that may share an answer.
SHARE, SURE, ANSWER_ITEMS = 0.5, 0.6, 2
#: Words of a document, and items, that are checked at once.
PIECE_WORDS, COLUMNS = 4_096, 128
#: Item passages that one pass compares with; more items make more passes.
BLOCK = 8_192

_INVISIBLE = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
#: Marks of Latin, Greek and Cyrillic; all others, tried only where a script that has them occurs.
_MARKS = re.compile("[̀-ͯ]+")
_FURTHER = re.compile("[҃-\u200a\u20d0-\u20ff\u2cef-\u302f\u3099\u309a\ua66f-\uabff\ufb1e\ufe20-\ufe2f\U000101fd-\U0001e94a]")
_MORE_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x483, 0x1E94B) if unicodedata.combining(chr(c))) + "]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrt])")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>")
_WORD = re.compile(r"[^\W_]+")
#: Frequent signs that are no part of words; without them most Latin text is ASCII, whose words are cut faster.
_SIGNS = "\u2019\u2018\u201c\u201d\u00ab\u00bb\u2014\u2013\u2026\u00b7\u201e\u2039\u203a"
_ASCII = "".join(chr(c) if chr(c).isalnum() else " " for c in range(128))


def words(text: str) -> list[str]:
    """Words without what leaks are disguised by: case, accents, punctuation, line breaks, invisible characters, markup and escapes."""
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text)))
        if _FURTHER.search(text):
            text = _MORE_MARKS.sub("", text)
        for sign in _SIGNS:
            if sign in text:
                text = text.replace(sign, " ")
    text = text.casefold()
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text)


class _Ids:
    """Words to 62-bit numbers; remembers words."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, text: str | None) -> list[int]:
        import xxhash

        ws = words(text or "")
        out = list(map(self.seen.get, ws))
        if None in out:
            if len(self.seen) > 500_000:
                self.seen.clear()
            for k, w in enumerate(ws):
                if out[k] is None:
                    out[k] = self.seen[w] = xxhash.xxh64_intdigest(w) >> 2
        return out


def tokenised(texts: DataFrame, key: Column, text: Column, name: str) -> DataFrame:
    """(key, words): a table of word numbers in the shared folder, read again by every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([ids(t) for t in part.column(1).to_pylist()], pa.list_(pa.int64()))], names=["key", "words"])

    rows = skew.spread(texts.select(key.cast("long").alias("key"), text.alias("text")).where("text is not null"))
    # Words recur: a dictionary that holds a file's words takes a third of their plain size.
    return storage.staged(rows.mapInArrow(run, "key long, words array<long>"), name, options={"parquet.dictionary.page.size": str(16 << 20)})


def feature_weights(tokens: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequencies of the hashed features over all documents, and the number of passages: FEATURES numbers reach the driver."""
    n, passages = tokens.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.size("words") / PASSAGE)), F.lit(0))).first()
    feature = F.explode(F.array_distinct(F.transform("words", lambda w: w % FEATURES))).alias("f")
    df = np.zeros(FEATURES)
    for r in tokens.select(feature).groupBy("f").agg(F.count("*").alias("n")).collect():
        df[r["f"]] = r["n"]
    return np.where(df > 0, np.log((1 + n) / (1 + np.minimum(df, n))) + 0.05, np.log(1 + n)).astype(np.float32), int(passages)


def basis_sample(tokens: DataFrame, passages: int) -> DataFrame:
    """About BASIS_PASSAGES passages as rows (key, words), all of them where the corpus has no more. Whether one is taken depends on a hash of its document and place alone."""
    share = min(1.0, BASIS_PASSAGES / max(1, passages))
    chosen = F.filter(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PASSAGE).cast("int")), lambda k: F.pmod(F.xxhash64("key", k), F.lit(1 << 30)) < int(share * (1 << 30)))
    cut = F.transform(chosen, lambda k: F.slice("words", k * PASSAGE + 1, PASSAGE))
    rows = tokens.where(F.size("words") > 0).select("key", F.explode(cut).alias("words"))
    tasks = min(BASIS_TASKS, tokens.sparkSession.sparkContext.defaultParallelism)
    return storage.staged(rows.repartition(tasks, F.xxhash64("key", "words")), "basis")


def _passages(flat: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a document's passages; the last is whole words to the end."""
    n = len(flat)
    starts = np.arange(0, max(1, n - PASSAGE + step), step)
    return starts, np.minimum(starts + PASSAGE, n)


def _project(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages times basis, with the features, weights and passages of their words; passages have unit length in feature space."""
    lengths = ends - starts
    total = int(lengths.sum())
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.repeat(starts - offsets, lengths) + np.arange(total)
    feats = (flat[at] % FEATURES).astype(np.int64)
    w = weights[feats]
    norm = np.sqrt(np.maximum(np.add.reduceat(w * w, offsets), 1e-9))
    w = w / np.repeat(norm, lengths)
    return np.add.reduceat(basis[feats] * w[:, None], offsets, axis=0), feats, w, np.repeat(np.arange(len(starts)), lengths)


def _latent(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages that follow each other by STEP, half a passage: each half is summed once for the two that share it."""
    alone = np.concatenate([starts[1:] != starts[:-1] + STEP, [True]])  # the second half is no other's first
    at = np.concatenate([starts, starts[alone] + STEP])[:, None] + np.arange(STEP)
    feats = (flat[np.minimum(at, len(flat) - 1)] % FEATURES).astype(np.int64)
    w = np.where(at < np.concatenate([np.minimum(starts + STEP, ends), ends[alone]])[:, None], weights[feats], np.float32(0))
    halves, squares = np.matmul(w[:, None, :], basis[feats])[:, 0], np.einsum("ij,ij->i", w, w)
    n = len(starts)
    second = np.arange(1, n + 1)
    second[alone] = n + np.arange(int(alone.sum()))
    y = (halves[:n] + halves[second]) / np.sqrt(np.maximum(squares[:n] + squares[second], 1e-9))[:, None]
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-6)


def _chunks(batch: pa.RecordBatch, step: int, most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passages of a batch's documents, some at a time: (words of the batch, starts, ends, document row)."""
    lists = batch.column(batch.schema.get_field_index("words"))
    flat, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    starts, ends, rows = [], [], []
    for k in range(len(lists)):
        if bounds[k + 1] > bounds[k]:
            s, e = _passages(flat[bounds[k] : bounds[k + 1]], step)
            starts.append(s + bounds[k])
            ends.append(e + bounds[k])
            rows.append(np.full(len(s), k))
    if not starts:
        return
    s, e, r = np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)
    for at in range(0, len(s), most):
        yield flat, s[at : at + most], e[at : at + most], r[at : at + most]


_PIECE = 256


def _summed(tokens: DataFrame, weights: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """The sum over the sample's passages of a'(aB), or with ``gram`` of (aB)'(aB): each of at most BASIS_TASKS tasks adds up one matrix, its pieces are added by a shuffle."""
    width = basis.shape[1]
    shared = tokens.sparkSession.sparkContext.broadcast((weights, basis))  # FEATURES x width, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis = shared.value
        total = np.zeros((width if gram else FEATURES, width), np.float32)
        any_row = False
        for batch in batches:
            for flat, s, e, _ in _chunks(batch, PASSAGE):
                any_row = True
                y, feats, w, row = _project(flat, s, e, weights, basis)
                if gram:
                    total += y.T @ y
                else:
                    order = np.argsort(feats, kind="stable")
                    f = feats[order]
                    cut = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
                    total[f[cut]] += np.add.reduceat(y[row[order]] * w[order, None], cut, axis=0)
        if any_row:
            pieces = [(i, total[i : i + _PIECE].astype(np.float32).tobytes()) for i in range(0, len(total), _PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int64()), pa.array([p[1] for p in pieces], pa.binary())], names=["piece", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": pdf["piece"][:1], "data": [np.sum([np.frombuffer(b, np.float32) for b in pdf["data"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})

    out = np.zeros((width if gram else FEATURES, width))
    few = tokens.coalesce(BASIS_TASKS)
    for r in few.mapInArrow(run, "piece long, data binary").groupBy("piece").applyInPandas(add, "piece long, data binary").collect():
        part = np.frombuffer(r["data"], np.float32).reshape(-1, width)
        out[r["piece"] : r["piece"] + len(part)] = part
    shared.unpersist()
    return out


def latent_basis(tokens: DataFrame, weights: np.ndarray, seed: int = 7) -> np.ndarray:
    """FEATURES x DIMENSIONS: the leading right singular vectors of the passages, by a randomised range finder with power passes."""
    basis = np.random.default_rng(seed).standard_normal((FEATURES, DIMENSIONS + EXTRA)).astype(np.float32) / np.sqrt(FEATURES)
    for _ in range(PASSES):
        q, _r = np.linalg.qr(_summed(tokens, weights, basis, gram=False))
        basis = q.astype(np.float32)
    values, vectors = np.linalg.eigh(_summed(tokens, weights, basis, gram=True))
    return (basis @ vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)


def common_subsequence(a_places: dict[int, int], length: int, b: list[int]) -> int:
    """Length of the longest common subsequence; ``a_places`` has the bits of each word of a (length words)."""
    full = (1 << length) - 1
    s = full
    for w in b:
        u = s & a_places.get(w, 0)
        if u:
            s = ((s + u) | (s - u)) & full
    return length - s.bit_count()


class Item:
    """A held-out text ready to be compared."""

    def __init__(self, key: int, ids: list[int], shared: dict[int, int]) -> None:
        self.key, self.ids, self.n = key, ids, len(ids)
        self.set = np.array(sorted(set(ids)), np.int64)
        self.places: dict[int, int] = {}
        for k, w in enumerate(ids):
            self.places[w] = self.places.get(w, 0) | 1 << k
        self.answers = {w for w in ids if shared[w] <= ANSWER_ITEMS}
        self.reach = self.n + self.n // 4 + 8

    def held(self, doc: np.ndarray, starts: np.ndarray) -> bool:
        """Whether a stretch of the document that starts at one of ``starts`` holds the item."""
        need = int(np.ceil(self.n * SHARE))
        half, k = self.reach // 2, 0
        while k < len(starts):
            # What all stretches of a run of starts hold together bounds what each holds.
            first = int(starts[k])
            after = int(np.searchsorted(starts, first + half, side="right"))
            if common_subsequence(self.places, self.n, doc[first : first + half + self.reach].tolist()) >= need:
                for s in starts[k:after]:
                    stretch = doc[s : s + self.reach].tolist()
                    got = common_subsequence(self.places, self.n, stretch)
                    if got >= need and (got >= SURE * self.n or not self.answers or not self.answers.isdisjoint(stretch)):
                        return True
            k = after
        return False


class Bench:
    """A block of items, and which words each has."""

    def __init__(self, held_out: list[tuple[int, list[int]]], shared: dict[int, int]) -> None:
        self.items = [Item(k, ws, shared) for k, ws in held_out]
        self.vocabulary = np.unique(np.concatenate([i.set for i in self.items]))
        self.times = np.zeros((len(self.vocabulary) + 1, len(self.items)), np.int32)
        for k, item in enumerate(self.items):
            self.times[np.searchsorted(self.vocabulary, item.set), k] = [item.places[int(w)].bit_count() for w in item.set]
        self.need = np.array([int(np.ceil(i.n * SHARE)) for i in self.items])
        self.reach = np.array([i.reach for i in self.items])

    def _enough(self, at: np.ndarray, times: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The starts whose stretch has half of an item's words, in any order, each counted no more often than the item has it; stretches start at a word of the item."""
        n, k = times.shape
        # A place counts for a start at or before it, unless the stretch from there has the word often enough before it.
        order = np.argsort(at, kind="stable")
        nth = np.empty(n, np.int64)
        nth[order] = np.arange(n)
        before = nth[:, None] - times
        same = (before >= 0) & (at[order[np.maximum(before, 0)]] == at[:, None])
        here = np.arange(n)[:, None]
        first = np.maximum(np.where(same, order[np.maximum(before, 0)], -1), here - self.reach[which]) + 1
        place = (times > 0) & (first <= here)
        column = np.broadcast_to(np.arange(k), (n, k))[place] * (n + 1)
        change = np.bincount(column + first[place], minlength=k * (n + 1)) - np.bincount(column + np.broadcast_to(here, (n, k))[place] + 1, minlength=k * (n + 1))
        return (np.cumsum(change.reshape(k, n + 1), axis=1)[:, :n].T >= self.need[which]) & (times > 0)

    def given_away(self, doc: np.ndarray, which: np.ndarray, spots: np.ndarray) -> list[int]:
        """The items, of the candidates ``which``, that the document holds. It is looked at around the passages that start at ``spots``, in pieces of bounded length that overlap by the longest stretch."""
        out: list[int] = []
        widest = int(self.reach[which].max())
        cuts = np.flatnonzero(np.diff(spots) > 2 * widest + PASSAGE)
        ranges = []
        for low, high in zip(spots[np.concatenate([[0], cuts + 1])], spots[np.concatenate([cuts, [len(spots) - 1]])], strict=True):
            low, high = max(0, int(low) - widest), min(len(doc), int(high) + PASSAGE + widest)
            ranges += [(at, min(high, at + PIECE_WORDS + widest)) for at in range(low, max(low + 1, high - widest), PIECE_WORDS)]
        for low, high in ranges:
            part = doc[low:high]
            at = np.minimum(np.searchsorted(self.vocabulary, part), len(self.vocabulary) - 1)
            at = np.where(self.vocabulary[at] == part, at, len(self.vocabulary))
            # Few items have half of their words anywhere in the part.
            seen, often = np.unique(at, return_counts=True)
            some = which[np.minimum(self.times[seen[:, None], which], often[:, None]).sum(axis=0) >= self.need[which]]
            for group in np.split(some, range(COLUMNS, len(some), COLUMNS)) if len(some) else ():
                enough = self._enough(at, self.times[at[:, None], group], group)
                for k in np.flatnonzero(enough.any(axis=0)):
                    item = int(group[k])
                    if item not in out and self.items[item].held(part, np.flatnonzero(enough[:, k])):
                        out.append(item)
        return out


def item_blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[tuple[list[tuple[int, list[int]]], dict[int, int]]]:
    """Blocks of items with words, as (key, words), each of about BLOCK passages, with the number of items that hold each of its words; the driver holds one block at a time."""
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull())
    tokens = tokenised(rows, F.col(item_key), F.col(item_text), "items").where(F.size("words") > 0)
    size = tokens.agg(F.coalesce(F.sum(F.floor(F.size("words") / STEP) + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK))
    shared = tokens.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if blocks > 1:
        tokens = storage.staged(tokens.withColumn("block", F.pmod(F.xxhash64("key", "words"), F.lit(blocks)).cast("int")).repartition(min(blocks, 1024), "block"), "blocks")
        shared = storage.staged(shared, "shared")
    for b in range(blocks):
        mine = tokens.where(F.col("block") == b) if blocks > 1 else tokens
        held_out = [(r["key"], r["words"]) for r in mine.select("key", "words").collect()]
        if held_out:
            of = mine.select(F.explode("words").alias("word")).distinct()
            yield held_out, {r["word"]: r["n"] for r in shared.join(of, "word", "left_semi").collect()}


def leaks(docs: DataFrame, key: Column, text: Column, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc, item): every document with every item that it gives away.

    Null and empty texts give nothing, nor do items without a word.  Equal documents and equal items all count.  Each
    block of items is one more pass over the documents, whose results are written before the next begins.
    """
    tokens = tokenised(docs, key, text, "corpus")
    weights, passages = feature_weights(tokens)
    basis = latent_basis(basis_sample(tokens, passages), weights)
    found, waiting = None, None
    for held_out, shared in item_blocks(items, item_key, item_text):
        if waiting is not None:
            waiting = storage.staged(waiting, "leaks")
            found = waiting if found is None else found.unionByName(waiting)
        waiting = _search(tokens, weights, basis, held_out, shared)
    if waiting is None:
        return tokens.sparkSession.createDataFrame([], "doc long, item long")
    return waiting if found is None else found.unionByName(waiting)


def _search(tokens: DataFrame, weights: np.ndarray, basis: np.ndarray, held_out: list[tuple[int, list[int]]], shared: dict[int, int]) -> DataFrame:
    """Candidates of one block of items by cosine, checked in the task that found them."""
    sent = tokens.sparkSession.sparkContext.broadcast((weights, basis, held_out, shared))  # a block of items, whose size BLOCK bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis, held_out, counts = sent.value
        bench = Bench(held_out, counts)
        targets, owners = [], []
        for i, item in enumerate(bench.items):
            flat = np.array(item.ids, np.int64)
            s, e = _passages(flat, STEP)
            targets.append(_latent(flat, s, e, weights, basis))
            owners += [i] * len(s)
        targets, owners = np.concatenate(targets).T.copy(), np.array(owners)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            keys = batch.column(0).to_pylist()
            pairs, places = [], []
            for _, s, e, rows in _chunks(batch, STEP):
                near = _latent(flat, s, e, weights, basis) @ targets >= COSINE
                hit, which = np.divmod(np.flatnonzero(near), near.shape[1])
                pairs.append(np.unique(rows[hit] * len(bench.items) + owners[which]))
                places.append(np.stack([rows, s])[:, np.unique(hit)])
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            rows, spots = np.concatenate(places, axis=1) if places else np.zeros((2, 0), np.int64)
            docs_of, items_of = np.divmod(pairs, len(bench.items))
            out = []
            for r in np.unique(docs_of):
                low, high = np.searchsorted(docs_of, [r, r + 1])
                doc = flat[bounds[r] : bounds[r + 1]]
                at = spots[np.searchsorted(rows, r) : np.searchsorted(rows, r + 1)] - bounds[r]
                out += [(keys[r], bench.items[i].key) for i in bench.given_away(doc, items_of[low:high], at)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["doc", "item"])

    return tokens.mapInArrow(run, "doc long, item long")
