"""Repetition inside single documents: an isolation forest over rule statistics, and an exact check."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = regex.compile(r"\p{L}+")
ASCII_LETTERS = re.compile(r"[a-z]+")
SENTENCE_END = re.compile(r"[.!?\n]+")
FEATURES = ["triple_share", "pair_share", "sameness", "sentence_share", "paragraph_share", "top_pair_share"]


@dataclass(frozen=True)
class RepetitionRule:
    """``gram``: words in a run that must have occurred before. ``least_words``/``least_share``: a text
    is repetitive from that many words and that share of repeated ones on. ``trees``, ``tree_rows``:
    size of the forest. ``fit_rows``: bound on the labelled rows. ``margin``: how far the threshold is
    lowered from the lowest labelled case towards the middle of the others. ``most_normal``: share of
    the labelled rows that are no cases which may be proposed at most."""

    gram: int = 4
    least_words: int = 20
    least_share: float = 0.3
    trees: int = 100
    tree_rows: int = 256
    fit_rows: int = 16384
    margin: float = 0.25
    most_normal: float = 0.25
    seed: int = 7


def words_of(low: str) -> list[str]:
    """Unbroken runs of letters of a text in lower case."""
    return ASCII_LETTERS.findall(low) if low.isascii() else LETTERS.findall(low)


def repeated_words(words: list[str], gram: int) -> np.ndarray:
    """Which words stand in a run of ``gram`` words that already occurred, starting earlier."""
    n = len(words)
    hit = np.zeros(n, bool)
    if n <= gram:
        return hit
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    m = n - gram + 1
    # Runs are numbered exactly: fold one word at a time into a dense number of the run so far.
    code = ids[:m]
    for k in range(1, gram):
        pair = code * len(seen) + ids[k : k + m]
        code = np.unique(pair, return_inverse=True)[1]
    first = np.full(int(code.max()) + 1, m, np.int64)
    np.minimum.at(first, code, np.arange(m))
    again = np.flatnonzero(first[code] < np.arange(m))
    for k in range(gram):
        hit[again + k] = True
    return hit


def _unit_share(units: list[str]) -> float:
    """Share of the characters that lie in a unit which already occurred."""
    seen, total, twice = set(), 0, 0
    for u in units:
        u = u.strip()
        if not u:
            continue
        total += len(u)
        if u in seen:
            twice += len(u)
        seen.add(u)
    return twice / total if total else 0.0


def statistics(low: str, words: list[str]) -> tuple[float, ...]:
    """The features of one text: shares of word triples, of word pairs and of words (against the
    usual number for the length) that are not new, of characters in sentences and in lines that
    occurred before, and of words in the commonest pair. Zeros for a wordless text."""
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    pairs = Counter(zip(words, words[1:]))
    triples = len(set(zip(words, words[1:], words[2:])))
    sameness = max(0.0, 1.0 - len(set(words)) / n**0.85)  # distinct words grow as a power below 1
    top = 2.0 * max(pairs.values()) / n if pairs else 0.0
    return 1.0 - triples / max(n - 2, 1) if n > 2 else 0.0, 1.0 - len(pairs) / max(n - 1, 1) if n > 1 else 0.0, sameness, _unit_share(SENTENCE_END.split(low)), _unit_share(low.split("\n")), top


def _depth(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows in a binary tree."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


class IsolationForest:
    """Trees of random splits over bounded subsamples; arrays of (feature, cut, left, right, path)."""

    def __init__(self, rows: np.ndarray, trees: int, tree_rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.size = min(tree_rows, len(rows))
        self.trees = []
        for _ in range(trees):
            sub = rows[rng.choice(len(rows), self.size, replace=False)]
            self.trees.append(self._grow(sub, rng, int(np.ceil(np.log2(max(self.size, 2))))))

    @staticmethod
    def _grow(sub: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
        feature, cut_at, left, right, path = [], [], [], [], []

        def node(x: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a, v in ((feature, -1), (cut_at, 0.0), (left, me), (right, me), (path, depth + _depth(len(x)))):
                a.append(v)
            lo, hi = x.min(axis=0), x.max(axis=0)
            free = np.flatnonzero(hi > lo)
            if depth < limit and len(x) > 1 and len(free):
                f = int(rng.choice(free))
                c = float(rng.uniform(lo[f], hi[f]))
                below = x[:, f] <= c
                if below.any() and not below.all():
                    feature[me], cut_at[me] = f, c
                    left[me] = node(x[below], depth + 1)
                    right[me] = node(x[~below], depth + 1)
            return me

        node(sub, 0)
        return np.array(feature), np.array(cut_at), np.array(left), np.array(right), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / usual path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for feature, cut_at, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut_at[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / max(_depth(self.size), 1e-9))


@dataclass(frozen=True)
class Judge:
    """A forest and the score from which a document is proposed."""

    forest: IsolationForest
    threshold: float


def calibrate(features: np.ndarray, label: np.ndarray, rule: RepetitionRule) -> Judge:
    """The forest of one half of the labelled rows that are no cases, and the threshold.

    The threshold is the lowest score of a labelled case, lowered by ``margin`` of its distance to the
    median of the other half of the others. It is never so low that more than ``most_normal`` of
    those would be proposed: a forest that does not tell cases from others proposes none. Without a
    labelled case only what scores above all others is proposed; without others everything is.
    """
    normal = np.flatnonzero(~label)
    if not len(normal):
        rows = features if len(features) > 1 else np.zeros((2, len(FEATURES)))
        return Judge(IsolationForest(rows, rule.trees, rule.tree_rows, rule.seed), -np.inf)
    grown, other = (normal[::2], normal[1::2]) if len(normal) > 3 else (normal, normal)
    rows = features[grown] if len(grown) > 1 else np.repeat(features[grown], 2, axis=0)
    forest = IsolationForest(rows, rule.trees, rule.tree_rows, rule.seed)
    usual = forest.score(features[other])
    if not label.any():
        return Judge(forest, float(np.nextafter(usual.max(), np.inf)))
    lowest = float(forest.score(features[label]).min())
    wanted = lowest - rule.margin * (lowest - float(np.median(usual)))
    floor = float(np.quantile(usual, 1.0 - rule.most_normal))
    return Judge(forest, wanted if wanted > floor else float(np.nextafter(floor, np.inf)))


def labelled_rows(df: DataFrame, doc: str, text: str, rule: RepetitionRule) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``fit_rows`` documents, those first by a hash of their id.

    The cut-off of the hash is found from the ids alone; only the texts below it are read again. A
    row is labelled by the written rule; texts of fewer than ``least_words`` words are none.
    """
    h = F.xxhash64(F.lit(rule.seed), F.col(doc))
    first = df.select(h.alias("h")).orderBy("h").limit(rule.fit_rows).agg(F.max("h")).first()[0]
    if first is None:
        return np.empty((0, len(FEATURES))), np.empty(0, bool)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                low = t.lower() if isinstance(t, str) else ""
                words = words_of(low)
                if len(words) >= rule.least_words:
                    share = repeated_words(words, rule.gram).sum() >= rule.least_share * len(words) - 1e-9
                    out.append((*statistics(low, words), bool(share)))
            yield pd.DataFrame(out, columns=[*FEATURES, "bad"])

    near = df.where(h <= F.lit(first)).select(F.col(text).alias("text"))
    got = near.mapInPandas(kernel, ", ".join(f"{f} double" for f in FEATURES) + ", bad boolean").limit(rule.fit_rows).toPandas()
    # In an order of their own, so that the forest does not depend on how the rows were spread.
    got = got.sort_values([*FEATURES, "bad"], kind="stable").reset_index(drop=True)
    at = np.random.default_rng(rule.seed).permutation(len(got))
    return got[FEATURES].to_numpy(float)[at], got["bad"].to_numpy(bool)[at]


def repetition(df: DataFrame, doc: str, text: str, rule: RepetitionRule = RepetitionRule(), measure_all: bool = False) -> DataFrame:
    """One row per document: ``doc, words``, the features, ``anomaly``, ``proposed``, ``repeated``, ``high``.

    ``anomaly`` is the score of an isolation forest over cheap rule statistics of the whole text (see
    ``statistics``), none of which is the share that the written rule asks for. The forest is grown and
    its threshold calibrated on a bounded sample of rows labelled by that rule (``labelled_rows``,
    ``calibrate``). Documents that reach the threshold are ``proposed``; for these alone the exact
    number of ``repeated`` words is counted: words in a run of ``gram`` that already occurred,
    starting earlier. ``high`` holds for proposed documents of at least ``least_words`` words of
    which ``least_share`` are repeated, so a document that the forest does not propose is never high.
    ``repeated`` is NULL where it was not counted, unless ``measure_all`` asks for all.

    All documents are scored in one pass without a shuffle; the model is of fixed size. NULL, empty
    and wordless texts have zero words and are never high; short texts are not either. Repeated ids
    give a row each; an empty table gives no rows. Other columns are not read.
    """
    judge = calibrate(*labelled_rows(df, doc, text, rule), rule)
    schema = f"doc {df.schema[doc].dataType.simpleString()}, words int, " + ", ".join(f"{f} double" for f in FEATURES) + ", anomaly double, proposed boolean, repeated int, high boolean"

    def read(t: str | None) -> tuple[str, list[str]]:
        low = t.lower() if isinstance(t, str) else ""
        return low, words_of(low)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(len(w), statistics(low, w)) for low, w in map(read, b["text"])]  # words are not kept: texts may be long
            n, x = np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], float).reshape(-1, len(FEATURES))
            score = judge.forest.score(x)
            proposed = (score >= judge.threshold) & (n >= rule.least_words)
            repeated = [int(repeated_words(read(t)[1], rule.gram).sum()) if p or measure_all else None for t, p in zip(b["text"], proposed, strict=True)]
            share = np.array([-1.0 if r is None else float(r) for r in repeated])
            out = pd.DataFrame({"doc": b["doc"].to_numpy(), "words": n})
            out[FEATURES] = x
            yield out.assign(anomaly=score, proposed=proposed, repeated=pd.Series(repeated, dtype="Int32"), high=proposed & (share >= rule.least_share * n - 1e-9))

    return df.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInPandas(kernel, schema).withColumnRenamed("doc", doc)
