"""Toxicity scores from a learnt, weighted lexicon.

Method: texts are folded (lower case, homoglyphs to Latin letters), an
Aho-Corasick automaton finds lexicon words and exception phrases in one pass,
hits inside an exception phrase do not count, and the weighted hits are
normalised by length.  Where words mix letters with digits or signs, the
automaton also reads the text with these unfolded to letters, place by place,
so hits and exceptions of all readings meet at the same offsets.  A lexicon
entry is a word, or a stem (written with a final ``*``) that any word may begin
with; an exception is a pair of neighbouring words, one of them in the lexicon,
that clean texts hold and toxic ones do not.  Lexicon, weights, exceptions and
the curve from hits to a score are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ready

#: Labelled rows that fitting reads at most, the first by hash of their id.
TRAIN_ROWS = 20_000
#: Entries of toxic texts that are counted in clean ones, candidates, and entries of the lexicon, at most.
COMMON, CANDIDATES, LEXICON = 50_000, 2_000, 500
#: Shortest and longest stem of a lexicon entry, and longest whole word.
STEM, LONGEST = (4, 8), 32
#: Clean texts that an exception phrase must be in, and exceptions at most.
CLEAN_TEXTS, EXCEPTIONS = 3, 500
#: Characters that stand for a letter in a word with letters.
SUBSTITUTES = str.maketrans("013457@$!|", "oieastasil")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {"а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ɡ": "g", "ӏ": "l", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ⅰ": "i", "​": None, "‌": None, "‍": None, "­": None, "﻿": None}
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_WORD = re.compile(r"[^\W_]+")
# a run of letters, digits and signs from its first sign or digit on; tried where a run begins, so long runs are read once
_MIXED = re.compile(r"(?<![^\W_])(?<![@$!|])[^\W\d_]*+[0-9@$!|](?:[^\W_]|[@$!|])*+")


def fold(text: str) -> str:
    """Lower case with look-alike letters made Latin."""
    text = text.lower()
    return text if text.isascii() else text.translate(_FOLD)


def _unfolded(folded: str) -> list[tuple[int, str]]:
    """(place, letters) of words in which digits or signs stand for letters; a word may have a second reading without signs at its ends."""
    out = []
    for m in _MIXED.finditer(folded):
        word = m.group().rstrip("!|")
        inner = word.strip("$@!|")
        for form, at in {(word, m.start()), (inner, m.start() + word.find(inner))}:
            if not form.isalpha() and any(c.isalpha() for c in form):
                new = form.translate(SUBSTITUTES)
                if new.isalpha():
                    out.append((at, new))
    return out


def readings(folded: str) -> list[str]:
    """The text and, where words mix letters with digits or signs, the text with their letters in place: equally long."""
    out = [folded]
    for at, new in sorted(_unfolded(folded), key=lambda x: (x[0], -len(x[1]))):
        which = 1 if len(out) < 2 or out[1][1] <= at else 2  # the second reading of a word overlaps its first
        while len(out) <= which:
            out.append([[], 0])
        parts, end = out[which]
        if at >= end:
            parts += [folded[end:at], new]
            out[which][1] = at + len(new)
    return [folded] + ["".join(parts) + folded[end:] for parts, end in out[1:]]


@dataclass
class Model:
    """A fitted lexicon (word -> weight) and the curve from its features to a score."""

    weights: dict[str, float]
    curve: list[float]  # intercept, weight of the log of hits, weight of the log of hits per 100 words
    exceptions: tuple[str, ...] = ()
    _automaton: object = field(default=None, repr=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, list] = {}  # [weight as a word, weight as a stem, whether an exception]
            for w, x in self.weights.items():
                entries.setdefault(w.rstrip("*"), [None, None, False])[w.endswith("*")] = x
            for p in self.exceptions:
                entries.setdefault(p, [None, None, False])[2] = True
            for w, e in entries.items():
                a.add_word(w, (len(w), *e))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> float:
        """Weighted whole-word hits outside exception phrases."""
        found, spared = self.places(folded)
        for start, end in spared:
            for at in [x for x in found if start <= x <= end]:
                del found[at]
        return sum(found.values())

    def places(self, folded: str) -> tuple[dict[int, float], list[tuple[int, int]]]:
        """(start -> weight of lexicon words, ends of exception phrases) in all readings of a text."""
        a = self.automaton()
        found: dict[int, float] = {}
        spared = []
        for text in readings(folded) if len(a) else ():
            for end, (n, word, stem, exception) in a.iter(text):
                start = end - n + 1
                if start and text[start - 1].isalnum():
                    continue
                whole = not text[end + 1 : end + 2].isalnum()
                if exception and whole:
                    spared.append((start, end))
                weight = word if whole and word is not None else stem
                if weight is not None:
                    found[start] = max(weight, found.get(start, 0.0))
        return found, spared

    def phrases(self, folded: str) -> set[str]:
        """Pairs of neighbouring words, parted by one space, of which one is a hit."""
        out: set[str] = set()
        found, _ = self.places(folded)
        for text in readings(folded) if found else ():
            for at in found:
                own = _WORD.match(text, at)
                if own and (own.start() == 0 or not text[at - 1].isalnum()):
                    if text[own.end() : own.end() + 1] == " " and (after := _WORD.match(text, own.end() + 1)):
                        out.add(text[at : after.end()])
                    left = at - 1
                    if left > 0 and text[left] == " " and text[left - 1].isalnum():
                        while left and text[left - 1].isalnum():
                            left -= 1
                        out.add(text[left : own.end()])
        return {p for p in out if len(p) <= 2 * LONGEST}

    def features(self, text: str | None) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        folded = fold(text)
        x = self.hits(folded)
        return (float(np.log1p(x)), float(np.log1p(100 * x / (1 + folded.count(" ") + folded.count("\n"))))) if x else (0.0, 0.0)

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = self.curve[0] + features @ np.array(self.curve[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row's label is never used: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def entries(word: str) -> list[str]:
    """Lexicon entries that match a word: itself, where it is not too long for one, and its stems."""
    return [word][: len(word) <= LONGEST] + [*[word[:n] + "*" for n in range(STEM[0], min(STEM[1], len(word)) + 1)]]


def _entries(folded: str) -> set[str]:
    """Entries that match a word of a folded text."""
    own = {w for w in [*_WORD.findall(folded), *(w for _, w in _unfolded(folded))] if len(w) > 2}
    return {e for w in own for e in entries(w)}


def _tokens(only: frozenset[str] | None = None):
    """(word, n): texts that have an entry, of all entries or of some."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 200):
                counts = Counter()
                for text in texts[a : a + 200]:
                    own = _entries(fold(text or ""))
                    counts.update(own if only is None else own & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _matrix(words: list[str]):
    """(toxic, candidate numbers) of each labelled text."""
    number = {w: i for i, w in enumerate(words)}

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(sorted(number[w] for w in _entries(fold(text or "")) if w in number))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["toxic", "words"])

    return run


def _phrases(model: Model):
    """(toxic, phrase) of each labelled text."""

    def run(batches):
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(model.phrases(fold(text or "")))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(own), pa.int32()), pa.array(own, pa.string())], ["toxic", "phrase"])

    return run


def _features(model: Model):
    def run(batches):
        for batch in batches:
            x = np.array([model.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Intercept and weights of a ridge-penalised logistic fit, by Newton steps; weights are not negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.array([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-6), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return [float(w[0]), *[max(0.0, float(v)) for v in w[1:]]]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows that are not held out, ``rows`` of them at most.

    Only texts and toxic labels are used.  Copies of a text count once.  A word
    enters the lexicon when it is far commoner in toxic texts and marks toxic
    texts that no better word marks; so what near copies share does not enter.
    With no toxic or no clean label the lexicon is empty and every score is
    the share of toxic labels.
    """
    ready(docs.sparkSession)
    ids = labels.where(~held_out()).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")  # bounded by rows
    sample = sample.groupBy(F.xxhash64("text"), F.length("text")).agg(F.max(F.struct("toxic", "text")).alias("s")).select("s.toxic", "s.text").persist()
    try:
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        n1, n0 = n.get(1, 0), n.get(0, 0)
        prior = n1 / (n1 + n0) if n1 + n0 else 0.0
        if not n1 or not n0:
            return Model({}, [30.0 if prior else -30.0, 0.0, 0.0])
        # Entries of toxic texts first, the commonest of them; then how many clean texts have those.
        toxic = sample.where("toxic = 1").mapInArrow(_tokens(), "word string, n long").groupBy("word").agg(F.sum("n").alias("t")).where(F.col("t") >= max(3, n1 // 200))
        common = toxic.orderBy(F.desc("t"), "word").limit(COMMON).collect()
        clean = sample.where("toxic = 0").mapInArrow(_tokens(frozenset(r["word"] for r in common)), "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
        counts = docs.sparkSession.createDataFrame([(r["word"], r["t"]) for r in common], "word string, t long").join(clean, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
        top = counts.withColumn("odds", odds).where("odds >= 2").orderBy(F.desc(F.col("odds") * F.sqrt("t")), F.expr("word like '%*'"), F.desc(F.length("word")), "word").limit(CANDIDATES).collect()
        words = [r["word"] for r in top]
        texts = sample.mapInArrow(_matrix(words), "toxic int, words array<int>").where("size(words) > 0").collect()
        weights, covered = {}, [False] * len(texts)
        where: dict[int, list[int]] = {}
        for i, r in enumerate(texts):
            for w in r["words"]:
                where.setdefault(w, []).append(i)
        for w, r in enumerate(top):
            rest = [i for i in where.get(w, ()) if not covered[i]]
            toxic = sum(texts[i]["toxic"] for i in rest)
            if toxic >= 2 and 2 * toxic >= len(rest) and len(weights) < LEXICON:
                weights[r["word"]] = float(r["odds"])
                for i in rest:
                    covered[i] = True
        model = Model(weights, [0.0, 0.0, 0.0])
        seen = sample.mapInArrow(_phrases(model), "toxic int, phrase string").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        spared = seen.where((F.col("t") == 0) & (F.col("n") >= CLEAN_TEXTS)).orderBy(F.desc("n"), "phrase").limit(EXCEPTIONS).collect()
        model = Model(weights, model.curve, tuple(r["phrase"] for r in spared))
        data = sample.mapInArrow(_features(model), "toxic int, a double, b double").toPandas()
        model.curve = logistic(data[["a", "b"]].to_numpy(), data["toxic"].to_numpy().astype(float))
        model._automaton = None
        return model
    finally:
        sample.unpersist()


def _score(model: Model, threshold: float):
    def run(batches):
        own = Model(model.weights, model.curve, model.exceptions)
        for batch in batches:
            x = np.array([own.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            s = own.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score is from 0 to 1, higher where a toxic label is likelier; predicted is
    1 from ``threshold`` on.  Null and empty texts have the score of a text
    without hits.  A null doc_id is not held out.  Repeated rows score alike;
    other columns are ignored.  Scoring is one pass without a shuffle.
    """
    model = model or fit(docs, labels)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; same columns, whatever their names.

    Null and empty texts score as texts without hits; repeated rows go or stay
    together; an empty table gives an empty result.  Without a toxic or a clean
    label every row scores the share of toxic labels.
    """
    model = fit(docs, labels)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        own = Model(model.weights, model.curve, model.exceptions)
        for batch in batches:
            x = np.array([own.features(t) for t in batch.column(at).to_pylist()]).reshape(-1, 2)
            yield batch.filter(pa.array(own.scores(x) < threshold))

    return docs.mapInArrow(run, schema)
