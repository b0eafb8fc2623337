"""Abusive, hateful or sexual content by multiple-instance learning (p8).

A text is a bag of sentences; its probability is the noisy-or of its sentences' probabilities. The sentence model, a logistic
unit on hashed words, characters in words, word pairs and pairs of word classes, is trained from labels of whole texts only, by
the gradient of the noisy-or: the labelled samples, sentences made from general knowledge (``seeds``) as texts of one sentence,
and mixtures of both. The classes (body, harm, family, ...) carry what is learned to words that no sample has.

The corpus itself enters by one statistic over all documents: how often each feature occurs in the windows that a first model
doesn't find abusive. The final model shrinks each weight by that frequency, so that the vocabulary of the corpus can't be
mistaken for abuse; what the first model finds abusive isn't counted, however usual it is.

The noisy-or is corrected for the leak of clean sentences (the mean probability of the sentences of clean samples), so that a
thousand clean sentences don't add up to an abusive text and many weakly hostile ones do. Sentences whose own probability
passes are the offending ones.

Before features, disguises are undone: compatibility forms, invisible characters, look-alike letters, digits and signs for
letters, separated letters, repeated letters; letters hidden by asterisks leave the word's shape and the classes it may have.

Defined results: null, empty and blank texts score 0 with no sentences; ties and repeated rows score alike; texts of any
length are scored whole; only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm.linear import BUCKETS, hashed_chars, ragged, word_hash
from sondage.llm.seeds import ABUSIVE, CLASSES, CLEAN, ORDER
from sondage.session import spread

#: Labelled samples at most, the probability from which a text is reported, and the one from which a window isn't counted as the corpus's clean language.
SAMPLES, THRESHOLD, DOUBT = 20_000, 0.35, 0.3
#: Weight of the corpus's feature frequencies, in windows.
BACKING = 10_000
#: A sentence of more than LONG words is read in windows of WINDOW words, one every STEP.
LONG, WINDOW, STEP = 12, 8, 4
#: Pieces of text whose words a worker keeps; above it, it forgets all, which changes no result.
KNOWN = 200_000
#: Features: hashed ones, then one for each pair of classes.
PAIRS = len(ORDER) ** 2
FEATURES = BUCKETS + PAIRS

# Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһкмтвнгАВЕКМНОРСТХІЅЈУαοερνικτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhrABEKMHOPCTXISJYaoepvikтuABEZHIKMNOPTYX".replace("т", "t"))
SIGNS = str.maketrans("013457@$€|!", "oieastaseli")
INVISIBLE = re.compile("[​-‏‪-‮⁠-⁤﻿­᠎]")
FOREIGN = re.compile("[Ѐ-ӿͰ-Ͽ]")
SEPARATED = re.compile(r"(?<![^\W_])((?:[^\W\d_]['’]?([ .\-_·*/])(?:(?=[^\W\d_]))){2,}[^\W\d_])(?![^\W_])")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”»’)'\]*_]*\s+|[\r\n]+")
CLOSED = re.compile(r"[.!?…][\"”»’)'\]*_]*$")
TOKEN = re.compile(r"[^\W_][\w'’$@€!|*-]*[\w$*]|\w|[@$][\w@$]+")
MIXED = re.compile(r"[^\W\d_][\w$@€!|]*[\d$@€|][\w$@€!|]*|[\d$@€|]+[^\W\d_][\w$@€!|]*")
CODE = re.compile(r"[A-Za-z]{1,2}\d+|\d+[a-z]{0,2}|[0-9a-f]{6,}")
DOUBLED = re.compile(r"([^\W\d_])\1+")
TREBLED = re.compile(r"([^\W\d_])\1{2,}")
HIDDEN = re.compile(r"[^\W\d_]\*+|\*\*+[^\W\d_]")


def _plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower().replace("ß", "ss")
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _class_words() -> tuple[dict[str, int], dict[int, dict[str, int]], dict[str, int]]:
    """Whole words and beginnings (by length) with the bits of their classes, in the form without doubled letters; and the words that have doubled ones."""
    whole, begun, doubled = {}, {}, {"ass": 1 << ORDER.index("sex"), "butt": 1 << ORDER.index("sex")}
    for bit, name in enumerate(ORDER):
        for word in CLASSES[name].split():
            bare = DOUBLED.sub(r"\1", _plain(word.rstrip("*")))
            if bare in ("as", "but"):
                continue
            into = begun.setdefault(len(bare), {}) if word.endswith("*") else whole
            into[bare] = into.get(bare, 0) | 1 << bit
    return whole, begun, doubled


WHOLE, BEGUN, DOUBLE = _class_words()
ANY = "\n".join([*WHOLE, *(w for words in BEGUN.values() for w in words)])


def classes(raw: str, bare: str) -> int:
    """The bits of a word's classes."""
    bits = WHOLE.get(bare, 0) | DOUBLE.get(raw, 0)
    for size, words in BEGUN.items():
        if size <= len(bare):
            bits |= words.get(bare[:size], 0)
    return bits


@lru_cache(1 << 14)
def _hidden_classes(word: str) -> int:
    """The classes of the known words that a word with asterisks may stand for."""
    bare = DOUBLED.sub(r"\1", word.rstrip("*")) if word.count("*") > 1 else word
    shape = "".join(".{1,%d}" % (len(part) + 1) if part[0] == "*" else re.escape(part) for part in re.findall(r"\*+|[^*]+", bare)) + (".{%d,%d}" % (max(1, len(word) - len(bare) - 1), len(word) - len(bare) + 1) if len(bare) < len(word) else "")
    bits = 0
    for found in re.findall(f"(?m)^{shape}$", ANY):
        bits |= classes(found, found)
    return bits & sum(1 << ORDER.index(x) for x in ("insult", "obscene", "sex"))


def _join(found: re.Match) -> str:
    return re.sub(r"[ .\-_·*/]", "", found[0])


def undisguise(text: str) -> str:
    """The text without compatibility forms, invisible characters and look-alike letters."""
    if text.isascii():
        return text
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if FOREIGN.search(text):
        text = re.sub(r"\w+", lambda m: m[0].translate(LOOKALIKE) if re.search(r"[a-zA-Z]", m[0]) or not FOREIGN.search(m[0].translate(LOOKALIKE)) else m[0], text)
    return text


def _word(token: str) -> str:
    """A token's plain word, its class if it is an identifier or a number, or its shape if letters are hidden."""
    if "*" in token and HIDDEN.search(token):
        return "*" + _plain(token).strip("-'")
    if "_" in token or token.isdigit() or re.fullmatch(r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", token):
        return "#"
    if not CODE.fullmatch(token) and MIXED.fullmatch(token):
        token = token.rstrip("!").translate(SIGNS)
    word = re.sub(r"[^\w]", "", _plain(token))
    if not word or any(c.isdigit() for c in word):
        return "#"
    return DOUBLED.sub(r"\1", word) if TREBLED.search(word) else word


def _gram(*words: str) -> int:
    value = 0
    for word in words:
        value = (value * 0x9E3779B1 + word_hash(word)) & 0xFFFFFFFFFFFF
    return (value ^ value >> 17) % BUCKETS


class Words(dict):
    """The words of pieces of text (what stands between blanks), as ids; id 0 ends a sentence, id 1 is an identifier or number."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids: dict[str, int] = {"": 0, "#": 1}
        self.features: list[np.ndarray] = [np.empty(0, np.int32), np.array([_gram("w", "#")], np.int32)]
        self.codes, self.bits, self.single = [0, word_hash("#")], [0, 0], [False, False]
        self.known = np.empty(0, np.uint64), np.empty(0, np.int64)
        self["\0"] = [0]

    def __missing__(self, piece: str) -> list[int]:
        if piece.isalpha():
            found = [self.id(_word(piece))]
        else:
            found = [self.id(_word(token)) for token in TOKEN.findall(self._joined(piece))]
            if CLOSED.search(piece):
                found.append(0)
        self[piece] = found
        return found

    @staticmethod
    def _joined(piece: str) -> str:
        return SEPARATED.sub(_join, piece)

    def id(self, word: str) -> int:
        at = self.ids.get(word)
        if at is None:
            at = self.ids[word] = len(self.ids)
            if word[0] == "*":
                bare = word[1:]
                bits, own = _hidden_classes(bare), [_gram("hidden"), _gram("s", bare[0], str(len(bare)), bare[-1])]
            else:
                bare = DOUBLED.sub(r"\1", word)
                bits, own = classes(word, bare), [_gram("w", word)]
            self.features.append(np.concatenate([np.array(own, np.int32), hashed_chars(f"<{bare}>", (4, 5))]) if word[0] != "*" else np.array(own, np.int32))
            self.codes.append(word_hash(word))
            self.bits.append(bits)
            self.single.append(len(word) == 1 and word.isalpha())
        return at

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes and class bits of all words."""
        if len(self.known[0]) < len(self.codes):
            at = len(self.known[0])
            self.known = np.append(self.known[0], np.array(self.codes[at:], np.uint64)), np.append(self.known[1], np.array(self.bits[at:], np.int64))
        return self.known

    def read(self, text: str | None) -> list[int]:
        """The ids of a text's words; letters that stand alone, three or more in a row, are joined."""
        if not text:
            return [0]
        text = undisguise(text)
        found = self._split(text)
        alone = 0
        for i in found:
            alone = alone + 1 if self.single[i] else 0
            if alone == 3:
                return self._split(SEPARATED.sub(_join, text))
        return found

    def _split(self, text: str) -> list[int]:
        pieces = text.replace("\r", "\n").replace("\n", " \0 ").split()
        found = list(chain.from_iterable(map(self.__getitem__, pieces)))
        found.append(0)
        return found


class Windows:
    """The windows of texts: where they begin and end in ``ids``, the text of each and the bits of their classes."""

    def __init__(self, words: Words, texts: list[str | None]) -> None:
        read = [words.read(text) for text in texts]
        self.ids = np.fromiter(chain.from_iterable(read), np.int64, sum(map(len, read)))
        text = np.repeat(np.arange(len(texts)), [len(r) for r in read])
        stop = np.flatnonzero(self.ids == 0)
        begin, size = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop, np.diff(np.concatenate([[-1], stop])) - 1
        begin, size, text = begin[size > 0], size[size > 0], text[stop[size > 0]] if len(stop) else text
        count = np.where(size > LONG, -(-(size - WINDOW) // STEP) + 1, 1)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        size, begin, text = np.repeat(size, count), np.repeat(begin, count), np.repeat(text, count)
        long = size > LONG
        self.begin = begin + np.where(long, np.minimum(nth * STEP, size - WINDOW), 0)
        self.size = np.where(long, WINDOW, size)
        self.text = text
        said = np.concatenate([[0], np.cumsum(self.ids > 1)])
        keep = said[self.begin + self.size] > said[self.begin]
        self.begin, self.size, self.text = self.begin[keep], self.size[keep], self.text[keep]
        codes, bits = words.arrays()
        mixed = (codes[self.ids[:-1]] * np.uint64(0x9E3779B97F4A7C15) + codes[self.ids[1:]]) * np.uint64(0xFF51AFD7ED558CCD) if len(self.ids) > 1 else np.empty(0, np.uint64)
        self.pairs = ((mixed >> np.uint64(24)) % np.uint64(BUCKETS)).astype(np.int64)
        flat = np.arange(self.size.sum()) - np.repeat(np.cumsum(self.size) - self.size, self.size) + np.repeat(self.begin, self.size)
        self.bits = np.bitwise_or.reduceat(bits[self.ids[flat]], np.cumsum(self.size) - self.size) if len(self.size) else np.empty(0, np.int64)
        self.flat, self.row = flat, np.repeat(np.arange(len(self.size)), self.size)

    def features(self, words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat features, window and factor of each, of the kept windows."""
        own = keep[self.row]
        at, row = self.flat[own], self.row[own]
        flat, which = ragged([words.features[i] for i in self.ids[at]])
        inside = at + 1 < self.begin[row] + self.size[row]
        pairs, pair_row = self.pairs[at[inside]] if len(at) else np.empty(0, np.int64), row[inside]
        window, bit = np.nonzero(keep[:, None] & (self.bits[:, None] >> np.arange(len(ORDER)) & 1).astype(bool))
        both = [(w, a * len(ORDER) + b) for w, group in _grouped(window, bit) for a in group for b in group if a <= b]
        class_row, class_at = np.array([w for w, _ in both], np.int64), np.array([BUCKETS + c for _, c in both], np.int64)
        rows = np.concatenate([row[which], pair_row, class_row])
        factor = np.where(np.arange(len(rows)) < len(which) + len(pair_row), 1 / np.sqrt(self.size[rows]), 1.0) if len(rows) else np.empty(0)
        return np.concatenate([flat, pairs, class_at]).astype(np.int64), rows, factor


def _grouped(window: np.ndarray, bit: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    cuts = np.flatnonzero(np.diff(window)) + 1
    for group in np.split(np.arange(len(window)), cuts) if len(window) else ():
        yield int(window[group[0]]), bit[group].tolist()


def noisy_or(p: np.ndarray, bag: np.ndarray, bags: int, leak: float = 0.0) -> np.ndarray:
    """One less the product of (1 - p), corrected for what as many clean sentences would give."""
    total = np.bincount(bag, np.log1p(-np.clip(p, 0, 1 - 1e-9)) - np.log1p(-leak), bags)
    return -np.expm1(np.minimum(total, 0))


class SentenceModel:
    """Logistic window scores trained from the labels of their texts."""

    def __init__(self) -> None:
        self.weights, self.bias, self.leak = np.zeros(FEATURES, np.float64), -6.0, 0.0

    def fit(self, words: Words, texts: list[str], labels: np.ndarray, importance: np.ndarray, frequency: np.ndarray | None = None, steps: int = 200, rate: float = 0.3, decay: float = 0.05) -> SentenceModel:
        windows = Windows(words, texts)
        bag, n = windows.text, len(windows.text)
        flat, row, factor = windows.features(words, np.ones(n, bool))
        shrink = decay + (0 if frequency is None else BACKING * frequency * 0.02)
        past, past_bias = np.full(FEATURES, 1e-8), 1e-8
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, self.weights[flat] * factor, n) + self.bias, -30, 30)))
            whole = np.clip(noisy_or(p, bag, len(texts)), 1e-6, 1)
            # d loss / d logit: p for a clean text; -(1 - P) / P * p for an abusive one
            slope = np.where(labels[bag] > 0, -(1 - whole[bag]) / whole[bag] * p, p) * importance[bag]
            g = np.bincount(flat, slope[row] * factor, FEATURES) + shrink * self.weights
            past += g**2
            self.weights -= rate * g / np.sqrt(past)
            total = slope.sum()
            past_bias += total**2
            self.bias -= 0.2 * rate * total / np.sqrt(past_bias)
        self.leak = float(np.mean(p[labels[bag] == 0])) if (labels[bag] == 0).any() else 0.0
        return self


class Scorer:
    """Window scores of one model: the sum of each word's weights is kept by word, that of class pairs by set of classes."""

    def __init__(self, model: SentenceModel) -> None:
        self.model, self.words, self.own = model, Words(), np.empty(0)
        held = (np.arange(1 << len(ORDER))[:, None] >> np.arange(len(ORDER)) & 1).astype(np.float32)
        weight = np.triu(model.weights[BUCKETS:].reshape(len(ORDER), len(ORDER))).astype(np.float32)
        self.by_classes = ((held @ weight) * held).sum(1)

    def windows(self, texts: list[str | None]) -> tuple[Windows, np.ndarray]:
        """The texts' windows and their probabilities."""
        if len(self.words) > KNOWN:
            self.words.reset()
            self.own = np.empty(0)
        windows = Windows(self.words, texts)
        if len(self.own) < len(self.words.features):
            flat, row = ragged(self.words.features[len(self.own) :])
            self.own = np.concatenate([self.own, np.bincount(row, self.model.weights[flat], len(self.words.features) - len(self.own))])
        one = np.concatenate([[0], np.cumsum(self.own[windows.ids])])
        two = np.concatenate([[0], np.cumsum(self.model.weights[windows.pairs])])
        end = windows.begin + windows.size
        hashed = one[end] - one[windows.begin] + two[end - 1] - two[windows.begin] if len(end) else np.empty(0)
        logit = hashed / np.sqrt(windows.size) + self.by_classes[windows.bits] + self.model.bias
        return windows, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
        """Each text's score and its offending sentences."""
        windows, p = self.windows(texts)
        score = noisy_or(p, windows.text, len(texts), self.model.leak)
        out: list[list[str]] = [[] for _ in texts]
        for i in np.unique(windows.text[p >= THRESHOLD]).tolist():
            said = [s.strip() for s in SENTENCE.split(texts[i]) if s.strip()]
            parts, q = self.windows(said)
            out[i] = list(dict.fromkeys(said[k] for k in np.unique(parts.text[q >= THRESHOLD]).tolist()))
        return score, out


def _shaped(text: str, rng: np.random.Generator) -> str:
    """The text with letters of its longer words hidden, in one of the usual ways for each."""

    def hide(found: re.Match) -> str:
        word, way = found[0], int(rng.integers(4))
        if way == 0:
            return word
        return (word[0] + "*" * (len(word) - 1), word[0] + "*" * (len(word) - 2) + word[-1], word[:2] + "*" * max(2, len(word) - 4) + word[2 + max(2, len(word) - 4) :])[way - 1]

    return re.sub(r"[^\W\d_]{4,}", hide, text)


def training_texts(samples: list[tuple[str, int]], seed: int = 11) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and importance: the samples, the seeds alone, with letters hidden, and among clean sentences."""
    rng = np.random.default_rng(seed)
    filler = [s for text, label in samples if not label for s in SENTENCE.split(text) if s.strip()] + list(CLEAN)
    rows = [(text, label, 1.0) for text, label in samples] + [(s, 0, 1.0) for s in CLEAN] + [(s, 0, 0.3) for s in filler]
    for said, _ in ABUSIVE:
        rows.append((said, 1, 0.3))
        if rng.random() < 0.3:
            rows.append((_shaped(said, rng), 1, 0.3))
        if rng.random() < 0.3:
            around = [filler[int(i)] for i in rng.integers(0, len(filler), int(rng.integers(1, 4)))]
            around.insert(int(rng.integers(0, len(around) + 1)), said + ".")
            rows.append((" ".join(around), 1, 0.3))
    return [t for t, *_ in rows], np.array([y for _, y, _ in rows], float), np.array([w for *_, w in rows])


def train(samples: list[tuple[str, int]], frequency: np.ndarray | None = None) -> SentenceModel:
    """The sentence model; ``frequency`` has, for each feature, its occurrences a clean window of the corpus."""
    return SentenceModel().fit(Words(), *training_texts(samples), frequency=frequency)


def corpus_frequency(docs: DataFrame, model: SentenceModel) -> np.ndarray:
    """How often each feature occurs in a window of the documents that ``model`` doesn't find abusive: one aggregate over all documents to a vector of fixed size."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, found, whole = Scorer(sent.value), np.zeros(FEATURES), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                windows, p = scorer.windows(batch.column(0).slice(start, 500).to_pylist())
                clean = p < DOUBT
                whole += int(clean.sum())
                own = clean[windows.row]
                ids, used = np.unique(windows.ids[windows.flat[own]], return_counts=True)
                flat, row = ragged([scorer.words.features[i] for i in ids])
                found[:BUCKETS] += np.bincount(flat, used[row].astype(float), BUCKETS)
                at = windows.flat[own]
                inside = at + 1 < (windows.begin + windows.size)[windows.row[own]]
                found[:BUCKETS] += np.bincount(windows.pairs[at[inside]] if len(at) else np.empty(0, np.int64), minlength=BUCKETS)
                sets, times = np.unique(windows.bits[clean], return_counts=True)
                held = (sets[:, None] >> np.arange(len(ORDER)) & 1).astype(float)
                found[BUCKETS:] += np.triu((held * times[:, None]).T @ held).ravel()
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(found[at], whole), pa.float64())], ["feature", "times"])

    rows = spread(docs.where("text is not null").select("text")).mapInArrow(run, "feature bigint, times double").groupBy("feature").agg(F.sum("times").alias("times")).toPandas()
    whole = rows.loc[rows.feature == -1, "times"].sum()
    frequency = np.zeros(FEATURES)
    rows = rows[rows.feature >= 0]
    frequency[rows.feature.to_numpy()] = rows.times.to_numpy() / max(1.0, whole)
    return frequency


def labelled_samples(samples: DataFrame) -> list[tuple[str, int]]:
    """``SAMPLES`` labelled texts at most, the smallest by digest."""
    few = samples.where("text is not null and label is not null").select("text", F.col("label").cast("int").alias("label")).distinct().orderBy(F.xxhash64("text"), "text", "label").limit(SAMPLES)
    return [(r[0], r[1]) for r in few.collect()]


def score_documents(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, source, score, offending): every document's probability and its offending sentences."""
    labelled = labelled_samples(samples)
    model = docs.sparkSession.sparkContext.broadcast(train(labelled, corpus_frequency(docs, train(labelled))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                score, said = scorer.judge(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(said, pa.list_(pa.string()))], ["doc_id", "source", "score", "offending"])

    rows = spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, score double, offending array<string>")


def abuse_rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, reported documents, their share and the mean score."""
    hit = (F.col("score") >= threshold).cast("bigint")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.sum(hit).alias("reported"), F.avg(hit).alias("rate"), F.avg("score").alias("mean_score"))
