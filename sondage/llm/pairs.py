"""Broken prompt and response pairs: a multi-label linear classifier on hashed n-grams and pair features (p1).

The classifier is trained at run time on a bounded sample of sound responses (``SAMPLE`` distinct pairs, the smallest by
digest, of those that the truncation operator doesn't find cut), from which defects are made: emptied, refused, copied from the
prompt in whole or in part and altered, swapped with answers of another language or given prose of one, and cut inside a
word or statement. A fourth of them is held out to set each label's threshold: the middle of those
of the best F1, and for the two labels that are checked the one that keeps ``RECALL`` of the cases.

Features are hashed words and word pairs within lines, the final trigrams by class, and features of the pair: how much stands in
the prompt, statements, columns, the languages of both by function words, how the last line ends. Lines are read once a
worker: what a line adds to the score is kept, so a response costs one look-up a line.

The classifier alone decides ``refusal``, ``copy`` and ``language``. ``empty`` has an exact check (no letter or digit but a stand-in
for nothing) and ``truncated`` that of the truncation operator. The first label in the order of ``LABELS`` counts.

Defined results: a null or blank response is ``empty``; a response whose prompt is missing or null is compared with an
empty prompt, so it can't be ``copy`` or ``language``; repeated rows of a run give one row with the first defect that any
of them has; where there are too few sound responses to learn from, only ``empty`` and ``truncated`` come out; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm import truncation
from sondage.llm.linear import BUCKETS, LogisticModel
from sondage.llm.phrases import HITS, LANGUAGES, NOTHING, REFUSALS, WORDS
from sondage.session import checkpoint, spread, width

LABELS = ("empty", "refusal", "copy", "language", "truncated")
#: Distinct sound pairs in the training sample, those that are made from fewer by other defects of each, and the largest prompt table that is sent to all workers.
SAMPLE, LEAST, PROMPT_BYTES = 500, 300, 64 << 20
#: Labels with an exact check, the share of their held-out cases that the threshold keeps and the further logit it gives way; F1 within which other thresholds are as good as the best.
CHECKED, RECALL, MARGIN, SLACK = ("empty", "truncated"), 0.998, 1.0, 0.015
#: Lines whose features a worker keeps; above it, it forgets all, which changes no result.
KNOWN = 200_000

LINE = re.compile(r"(?i)^[\s>*•+–_-]*(?:\d+[.)]\s*)?[*_]*(entity|pk|attr|rel)\b")
PLAIN = re.compile(r"\*\*|__|^[\s>]*(?:[-*•+–]+(?:\s+|$)|[0-9]+[.)](?:\s+|$))?")
WORD = re.compile(r"\w+(?:['’]\w+)?")
TOKEN = re.compile(r"\w+|->|\S")
FENCE = re.compile(r"^\s*(?:```|~~~)")
QUOTED = re.compile(r'"[^"\n]{1,40}"|“[^”\n]{1,40}”|«[^»\n]{1,40}»')
ARROW = re.compile("→|⇒|⟶|➔")
MARK = re.compile(r"(?:\[\s*(?:cut|truncated|\.\.\.|…)\s*\]|\((?:cut|truncated)\)|<(?:cut|truncated)>|…|\.\.\.)$")
ATTR = re.compile(r"(?i)^attr\s+[^:]*[^:\s]\s*:\s*[^:\s][^:]*(?:\s*:\s*(?:pk|fk))*$")
CARDINALITY = r"(?:[01]\.\.(?:1|n|m|\*)|1|n|m|\*|many|one)"
REL = re.compile(rf"(?i)^rel\s+.*\S\s*->\s*\S.*?\s*:\s*{CARDINALITY}\s*->\s*{CARDINALITY}\s*(?::\s*fk\s*=\s*\S.*)?$")
STAND_INS = NOTHING | {re.sub(r"\W", "", x) for x in NOTHING}
NO_HITS = np.zeros(len(LANGUAGES))


@lru_cache(1 << 17)
def coded(word: str) -> bool:
    """Identifiers and numbers."""
    return "_" in word or any(c.isdigit() for c in word)


class Lines(dict):
    """Lines by their text, as places in ``grams`` (hashes of four words in a row, or of all), ``masked`` and ``facts``: what a line adds, whatever text it stands in."""

    def __init__(self) -> None:
        self.grams: list[tuple[int, ...]] = []
        self.masked: list[str] = []
        self.facts: list[tuple[float, ...]] = []

    def __missing__(self, text: str) -> int:
        words = WORD.findall(text.lower())
        codes = [coded(w) or len(w) > 24 for w in words]
        hits, said = NO_HITS, 0
        model = LINE.match(text)
        if (not model or text.rstrip().endswith(".")) and text.count(",") * 3 < len(words) + 3:
            prose = [w for w in WORD.findall(unicodedata.normalize("NFC", QUOTED.sub(" ", text)).lower().replace("’", "'")) if not coded(w)]
            said = len(prose)
            hits = sum((HITS[w] for w in prose if w in HITS), NO_HITS)
        size = min(4, len(words))
        self.grams.append(tuple(map(hash, zip(*(words[i:] for i in range(size)), strict=False))) if len(words) > 1 else ())
        self.masked.append(" ".join(["#" if c else w for w, c in zip(words, codes, strict=True)]))
        self.facts.append((len(words), sum(map(len, words)), bool(model and "<" not in text), sum(map(coded, words)), bool(FENCE.match(text)), said, *hits))
        self[text] = len(self.facts) - 1
        return len(self.facts) - 1


@lru_cache(1 << 16)
def line_buckets(masked: str) -> np.ndarray:
    """Hashed words and word pairs of a line, identifiers masked."""
    words = masked.split(" ") if masked else []
    return np.array([crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words] + [crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) % BUCKETS for a, b in zip(words, words[1:], strict=False)], np.int32)


def _flat(text: str) -> str:
    return " ".join(text.lower().split()).lstrip("> ")


class Prompt(dict):
    """What a response is compared with; by line, the words of it that stand in the prompt."""

    def __init__(self, text: str, lines: Lines) -> None:
        words = WORD.findall(text.lower())
        self.grams = {hash(tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1)}
        self.lines = sorted({_flat(x) for x in text.split("\n")})
        self.read = lines
        hits = np.sum([lines.facts[lines[x]][6:] for x in text.split("\n")], 0)
        self.asked = int(hits.argmax()) if hits.max() > 0 else -1

    def __missing__(self, at: int) -> int:
        """The words of a line that stand in the prompt, four in a row or the whole line."""
        grams = self.read.grams[at]
        if self.grams.isdisjoint(grams):
            self[at] = 0
        else:
            words = int(self.read.facts[at][0])
            size, inside = min(4, words), bytearray(words)
            for i, gram in enumerate(grams):
                if gram in self.grams:
                    inside[i : i + size] = b"\1" * size
            self[at] = sum(inside)
        return self[at]

    def goes_on(self, last: str) -> bool:
        """Whether a line of the prompt begins with this one and goes on."""
        at = bisect_right(self.lines, last)
        return bool(last) and at < len(self.lines) and self.lines[at].startswith(last) and (at == 0 or self.lines[at - 1] != last)


def _begun(body: str, word: str) -> bool:
    """Whether a word of the text goes on where the last one ends, and the last one stands nowhere else."""
    low, begun = body.lower(), False
    at, end = low.find(word), len(low) - len(word)
    while -1 < at < end:
        after = low[at + len(word)]
        if at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_"):
            if not (after.isalnum() or after == "_"):
                return False
            begun = True
        at = low.find(word, at + 1)
    return begun


class Reader:
    """Reads pairs into features; keeps lines and prompts."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.lines, self.prompts, self.facts = Lines(), {}, np.empty((0, 6 + len(LANGUAGES)))

    def prompt(self, text: str | None) -> Prompt:
        if text not in self.prompts:
            self.prompts[text] = Prompt(text or "", self.lines)
        return self.prompts[text]

    def read(self, pairs: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lines of all texts in a row, the text of each, four hashed features of each text's end, and the dense features."""
        ids, sizes, ends, own = [], [], [], []
        for text, prompt in pairs:
            body, asked = (text or "").rstrip(), self.prompt(prompt)
            whole = [x for x in body.replace("\r", "\n").split("\n") if x and not x.isspace()]
            at = list(map(self.lines.__getitem__, whole))
            ids += at
            sizes.append(len(at))
            end, facts = self._end(body, whole[-1] if whole else "", asked)
            ends.append(end)
            own.append((sum(map(asked.__getitem__, at)), asked.asked, *facts))
        ids, sizes, own = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(own, np.float64).reshape(len(pairs), -1)
        row = np.repeat(np.arange(len(pairs)), sizes)
        if len(self.facts) < len(self.lines.facts):
            self.facts = np.concatenate([self.facts, self.lines.facts[len(self.facts) :]])
        facts = self.facts[ids]
        total = np.stack([np.bincount(row, facts[:, k], len(pairs)) for k in range(6 + len(LANGUAGES))], 1)
        return ids, row, np.array(ends, np.int32).reshape(len(pairs), 4), self._dense(total, own)

    @staticmethod
    def _end(body: str, line: str, asked: Prompt) -> tuple[tuple[int, ...], tuple[float, ...]]:
        """Hashed final trigrams, by word and by class, and what the last line looks like."""
        marked = MARK.search(body) if body.endswith(("]", ")", ">", "…", "...")) else None
        last = PLAIN.sub("", ARROW.sub("->", (MARK.sub("", line) if marked else line).strip())).strip()
        keyword = KEYWORD.match(last)
        tokens = ["^", "^", *TOKEN.findall(last.lower())] if last else ["^", "^", "^"]
        kinds = ["#" if coded(t) else t if t in WORDLESS or not t[0].isalnum() else "w" for t in tokens[-3:]]
        begun = bool(last) and tokens[-1][0].isalnum() and _begun(body, tokens[-1])
        complete = bool(keyword) and bool(ATTR.match(last) or REL.match(last))
        final, kind = body[-1:], keyword[1].lower() if keyword else ""
        ends = (_hash("3", *kinds[:2], tokens[-1]), _hash("k", *kinds), _hash("2", kinds[1], tokens[-1]), _hash("c", kind, "w" if final.isalnum() else final))
        return ends, (
            marked is not None, final != "" and final in ".!?", final != "" and final in ",:;-", final != "" and final in "`~", bool(keyword), complete, begun, complete and kind == "attr" and tokens[-1] not in TYPES,
            asked.goes_on(_flat(last)), final.isalnum(), len(last) < 4, content_free(body) if len(body) < 200 else False,
        )

    @staticmethod
    def _dense(total: np.ndarray, own: np.ndarray) -> np.ndarray:
        words, letters, statements, columns, fences, said = total[:, :6].T
        hits, asked = total[:, 6:], own[:, 1].astype(int)
        covered, marked, stop, comma, tick, keyword, complete, begun, odd_type, goes_on, alnum, short, free = own[:, [0, *range(2, 14)]].T
        known = asked >= 0
        at = np.arange(len(total))
        mine = np.where(known, hits[at, np.maximum(asked, 0)], 0)
        others = hits.copy()
        others[at, np.maximum(asked, 0)] = 0
        other = np.where(known, others.max(1, initial=0), 0)
        copied = covered / np.maximum(1, words)
        log = np.log1p
        few, foreign = statements < 2, other > 1.5 * mine + 1
        return np.stack([
            log(words), words == 0, words < 4, log(letters), free, letters == 0, log(statements), statements == 0, few,
            copied, copied * few, copied >= 0.4, (copied >= 0.4) * few, (copied < 0.4) * (statements == 0) * (words > 0),
            log(mine), log(other), log(other) - log(mine), foreign, foreign * (said > 4), log(columns), columns < 2, (columns < 2) * (statements == 0) * (copied < 0.4) * (words > 0),
            fences % 2, marked, stop, comma, tick, keyword * (1 - complete), complete, complete * begun, begun, odd_type,
            goes_on * (copied >= 0.4), (1 - keyword) * alnum * (statements > 0), short, (said > 0) * (1 - np.maximum(stop, tick)) * (1 - keyword),
        ], 1).astype(np.float64)


KEYWORD = re.compile(r"(?i)(entity|pk|attr|rel)\b")
WORDLESS = frozenset(("entity", "pk", "attr", "rel", "fk", "one", "many", "n", "m"))
TYPES = frozenset("integer int bigint decimal numeric float date datetime timestamp time varchar text string char boolean pk fk".split())


@lru_cache(1 << 16)
def _hash(*parts: str) -> int:
    return crc32("\1".join(("end", *parts)).encode("utf-8", "surrogatepass")) % BUCKETS


def content_free(text: str | None) -> bool:
    """Exact check of ``empty``: no letter or digit but a stand-in for nothing."""
    bare = re.sub(r"[\W_]+", "", (text or "").lower())
    return not bare or bare in STAND_INS or bool(re.fullmatch(r"\W*(?:```|~~~)\w*\s*(?:```|~~~)?\W*", text or ""))


def _pick(rng: np.random.Generator, options):  # noqa: ANN001, ANN202
    return options[int(rng.integers(len(options)))]


def _visible_cut(text: str, rng: np.random.Generator) -> str | None:
    """The text cut inside a word or statement, or nothing if the place is none."""
    at = int(rng.integers(max(2, len(text) // 6), max(3, len(text) - 1)))
    before, after = text[at - 1 : at], text[at : at + 1]
    inside = before.isalnum() and (after.isalnum() or after == "_")
    if inside or (before in ":=>," and after not in "\n") or (before == " " and after.isalnum()):
        return text[:at].rstrip() or None
    return None


def made_defects(sound: list[tuple[str, str]], rng: np.random.Generator) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Pairs and their labels (pairs x labels): the sound ones and defects made of them."""
    reader = Reader()
    pairs, labels = [], []

    def add(text: str, prompt: str, *names: str) -> None:
        pairs.append((text, prompt))
        labels.append([label in names for label in LABELS])

    by_language: dict[int, list[str]] = {}
    for text, prompt in sound:
        by_language.setdefault(reader.prompt(prompt).asked, []).append(text)
    blanks = ["", " ", "\n\n", "```\n```", "~~~\n~~~", "-", "—", "?", "...", "**", "# ", "[]", "{}", '""', "﻿", "​", *sorted(NOTHING), "(empty)", "<null>", "NULL", "None."]
    for text, prompt in sound:
        asked = reader.prompt(prompt).asked
        own = LANGUAGES[asked] if asked >= 0 else "en"
        add(text, prompt)
        lines = text.split("\n")
        if len(lines) > 4:  # cut between lines: nothing shows
            kept = lines[: int(rng.integers(3, len(lines)))]
            if re.match(r"(?i)[\s*•-]*(?:attr\b.*:|rel\b.*:)", kept[-1]) and "```" not in text and "~~~" not in text:
                add("\n".join(kept), prompt)
        for _ in range(2):
            cut = _visible_cut(text, rng)
            if cut:
                add(cut + (_pick(rng, ["...", "…", " [cut]", " (truncated)"]) if rng.random() < 0.15 else ""), prompt, "truncated")
        if rng.random() < 0.8:
            add(_pick(rng, blanks), prompt, "empty")
        lang = own if rng.random() < 0.6 else _pick(rng, LANGUAGES)
        opening, core, more = (_pick(rng, part) for part in REFUSALS[lang])
        refusal = f"{opening} {core}{more}".strip()
        if rng.random() < 0.3:
            refusal += " " + _pick(rng, REFUSALS[lang][1]).capitalize() + "."
        refusal = refusal[:1].upper() + refusal[1:]
        add(refusal, prompt, "refusal", *(["language"] if lang != own and len(refusal.split()) > 6 else []))
        asks = prompt.split("\n")
        start, end = sorted(rng.integers(0, len(asks) + 1, 2))
        part = "\n".join(asks[start:end] if end - start > 1 else asks)
        part = _pick(rng, [part, part.upper(), part.lower(), "\n".join("> " + x for x in part.split("\n")), " ".join(part.split()), part.title()])
        if rng.random() < 0.3:
            part = part[: max(20, int(len(part) * rng.uniform(0.4, 0.98)))]
        add(part, prompt, "copy")
        if asked < 0:
            continue
        foreign = _pick(rng, [x for x in LANGUAGES if x != own])
        said = " ".join(_pick(rng, WORDS[foreign]) if rng.random() < 0.7 else _pick(rng, ("order", "model", "table", "attribute", "form", "plan")) for _ in range(int(rng.integers(5, 50)))).capitalize() + "."
        body = "\n".join(x for x in lines if LINE.match(x))
        add(f"{said}\n\n{body}" if rng.random() < 0.6 else said, prompt, "language")
        near = " ".join(_pick(rng, WORDS[own]) for _ in range(int(rng.integers(5, 50)))).capitalize() + "."
        add(f"{near}\n\n{body}", prompt)
        others = [x for k, texts in by_language.items() if k >= 0 and k != asked for x in texts[:20]]
        if others:
            swapped = _pick(rng, others)
            spoken = np.sum([reader.lines.facts[reader.lines[x]][6:] for x in swapped.split("\n")], 0)
            if spoken.max() >= 4 and spoken.argmax() != asked:
                add(swapped, prompt, "language")
    return pairs, np.array(labels, np.float64).reshape(-1, len(LABELS))


def best_threshold(logits: np.ndarray, positive: np.ndarray) -> float:
    """The middle of the logits whose F1 is the best or nearly so."""
    if not positive.any():
        return np.inf
    order = np.argsort(-logits)
    hit = np.cumsum(positive[order])
    f1 = 2 * hit / (np.arange(1, len(hit) + 1) + positive.sum())
    good = np.flatnonzero(f1 >= f1.max() - SLACK)
    return float((logits[order[good[0]]] + logits[order[good[-1]]]) / 2)


class Classifier:
    """The fitted model with a threshold for each label."""

    def __init__(self, sample: list[tuple[str | None, str | None]], seed: int = 7) -> None:
        reader = Reader()
        sound = []
        for text, prompt in sample:
            asked = reader.prompt(prompt)
            ids = [reader.lines[x] for x in text.rstrip().replace("\r", "\n").split("\n") if x.strip()]
            words, _, statements, _, fences, _, *hits = np.sum([reader.lines.facts[i] for i in ids] or [(0,) * (6 + len(LANGUAGES))], 0)
            if statements >= 4 and sum(asked[i] for i in ids) < 0.3 * words and (max(hits) < 1.5 or int(np.argmax(hits)) == asked.asked) and fences % 2 == 0:
                sound.append((text, prompt or ""))
        self.model, self.thresholds, self.held = None, np.full(len(LABELS), np.inf), {}
        sound = (sound * (1 + LEAST // max(1, len(sound))))[: max(LEAST, len(sound))] if len(sound) >= 5 else []
        pairs, labels = made_defects(sound, np.random.default_rng(seed))
        if pairs:
            hashed, dense = features(pairs)
            held = np.arange(len(pairs)) % 4 == 3
            kept, out = np.flatnonzero(~held), np.flatnonzero(held)
            self.model = LogisticModel(len(LABELS), dense.shape[1]).fit([hashed[i] for i in kept], dense[kept], labels[kept], steps=100)
            logits = self.model.logits([hashed[i] for i in out], dense[out])
            for k in range(len(LABELS)):
                hit = labels[out, k] > 0
                self.thresholds[k] = best_threshold(logits[:, k], hit)
                if LABELS[k] in CHECKED and hit.any():
                    self.thresholds[k] = float(np.quantile(logits[hit, k], 1 - RECALL)) - MARGIN
            passed = logits >= self.thresholds
            for k, label in enumerate(LABELS):
                both = (passed[:, k] & (labels[out, k] > 0)).sum()
                self.held[label] = (both / max(1, labels[out, k].sum()), both / max(1, passed[:, k].sum()))


def features(pairs: list[tuple[str | None, str | None]]) -> tuple[list[np.ndarray], np.ndarray]:
    reader = Reader()
    ids, row, ends, dense = reader.read(pairs)
    own = np.split(ids, np.searchsorted(row, np.arange(1, len(pairs))))
    return [np.concatenate([*(line_buckets(reader.lines.masked[i]) for i in at), end]).astype(np.int32) for at, end in zip(own, ends, strict=True)], dense


class Judge:
    """Labels of pairs by one classifier; what a line adds to the score is kept by line."""

    def __init__(self, classifier: Classifier) -> None:
        self.classifier, self.reader = classifier, Reader()
        self.own, self.by_mask = np.empty((0, len(LABELS) + 1)), {}

    def _mask(self, masked: str) -> np.ndarray:
        found = self.by_mask.get(masked)
        if found is None:
            buckets = line_buckets(masked)
            found = self.by_mask[masked] = np.append(self.classifier.model.weights[buckets].sum(0), len(buckets))
        return found

    def logits(self, texts: list[str | None], prompts: list[str | None]) -> np.ndarray:
        model = self.classifier.model
        if len(self.reader.lines) > KNOWN:
            self.reader.reset()
            self.own, self.by_mask = self.own[:0], {}
        ids, row, ends, dense = self.reader.read(list(zip(texts, prompts, strict=True)))
        if len(self.own) < len(self.reader.lines):
            self.own = np.concatenate([self.own, [self._mask(x) for x in self.reader.lines.masked[len(self.own) :]]])
        score = np.stack([np.bincount(row, self.own[ids, k], len(texts)) for k in range(len(LABELS) + 1)], 1)
        hashed = (score[:, :-1] + model.weights[ends].sum(1)) / np.sqrt(score[:, -1:] + ends.shape[1])
        return hashed + ((dense - model.center) / model.scale) @ model.dense + model.bias

    def labels(self, texts: list[str | None], prompts: list[str | None]) -> list[str | None]:
        """The first label that passes; ``truncated`` is still to be checked."""
        if not texts:
            return []
        if self.classifier.model is None:
            return ["empty" if content_free(t) else "truncated" for t in texts]
        passed = self.logits(texts, prompts) >= self.classifier.thresholds
        out: list[str | None] = []
        for text, prompt, own in zip(texts, prompts, passed, strict=True):
            if not (text or "").strip() or (own[0] and content_free(text)):
                out.append("empty")
                continue
            own = own & [False, True, bool(prompt), bool(prompt), True]
            out.append(LABELS[int(own.argmax())] if own.any() else None)
        return out


def training_sample(raw: DataFrame, prompts: DataFrame, cut: DataFrame, size: int = SAMPLE) -> list[tuple[str, str]]:
    """``size`` distinct responses at most that aren't known as cut, with their prompts, the smallest by digest."""
    sound = raw.where("response_text is not null and run_id is not null").select("run_id", F.xxhash64("prompt_file", "response_text").alias("digest")).join(cut, "run_id", "left_anti")
    chosen = [r[0] for r in sound.groupBy("digest").agg(F.min("run_id").alias("run_id")).orderBy("digest").limit(size).select("run_id").collect()]
    few = raw.where(F.col("run_id").isin(chosen) & F.col("response_text").isNotNull()).select("prompt_file", "response_text").distinct().orderBy(F.xxhash64("prompt_file", "response_text"), "response_text", "prompt_file")
    return [(r[0], r[1]) for r in few.join(prompts, "prompt_file", "left").select("response_text", "prompt_text").collect()]


def label_responses(raw: DataFrame, prompts: DataFrame, cut: DataFrame) -> DataFrame:
    """(run_id, defect) of the rows that the classifier passes, ``truncated`` still unchecked."""
    spark = raw.sparkSession
    classifier = spark.sparkContext.broadcast(Classifier(training_sample(raw, prompts, cut)))
    rows = spread(raw.select("run_id", "prompt_file", "response_text").where("run_id is not null"))
    if width(prompts) <= PROMPT_BYTES:
        known = spark.sparkContext.broadcast({r[0]: r[1] for r in prompts.collect()})
    else:
        known, rows = None, rows.join(prompts, "prompt_file", "left").select("run_id", "prompt_text", "response_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(classifier.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                asked = batch.column(1).to_pylist()
                asked = [known.value.get(x) for x in asked] if known else asked
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge.labels(batch.column(2).to_pylist(), asked), pa.string())], ["run_id", "defect"])

    return rows.mapInArrow(run, "run_id string, defect string").where("defect is not null")


def broken_pairs(raw: DataFrame, prompts: DataFrame) -> DataFrame:
    """(run_id, defect): every defective run once, with the first defect that applies."""
    asked = prompts.groupBy("prompt_file").agg(F.min("prompt_text").alias("prompt_text"))
    cut = checkpoint(truncation.truncated_runs(raw, asked))
    labels = label_responses(raw, asked, cut)
    checked = labels.join(cut.withColumnRenamed("run_id", "cut_id"), F.col("run_id") == F.col("cut_id"), "left").where("defect != 'truncated' or cut_id is not null")
    order = F.array_position(F.array(*map(F.lit, LABELS)), F.col("defect"))
    return checked.groupBy("run_id").agg(F.min_by("defect", order).alias("defect"))
