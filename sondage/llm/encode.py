"""Encoding of a corpus with a public byte-level BPE vocabulary by prefix-sharing trie traversal (p6).

Texts are split by the vocabulary's public pattern. The distinct words of each batch go, in sorted order, into a trie of
bytes, which visits it depth first: a node stands for a prefix and keeps the last token of that prefix's encoding and the
node before this token. A token ends the encoding of a prefix exactly if it is compatible with the last token of what is
left, that is, if both together encode to these two tokens; so a prefix shared by many words is encoded once, and a
word's ids are read off the chain of nodes backwards.

The trie lives in the Python worker and is emptied above a fixed size, which changes no result. There is no shuffle but
for inputs of fewer partitions than cores.

Defined results: null and empty texts have an empty list; strings that look like special tokens are ordinary text; texts
of any length are encoded whole; repeated rows give repeated results; other columns aren't read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.session import spread

#: Words and nodes at which a worker empties its trie.
MAX_WORDS, MAX_NODES = 200_000, 800_000
#: Rows of one outgoing batch.
ROWS = 2_000


def public_vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[str, str]:
    """Path of the rank file and the splitting pattern; ``folder`` defaults to the installed public vocabularies."""
    import public_tokenizers

    return (f"{folder}/{name}.tiktoken" if folder else public_tokenizers.path(f"{name}.tiktoken")), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TrieEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.spelling = {rank: token for token, rank in ranks.items()}
        self.longest: dict[bytes, int] = {}  # by the last two bytes
        for token in ranks:
            self.longest[token[-2:]] = max(self.longest.get(token[-2:], 0), len(token))
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, tuple[int, ...]] = {}
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.before = array("i", [-1]), array("i", [-1])

    def merge(self, text: bytes) -> list[bytes]:
        """Plain merging of a short text, used to tell compatible tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.spelling[left], self.spelling[right]
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def reachable(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = len(self.merge(self.spelling[token])) == 1
        return known

    def add(self, words: list[str]) -> None:
        """Inserts sorted words, going down from the prefix shared with the word before."""
        ranks, child, token, before = self.ranks, self.child, self.token, self.before
        path, last = [0], b""
        for word in words:
            text = word.encode("utf-8", "surrogatepass")
            shared = 0
            for a, b in zip(text, last, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                key = path[-1] << 8 | text[end - 1]
                node = child.get(key)
                if node is None:
                    node = child[key] = len(token)
                    for size in range(min(end, self.longest.get(text[max(0, end - 2) : end], 1)), 0, -1):
                        rank = ranks.get(text[end - size : end])
                        if rank is None:
                            continue
                        start = path[end - size]
                        if self.compatible(token[start], rank) if start else self.reachable(rank):
                            break
                    token.append(rank)
                    before.append(start)
                path.append(node)
            ids, node = [], path[-1]
            while node:
                ids.append(token[node])
                node = before[node]
            self.codes[word] = tuple(reversed(ids))
            last = text

    def encode(self, texts: list[str | None]) -> Iterator[array]:
        """The ids of each text."""
        split = [self.split(text) if text else () for text in texts]
        if len(self.codes) > MAX_WORDS or len(self.token) > MAX_NODES:
            self.clear()
        fresh = {word for words in split for word in words if word not in self.codes}
        self.add(sorted(fresh, key=lambda w: w.encode("utf-8", "surrogatepass")))
        codes = self.codes
        for words in split:
            ids = array("i")
            for word in words:
                ids.extend(codes[word])
            yield ids


_ENCODERS: dict[tuple, TrieEncoder] = {}


def _encoder(handle, pattern: str) -> TrieEncoder:
    """One encoder a worker process, so that compatible pairs stay known from task to task."""
    key = (handle.value["name"], pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = TrieEncoder(handle.value["ranks"], pattern)
    return _ENCODERS[key]


def _mapped(df: DataFrame, key: list[str], text: str, vocabulary: tuple[str, str] | None, column: Callable, schema: str) -> DataFrame:
    path, pattern = vocabulary or public_vocabulary()
    handle = df.sparkSession.sparkContext.broadcast({"name": path, "ranks": read_ranks(path)})  # a vocabulary file: about 1 MB
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(handle, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                made = column(encoder.encode(batch.column(len(key)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], made], [*key, schema.split()[0]])

    return spread(df.select(*[F.col(f"`{k}`") for k in key], F.col(f"`{text}`").cast("string"))).mapInArrow(run, f"{kinds}, {schema}")


def _lists(encoded: Iterator[array]) -> pa.Array:
    flat, offsets = array("i"), array("i", [0])
    for ids in encoded:
        flat.extend(ids)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key, ids): the token ids of every row's whole text."""
    return _mapped(df, [key], text, vocabulary, _lists, "ids array<int>")


def token_counts(df: DataFrame, key: list[str], text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(key..., n_tokens): the number of tokens of every row's whole text."""
    return _mapped(df, key, text, vocabulary, lambda encoded: pa.array([len(ids) for ids in encoded], pa.int64()), "n_tokens bigint")
