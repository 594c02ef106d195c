"""BPE encoding and decoding with a public tokenizer's vocabulary.

Encoding finds the exact merges in linear time by backtracking: one pass of an
Aho-Corasick automaton over a pretoken finds all tokens in it, and so the
longest at each place. The next token is the longest at its place, accepted
only if it is compatible with the token before it, that is if byte-pair merging
of the two tokens' bytes would keep the boundary between them; else the next
shorter one is tried (a table has each token's longest proper prefix), and when
none is left the last token is taken back and its place is dead.
Compatibility is looked up in a table, filled for a pair when it is first seen
by undoing merges from both sides. Decoding is a gather from an offset table:
the bytes of all tokens in one array, and where each begins.

Merging never crosses the pretokenizer's boundaries. A pretoken is worked out
once and kept, in two generations of bounded size, so frequent ones stay.
"""

from __future__ import annotations

import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level pretokenizer's pattern (a fixed value of the vocabulary).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of Latin-1 characters whose classes the re module shares: all but four control characters.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*")
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_QUICK = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall
_FULL = regex.compile(PRETOKEN).findall
#: Pretokens of a generation of the store.
MOST_PRETOKENS = 300_000
#: Longer ones are hardly met again, and would leave the store without a bound in bytes.
LONGEST_KEPT = 64


def pretokens(text: str) -> list[str]:
    """The pretokenizer's pieces of a text; most texts allow the quicker way."""
    return _QUICK(text) if _PLAIN.fullmatch(text) else _FULL(text)


class Store(dict):
    """What ``work`` gives for each pretoken, kept while it is in use."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) > MOST_PRETOKENS:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.work(key)
        if len(key) <= LONGEST_KEPT:
            self[key] = got
        return got


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and tables of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        letters = byte_letters()
        self.latin = dict(enumerate(letters))
        back = {c: b for b, c in enumerate(letters)}
        ids = model["vocab"]
        # Added tokens are taken as they stand; other ways of matching them are refused.
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("added tokens that take in or need what is around them are not handled")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            if token not in self.special:
                tokens[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        # The offset table.
        self.starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.rank, self.split = {}, {}
        for r, merge in enumerate(model["merges"]):
            pair = merge.split(" ") if isinstance(merge, str) else merge
            (left, right), whole = (ids[x] for x in pair), ids["".join(pair)]
            self.rank[left, right] = r
            # A token that several merges make comes from the first.
            self.split.setdefault(whole, (r, left, right))
        # Tokens that merging their own bytes does not give can't occur.
        self.whole = {token: i for token, i in ids.items() if token not in self.special and (len(token) == 1 or i in self.split)}
        self.length, self.shorter = [0] * size, [-1] * size
        self.automaton = ahocorasick.Automaton()
        for token, i in self.whole.items():
            self.automaton.add_word(token, i)
            self.length[i] = len(token)
            self.shorter[i] = next((self.whole[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.whole), -1)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        # Of several that begin at a place the longest counts.
        self.special_pattern = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))

    def keeps_boundary(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens together keeps them apart.

        Both tokens form by the merges of their own trees; seen from the end,
        the boundary pair at any moment is the left one's last part and the
        right one's first. The boundary is lost if such a pair has a merge that
        comes before the merge which next changes either part.
        """
        kept = self.compatible.get((left, right))
        if kept is None:
            a, b, limit, kept = left, right, len(self.rank) + 1, True
            while True:
                r = self.rank.get((a, b))
                if r is not None and r < limit:
                    kept = False
                    break
                ra = self.split[a][0] if a in self.split else -1
                rb = self.split[b][0] if b in self.split else -1
                if ra < 0 and rb < 0:
                    break
                # Undo the later of the two merges; of equal ones the right, as merging goes from the left.
                if ra > rb:
                    limit, a = ra, self.split[a][2]
                else:
                    limit, b = rb + 1, self.split[b][1]
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[left, right] = kept
        return kept

    def merge(self, word: str) -> list[int]:
        """Ids of a pretoken, given in byte letters, by backtracking."""
        if (token := self.whole.get(word)) is not None:
            return [token]
        lengths, shorter, keeps = self.length, self.shorter, self.keeps_boundary
        n = len(word)
        longest = [-1] * n
        # In order of their ends, so the last at a start is the longest.
        for end, token in self.automaton.iter(word):
            longest[end - lengths[token] + 1] = token
        out: list[int] = []
        at, token = 0, longest[0]
        dead = bytearray(n + 1)  # places from which no continuation fits
        while True:
            while token >= 0 and (dead[at + lengths[token]] or (out and not keeps(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.store = Store(self.word)

    def word(self, pretoken: str) -> bytes:
        ids = self.v.merge(pretoken.encode().decode("latin-1").translate(self.v.latin))
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizers library gives them; a special token's string is that token."""
        parts = []
        texts = re.split(f"({self.v.special_pattern})", text) if any(s in text for s in self.v.special) else [text]
        for i, part in enumerate(texts):
            if i % 2:
                parts.append(np.array([self.v.special[part]], dtype="<u4").tobytes())
            else:
                parts += map(self.store.__getitem__, pretokens(part))
        return np.frombuffer(b"".join(parts), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        start = self.v.starts[ids]
        size = self.v.starts[ids + np.uint32(1)] - start
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        return self.v.bytes[at].tobytes().decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path))
    return _encoders[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded): the ids of every whole text, and what
    they decode to. A null text counts as empty, which has no ids; repeated
    rows each get theirs; other columns are not read."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            got = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int32)
            flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(flat)), pa.array([coder.decode(x) for x in got], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Per document the number of ids and digests of ids and decoded text."""

    def run(batches):
        coder = encoder(path)
        names = [str(i) for i in range(len(coder.v.starts))]
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text or "")
                n.append(len(ids))
                ids_sha.append(sha(",".join([names[i] for i in ids.tolist()]).encode()))
                text_sha.append(sha(coder.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
