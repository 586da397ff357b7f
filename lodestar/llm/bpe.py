"""Byte-level BPE by speculation: propose tokens greedily, verify all pairs, merge only where that fails.

A text is cut into words, whose encodings are independent.  For the words not met before, greedy
longest match over the vocabulary proposes tokens.  A sequence of tokens is what the merges give
exactly if this holds for each two neighbours alone, so every adjacent pair of all proposals is
tested, many at a time: walking back through the merges on both sides of the border, no merge
across it may come earlier than those that formed the two sides.  Words with a failing pair undergo
exact merging.  Encodings are kept per Python worker, in a table of bounded size.

Defined cases: a null text is empty and has no tokens; the strings of special tokens in a text
give their ids, as in the tokenizers library's default; repeated rows each get a row; texts are
encoded whole, with memory in proportion to the longest one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_of

#: How byte-level vocabularies write bytes as characters.
PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
#: Fixed value: the expression that cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same over ASCII and the letters of Latin-1, for the faster engine.
_LATIN = "a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_PLAIN = bytes(c for c in range(256) if (c < 128 and not 28 <= c < 32) or (c >= 192 and c not in (215, 247)))
#: Words in a worker's table; beyond, it starts anew.
KEPT_WORDS = 600_000
_NEVER = np.iinfo(np.int64).max


def plain(text: str) -> bool:
    """Whether a text has only ASCII and letters of Latin-1, where both engines cut alike."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


def byte_of_char() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + n): b for n, b in enumerate(rest)}


def _in_order(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their words, by word; tokens of a word stay in the order in which they were given."""
    tokens, of = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(of, kind="stable")
    return tokens[order], of[order]


class Encoder:
    """Encodes with a byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model, of_char = spec["model"], byte_of_char()
        raw = {token: bytes(of_char[c] for c in token) for token in model["vocab"]}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes_of[i] = raw[token]
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.size = size
        #: For each token: its two halves, and the rank of the merge that forms it (-1: a byte).
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        ids = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            new = ids[a + b]
            self.merges.setdefault((ids[a], ids[b]), (rank, new))
            if self.rank[new] < 0:
                self.left[new], self.right[new], self.rank[new] = ids[a], ids[b], rank
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], 0)
        self.pair_new = np.append(np.array([n for _, n in self.merges.values()], np.int64)[order], 0)
        self.byte_ids = [ids[c] for c, _ in sorted(of_char.items(), key=lambda x: x[1])]
        #: Only what its own merges give can be proposed.
        tokens = [(raw[t], i) for t, i in ids.items() if raw[t]]
        of = np.repeat(np.arange(len(tokens)), [len(t) for t, _ in tokens])
        got, of = self.merged_all(np.frombuffer(b"".join(t for t, _ in tokens), np.uint8), of)
        same = (np.bincount(of) == 1) & (got[np.searchsorted(of, np.arange(len(tokens)))] == [i for _, i in tokens])
        self.of_bytes = {t: i for (t, i), ok in zip(tokens, same.tolist()) if ok}
        self.plant()
        self.known: dict[str, bytes] = {}
        import regex

        self.words = regex.compile(WORDS)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.counts = {"words": 0, "failed": 0}

    def merged_all(self, raw: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words, all one step at a time: (tokens, their words), from (bytes, their words)."""
        ids, done = np.array(self.byte_ids, np.int64)[raw], []
        while len(ids):
            keys = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.pair_keys, keys)
            found = (self.pair_keys[at] == keys) & (of[:-1] == of[1:])
            rank = np.append(np.where(found, self.pair_ranks[at], _NEVER), _NEVER)
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(ids))))
            ended = least == _NEVER
            done.append((ids[ended], of[ended]))
            # of overlapping pairs (a a a) every other one counts, from the left
            chosen = (rank == least) & ~ended
            runs, spot = np.flatnonzero(chosen & ~np.append(False, chosen[:-1])), np.flatnonzero(chosen)
            spot = spot[(spot - runs[np.searchsorted(runs, spot, "right") - 1]) % 2 == 0]
            ids[spot] = self.pair_new[np.searchsorted(self.pair_keys, ids[spot] * self.size + ids[spot + 1])]
            stays = ~ended
            stays[spot + 1] = False
            ids, of = ids[stays], of[stays]
        return _in_order(done)

    def plant(self) -> None:
        """The trie of all tokens: nodes near the root have dense rows, the rest are found by search."""
        children: list[dict[int, int]] = [{}]
        accepts, depth = [-1], [0]
        for token, i in sorted(self.of_bytes.items(), key=lambda x: len(x[0])):
            node = 0
            for b in token:
                if (after := children[node].get(b)) is None:
                    after = children[node][b] = len(children)
                    children.append({})
                    accepts.append(-1)
                    depth.append(depth[node] + 1)
                node = after
            accepts[node] = i
        self.accepts = np.array(accepts, np.int64)
        self.row = np.full(len(children), -1, np.int64)
        near = [n for n, d in enumerate(depth) if d < 2]
        self.row[near] = np.arange(len(near))
        self.dense = np.full((len(near), 256), -1, np.int32)
        far = []
        for node, after in enumerate(children):
            if depth[node] < 2:
                self.dense[self.row[node], list(after)] = list(after.values())
            else:
                far += [(node * 256 + b, n) for b, n in after.items()]
        far.sort()
        self.far_keys = np.array([k for k, _ in far] + [_NEVER], np.int64)
        self.far_nodes = np.array([n for _, n in far] + [-1], np.int64)

    def proposed_all(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match in many words, all one byte at a time: (tokens, their words)."""
        word, at = np.arange(len(ends)), np.append(0, ends[:-1])
        node, best, best_end = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64), at.copy()
        done = []
        while len(word):
            byte, row = raw[at].astype(np.int64), self.row[node]
            after = self.dense[row, byte].astype(np.int64)
            deep = np.flatnonzero(row < 0)
            keys = node[deep] * 256 + byte[deep]
            place = np.searchsorted(self.far_keys, keys)
            after[deep] = np.where(self.far_keys[place] == keys, self.far_nodes[place], -1)
            goes = after >= 0
            at, node = at + goes, np.where(goes, after, node)
            token = np.where(goes, self.accepts[node], -1)
            best, best_end = np.where(token >= 0, token, best), np.where(token >= 0, at, best_end)
            emits = ~goes | (at == ends[word])
            done.append((best[emits], word[emits]))
            at, node = np.where(emits, best_end, at), np.where(emits, 0, node)
            rest = at < ends[word]
            word, at, node, best, best_end = word[rest], at[rest], node[rest], best[rest], best_end[rest]
        return _in_order(done)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each a and b together gives a and b."""
        a, b = a.copy(), b.copy()
        end_a, end_b = np.full(len(a), _NEVER), np.full(len(b), _NEVER)
        good, todo = np.ones(len(a), bool), np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            keys = x * self.size + y
            at = np.searchsorted(self.pair_keys, keys)
            rank = self.pair_ranks[at]
            # of two like merges the left one comes first: equal ranks spoil only the right side
            clash = (self.pair_keys[at] == keys) & (rank < end_a[todo]) & (rank <= end_b[todo])
            good[todo[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & ((rx >= 0) | (ry >= 0))
            back_b = go & (ry >= rx)  # undo what was formed last
            back_a = go & ~back_b
            t = todo[back_b]
            end_b[t], b[t] = ry[back_b], self.left[y[back_b]]
            t = todo[back_a]
            end_a[t], a[t] = rx[back_a], self.right[x[back_a]]
            todo = todo[go]
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words that are not in the table."""
        encoded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, encoded), np.int64, len(words))
        raw, ends = np.frombuffer(b"".join(encoded), np.uint8), np.cumsum(sizes)
        tokens, of = self.proposed_all(raw, ends)
        inside = np.flatnonzero(of[:-1] == of[1:])
        pairs, place = np.unique(tokens[inside] * self.size + tokens[inside + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[place]
        failed = np.zeros(len(words), bool)
        failed[of[inside[~good]]] = True
        self.counts["words"] += len(words)
        self.counts["failed"] += int(failed.sum())
        if failed.any():
            of_byte = np.repeat(np.arange(len(words)), sizes)
            again, kept = failed[of_byte], ~failed[of]
            tokens, of = _in_order([(tokens[kept], of[kept]), self.merged_all(raw[again], of_byte[again])])
        data, begin = tokens.astype("<u4").tobytes(), 0
        stops = np.cumsum(np.bincount(of, minlength=len(words))) * 4
        for word, stop in zip(words, stops.tolist()):
            self.known[word] = data[begin:stop]
            begin = stop

    def split(self, text: str) -> list[str]:
        return (_LATIN_WORDS if plain(text) else self.words).findall(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for text in texts:
            if self.cut and self.cut.search(text):
                pieces = self.cut.split(text)
            else:
                pieces = [text]
            parts.append([self.special[p] if i % 2 else self.split(p) for i, p in enumerate(pieces)])
        new: set[str] = set()
        for part in parts:
            for words in part:
                if isinstance(words, list):
                    new.update(words)
        new.difference_update(self.known)
        if new:
            if len(self.known) + len(new) > KEPT_WORDS:
                self.known.clear()
                new = {w for part in parts for words in part if isinstance(words, list) for w in words}
            self.learn(sorted(new))
        of = self.known.__getitem__
        return [
            b"".join(b"".join(map(of, w)) if isinstance(w, list) else int(w).to_bytes(4, "little") for w in part) for part in parts
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(vocabulary: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


#: Characters of text that are encoded at a time.
CHARACTERS = 4_000_000


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHARACTERS characters each."""
    begin = total = 0
    for k, text in enumerate(texts):
        total += len(text)
        if total >= CHARACTERS:
            yield begin, k + 1
            begin, total = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", doc_id: str = "doc_id", decode: bool = False) -> DataFrame:
    """(doc_id, ids binary[, decoded]) of every document; ids are little-endian unsigned 32-bit integers."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = encoder.encode_batch(texts[a:b])
                columns = [batch.column(0).slice(a, b - a), pa.array(ids, pa.binary())]
                names = ["doc_id", "ids"]
                if decode:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    key = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {key}, ids binary" + ", decoded string" * decode
    return docs.select(docs[doc_id].alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)
