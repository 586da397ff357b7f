"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are encoded with a word-based BPE vocabulary, ended by a closing id, and cut only where
they are longer than a sequence.  The pieces, as rows of lengths, are dealt evenly over groups of
bounded size.  Each group is packed best fit, longest first; then moves, one-for-one and
two-for-one exchanges between underfull sequences raise the sum of squared fills, until sequences
empty or nothing helps.  What stands in the sequences that are still underfull is packed again in a
second round, in groups across the first ones, so that the grouping costs next to nothing.

Defined cases: a null text is empty, and an empty document is its closing id alone; repeated rows
are packed each on its own; ties between lengths go by the order of rows; the encoding needs memory
in proportion to the longest text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import plain, slices
from .common import materialise, text_of

#: Fixed value: the expression that finds the words of a text in lower case, over ASCII and the letters of Latin-1.
_LOWER = "a-z\xdf-\xf6\xf8-\xff"
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LOWER}]+|[0-9]|[^\t-\r {_LOWER}0-9]+")
#: Words in a worker's table; beyond, it starts anew.
KEPT_WORDS = 600_000
#: Words that the library encodes at a time.
AT_ONCE = 20_000
#: Looks at a bin in the local search, for each underfull one, and of a group at least.
LOOKS, LEAST_LOOKS = 2, 400


class WordEncoder:
    """Ids by the tokenizers library, each distinct word encoded once.

    The library encodes words on their own, and only the last token of a word ends in the suffix
    for word ends, so many new words can be encoded in one call and told apart afterwards.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = re.compile("|".join(map(re.escape, special)) or "(?!)")
        suffix = spec["model"]["end_of_word_suffix"]
        size = 1 + max([*spec["model"]["vocab"].values(), *special.values()])
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.library = Tokenizer.from_str(vocabulary)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), AT_ONCE):
            some = words[k : k + AT_ONCE]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, begin = ids.astype("<u4").tobytes(), 0
                for word, stop in zip(some, (stops * 4).tolist()):
                    self.known[word] = data[begin:stop]
                    begin = stop
            else:
                self.known.update((word, self.whole(word)) for word in some)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        #: Texts beyond Latin-1, or with a special token's string, go to the library whole.
        parts = [_LATIN_WORDS.findall(t.lower()) if plain(t) and not self.cut.search(t) else None for t in texts]
        found = [words and list(map(self.known.get, words)) for words in parts]  # None for words that aren't known yet
        gaps = [[k for k, x in enumerate(ids) if x is None] if ids and None in ids else () for ids in found]
        new = {words[k] for words, gap in zip(parts, gaps) for k in gap}
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
        self.learn(sorted(new))
        for words, ids, gap in zip(parts, found, gaps):
            for k in gap:
                ids[k] = self.known[words[k]]
        return [self.whole(t) if ids is None else b"".join(ids) for t, ids in zip(texts, found)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODERS: dict[int, WordEncoder] = {}


def pieces(
    docs: DataFrame, vocabulary_path: str, capacity: int = 4096, closing_id: int = 1, text: str = "text",
    doc_id: str = "doc_id", digest: bool = False,
) -> DataFrame:
    """(row, doc_id, piece, start, length, ids) of each piece; with digest, ids_crc32 in place of ids."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary
    closing = int(closing_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = WordEncoder(shared.value)
        encoder, width = _ENCODERS[key], 4 * capacity
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                of, piece, start, length, last = [], [], [], [], []
                for k, ids in enumerate(encoder.encode_batch(texts[a:b])):
                    ids += closing
                    for n, at in enumerate(range(0, len(ids), width)):
                        part = ids[at : at + width]
                        of.append(k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        last.append(zlib.crc32(part) if digest else part)
                rows = pa.array(np.arange(row, row + len(of)), pa.int64())
                row += len(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows, batch.column(0).slice(a, b - a).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(last, pa.int64() if digest else pa.binary()),
                    ],
                    ["row", "doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {kind}, piece int, start long, length long, " + ("ids_crc32 long" if digest else "ids binary")
    return docs.select(docs[doc_id].alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # room left -> bins
    some = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = some >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
            bins[k].append(i)
        else:
            k, r = len(bins), capacity
            bins.append([i])
        if left := r - n:
            room.setdefault(left, []).append(k)
            some |= 1 << left
    return bins


class _Bin:
    """A sequence: its items, fill, and the distinct lengths of one and of two of its items.  As the lengths add up to
    the capacity at most, there are no more than about sqrt(2 capacity) of the former, and capacity of the latter."""

    __slots__ = ("items", "fill", "ones", "twos")

    def __init__(self, items: list[int], lengths: np.ndarray):
        self.items, of = items, lengths[items]
        self.fill = int(of.sum())
        self.ones, counts = np.unique(of, return_counts=True)
        i, j = np.triu_indices(len(self.ones))
        some = (i != j) | (counts[i] > 1)
        self.twos = np.unique(self.ones[i[some]] + self.ones[j[some]])

    def pick(self, total: int, n: int, lengths: np.ndarray) -> list[int]:
        """n items, of that length together."""
        if n < 2:
            return [next(i for i in self.items if lengths[i] == total)] if n else []
        seen: dict[int, int] = {}
        for i in self.items:
            if (other := seen.get(total - int(lengths[i]))) is not None:
                return [other, i]
            seen.setdefault(int(lengths[i]), i)
        raise ValueError(total)


def _best_step(under: list[_Bin], k: int, capacity: int) -> tuple[int, int, int, int, int, int]:
    """The step from bin k to another one that raises the sum of squared fills most: (rise, length and number of the
    items out, bin, length and number of the items back).  A bin's best step is the one that moves most over."""
    own, best = under[k], (0, 0, 0, 0, 0, 0)
    fills = np.array([b.fill for b in under], np.int64)
    nothing = [np.zeros(1, np.int64)] * len(under)
    for backs, back_n, outs in (
        (nothing, 0, ((own.ones, 1),)), ([b.ones for b in under], 1, ((own.ones, 1), (own.twos, 2))), ([b.twos for b in under], 2, ((own.ones, 1),)),
    ):
        back, to = np.concatenate(backs), np.repeat(np.arange(len(under)), [len(x) for x in backs])
        for out, out_n in outs:
            if not len(out) or not len(back):
                continue
            at = np.searchsorted(out, back + capacity - fills[to], "right") - 1
            net = np.where((at >= 0) & (to != k), out[at] - back, 0)
            rise = np.where(net > 0, 2 * net * (fills[to] - own.fill + net), 0)
            if (r := int(rise.max())) > best[0]:
                i = int(rise.argmax())
                best = (r, int(out[at[i]]), out_n, int(to[i]), int(back[i]), back_n)
    return best


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, looks: int | None = None) -> list[list[int]]:
    """Moves, and exchanges of one for one, two for one and one for two, between underfull bins, each of which raises
    the sum of squared fills, until nothing helps: all items, and all pairs of items of a bin, are tried.
    looks: how often bins are looked at, for each underfull one, before the search gives up (LEAST_LOOKS in all at
    least); without it the search goes on until nothing helps.

    The emptiest bins give first; after each step it is their turn again.  At the bound on the number of
    bins there is nothing left to do.
    """
    least = -(-int(lengths.sum()) // capacity)
    every = [_Bin(list(b), lengths) for b in bins]
    full = [b for b in every if b.fill == capacity]
    under = sorted((b for b in every if b.fill < capacity), key=lambda b: b.fill)
    k, left = 0, float("inf") if looks is None else max(LEAST_LOOKS, looks * len(under))
    while k < len(under) and len(full) + len(under) > least and left > 0:
        left -= 1
        rise, out, out_n, to, back, back_n = _best_step(under, k, capacity)
        if not rise:
            k += 1
            continue
        one, two = under[k], under[to]
        gone, come = one.pick(out, out_n, lengths), two.pick(back, back_n, lengths)
        changed = [[i for i in one.items if i not in gone] + come, [i for i in two.items if i not in come] + gone]
        rest = [b for j, b in enumerate(under) if j not in (k, to)] + [_Bin(x, lengths) for x in changed if x]
        full += [b for b in rest if b.fill == capacity]
        under = sorted((b for b in rest if b.fill < capacity), key=lambda b: b.fill)
        k = 0
    return [b.items for b in full + under]


def pack_lengths(lengths: np.ndarray, capacity: int, looks: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its offset there."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity, looks)
    of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, members in enumerate(bins):
        of[members] = k
        offset[members] = np.cumsum(lengths[members]) - lengths[members]
    return of, offset


def _round(rows: DataFrame, capacity: int, per_group: int, level: int, looks: int | None) -> DataFrame:
    """One round of packing: adds sequence_id, offset and the sequence's fill to rows with row and length."""
    groups = max(1, -(-rows.count() // per_group))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        lengths = part["length"].to_numpy(np.int64)
        of, offset = pack_lengths(lengths, capacity, looks)
        fill = np.bincount(of, weights=lengths).astype(np.int64)[of]
        group = (level << 56) | (int(part["part"].iloc[0]) << 28)
        return part.drop(columns="part").assign(sequence_id=group + of, offset=offset, fill=fill)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    return dealt.groupBy("part").applyInPandas(pack, f"{fields}, sequence_id long, offset long, fill long")


def pack_pieces(parts: DataFrame, capacity: int = 4096, per_group: int = 4096, looks: int | None = LOOKS) -> DataFrame:
    """Adds sequence_id and offset to pieces that stand in a written table.  per_group: pieces that are packed
    together, about; looks: see `local_search`."""
    first = materialise(_round(parts, capacity, per_group, 0, looks), "packed")
    #: Underfull sequences hold few pieces, as most are full to the last token.
    rest = first.where(F.col("fill") < capacity).drop("sequence_id", "offset", "fill")
    second = _round(rest, capacity, 4 * per_group, 1, looks)
    return first.where(F.col("fill") == capacity).unionByName(second).drop("row", "fill")


def pack(
    docs: DataFrame, vocabulary_path: str, capacity: int = 4096, closing_id: int = 1, text: str = "text",
    doc_id: str = "doc_id", digest: bool = False, looks: int | None = LOOKS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of each piece of each document.  looks: see `local_search`."""
    parts = materialise(pieces(docs, vocabulary_path, capacity, closing_id, text, doc_id, digest), "pieces")
    return pack_pieces(parts, capacity, looks=looks)
