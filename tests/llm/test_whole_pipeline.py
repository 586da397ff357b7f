"""The pipeline against plain Python: every stage by brute force, on documents with cases for each of them."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import secrets, simhash

from .conftest import bag
from .test_texts import figures, spans_of, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made():
    rng = random.Random(21)

    def prose(n):
        return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n))

    passages = [prose(70) for _ in range(3)]
    texts = []
    for k in range(60):
        text = [prose(rng.randint(60, 120))]
        if k % 3 == 0:
            text.append("Follow us  on all channels")  # over the limits on each host
        if k % 4 == 1:
            text.insert(0, passages[k % 3] + " " + prose(20))
        if k % 7 == 2:
            text.append('secret = "abcdef123" and ' + "AKIA" + "Q" * 18 + f" {prose(30)}")
        texts.append("\n".join(text))
    texts += ["too short", None, "", "again and again " * 40, texts[5], texts[8] + " more", "\n".join(["Follow us  on all channels"] * 20 + [prose(12)])]
    return [(k, t, "en", "ab"[k % 2], None if t is None else len(t)) for k, t in enumerate(texts)]


def good(docs):
    """Frequent lines go; short, repetitive and depleted documents too."""
    line = lambda x: " ".join(words(x)).lower()
    holders, hosts = defaultdict(set), defaultdict(set)
    for _, t, h in docs:
        hosts[h].add(t or "")
        for x in (t or "").split("\n"):
            if words(x):
                holders[h, line(x)].add(t or "")
    often = {k for k, v in holders.items() if len(v) > 100 or len(v) >= 10 and len(v) * 10 > len(hosts[k[0]])}
    out = []
    for d, t, h in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if (h, line(x)) not in often]
        n, rest = len(words(t)), len(words("\n".join(left)))
        if not figures(t)[5] and rest * 100 >= n * 30:
            out.append((d, "\n".join(left) if len(left) < len(lines) else t))
    return out


def first_of_groups(docs):
    fps = [simhash.fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [docs[i] for i in range(len(docs)) if group[i] == i]


def without_repeats(docs):
    """Words in runs of 50 that an earlier document has go, with the white space after them."""
    seen, out = {}, []
    for d, t in docs:
        found = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        gone = set()
        for i in range(len(found) - 49):
            if seen.setdefault(tuple(w for _, w in found[i : i + 50]), d) != d:
                gone.update(range(i, i + 50))
        places = [p for p, _ in found] + [len(t)]
        kept = t[: places[0]] + "".join(t[places[i] : places[i + 1]] for i in range(len(found)) if i not in gone)
        if kept.strip():
            out.append((d, kept if gone else t))
    return out


def redacted(docs):
    out = []
    for d, t in docs:
        at, parts = 0, []
        for start, _, end, _ in spans_of(t, secrets.RULES):
            if start >= at:
                parts += [t[at:start], "[secret]"]
            at = max(at, end)
        out.append((d, "".join(parts) + t[at:]))
    return out


def test_pipeline_against_plain_python(spark, tmp_path):
    rows = made()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    first = good([(d, t, h) for d, t, _, h, _ in rows])
    second = first_of_groups(first)
    third = without_repeats(second)
    last = redacted(third)
    assert len(first) < len(rows) - 4 and len(second) < len(first) and last != third
    assert sum(len(t) for _, t in third) < sum(len(t) for _, t in second) - 1000
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for d, t in last:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        expected += [(d, n, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bag(tuple(r)[:5] for r in found) == bag(expected)
    assert len({r.sequence_id for r in found}) == -(-sum(r.length for r in found) // 4096)
