"""The operators across documents against brute force, over odd documents and empty tables."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from lodestar.llm import ann, html_extract, simhash, substring

from .conftest import SHARED, TEXTS, bag, prose


def fingerprint(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, limit=2):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= limit:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_simhash(spark, odd, none):
    rows = simhash.components(odd).collect()
    of = linked([fingerprint(t[1]) for t in TEXTS])
    least = {}
    for t in TEXTS:
        if t[0] is not None:
            c = of[fingerprint(t[1])]
            least[c] = min(least.get(c, t[0]), t[0])
    expected = [(t[0], f"{fingerprint(t[1]):016x}", least.get(of[fingerprint(t[1])])) for t in TEXTS]
    assert bag(tuple(r) for r in rows) == bag(expected)
    first = simhash.keep_first(odd)
    assert first.columns == odd.columns
    ids = [r.doc_id for r in first.collect()]
    assert len(ids) == len(set(of.values())) and 5 in ids and 10 not in ids and ids.count(5) == 1 and None in ids
    assert simhash.components(none).count() == 0 and simhash.keep_first(none).count() == 0


def test_links_with_crowds(spark, monkeypatch):
    """Crowded keys are linked by neighbours; connections must be those of all pairs."""
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    of = linked(fps)
    for crowd in (64, 4):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        pairs = [(a % 2**64, b % 2**64) for a, b in simhash.links(df).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = lambda r: {frozenset(f for f in fps if r(f) == x) for x in {r(f) for f in fps}}
        assert groups(find) == groups(of.__getitem__)
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_plan_is_a_pigeonhole():
    rng = np.random.default_rng(0)
    blocks = [list(range(8 * k, 8 * k + 8)) for k in range(8)]
    spreads = [simhash.distances(rng.integers(1, 9, 256)) for _ in blocks]
    for n in (100, 10**6, 10**10):
        plan = simhash.choose_plan(blocks, spreads, n, 2)
        assert sum(plan.thresholds) == 2 - len(plan.masks) + 1 and sum(plan.masks) == 2**64 - 1


def test_chain_against_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        points = sorted({(rng.randint(0, 12), rng.randint(0, 12)) for _ in range(rng.randint(1, 14))})
        a, b, cost, best = [p[0] for p in points], [p[1] for p in points], rng.choice([0.04, 0.3, 1.0]), []
        for j in range(len(a)):
            best.append(5 + max([0] + [best[i] - cost * (a[j] - a[i] + b[j] - b[i]) for i in range(j) if a[i] < a[j] and b[i] < b[j]]))
        chains = substring.chain(a, b, 5, cost)
        top = chains[0]
        worth = 5 * len(top) - cost * sum(a[y] - a[x] + b[y] - b[x] for x, y in zip(top, top[1:]))
        assert worth == pytest.approx(max(best)) and sorted(sum(chains, [])) == list(range(len(a)))


def test_seeds_meet():
    seeder, rng = substring.Words(substring.Passages()), random.Random(1)
    for k in range(40):
        shared = prose(25, ("s", k).__repr__())
        texts = [f"{prose(rng.randrange(60), k)} {shared} {prose(rng.randrange(60), -k)}" for _ in range(2)] + ["x", "", shared]
        of, pos, seed, *_ = seeder.seeds(texts)
        found = [set(seed[of == i].tolist()) for i in range(5)]
        assert found[0] & found[1] & found[4] and not found[2] | found[3]


def test_substring(spark, odd, none):
    fuzzy = prose(200, 77).split()
    fuzzy[60] = "changed"
    more = [(50, prose(200, 77), 0), (51, prose(25, 78) + " " + " ".join(fuzzy), 0), (52, prose(300, 79), 0)]
    docs = odd.select("doc_id", "text", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string, key long"))
    rows = substring.repeats(docs).collect()
    found = {(r.doc_id, r.partner_id): r for r in rows if r.is_repeat and r.doc_id != r.partner_id}
    assert (found[9, 8].start, found[9, 8].end, found[9, 8].partner_start) == (20, 80, 30)
    assert (found[51, 50].start, found[51, 50].end) == (25, 225) and 0.9 < found[51, 50].similarity < 1
    assert found[10, 5].similarity == 1.0 and sum(r.is_repeat for r in rows if r.doc_id == 5) == 0 or any(r.doc_id == r.partner_id == 5 for r in rows)
    assert not {r.doc_id for r in rows} & {1, 2, 3, 4, 6, 7, 52, None}
    cut = {r.doc_id: r for r in substring.cut_repeats(odd).collect()}
    assert SHARED.upper() not in cut[9].text and SHARED in cut[8].text and 10 not in cut and cut[9].n_chars == len(cut[9].text)
    assert {2, 3, 4, 6, 7, None} <= set(cut) and substring.cut_repeats(odd).columns == odd.columns
    assert substring.repeats(none).count() == 0 and substring.cut_repeats(none).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = [(k, (centres[k % 20] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for k in range(1500)]
    same = vectors[100][1]
    vectors += [(2000 + k, same) for k in range(60)]  # a large class
    odd = [(3000, None), (3100, []), (3200, [0.0] * 16), (3300, [None] * 16), (3400, [float("nan")] * 16), (None, same), (3500, [1.0, 2.0]), (3600, [1.0, 2.5])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd + vectors[:3]], "vec_id long, embedding array<float>, rank int, v string")
    rows = ann.neighbours(df).collect()
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float64)
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        own = int(np.flatnonzero(ids == q)[0])
        far = np.sqrt(((x - x[own]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, far)) if i != own][:10]
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [g[0] for g in got] == list(range(1, 11)) and len({g[1] for g in got}) == 10
        assert all(s == far[np.flatnonzero(ids == v)[0]] for _, v, s in got)
        hits += len({g[1] for g in got} & {int(ids[i]) for i in best})
        total += 10
    assert hits / total >= 0.9
    large = sorted((r.rank, r.vec_id) for r in rows if r.query_id == 2000)
    assert [v for _, v in large] == [100, *range(2001, 2010)]
    assert {(r.query_id, r.vec_id) for r in rows if r.query_id in (3500, 3600)} == {(3500, 3600), (3600, 3500)}
    assert not {r.query_id for r in rows} & {3000, 3100, 3200, 3300, 3400}
    assert ann.neighbours(df.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_hilbert_curve_is_continuous():
    cells = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    along = cells[np.argsort(ann.hilbert_keys(cells, 3))]
    assert set(np.abs(np.diff(along, axis=0)).sum(1)) == {1}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="wrap"><div id="sidebar"><p>Aside, more.</div>
<div class="post-{k} content"><h2>Head &amp; line {k}</h2><p>First <b>bold</b>&nbsp;text,
with words, number {k}.<p>Second &#233; para, which is longer than the rest.<ul><li>one<li>two</ul><div class="share">Share</div>
<section class="comments"><p>I like it, really, very much, and more.</p></section></div></div><div class="cookie-notice">Cookies</div><footer>f</footer></body></html>"""


def test_pages(spark):
    def text(k):
        return f"Head & line {k}\nFirst bold text, with words, number {k}.\nSecond é para, which is longer than the rest.\none\ntwo"

    pages = [(k, f"https://Host.example/{k}", PAGE.format(k=k), "x") for k in range(6)]
    odd = [(10, "https://host.example/e", None, "x"), (11, None, "", "y"), (12, None, "plain &lt; text", "y"), (13, "nonsense", "<p", "y"), (0, "https://Host.example/0", PAGE.format(k=0), "x")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string, path string")
    rows = html_extract.extract_pages(df).collect()
    expected = [(k, u, text(k)) for k, u, _, _ in pages] + [(10, odd[0][1], ""), (11, None, ""), (12, None, "plain < text"), (13, "nonsense", ""), (0, odd[4][1], text(0))]
    assert bag(tuple(r) for r in rows) == bag(expected)
    assert html_extract.extract_pages(df.limit(0)).count() == 0
    assert html_extract.extract("<div>" * 3000 + "deep" + "</div>" * 3000, None) == "deep"


def test_pipeline(spark, odd, none, tmp_path):
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows if r.piece == 0]
    assert {1, 5, 7, 8, 9, 20} <= set(ids) and not set(ids) & {2, 3, 4, 6, 10, 11, 12} and len(ids) == len(set(ids))
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)


def test_neighbours_in_small_blocks(spark):
    """Blocks and chunks change nothing; few vectors are looked at where there is structure."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    x = (centres[np.arange(3000) % 60] + 0.2 * rng.normal(size=(3000, 24))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = [bag(ann.neighbours(df, every=50, how=ann.Curves(block=b, chunk=c)).collect()) for b, c in ((4096, 2048), (100, 2))]
    assert rows[0] == rows[1] and len(rows[0]) == 600


def test_candidates_met_once():
    """Each pair within the window of some ordering is looked at in exactly one of them, and the nearest are kept."""
    rng = np.random.default_rng(9)
    at = np.array([rng.permutation(200) for _ in range(5)], np.int32).T
    x = rng.integers(0, 3, size=(200, 4)).astype(float)
    asked, window, found = np.arange(0, 200, 10), 7, []
    for l in range(5):
        tables = [pa.table({"l": [l] * len(i), "cid": i, "at": at[i].tolist(), "v": x[i].tolist()}) for i in (asked, np.arange(200))]
        found += [(a, b, d) for q, c, far in ann._meet(*tables, 4, window, 1000) for a, b, d in zip(q.tolist(), c.tolist(), far.tolist())]
    near = np.abs(at[asked][:, None, :] - at[None]).min(2) <= window
    wanted = [(int(asked[i]), int(j), float(np.sqrt(((x[asked[i]] - x[j]) ** 2).sum()))) for i, j in zip(*np.nonzero(near)) if asked[i] != j]
    assert sorted(found) == sorted(wanted)
