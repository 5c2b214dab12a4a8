"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from framelake.llm import ann, exact_dedup, licenses, mixing, packing, simhash, tokens, toxicity, urls, warc
from framelake.llm.common import components, forest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _key string, size string"
SPACES = r"[\x20\x09-\x0D]+"


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["é", "naïve", "日本"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.randint(5, 400)) for _ in range(40)]
    out = [None, "", " ", "\n\t", "a", "A  b", "a\nB", *base, *base[:5], base[0].replace(" ", "\n"), make(6000), "<|endoftext|> x <|endoftext|>", "it's 12\u00a034 \u2003x"]
    for t in base[5:12]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    return out


def rows():
    t = texts()
    sources = ["b", "a", None, "a", "a"]
    out = [(i * 3 % (3 * len(t)) if i else None, x, None, sources[i % 5], None, "no", "x", "y") for i, x in enumerate(t)]
    return [*out, out[9], out[9]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(SPACES, " ", t or "")


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for r in rows():
        groups[hashlib.sha256(norm(r[1]).encode()).hexdigest()].append(r[0])
    assert len(got) == len(rows())
    for r in got:
        ids = groups[r["text_sha256"]]
        assert (r["group_size"], r["keep_id"]) == (len(ids), min((i for i in ids if i is not None), default=None))
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_mixing(docs, none, spark):
    got = mixing.mix(docs).collect()
    size = lambda t: len([w for w in re.split(SPACES, t or "") if w])
    per = defaultdict(int)
    for r in rows():
        per[r[3]] += size(r[1])
    assert sorted(per.values()) == sorted({r["source_size"] for r in got})
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight, cap = dict(zip(order, (3, 1, 2), strict=False)), {s: 2 * n for s, n in per.items()}
    total, full, target = 1.5 * sum(per.values()), set(), {}
    while True:
        left, w = total - sum(cap[s] for s in full), sum(weight[s] for s in per if s not in full)
        target = {s: cap[s] if s in full else weight[s] * left / w for s in per}
        above = {s for s in per if s not in full and target[s] > cap[s]}
        if not above:
            break
        full |= above
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {(per[s], round(target[s], 6)) for s in per} == set(taken)
    assert all(0 <= t - n <= 3 for (_, t), n in taken.items())
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert abs(sum(size(r["text"]) for r in mixed.collect()) - sum(taken.values())) == 0
    assert mixing.mix(none).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_tokens(docs, none):
    tk = library()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(tk.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    got = tokens.count_tokens(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokens.count_tokens(none).count() == 0


def test_packing(docs, none):
    tk = library()
    ids = defaultdict(list)
    for r in rows():
        ids[r[0]].append([*tk.encode(r[1] or "", add_special_tokens=False).ids, 0])
    got = packing.pack(docs, with_ids=True).collect()
    seqs, total = defaultdict(list), sum(len(x) for v in ids.values() for x in v)
    pieces = defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert any(len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == r["ids"] for x in ids[r["doc_id"]])
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r["length"])
    assert sum(sum(p) for p in pieces.values()) == total == sum(r["length"] for r in got)
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_window_cuts_are_best():
    rng = random.Random(3)
    for _ in range(200):
        ends = sorted(rng.sample(range(1, 40), rng.randint(1, 12)))
        while any(b - a > 16 for a, b in zip([0, *ends], ends, strict=False)):
            ends = sorted({*ends, rng.randint(1, 39)})
        cost = [rng.randint(0, 4) for _ in ends]
        best, pos = [0] + [None] * len(ends), [0, *ends]
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 16 - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= 16) + (cost[j - 1] if j < len(ends) else 0)
        cuts = packing.window_cuts(ends, cost, 16)
        got = sum(16 - (b - a) for a, b in zip([0, *cuts], cuts, strict=False)) + sum(cost[ends.index(c)] for c in cuts[:-1])
        assert got == best[-1] and cuts[-1] == ends[-1]


def finger(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash(docs, none):
    data = [(r[0], finger(r[1])) for r in rows()]
    want = []
    for i, f in data:
        reach, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, g in data:
                if g not in reach and (x ^ g).bit_count() <= 3:
                    reach.add(g)
                    todo.append(g)
        want.append((str(i), f"{f:016x}", min((j for j, g in data if g in reach and j is not None), default=None)))
    got = simhash.simhash_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted(want, key=str) or sorted(map(str, want)) == sorted(str((str(r["doc_id"]), r["fingerprint"], r["component_id"])) for r in got)
    assert simhash.simhash_components(none).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


def test_wide_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST", 100)  # several tiles
    fp = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 2000)
    fp[:200] = fp[200:400] ^ 0b111110001
    df = spark.createDataFrame([(i * 3, int(x)) for i, x in enumerate(fp)], "node long, fp long")
    got = simhash.wide_links(df, 16).toPandas() // 3
    u = fp.view(np.uint64)
    x, y = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 16)
    assert forest(2000, x, y).tolist() == forest(2000, got["a"].to_numpy(), got["b"].to_numpy()).tolist()
    assert simhash.wide_links(df.limit(0), 16).count() == 0


def test_near_dedup(spark, tmp_path):
    rng = random.Random(1)
    base = [" ".join(f"v{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(12)]
    close = [" ".join(w if k % 100 else "new" for k, w in enumerate(t.split())) for t in base[:6]]
    spark.createDataFrame(list(enumerate(base + close)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    left = simhash.near_dedup(spark.read.parquet(str(tmp_path / "d")))
    assert sorted(r["doc_id"] for r in left.collect()).__len__() == 12 and left.columns == ["doc_id", "text"]


def test_near_dedup_is_exact(spark, tmp_path, monkeypatch):
    """Pairs of similarity 0.79 stay and those of 0.82 go, by the shingles and not by an estimate; so do large groups, over several tiles."""
    monkeypatch.setattr(simhash, "VERIFIED", 8)
    rng = random.Random(2)
    base = [[f"v{rng.randint(0, 10**6)}" for _ in range(300)] for _ in range(80)]
    edited = lambda t, n, new: [new if k % 40 == 20 and k < 40 * n else w for k, w in enumerate(t)]
    close = [edited(t, 6 if i % 2 else 7, "new") for i, t in enumerate(base)]
    crowd = [edited(base[1], 1, f"new{i}") for i in range(40)]
    data = base + close + crowd
    grams = [{tuple(t[k : k + 5]) for k in range(296)} for t in data]
    x, y = np.array([(i, j) for i in range(len(data)) for j in range(i) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8]).T
    want = sorted(set(forest(len(data), x, y).tolist()))
    assert len(want) == 120
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(data)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    assert sorted(r["doc_id"] for r in simhash.near_dedup(spark.read.parquet(str(tmp_path / "d"))).collect()) == want


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[100]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (550, [0.0] * 16), (600, [float("nan")] * 16), (650, [1.0, None] * 8), (700, [1.0]), (7, x[7].tolist()), (None, x[3].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
        a, b = x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)
        assert abs(r["score"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 400, 50):
        s = np.round(d @ d[q], 12)
        s[q] = -9
        assert got[q] == np.lexsort((np.arange(400), -s))[:5].tolist()
    assert set(got) == set(range(0, 400, 50))
    assert ann.nearest(df.limit(0)).count() == 0


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "RANGE_ROWS", 100)  # as many ranges as there ever are
    x = np.random.default_rng(4).normal(size=(6000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got, hit = defaultdict(set), 0
    for r in ann.nearest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    for q in range(0, 6000, 50):
        s = d @ d[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit / 600 >= 0.9


def test_urls(spark):
    pages = [(1, "http://A.org/x"), (2, "http://example.org/es/1?q"), (3, "https://m.example.org/en/12#a"), (4, "http://x.com/de/1"), (5, "http://x.com/fr/1"), (6, None), (7, "no url"), (8, "http://bad.net/a"), (9, "http://notexample.org?x://y/z"), (10, "http://bad.net/b"), (10, "http://bad.net/b"), (None, "http://ok.net/c"), (11, "http://org"), *[(100 + i, f"http://bad.net/{i}") for i in range(60)], *[(200 + i, f"http://ok.net/{i}") for i in range(60)]]
    labels = [(100 + i, True) for i in range(60)] + [(200 + i, False) for i in range(60)] + [(1, None), (None, True)]
    df, known = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge_urls(df, known).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[3] == ("m.example.org", "/en/12", "example.org/en/1", "block") and got[4][2:] == ("com/de/", "block") and got[5][2:] == ("com/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("bad.net", "/a", None, "block") and got[9][:3] == ("notexample.org", "", None)
    assert got[None][3] == "allow" and got[11][2] is None
    assert urls.judge_urls(df, known).count() == len(pages) and urls.judge_urls(df.limit(0), known).count() == 0
    assert urls.judge_urls(df, known.limit(0)).filter("rule IS NULL AND verdict = 'block'").count() == 0


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["x" * 200, "y" * 99, None, "", fake, f"<p>{fake}</p>{fake}WARC/1.0\r\n" + "é" * 50, "x" * 200, "x" * 200, "y" * 99, "WARC/1.", "tail\r\n\r\n", "line\n" * 40000]
    pages = [(i + 1, f"http://a/{i}\r\nX: 1", h) for i, h in enumerate(html)] + [(None, None, "z" * 300), (7, "u", "x" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = sorted(map(tuple, warc.archive_round_trip(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        again = h == "x" * 200 and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_licenses(spark):
    t = dict(licenses.TEMPLATES[1:3])["Apache-2.0"]
    mit = next(x for n, x in licenses.TEMPLATES if n == "MIT")
    noise = " ".join(f"n{i}" for i in range(500))
    data = [(1, f"{noise} {mit} {noise}"), (2, t.upper() + noise), (3, noise), (4, None), (5, ""), (6, "Released under a different MIT licence"), (7, noise + " Licensed under CC BY-NC 4.0."), (7, noise + " Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).collect())
    assert got == [(1, "MIT"), (2, "Apache-2.0"), (7, "CC-BY-NC-4.0"), (7, "CC-BY-NC-4.0")]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_fold():
    assert toxicity.fold("ІDI0T 5tup1d ѕtupid ｉｄｉｏｔ mor\u200bon Écl") == "idiot stupid stupid idiot moron eci"
    assert toxicity.fold("stupid$$$ at 1999") == "stupid$$$ at 1999"


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeghmnoprtu") for _ in range(6))
    data, labels = [], []
    for i in range(600):
        w, bad = [word() for _ in range(rng.randint(10, 80))], i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "st\u0443pid".replace("\u0443", "u"), "zzq" + word()])
        if bad and i % 8 == 0:
            w = [x.replace("idiot", "1d10t").replace("stupid", "ѕtupіd") for x in w]
        data.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    data += [(1000, None), (1001, ""), (None, "x"), (1002, "that trash can"), (3, data[3][1])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (2000, None)], "doc_id long, toxic int")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    model = toxicity.learn(df, known.filter(~toxicity.held_out(known.doc_id)))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    assert sum(got[i]["predicted"] == y for i, y in labels if i in held) / len(held) > 0.95
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0
    m = toxicity.Matcher(toxicity.Model((("trash", 3.0),), ("trash can",), 0.0, (1.0, 1.0)))
    assert (m.weight(toxicity.fold("TRASH")), m.weight(toxicity.fold("a trash can")), m.weight("trashy")) == ((3.0, 1), (0, 0), (0, 0))
    assert toxicity.score_toxicity(df, toxicity.learn(df, known.limit(0))).filter("score > 0.01").count() == 0
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0
