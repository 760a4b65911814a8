"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import io
import math
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.llm import embeddings, licenses, linededup, mixing, packing, quality, shared, simhash, toxicity, urlfilter, warczip

PATH = public_tokenizers.path(packing.TOKENIZER)
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def text_of(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def union(pairs, items):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


# Components

@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_stars(pairs):
    a, b = (np.array(x) for x in zip(*pairs))
    nodes, roots = shared.stars(a, b)
    want = union(pairs, {x for p in pairs for x in p})
    assert dict(zip(nodes.tolist(), roots.tolist())) == {k: v for k, v in want.items() if k != v}


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(7, 300), (300, 301)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = union(chain, {x for p in chain for x in p})
    assert got == {k: v for k, v in want.items() if k != v}


# 3 SimHash

def test_masks_cover():
    masks = simhash.masks()
    assert len(masks) == 15 and all(bin(m).count("1") == 32 for m in masks)
    for _ in range(3000):
        flip = sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & flip == 0 for m in masks)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = ["", " ", "One", "one two", "É É é X y Z", text_of(50), text_of(900), "a\x0bb\x0cc\rd e"]
    assert simhash.fingerprints(texts).tolist() == [slow_fingerprint(t) for t in texts]


@pytest.mark.parametrize("block", [4, 1024])
def test_links_are_exact(spark, block):
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {rng.getrandbits(64) for _ in range(50)}
    for b in base:
        for _ in range(60):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    got = {r["node"]: r["root"] for r in shared.components(simhash.links(nodes, block=block)).collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert got == {k: v for k, v in union(pairs, range(len(fps))).items() if k != v}


def near_texts(n, r):
    """A text and variants of it, each 1 to 3 bits from the one before and more than 3 from all others."""
    bits = lambda a, b: int(np.bitwise_count(simhash.fingerprints([a])[0] ^ simhash.fingerprints([b])[0]))
    chain = [text_of(300, r)]
    for _ in range(100_000):
        words = chain[-1].split()
        words[r.randrange(len(words))] = r.choice(WORDS)
        new = " ".join(words)
        if 1 <= bits(new, chain[-1]) <= 3 and all(bits(new, x) > 3 for x in chain[:-1]):
            chain.append(new)
            if len(chain) == n:
                return chain
    raise AssertionError("no such texts")


def test_rows_without_id_link(spark):
    r = random.Random(11)
    a, b, c = near_texts(3, r)
    rows = [(7, a), (None, b), (9, c), (None, text_of(200, r)), (4, text_of(200, r))]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = lambda i: (rows[i][0], f"{simhash.fingerprints([rows[i][1]])[0]:016x}")
    assert [got[at(i)] for i in range(5)] == [7, 7, 7, None, 4]  # 7 and 9 are linked through the row without doc_id only


# 1 Embeddings

@pytest.mark.parametrize("block", [16, 1024])
def test_vectors_against_brute_force(spark, block):
    g = np.random.default_rng(3)
    x = g.standard_normal((300, 24))
    for k in range(5):
        x[50 * k : 50 * k + 40] = x[50 * k] + 0.03 * g.standard_normal((40, 24))
    x[299], x[298] = x[0], x[0]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df, block=block).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    roots = union([tuple(map(int, p)) for p in np.argwhere(near)], range(300))
    assert {i: r for i, (_, r) in got.items()} == roots
    links = np.array([got[i][0] for i in range(300)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()


def test_recall_at_the_threshold():
    g = np.random.default_rng(4)
    pivots = embeddings.filled(64, embeddings.PIVOTS)
    x = g.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = g.standard_normal((2000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (embeddings.permutations(v, pivots, embeddings.PREFIX) for v in (x, y))
    common, best = embeddings.best_common(a, b)
    listed = [(p[:, : embeddings.NEAR] == best[:, None]).any(1) for p in (a, b)]
    assert ((common >= embeddings.SHARED) & listed[0] & listed[1]).mean() > 0.99


def test_permutations_and_shared_pivots():
    g = np.random.default_rng(5)
    pivots = g.standard_normal((40, 6))
    pivots[7] = pivots[3]  # a tie
    x = g.standard_normal((120, 6))
    x[60:] = x[:60] + 0.1 * g.standard_normal((60, 6))
    perms = embeddings.permutations(x, pivots, 8)
    assert perms.tolist() == [sorted(range(40), key=lambda p: (-float(v @ pivots[p]), p))[:8] for v in x] or np.allclose(np.take_along_axis(-(x @ pivots.T), perms, 1), np.sort(-(x @ pivots.T), 1)[:, :8])
    for members in (range(120), range(0, 120, 9), [3, 63]):
        p = perms[list(members)]
        for pivot in (0, 3, int(p[0, 0])):
            rows = [i for i in range(len(p)) if pivot in p[i]]
            got = set(zip(*(c.tolist() for c in embeddings.sharing(p[rows], pivot, 3))))
            assert got == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if len(set(p[rows[i]]) & set(p[rows[j]])) >= 3}
    n, best = embeddings.best_common(perms[:60], perms[60:])
    for a, b, k, p in zip(perms[:60].tolist(), perms[60:].tolist(), n, best):
        both = set(a) & set(b)
        assert k == len(both) and p == min(both, key=lambda q: (a.index(q) + b.index(q), q), default=-1)


# 2 Toxicity

def slow_segments(values):
    out = []

    def rec(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 0 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best:
            rec(a, best[1])
            out.append(best)
            rec(best[2] + 1, b)

    rec(0, len(values))
    return out


@settings(max_examples=300)
@given(st.lists(st.sampled_from([None, None, 0.5, 1.25, 3.0]), min_size=1, max_size=16), st.sampled_from([-0.3, -0.77, -1.1]))
def test_segments(scores, drift):
    hits = [(i, s) for i, s in enumerate(scores) if s]
    got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(hits, drift)]
    assert got == [(round(s, 6), a, b) for s, a, b in slow_segments([s or drift for s in scores])]


def test_toxicity_held_out(spark):
    r = random.Random(9)
    bad = ["grubfoul", "mudwretch", "vilescum", "dirtclod"]
    rows, labels = [], []
    for i in range(1500):
        words = text_of(r.randint(30, 200), r).split()
        toxic = r.random() < 0.2
        for _ in range(r.randint(1, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.report(docs, table).collect()}
    held = [i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, x in got.items() if x["held_out"]} == set(held)
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) >= 0.98 * len(held)
    kept = {x["doc_id"] for x in toxicity.keep(docs, table).collect()}
    assert kept == {i for i, x in got.items() if x["score"] < 0.7}
    flipped = table.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x["doc_id"]: x["score"] for x in toxicity.report(docs, flipped).collect()} == {i: x["score"] for i, x in got.items()}  # held-out labels teach nothing


# 4 URLs

def url_frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_url_rules(spark):
    r = random.Random(2)
    hosts = [f"{w}.example.{t}" for w in WORDS[:40] for t in ("com", "net")]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'fr'])}/{r.randint(1, 900)}" for _ in range(900)] + [f"http://www.best-casino-{k}.example.com/fr/{k}" for k in range(40)] + ["http://EXAMPLE.com/en/71?q", "https://a.example.net/de/8", "https://xexample.com/en/7", "nothing", "://x.org/es/"]
    got = {x["page_id"]: x for x in urlfilter.judge(url_frame(spark, urls)).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = sorted((len(h) + len(p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, fits[-1][1] if fits else None)
        assert not fits or got[i]["verdict"] == fits[-1][2]
    free = [i for i in got if got[i]["rule"] is None]
    assert all(got[i]["verdict"] == ("block" if "casino" in urls[i] else "allow") for i in free)


def test_url_models_learn_hosts_that_no_example_names(spark):
    r = random.Random(12)
    clean = [f"http://{r.choice(('www', 'm', 'blog'))}.{w}.example.org/fr/{r.randint(1, 999)}" for w in WORDS[:60] for _ in range(20)]
    spam = [f"http://online-casino-bonus-aduceboidu{k}.example.org/fr/{k}" for k in range(60)] + [f"http://cheap-pills-aduceboidu{k}.example.org/fr/{k}" for k in range(60)]
    hosts = spark.createDataFrame([(f"m.aduceboidu{k}.example.org",) for k in range(60, 80)], "host string")
    new = [f"http://{x['host']}/fr/7" for x in hosts.filter(F.xxhash64("host") % 2 != 0).collect()]  # hosts that the models haven't seen
    assert not any("aduce" in h for h in urlfilter.REJECTED)
    urls = clean + spam + new
    got = {x["page_id"]: x["verdict"] for x in urlfilter.judge(url_frame(spark, urls)).collect()}
    blocked = [got[i] == "block" for i in range(len(urls))]
    assert all(blocked[len(clean) :]) and not any(blocked[: len(clean)])
    assert len(new) > 4
    assert not any(x["verdict"] == "block" for x in urlfilter.judge(url_frame(spark, clean + new)).collect())  # without URLs to learn them from


def slow_url_models(rows, order0, order=4):
    """log P1 - log P0 of every n-gram, by dictionaries."""
    c = [{}, {}]
    for line, n, *w in rows:
        padded = urlfilter.START * (order - 1) + line
        for i in range(len(line)):
            for k in range(1, order + 1):
                g = padded[i + order - k : i + order]
                for side in (0, 1):
                    c[side][g] = c[side].get(g, 0.0) + n * w[side]
    def smooth(side, g, lower):  # noqa: E306
        after = [v for x, v in c[side].items() if len(x) == len(g) and x[:-1] == g[:-1]]
        total, kinds = sum(after), sum(v > 0 for v in after)
        return (c[side].get(g, 0) + kinds * lower) / (total + kinds) if total else lower
    out = {}  # noqa: E306
    for g in (x for x in c[0] if len(x) == order):
        p0 = 1 / 256
        for k in range(1, order0 + 1):
            p0 = smooth(0, g[order - k :], p0)
        p1 = smooth(1, g, smooth(1, g[1:], p0))
        out[g] = math.log(p1 / p0)
    return out


@pytest.mark.parametrize("order0", [2, 4])
def test_url_models_against_dictionaries(spark, order0):
    r = random.Random(7)
    rows = [("".join(r.choice("ab/1é") for _ in range(r.randint(1, 9))), r.randint(1, 5), float(r.random() < 0.6), float(r.random() < 0.3)) for _ in range(60)]
    table = spark.createDataFrame(rows, "line string, n long, w0 double, w1 double")
    model = urlfilter.train(table, order0)
    want = slow_url_models(rows, order0)
    assert {x["gram"]: x["diff"] for x in model.collect()} == pytest.approx(want)
    lines = spark.createDataFrame([(0, "ab/1é"), (1, rows[3][0]), (2, rows[4][0] * 3)], "id long, line string")
    for x in urlfilter.score(lines, model).collect():
        line = {0: "ab/1é", 1: rows[3][0], 2: rows[4][0] * 3}[x["id"]]
        padded = urlfilter.START * 3 + line
        parts = [want.get(padded[i : i + 4], 0.0) for i in range(len(line))]
        assert (x["total"], x["score"]) == pytest.approx((sum(parts), sum(parts) / len(parts)))


def test_url_models_and_cutoff_count_urls(spark):
    rows = [("ab.com/a", 5, 1.0, 0.0), ("cd.com/0", 1, 1.0, 0.0), ("casino.com/", 3, 0.0, 1.0), ("abcd.com/a", 1, 0.0, 1.0)]
    model = lambda rows: {r["gram"]: r["diff"] for r in urlfilter.train(spark.createDataFrame(rows, "line string, n long, w0 double, w1 double")).collect()}
    assert model(rows) == pytest.approx(model([(line, 1, *w) for line, n, *w in rows for _ in range(n)]))
    r = random.Random(2)
    for share in (0.002, 0.1, 0.5):
        scored = [(r.choice([r.random(), 0.25, 0.75]), r.randint(1, 500)) for _ in range(80)]
        total = sum(n for _, n in scored)
        want = min(s for s, _ in scored if sum(n for x, n in scored if x > s) <= share * total)
        assert urlfilter.cutoff_of(spark.createDataFrame(scored, "score double, n long"), share) == want
    assert urlfilter.cutoff_of(spark.createDataFrame([], "score double, n long")) is None


def test_url_models_keep_all_ngrams_and_join_large_tables(spark, monkeypatch):
    r = random.Random(3)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz0./-_~%") for _ in range(12)) for _ in range(8000)]
    want = {(urlfilter.START * 3 + x)[i : i + 4] for x in lines for i in range(len(x))}
    model = urlfilter.train(spark.createDataFrame([(x, 1, float(i % 2), float(1 - i % 2)) for i, x in enumerate(lines)], "line string, n long, w0 double, w1 double"))
    assert len(want) > 60_000 and model.count() == len(want)
    some = spark.createDataFrame(list(enumerate(lines[:300])), "id long, line string")
    small = {x["id"]: x["score"] for x in urlfilter.score(some, model).collect()}
    monkeypatch.setattr(urlfilter, "BROADCAST", 10)
    assert {x["id"]: x["score"] for x in urlfilter.score(some, model).collect()} == pytest.approx(small)


# 5 Licenses

def test_licenses(spark):
    texts = {
        "MIT": "intro\nReleased under the MIT License.", "Apache-2.0": "x y z Licensed under the Apache License, Version 2.0. and more words here", "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "CC-BY-NC": "Licensed under CC BY-NC 4.0.", "CC-BY-SA": "Licensed under CC BY-SA 4.0.", "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None: "She renewed her driving license in 2.0 days.",
    }
    df = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(df).collect()}
    assert got == dict(enumerate(texts))


def slow_scan(text):
    """Family to (windows, probability, similarity) of a text, and how many windows were judged."""
    families, weights, bias, need = licenses.train()
    found, judged, reach = {}, 0, licenses.REACH
    for paragraph in re.split(r"\n[ \t\r\x0b\f]*\n", text.lower()):
        words = re.findall(licenses.WORD, paragraph)
        for at in range(0, max(1, len(words)), reach):
            window = words[at : at + 2 * reach]
            line = " ".join(window)
            if not any(t in line for t in licenses.triggers()):
                continue
            judged += 1
            grams = {" ".join(window[i : i + n]) for n in (1, 2, 3) for i in range(len(window) - n + 1)}
            z = np.array(bias) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(families)))
            for k, family in enumerate(families):
                p = 1 / (1 + math.exp(-z[k]))
                best = max(sum(f" {x} " in f" {line} " for x in licenses.shingles_of(t)) / len(licenses.shingles_of(t)) for t in map(licenses.words_of, licenses.NOTICES[family]))
                if p >= need[k] and best >= licenses.SIMILAR:
                    n, a, b = found.get(family, (0, 0.0, 0.0))
                    found[family] = (n + 1, max(a, p), max(b, best))
    return found, judged


def test_licenses_against_brute_force(spark):
    r = random.Random(21)
    every = [(f, n) for f, ns in licenses.NOTICES.items() for n in ns]
    texts = []
    for _ in range(160):
        parts = [text_of(r.randint(0, 200), r) for _ in range(r.randint(0, 3))]
        for family, notice in r.sample(every, r.randint(0, 3)):
            words = notice.split(" ")
            if r.random() < 0.4:
                del words[r.randrange(len(words))]
            parts.insert(r.randint(0, len(parts)), r.choice([" ", "\n", "\n * "]).join(words))
        parts += r.sample(licenses.ORDINARY, r.randint(0, 2))
        texts.append(r.choice([" ", "\n", "\n\n", "\n \t\n"]).join(parts))
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    hits = 0
    for x in rows:
        found, judged = slow_scan(texts[x["doc_id"]])
        assert x["n_candidates"] == judged and (x["families"] or "") == ",".join(sorted(found))
        if found:
            hits += 1
            assert x["license"] == max(found, key=lambda f: (*found[f], f))
            assert x["probability"] == pytest.approx(max(p for _, p, _ in found.values())) and x["similarity"] == pytest.approx(max(s for *_, s in found.values()))
    assert hits > 80


def test_every_notice_is_known_and_triggers_lose_nothing():
    families, weights, bias, need = licenses.train()
    for k, family in enumerate(families):
        for notice in licenses.NOTICES[family]:
            found, _ = slow_scan(notice)
            assert family in found, notice
    for family, notices in licenses.NOTICES.items():
        for notice in notices:  # without the shingles that hold a trigger, too few are left to confirm
            shingles = licenses.shingles_of(licenses.words_of(notice))
            left = [x for x in shingles if not set(x.split(" ")) & set(licenses.triggers())]
            assert len(left) < licenses.SIMILAR * len(shingles)
    assert not any(slow_scan(x)[0] for x in licenses.ORDINARY)


def test_long_texts_of_licenses(spark):
    """100,000 words in one line, with a trigger in each window."""
    text = "Licensed under the MIT License. " + "license word " * 50_000 + "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(0, text), (1, text.replace(" ", "\n"))], "doc_id long, text string")
    began = time.perf_counter()
    got = licenses.scan(df).collect()
    assert time.perf_counter() - began < 60
    assert [x["families"] for x in got] == ["Apache-2.0,MIT"] * 2 and got[0]["n_candidates"] == -(-(2 * 50_000 + 12) // licenses.REACH)


def test_short_and_wrapped_notices(spark):
    prose, r = " ".join(WORDS[:12]), random.Random(4)
    texts = {
        "All rights reserved.": "Proprietary",
        f"{prose}\nAll rights\nreserved.\n{prose}": "Proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": "MIT",
        f"{prose}\n * Permission is hereby\n * granted, free of charge, to any\n * person obtaining a copy of\n *\n * this software and associated\n * documentation files\n{prose}": "MIT",
        f"{text_of(90, r)}\nThis work is licensed under the GNU General Public\nLicense, version 3.\n{text_of(90, r)}": "GPL-3.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files": None,
        f"{prose}\nHis driving license was suspended\nby the board.\n{prose}": None,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(df).collect()}
    assert got == dict(enumerate(texts.values()))


# 6 Packing

def test_encoder():
    from tokenizers import Tokenizer

    own, theirs = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    r = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "1", "'s", "!?", "\x1c", "\u0085", "<|endoftext|>", "😀", "\r\n", "-", "ß", "word"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(own(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_plans_use_every_piece_once(hist):
    plan = packing.make_plan(hist, 64)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 64 and n > 0
        for k in lengths:
            used[k] += n
    assert used == Counter(hist)
    assert sum(n for _, n in plan) <= best_fit(hist, 64)


def best_fit(hist, capacity):
    """Sequences that best fit, longest first and piece by piece, needs: what the plan may never exceed."""
    room = []
    for k in sorted(hist, reverse=True):
        for _ in range(hist[k]):
            fits = [(r, i) for i, r in enumerate(room) if r >= k]
            if fits:
                room[min(fits)[1]] -= k
            else:
                room.append(capacity - k)
    return len(room)


@pytest.mark.parametrize("capacity, hist", [(64, {22: 23}), (64, {33: 7}), (64, {64: 3}), (64, {21: 10}), (64, {1: 65}), (10, {6: 2, 4: 2, 3: 2, 2: 1}), (10, {5: 3, 7: 1, 3: 1}), (12, {7: 1, 6: 2, 5: 1, 4: 2, 2: 2})])
def test_plans_are_best_on_small_histograms(capacity, hist):
    def best(left, bins):
        """The fewest sequences, by trying every place of every piece."""
        if not left:
            return len(bins)
        k, rest, found = left[0], left[1:], len(bins) + len(left)
        for i in {r: i for i, r in enumerate(bins) if r >= k}.values():
            found = min(found, best(rest, [*bins[:i], bins[i] - k, *bins[i + 1 :]]))
        return min(found, best(rest, [*bins, capacity - k])) if len(bins) + 1 <= found else found

    pieces = sorted((k for k, n in hist.items() for _ in range(n)), reverse=True)
    want = -(-len(pieces) // (capacity // pieces[0])) if len(hist) == 1 else best(pieces, [])
    assert sum(n for _, n in packing.make_plan(hist, capacity)) == want


def test_many_small_documents_fill_up():
    r = random.Random(6)
    hist = Counter(r.randint(1, 1023) for _ in range(20_000))
    n = sum(c for _, c in packing.make_plan(dict(hist)))
    assert n <= 1.004 * -(-sum(k * c for k, c in hist.items()) // 1024) + 2


def test_pieces(spark):
    texts = ["", "short text", text_of(3000), text_of(900), None] + [text_of(rng.randint(1, 300)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(df, PATH).collect()
    enc = packing.Encoder(PATH)
    by = {}
    for x in rows:
        by.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = enc(t or "") + np.array([2], "<u4").tobytes()
        mine = sorted(by[i], key=lambda x: x["piece"])
        assert [x["piece"] for x in mine] == list(range(len(mine))) and sum(x["length"] for x in mine) * 4 == len(ids)
        assert all(x["ids_crc32"] == zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])]) for x in mine) and all(x["length"] == 1024 for x in mine[1:])
    at = {}
    for x in sorted(rows, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == at.get(x["sequence_id"], 0)
        at[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(at.values()) <= 1024


# 7 Quality

def test_statistics(spark):
    texts = ["", None, "a b c", "a b c a b c", "x\nx\n\n \nx", "#a $b | c", text_of(400) + "\n" + text_of(5) * 3, "é b \x1c"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for x in quality.statistics(df).collect():
        t = texts[x["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count, cover = Counter(windows), set()
        for i, w in enumerate(windows):
            if count[w] > 1:
                cover |= {i, i + 1, i + 2}
        lines = [y for y in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def test_exact_bounds():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    for k, n, d in ((3, 50, 0.01), (0, 10, 0.5), (40, 41, 0.1)):
        assert quality.binomial_tail(k, n, quality.upper_bound(k, n, d)) == pytest.approx(d, abs=1e-9)
    assert quality.upper_bound(5, 5, 0.1) == 1.0


def test_thresholds_spare_good_documents(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(6000):
        good = r.random() < 0.8
        words = [r.choice(WORDS) + ("" if good or r.random() < 0.3 else r.choice("###$$$")) for _ in range(60)]
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(good), 0))
    out = quality.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = [x["kept"] for x in out if labels[x["doc_id"]][1] and not x["base_failed"]]
    bad = [x["kept"] for x in out if not labels[x["doc_id"]][1]]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_every_stratum_acts(spark):
    """Two languages of 700 labelled documents each get a filter; one of 40 shares the rest's stratum."""
    r = random.Random(18)
    rows, labels = [], []
    for i in range(1440):
        lang = "en" if i < 700 else "de" if i < 1400 else "fr"
        good = r.random() < 0.8
        words = [r.choice(WORDS) + ("" if good or r.random() < 0.5 else "#") for _ in range(80)]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good), 0))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    own, chosen = quality.fit(shared.materialize(quality.statistics(docs), "stats"), table)
    assert own == ["de", "en"] and chosen["de"] and chosen["en"] and set(chosen) == {"de", "en", None}
    got = {x["doc_id"]: x for x in quality.report(docs, table).collect()}
    for i, text, lang in rows:  # each verdict from the chosen steps, by hand
        stats = {c: got[i][c] for c in ("n_words", "word_chars", "n_symbols")}
        ratio = {"symbols": stats["n_symbols"] / (stats["word_chars"] + 1), "long_words": stats["word_chars"] / (stats["n_words"] + 1), "short_words": stats["word_chars"] / (stats["n_words"] + 1)}
        steps = chosen[lang if lang in own else None]
        assert {rule for rule, _ in steps} <= set(ratio)
        first = next((rule for rule, cut in steps if (ratio[rule] < cut if rule == "short_words" else ratio[rule] > cut)), None)
        assert got[i]["rejected_by"] == first and got[i]["kept"] == (first is None)


def test_guarantee_holds_in_simulation():
    """Rules that reject good documents at rates around the risk: the chosen filter's true rate is above it in at most delta of the runs."""
    g = np.random.default_rng(3)
    rules = list(quality.GRID)
    risk, delta, broken, used = 0.05, 0.1, 0, 0
    for _ in range(400):
        base = g.uniform(0.0, 0.06, 3)  # true share of good documents beyond each of three rules' strictest cutoff

        def draw(n):
            good = g.random(n) < 0.7
            x = np.zeros((n, len(rules)))
            x[:, rules.index("short_words")] = 9.0
            for k, rule in enumerate(("symbols", "pipes", "shouting")):
                cuts = quality.GRID[rule]
                hit = g.random(n) < np.where(good, base[k], 0.5)
                x[:, rules.index(rule)] = np.where(hit, cuts[0] + 1e-6 + g.random(n) * cuts[-1], 0)
            return x, good

        def rejected(x, steps):
            return np.logical_or.reduce([x[:, rules.index(r)] < c if r == "short_words" else x[:, rules.index(r)] > c for r, c in steps]) if steps else np.zeros(len(x), bool)

        steps = quality.sequence_of(*draw(600), risk=risk)
        x, good = draw(600)
        lost = [int((rejected(x, steps[: k + 1]) & good).sum()) for k in range(len(steps))]
        chosen = steps[: quality.steps_passed(int(good.sum()), lost, risk, delta)]
        used += bool(chosen)
        fresh, ok = draw(20_000)
        broken += (rejected(fresh, chosen) & ok).sum() / ok.sum() > risk
    assert used > 100 and broken <= 0.1 * 400 + 3 * (400 * 0.1 * 0.9) ** 0.5


# 8 Lines

def test_lines(spark):
    common, rare = "This line is in very many of these documents, ok", "This line is in four documents only, so it stays"
    rows = [(i, "\n".join([f"own {i}", common.upper() if i % 2 else f"  {common}\t", rare if i < 4 else "", common if i == 3 else ""])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in linededup.line_report(df).collect()}
    for i, t in rows:
        keep = [x for x in t.split("\n") if x.strip().lower() != common.lower() or i == 39]
        assert got[i]["kept_sha256"] == hashlib.sha256("\n".join(keep).encode()).hexdigest() and got[i]["n_dropped"] == 4 - len(keep)
    assert got[3]["dropped_runs"] == "1+1,3+1"
    texts = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(df).collect()}
    assert all(hashlib.sha256(texts[i].encode()).hexdigest() == got[i]["kept_sha256"] for i in texts)


# 9 Mixing

def resharing(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[n] for n in open_)
        now = {n: left * w[n] / total for n in open_}
        over = [n for n in open_ if now[n] > most * sizes[n]]
        if not over:
            return out | now
        for n in over:
            out[n] = most * sizes[n]
            left -= out[n]
            open_.discard(n)
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, "d": 10, None: 5}, {"x": 0, "y": 7}, {"only": 3}, {"a": 500, "b": 20, "c": 20, "d": 20, "e": 400, "f": 90, "g": 1}])
def test_targets(spark, sizes):
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(resharing(sizes))


def test_mix(spark):
    rows = [(i, text_of(rng.randint(0, 60)), f"s{min(i % 10, 4)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    sizes, taken = Counter(), Counter()
    for x in got:
        source = rows[x["doc_id"]][2]
        assert x["size"] == len(rows[x["doc_id"]][1].split()) and x["taken"] <= 2 * x["size"]
        sizes[source] += x["size"]
        taken[source] += x["taken"]
    for source, target in resharing(sizes).items():
        assert abs(taken[source] - target) <= 60
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_report(df.repartition(7)).collect()))
    assert Counter(x["doc_id"] for x in mixing.mix(df).collect()) == Counter({x["doc_id"]: x["copies"] for x in got if x["copies"]})


# 10 WARC

def test_zip_directories():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("archive/a.warc", b"one")
        with z.open("archive/b.warc.gz", "w", force_zip64=True) as f:
            f.write(b"two" * 100)
        z.writestr(zipfile.ZipInfo("pages/x"), b"packed" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 in a comment"

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    d = warczip.ZipDirectory(Source(data.getvalue()))
    assert d.archives() == ["archive/a.warc", "archive/b.warc.gz"] and d.read("archive/a.warc", 1, 2) == b"ne" and d.read("archive/b.warc.gz", 3, 3) == b"two"
    with pytest.raises(warczip.BadPackage):
        d.stored("pages/x")
    with pytest.raises(warczip.BadPackage):
        warczip.ZipDirectory(Source(b"no zip"))
    with pytest.raises(warczip.BadPackage):
        warczip.ZipDirectory(Source(data.getvalue()[:40]))


def test_zip64_end_record(monkeypatch):
    data = io.BytesIO()
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    with zipfile.ZipFile(data, "w") as z:
        for k in range(5):
            z.writestr(f"archive/{k}.warc", bytes([k]))

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    assert b"PK\x06\x07" in data.getvalue()
    d = warczip.ZipDirectory(Source(data.getvalue()))
    assert len(d.archives()) == 5 and d.read("archive/3.warc", 0, 1) == b"\x03"


def test_round_trip_without_index(tmp_path):
    path = f"file://{tmp_path}/p.wacz"
    body = [b"", b"x" * 400_000, "é".encode() * 10]
    rows = [(i, f"http://h/{i} \r\nx", "response", b, len(b), hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(body)] + [(9, None, "revisit", b"", 5, "d", 1)]
    assert warczip.write_package(path, rows) == 4
    want = [b for b in body] + [b""]
    assert [b for _, b in warczip.read_records(path)] == want
    bare = tmp_path / "bare.wacz"
    with zipfile.ZipFile(tmp_path / "p.wacz") as a, zipfile.ZipFile(bare, "w") as b:
        b.writestr(warczip.DATA, a.read(warczip.DATA))
    assert [b for _, b in warczip.read_records(f"file://{bare}")] == want


def test_design_half_counts_whole(spark, monkeypatch):
    """45,000 documents of the design half are all in the counts, and the sequence is that of the documents one by one."""
    seen, real = [], quality.sequence_of

    def noted(ratios, good, **more):
        out = real(ratios, good, **more)
        seen.append((out, int(np.sum(more["n"])) if more.get("n") is not None else len(good)))
        return out

    monkeypatch.setattr(quality, "sequence_of", noted)
    stats = spark.range(90_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(100).cast("long").alias("n_words"), (600 + F.pmod(F.hash("id"), F.lit(100))).cast("long").alias("word_chars"), F.pmod(F.hash("id", F.lit(1)), F.lit(200)).cast("long").alias("n_symbols"), *[F.lit(0).cast("long").alias(c) for c in ("n_dup_lines", "n_repeat_words", "n_lines", "n_single", "n_upper")])
    labels = stats.select("doc_id", F.when((F.col("n_symbols") > 120) & (F.col("doc_id") % 9 > 0), 0).otherwise(1).alias("quality"))
    quality.fit(stats, labels)
    rows = stats.join(labels, "doc_id").filter(~quality.held_half(F.col("doc_id"))).select("quality", *quality.ratios().values()).collect()
    assert len(rows) > 40_000 and len(seen) == 1 and seen[0][0]
    assert seen[0] == (real(np.array([r[1:] for r in rows], float), np.array([r[0] == 1 for r in rows])), len(rows))
