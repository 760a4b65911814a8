"""The pipeline against brute force: each stage done again in plain Python, from its definition, on what its predecessor wrote."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codestrata.llm import packing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# Toxicity: log-odds, maximal segments by recursion, extreme-value calibration, logistic fit.

def best_segments(values, base=0):
    """(score, first, last) of all maximal segments of a sequence, by taking out the best one and going on left and right."""
    best = None
    for i in range(len(values)):
        total = 0.0
        for j in range(i, len(values)):
            total += values[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                best = (total, i, j)
    if best is None:
        return []
    s, i, j = best
    return best_segments(values[:i], base) + [(s, base + i, base + j)] + best_segments(values[j + 1 :], base + j + 1)


def evidence_of(text, scores, drift, lam, k, expected=0.05):
    words = re.findall(r"\w+", (text or "").lower())
    hits = [i for i, w in enumerate(words) if w in scores]
    compressed, last = [], -1
    for i in hits:  # gaps between hits are one negative number
        if i - last > 1:
            compressed.append(drift * (i - last - 1))
        compressed.append(scores[words[i]])
        last = i
    segments = [s for s, _, _ in best_segments(compressed)]
    chance = math.log(max(k * len(words), 1e-300)) if words else 0.0
    return sum(e for s in segments if (e := lam * s - chance) >= -math.log(expected)), segments, len(words)


def toxicity_stage(rows, labels):
    label = {}
    for r in labels:
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            label[r["doc_id"]] = max(label.get(r["doc_id"], 0), r["toxic"])
    texts = {}
    for r in rows:
        if r["doc_id"] in label and r["text"] is not None:
            texts[r["text"]] = max(texts.get(r["text"], 0), label[r["doc_id"]])
    count = {0: Counter(), 1: Counter()}
    for text, toxic in texts.items():
        count[toxic].update(set(re.findall(r"\w+", text.lower())))
    nt, nc = sum(count[1].values()), sum(count[0].values())
    if not nt or not nc:
        return rows
    scores = {}
    for w in set(count[0]) | set(count[1]):
        t, c = count[1][w], count[0][w]
        share = 1000.0 * (t + c) / (nt + nc)
        odds = math.log((t + share) / (nt + 1000 - t - share)) - math.log((c + share) / (nc + 1000 - c - share))
        g2 = 2 * sum(n * math.log(n / ((t + c) * of / (nt + nc))) for n, of in ((t, nt), (c, nc)) if n)
        if odds > 0 and g2 >= 25 and t >= 4:
            scores[w] = odds
    pc = {w: (count[0][w] + 0.5) / (nc + 0.5 * len(scores) + 1) for w in scores}
    rest = math.log(max(1e-9, 1 - sum(count[1][w] for w in scores) / nt) / max(1e-9, 1 - sum(count[0][w] for w in scores) / nc))
    drift = min(rest, -2 * sum(pc[w] * s for w, s in scores.items()), -0.005)
    lam = 1.0
    if scores:
        f = lambda x: max(0.0, 1 - sum(pc.values())) * math.exp(x * drift) + sum(pc[w] * math.exp(x * s) for w, s in scores.items()) - 1
        lo, hi = 1e-6, 1.0
        while f(hi) < 0 and hi < 64:
            lo, hi = hi, 2 * hi
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if f((lo + hi) / 2) < 0 else (lo, (lo + hi) / 2)
        lam = hi
    level = float(np.median(list(scores.values()))) if scores else 1.0
    raw = [(y, *evidence_of(x, scores, drift, lam, 1.0)[1:]) for x, y in texts.items()]
    above = sum(sum(s >= level for s in segs) for y, segs, _ in raw if not y)
    k = (above + 0.5) / max(1.0, sum(n for y, _, n in raw if not y) * math.exp(-lam * level))
    x = np.array([math.log1p(evidence_of(t, scores, drift, lam, k)[0]) for t in texts])
    y = np.array(list(texts.values()), float)
    w = np.zeros(2)  # the same convex function by plain gradient steps on its Newton direction
    d = np.stack([np.ones_like(x), x], 1)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        w += np.clip(np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag([1e-6, 1e-2]), d.T @ (y - p) - np.diag([1e-6, 1e-2]) @ w), -2, 2)
    bias, slope = w[0], max(0.0, w[1])
    known = Counter(r["toxic"] for r in labels if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1)
    if known[0] and known[1] and y.sum() and (1 - y).sum():
        bias += math.log(known[1] / known[0]) - math.log(y.sum() / (1 - y).sum())
    score = lambda t: 1 / (1 + math.exp(-(bias + slope * math.log1p(evidence_of(t, scores, drift, lam, k)[0]))))
    return [r for r in rows if score(r["text"]) < 0.7]


def line_stage(rows):
    key = lambda line: lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r["doc_id"])
    keeper = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= 5}
    out = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == r["doc_id"]]
        out.append(r if len(kept) == len(lines) else r | {"text": "\n".join(kept)})
    return out


def fingerprint(text):
    words = WORD.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_stage(rows):
    fps = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3 or (rows[i]["doc_id"] is not None and rows[i]["doc_id"] == rows[j]["doc_id"]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    text_hash = lambda r: hashlib.md5((r["text"] or "").encode()).hexdigest()
    json_of = lambda r: json.dumps({k: v for k, v in r.items() if v is not None}, separators=(",", ":"), ensure_ascii=False)
    return [rows[min(g, key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, signed(fps[i]), text_hash(rows[i]), json_of(rows[i])))] for g in groups.values()]


def mixing_stage(rows):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    draw = lambda r: int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:9], 16)
    sources = defaultdict(list)
    for r in rows:
        sources[r["source"]].append(r)
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(map(size, sources[s])) for s in names}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        now = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if now[s] > 2 * total[s]]
        if not over:
            target |= now
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
            open_.discard(s)
    out = []
    for s in names:
        whole = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        budget, upto = target[s] - whole * total[s], 0
        by_draw = defaultdict(list)
        for r in sources[s]:
            by_draw[draw(r)].append(r)
        for u in sorted(by_draw):
            n = sum(map(size, by_draw[u]))
            more = upto + n <= budget or 2 * (budget - upto) >= n
            for r in by_draw[u]:
                out += [r] * (whole + more)
            upto += n
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with rows without id, repeated ids, copies and extra columns planted, in a folder of their own."""
    folder = tmp_path_factory.mktemp("sf")
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = random.Random(3)
    words = sorted({w for d in docs[:40] for w in (d["text"] or "").split()})[:400]
    unique = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = "A line of more than forty characters that very many of the rows hold"
    big = next(d for d in docs if d["text"] and len(d["text"].split()) > 200)
    planted = [
        {"doc_id": None, "text": docs[0]["text"]},
        {"doc_id": None, "text": unique(150)},
        {"doc_id": None, "text": big["text"].upper()},
        {"doc_id": 900_001, "text": unique(120)},
        {"doc_id": 900_001, "text": unique(130)},
        {"doc_id": 900_002, "text": unique(90), "source": "again"},
        {"doc_id": 900_002, "text": None},
        *({"doc_id": 900_010 + k, "text": f"{unique(60)}\n{shared}\n{unique(5)}"} for k in range(7)),
        {"doc_id": None, "text": f"{unique(70)}\n  {shared.upper()}"},
    ]
    toxic = {}
    for k in range(240):
        toxic[800_000 + k] = int(k % 4 == 0)
        text = unique(60).split()
        for _ in range(4 * toxic[800_000 + k]):
            text.insert(r.randrange(len(text)), r.choice(["grubfoul", "mudwretch", "vilescum"]))
        planted.append({"doc_id": 800_000 + k, "text": " ".join(text), "source": "talk"})
    same = {"doc_id": 900_003, "text": unique(100)}
    planted += [same, dict(same)]
    docs += [{"lang": "en", "source": None, "n_chars": 1} | p for p in planted]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    df = spark.createDataFrame([tuple(d.get(f.name) for f in schema) for d in docs], schema)
    df = df.withColumns({c: F.lit("x") for c in ("__d", "key", "row", "text_key", "__dropped", "copies", "score")})
    df.repartition(5).write.parquet(f"{folder}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").select(*[F.col(f.name).cast(f.dataType) for f in labels.schema])).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def counted(rows):
    return Counter(tuple((k, r[k]) for k in sorted(r)) for r in rows)


def test_every_stage_against_brute_force(spark, tables, tmp_path):
    labels = rows_of(spark.read.parquet(f"{tables}/labels.parquet"))
    slow = {"toxicity": lambda rows: toxicity_stage(rows, labels), "line dedup": line_stage, "simhash near-dedup": near_stage, "mixing": mixing_stage}
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ends = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, docs, tables).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == columns
        before, after = rows_of(docs), rows_of(out)
        assert counted(after) == counted(slow[name](before)), name
        ends[name] = (len(before), len(after))
        docs = out
    assert ends["toxicity"][1] < ends["toxicity"][0] and ends["simhash near-dedup"][1] < ends["simhash near-dedup"][0]

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = Counter()
    for r in rows_of(docs):
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        n = len(ids)
        cuts = [0, n] if n <= 1024 else [*([0] if n % 1024 else []), *range(n % 1024, n + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    rows = rows_of(corpus_pipeline.run(spark, tables))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    filled = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024
    room = []  # best fit, longest first: the plan must not need more
    for k in sorted((r["length"] for r in rows), reverse=True):
        fits = [(x, i) for i, x in enumerate(room) if x >= k]
        if fits:
            room[min(fits)[1]] -= k
        else:
            room.append(1024 - k)
    assert len(filled) <= len(room)
