"""The registered queries against their SQL and, where there is none, brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from skylattice.llm import queries
from skylattice.llm.url_filter import RULES, url_filter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def test_url_filter(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op1_url_filter(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        fits = [(h + p, v) for h, p, v in RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host.lower(), path, rule)
        assert r["verdict"] == (verdict or ("block" if r["pattern"] else "allow"))


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_language_id(spark, sf_dir).join(docs, "doc_id").filter("held_out and lang is not null").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_id_by_brute_force(spark, sf_dir, texts):
    """Predictions again from the model's tables, one n-gram at a time."""
    from skylattice.llm import language_id as own

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = own.fit(docs)
    got = {r["doc_id"]: r for r in own.language_id(docs, model).collect()}
    wide = (1 << 64) - 1
    for doc in sorted(texts)[:40]:
        letter = lambda c: 0x61 <= c <= 0x7A or (c >= 0xAA and not 0x2000 <= c < 0x2C00 and not 0x3000 <= c < 0x3041)
        points = [ord(c) if letter(ord(c)) else 0x20 for c in f" {texts[doc]} ".lower()]
        points = [c for i, c in enumerate(points) if c != 0x20 or i == 0 or points[i - 1] != 0x20]
        sums, n = [0.0] * len(model.languages), 0
        for i in range(len(points)):
            h = 0
            for k in range(min(max(own.GRAMS), len(points) - i)):
                h = (h * 0x100000001B3 + points[i + k]) * 0x9E3779B97F4A7C15 & wide
                h ^= h >> 29
                gram = points[i : i + k + 1]
                if 0x20 in gram[1:-1] or gram == [0x20]:
                    continue
                row = h >> (65 - own.ROWS.bit_length())
                sums = [a + float(b) for a, b in zip(sums, model.table[row])]
                n += 1
        z = [(a / max(1, n) + b) / model.temperature for a, b in zip(sums, model.bias)]
        p = [math.exp(x - max(z)) for x in z]
        best = p.index(max(p))
        if any(map(str.isalpha, texts[doc])):
            assert got[doc]["lang_pred"] == model.languages[best] and got[doc]["score"] == pytest.approx(p[best] / sum(p), abs=1e-6)
        else:
            assert (got[doc]["lang_pred"], got[doc]["score"]) == ("und", 0)


def test_mined_rules_by_brute_force(spark):
    """Rules of all token sets, pruned by support, confidence, lift and shorter rules; verdicts."""
    rng = random.Random(6)
    rows = [(i, "http://" + rng.choice("abc") + ".org/" + "/".join(rng.sample(["x", "y", "z", "w"], rng.randint(0, 3)))) for i in range(400)]
    bad = {i for i, u in rows if rng.random() < (0.9 if "x" in u[13:] and "y" in u[13:] else 0.1)}
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(250)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}

    def tokens(u):
        host, _, path = u.partition("://")[2].partition("/")
        return frozenset([f"h:{x}" for x in host.split(".")] + [f"p:{x}" for x in path.split("/") if x])

    sets = [tokens(u) for _, u in rows[:250]]
    rules = {}
    for n in range(1, 6):
        for a in {c for s in sets for c in itertools.combinations(sorted(s), n)}:
            holds = [i for i, s in enumerate(sets) if set(a) <= s]
            hit = sum(i in bad for i in holds)
            sure = hit / len(holds)
            if hit / 250 >= 10 / 250 and sure >= 0.6 and sure / (len([i for i in bad if i < 250]) / 250) >= 1.5:
                rules[a] = sure
    rules = {a: c for a, c in rules.items() if not any(set(b) < set(a) and d >= c for b, d in rules.items())}
    assert len(rules) > 1
    for i, u in rows:
        fits = [(c, " ".join(a)) for a, c in rules.items() if set(a) <= tokens(u)]
        assert got[i]["verdict"] == ("block" if fits else "allow")
        assert (got[i]["pattern"], got[i]["confidence"]) == ((max(fits)[1], pytest.approx(max(fits)[0])) if fits else (None, None))


def test_mixing_by_brute_force(spark, sf_dir):
    """Raking and the scale again in plain Python, from the rows' own cells."""
    rows = queries.op9_mixing(spark, sf_dir).collect()
    cells = defaultdict(float)
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    total, raked = sum(cells.values()), dict(cells)
    want = []
    for m, power in enumerate((0.5, 0.7, 0.5)):
        margin = defaultdict(float)
        for c, n in cells.items():
            margin[c[m]] += n
        shares = {v: n**power for v, n in margin.items() if n > 0}
        want.append({v: s / sum(shares.values()) * total for v, s in shares.items()})
    for _ in range(48):
        off = 0.0
        for m in range(3):
            sums = defaultdict(float)
            for c, n in raked.items():
                sums[c[m]] += n
            off = max([off, *[abs(sums[v] - w) / w for v, w in want[m].items() if sums[v] > 0]])
            raked = {c: n * want[m][c[m]] / sums[c[m]] if sums[c[m]] > 0 else 0.0 for c, n in raked.items()}
        if off < 1e-3:
            break
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        kept = sum(min(n, raked[c] * mid) for c, n in cells.items() if n > 0)
        low, high = (mid, high) if kept <= total / 2 else (low, mid)
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        p = min(1.0, raked[c] * low / cells[c]) if cells[c] else 0.0
        assert r["probability"] == pytest.approx(p, rel=1e-5, abs=1e-12)
        if p > 0:
            assert r["weight"] == pytest.approx(raked[c] * low / cells[c] / p, rel=1e-5)


def test_secret_scan(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smaller tables hold no secret
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kinds = [("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]
    found = 0
    for r in queries.op6_secret_scan(spark, sf_dir).collect():
        spans = [(m.start(), i, m.end()) for i, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, texts[r["doc_id"]], re.ASCII) if len(m[g]) >= least]
        told = [f"{kinds[i][0]}:{a}:{b}" for a, i, b in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(i == k for _, i, _ in spans) for k in range(3)]
        assert set(told) <= set(r["spans"].split(","))
        found += len(told)
    assert found


def test_simhash_dedup(spark, sf_dir, texts):
    prints = {}
    for doc, text in texts.items():
        words = [w for w in SPACE.split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_dedup(spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", root(d)) for d in prints}


def test_mixing(spark, sf_dir, texts):
    rows = queries.op9_mixing(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    total = sum(r["n_tokens"] for r in rows)
    assert all(r["n_tokens"] == len([w for w in SPACE.split(texts[r["doc_id"]]) if w]) for r in rows)
    kept = sum(r["n_tokens"] * r["probability"] for r in rows)
    assert kept == pytest.approx(total / 2, rel=0.01)
    # expected weighted tokens of each source are in proportion to the root of its own
    own, raked = defaultdict(float), defaultdict(float)
    for r in rows:
        own[r["source"]] += r["n_tokens"]
        raked[r["source"]] += r["n_tokens"] * r["probability"] * r["weight"]
    want = {s: n**0.5 for s, n in own.items()}
    for s in own:
        assert raked[s] / sum(raked.values()) == pytest.approx(want[s] / sum(want.values()), rel=0.02)


def test_token_counts(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for r in queries.op10_token_counts(spark, sf_dir).collect():
        text = texts[r["doc_id"]]
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.stash(spark, stage(spark, before, sf_dir), f"test-{name}")
        assert docs.columns == before.columns
        kept = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        came = {r["doc_id"]: r["text"] or "" for r in before.select("doc_id", "text").collect()}
        assert set(kept) <= set(came)  # the small tables have a language for all
        if name == "language":
            assert all(any(map(str.isalpha, t)) for t in kept.values()) and len(kept) > 0.95 * len(came)
        if name == "exact":
            groups = defaultdict(list)
            for d, t in came.items():
                groups[SPACE.sub(" ", t)].append(d)
            assert set(kept) == {min(g) for g in groups.values()}
    whole = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert whole < set(kept)
