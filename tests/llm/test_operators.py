"""Operators on small made tables: odd rows, odd columns, and what their queries don't reach."""

import base64
import gzip
import hashlib
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from skylattice.llm.decontamination import decontamination
from skylattice.llm.exact_dedup import exact_dedup
from skylattice.llm import fill_in_middle as fim
from skylattice.llm.language_id import language_id
from skylattice.llm.license_scan import TEMPLATES, license_scan
from skylattice.llm.merkle_manifest import Traversal, folded, joined, levels, lowered_fifth, merkle_manifest
from skylattice.llm.mixing import mixing
from skylattice.llm.secret_scan import secrets, secret_scan
from skylattice.llm.simhash_dedup import connected, links, simhash_dedup
from skylattice.llm.substring_dedup import substring_dedup
from skylattice.llm.token_counts import token_counts
from skylattice.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, text_sha256 string, locator string, topic string, block int, fp string, items string"
LONG = "the quick brown fox jumps over a lazy dog near the river bank " * 4000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing columns."""
    more = (1, "r", "s", "l", "t", 2, "f", "i")
    rows = [(1, "some plain words here", "en", "web", *more), (1, "some plain words here", "en", "web", *more), (2, None, None, None, *[None] * 8), (None, "a text without an id", "en", None, *more), (3, "", "en", "web", *more), (4, " \t\n", None, "web", *more), (5, LONG, "en", "book", *more), (6, "漢字 \U0001f600 é\u0000x", "zh", "web", *more), (7, "12345 678", "en", "web", *more)]
    return spark.createDataFrame(rows, SCHEMA)


def _tests(spark):
    return spark.createDataFrame([("1", "brown fox jumps over a lazy dog", 1), ("2", None, 1), (None, "", 1)], "item_id string, text string, spans int")


def _token(docs):
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


OPERATORS = {"license": license_scan, "decontamination": lambda d: decontamination(d, _tests(d.sparkSession)), "language": language_id, "substring": substring_dedup, "secret": secret_scan, "exact": exact_dedup, "simhash": simhash_dedup, "mixing": lambda d: mixing(d).select("row.doc_id", "n_tokens", "kept"), "token": _token, "middle": fim.fill_in_middle, "manifest": merkle_manifest}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(name, spark, odd):
    rows = OPERATORS[name](odd).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    twins = [r for r in rows if r["doc_id"] == 1]
    if name == "exact":  # one of two rows with one id stays; their places tell them apart
        assert sorted(r["kept"] for r in twins) == [False, True]
        twins = [(r["keep_id"], r["group_size"], r["text_sha256"]) for r in twins]
    if name == "manifest":
        assert all(r["verified"] for r in rows)
    assert twins[0] == twins[1]
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_odd_values(spark, odd):
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    assert {k: v["lang_pred"] for k, v in by(language_id(odd)).items() if v["score"] == 0} == {2: "und", 3: "und", 4: "und", 7: "und"}
    exact = by(exact_dedup(odd))
    assert exact[2]["keep_id"] == exact[3]["keep_id"] == 2 and exact[4]["keep_id"] == 4 and exact[2]["group_size"] == 2
    sim = by(simhash_dedup(odd))
    assert sim[2]["fingerprint"] == sim[4]["fingerprint"] == "0" * 16 and sim[4]["component_id"] == 2
    sub = by(substring_dedup(odd))
    assert sub[5]["n_removed"] == sub[5]["n_words"] == 52000 and sub[6]["n_removed"] == 0
    hit = by(decontamination(odd, _tests(spark)))
    assert hit[5]["n_hit"] == 4000 * 7 and hit[5]["contaminated"] and hit[5]["items"] == ["1"] and not hit[1]["contaminated"] and hit[2]["n_words"] == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "http://A.Example.COM/en/x?q#f", "x"), (3, "http://A.Example.COM/en/x?q#f", "x"), (None, "ftp://x.net", "x"), (4, "a://b://net/es/", "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, labels).collect() if r["rule"] or not r["host"])
    assert got == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/x", "example.com/en/", "block"), (3, "a.example.com", "/en/x", "example.com/en/", "block")]
    assert url_filter(pages.limit(0), labels).count() == 0 and url_filter(pages, labels.limit(0)).count() == 6


def test_mined_url_rules(spark):
    rows = [(i, f"http://site{i % 7}.org/{'promo/win' if i % 3 == 0 else 'promo/news' if i % 3 == 1 else 'win/notes'}/{i}") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 3 == 0) for i in range(600))
    assert got[300]["pattern"] == "p:promo p:win" and got[300]["confidence"] == 1.0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha big beta gamma"), (2, "alpha beta gamma"), (3, "gamma alpha far far far beta")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hits = lambda slop: {r["doc_id"]: r["n_hit"] for r in decontamination(docs, tests, slop=slop).collect()}
    assert hits(0) == {1: 0, 2: 3, 3: 0} and hits(1) == {1: 4, 2: 3, 3: 0}


def test_clashing_digests(spark):
    """A digest of one byte puts different texts together; their bytes tell them apart."""
    texts = [f"text {i % 40}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(docs, digest=lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2))).collect()}
    assert got == {i: (i % 40, texts.count(t)) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", range(4))
def test_substrings_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdef") for _ in range(rng.randint(3, 12))] for _ in range(6)]
    words = [sum((rng.choice(pool) if rng.random() < 0.3 else [str(rng.randint(0, 10**6)) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(0, 12))), []) for _ in range(40)]
    n = 7
    starts: dict = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            starts.setdefault(tuple(w[i : i + n]), []).append((d, i))
    gone = {(d, i + k) for at in starts.values() if len(at) > 1 for d, i in at for k in range(n)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(words)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup(docs, window=n).collect()}
    assert gone and got == {d: (sum((d, i) in gone for i in range(len(w))), " ".join(x for i, x in enumerate(w) if (d, i) not in gone)) for d, w in enumerate(words)}


def test_nested_secrets():
    key = "AKIA" + "ABCD1234" * 2
    packed = base64.b64encode(gzip.compress(f"say {key} now".encode())).decode()
    hidden = "".join(f"%{b:02X}" for b in key.encode())
    escaped = "".join(f"\\u{ord(c):04x}" for c in "password") + "=hunter2hunter2"
    for text, kind, a, b in ((f"see {packed} end", "access", 4, 4 + len(packed)), (f"é {hidden}!", "access", 2, 2 + len(hidden)), (escaped, "assign", 0, len(escaped)), (base64.b64encode(hidden.encode()).decode(), "access", 0, None)):
        base, spans = secrets(text)
        assert all(k != kind for _, _, k in base)
        assert any(k == kind and s == a and (b is None or e == b) for s, e, k in spans), (text, spans)
    assert secrets("%2541%2542") == ([], []) and secrets("") == ([], [])


def test_dense_links(spark):
    """Many fingerprints that share keys: components as by comparing all pairs."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(80)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    edges = connected(links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4))
    got = {x: x for x in signed} | {r["node"]: r["root"] for r in edges.collect()}
    left, want = set(signed), {}
    while left:
        todo = [min(left)]
        first = todo[0]
        left.discard(first)
        while todo:
            x = todo.pop()
            want[x] = first
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 4}
            left -= near
            todo.extend(near)
    assert got == want


def test_licences(spark):
    mit = TEMPLATES["MIT-text"]
    docs = spark.createDataFrame([(1, "intro\n\n" + mit.upper() + "\n\nouttro"), (2, mit.replace("software", "thing", 1)), (3, mit[: len(mit) // 3]), (4, "Released under the MIT License.\nno more")], "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["dice"], r["n_lines"]) for r in license_scan(docs).collect()}
    assert got[1] == ("MIT-text", 1.0, 1) and got[2][0] == "MIT-text" and 0.8 <= got[2][1] < 1 and got[3] == (None, 0.0, 0) and got[4] == ("MIT", 1.0, 1)


def test_whole_licence_files(spark):
    """Licence files with a copyright line, wrapped lines, comment marks or other text around."""
    full = {n: t for n, t in TEMPLATES.items() if n.endswith("-full")}
    wrap = lambda t, mark="", end="\n": end.join(mark + line for line in textwrap.wrap(" ".join(t.split()), 70))
    shapes = [lambda t: "Copyright (c) 2020 Some One\n\n" + t, lambda t: wrap(t, " * "), lambda t: wrap(t, "# ", "\r\n"), lambda t: "other words before it " * 40 + wrap(t) + " and some after it" * 40]
    rows = [(f"{n}/{i}", shape(t)) for n, t in full.items() for i, shape in enumerate(shapes)]
    got = {r["doc_id"]: r["licenses"].split(",") for r in license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(k.partition("/")[0] in v for k, v in got.items()), [k for k, v in got.items() if k.partition("/")[0] not in v]
    line = spark.createDataFrame([(1, "As it says, this file is Released under the MIT License. Please read it.")], "doc_id long, text string")
    assert license_scan(line).first()["licenses"] == "MIT"


def test_targets_are_met(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (5 + i % 7), "en" if i % 4 else "de", f"s{i % 3}") for i in range(600)], "doc_id long, text string, lang string, source string")
    rows = mixing(docs, {"source": {"s0": 0.6, "s1": 0.3, "s2": 0.1}, "lang": {"en": 0.5, "de": 0.5}}).collect()
    for margin, want in (("source", {"s0": 0.6, "s1": 0.3, "s2": 0.1}), ("lang", {"en": 0.5, "de": 0.5})):
        mass = {v: sum(r["n_tokens"] * r["probability"] * r["weight"] for r in rows if r[margin] == v) for v in want}
        for v in want:
            assert mass[v] / sum(mass.values()) == pytest.approx(want[v], abs=0.01)


def test_special_tokens_and_long_runs(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b <|endoftext|><|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " " * 500 + "x", "don't  stop\n\n\n it", "日本語のテキスト", "\u0000\u0001"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in _token(docs).collect()} == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


@pytest.mark.parametrize("chunk", [3, 1 << 17])
@pytest.mark.parametrize("grammar", ["code_point", "word", "line"])
def test_units(spark, monkeypatch, grammar, chunk):
    """Units by a plain scan of neighbouring classes; chunks of three characters change nothing."""
    monkeypatch.setattr(fim, "CHUNK", chunk)
    rng = random.Random(11)
    texts = ["", "x", "\n", "a<S>b", "\U0001f600" * 5] + ["".join(rng.choice("ab1_ \t\n\r.,!é漢\U0001f600\u00a0") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.fill_in_middle(docs, grammar)
    got = {r["doc_id"]: r for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()}

    def kind(c):
        if grammar == "line":
            return "end" if c == "\n" else "rest"
        return "any" if grammar == "code_point" else "word" if c == "_" or c.isalnum() else "space" if c.isspace() else "other"

    joined = fim.GRAMMARS[grammar].joined
    for i, t in enumerate(texts):
        units = []
        for k, c in enumerate(t):
            if k and (kind(t[k - 1]), kind(c)) in joined:
                units[-1] += c
            else:
                units.append(c)
        r = got[i]
        h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not t or "<S>" in t or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        output = {"plain": t, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        lengths = (None, None) if form == "plain" else (len(prefix), len(middle))
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) == (len(units), form, *lengths, output, t)
    assert {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


def test_odd_units(spark, odd):
    by = {r["doc_id"]: r for r in fim.fill_in_middle(odd).collect()}
    assert [(by[i]["n"], by[i]["form"], by[i]["output"]) for i in (2, 3)] == [(0, "plain", "")] * 2
    assert by[5]["n"] == len(LONG) and by[None]["n"] == len("a text without an id") and by[6]["n"] == 8
    # marks of one's own, and a text in which they meet parts of themselves
    docs = spark.createDataFrame([(i, "[[a][P[S]]"[: 3 + i % 8]) for i in range(40)], "doc_id long, text string")
    rows = fim.fill_in_middle(docs, marks=("[P]", "[S]", "[M]"), transformed=100).withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[P]", "[S]", "[M]"))).collect()
    assert all(r["back"] == "[[a][P[S]]"[: 3 + r["doc_id"] % 8] for r in rows) and len({r["form"] for r in rows}) == 3


def _tree(leaves):
    """Root of a list of digests, and for each its siblings (before, after) level by level."""
    nodes, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            paths[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes = [hashlib.sha256("".join(nodes[k : k + 16]).encode()).hexdigest() for k in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], paths


def test_traversal():
    """Paths of blocks of any size and height, held in few digests."""
    for count in (1, 2, 15, 16, 17, 33, 255, 256, 257, 1000, 4096):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(count)]
        root, paths = _tree(leaves)
        block = Traversal([x.encode() for x in leaves], levels(count))
        got = [[(b"".join(a).decode(), b"".join(b).decode()) for a, b in path] for path in block]
        assert got == paths and block.root().decode() == root
    # a block in a taller tree joins runs of one node too
    assert Traversal([b"ab"], 2).root() == joined([joined([b"ab"])])
    assert folded(b"ab", [b"", b""], [b"", b""]) == joined([joined([b"ab"])])


@pytest.mark.parametrize("rows", [1, 40, 70_000])
def test_manifest(spark, rows):
    """A hot source of several rounds, a null and an empty one, nulls in all fields, repeated rows."""
    made = [(i, None if i % 11 == 0 else f"Text {i} É" if i % 7 else "", None if i % 5 == 1 else "en", "hot", i if i % 3 else None) for i in range(rows)]
    if rows > 1:
        made += [(i, "Same", "de", s, 4) for i in range(20) for s in (None, "", "é", "a,b")] + [(3, "Same", "de", None, 4)] * 2 + [(None, "No id", "de", "hot", 5)]
    random.Random(rows).shuffle(made)
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").withColumn("digest", F.lit(1)).withColumn("tree", F.lit("x"))

    def leaf(doc_id, text, lang, source, n_chars):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    sources = {}
    for r in made:
        low = r[1] if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        sources.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), leaf(r[0], low, *r[2:]) if hit else None))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    root, upper = _tree([trees[s][0] for s in order])
    want = []
    for s, above in zip(order, upper):
        for (known, doc_id, own, other), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            v = other or own
            for a, b in path + above:
                v = hashlib.sha256((a + v + b).encode()).hexdigest()
            proof = hashlib.sha256("".join(a + b for a, b in path + above).encode()).hexdigest()
            want.append((doc_id if known else -1, own, trees[s][0], root, proof, v, v == root))
    got = merkle_manifest(docs, lowered_fifth()).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in got) == sorted(want)
    assert rows == 1 or {r["verified"] for r in got} == {True, False}


def test_proofs_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    for r in merkle_manifest(docs, proofs=True).collect():
        before, after = [bytes(x) for x in r["before"]], [bytes(x) for x in r["after"]]
        assert folded(r["leaf"].encode(), before, after).decode() == r["root"] and r["verified"]
        assert folded(r["leaf"].encode()[::-1], before, after).decode() != r["root"]


def test_a_licence_behind_repeats(spark):
    """Repeats of a few of a licence's own bigrams before it, within one line; and random texts of
    pieces of templates, against all runs of a template's length."""
    mit = TEMPLATES["MIT-text"]
    loop = "the Software and to permit persons to whom "
    rng = random.Random(9)
    texts = [loop * 14 + "other words stand here " * 20 + mit]
    for _ in range(25):
        words = []
        for _ in range(rng.randint(1, 6)):
            own = rng.choice([mit, TEMPLATES["GPL-3.0-header"], loop * 5]).split()
            a = rng.randint(0, len(own) // 3)
            words += own[a : a + rng.randint(5, len(own))] + [f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))]
        texts.append(" ".join(words))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    grams = lambda w: list(zip(w, w[1:]))
    names = ("MIT-text", "GPL-3.0-header")
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), {n: TEMPLATES[n] for n in names}).collect()}
    assert got[0]["licenses"] == "MIT-text" and got[0]["dice"] == 1.0
    found = 0
    for i, t in enumerate(texts):
        own, best = grams(cut(t)), {}
        for n in names:
            template = grams(cut(TEMPLATES[n]))
            for a in [0, *(k for k, g in enumerate(own) if g in set(template))]:
                run = set(own[a : a + len(template)] if a else own)
                best[n] = max(best.get(n, 0), 2 * len(run & set(template)) / (len(run) + len(set(template))))
            first = set(own[: len(template)]) if own and own[0] in set(template) else set()
            best[n] = max(best[n], 2 * len(first & set(template)) / (len(first) + len(set(template))))
        assert got[i]["licenses"] == ",".join(sorted(n for n in names if best[n] >= 0.8)), i
        found += bool(got[i]["licenses"])
    assert found > 8
