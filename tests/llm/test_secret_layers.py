"""Secrets in layers that aren't clean: marks, other encodings, stray bytes, lines, members."""

import base64
import bz2
import gzip
import lzma
import os
import random
import subprocess
import sys
import time
import urllib.parse
import zlib

import pytest

from skylattice.llm.secret_scan import secrets

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
KEY = "AKIA" + "QRST5678" * 2
NOISE = "".join(random.Random(1).choice("ghijkl mnop") for _ in range(400))


def _b64(raw, width=0):
    text = base64.b64encode(raw).decode()
    return "\n".join(text[i : i + width] for i in range(0, len(text), width)) if width else text


@pytest.mark.parametrize("raw", [b"\xef\xbb\xbfid=" + KEY.encode(), b"a\0b\x1b " + KEY.encode(), b"\xff\xfe " + KEY.encode(), KEY.encode("utf-16"), KEY.encode("utf-16-be"), gzip.compress(b"one") + gzip.compress(KEY.encode()), gzip.compress(KEY.encode("utf-16"))])
def test_unclean_layers(raw):
    text = f"see {_b64(raw)} end"
    spans = secrets(text)[1]
    assert any(k == "access" and 4 <= a < b <= len(text) - 4 for a, b, k in spans), spans


@pytest.mark.parametrize("raw", [gzip.compress((NOISE + KEY).encode()), (NOISE[:50] + KEY + NOISE).encode()])
@pytest.mark.parametrize("head", ["", "-----BEGIN CERTIFICATE-----\n"])
def test_wrapped_lines(raw, head):
    text = head + _b64(raw, 64) + "\n"
    assert any(k == "access" and len(head) <= a < b < len(text) for a, b, k in secrets(text)[1])


def test_stray_percent_bytes():
    hidden = "".join(f"%{b:02X}" for b in KEY.encode())
    assert (3, 3 + len(hidden), "access") in secrets(f"%FF{hidden}%FE")[1]


def test_layer_across_any_seam():
    """An encoded layer of 300 kB deep in a large decompressed one, at several places."""
    rng = random.Random(4)
    inner = _b64(gzip.compress(bytes(rng.randrange(32, 127) for _ in range(200_000)) + KEY.encode(), 1))
    for pad in (0, (1 << 20) - 7, (4 << 20) - 150_000):
        text = "x " + _b64(gzip.compress(b"plain " * (pad // 6) + b" " * (pad % 6) + inner.encode() + b" end"))
        assert (2, len(text), "access") in secrets(text)[1], pad


def test_bombs_take_little_memory():
    """Texts of some 300 kB that unpack to 48 MB, one of them twice over."""
    raw = gzip.compress(b"nothing to see " * (48 * 70_000) + KEY.encode())
    for body in (raw, gzip.compress(_b64(raw).encode())):
        text = _b64(body)
        code = f"import sys, resource; sys.path.insert(0, {ROOT!r})\nfrom skylattice.llm.secret_scan import secrets\nt = sys.stdin.read(); before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nimport os\nprint((0, len(t), 'access') in secrets(t)[1])\nprint([int(x.split()[1]) for x in open('/proc/self/status') if x.startswith('RssAnon')][0], before)"
        out = subprocess.run([sys.executable, "-c", code], input=text, capture_output=True, text=True, check=True).stdout.split()
        assert out[0] == "True" and int(out[1]) < int(out[2]) + 100_000  # kB


@pytest.mark.parametrize("seed", range(12))
def test_nested_layers_by_brute_force(seed):
    """Random nests of encodings around a key: found, and within the place they were put at."""
    rng = random.Random(seed)
    wrap = {
        "percent": lambda t: "".join(f"%{b:02x}" for b in t.encode()),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "html": lambda t: "".join(f"&#{ord(c)};" for c in t),
        "base64": lambda t: _b64(t.encode()),
        "lines": lambda t: _b64(t.encode(), 60),
        "gzip": lambda t: _b64(gzip.compress(t.encode())),
        "bz2": lambda t: _b64(bz2.compress(t.encode())),
        "xz": lambda t: _b64(lzma.compress(t.encode())),
    }
    text, names = f"id {KEY} é", [rng.choice(sorted(wrap)) for _ in range(rng.randint(1, 4))]
    for n in names:
        text = wrap[n](text)
    head = "före "
    spans = secrets(head + text + " !")[1]
    assert any(k == "access" and len(head) <= a < b <= len(head + text) for a, b, k in spans), names


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "bz2": bz2.compress, "xz": lzma.compress}


@pytest.mark.parametrize("seed", range(8))
def test_compressed_in_compressed(seed):
    """Nests of compressed layers with nothing between them, in base64 or in escapes of their bytes."""
    rng = random.Random(seed)
    key = "AKIA" + "".join(rng.choice("ABCD1234") for _ in range(16))
    data = f"say {key} now, and {rng.random()}".encode()
    for _ in range(rng.randint(1, 6)):
        data = rng.choice(list(PACKERS.values()))(data)
    written = {"base64": base64.b64encode(data).decode(), "percent": "".join(f"%{b:02x}" for b in data), "url": urllib.parse.quote_from_bytes(data), "escapes": "".join(f"\\x{b:02X}" for b in data), "repr": repr(data)[2:-1]}
    quote = repr(data)[1]
    for name, text in written.items():
        _, spans = secrets(f"é v={quote}{text}{quote} and more")
        assert (5, 5 + len(text), "access") in spans, name
        # as text within base64
        assert any(kind == "access" and a <= 2 and b >= len(base64.b64encode(text.encode()).rstrip(b"=")) - 4 for a, b, kind in secrets(base64.b64encode(f"{quote}{text}{quote}".encode()).decode())[1]), name


def test_many_secrets_in_a_layer():
    """Positions of many secrets in a layer cost no more each than those of few."""
    for mark in ("", "é", "\U0001f600"):
        text = f" {mark}".join(f"token=abcdefgh{i}" for i in range(40_000))
        coded = base64.b64encode(text.encode()).decode()
        began = time.perf_counter()
        _, spans = secrets(coded)
        assert len(spans) == 40_000 and time.perf_counter() - began < 5
        raw = text.encode()
        for a, b, _ in spans[:: 4_001]:
            at = raw.index(b"token=", max(0, a * 3 // 4 - 1))
            assert a == at * 4 // 3 and b >= (at + len(b"token=abcdefgh")) * 4 // 3
