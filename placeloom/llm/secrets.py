"""Secret scans: three exact patterns, and a linear-chain conditional random field.

Base spans are the leftmost non-overlapping matches of the fixed patterns ``assign``, ``access``
and ``hex``; a match that fails its length condition is dropped. The CRF (states outside, begin,
inside) tags all tokens of a text, runs of ``[A-Za-z0-9+/_=-]``, as one chain. Two kinds of token are
outside by constraint: those of fewer than ten characters, and plain words (letters in one case, but
for a first capital, and hyphens) with neither an assignment mark or quote before them nor a key
word shortly before. Between tokens of known state the chain falls apart: each piece is decoded with
the moves from and to its outside neighbours, which gives the same path as decoding the whole text.
Features are the token's shape, its neighbouring words and marks, and features of the whole file.

Training. The model learns from at most ``TRAIN_CHAINS`` chains (long ones in pieces of
``TRAIN_TOKENS``), those of smallest hash among
documents that hold a key word of the patterns (their base spans are the labels), and from a
fixed number of made-up assignments, tokens and harmless numbers drawn with a set seed.

Offsets count code points, ends are exclusive. Edge cases: a null text counts as empty and has no
spans; repeated rows get equal rows; an empty table gives an empty result (the model then learns
from the made-up rows alone); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover, pieces, table
from .crf import LinearChainCRF, bucket

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ finds them, of 16 or more
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TRAIN_CHAINS, MADE_UP, BUCKETS, SEED, LEAST = 4000, 1500, 1 << 14, 11, 10
TRAIN_TOKENS = 64
#: Words that make a plain word after them worth a look.
CUES = re.compile(r"(?i)(?:pass|pwd|secret|token|key|auth|bearer|credential)[^\n]{0,16}$")
O, B, I = range(3)
_PLAIN = re.compile(r"[A-Za-z]?[a-z]+(?:-[A-Za-z]?[a-z]+)*|[A-Z]+|[-=_+/]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_WORD = re.compile(r"[^\W_]+")
_KINDS_OF = re.compile(r"(?P<u>[A-Z]+)|(?P<l>[a-z]+)|(?P<d>[0-9]+)|(?P<s>[^A-Za-z0-9]+)")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _few(x: float, *limits: float) -> int:
    return sum(x >= limit for limit in limits)


def file_features(text: str, n_tokens: int) -> list[str]:
    n = max(len(text), 1)
    marks = sum(map(text.count, "={};"))
    return [f"file marks {_few(marks / n, 0.001, 0.01, 0.05)}", f"file tokens {_few(n_tokens, 2, 5, 20)}", f"file size {_few(n, 200, 2000, 20000)}"]


def features(text: str, start: int, end: int, of_file: list[str]) -> list[str]:
    t = text[start:end]
    parts = [m.lastgroup for m in _KINDS_OF.finditer(t)]
    counts = Counter(t)
    entropy = -sum(c / len(t) * math.log2(c / len(t)) for c in counts.values())
    classes = "".join(sorted(set(parts)))
    digits = sum(map(t.count, "0123456789")) / len(t)
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    left, right = _WORD.findall(before.lower())[-3:], _WORD.findall(after.lower())[:2]
    gap = before[-4:]
    head = re.match(r"[A-Za-z]*", t)[0]
    out = [
        "bias", f"size {_few(len(t), 12, 16, 20, 32, 40, 64)}", f"classes {classes}", f"digits {_few(digits, 0.1, 0.3, 0.6, 0.99)}", f"turns {_few(len(parts) / len(t), 0.1, 0.25, 0.4, 0.6)}",
        f"entropy {_few(entropy, 2.5, 3, 3.5, 4, 4.5)}", f"hex {bool(HEX.fullmatch(t))}", f"head {head[:6].lower()} {len(head) < len(t) and t[len(head)] in '_-'}", f"assigned {gap.strip(' ')[-1:] in ('=', ':')}",
        f"quoted {gap[-1:] in ('"', "'")}", f"mark before {gap[-1:]}", f"mark after {after[:1]}", f"words in it {sum(p == 'l' for p in parts) > 2 and digits < 0.3}", f"classes {classes} size {_few(len(t), 16, 24, 32)}",
        *of_file,
    ]
    out += [f"left {i} {w}" for i, w in enumerate(reversed(left))] + [f"near {w}" for w in left] + [f"right {w}" for w in right[:1]]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """The tokens that are not outside by constraint."""
    out = []
    for m in _LONG.finditer(text):
        a, b = m.span()
        if not _PLAIN.fullmatch(m[0]) or text[max(a - 2, 0) : a].rstrip(" ")[-1:] in ("=", ":", '"', "'") or CUES.search(text, max(a - 26, 0), a):
            out.append((a, b))
    return out


def chains(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[str]], int | None, int | None]]:
    """Pieces of the text's chain between tokens outside by constraint: tokens, their features, and the
    states before and after (none at the text's ends)."""
    found = candidates(text)
    if not found:
        return
    of_file = file_features(text, len(found))
    at, before = 0, O if _TOKEN.search(text, 0, found[0][0]) else None
    for i in range(1, len(found) + 1):
        cut = _TOKEN.search(text, found[i - 1][1], found[i][0] if i < len(found) else len(text)) is not None
        if i == len(found) or cut:
            spans = found[at:i]
            yield spans, [features(text, *s, of_file) for s in spans], before, O if cut else None
            at, before = i, O


def tags_of(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """State of each token, given the secrets' spans; overlapping spans are one secret."""
    known, out, last = Cover(secrets), [], None
    for a, b in spans:
        hit = known.meets(a, b)
        out.append(O if hit is None else I if hit == last else B)
        last = hit
    return out


def made_up(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of their secrets, drawn with a set seed."""
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    alnum, upper, digit, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789", "0123456789abcdef"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: some("abcdefghilmnoprstu", rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 8)))
    solid = lambda: some(alnum, rng.randint(16, 44)) + rng.choice(digit)
    out = []
    for i in range(n):
        name = rng.choice(["auth", "bearer", "credential", "pwd", "private_key", "client_secret", "access_key", "authorization", "key"])
        good = [
            lambda: name + rng.choice([": ", "=", ' = "', " "]) + "\0" + solid() + "\1",
            lambda: "\0" + rng.choice(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "hf_", "npm_"]) + some(alnum, rng.randint(20, 36)) + "7\1",
            lambda: name + " \0" + ".".join("e" + some(alnum, rng.randint(18, 40)) + "5" for _ in range(3)) + "\1",
            lambda: name + "=\0" + some(alnum + "+/", rng.randint(30, 60)) + "9==\1",
            lambda: "\0AKIA" + some(upper, 15) + "2\1",
            lambda: name + rng.choice([": ", "=", ' = "', " "]) + rng.choice(["", "Bearer ", "bearer "]) + "\0" + some(letters, rng.randint(20, 44)) + "\1",
            lambda: rng.choice(["token = \"", "password=", "secret: "]) + "\0" + some(hexa, rng.choice([18, 32, 40])) + "0\1",
        ]
        bad = [
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}",
            lambda: "-".join([word(), word(), word(), str(rng.randint(1, 2000))]),
            lambda: "_".join([word(), word(), str(rng.randint(1, 99999))]),
            lambda: "/".join(["", word(), word(), str(rng.randint(1, 99999)), word()]),
            lambda: f"978-{rng.randint(0, 9)}-{some(digit, 4)}-{some(digit, 4)}-{rng.randint(0, 9)}",
            lambda: some(digit, rng.randint(10, 15)),
            lambda: f"{some(digit, 3)}-{some(digit, 3)}-{some(digit, 4)}",
            lambda: f"{rng.choice(['INV', 'ORD', 'REF', 'PO'])}-{rng.randint(2000, 2030)}-{some(digit, rng.randint(4, 8))}",
            lambda: f"{rng.choice(['IMG', 'image', 'chapter', 'figure', 'version'])}_{some(digit, rng.randint(3, 8))}_{word()}",
            lambda: word() + word() + word() + rng.choice(digit),
            lambda: " ".join(some("abcdefghilmnoprstu", rng.randint(10, 22)) for _ in range(rng.randint(1, 4))),
            lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))) + rng.choice(["", "Error", "Service"]),
            lambda: rng.choice("-_/").join(word() for _ in range(rng.randint(3, 5))),
            lambda: rng.choice(["=", "-", "_"]) * rng.randint(10, 60),
            lambda: some("ABCDEFGHILMNOPRSTU", rng.randint(10, 16)),
            lambda: name + rng.choice([": ", " ", " is "]) + some("abcdefghilmnoprstu", rng.randint(10, 18)),
            lambda: f"{rng.choice(['x', 'v'])}86-{some(digit, 2)}-{word()}-{word()}",
        ]
        text = prose() + " " + rng.choice(good if i % 2 else bad)() + rng.choice([" ", "\n", '" ', ". "]) + prose()
        a, b = text.find("\0"), text.find("\1")
        out.append((text.replace("\0", "").replace("\1", ""), [(a, b - 1)] if a >= 0 else []))
    return out


def fit(docs: DataFrame, train_chains: int = TRAIN_CHAINS, n_made_up: int = MADE_UP, seed: int = SEED) -> LinearChainCRF:
    """A model from a bounded sample of ``docs`` (doc_id, text) and made-up rows."""

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                known = [(a, b) for _, a, b in base_spans(text)]
                for spans, feats, before, after in chains(text):
                    tags = tags_of(spans, known)
                    for i in range(0, len(spans), TRAIN_TOKENS):
                        ends = before if i == 0 else tags[i - 1], after if i + TRAIN_TOKENS >= len(spans) else tags[i + TRAIN_TOKENS]
                        row = json.dumps([feats[i : i + TRAIN_TOKENS], tags[i : i + TRAIN_TOKENS], *ends])
                        rows.append((int.from_bytes(hashlib.blake2b(row.encode(), digest_size=8).digest(), "big", signed=True), row))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["h", "row"])

    text = F.col("text").cast("string")
    hold = [text.contains(w) for w in (*KEY_WORDS, "AKIA")]
    some = hold[0]
    for x in hold[1:]:
        some = some | x
    sample = docs.filter(some).select(text).mapInArrow(labelled, "h long, row string").orderBy("h", "row").limit(train_chains).collect()
    rows = [json.loads(r.row) for r in sample]
    for body, known in made_up(n_made_up, seed):
        rows += [[feats, tags_of(spans, known), before, after] for spans, feats, before, after in chains(body)]
    data = [([[bucket(f, BUCKETS) for f in one] for one in feats], *rest) for feats, *rest in rows]
    return LinearChainCRF.fit(data, BUCKETS, 3, seed=seed, forbidden=((O, I),), forbidden_first=(I,))


def crf_spans(text: str, model: LinearChainCRF, base: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
    """What the model tags as secrets, but for spans whose every token lies in a base span."""
    out, new = [], []
    known = Cover((a, b) for _, a, b in base)
    for spans, feats, before, after in chains(text):
        path = model.viterbi([model.ids(f) for f in feats], before, after)
        for (a, b), state in zip(spans, path, strict=True):
            own = not known.holds(a, b)
            if state == B:
                out.append(("crf", a, b))
                new.append(own)
            elif state == I:
                out[-1] = ("crf", out[-1][1], b)
                new[-1] |= own
    return [s for s, own in zip(out, new, strict=True) if own]


def all_spans(text: str, model: LinearChainCRF) -> tuple[list, list]:
    """The base spans, and these with what the model adds outside them."""
    base = base_spans(text)
    return base, sorted(base + crf_spans(text, model, base), key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: LinearChainCRF) -> DataFrame:
    """doc_id, counts of each kind, digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = [all_spans(t or "", shared.value) for t in texts]
            counts = [Counter(k for k, _, _ in spans) for _, spans in found]
            columns = [batch.column(0)] + [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
