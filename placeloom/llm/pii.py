"""Personal data: four exact patterns, and spans from aggregated weak labels.

Base spans are the leftmost non-overlapping matches of the fixed patterns ``email``, ``ip``,
``card`` and ``phone``; a match that fails its condition is dropped and not tried again.

The method looks at further candidates (national phone numbers, social-security numbers,
account numbers, names after a title, spelt-out addresses) next to the base spans. Labelers vote
on each candidate: a strict pattern, gazetteers, cue words around it for and against, and its
shape. How often each combination of votes occurs is counted over all documents;
expectation-maximisation on these counts estimates what each labeler's vote is worth, and gives
every combination a probability of being personal data. A logistic span classifier is trained on
the candidates' own features against these probabilities, from at most ``TRAIN_SPANS``
candidates, those of smallest hash. Further candidates that it gives at least ``THRESHOLD`` are
returned besides the base spans.

Offsets count code points, ends are exclusive. Edge cases: a null text counts as empty and has no
spans; repeated rows get equal rows; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover, map_batches, pieces, stored, table
from .crf import bucket

BASE = ("email", "ip", "card", "phone")
FURTHER = ("local_phone", "ssn", "iban", "name", "spelt_email")
KINDS = BASE + FURTHER
TRAIN_SPANS, BUCKETS, THRESHOLD, SEED = 20000, 1 << 12, 0.6, 5

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a digit run that failed from its first digit fails from the others too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.?\x20[A-ZÀ-Ý][a-zà-ÿ]{2,}(?:\x20[A-ZÀ-Ý][a-zà-ÿ]{2,})?")
_SPELT = re.compile(r"(?<![\w.])[A-Za-z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{2,24})+")
_WORD = re.compile(r"[^\W\d_]+")
_FOR = frozenset("phone tel telephone call mobile fax contact email mail address ssn social security card iban account bank born name telefon anruf konto nombre correo cuenta teléfono nom courriel compte téléphone".split())
_AGAINST = frozenset("version isbn order invoice page figure table chapter section release build model part item sku serial rfc port example edition".split())
_GIVEN = frozenset("james john robert michael william david richard joseph thomas mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria laura peter paul hans karl klaus jean pierre marie claire luis carlos jose juan carmen lucia sofia martin simon".split())
_COUNTRIES = frozenset("AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, in linear time: only an @ can anchor one."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


_SOME_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if _SOME_DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def further_candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the other kinds that no base span overlaps; the first kind wins."""
    found = []
    patterns = [("name", _NAME)]
    if _SOME_DIGIT.search(text):
        patterns = [("local_phone", _LOCAL_PHONE), ("ssn", _SSN), ("iban", _IBAN), *patterns]
    if "at]" in text or "at)" in text:
        patterns.append(("spelt_email", _SPELT))
    for kind, pattern in patterns:
        taken = Cover((a, b) for _, a, b in base + found)
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if taken.meets(m.start(), m.end()) is None]
    return found


def _iban_ok(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """-1, 0 or 1 of each labeler: strict pattern, gazetteer, cues for, cues against, shape, surroundings."""
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    words = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start]) + _WORD.findall(text[end : end + 24])}
    strict = 0
    if kind == "iban":
        strict = 1 if _iban_ok(s) else -1
    elif kind == "ssn":
        strict = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    elif kind in ("local_phone", "phone"):
        strict = -1 if digits[-10:][:1] in "01" else 1
    elif kind in ("email", "spelt_email", "card"):
        strict = 1
    elif kind == "ip":
        strict = -1 if s.startswith(("0.", "127.", "255.")) else 1
    gazetteer = 0
    if kind == "name":
        gazetteer = 1 if any(w.lower() in _GIVEN for w in s.split()[1:]) else 0
    elif kind == "iban":
        gazetteer = 1 if s[:2] in _COUNTRIES else -1
    shape = -1 if digits and (len(set(digits)) <= 2 or digits in "01234567890123456789") else 1 if len(set(digits)) >= 6 else 0
    around = -1 if text[start - 1 : start].isalnum() and start or text[end : end + 1].isalnum() else 0
    return strict, gazetteer, int(bool(words & _FOR)), -int(bool(words & _AGAINST)), shape, around


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    s = text[start:end]
    shape = re.sub("[0-9]+", "9", re.sub("[^\\W\\d_]+", "a", s))[:24]
    left = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-3:]
    right = [w.lower() for w in _WORD.findall(text[end : end + 24])][:1]
    digits = "".join(c for c in s if "0" <= c <= "9")
    out = [f"kind {kind}", f"kind {kind} shape {shape}", f"size {min(len(s) // 4, 10)}", f"kinds of digits {kind} {min(len(set(digits)), 7)}", f"head {kind} {s[:2]}", f"marks {text[start - 1 : start] if start else ''} {text[end : end + 1]}"]
    out += [f"left {w}" for w in left] + [f"right {w}" for w in right]
    out += [f"cue for {kind}"] * bool(_FOR & {*left, *right}) + [f"cue against {kind}"] * bool(_AGAINST & {*left, *right})
    if kind == "name":
        out += [f"given {any(w.lower() in _GIVEN for w in s.split()[1:])}"]
    if kind == "iban":
        out += [f"check {_iban_ok(s)}"]
    return sorted({bucket(f, BUCKETS) for f in out})


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 30) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of personal data for each (kind, votes), from counts, by expectation-maximisation.

    A labeler that does not abstain votes with a probability that depends on the truth; given the
    truth, labelers vote independently. Each kind has its own share of true candidates.
    """
    if not patterns:
        return {}
    v = np.array([p[1] for p in patterns])
    n = np.array([float(p[2]) for p in patterns])
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    post = 1 / (1 + np.exp(-v.sum(axis=1) - 0.5))
    for _ in range(rounds):
        logit = np.zeros(len(n))
        for k in np.unique(kinds):
            own = kinds == k
            share = ((post * n)[own].sum() + 2) / (n[own].sum() + 3)
            logit[own] += math.log(share / (1 - share))
        for j in range(v.shape[1]):
            for vote in (-1, 1):
                said = v[:, j] == vote
                spoke = v[:, j] != 0
                if said.any():
                    # a prior of four votes that a labeler is right more often than not
                    true = ((post * n)[said].sum() + (3 if vote == 1 else 1)) / ((post * n)[spoke].sum() + 4)
                    false = (((1 - post) * n)[said].sum() + (1 if vote == 1 else 3)) / (((1 - post) * n)[spoke].sum() + 4)
                    logit[said] += math.log(true / false)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return {(k, p): float(x) for (k, p, _), x in zip(patterns, post, strict=True)}


def train(rows: list[tuple[list[int], float]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-5, seed: int = SEED) -> np.ndarray:
    """Logistic weights over hashed features, against soft labels."""
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            ids, y = rows[i]
            d = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[ids].sum()))))) - y
            d = d + l2 * w[ids]
            g[ids] += d * d
            w[ids] -= rate * d / np.sqrt(g[ids])
    return w


def candidates(docs: DataFrame) -> DataFrame:
    """kind, votes, ids (features) and h (a hash) of every candidate, base spans included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            rows = []
            for text in texts:
                base = base_spans(text)
                for span in base + further_candidates(text, base):
                    around = text[max(0, span[1] - 40) : span[2] + 24]
                    h = int.from_bytes(hashlib.blake2b(f"{span[0]}\0{around}".encode(errors="replace"), digest_size=8).digest(), "big", signed=True)
                    rows.append((span[0], list(votes(text, *span)), features(text, *span), h))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()))], ["kind", "votes", "ids", "h"])

    text = F.col("text").cast("string")
    return map_batches(docs.select(text.alias("text")).filter("text is not null"), run, "kind string, votes array<int>, ids array<int>, h long")


def fit(docs: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray:
    found = stored(candidates(docs), "pii-candidates")
    counts = found.groupBy("kind", "votes").count().collect()  # at most kinds x 3^labelers rows
    worth = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counts))
    sample = found.orderBy("h", "kind", "ids").limit(train_spans).collect()
    return train([(r.ids, worth[r.kind, tuple(r.votes)]) for r in sample])


def all_spans(text: str, weights: np.ndarray, threshold: float = THRESHOLD) -> tuple[list, list]:
    """The base spans, and these with what the classifier accepts besides them."""
    base = base_spans(text)
    more = [s for s in further_candidates(text, base) if 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[features(text, *s)].sum()))))) >= threshold]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, counts of each base kind, digest of the base spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            found = [all_spans(t or "", shared.value) for t in texts]
            counts = [Counter(k for k, _, _ in base) for base, _ in found]
            columns = [batch.column(0)] + [pa.array([c[k] for c in counts], pa.int64()) for k in BASE]
            columns += [pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op8_pii_spans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the text is replaced; n_chars counts the new text. A null text stays null."""
    shared = spark.sparkContext.broadcast(fit(docs))

    own = docs.withColumn("text", F.col("text").cast("string"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches, "text"):
            new = [None if t is None else redacted(t, all_spans(t, shared.value)[1]) for t in texts]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    out = map_batches(own, clean, own.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
