"""Repeated strings of ``LENGTH`` bytes or more, and repeated passages, by prefix-free parsing.

Parse. A rolling hash runs over every gram of ``GRAM`` bytes. The trigger of a place is the gram of
smallest hash among the ``WINDOW`` bytes from there on (the last one, in a tie), so that equal
strings of ``WINDOW`` bytes or more have equal triggers wherever they stand. Consecutive places
with one trigger form a phrase: the bytes from the first place to ``LENGTH`` bytes after the last
one, or to the document's end. A document is parsed into its phrases; the dictionary holds each
distinct phrase once.

Corpus order. Two strings are equal only if they have one trigger and agree left and right of it.
So the order is built for the suffixes that start at a trigger, and splits into ranges by trigger:

* the parse's suffix array: a distributed sort of the phrases by trigger and by the bytes from the
  trigger on. ``LENGTH`` bytes of each suffix are enough, and no phrase has more;
* the dictionary's suffix array of what leads up to the trigger: the same rows by their left part,
  read from the trigger backwards;
* both with the common prefixes of neighbours. Strings that reach *d* bytes left and *r* bytes right
  of a trigger are equal if no neighbour between them shares fewer than *d* bytes in the second
  array or *r* in the first. This is decided on the bytes.

A suffix array of every position would need a row a byte of the corpus. What is left out cannot
matter: a phrase whose trigger occurs once has no repeated string, and one that occurs again as it
stands (equal trigger and equal name, 64 bits each) is repeated as a whole.

Passages. Besides the strings of ``LENGTH`` bytes, those of ``WORDS`` words are looked up in the same
order, with at least ``WINDOW`` and at most ``LENGTH`` bytes; they are reported, not removed.

Groups. Occurrences are counted with partial sums before any shuffle, so copies cost one row for
each task. Triggers with more than ``CROWD`` distinct phrases (a licence line in a third of all
documents, say) are not brought together: their strings' names (64 bits, beside the trigger's 64)
become rows, counted with partial sums.

The texts are shuffled once: fetching phrases and cutting texts are one plan, in which Spark reads
the same exchange twice.

Edge cases: a null text counts as empty; matches never cross documents; overlapping occurrences
in one document count; rows that are equal in all columns are occurrences of each other; a
document of fewer than ``LENGTH`` bytes keeps all bytes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

LENGTH, WINDOW, GRAM, WORDS, CROWD = 400, 256, 56, 50, 20_000
#: What a run of places says: all strings there are repeated, those of LENGTH bytes are, those of WORDS words are.
WHOLE, LONG, PASSAGE = range(3)
_NO_ID = -(1 << 63)
_CHUNK = 1 << 23
_LOW = np.uint64(0xFFFFFF)
_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(400)).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class _Powers:
    """Powers of the odd base and of its inverse, modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_STEP, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_STEP, -k, 1 << 64))))
        return self.up, self.down


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class _Hashes:
    """Hashes of any substring of some bytes, from prefix sums."""

    def __init__(self, data: bytes) -> None:
        n = len(data)
        up, self.down = _POWERS.of(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def parse(data: bytes, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The phrases of some bytes: start, number of places, offset of the trigger, trigger, name."""
    places = max(len(data) - window + 1, 0)
    parts = [_parsed(data[c : c + _CHUNK + length - 1], c, min(_CHUNK, places - c), length, window, gram) for c in range(0, places, _CHUNK)]
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _parsed(data: bytes, shift: int, places: int, length: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    hashes = _Hashes(data)
    grams = hashes.all_of(gram)
    # the low bits prefer the last of equal hashes
    least = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
    span, k = window - gram + 1, 1
    while 2 * k <= span:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    if rest := span - k:
        least = np.minimum(least[:-rest], least[rest:])
    trigger = (_LOW - (least[:places] & _LOW)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(trigger))
    first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(trigger) - 1]))
    at, n = trigger[first], last - first + 1
    name = _mixed(hashes.of(first, np.minimum(last + length, len(data))) + n.astype(np.uint64))
    return first + shift, n, at - first, grams[at], name


def passage_sizes(data: np.ndarray, ends_here: bool, words: int = WORDS, window: int = WINDOW, length: int = LENGTH) -> np.ndarray:
    """Bytes of the passage that starts at each place: ``words`` words, but within [window, length].

    It depends on the bytes that follow only. ``ends_here``: a last word is whole.
    """
    n = len(data)
    space = _SPACE[data]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if ends_here and n and not space[-1]:
        ends = np.append(ends, n)
    place = np.arange(n)
    nth = np.searchsorted(ends, place, "right") + words - 1
    far = n + length
    return np.clip(np.append(ends, far)[np.minimum(nth, len(ends))] - place, window, length)


def string_names(phrase: bytes, trigger: int, sizes: np.ndarray) -> np.ndarray:
    """Names of the strings of ``sizes`` bytes at a phrase's first places; equal strings of one
    trigger have equal names, and hardly others."""
    place = np.arange(len(sizes))
    h = _Hashes(phrase).of(place, place + sizes)
    return _mixed(h ^ ((trigger - place).astype(np.uint64) * np.uint64(_STEP)) ^ sizes.astype(np.uint64))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, same, data; the first two are equal for rows of equal id and text only. The lowest bit of
    ``same`` says that there is no id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    none = F.col("doc_id").isNull().cast("long")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), none.alias("none"), text.alias("data"))
    return own.select("doc", F.shiftleft(F.xxhash64("data", F.lit(7)), 1).bitwiseOR(F.col("none")).alias("same"), "data")


def occurrences(keyed: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per phrase of each document: trigger, name, doc, same, start, places, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [parse(x, length, window, gram) for x in part.column(2).to_pylist()]
                counts = [len(f[0]) for f in found]
                start, places, at, trigger, name = (np.concatenate(x) for x in zip(*found, strict=True))
                docs, same = (np.repeat(part.column(c).to_numpy(), counts) for c in (0, 1))
                columns = [trigger.view(np.int64), name.view(np.int64), docs, same, start, places.astype(np.int32), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trigger", "name", "doc", "same", "start", "places", "at"])

    return keyed.select("doc", "same", "data").mapInArrow(run, "trigger long, name long, doc long, same long, start long, places int, at int")


_PHRASE = "trigger long, n long, doc long, same long, start long, places int, left binary, right binary"


def _phrases_with_bytes(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (trigger, n, doc, same, start, places, at) with what leads up to the trigger, read
    backwards, and what follows from there on."""
    of_doc = wanted.groupBy("doc", "same").agg(F.collect_list(F.struct("trigger", "n", "start", "places", "at")).alias("w"))
    once = keyed.join(of_doc, ["doc", "same"]).select("doc", "same", "data", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                rows = []
                for doc, same, data, w in zip(*(batch.column(c).slice(i, 200).to_pylist() for c in range(4)), strict=True):
                    for x in w:
                        s, t = x["start"], x["start"] + x["at"]
                        rows.append((x["trigger"], x["n"], doc, same, s, x["places"], data[s:t][::-1], data[t : s + x["places"] - 1 + length]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], [x.split()[0] for x in _PHRASE.split(", ")])

    return once.mapInArrow(cut, _PHRASE)


def _matrix(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as rows of one matrix, filled up with zeros, and their sizes."""
    sizes = np.array([len(p) for p in parts])
    wide = max(int(sizes.max()), 1)
    return np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), np.uint8).reshape(-1, wide), sizes


def _classes(parts: list[bytes], group: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each prefix size up to ``most`` and each part, the number of its class: parts of one group
    with equal prefixes of that size. ``order`` sorts the parts within their groups."""
    rows, sizes = _matrix(parts)
    rows, sizes, group = rows[order], sizes[order], group[order]
    differ = np.concatenate((rows[1:] != rows[:-1], np.ones((len(rows) - 1, 1), bool)), axis=1)
    common = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    common = np.where(group[1:] == group[:-1], common, -1)
    out = np.zeros((most + 1, len(parts)), np.int32)
    out[:, order[1:]] = (common[None, :] < np.arange(most + 1)[:, None]).cumsum(axis=1, dtype=np.int32)
    return out


def _sizes_of(row: tuple, length: int, window: int, words: int) -> np.ndarray:
    """For each place of a phrase the size of its passage."""
    _, _, _, _, _, places, left, right = row
    phrase = left[::-1] + right
    return passage_sizes(np.frombuffer(phrase, np.uint8), len(phrase) < places - 1 + length, words, window, length)[:places]


def compared(rows: list[tuple], length: int = LENGTH, window: int = WINDOW, words: int = WORDS) -> list[tuple]:
    """rows of whole triggers, sorted by trigger and right part, distinct within a trigger. Returns
    (doc, same, kind, first, last): runs of places whose strings another phrase has, too."""
    group = np.cumsum([0, *(a[0] != b[0] for a, b in zip(rows, rows[1:], strict=False))])
    left, right = [r[6] for r in rows], [r[7] for r in rows]
    back = np.array(sorted(range(len(rows)), key=lambda j: (group[j], left[j])))
    to_left, to_right = _classes(left, group, back, max(map(len, left))), _classes(right, group, np.arange(len(rows)), length)
    places = np.array([r[5] for r in rows])
    row = np.repeat(np.arange(len(rows)), places)
    place = np.arange(len(row)) - np.repeat(np.cumsum(places) - places, places)
    d = np.array([len(x) for x in left])[row] - place
    whole = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)])[row]
    out = []
    for kind, sizes in ((LONG, np.full(len(row), length)), (PASSAGE, np.concatenate([_sizes_of(r, length, window, words) for r in rows]))):
        fits = place + sizes <= whole
        r = np.where(fits, sizes - d, 0)
        key = ((d * (len(rows) + 1) + to_left[d, row]) * (length + 1) + r) * (len(rows) + 1) + to_right[r, row]
        key = np.where(fits, key, -1 - np.arange(len(row)))
        _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice, at = counts[where] > 1, 0
        for (_, n, doc, same, start, size, _, _) in rows:
            if n == 1:
                out += [(doc, same, kind, start + a, start + b) for a, b in runs(twice[at : at + size])]
            at += size
    return out


def spans(keyed: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """(doc, same, kind, first, last): runs of places whose strings occur anywhere else."""
    occ = stored(occurrences(keyed, length, window, gram), "repeats-parse")
    one = [F.first(c).alias(c) for c in ("doc", "same", "start", "places", "at")]
    dictionary = stored(occ.groupBy("trigger", "name").agg(F.count("*").alias("n"), *one), "repeats-dictionary")
    again = dictionary.filter("n > 1").select("trigger", "name")
    lits = lambda kind, *cols: (F.lit(kind).alias("kind"), *cols)
    whole = occ.join(again, ["trigger", "name"]).select("doc", "same", *lits(WHOLE, F.col("start").alias("first"), (F.col("start") + F.col("places") - 1).alias("last")))
    shared = dictionary.groupBy("trigger").agg(F.count("*").alias("k")).filter("k > 1")
    wanted = stored(dictionary.drop("name").join(shared, "trigger"), "repeats-shared")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows):
            found = compared(rows, length, window, words)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["doc", "same", "kind", "first", "last"])

        held: list[tuple] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                held += zip(*(c.to_pylist() for c in batch.slice(i, 4096).columns), strict=True)
                cut = len(held)
                while cut and held[cut - 1][0] == held[-1][0]:  # a group may go on in the next batch
                    cut -= 1
                if cut >= 2048:
                    yield give(held[:cut])
                    held = held[cut:]
        if held:
            yield give(held)

    schema = "doc long, same long, kind int, first long, last long"
    few = _phrases_with_bytes(keyed, wanted.filter(F.col("k") <= crowd), length)
    found = whole.union(few.repartition("trigger").sortWithinPartitions("trigger", "right").mapInArrow(resolve, schema))
    crowded = wanted.filter(F.col("k") > crowd)
    return found if crowded.isEmpty() else found.union(_of_crowds(keyed, crowded, length, window, words))


def _of_crowds(keyed: DataFrame, crowded: DataFrame, length: int, window: int, words: int) -> DataFrame:
    """The same for triggers of many phrases: names of strings are counted, no trigger's rows meet."""

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trigger, n, doc, same, start, places, left, right = row
                phrase = left[::-1] + right
                for kind, sizes in ((LONG, np.full(places, length)), (PASSAGE, _sizes_of(row, length, window, words))):
                    m = int((np.arange(places) + sizes <= len(phrase)).sum())  # the places that fit come first
                    names = string_names(phrase, len(left), sizes[:m]).view(np.int64)
                    columns = [np.full(m, trigger), names, np.full(m, n), np.full(m, doc), np.full(m, same), np.full(m, kind, np.int32), np.arange(start, start + m)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trigger", "string", "n", "doc", "same", "kind", "start"])

    strings = stored(_phrases_with_bytes(keyed, crowded, length).mapInArrow(unrolled, "trigger long, string long, n long, doc long, same long, kind int, start long"), "repeats-strings")
    twice = strings.groupBy("trigger", "kind", "string").agg(F.count("*").alias("c")).filter("c > 1").select("trigger", "kind", "string")
    return strings.filter("n = 1").join(twice, ["trigger", "kind", "string"]).select("doc", "same", "kind", F.col("start").alias("first"), F.col("start").alias("last"))


def covered(n: int, starts: list[tuple[int, int]], sizes: np.ndarray | int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) covered by the strings of ``sizes`` bytes at the runs of places that
    fit into ``n`` bytes."""
    out: list[list[int]] = []
    if not isinstance(sizes, int):
        steps = np.zeros(n + 1, np.int64)
        for a, b in starts:
            place = np.arange(a, b + 1)
            place = place[place + sizes[place] <= n]
            np.add.at(steps, place, 1)
            np.add.at(steps, place + sizes[place], -1)
        return [(a, b + 1) for a, b in runs(np.cumsum(steps)[:n] > 0)]
    for a, b in sorted(starts):
        b = min(b, n - sizes)
        if b < a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + sizes)
        else:
            out.append([a, b + sizes])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """For each row doc_id, n_bytes, kept (binary), spans (start and end of what is removed) and
    passages (start and end of what repeated passages cover)."""
    keyed = _keyed(docs)
    found = spans(keyed, length, window, gram, words, crowd).groupBy("doc", "same").agg(F.collect_set(F.struct("kind", "first", "last")).alias("found"))
    joined = keyed.join(found, ["doc", "same"], "left").select("doc", "same", "data", "found")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for doc, same, data, here in zip(*(batch.column(c).slice(i, 500).to_pylist() for c in range(4)), strict=True):
                    of = lambda kind: [(x["first"], x["last"]) for x in here or [] if x["kind"] in (WHOLE, kind)]  # noqa: E731, B023
                    cut, parts, at = covered(len(data), of(LONG), length), [], 0
                    for a, b in cut:
                        parts.append(data[at:a])
                        at = b
                    told = covered(len(data), of(PASSAGE), passage_sizes(np.frombuffer(data, np.uint8), True, words, window, length)) if here else []
                    as_rows = lambda x: [{"start": a, "end": b} for a, b in x]
                    rows.append((None if same & 1 and doc == _NO_ID else doc, len(data), b"".join([*parts, data[at:]]), as_rows(cut), as_rows(told)))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary(), span, span))], ["doc_id", "n_bytes", "kept", "spans", "passages"])

    kind = "array<struct<start:long,end:long>>"
    return joined.mapInArrow(run, f"doc_id long, n_bytes long, kept binary, spans {kind}, passages {kind}")


def op5_remove_repeats(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed: Column = F.col("n_bytes") - F.octet_length("kept")
    told = F.aggregate("passages", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.size("passages").cast("long").alias("n_passages"), told.alias("n_passage_bytes"))
