"""Evaluation texts leaking into training text: prefix-filtered join of item windows."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.runtime import bounded, cut, split_join

_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|["\\/bfnrt])')
_CONTROL = {"b": " ", "f": " ", "n": "\n", "r": "\n", "t": "\t"}
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)\b[^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]*\)")
_INVISIBLE = regex.compile(r"[\p{M}\p{Cf}]+")
_OTHER = re.compile(r"[\W_]+")
#: Elements that stand within a word; any other ends it.
_INLINE = {"a", "b", "i", "u", "s", "em", "strong", "span", "mark", "small", "sub", "sup", "wbr", "font", "code", "del", "ins"}
#: Letters that are written with two where accents are not at hand.
_LIGATURES = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d"})

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _unescape(m: re.Match) -> str:
    c = m[1]
    return chr(int(c[1:], 16)) if len(c) == 5 else _CONTROL.get(c, c)


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, accents, markup and invisible characters."""
    if not text:
        return []
    for _ in range(2):  # texts are at times escaped twice
        if "\\" in text:
            text = _ESCAPE.sub(_unescape, text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[2] and m[2].lower() in _INLINE else " ", text)
    if "](" in text:
        text = _LINK.sub("]", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        text = _INVISIBLE.sub("", text).translate(_LIGATURES)
    return _OTHER.sub(" ", text.lower()).split()


def shingle_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all runs of q numbers, from prefix sums of c_j * B^j modulo 2^64."""
    n = len(codes)
    if n < q:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up = np.ones(n, np.uint64)
        up[1:] = _BASE
        np.multiply.accumulate(up, out=up)
        down = np.ones(n - q + 1, np.uint64)
        down[1:] = _INVERSE
        np.multiply.accumulate(down, out=down)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _BASE * up, out=sums[1:])
        h = (sums[q:] - sums[:-q]) * down
        return h ^ (h >> np.uint64(31))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)


BITS = 26  # of the largest bit table, 8 MB; with more shingles it lets more through and stays right


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bit table."""
    h = hashes.astype(np.uint64)
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h * _BASE) >> np.uint64(64 - bits)).astype(np.int64)


def _bit_words(bits: int):
    """Shingles to the words of the bit table they set, combined per task."""

    def run(batches):
        table = np.zeros(1 << (bits - 6), np.uint64)
        for batch in batches:
            for at in _slots(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        k = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(table[k].view(np.int64))], names=["word", "bits"])

    return run


def _chunks(texts: list[str], most: int = 2_000_000):
    """Neighbouring texts of at most that many characters together (a longer one by itself)."""
    s = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield s, k
            s, size = k, 0
        size += len(t)
    if s < len(texts):
        yield s, len(texts)


def _texts(n_words: int):
    """(item, text) to (item, words): normalised, those of at least n_words."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            rows = [k for k, w in enumerate(words) if len(w) >= n_words]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([" ".join(words[k]) for k in rows], pa.string())], names=["item", "words"])

    return run


def _shortest(n_words: int):
    """Least length of a window, and the characters, of the texts of a task."""

    def run(batches):
        least, chars = None, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ends = np.cumsum([0, *map(len, t.split(" "))])
                short = int((ends[n_words:] - ends[:-n_words]).min())
                least = short if least is None else min(least, short)
                chars += int(ends[-1])
        yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([chars], pa.int64())], names=["least", "chars"])

    return run


def _shingles(q: int):
    """(id, words) to (id, pos, shingle): all runs of q characters."""

    def run(batches):
        for batch in batches:
            texts = [w.replace(" ", "") for w in batch.column(1).to_pylist()]
            for s, e in _chunks(texts):
                found = [shingle_hashes(_codes([t]), q) for t in texts[s:e]]
                n = [len(h) for h in found]
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(s, e), n)))
                pos = np.concatenate([np.arange(k, dtype=np.int32) for k in n])
                yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(np.concatenate(found).view(np.int64))], names=["id", "pos", "shingle"])

    return run


def _scan(table: np.ndarray, bits: int, q: int, need: int):
    """(doc, text) to (doc, words): the stretches of a document whose next `need` shingles may all be known."""

    def scan(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            texts = ["".join(w) for w in words]
            docs, parts = [], []
            for s, e in _chunks(texts):
                h = shingle_hashes(_codes(texts[s:e]), q)
                ends = np.cumsum([len(t) for t in texts[s:e]])
                hit = np.zeros(len(h) + 1, np.int8)
                first, second = _slots(h, bits)
                hit[:-1] = table[first >> 6] >> (first & 63).astype(np.uint64) & table[second >> 6] >> (second & 63).astype(np.uint64) & np.uint64(1)
                for k in range(1, q):  # runs across the end of a text do not count
                    at = ends - k
                    hit[at[(at >= 0) & (at < len(h))]] = 0
                edge = np.diff(np.r_[np.int8(0), hit])
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                long = stops - starts >= need
                starts, stops = starts[long], stops[long] + q - 1
                of = np.searchsorted(ends, starts, side="right")
                for d in np.unique(of).tolist():
                    begin = ends[d] - len(texts[s + d])
                    borders = np.cumsum([0, *map(len, words[s + d])])
                    for a, b in zip(starts[of == d] - begin, stops[of == d] - begin):
                        i, j = int(np.searchsorted(borders, a)), int(np.searchsorted(borders, b, side="right")) - 1
                        if i < j:
                            docs.append(s + d)
                            parts.append(" ".join(words[s + d][i:j]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(parts, pa.string())], names=["doc", "words"])

    return scan


def _prefixes(n_words: int, q: int):
    """(words, ranks: list of (pos, n, shingle)) to (window, shingle, offset) of windows all of whose shingles occur.

    The shingle is the rarest of the window, the first of equals.
    """

    def run(batches):
        for batch in batches:
            windows, shingles, offsets = [], [], []
            for text, ranks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split(" ")
                ends = np.cumsum([0, *map(len, words)])
                count, name = np.zeros(max(0, int(ends[-1]) - q + 1), np.int64), np.zeros(max(0, int(ends[-1]) - q + 1), np.int64)
                for r in ranks:
                    count[r["pos"]], name[r["pos"]] = r["n"], r["shingle"]
                for k in range(len(words) - n_words + 1):
                    a, b = int(ends[k]), int(ends[k + n_words]) - q + 1
                    if count[a:b].all():
                        at = a + int(np.argmin(count[a:b]))
                        windows.append("".join(words[k : k + n_words]))
                        shingles.append(int(name[at]))
                        offsets.append(at - a)
            yield pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(shingles, pa.int64()), pa.array(offsets, pa.int32())], names=["window", "shingle", "offset"])

    return run


def _verify(batches):
    """(doc, words, start, window) to (doc, window) where the window stands there, between borders of words."""
    for batch in batches:
        rows = []
        held, borders, squashed = None, set(), ""
        for k, (words, start, window) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
            if words != held:
                held, squashed = words, words.replace(" ", "")
                borders = {0, *np.cumsum([len(w) for w in words.split(" ")]).tolist()}
            if start in borders and start + len(window) in borders and squashed.startswith(window, start):
                rows.append(k)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at)], names=["doc", "window"])


def leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    fields: tuple[str, ...] = ("question", "context"),
    n_words: int = 12,
    q: int = 24,
) -> DataFrame:
    """doc_id, item_id, n_windows: documents that hold n_words consecutive words of a field of an item.

    Words are compared as their run of letters without anything between, so line breaks inside words do
    not matter; a match begins and ends where words of the document do.  n_windows counts the item's
    different windows found.  One row per id and item (ids that repeat are one document); null and empty
    texts and fields, items of fewer words, null ids and empty tables give no rows.  Further columns are
    not read; the result's columns always have the two id columns' names.

    Method: every window of an item must be in the document as a whole, so all its shingles (q characters)
    are, one after the other.  A bit table of the shingles of all items, of at most 2^BITS bits whatever their
    number, goes over the documents in their only pass: only stretches with as many consecutive hits as the
    shortest window has shingles are kept.  Shingles are then counted in these; each window's rarest
    becomes its prefix token, which is joined with the stretches' shingles, bounds the position and the
    length, and the whole window is verified there.
    """
    spark = documents.sparkSession
    docs = documents.filter(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("doc"), F.col(text).alias("text"))
    kind, item_kind = dict(docs.dtypes)["doc"], dict(items.dtypes)[item]
    flat = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), F.explode(F.array(*[F.col(f) for f in fields])).alias("text"))
    none = spark.createDataFrame([], f"{id} {kind}, {item} {item_kind}, n_windows long")
    owners = cut(flat.filter("text is not null").mapInArrow(_texts(n_words), f"item {item_kind}, words string").distinct())
    texts = cut(owners.select("words").distinct()).withColumn("id", F.monotonically_increasing_id())
    size = texts.select("words").mapInArrow(_shortest(n_words), "least long, chars long").agg(F.min("least").alias("least"), F.sum("chars").alias("chars")).first()
    if size["least"] is None:
        return none
    width = min(q, size["least"])
    bits = min(BITS, max(12, int(size["chars"] * 16).bit_length()))
    known = cut(texts.select("id", "words").mapInArrow(_shingles(width), "id long, pos int, shingle long"))
    # at most 2^BITS / 64 numbers, whatever the items
    words = known.select("shingle").mapInArrow(_bit_words(bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    parts = cut(docs.mapInArrow(_scan(table, bits, width, size["least"] - width + 1), f"doc {kind}, words string")).withColumn("id", F.monotonically_increasing_id())
    hits = cut(parts.select("id", "words").mapInArrow(_shingles(width), "id long, pos int, shingle long"))
    counts = hits.groupBy("shingle").agg(F.count("*").alias("n"))
    ranks = known.join(counts, "shingle").groupBy("id").agg(F.collect_list(F.struct("pos", "n", "shingle")).alias("ranks"))
    windows = texts.join(ranks, "id").select("words", "ranks").mapInArrow(_prefixes(n_words, width), "window string, shingle long, offset int").distinct()
    tokens = windows.groupBy("shingle").agg(F.collect_list(F.struct("window", "offset")).alias("w"))
    tokens = cut(tokens.join(counts, "shingle"))
    total = tokens.agg(F.sum("n")).first()[0]
    if not total:
        return none
    met = split_join(hits, tokens, "shingle", "n", total).select("id", "pos", F.explode("w").alias("w"))
    places = met.select("id", (F.col("pos") - F.col("w.offset")).alias("start"), "w.window").filter("start >= 0")
    asked = places.join(parts, "id").filter(F.length(F.replace("words", F.lit(" "))) >= F.col("start") + F.length("window"))
    found = asked.select("doc", "words", "start", "window").mapInArrow(_verify, f"doc {kind}, window string").distinct()
    of = owners.select("item", "words").mapInArrow(_owned(n_words), f"item {item_kind}, window string").distinct()
    wanted = tokens.select(F.explode("w.window").alias("window")).distinct()
    named = found.join(bounded(cut(of.join(wanted, "window", "left_semi")), 200_000), "window")
    return named.groupBy("doc", "item").agg(F.count("*").alias("n_windows")).select(F.col("doc").alias(id), F.col("item").alias(item), "n_windows")


def _owned(n_words: int):
    """(item, words) to (item, window)."""

    def run(batches):
        for batch in batches:
            rows, windows = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                words = t.split(" ")
                for s in range(len(words) - n_words + 1):
                    rows.append(k)
                    windows.append("".join(words[s : s + n_words]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(windows, pa.string())], names=["item", "window"])

    return run
