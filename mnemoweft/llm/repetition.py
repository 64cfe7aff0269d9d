"""Repetition inside a single document, and how well public vocabularies fit it."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoweft.functions.tokens import load_encoding, pieces
from mnemoweft.runtime import cut

#: A word: a run of letters or digits.
WORD = regex.compile(r"[\p{L}\p{N}]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def repeated_words(text: str | None, stretch: int) -> tuple[int, int]:
    """Words of a text, and those in a stretch that already began earlier in it.

    Words become numbers in the order of first use and a stretch of n of them one pair of 64-bit
    hashes, so two different stretches of a text are confused with a chance below 2^-90 or so.
    """
    words = WORD.findall(text.lower()) if text else []
    return len(words), _repeats(words, stretch)


def _repeats(words: list[str], stretch: int) -> int:
    n = len(words)
    if n <= stretch:
        return 0
    seen: dict[str, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.uint64, n)
    m = n - stretch + 1
    keys = np.zeros((2, m), np.uint64)
    with np.errstate(over="ignore"):
        for h in (0, 1):
            for k in range(stretch):
                keys[h] = (keys[h] ^ codes[k : k + m]) * _MIX[h]
                keys[h] ^= keys[h] >> np.uint64(29 + 3 * h)
    order = np.lexsort((np.arange(m), keys[1], keys[0]))
    a, b = keys[0][order], keys[1][order]
    again = np.zeros(m, bool)
    again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + stretch, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repetition(documents: DataFrame, id: str = "doc_id", text: str = "text", stretch: int = 5) -> DataFrame:
    """id, n_words, n_repeated, repeated_share of every document, over whole texts.

    A word is a run of letters or digits, lower-cased; it is repeated if it lies in a stretch of
    `stretch` words that already began earlier in the document.  Null, empty and wordless texts have
    no words and a share of 0.  Each row is measured by itself: repeated ids give repeated rows,
    an empty table none, a null id stays.  Further columns are not read.  No shuffle.
    """
    schema = documents.select(F.col(id)).schema.add("n_words", "long").add("n_repeated", "long")

    def measure(batches):
        for batch in batches:
            found = [repeated_words(t, stretch) for t in batch.column(1).to_pylist()]
            n, r = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), n, r], names=[id, "n_words", "n_repeated"])

    share = F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(F.lit(0.0))
    return documents.select(id, F.col(text).alias("__text")).mapInArrow(measure, schema).select("*", share.alias("repeated_share"))


def _encoder(path: str):
    """Text to token ids, and whether each id is a byte that stands for no whole character, of a public vocabulary."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda t: model.encode(t, num_threads=1)), np.array([model.is_byte(k) for k in range(model.vocab_size())])
    encoding = load_encoding(path)
    byte = np.zeros(encoding.n_vocab + 1, bool)
    for k in range(encoding.n_vocab):
        try:
            encoding.decode_single_token_bytes(k).decode()
        except (UnicodeDecodeError, KeyError):
            byte[k] = True
    return (lambda t: [x for p in pieces(t) for x in encoding.encode_ordinary(p)]), byte


def repetitive(documents: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", share: float = 0.3, least: int = 20, stretch: int = 5) -> DataFrame:
    """id, n_words, tokens_per_word, type_entropy, n_repeated, repeated_share of the documents of at least
    `least` words whose share of repeated words (see repetition) is at least `share`.

    Method: the fertility of a public vocabulary (tokens per word, each word encoded by itself) and the
    entropy of the token types (order 0: log2 of the different tokens) reject what cannot be repetitive.
    Every token of a repeated word came before, and a word has a token or more, so a document of n words
    with that share has at most n (fertility - share) different tokens: the band of its entropy ends at
    log2 n + log2(fertility - share), wherever its language's fertility lies.  Only documents within it are
    measured exactly; none is lost.  Null and empty texts never come out, an empty table gives no rows,
    repeated ids are measured each, further columns are not read.  No shuffle.
    """
    schema = documents.select(F.col(id)).schema.add("n_words", "long").add("tokens_per_word", "double").add("type_entropy", "double").add("n_repeated", "long")

    def measure(batches):
        encoding, known = load_encoding(vocabulary), {}
        for batch in batches:
            kept, rows = [], []
            if len(known) > 200_000:
                known.clear()
            for k, t in enumerate(batch.column(1).to_pylist()):
                words = WORD.findall(t.lower()) if t else []
                n = len(words)
                if n < max(1, least):
                    continue
                counts = Counter(words)
                for w in counts.keys() - known.keys():
                    known[w] = encoding.encode_ordinary(" " + w)
                tokens = sum(c * len(known[w]) for w, c in counts.items())
                types = len(set().union(*map(known.__getitem__, counts)))
                if tokens <= share * n or np.log2(types) > np.log2(n) + np.log2(tokens / n - share) + 1e-9:
                    continue
                r = _repeats(words, stretch)
                if r >= share * n:
                    kept.append(k)
                    rows.append((n, tokens / n, float(np.log2(types)), r))
            cols = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), *cols], names=schema.names)

    return documents.select(id, F.col(text).alias("__text")).mapInArrow(measure, schema).withColumn("repeated_share", F.col("n_repeated") / F.col("n_words"))


def script_of(text: str) -> str:
    """The script of most letters of a text, "none" without letters."""
    best, most = "none", 0
    for name, letters in _SCRIPTS.items():
        n = sum(map(len, letters.findall(text)))
        if n > most:
            best, most = name, n
    return best


#: Scripts that are told apart.
_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}+") for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Han", "Hiragana", "Katakana")}


def fertility(documents: DataFrame, vocabularies: list[str], id: str = "doc_id", text: str = "text", lang: str = "lang", bands: float = 4.0) -> DataFrame:
    """id, vocabulary, band, n_tokens, chars_per_token, byte_share, token_entropy, in_band of every document and vocabulary.

    vocabularies are paths of public ones that every executor can read (.tiktoken ranks or .model of
    sentencepiece), named by their file.  byte_share is the share of tokens that are bytes and hold no whole
    character, to which a vocabulary falls back for what it has no entry for; the entropy (bits) is that
    of the document's own tokens.

    band is the language (trimmed, lower-cased), or the script of the text where that is null, empty or
    "und".  in_band tells whether chars_per_token is within `bands` times the band's spread of its median,
    byte_share not above its median by more, and the entropy per log2 of the tokens not below it by more; a
    spread is the median absolute deviation, at least 5 % of the median (of byte_share at least 0.02).  The
    medians are of all documents of the band (approximate percentiles, one pass with map-side combine).
    Null and empty texts have null measures and are out of band; further columns are not read.
    """
    schema = f"__id {dict(documents.dtypes)[id]}, vocabulary string, band string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"

    def measure(batches):
        encoders = {path.rsplit("/", 1)[-1].split(".")[0]: _encoder(path) for path in vocabularies}
        for batch in batches:
            texts = batch.column(2).to_pylist()
            langs = [(v or "").strip().lower() for v in batch.column(1).to_pylist()]
            band = pa.array([v if v not in ("", "und") else f"script {script_of(t or '')}" for v, t in zip(langs, texts)], pa.string())
            for name, (encode, byte) in encoders.items():
                rows = []
                for t in texts:
                    ids = np.array(encode(t), np.int64) if t else np.zeros(0, np.int64)
                    if not len(ids):
                        rows.append((0, None, None, None))
                        continue
                    p = np.unique(ids, return_counts=True)[1] / len(ids)
                    rows.append((len(ids), len(t) / len(ids), float(byte[ids].mean()), float(-(p * np.log2(p)).sum())))
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), *[pa.float64()] * 3))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(texts), pa.string()), band, *cols], names=["__id", "vocabulary", "band", "n_tokens", "chars_per_token", "byte_share", "token_entropy"])

    sized = cut(documents.select(F.col(id).alias("__id"), F.col(lang).alias("lang"), F.col(text).alias("__text")).mapInArrow(measure, schema))
    flat = F.when(F.col("n_tokens") > 1, F.col("token_entropy") / F.log2(F.col("n_tokens"))).when(F.col("n_tokens") == 1, F.lit(1.0))
    sized = sized.withColumn("__flat", flat)
    measures = {"chars_per_token": "__m", "__flat": "__f", "byte_share": "__b"}
    by = ["vocabulary", "band"]
    middle = sized.groupBy(*by).agg(*[F.percentile_approx(c, 0.5).alias(m) for c, m in measures.items()])
    near = sized.join(F.broadcast(middle) if middle.limit(10_001).count() <= 10_000 else middle, by)
    spread = near.groupBy(*by).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(m)), 0.5).alias(f"{m}s") for c, m in measures.items()])
    width, drop, more = F.greatest("__ms", 0.05 * F.col("__m")), F.greatest("__fs", 0.05 * F.col("__f")), F.greatest("__bs", F.lit(0.02))
    inside = (F.abs(F.col("chars_per_token") - F.col("__m")) <= bands * width) & (F.col("__flat") >= F.col("__f") - bands * drop) & (F.col("byte_share") <= F.col("__b") + bands * more)
    return near.join(spread, by).select(
        F.col("__id").alias(id), "vocabulary", "band", "n_tokens", "chars_per_token", "byte_share", "token_entropy", F.coalesce(inside, F.lit(False)).alias("in_band")
    )
