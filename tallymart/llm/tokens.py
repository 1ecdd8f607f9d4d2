"""Token counts of whole texts under a public BPE vocabulary, by compiled transducers.

Normalising (NFC, lower case by character), cutting into words and the word-end BPE follow the
vocabulary file. Characters are cut into words with array operations over many texts; each distinct
word, told by its bytes, then runs through the transducer of ``transducer.py`` once, and its count is kept for
later texts of the task up to a bound. The file's content is read on the driver and broadcast: its size is fixed.

A long text is cut into chunk rows behind white space, which are dealt over tasks. White space leads every state of
the transducer to its start, so the map of such a chunk has one entry and one exit, and the maps of a
document's chunks compose to the sum of their counts, which Spark adds up by document. A run without
white space that is longer than a chunk stays whole; its words are scanned by prefix composition of the maps of
their pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymart.llm import frames, text
from tallymart.llm.transducer import Transducer

LIMIT = 2048
KEPT_WORDS = 1 << 20
CHUNK_CHARS = 1 << 15
SLICE_CHARS = 1 << 20

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255

# What follows an apostrophe that is not left to punctuation.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_counters: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts; keeps classes of characters and counts of words."""

    def __init__(self, content: str):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        parsed = json.loads(content)
        model, cut = parsed["model"], parsed["pre_tokenizer"]["pretokenizers"][0]
        if model["end_of_word_suffix"] != "</w>" or not cut["invert"]:
            raise ValueError("not a BPE vocabulary with word ends")
        self.machine = Transducer(model["vocab"], [tuple(m) for m in model["merges"]])
        special = [t["content"] for t in parsed["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # Classes of characters are asked of the file's own pattern, character by character.
        self.cut = Split(Regex(cut["pattern"]["Regex"]), "removed", invert=True)
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)
        self.known: dict[bytes, int] = {}

    def _classify(self, codes: np.ndarray) -> None:
        for code in codes.tolist():
            char = chr(code)
            pieces = [p for p, _ in self.cut.pre_tokenize_str(f"a{char}a")]
            if len(pieces) == 2:
                kind = SPACE
            elif len(pieces) == 1:
                kind = LETTER
            else:
                kind = OTHER if len(self.cut.pre_tokenize_str(f"!{char}")) == 1 else NUMBER
            self.classes[code] = kind

    def normalise(self, value: str) -> tuple[str, int]:
        """The text in normal form and the number of special strings cut out of it."""
        cut = 0
        if self.special is not None and "<" in value:
            value, cut = self.special.subn(" ", value)
        if not value.isascii():
            if not unicodedata.is_normalized("NFC", value):
                value = unicodedata.normalize("NFC", value)
            value = value.replace("Σ", "σ")  # no final form: characters are lowered one by one
        return value.lower(), cut

    def count(self, values: list[str | None]) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        first = 0
        while first < len(values):
            last, size, part = first, 0, []
            while last < len(values) and (last == first or size < SLICE_CHARS):
                value, out[last] = self.normalise(values[last] or "")
                part.append(value)
                size += len(value) + 1
                last += 1
            out[first:last] += self._slice(part)
            first = last
        return out

    def _slice(self, part: list[str]) -> np.ndarray:
        joined = "\n".join(part) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[codes]
        if (kind == UNKNOWN).any():
            self._classify(np.unique(codes[kind == UNKNOWN]))
            kind = self.classes[codes]
        opens = kind != SPACE
        opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        self._contractions(codes, kind, opens)
        mark = np.flatnonzero(opens | (kind == SPACE))  # the text ends with white space
        start = np.flatnonzero(opens)
        end = mark[np.searchsorted(mark, start) + 1]

        wide = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.concatenate(([0], np.cumsum(wide)))
        body = joined.encode("utf-8")
        data = np.frombuffer(body, dtype=np.uint8)
        a, b = at[start], at[end]
        encoded = text.Words(data, a, b, a, a, 0).array().dictionary_encode()
        counted = self._counts(encoded.dictionary.to_pylist())
        place = encoded.indices.to_numpy(zero_copy_only=False)
        rows = np.cumsum([0, *(len(p) + 1 for p in part)])
        row = np.searchsorted(rows, start, side="right") - 1
        return np.bincount(row, counted[place], minlength=len(part)).astype(np.int64)

    @staticmethod
    def _contractions(codes: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> None:
        """An apostrophe that opens a run takes one of the endings with it."""
        quote = np.flatnonzero((codes[:-1] == 0x27) & opens[:-1] & (kind[1:] == LETTER))
        for ending in CONTRACTIONS:
            fits = quote[quote + len(ending) < len(codes)]
            for k, char in enumerate(ending, 1):
                fits = fits[codes[fits + k] == ord(char)]
            opens[fits + 1] = False
            after = fits + 1 + len(ending)
            after = after[after < len(codes)]
            opens[after] |= kind[after] == LETTER
            quote = np.setdiff1d(quote, fits, assume_unique=True)

    def _counts(self, distinct: list[bytes]) -> np.ndarray:
        """Counts of distinct words; those not met yet run through the transducer."""
        known, run = self.known, self.machine.count
        if len(known) + len(distinct) > KEPT_WORDS:
            known.clear()
        for word in distinct:
            if word not in known:
                known[word] = run(word)
        return np.fromiter((known[word] for word in distinct), dtype=np.int64, count=len(distinct))


def counter(content: str) -> Counter:
    """The process's counter for a vocabulary; one is kept."""
    if content not in _counters:
        _counters.clear()
        _counters[content] = Counter(content)
    return _counters[content]


def with_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """All columns of ``docs`` and the number of tokens of the whole text; null counts as empty.

    ``vocabulary`` is the path of a tokenizers file on the driver.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    sent = frames.ready(docs).sparkContext.broadcast(content)

    @F.arrow_udf(T.LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = counter(sent.value)
            yield pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *(
                made.count(batch.slice(i, 256).to_pylist()) for i in range(0, len(batch), 256)
            )]))

    return docs.withColumn(name, tokens(frames.col(docs, text_col)))


def chunks(value: Column, size: int = CHUNK_CHARS) -> Column:
    """A text's pieces: up to ``size`` characters that end behind plain white space, or a longer run without any."""
    blank, dark = r"[ \t\r\n]", r"[^ \t\r\n]"
    return F.regexp_extract_all(value, F.lit(rf"(?s).{{1,{size}}}(?:(?<={blank})|$)|{dark}++{blank}?"), F.lit(0))


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Begin and end tokens are not added; special strings inside a text are one token each. Null and
    empty texts have no bytes and no tokens. Repeated rows stay; other columns are left out. No task
    counts more of a text than ``chunk_chars`` characters, or the longest run without white space.
    """
    rows = docs.select(frames.col(docs, id_col).alias("doc_id"), frames.col(docs, text_col).cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    whole = with_tokens(rows.where(~long), vocabulary, "text", "n_tokens").select("doc_id", size, "n_tokens")

    cut = rows.where(long).withColumn("row", F.monotonically_increasing_id())
    cut = cut.select("row", "doc_id", size, F.posexplode(chunks(F.col("text"), chunk_chars)).alias("place", "text"))
    dealt = cut.repartition(frames.partitions(docs.sparkSession), "row", "place")
    parts = with_tokens(dealt, vocabulary, "text", "n_tokens").drop("text")
    composed = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    counted = whole.unionByName(composed.drop("row"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
