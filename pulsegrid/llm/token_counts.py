"""Token counts by heap-and-linked-list byte-pair merging.

A text's count is its number of initial symbols minus the merges that the vocabulary's ranks allow; no identifiers are
made. Words repeat, so each task remembers the counts of recent words, in a cache of bounded size.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

#: The vocabulary file goes to every task whole; a larger one than this is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of words that a task remembers before it forgets all and starts again, and letters of a word worth remembering.
CACHE_BYTES, CACHE_LETTERS = 96 << 20, 64
#: What an entry takes besides its word.
_ENTRY = 120

_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: White space in Unicode's sense, which, unlike str.split(), leaves out the separators U+001C to U+001F.
_SPACE = r"[\t-\r \x85\xa0  -     　]"
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: What a vocabulary file has to say of its own steps for the counts to be right.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def check_spec(spec: dict) -> None:
    """Refuse a file whose normalizer, split pattern or kind of model are not those that WordBpeCounter follows."""
    model = spec["model"]
    normalizer, splitter = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    same = {
        "model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")),
        "normalizer": [n.get("type") for n in normalizer.get("normalizers") or ()] == _NORMALIZERS,
        "split pattern": (splitter[0].get("pattern") or {}).get("Regex") == _SPLIT and [x.get("type") for x in splitter] == ["Split", "ByteLevel"] and not splitter[1].get("add_prefix_space"),
        "added tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if other := [k for k, ok in same.items() if not ok]:
        raise ValueError(f"the vocabulary file has another {', '.join(other)} than this counter")


class WordBpeCounter:
    """Counts tokens as a byte-level BPE vocabulary with word ends does: NFC, lower case, white space dropped."""

    def __init__(self, spec: dict):
        check_spec(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + self.end] for s in symbols]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pieces = regex.compile(_PIECE).findall
        self.pieces_of_text = regex.compile(_PIECE.replace(r"[^\s", "[^" + _SPACE[1:-1])).findall
        self.counts: dict[str, int] = {}
        self.held = 0

    def piece(self, text: str) -> int:
        """Repeatedly merge the lowest-ranked adjacent pair (the leftmost of equals); the count is symbols minus merges."""
        raw = text.encode()
        n = len(raw)
        if n < 2:
            return n
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = self.merges
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i, to = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j < 0 or (m := merges.get((symbol[i], symbol[j]))) is None or m[0] != rank:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = to, -1
            after[i] = k = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if m := merges.get((to, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get((symbol[h], to))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return left

    def _word(self, word: str) -> int:
        n, counts = 0, self.counts
        for piece in self.pieces(word):
            if (m := counts.get(piece)) is None:
                m = self.piece(piece)
                self._remember(piece, m)
            n += m
        self._remember(word, n)
        return n

    def _remember(self, word: str, n: int) -> None:
        if len(word) > CACHE_LETTERS:
            return
        if self.held > CACHE_BYTES:
            self.counts.clear()
            self.held = 0
        if word not in self.counts:
            self.held += sys.getsizeof(word) + _ENTRY
        self.counts[word] = n

    def _plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # each character is lowered by itself: str.lower() alone would look at a capital sigma's neighbours
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        if _ODD_SPACE.search(text):
            return sum(map(self.piece, self.pieces_of_text(text)))
        known, total = self.counts.get, 0
        for word in text.split():
            n = known(word)
            total += self._word(word) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(s in text for s in self.specials):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    vocabulary: path of a word-level BPE file in the tokenizers library's JSON form, read on the driver; a file with other
    steps of normalizing and splitting than the default's is refused.
    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null ids each give a row; an empty table gives none.
    Other columns are ignored. Without a shuffle: each task reads its rows once, a batch at a time.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary file has more than {MAX_VOCABULARY_BYTES} bytes")
    check_spec(json.loads(raw))
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or WordBpeCounter(json.loads(shared.value))
            texts = batch.column(1)
            tokens = pa.array([counter.count(x.as_py()) for x in texts], pa.int64())
            sizes = pc.fill_null(pc.binary_length(texts).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
