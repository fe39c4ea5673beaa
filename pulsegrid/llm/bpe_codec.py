"""Byte-pair encoding and decoding that reuses content-defined chunks.

A rolling hash cuts texts into chunks wherever its value says so, so that texts which share a passage share its chunks.
A chunk that occurs more than once in the corpus is encoded once, into a dictionary; what lies between such chunks is
encoded where it stands. A chunk's own encoding can be wrong where it meets its neighbours, so each join is repaired: the
last word before it is encoded again together with more and more of what follows, until a word starts there at the same
place as in the next chunk's own encoding. From such a place on both encodings agree to the end of the chunk.

Four passes over the texts, of which three only cut and hash: counts of chunks; texts of those that occur more than once;
texts without such chunks (encoded in place); the rest, whose chunks meet the dictionary and are put in order again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, Tables, pick, table, text_slices
from .token_counts import MAX_VOCABULARY_BYTES, byte_symbols

#: Bytes of a chunk at least and at most; between them one place in 2 ** CUT_BITS is a cut.
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 128, 8_192, 10
#: Bytes that the rolling hash sees; a cut lies MIN_CHUNK bytes or more behind the text's start, so it sees that text alone.
WINDOW = 16
#: What a word is does not depend on anything this many bytes behind its end.
MARGIN = 16
#: Bytes after a join that are encoded again at first.
REPAIR = 64
#: Chunks with more than 1 / HOT of all occurrences of repeated chunks, so fewer than HOT (of MAX_CHUNK bytes each), go to
#: every task with their ids; no other chunk has enough occurrences to burden a task.
HOT = 1_000
#: Bits of the map that tells which chunks may be repeated ones (8 MB). One it takes for repeated by chance gets an entry too.
MAP_BITS = 26

_GEAR = np.random.default_rng(20250117).integers(0, 1 << 32, 256, dtype=np.uint32)
_BASE = 0x9E3779B1
_BLOCK = 1 << 20

#: How the library's byte-level splitter cuts a text into words. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def read_vocabulary(path: str | None = None) -> Vocabulary:
    """A vocabulary file, checked; it goes to every task whole."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        raw = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary file has more than {MAX_VOCABULARY_BYTES} bytes")
    spec = json.loads(raw)
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    same = {
        "model": model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")),
        "normalizer": not spec.get("normalizer"),
        "split": before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"),
        "decoder": after.get("type") == "ByteLevel",
        "added tokens": not any(t.get(k) for t in spec.get("added_tokens") or () for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    if other := [k for k, ok in same.items() if not ok]:
        raise ValueError(f"the vocabulary file has another {', '.join(other)} than this codec")
    return Vocabulary(raw)


class Vocabulary:
    """The bytes of each id, the added tokens, and which characters need the slower of two encoders."""

    def __init__(self, raw: str):
        self.raw, spec = raw, json.loads(raw)
        byte = {s: b for b, s in enumerate(byte_symbols())}
        own, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
        self.specials = {content.encode(): i for content, i in added.items()}
        self.of = [b""] * (max([*own.values(), *added.values()]) + 1)
        for token, i in [*own.items(), *added.items()]:
            self.of[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.sizes = np.array([len(x) for x in self.of], dtype=np.int64)
        #: Ids that surely begin a word: no word holds a space before a visible character but at its start.
        self.opens = np.array([len(x) > 1 and x[0] == 32 and 33 <= x[1] <= 126 for x in self.of])
        self.dtype = np.dtype("<u2" if len(self.of) <= 1 << 16 else "<u4")
        longest = sorted(self.specials, key=len, reverse=True)
        self.special = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        # encoding by rank needs ids in the order of the merges, and one id for each token
        made = [own[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        self.ranked = sorted(made) == made and len({self.of[i] for i in own.values()}) == len(own)
        self.ranks = {self.of[i]: i for i in own.values()} if self.ranked else {}
        self.odd = re.compile("[\U00010000-\U0010ffff]")
        if self.ranked and (differ := Codec(self).differences()):
            self.odd = re.compile("[\U00010000-\U0010ffff" + "".join(map(re.escape, differ)) + "]")

    def bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.of.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        return self.bytes(ids).decode("utf-8", "replace")


class Codec:
    """Encodes runs of text without added tokens, and joins the encodings of pieces.

    Runs are encoded by tiktoken, which gives what the tokenizers library gives where both cut words alike. What a character
    counts as can differ between their Unicode tables, so texts with such a character, or one beyond the basic plane, go to
    the tokenizers library, which is several times slower; so does what tiktoken refuses (very long words).
    """

    def __init__(self, vocabulary: Vocabulary):
        self.known, self.dtype, self.bytes = vocabulary, vocabulary.dtype, vocabulary.bytes
        self.sizes, self.opens = vocabulary.sizes, vocabulary.opens
        self._library = self._ranked = None
        if vocabulary.ranked:
            import tiktoken

            self._ranked = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary.ranks, special_tokens={})

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.known.raw)
            self._library.no_truncation()
            self._library.no_padding()
            self._library.encode_special_tokens = True  # texts are split at these beforehand
        return self._library

    def differences(self) -> list[str]:
        """Characters of the basic plane around which the two encoders differ."""

        def differ(chars: list[str]) -> list[str]:
            probe = "\n".join(f"a{c}a1{c}1.{c}. {c}a {c}1 {c}." for c in chars)
            if self._by_rank(probe).tolist() == self._by_library(probe).tolist():
                return []
            half = len(chars) // 2
            return differ(chars[:half]) + differ(chars[half:]) if half else chars

        plane = [chr(c) for c in range(1 << 16) if not 0xD800 <= c < 0xE000]
        return [c for k in range(0, len(plane), 512) for c in differ(plane[k : k + 512])]

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _by_rank(self, text: str) -> np.ndarray:
        return self._ranked.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def encode(self, raw: bytes) -> np.ndarray:
        text = raw.decode()
        if self._ranked is not None and (text.isascii() or not self.known.odd.search(text)):
            try:
                return self._by_rank(text)
            except ValueError:  # its splitter refuses very long words
                pass
        return self._by_library(text)

    def _places(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins, and the end."""
        out = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.sizes[ids], out=out[1:])
        return out

    def _settled(self, ids: np.ndarray) -> int:
        """The last word known to start MARGIN bytes or more before the end, or the first: all before it stay as they are."""
        for most in (64, len(ids)):  # nearly always a near one
            tail = ids[-most:]
            places = self._places(tail)
            known = np.flatnonzero(self.opens[tail] & (places[:-1] <= places[-1] - MARGIN))
            if len(known):
                return len(ids) - len(tail) + int(known[-1])
        return 0

    def join(self, pieces: list[np.ndarray]) -> np.ndarray:
        """The ids of the text that these pieces make up one after the other.

        What is encoded again grows to at least twice its size before the next try, so that a word of any length costs
        time in proportion to its own.
        """
        queue = deque(p for p in pieces if len(p))
        if not queue:
            return np.empty(0, dtype=self.dtype)
        out = []
        ids = queue.popleft()
        while queue:
            at = self._settled(ids)
            out.append(ids[:at])
            tail = self.bytes(ids[at:])
            while True:
                window, begin, piece, rest = self._widened(tail, queue)
                new = self.encode(window)
                if not queue:
                    return np.concatenate([*out, new])
                places, own = self._places(new), begin + self._places(piece)
                mine, its = places[:-1][self.opens[new]], own[:-1][self.opens[piece]]
                mine = mine[(mine >= begin) & (mine <= len(window) - MARGIN)]
                both = mine[np.isin(mine, its, assume_unique=True)]
                if len(both):
                    out.append(new[: np.searchsorted(places, both[0])])
                    ids = piece[int(np.searchsorted(own, both[0])) :]
                    if rest is not None:
                        queue.popleft()
                        ids = np.concatenate([ids, rest])
                    break
                at = self._settled(new)
                out.append(new[:at])
                tail = self.bytes(new[at:])
        return np.concatenate([*out, ids])

    def _widened(self, tail: bytes, queue: deque[np.ndarray]) -> tuple[bytes, int, np.ndarray, np.ndarray | None]:
        """The tail and at least as much again of the queue; where its last piece begins, what is taken of that, and the rest of it, which stays first in the queue."""
        want, parts, size = max(REPAIR, len(tail)), [tail], len(tail)
        while True:
            ids = queue.popleft()
            head = ids[: want + 512]  # an id has a byte at least
            places = self._places(head)
            beyond = np.flatnonzero(self.opens[head] & (places[:-1] >= want))
            if len(beyond):
                k = int(beyond[0])
                queue.appendleft(ids[k:])
                return b"".join([*parts, self.bytes(ids[:k])]), size, ids[:k], ids[k:]
            text = self.bytes(ids)
            parts.append(text)
            begin, size, want = size, size + len(text), want - len(text)
            if want <= 0 or not queue:
                return b"".join(parts), begin, ids, None

    def text(self, parts: list[tuple[bool, np.ndarray]]) -> np.ndarray:
        """The ids of a text in parts (hard, ids), where a hard one is an added token, which no word crosses."""
        out, run = [], []
        for hard, ids in parts:
            if hard:
                out += [self.join(run), ids]
                run = []
            else:
                run.append(ids)
        return np.concatenate([*out, self.join(run)])


# -- chunks -------------------------------------------------------------------------------------------------------


def cut_places(data: np.ndarray) -> np.ndarray:
    """Places before which the rolling hash of the last WINDOW bytes says cut, and a character begins."""
    found = []
    for a in range(0, len(data), _BLOCK):
        part = data[max(0, a - WINDOW) : a + _BLOCK]
        h, step, factor = _GEAR[part], 1, _BASE
        while step < WINDOW:
            more = h.copy()
            more[step:] += h[:-step] * np.uint32(factor)
            h, step, factor = more, 2 * step, factor * factor & 0xFFFFFFFF
        at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + max(0, a - WINDOW) + 1
        found.append(at[at > a])
    at = np.concatenate(found) if found else np.empty(0, dtype=np.int64)
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def _chunk_ends(data: np.ndarray, places: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of the run [a, b)."""
    own = places[np.searchsorted(places, a) : np.searchsorted(places, b)]
    while a < b:
        i = int(np.searchsorted(own, a + MIN_CHUNK))
        to = min(int(own[i]) if i < len(own) else b, b)
        if to - a > MAX_CHUNK:
            to = a + MAX_CHUNK
            while to > a + 1 and data[to] & 0xC0 == 0x80:
                to -= 1
        yield a, to
        a = to


def chunks_of(column: pa.Array, special: re.Pattern | None) -> Iterator[tuple[int, list[bytes | tuple[bytes, bytes]]]]:
    """For each row its parts in order: an added token's own bytes, or (digest, bytes) of a chunk."""
    for first, _, data, offsets in text_slices(column):
        places = cut_places(data)
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
            raw, parts, at = data[a:b].tobytes(), [], a
            for k, run in enumerate(special.split(raw) if special else [raw]):
                if k % 2:
                    parts.append(run)
                else:
                    parts += [(hashlib.blake2b(c := raw[x - a : y - a], digest_size=16).digest(), c) for x, y in _chunk_ends(data, places, at, at + len(run))]
                at += len(run)
            yield row, parts


def _map_place(digest: bytes) -> int:
    return int.from_bytes(digest[8:], "little") & ((1 << MAP_BITS) - 1)


class _Repeated:
    """Which chunks may be repeated (`bits`), and the pieces of the hottest (`hot`)."""

    def __init__(self, bits: np.ndarray, hot: dict[bytes, bytes]):
        self.bits, self.hot = bits.tobytes(), hot

    def __contains__(self, digest: bytes) -> bool:
        i = _map_place(digest)
        return self.bits[i >> 3] >> (i & 7) & 1 == 1


def _halves(digests: list[bytes]) -> list[pa.Array]:
    pairs = [struct.unpack("<qq", d) for d in digests]
    return [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]


# -- the corpus ---------------------------------------------------------------------------------------------------


def _counts(texts: DataFrame, raw: Shared) -> DataFrame:
    """Every chunk and how often it occurs: hi, lo, n. Each task counts a batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = raw.value
        for batch in batches:
            seen = Counter(p[0] for _, parts in chunks_of(batch.column(0), vocabulary.special) for p in parts if type(p) is tuple)
            yield pa.RecordBatch.from_arrays([*_halves(list(seen)), pa.array(seen.values(), pa.int64())], ["hi", "lo", "n"])

    return texts.mapInArrow(run, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _map_of(repeated: DataFrame) -> np.ndarray:
    """The bit map of these chunks: at most 2 ** (MAP_BITS - 6) rows reach the driver."""
    place = F.col("lo").bitwiseAND((1 << MAP_BITS) - 1)
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, CAST(lo & 63 AS INT))")
    got = repeated.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), dtype="<i8")
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint8)


def _dictionary(texts: DataFrame, raw: Shared, repeated: Shared) -> DataFrame:
    """hi, lo, ids of every chunk that the map takes for repeated, each encoded once."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = raw.value, repeated.value
        for batch in batches:
            found = {p[0]: p[1] for _, parts in chunks_of(batch.column(0), vocabulary.special) for p in parts if type(p) is tuple and p[0] in known}
            yield pa.RecordBatch.from_arrays([*_halves(list(found)), pa.array(found.values(), pa.binary())], ["hi", "lo", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(raw.value)
            made = [codec.encode(c.as_py()).tobytes() for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["hi", "lo", "ids"])

    once = texts.mapInArrow(candidates, "hi long, lo long, chunk binary").groupBy("hi", "lo").agg(F.first("chunk").alias("chunk"))
    return once.mapInArrow(encoded, "hi long, lo long, ids binary")


_OUT = "doc_id long, ids array<int>"
_PARTS = "_key long, _seq long, doc_id long, hi long, lo long, ref boolean, hard boolean, ids binary"


class _Rows:
    """Gathers (doc_id, ids) and gives batches of about a million ids."""

    def __init__(self):
        self.docs, self.ids, self.size = [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> bool:
        self.docs.append(doc)
        self.ids.append(ids)
        self.size += len(ids) + 16
        return self.size > 1 << 20

    def batch(self) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int32)
        values = np.concatenate(self.ids).astype(np.int32) if self.ids else np.empty(0, dtype=np.int32)
        out = pa.RecordBatch.from_arrays([pa.array(self.docs, pa.int64()), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])
        self.docs, self.ids, self.size = [], [], 0
        return out


def _whole(docs: DataFrame, vocabulary: Shared, repeated: Shared) -> DataFrame:
    """Texts that need no entry but those every task has, encoded where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows = None, _Rows()
        for batch in batches:
            if codec is None:
                codec, known = Codec(vocabulary.value), repeated.value
            ids = batch.column(0)
            for row, parts in chunks_of(batch.column(1), codec.known.special):
                if _refers(parts, known):
                    continue  # _parts takes it
                if rows.add(ids[row].as_py(), codec.text(list(_runs(parts, known, codec)))):
                    yield rows.batch()
        if rows.docs:
            yield rows.batch()

    return docs.mapInArrow(run, _OUT)


def _refers(parts: list, known: _Repeated) -> bool:
    """Whether a text has a repeated chunk that the dictionary alone has."""
    return any(type(p) is tuple and p[0] in known and p[0] not in known.hot for p in parts)


def _runs(parts: list, known: _Repeated, codec: Codec) -> Iterator[tuple[bool, np.ndarray | bytes]]:
    """(hard, ids) of each added token, repeated chunk (its digest, if only the dictionary has it) and run of other chunks."""
    own: list[bytes] = []

    def take() -> Iterator[tuple[bool, np.ndarray]]:
        if own:
            yield False, codec.encode(b"".join(own))
            own.clear()

    for p in parts:
        if type(p) is bytes:
            yield from take()
            yield True, np.array([codec.known.specials[p]], dtype=codec.dtype)
        elif (entry := known.hot.get(p[0])) is not None:
            yield from take()
            yield False, np.frombuffer(entry, dtype=codec.dtype)
        elif p[0] in known:
            yield from take()
            yield False, p[0]
        else:
            own.append(p[1])
    yield from take()


def _parts(docs: DataFrame, vocabulary: Shared, repeated: Shared) -> DataFrame:
    """The other texts in parts: each a reference to the dictionary (hi, lo) or ids of its own, numbered by _seq.

    Rows are told apart by partition and place in it, so that repeated and null ids do no harm. Parts with ids of their own
    have a random (hi, lo), which spreads them over the tasks of the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, key = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            if codec is None:
                codec, known = Codec(vocabulary.value), repeated.value
            out: list[tuple] = []
            size, ids = 0, batch.column(0)
            for row, parts in chunks_of(batch.column(1), codec.known.special):
                if not _refers(parts, known):
                    continue
                doc, key = ids[row].as_py(), key + 1
                for seq, (hard, piece) in enumerate(_runs(parts, known, codec)):
                    if type(piece) is bytes:
                        out.append((key, seq, doc, *struct.unpack("<qq", piece), True, False, None))
                    else:
                        out.append((key, seq, doc, key * 0x9E3779B97F4A7C1 % (1 << 63), seq, False, hard, piece.tobytes()))
                        size += piece.nbytes
                if size > 1 << 21 or len(out) > 1 << 15:
                    yield _parts_batch(out)
                    out, size = [], 0
            yield _parts_batch(out)

    return docs.mapInArrow(run, _PARTS)


def _parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.binary()]
    names = [x.split()[0] for x in _PARTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _assembled(parts: DataFrame, dictionary: DataFrame, vocabulary: Shared) -> DataFrame:
    """Parts meet the dictionary, come together by text in order, and are joined as they stream by."""
    entry = dictionary.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("ids").alias("_ids"))
    met = parts.join(entry, F.col("ref") & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
    met = met.select("_key", "_seq", "doc_id", "hard", F.coalesce("ids", "_ids").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows, last, run = None, _Rows(), None, []
        for batch in batches:
            codec = codec or Codec(vocabulary.value)
            for key, doc, hard, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if last is not None and key != last[0]:
                    full, run = rows.add(last[1], codec.text(run)), []
                    if full:
                        yield rows.batch()
                last = key, doc
                run.append((hard, np.frombuffer(ids, dtype=codec.dtype)))
        if last is not None:
            rows.add(last[1], codec.text(run))
            yield rows.batch()

    return met.repartition("_key").sortWithinPartitions("_key", "_seq").mapInArrow(run, _OUT)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The ids of every whole text (doc_id, ids), as the tokenizers library gives them without special tokens added.

    vocabulary: path of a byte-level BPE file in that library's JSON form, read on the driver; a file with other steps than
    the default's is refused. Strings of added tokens inside texts become those tokens, which no word crosses.
    Null and empty texts have no ids. Repeated rows and null ids each give a row; an empty table gives none. Other columns
    are ignored. A text of any length is put together in one task, of which it holds two bytes an id.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    texts, tables = docs.select("text"), Tables(spark, "bpe")
    raw = Shared(spark, read_vocabulary(vocabulary))
    seen = tables.write(_counts(texts, raw).where("n > 1"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    repeated = Shared(spark, _Repeated(bits := _map_of(seen), {}))
    dictionary = tables.write(_dictionary(texts, raw, repeated))
    often = seen.where(F.col("n") > total / HOT).select("hi", "lo")
    rows = dictionary.join(F.broadcast(often), ["hi", "lo"]).collect()  # fewer than HOT
    tables.drop(seen)
    repeated.forget()
    repeated = Shared(spark, _Repeated(bits, {struct.pack("<qq", r["hi"], r["lo"]): bytes(r["ids"]) for r in rows}))
    return _whole(docs, raw, repeated).unionByName(_assembled(_parts(docs, raw, repeated), dictionary, raw))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The texts of (doc_id, ids): doc_id, text. Special tokens stay; bytes that are no UTF-8 become U+FFFD; null ids give null.

    A negative id, or one that the vocabulary lacks, raises an error.
    """
    raw = Shared(encoded.sparkSession, read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = raw.value
        for batch in batches:
            texts = [None if ids is None else known.text(ids) for ids in _id_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.large_string()).cast(pa.string())], ["doc_id", "text"])

    return pick(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _id_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for null, a, b in zip(column.is_null().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if not null and a < b and values[a:b].min() < 0:
            raise ValueError("an id is negative")
        yield None if null else values[a:b]


def digests(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of (doc_id, ids)."""
    raw = Shared(encoded.sparkSession, read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sha = raw.value, lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            made = [(len(ids), sha(ids.astype("<u4").tobytes()), sha(known.text(ids).encode())) for ids in _id_rows(batch.column(1))]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(table(spark, sf_dir, "documents")))
