"""Secret scans: three plain patterns and a token-efficiency test.

Random strings split into short tokens under a vocabulary made of text, so few characters a token give them away. Known
digests (hex of the usual lengths), UUIDs and identifiers (words joined by case, dots, slashes or underscores) are left
out first, as are strings that a plain pattern has found already.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import pick, table

KINDS = ("assign", "access", "hex", "random")

#: The patterns' texts and least lengths are fixed by what the scan has to find.
_ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ASSIGN_LEAST = 12
_ACCESS, _ACCESS_LEAST = re.compile(r"AKIA[A-Z0-9]+"), 18
#: A run of 16 or more is the whole of what [0-9a-f]+ matches there.
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Strings that the token test looks at, and the parts between their joining signs.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_PART, _PART_LEAST = re.compile(r"[A-Za-z0-9]+"), 16
_DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A digest in base 64 behind the name of its algorithm; its length without padding has to be that of a digest.
_NAMED_DIGEST = re.compile(r"(?i:sha-?(?:1|224|256|384|512)|md5|blake2[bs]?|ripemd160)[-_:=/+ ]{1,2}([A-Za-z0-9+/_-]{22,86})(?![A-Za-z0-9+/_-])={0,2}")
_NAMED_LENGTHS = (22, 27, 38, 43, 64, 86)
#: Times, numbers of books and parts and the like: groups of digits (or times with a T or Z) and short words, joined by signs.
_NUMBERED = re.compile(r"[/_+=-]*(?:(?:[0-9]{1,10}|[A-Za-z]{1,5}|[0-9]{1,8}[TtZz](?:[0-9]{1,6}[Zz]?)?)(?:[/_+=-]+|\Z)){2,}\Z|[0-9]{6,8}[Tt][0-9]{4,9}[Zz]?\Z")
_NUMBERED_LETTERS = 8
_WORD = re.compile(r"[A-Za-z]+")
#: Words with a capital at most, joined by signs: readable however odd the words are.
_WORDS = re.compile(r"[/_+=-]*[A-Z]?[a-z]+(?:[/_+=-]+[A-Z]?[a-z]+)*[/_+=-]*\Z")
#: Parts that are readable, so that they are no beginning or end of a random string with joining signs.
_PLAIN = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})\Z")

#: How far before a candidate the name of a digest's algorithm may begin.
_NAME = 12

MAX_CHARS_PER_TOKEN = 2.0
MAX_VOCABULARY_BYTES = 64 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _in_sequence(s: str) -> bool:
    """Whether half of the characters or more are their predecessor's neighbour or the same: alphabets, counts, repeats."""
    near = sum(-1 <= ord(y) - ord(x) <= 1 for x, y in pairwise(s))
    return 2 * near >= len(s) - 1


class SecretScanner:
    """Spans (kind, start, end) of a text, in code points, by start and then kind."""

    def __init__(self, ranks: bytes, pattern: str, max_chars_per_token: float = MAX_CHARS_PER_TOKEN):
        import tiktoken

        merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encode = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=merge, special_tokens={}).encode_ordinary
        self.limit = max_chars_per_token

    def is_random(self, s: str) -> bool:
        """Few characters a token, letters and digits (or both cases) mixed, and no digest, UUID, number, sequence or identifier."""
        if _UUID.search(s) or (len(s) in _DIGEST_LENGTHS and _DIGEST.match(s)):
            return False
        if (_NUMBERED.match(s) and sum(map(str.isalpha, s)) <= _NUMBERED_LETTERS) or _in_sequence(s):
            return False
        kinds = any(map(str.isdigit, s)) + any(map(str.islower, s)) + any(map(str.isupper, s))
        if kinds < 2 or _WORDS.match(s):
            return False
        if max(map(len, re.findall(r"[A-Z]?[a-z]+|[A-Z]+", s)), default=0) >= 4 and sum(map(len, _WORD.findall(s))) >= 0.8 * len(s):
            # words of some length joined together; in random strings runs of one case are short, or no words
            runs = re.findall(r"[A-Z]?[a-z]+|[A-Z]{2,}|[0-9]+", s)
            words = [r.lower() for r in runs if len(r) > 2 and r.isalpha()]
            if len(s) / max(1, len(runs)) >= 4 and sum(map(len, words)) > self.limit * sum(len(self.encode(w)) for w in words):
                return False
        return len(s) / len(self.encode(s)) <= self.limit

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _ASSIGN_LEAST]
        if "AKIA" in text:
            found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
        return found

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """A random run as a whole; else, without base spans, digests and UUIDs, its random stretches and parts."""
        spans = sorted((a, b) for _, a, b in base)
        starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
        out = []
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            before = bisect_left(starts, b)  # spans that start before the candidate ends; one of them may reach into it
            named = [x.span() for x in _NAMED_DIGEST.finditer(text, max(0, a - _NAME), b) if len(x[1]) in _NAMED_LENGTHS]
            if not named and not (before and reach[before - 1] > a) and self.is_random(m[0]):
                out.append(("random", a, b))
                continue
            first = before
            while first and reach[first - 1] > a:
                first -= 1
            known = [(max(a, x), min(b, y)) for x, y in spans[first:before] if y > a]
            known += [(max(a, x), min(b, y)) for x, y in named if y > a]
            known += [(a + x.start(), a + x.end()) for x in _UUID.finditer(m[0])]
            known += [(a + x.start(), a + x.end()) for x in _PART.finditer(m[0]) if len(x[0]) in _DIGEST_LENGTHS and _DIGEST.match(x[0])]
            at = a
            for x, y in [*sorted(known), (b, b)]:
                if x - at >= _PART_LEAST:
                    out += self.within(text, at, x, x - at < b - a)
                at = max(at, y)
        return out

    def within(self, text: str, a: int, b: int, rest: bool) -> list[tuple[str, int, int]]:
        """The random stretch between the readable parts at both ends of text[a:b], or its random parts; rest: text[a:b] itself is untested."""
        parts = [x.span() for x in _PART.finditer(text, a, b)]
        odd = [x for x in parts if not _PLAIN.match(text[slice(*x)])]
        if not odd:
            return []
        x, y = odd[0][0], odd[-1][1]
        tries = [(x, y)] if y - x >= _PART_LEAST and (rest or y - x < b - a) else []
        if any(self.is_random(text[i:j]) for i, j in tries):
            return [("random", x, y)]
        return [("random", i, j) for i, j in odd if j - i >= _PART_LEAST and (i, j) != (x, y) and self.is_random(text[i:j])]

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        base = self.base(text)
        order = lambda s: (s[1], KINDS.index(s[0]))
        return sorted(base, key=order), sorted(base + self.added(text, base), key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    vocabulary: path of a tiktoken rank file, read on the driver; pattern: its way of splitting text. spans lists
    kind:start:end in code points (end exclusive) by start, comma-joined; base_sha256 digests those of the plain patterns
    alone. A null text counts as empty: no spans, the digest of an empty string. One row for each input row, null and
    repeated ids included; other columns are ignored. Without a shuffle.
    """
    with open(vocabulary or default_vocabulary(), "rb") as file:
        ranks = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary file has more than {MAX_VOCABULARY_BYTES} bytes")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or SecretScanner(shared.value, pattern, max_chars_per_token)
            counts, digests, spans = [], [], []
            for text in pc.fill_null(batch.column(1), ""):
                base, both = scanner.scan(text.as_py())
                kinds = [k for k, _, _ in both]
                counts.append([kinds.count(k) for k in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(both))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
