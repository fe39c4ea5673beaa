"""Benchmark decontamination with a generalised suffix automaton.

The automaton knows every run of words that occurs in an item. Document words stream through it, and at each word it
gives the length of the longest run that ends there and that some item holds; a run of `window` words or more is an
occurrence. Words that can't be part of one (no run of the items' shortest window length starts, passes or ends there)
are recognised by hashes beforehand, a whole batch at a time, so that the automaton sees little else than item text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, DOCUMENT_COLUMNS, Shared, Tables, Words, mix, pick, table, text_slices

WINDOW = 10
#: An automaton is built of so many item words at most; a larger benchmark takes several, in passes over the documents.
BLOCK_WORDS = 400_000
#: Words that the screen compares at once.
SCREEN = 3

_ROW = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long,first_word:long,end_word:long>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.int64())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))),
    ]
)


def item_words(text: str | None) -> list[bytes]:
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]), ALNUM)
    return [words.word(i) for i in range(len(words.starts))]


class Automaton:
    """Suffix automaton of several word sequences; `spot` lists the items of a run of words that is a window."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.items = [(i, words) for i, words in items if words]
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in self.items:
            self._add(words)
        # whole short items and windows of long ones, by the state and the length that spell them
        self.windows: dict[tuple[int, int], set[int]] = {}
        self.marks: dict[int, list[int]] = {}  # state: lengths of windows that it spells
        for item, words in self.items:
            size = min(window, len(words))
            for at, state, length in self.run(words):
                if length >= size:
                    state = self.spelled(state, size)
                    if (state, size) not in self.windows:
                        self.windows[state, size] = set()
                        self.marks.setdefault(state, []).append(size)
                    if at >= size - 1:
                        self.windows[state, size].add(item)
        self.windows = {k: v for k, v in self.windows.items() if v}
        self.shortest = min((min(window, len(words)) for _, words in self.items), default=window)
        self.screen = min(SCREEN, self.shortest)
        short = np.array([], dtype=np.uint64)
        runs = [short]
        for _, words in self.items:
            text = np.frombuffer(b" ".join(words), dtype=np.uint8)
            runs.append(run_hashes(Words(text, np.array([0, len(text)]), ALNUM).hashes, self.screen))
        self.screened = np.unique(np.concatenate(runs))
        bits = np.zeros(1 << 20, dtype=bool)
        bits[(self.screened >> np.uint64(44)).astype(np.int64)] = True
        self.bits = bits
        # the nearest state up the suffix links, itself included, that spells a window
        self.nearest = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.nearest[state] = state if state in self.marks else (self.nearest[self.link[state]] if state else -1)

    def _add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            if (q := self.next[last].get(w)) is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new = self._state({}, self.length[last] + 1)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new

    def _state(self, to: dict[bytes, int], length: int, link: int = 0) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state of its own for the strings of q that are no longer than p's and w."""
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def run(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
        """For each word: its number, the state and the length of the longest item run that ends with it."""
        state = length = 0
        for at, w in enumerate(words):
            while (to := self.next[state].get(w)) is None and state:
                state = self.link[state]
                length = self.length[state]
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield at, state, length

    def spelled(self, state: int, size: int) -> int:
        """The state of the last `size` words of a longer run."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def spot(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """Occurrences of windows: number of the last word, how many words, the items."""
        for at, state, length in self.run(words):
            s = self.nearest[state]
            while s >= 0:
                for size in self.marks[s]:
                    if size <= length and (found := self.windows.get((s, size))):
                        yield at, size, found
                s = self.nearest[self.link[s]] if s else -1


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size if n else 0):
        out += h[j : j + n] * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x51ED270B)
    return mix(out)


def _mark(words: Words, auto: Automaton) -> Iterator[tuple[np.ndarray, np.ndarray, set[int]]]:
    """For each text: which of its words are hit, which of them by a whole item shorter than a window, and the items."""
    k = auto.screen
    h = run_hashes(words.hashes, k)
    maybe = np.flatnonzero(auto.bits[(h >> np.uint64(44)).astype(np.int64)])
    if len(auto.screened):
        at = np.minimum(np.searchsorted(auto.screened, h[maybe]), len(auto.screened) - 1)
        maybe = maybe[auto.screened[at] == h[maybe]]
    else:
        maybe = maybe[:0]
    # stretches that the screened runs cover, cut where texts end
    text = np.searchsorted(words.first, maybe, side="right") - 1
    inside = maybe + k <= words.first[text + 1] if len(maybe) else np.zeros(0, dtype=bool)
    maybe, text = maybe[inside], text[inside]
    n = len(words.offsets) - 1
    hits: list[list[tuple[int, int, bool]]] = [[] for _ in range(n)]
    items: list[set[int]] = [set() for _ in range(n)]
    joined: list[set[int]] = [set() for _ in range(n)]  # which windows' items are in already
    if len(maybe):
        new = np.flatnonzero(np.r_[True, (maybe[1:] > maybe[:-1] + 1) | (text[1:] != text[:-1])])
        for a, b in zip(new, np.r_[new[1:], len(maybe)], strict=True):
            first, end, t = int(maybe[a]), int(maybe[b - 1]) + k, int(text[a])
            if end - first < auto.shortest:
                continue
            for at, size, found in auto.spot(words.word(i) for i in range(first, end)):
                hits[t].append((first + at - size + 1, first + at + 1, size < auto.window))
                if id(found) not in joined[t]:
                    joined[t].add(id(found))
                    items[t] |= found
    for t in range(n):
        hit = np.zeros(int(words.first[t + 1] - words.first[t]), dtype=bool)
        whole = np.zeros_like(hit)
        for a, b, short in hits[t]:
            hit[a - words.first[t] : b - words.first[t]] = True
            if short:
                whole[a - words.first[t] : b - words.first[t]] = True
        yield hit, whole, items[t] - {None}


def _stretches(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def _automata(benchmark: DataFrame, block_words: int, window: int = WINDOW) -> list[Callable[[], Shared]]:
    """Automata of blocks of about so many item words, built in tasks and written; each is fetched when its pass begins, so
    that the driver holds one at a time.

    Long items are cut into parts that overlap, so that each of their windows is in one. Parts are dealt to blocks by a
    hash, half as many words a block on average as it may have.
    """
    spark, most = benchmark.sparkSession, max(1, block_words // 16)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = item_words(text.as_py())
                parts = [words[at : at + most + window - 1] for at in range(0, max(1, len(words) - window + 1), most)] if words else []
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary())]
                columns = ([item] * len(parts), [len(p) for p in parts], parts)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "n", "words"])

    tables = Tables(spark, "benchmark")
    parts = tables.write(pick(benchmark, "item_id", "text").mapInArrow(cut, "item_id long, n long, words array<binary>"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = 1 if total <= block_words else -(-2 * total // block_words)

    def build(own: pa.Table) -> pa.Table:
        pairs = zip(own.column("item_id").to_pylist(), own.column("words").to_pylist(), strict=True)
        rows = sorted(pairs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        return pa.table({"block": pa.array([own.column("block")[0].as_py()], pa.int32()), "automaton": pa.array([cloudpickle.dumps(Automaton(rows, window))], pa.binary())})

    dealt = parts.select(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int").alias("block"), "item_id", "words")
    built = tables.write(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"))
    tables.drop(parts)
    numbers = sorted(r["block"] for r in built.select("block").collect())
    fetch = lambda i: Shared(spark, pickled=built.where(F.col("block") == i).first()["automaton"])
    return [partial(fetch, i) for i in numbers] or [lambda: Shared(spark, Automaton([], window))]


def _in_passes(out: DataFrame, automata: list[Callable[[], Shared]], step, last) -> DataFrame:
    """One pass over the rows for each automaton, each written before the next one starts; the last one is for whoever reads the result."""
    tables, written = Tables(out.sparkSession, "passes"), None
    for fetch in automata[:-1]:
        auto = fetch()
        before, written = written, tables.write(step(out, auto))
        out = written
        auto.forget()
        if before is not None:
            tables.drop(before)
    return last(out, automata[-1]())


def _code_points(lowered: np.ndarray, places: list[int]) -> list[int]:
    """Numbers of code points before these bytes of one text."""
    before = np.concatenate([[0], np.cumsum((lowered & 0xC0) != 0x80)])
    return before[places].tolist()


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Occurrences of benchmark windows in every whole text.

    Returns doc_id, n_words, n_hit, items (sorted ids whose windows occur), spans (start and end code point, first and end
    word of each stretch of hit words), one row for each input row. Words are runs of ASCII letters (lower-cased), digits
    and characters beyond ASCII; an item's windows are its runs of `window` words, or the whole item if it has fewer. Null
    or empty texts have no words, items without words no windows; items of the same id count as one; the windows of an item
    with a null id hit words like any other's, but there is no id to list. An empty benchmark gives no hits. Other columns are ignored.

    Without a shuffle of the documents. The automaton of about `block_words` item words at most goes to every task; a larger
    benchmark is cut into blocks of items, each of which makes another pass, and the passes' hits are joined in the row.
    """
    out = pick(docs, "doc_id", "text").withColumn("found", F.lit(None).cast("array<struct<first_word:long,end_word:long>>")).withColumn("items", F.lit(None).cast("array<long>"))
    names = ["doc_id", "text", "found", "items"]
    schema = "doc_id long, text string, found array<struct<first_word:long,end_word:long>>, items array<long>"
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("found", pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))), ("items", pa.list_(pa.int64()))])
    step = lambda df, auto: df.mapInArrow(_pass(auto, None, arrow), schema)
    return _in_passes(out, _automata(benchmark, block_words, window), step, lambda df, auto: df.select(names).mapInArrow(_pass(auto, _ARROW, arrow), _ROW))


def _pass(shared, last: pa.Schema | None, between: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            known, known_items = batch.column(2), batch.column(3)
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                rows: dict[str, list] = {"n_words": [], "n_hit": [], "items": [], "spans": []}
                for t, (hit, _, items) in enumerate(_mark(words, auto)):
                    for x in known[a + t].as_py() or ():
                        hit[x["first_word"] : x["end_word"]] = True
                    items = sorted(items.union(known_items[a + t].as_py() or ()))
                    stretches = _stretches(hit)
                    spans = [{"first_word": x, "end_word": y} for x, y in stretches]
                    if last is not None and spans:
                        base, first = int(offsets[t]), int(words.first[t])
                        text = words.lowered[base : int(offsets[t + 1])]
                        places = [int(p) - base for x, y in stretches for p in (words.starts[first + x], words.ends[first + y - 1])]
                        at = _code_points(text, places)
                        spans = [s | {"start": at[2 * i], "end": at[2 * i + 1]} for i, s in enumerate(spans)]
                    for k, v in zip(rows, (len(hit), int(hit.sum()), items, spans), strict=True):
                        rows[k].append(v)
                ids = batch.column(0).slice(a, b - a)
                if last is None:
                    yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(a, b - a), pa.array(rows["spans"], between.field(2).type), pa.array(rows["items"], between.field(3).type)], schema=between)
                else:
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[n], last.field(n).type) for n in last.names[1:])], schema=last)

    return run


_CLEAN = "doc_id long, text string, lang string, source string, n_chars long"
_MARKED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text", pa.string()),
        ("lang", pa.string()),
        ("source", pa.string()),
        ("n_chars", pa.int64()),
        ("hit", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
        ("whole", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
    ]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_span: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark text, with the columns doc_id, text, lang, source, n_chars.

    Hit spans of `min_span` words or more (and those with a whole item shorter than a window) are cut out of the text; a
    document of whose words more than `max_coverage` are hit goes altogether. Spans and coverage are those of the whole
    benchmark, however many blocks it takes. Documents without hits stay as they are, nulls included.
    """
    ranges = "array<struct<first:long,end:long>>"
    out = pick(docs, *DOCUMENT_COLUMNS).withColumn("hit", F.lit(None).cast(ranges)).withColumn("whole", F.lit(None).cast(ranges))
    step = lambda df, auto: df.mapInArrow(_marker(auto), f"{_CLEAN}, hit {ranges}, whole {ranges}")
    return _in_passes(out, _automata(benchmark, block_words), step, lambda df, auto: df.mapInArrow(_cutter(auto, min_span, max_coverage), _CLEAN))


def _all_hits(batch: pa.RecordBatch, a: int, words: Words, auto: Automaton) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text of a slice that starts at row a: its row, its hit words, and those of whole short items, of this pass and those before."""
    for t, (hit, whole, _) in enumerate(_mark(words, auto)):
        for mask, known in ((hit, batch.column(5)), (whole, batch.column(6))):
            for x in known[a + t].as_py() or ():
                mask[x["first"] : x["end"]] = True
        yield a + t, hit, whole


def _marker(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                marked: tuple[list, list] = ([], [])
                for _, *masks in _all_hits(batch, a, Words(data, offsets, ALNUM), auto):
                    for out, mask in zip(marked, masks, strict=True):
                        out.append([{"first": x, "end": y} for x, y in _stretches(mask)])
                new = [pa.array(m, _MARKED.field(5).type) for m in marked]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a).cast(_MARKED.field(i).type) for i in range(5)), *new], schema=_MARKED)

    return run


def _cutter(shared, min_span: int, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                keep, texts = [], []
                for row, hit, whole in _all_hits(batch, a, words, auto):
                    keep.append(not hit.any() or hit.mean() <= max_coverage)
                    text = batch.column(1)[row].as_py()
                    cuts = [(x, y) for x, y in _stretches(hit) if y - x >= min_span or whole[x:y].any()]
                    if cuts and keep[-1]:
                        base, first = int(offsets[row - a]), int(words.first[row - a])
                        raw = data[base : int(offsets[row - a + 1])]
                        left = np.ones(len(raw), dtype=bool)
                        for x, y in cuts:
                            left[int(words.starts[first + x]) - base : int(words.ends[first + y - 1]) - base] = False
                        text = raw[left].tobytes().decode()
                    texts.append(text)
                part = batch.slice(a, b - a)
                new = pa.array(texts, pa.string())
                sizes = pa.array([old if x is None or old is None else len(x) for x, old in zip(texts, part.column(4).to_pylist(), strict=True)], pa.int64())
                out = pa.RecordBatch.from_arrays([part.column(0), new, part.column(2), part.column(3), sizes], _MARKED.names[:5])
                yield out.filter(pa.array(keep, pa.bool_()))

    return run


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[p:p + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM i WHERE len(words) > 0)),
dw AS (
  SELECT doc_id, p, size, array_to_string(words[p:p + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM w, (SELECT DISTINCT size FROM iw) WHERE len(words) >= size)),
m AS (SELECT doc_id, p, dw.size, item_id FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(s) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
