"""Byte-level BPE by SQL: each partition runs the merges of its words as recursive queries of an in-process DuckDB.

A text is split by the tokenizer's pattern. Words that the task does not know yet go, as rows (word, position, token), into a recursive
query: each step joins neighbouring tokens with the merge table, picks each word's lowest rank (leftmost of equals) and
contracts that pair, until no word has a pair left; the tokens in order are the word's ids. Ids are decoded by another query, which joins the
vocabulary to their rows and aggregates its bytes in order. Known words are kept between batches and tasks, in bounded number.

Words of more than ``SHORT`` bytes make the same merges in the same order in fewer steps: a step contracts a word's lowest pair at one place
after the other, from left to right, and ends after the first contraction that makes a pair of lower rank, be it with a neighbour as it stood or with
what the same step has made.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lists, rows_of, texts

#: Words of one generation that a worker remembers; when it is full, those not met since the one before are forgotten.
CACHE = 300_000
SHORT = 64
#: Bytes of text whose new words are learnt together.
TEXT = 1 << 22
#: Tokens that one query decodes.
TOKENS = 1 << 18
#: Bytes of words that one recursive query encodes.
STEP = 1 << 18

_NEIGHBOURS = """
    select word, pos, token, lag(pos) over w as back, lag(token) over w as before, lead(token) over w as after, lead(token, 2) over w as beyond
    from merging where not done window w as (partition by word order by pos)
"""
_RESULT = "select list(token order by pos) as ids from merging where done group by word order by word"
#: The vocabulary's bytes, in hexadecimal, joined in the order of the ids.
DECODE = "select doc, unhex(string_agg(hex, '' order by pos)) as decoded from given join vocabulary using (id) group by doc order by doc"
#: Each step contracts the leftmost lowest pair of each word.
MERGE = f"""
with recursive merging as (
    select word, pos, token, false as done from start
    union all
    select word, pos, case when pos = best & 4294967295 then best >> 32 else token end, best is null
    from (
        with near as materialized (
            select word, pos, token, lag(pos) over w as back, lead(token) over w as after
            from merging where not done window w as (partition by word order by pos)
        ), lowest as (
            select word, min((m << 32) | pos) as best from near join merges on pair = (token << 32) | after group by word
        )
        select near.*, best from near left join lowest using (word)
    )
    where back is null or best is null or back <> best & 4294967295
)
{_RESULT}
"""
#: Each step contracts the lowest pair of each word at place after place, while that makes no lower pair.
MERGE_LONG = f"""
with recursive merging as (
    select word, pos, token, false as done from start
    union all
    select word, pos, case when taken then best else token end, best is null
    from (
        select *, lag(taken) over (partition by word order by pos) as gone
        from (
            select *, coalesce(here and (run_at - min(case when here then run_at end) over (partition by word, run)) % 2 = 0 and pos <= coalesce(stop, pos), false) as taken
            from (
                select *, min(case when here and lower then pos end) over (partition by word) as stop,
                    row_number() over (partition by word order by pos) as run_at,
                    sum(case when here then 0 else 1 end) over (partition by word order by pos) as run
                from (
                    select n.*, coalesce(n.m = n.best, false) as here,
                        coalesce(l.m < n.best, false) or coalesce(r.m < n.best, false) or coalesce(b.m < n.best, false) as lower
                    from (
                        select *, min(m) over (partition by word) as best
                        from ({_NEIGHBOURS}) left join merges on pair = (token << 32) | after
                    ) n
                    left join merges l on l.pair = (n.before << 32) | n.best
                    left join merges r on r.pair = (n.best << 32) | n.beyond
                    left join merges b on b.pair = (n.best << 32) | n.best
                )
            )
        )
    )
    where not coalesce(gone, false)
)
{_RESULT}
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """All pairs of tokens whose concatenation is a token; that token's id is the pair's rank."""
    pairs: dict[str, list[int]] = {"l": [], "r": [], "m": []}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                for name, x in zip("lrm", (a, b, rank)):
                    pairs[name].append(x)
    return pairs


class Encoder:
    """A DuckDB session with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.pattern = regex.compile(pattern)
        self.sql.register("merges_in", pa.table({k: pa.array(v, pa.int64()) for k, v in merge_rows(ranks).items()}))
        self.sql.register("vocabulary_in", pa.table({"id": pa.array(ranks.values(), pa.int64()), "hex": pa.array([t.hex() for t in ranks], pa.string())}))
        self.sql.execute("create table merges as select (l << 32) | r as pair, m from merges_in")
        self.sql.execute("create table vocabulary as select id, hex from vocabulary_in")
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[bytes], query: str) -> Iterator[bytes]:
        """Ids of each word as 32-bit integers."""
        sizes = np.array([len(w) for w in words])
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(len(first)) - first).astype(np.int32), "token": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        self.sql.register("start", rows)
        ids = self.sql.sql(query).to_arrow_table().column("ids").combine_chunks()
        self.sql.unregister("start")
        cuts, data = (ids.offsets.to_numpy() * 4).tolist(), ids.values.to_numpy().astype(np.int32).tobytes()
        return (data[a:b] for a, b in zip(cuts, cuts[1:]))

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the words that are not known yet."""
        words = set(words)
        if len(self.ids) > CACHE:
            self.older, self.ids = self.ids, {}
        fresh = []
        for w in words - self.ids.keys():
            if w in self.older:
                self.ids[w] = self.older[w]
            else:
                fresh.append(w)
        coded = sorted(((w.encode(), w) for w in fresh), key=lambda x: len(x[0]))
        short = bisect_right(coded, SHORT, key=lambda x: len(x[0]))
        for query, some in ((MERGE, coded[:short]), (MERGE_LONG, coded[short:])):
            group: list[tuple[bytes, str]] = []
            size = 0
            for word in [*some, None]:
                if group and (word is None or size + len(word[0]) > STEP):
                    for (_, w), ids in zip(group, self._encode([w for w, _ in group], query)):
                        self.ids[w] = ids
                    group, size = [], 0
                if word is not None:
                    group.append(word)
                    size += len(word[0])

    def encode(self, chunk: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        split = [self.pattern.findall(t) for t in chunk]
        self.learn(chain.from_iterable(split))
        for words in split:
            yield np.frombuffer(b"".join(map(self.ids.__getitem__, words)), np.int32)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes that each list of ids stands for."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        doc, tokens = np.repeat(np.arange(len(ids)), sizes), pc.fill_null(ids.flatten().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        found: list[list[bytes]] = [[] for _ in range(len(ids))]
        for lo in range(0, len(tokens), TOKENS):  # a long text goes in pieces
            part = slice(lo, lo + TOKENS)
            self.sql.register("given", pa.table({"doc": doc[part], "pos": np.arange(len(tokens[part])), "id": tokens[part]}))
            for i, data in self.sql.sql(DECODE).fetchall():
                found[i].append(data)
            self.sql.unregister("given")
        return pa.array([b"".join(x) if there else None for there, x in zip(ids.is_valid().to_pylist(), found)], pa.binary())


_encoders: dict[tuple, Encoder] = {}


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def _run(shipped, pattern: str, decoded: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for ids, chunk in rows_of(batches, TEXT):
            made = list(encoder.encode([t.decode("utf-8", "replace") for t in chunk]))
            tokens = lists(np.cumsum([0, *map(len, made)]), np.concatenate([*made, np.zeros(0, np.int32)]))
            out = {"doc_id": pa.array(ids, pa.int64()), "ids": tokens}
            yield pa.RecordBatch.from_pydict(out | {"decoded": encoder.decode(tokens)} if decoded else out)

    return run


def _shipped(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array<int>), and if asked ``decoded`` (the bytes that these ids decode to).

    ``vocabulary`` is a file of base64 tokens and ranks that the driver reads and broadcasts (its size is that of a vocabulary, whatever
    the input's). Special tokens are ordinary text. Null and empty texts have no ids. Ids and rows may repeat, other columns are ignored. A very long
    text costs memory in proportion to its length in one task; a single very long word as many steps as it has merges of different ranks, at least.
    """
    schema = "doc_id long, ids array<int>" + (", decoded binary" if decoded else "")
    return texts(docs, text, doc_id).mapInArrow(_run(_shipped(docs, vocabulary), pattern, decoded), schema)


def decode(tokens: DataFrame, vocabulary: str, pattern: str = ".", ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``tokens``: doc_id, decoded (the bytes that its array of ids stands for).

    A null array stays null, an empty one gives no bytes, and so do a null id and one that the vocabulary lacks. Other columns are ignored.
    """
    shipped = _shipped(tokens, vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "decoded": encoder.decode(part.column("ids"))})

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
