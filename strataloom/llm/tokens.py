"""Byte-level BPE encoding of whole corpora, contracted by recursive DuckDB queries in each partition."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Splits a text into the words that are encoded one by one (the published pattern of this vocabulary).
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Words of more bytes are contracted with a heap, as a query would take a round for each of their pairs.
LONG = 400
#: Encoded words that a worker keeps.
KEPT = 300_000
#: Texts and characters of a query's batch.
BATCH, BATCH_CHARS = 2_000, 4_000_000

_ROUNDS = """
WITH RECURSIVE token(word, pos, id, round) AS (
  SELECT word, pos, id, 0 FROM fresh
  UNION ALL
  SELECT word, pos, CASE WHEN starts THEN merged ELSE id END, round + 1
  FROM (
    SELECT *, coalesce(lag(starts) OVER (PARTITION BY word ORDER BY pos), FALSE) AS swallowed
    FROM (
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, hit, run ORDER BY pos)) % 2 = 1 AS starts
      FROM (
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS run
        FROM (
          SELECT *, coalesce(rank = best, FALSE) AS hit
          FROM (
            SELECT p.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY p.word) AS best
            FROM (SELECT *, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next FROM token) p
            LEFT JOIN merge m ON m.a = p.id AND m.b = p.next
          )
          WHERE best IS NOT NULL
        )
      )
    )
  )
  WHERE NOT swallowed
)
SELECT word, list(id ORDER BY pos) AS ids
FROM (SELECT * FROM token QUALIFY round = max(round) OVER (PARTITION BY word))
GROUP BY word
"""

_TEXTS = """
SELECT t.text AS text, flatten(list(w.ids ORDER BY t.pos)) AS ids
FROM place t JOIN encoded w ON w.word = t.word GROUP BY t.text
"""


@cache
def vocabulary(path: str) -> tuple[list[int], dict[tuple[int, int], tuple[int, int]]]:
    """(id of each byte, {(a, b): (rank, merged)}) of a tokenizer file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    # the file writes a byte that is no printable character as the next free character from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return [ids[letter[b]] for b in range(256)], {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}


def contract_long(tokens: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The same contraction of one long word with a heap: always the leftmost pair of the least rank."""
    n = len(tokens)
    ids, left, right = list(tokens), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (m := merges.get((ids[i], ids[j]))):
            heapq.heappush(heap, (m[0], i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if not alive[i] or ids[i] != a or right[i] >= n or ids[right[i]] != b:
            continue
        j = right[i]
        ids[i] = merges[a, b][1]
        alive[j] = False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [t for t, x in zip(ids, alive, strict=True) if x]


class Encoder:
    """Encodes texts of one process; keeps a DuckDB database with the merge table and the words it has met."""

    def __init__(self, path: str) -> None:
        import duckdb

        self.bytes, self.merges = vocabulary(path)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
        table = pa.table({"a": [p[0] for p in self.merges], "b": [p[1] for p in self.merges], "rank": [m[0] for m in self.merges.values()], "merged": [m[1] for m in self.merges.values()]}, schema=pa.schema([(c, pa.int32()) for c in ("a", "b", "rank", "merged")]))
        self.db.register("merge_rows", table)
        self.db.execute("CREATE TABLE merge AS SELECT * FROM merge_rows")
        self.db.execute("CREATE TABLE encoded (word INTEGER, ids INTEGER[])")
        self.known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        """Adds words to the table of encoded ones; their numbers are already in ``known``."""
        word, pos, token = [], [], []
        long_words, long_ids = [], []
        for w in words:
            number, data = self.known[w], w.encode()
            tokens = [self.bytes[b] for b in data]
            if len(data) > LONG:
                long_words.append(number)
                long_ids.append(contract_long(tokens, self.merges))
            else:
                word += [number] * len(tokens)
                pos += range(len(tokens))
                token += tokens
        if word:
            self.db.register("fresh", pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array(token, pa.int32())}))
            self.db.execute("INSERT INTO encoded " + _ROUNDS)
            self.db.unregister("fresh")
        if long_words:
            self.db.register("long_rows", pa.table({"word": pa.array(long_words, pa.int32()), "ids": pa.array(long_ids, pa.list_(pa.int32()))}))
            self.db.execute("INSERT INTO encoded SELECT * FROM long_rows")
            self.db.unregister("long_rows")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; NULL and empty texts have none."""
        if len(self.known) > KEPT:
            self.known.clear()
            self.db.execute("DELETE FROM encoded")
        text, pos, word = [], [], []
        new: list[str] = []
        known = self.known
        for i, t in enumerate(texts):
            if not t:
                continue
            words = WORDS.findall(t)
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    new.append(w)
            text += [i] * len(words)
            pos += range(len(words))
            word += [known[w] for w in words]
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        out: list[list[int]] = [[] for _ in texts]
        if text:
            self.db.register("place", pa.table({"text": pa.array(text, pa.int32()), "pos": pa.array(pos, pa.int32()), "word": pa.array(word, pa.int32())}))
            rows = self.db.execute(_TEXTS).fetchall()
            self.db.unregister("place")
            for i, ids in rows:
                out[i] = ids
        return out


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    key = (os.getpid(), path)
    if key not in _encoders:
        _encoders[key] = Encoder(path)
    return _encoders[key]


def encode(df: DataFrame, text: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with ``ids``, the tokens of the column ``text`` (ARRAY<INT>) by a byte-level BPE tokenizer, without special tokens.

    Strings that look like special tokens are ordinary text; NULL and empty texts give an empty
    list; blank texts are encoded like any other. Texts are never cut. Other columns go along; an
    existing column ``ids`` is replaced. The tokenizer's file must be at the same path on all
    executors.
    """
    kept = df.drop(ids)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    path = os.path.join(folder, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(text)
            start = 0
            while start < batch.num_rows:
                end, chars = start, 0
                taken: list[str | None] = []
                while end < batch.num_rows and len(taken) < BATCH and chars < BATCH_CHARS:
                    taken.append(texts[end].as_py())
                    chars += len(taken[-1] or "")
                    end += 1
                part = batch.slice(start, end - start)
                columns = [c.cast(f.type) for c, f in zip(part.columns, target, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(enc.encode(taken), target.field(len(columns)).type)], schema=target)
                start = end

    return kept.mapInArrow(run, schema)
