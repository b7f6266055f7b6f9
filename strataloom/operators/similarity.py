"""Similarity of texts and vectors by weights of their words, and of dense vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.session import by_slices, cut_lineage, release

#: Weights of the vectors that are compared before the next slice of blocks, about.
SLICE_WEIGHTS = 20_000_000
#: Up to so many bytes of tokens and counts, those of all documents are sent to every executor as arrays; the result is the same.
ARRAY_BYTES = 250_000_000
#: Axes of the space that bounds similarities, the tokens and documents it is chosen by, and documents compared at a time. Of these nothing but speed depends.
AXES, AXES_TOKENS, AXES_DOCUMENTS, COMPARED = 256, 2_048, 8_000, 2_048
#: Documents of a token that one unit of work compares with all others of it.
UNIT_DOCUMENTS = 16_384


def tfidf(tokens: DataFrame, key: str, documents: int | Column | None = None, max_share: float = 0.3) -> DataFrame:
    """(``key``, token, weight, df): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document of length 1.

    ``tokens``: ``key``, token, a row an occurrence. Tokens of one document only, and those of more
    than ``max_share`` of all (two at least), are left out.
    """
    tf = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    n = F.lit(documents) if documents is not None else tokens.select(key).distinct().agg(F.count(F.lit(1))).scalar()
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") > 1) & (F.col("df") <= F.greatest(F.lit(2), F.floor(n * max_share))))
    raw = tf.join(df, "token").withColumn("_w", (1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return raw.join(norm, key).select(key, "token", (F.col("_w") / F.col("_norm")).alias("weight"), "df")


def cosine_pairs(weights: DataFrame, key: str, least: float, block: int = 512) -> DataFrame:
    """(a, b, similarity), a < b, of all documents that share a token and are at least ``least`` alike.

    ``weights``: as of :func:`tfidf`, each document of length 1 (or less), ``least`` above 0. Prefix
    filtering, which is exact: tokens are in order of their documents, the rarest first. What a
    document has from its first token on that leaves less than ``least`` of its length can't make a
    pair alone, so the rarest token that a pair shares is before that place in both. Documents with
    such a token are compared in blocks: those of rare tokens together, those of a token with more
    than ``block`` of them in pairs of salted chunks, so that no task grows with a token.
    """
    slack = least - 1e-6  # similarities are rounded to 6 places
    onward = Window.partitionBy(key).orderBy(F.col("df").desc(), F.col("token").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = weights.withColumn("_left", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(onward))).filter(F.col("_left") >= slack).select(key, "token")
    postings = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    bins = postings.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("_n") <= block, F.col("_n"))) / block))).scalar()
    placed = cut_lineage(prefix.join(postings, "token"))
    light = placed.filter(F.col("_n") <= block).select(key, F.lit("").alias("_token"), F.pmod(F.xxhash64("token"), F.coalesce(bins, F.lit(1))).alias("_low"), F.lit(-1).cast("bigint").alias("_high"), F.lit(-1).cast("bigint").alias("_chunk")).distinct()
    chunks = F.ceil(F.col("_n") / block)
    heavy = placed.filter(F.col("_n") > block).withColumn("_chunk", F.pmod(F.xxhash64(key), chunks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
    heavy = heavy.select(key, F.col("token").alias("_token"), F.least("_chunk", "_other").alias("_low"), F.greatest("_chunk", "_other").alias("_high"), "_chunk")
    blocks = light.unionByName(heavy)
    # what a document is compared in: bins of rare tokens first, then frequent tokens; a pair counts in the first that its documents share
    name = lambda token, low: F.when(token == "", F.concat(F.lit("\u0000"), F.lpad(low.cast("string"), 20, "0"))).otherwise(token)
    shared = light.select(key, name(F.col("_token"), F.col("_low")).alias("_g")).unionByName(placed.filter(F.col("_n") > block).select(key, F.col("token").alias("_g")))
    vectors = weights.join(placed.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.collect_list(F.struct("token", "weight")).alias("_v")).select(key, F.col("_v.token").alias("_tokens"), F.col("_v.weight").alias("_weights"))
    vectors = cut_lineage(vectors.join(shared.groupBy(key).agg(F.collect_list("_g").alias("_shared")), key))
    size = blocks.join(vectors.select(key, F.size("_tokens").alias("_s")), key).agg(F.sum("_s")).first()[0] or 0
    kind = weights.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])

    def compare(rows: pa.Table) -> pa.Table:
        i, j, found = alike(rows, slack)
        first = first_shared(rows, i, j)
        i, j, found = i[first], j[first], found[first]
        ids = rows[key].combine_chunks()
        return pa.table({"a": ids.take(pa.array(i)), "b": ids.take(pa.array(j)), "similarity": pa.array(found)})

    met = lambda part: part.join(vectors, key).groupBy("_token", "_low", "_high").applyInArrow(compare, schema).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("similarity", 6).alias("similarity")).filter(F.col("similarity") >= least)
    # each pair comes from one block, so blocks are compared slice by slice
    return by_slices(blocks.withColumn("_block", F.xxhash64("_token", "_low", "_high")), "_block", size // SLICE_WEIGHTS + 1, met)


def alike_documents(documents: DataFrame, key: str, tokens: str, least: float, max_share: float = 0.3) -> DataFrame:
    """(a, b, similarity), a < b: what :func:`cosine_pairs` finds with the weights of :func:`tfidf`, of ``documents`` (``key``, ``tokens``: an array of strings).

    The tokens of all documents, numbered from the rarest on, are sent to every executor as arrays;
    no vector is shuffled. Documents that have a token before the place after which less than
    ``least`` is left are compared: products of matrices give an upper bound of their similarity
    (their part in a space of few axes, and the lengths of what is beside it), pairs that it lets
    through are computed whole, each with the rarest token that it shares. Documents whose tokens
    are too large for arrays (``ARRAY_BYTES``) or whose keys are not distinct go by ``cosine_pairs``.
    """
    spark, kind = documents.sparkSession, documents.schema[key].dataType
    known = _numbered(documents.select(F.col(key).alias("key"), F.array_compact(tokens).alias("tokens")), least - 1e-6, max_share)
    if known is None:
        return cosine_pairs(tfidf(documents.select(key, F.explode(tokens).alias("token")), key, max_share=max_share), key, least)
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("similarity", T.DoubleType())])
    if not len(known["post"]):
        return spark.createDataFrame([], schema)
    sizes = np.diff(known["begin"])
    units = np.array([(t, k, sizes[t] * min(sizes[t], UNIT_DOCUMENTS)) for t in np.flatnonzero(sizes > 1) for k in range(0, sizes[t], UNIT_DOCUMENTS)], dtype="i8").reshape(-1, 3)
    known |= {"unit": UNIT_DOCUMENTS, "compared": COMPARED}
    known["units"] = units[np.argsort(-units[:, 2], kind="stable"), :2]
    sent, tasks = spark.sparkContext.broadcast(known), int(max(1, min(len(units), 1 + units[:, 2].sum() // 5_000_000, 600)))
    ids = known.pop("ids")
    del known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for token, first in table["units"][task::tasks]:
                    for i, j, found in _alike_of_token(table, int(token), int(first)):
                        yield pa.RecordBatch.from_arrays([table["ids"].take(pa.array(i)), table["ids"].take(pa.array(j)), pa.array(found)], names=["a", "b", "similarity"])

    pairs = spark.range(0, tasks, 1, tasks).mapInArrow(run, T.StructType([T.StructField(f.name, _kind(ids.type) if f.name != "similarity" else f.dataType) for f in schema]))
    return pairs.select(F.least("a", "b").cast(kind).alias("a"), F.greatest("a", "b").cast(kind).alias("b"), F.round("similarity", 6).alias("similarity")).filter(F.col("similarity") >= least)


def _kind(kind: pa.DataType) -> T.DataType:
    return T.StringType() if pa.types.is_string(kind) or pa.types.is_large_string(kind) else T.LongType()


def _numbered(documents: DataFrame, slack: float, max_share: float) -> dict | None:
    """Arrays of all documents (key, tokens): their tokens' numbers from the rarest on with their counts, and a token's documents with its place in each; None if these are too large or keys not distinct, whole numbers or strings."""
    kind = documents.schema["key"].dataType
    if not isinstance(kind, T.StringType | T.LongType | T.IntegerType | T.ShortType):
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype("i8")
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            words = len(coded.dictionary)
            both, tf = np.unique(np.repeat(np.arange(len(size)), size) * words + coded.indices.to_numpy(), return_counts=True)
            row, code = both // words, both % words
            rows, counts = np.unique(row, return_counts=True)
            ids = batch.column(0).take(pa.array(rows))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [one(ids), one(coded.dictionary.cast(pa.string())), one(pa.array(np.bincount(code, minlength=words))), *(pa.array([x.astype(np.min_scalar_type(x.max())).tobytes()]) for x in (counts, code, tf)), pa.array([len(code)]), pa.array([int(tf.max())])],
                names=["ids", "words", "df", "counts", "codes", "tf", "n", "most"],
            )

    text = isinstance(kind, T.StringType)
    rows = documents.select(F.col("key").cast("string" if text else "long").alias("key"), "tokens").filter("tokens IS NOT NULL")
    packed = cut_lineage(rows.mapInArrow(pack, f"ids array<{'string' if text else 'bigint'}>, words array<string>, df array<bigint>, counts binary, codes binary, tf binary, n long, most long"))
    vocabulary = packed.select(F.explode(F.arrays_zip("words", "df")).alias("x")).groupBy(F.col("x.words").alias("token")).agg(F.sum("x.df").alias("df"))
    total, most = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("most"), F.lit(0))).first()
    if 3 * total > ARRAY_BYTES or vocabulary.filter("df > 1").count() > ARRAY_BYTES // 100:
        return None
    ids = packed.select(F.explode("ids").alias("id")).toArrow()["id"].combine_chunks()
    if ids.null_count or pc.count_distinct(ids).as_py() != len(ids):
        return None
    n = len(ids)
    words = vocabulary.filter((F.col("df") > 1) & (F.col("df") <= max(2, int(np.floor(n * max_share))))).toArrow()
    df = words["df"].to_numpy()
    order = np.lexsort((np.arange(len(df)), df))
    names, df = words["token"].combine_chunks().take(pa.array(order)).cast(pa.string()), df[order]
    number, counts = np.min_scalar_type(len(df) + 1), np.min_scalar_type(most)
    if (number.itemsize + counts.itemsize) * total > ARRAY_BYTES:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    log = np.zeros(most + 1)
    log[1:] = 1 + np.log(np.arange(1, most + 1))
    token, tf, length, norm = np.empty(total, number), np.empty(total, counts), np.empty(n, "i8"), np.empty(n)
    post, done, docs = [], 0, 0
    for r in packed.toLocalIterator():
        size, code, k = (np.frombuffer(x, f"u{len(x) // c}") for x, c in ((r["counts"], len(r["ids"])), (r["codes"], r["n"]), (r["tf"], r["n"])))
        place = pc.index_in(pa.array(r["words"], pa.string()), names).fill_null(-1).to_numpy()[code]
        row = np.repeat(np.arange(len(size)), size)[place >= 0]
        k, place = k[place >= 0], place[place >= 0]
        order = np.lexsort((place, row))
        row, k, place = row[order], k[order], place[order]
        w = log[k] * idf[place]
        size = np.bincount(row, minlength=len(size))
        own = np.sqrt(np.bincount(row, w * w, len(size)))
        w = w / own[row]
        first = np.r_[0, np.cumsum(size)[:-1]]
        upto = np.cumsum(w * w)
        before = upto - w * w - np.r_[0, upto][first][row]
        early = before <= 1 - slack * slack + 1e-9
        post.append((place[early].astype(number), (row[early] + docs).astype("i4"), (np.arange(len(row)) - first[row])[early].astype(np.min_scalar_type(size.max()))))
        token[done : done + len(row)], tf[done : done + len(row)] = place, k
        length[docs : docs + len(size)], norm[docs : docs + len(size)] = size, own
        done, docs = done + len(row), docs + len(size)
    del packed, vocabulary
    release(documents.sparkSession)
    of, doc, at = (np.concatenate(c) if post else np.empty(0, "i4") for c in (zip(*post, strict=True) if post else ((), (), ())))
    order = np.argsort(of, kind="stable")
    begin = np.r_[0, np.cumsum(np.bincount(of, minlength=len(df)))]
    known = {"ids": ids, "token": token[:done].copy(), "tf": tf[:done].copy(), "start": np.r_[0, np.cumsum(length)[:-1]], "length": length, "norm": norm, "idf": idf, "log": log, "post": doc[order], "place": at[order], "begin": begin, "slack": slack}
    return known | _axes(known)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): the places from ``start`` on, ``count`` of them, of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) + np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)


def _dense(known: dict, docs: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """The weights of ``docs`` as rows of a matrix, a token in its ``column`` (-1: none)."""
    row, place = _spread(known["start"][docs], known["length"][docs])
    token = known["token"][place]
    to = column[token]
    out = np.zeros((len(docs), width), "f4")
    w = known["log"][known["tf"][place]] * known["idf"][token] / known["norm"][docs][row]
    out[row[to >= 0], to[to >= 0]] = w[to >= 0]
    return out


def _axes(known: dict) -> dict:
    """column, axes: orthogonal axes that hold much of the documents' weights. Whatever they are, what :func:`_alike_of_token` finds is the same."""
    n, words = len(known["length"]), len(known["idf"])
    column, width = np.full(words, -1), min(words, AXES_TOKENS)
    docs = np.arange(0, n, n // AXES_DOCUMENTS + 1)
    row, place = _spread(known["start"][docs], known["length"][docs])
    token = known["token"][place]
    w = known["log"][known["tf"][place]] * known["idf"][token] / known["norm"][docs][row]
    column[np.argsort(-np.bincount(token, w * w, words), kind="stable")[:width]] = np.arange(width)
    products = np.zeros((width, width))
    for k in range(0, len(docs), 1_000):
        x = _dense(known, docs[k : k + 1_000], column, width)
        products += x.T @ x
    return {"column": column, "axes": np.ascontiguousarray(np.linalg.eigh(products)[1][:, ::-1][:, :AXES]).astype("f4") if width else np.zeros((0, 0), "f4")}


def _projected(known: dict, docs: np.ndarray) -> np.ndarray:
    """Rows whose products are at least the similarities of ``docs``: what the axes hold of each, and the length of the rest."""
    axes, out = known["axes"], np.empty((len(docs), known["axes"].shape[1] + 1), "f4")
    for k in range(0, len(docs), 512):
        x = _dense(known, docs[k : k + 512], known["column"], len(axes)) @ axes
        out[k : k + 512, :-1] = x
        out[k : k + 512, -1] = np.sqrt(np.maximum(0, 1 - (x.astype("f8") ** 2).sum(1)) + 2e-6)
    return out


def _alike_of_token(known: dict, token: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of alike documents of ``token`` that share no rarer one, i of the unit from ``first`` on, and j before i."""
    own = slice(known["begin"][token], known["begin"][token + 1])
    docs, place = known["post"][own], known["place"][own].astype("i8")
    end, step = min(len(docs), first + known["unit"]), known["compared"]
    bounded = end > 32
    left = _projected(known, docs[first:end]) if bounded else None
    for low in range(0, end, step):
        high = min(end, low + step)
        right = (left[low - first : high - first] if low >= first else _projected(known, docs[low:high])) if bounded else None
        for k in range(max(first, low // step * step), end, step):
            top = min(end, k + step)
            if bounded:
                i, j = np.nonzero(left[k - first : top - first] @ right.T >= known["slack"] - 1e-4)
            else:
                i, j = (x.ravel() for x in np.indices((top - k, high - low)))
            i, j = i + k, j + low
            i, j = i[j < i], j[j < i]
            if len(i):
                yield from _whole(known, docs, place, i, j)


def _whole(known: dict, docs: np.ndarray, place: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Those of the pairs of places ``i`` (in order) and ``j`` in ``docs`` that share no token before ``place`` and are alike."""
    words = len(known["idf"])
    who, row = np.unique(i, return_inverse=True)
    rows = max(1, 1_500_000 // words)
    table = np.zeros(min(rows, len(who)) * words)
    for begin in range(0, len(who), rows):
        mine = docs[who[begin : begin + rows]]
        at, p = _spread(known["start"][mine], known["length"][mine])
        token = known["token"][p]
        filled = at * words + token
        table[filled] = known["log"][known["tf"][p]] * known["idf"][token] ** 2 / known["norm"][mine][at]
        a, b = np.searchsorted(row, [begin, begin + rows])
        for k in range(a, b, 20_000):
            x, y = row[k : min(b, k + 20_000)] - begin, j[k : min(b, k + 20_000)]
            pair, p = _spread(known["start"][docs[y]], place[y])
            rarer = np.zeros(len(y), bool)
            rarer[pair[table[x[pair] * words + known["token"][p]] > 0]] = True
            x, y = x[~rarer], y[~rarer]
            if not len(y):
                continue
            length = known["length"][docs[y]]
            pair, p = _spread(known["start"][docs[y]], length)
            found = np.add.reduceat(table[x[pair] * words + known["token"][p]] * known["log"][known["tf"][p]], np.r_[0, np.cumsum(length)[:-1]]) / known["norm"][docs[y]]
            near = found >= known["slack"]
            if near.any():
                yield mine[x[near]], docs[y[near]], found[near]
        table[filled] = 0


def first_shared(rows: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether this block is the first that the rows ``i`` and ``j`` share."""
    token, low = rows["_token"][0].as_py(), rows["_low"][0].as_py()
    here = token or "\0" + str(low).zfill(20)
    earlier = [{g for g in x if g < here} for x in rows["_shared"].to_pylist()]
    return np.array([earlier[x].isdisjoint(earlier[y]) for x, y in zip(i, j, strict=True)], dtype=bool)


def alike(rows: pa.Table, least: float, columns: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the rows (_low, _high, _chunk, _tokens, _weights) of a block that are at least ``least`` alike: of the low chunk with the high one, or all with all.

    Products are summed over ``columns`` tokens at a time, so memory doesn't grow with the vocabulary.
    """
    lists = rows["_tokens"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    size, token, weight = pc.list_value_length(lists).to_numpy(), coded.indices.to_numpy(), rows["_weights"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    low, high, chunk = (rows[c].to_numpy() for c in ("_low", "_high", "_chunk"))
    whole = high[0] < 0 or low[0] == high[0]
    left, right = (np.arange(len(size)),) * 2 if whole else (np.flatnonzero(chunk == low[0]), np.flatnonzero(chunk == high[0]))
    in_left, in_right = np.isin(row, left), np.isin(row, right)
    shared = np.intersect1d(token[in_left], token[in_right])
    place, at = np.full(len(coded.dictionary), -1), np.empty(len(size), dtype=int)
    place[shared] = np.arange(len(shared))

    def matrix(side: np.ndarray, inside: np.ndarray, begin: int) -> np.ndarray:
        at[side] = np.arange(len(side))
        col = place[token] - begin
        use = inside & (col >= 0) & (col < columns)
        out = np.zeros((len(side), min(columns, len(shared) - begin)))
        out[at[row[use]], col[use]] = weight[use]
        return out

    total = np.zeros((len(left), len(right)))
    for begin in range(0, len(shared), columns):
        x = matrix(left, in_left, begin)
        total += x @ (x if whole else matrix(right, in_right, begin)).T
    i, j = np.nonzero((np.triu(total, 1) if whole else total) >= least)
    return left[i], right[j], total[i, j]


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, rank, ``key``, similarity): the ``k`` vectors most alike to each query by cosine, itself excepted; all vectors are compared.

    ``queries`` is a stated set and small against the vectors, which are read once; each part of
    them keeps its best ``k`` before these are brought together.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    unit = lambda df: df.withColumn("_n", F.sqrt(dot(F.col(vector), F.col(vector))))
    q = unit(queries).select(F.col(key).alias("query"), F.col(vector).alias("_q"), F.col("_n").alias("_qn"), F.lit(1).alias("_one"))
    base = unit(vectors).select(key, F.col(vector).alias("_v"), F.col("_n").alias("_vn"), F.lit(1).alias("_one"))
    scored = base.join(F.broadcast(q), "_one").filter(F.col("query") != F.col(key)).select("query", key, F.round(F.try_divide(dot(F.col("_v"), F.col("_q")), F.col("_vn") * F.col("_qn")), 6).alias("similarity"))
    order = [F.col("similarity").desc(), F.col(key).asc()]
    part = Window.partitionBy("query", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(*order)
    kept = scored.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query", "rank", key, "similarity")
