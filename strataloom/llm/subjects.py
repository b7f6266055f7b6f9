"""Subject areas of documents: weighted terms, curated and learned, matched by an automaton; rarity, length, calibrated thresholds."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.llm import subject_terms
from strataloom.session import cut_lineage

#: Weight of a term that other subjects share; a term of a subject's own has 1.
SHARED_WEIGHT = 0.25
#: A term is worth at least this part of its weight, however common; matters in small corpora only.
LEAST_RARITY = 0.5
#: Labelled documents that terms, marks and thresholds are fitted on, taken by a hash of their key: half for the first two, half for thresholds.
MAX_LABELLED = 50_000
#: Words of a learned term or mark, documents or sentences that have it, and the lower bound (95 %) of the share of these that speaks for it.
MAX_WORDS, LEAST_SEEN, LEAST_SHARE = 3, 5, 0.7
#: Learned terms a subject, and marks of passing mentions, at most: the best backed.
MAX_LEARNED = 1_000
#: A mark of passing mentions stands beside at least so many subjects.
MARK_SUBJECTS = 3
#: Counters that a task keeps before it passes them on.
COUNTERS = 200_000
#: Thresholds without labels, or with fewer labels of a subject: least evidence, and least evidence a sentence.
DEFAULT_THRESHOLDS, LEAST_LABELS = (0.5, 0.12), 20
#: Confidence of lower bounds: 95 % on one side.
Z = 1.645

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NOT_WORD = re.compile(r"(?:[^\w\n]|_)+")
_SENTENCE = re.compile(r"(?<=[.?!…])\s+|[\r\n]+|</?(?:p|li|td|h\d|br|div)\b[^>]*>")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")


def _mend(m: re.Match) -> str:
    raw = m.group()
    try:
        return raw.encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return raw.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return raw


def plain(text: str) -> str:
    """Lower case words without accents, parted by single blanks, a line a sentence; names in code are split into their words."""
    text = _SENTENCE.sub("\n", _CAMEL.sub(" ", text)).lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("æ", "ae"))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return _NOT_WORD.sub(" ", text).strip()


def sentences_of(text: str | None) -> list[str]:
    """The sentences of a text as ``plain`` words; those without words are left out."""
    text = text or ""
    if not text.isascii():
        text = _MOJIBAKE.sub(_mend, text)
    return [s for line in plain(text).split("\n") if (s := line.strip())]


def _terms(text: str) -> list[str]:
    return [t for t in (plain(x) for x in text.replace("\n", " ").split(",")) if t]


@cache
def curated() -> tuple[tuple[str, str, float], ...]:
    """(term, subject, weight) of the curated terms."""
    rows = [(t, s, 1.0) for s, text in subject_terms.STRONG.items() for t in _terms(text)]
    strong = {(t, s) for t, s, _ in rows}
    rows += [(t, s, SHARED_WEIGHT) for s, text in subject_terms.SHARED.items() for t in _terms(text) if (t, s) not in strong]
    return tuple(dict.fromkeys(rows))


class Lexicon:
    """Weighted terms, (term, subject, weight) by place; a mark of passing mentions has no subject. One automaton finds them all."""

    def __init__(self, rows: Sequence[tuple[str, str, float]]) -> None:
        self.rows = list(rows)
        self._machine = None

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "_machine": None}

    def machine(self) -> object:
        """An automaton of the terms, each with its places; a term matches its plural as well."""
        if self._machine is None:
            import ahocorasick

            places: dict[str, list[int]] = {}
            for i, (term, _, _) in enumerate(self.rows):
                places.setdefault(term, []).append(i)
            self._machine = ahocorasick.Automaton()
            for term, where in places.items():
                self._machine.add_word(f" {term}", (len(term), where))
            self._machine.make_automaton()
        return self._machine

    def sentence_hits(self, sentence: str) -> list[int]:
        """Places of the terms of a plain sentence; of overlapping terms of a subject the longest."""
        padded = f" {sentence} "
        found: list[tuple[int, int, int]] = []
        for end, (length, where) in self.machine().iter(padded):
            if padded[end + 1] == " " or padded[end + 1 : end + 4].split(" ", 1)[0] in _ENDINGS:
                found += [(end - length + 1, -end, i) for i in where]
        if len(found) < 2:
            return [i for _, _, i in found]
        keep, reach = [], {}
        for _, end, i in sorted(found):
            subject = self.rows[i][1]
            if -end > reach.get(subject, -1):
                reach[subject] = -end
                keep.append(i)
        return keep

    def document_hits(self, text: str | None) -> tuple[int, list[list[int]]]:
        """(sentences, the hits of each sentence that has any); a sentence with a mark mentions its subject in passing and has none."""
        lines = sentences_of(text)
        hits = [h for line in lines if (h := self.sentence_hits(line)) and not any(self.rows[i][1] == "" for i in h)]
        return len(lines), hits


_ENDINGS = ("s", "es", "n", "en")


def _grams(sentence: str, least: int = 1, most: int = MAX_WORDS) -> set[str]:
    """Runs of ``least`` to ``most`` words of letters; a single word has at least four."""
    words = sentence.split()
    out = set()
    for i in range(len(words)):
        for j in range(i, min(i + most, len(words))):
            if not words[j].isalpha():
                break
            if j - i + 1 >= least and (j > i or len(words[i]) > 3):
                out.add(" ".join(words[i : j + 1]))
    return out


def _counted(df: DataFrame, fn) -> DataFrame:
    """(gram, subject, n): the sums of what ``fn`` counts in the rows of ``df``, added up in the tasks first."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(g, s, n) for (g, s), n in counts.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                counts.update(fn(*row))
            if len(counts) > COUNTERS:
                yield flush()
        yield flush()

    return df.mapInArrow(run, schema).groupBy("gram", "subject").agg(F.sum("n").alias("n"))


def _bound(k: Column, n: Column) -> Column:
    """Lower bound of a share k / n (Wilson)."""
    share = k / n
    return (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)


def learned_terms(labelled: DataFrame) -> list[tuple[str, str, float]]:
    """(term, subject, weight) of word runs that tell a subject in ``labelled`` (text, subjects), weighted by the bound of their share.

    At most ``MAX_LEARNED`` a subject.
    """

    def count(text: str, subjects: list[str]) -> list[tuple[str, str]]:
        grams = set().union(*map(_grams, sentences_of(text)))
        return [(g, s) for g in grams for s in ["", *subjects]]

    counts = _counted(labelled.select("text", "subjects"), count)
    whole = counts.filter("subject = ''").select("gram", F.col("n").alias("_all")).filter(F.col("_all") >= LEAST_SEEN)
    rated = counts.filter("subject <> ''").join(whole, "gram").withColumn("weight", _bound(F.col("n"), F.col("_all"))).filter(F.col("weight") >= LEAST_SHARE)
    best = Window.partitionBy("subject").orderBy(F.desc("n"), "gram")
    top = rated.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= MAX_LEARNED).orderBy("subject", "gram").collect()
    return [(r.gram, r.subject, r.weight) for r in top]


def learned_marks(labelled: DataFrame, lexicon: Lexicon) -> list[str]:
    """Word runs of sentences that mention a subject in passing: those whose subject mostly isn't one of the document's, whatever it is.

    ``labelled``: text, subjects. At most ``MAX_LEARNED``.
    """
    rows = lexicon.rows

    def count(text: str, subjects: list[str]) -> list[tuple[str, str]]:
        out = []
        for line in sentences_of(text):
            if hits := lexicon.sentence_hits(line):
                subject = rows[max(hits, key=lambda i: (rows[i][2], rows[i][1]))][1]
                out += [(g, "" if subject in subjects else subject) for g in _grams(line, 2)]
        return out

    each = _counted(labelled.select("text", "subjects"), count)
    passing = F.col("subject") != ""
    rated = each.groupBy("gram").agg(F.sum("n").alias("_all"), F.sum(F.when(passing, F.col("n")).otherwise(0)).alias("n"), F.sum(passing.cast("int")).alias("subjects"))
    kept = rated.filter((F.col("_all") >= LEAST_SEEN) & (F.col("subjects") >= MARK_SUBJECTS) & (_bound(F.col("n"), F.col("_all")) >= LEAST_SHARE))
    return sorted(r.gram for r in kept.orderBy(F.desc("n"), "gram").limit(MAX_LEARNED).collect())


def labelled_sample(labels: DataFrame, key: str) -> DataFrame:
    """(``key``, subjects, half) of at most ``MAX_LABELLED`` labelled documents; subjects outside the lexicon say that none applies."""
    known = labels.select(key, "subject").dropna().groupBy(key).agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    hashed = known.withColumn("_h", F.xxhash64(key)).orderBy("_h", key).limit(MAX_LABELLED)
    listed = F.array(*map(F.lit, subject_terms.STRONG))
    return hashed.select(key, F.array_intersect("subjects", listed).alias("subjects"), F.pmod(F.col("_h"), F.lit(2)).alias("half"))


def learn(df: DataFrame, key: str, text: str, sample: DataFrame | None) -> Lexicon:
    """The curated terms, and what the first half of the labelled ``sample`` teaches: further terms, and marks of passing mentions."""
    if sample is None:
        return Lexicon(curated())
    fit = df.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample.filter("half = 0").withColumnRenamed(key, "_key")), "_key").select("text", "subjects")
    fit = cut_lineage(fit)
    weights = {(t, s): w for t, s, w in curated()} | {(t, s): w for t, s, w in shortest(learned_terms(fit), curated())}
    terms = [(t, s, w) for (t, s), w in weights.items()]
    return Lexicon([*terms, *((m, "", 0.0) for m in shortest_marks(learned_marks(fit, Lexicon(terms))))])


def _inner(gram: str) -> Iterator[str]:
    """The shorter runs of words within a gram."""
    words = gram.split()
    return (" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words))


def shortest(learned: Sequence[tuple[str, str, float]], known: Sequence[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """``learned`` terms that say more than the terms within them: longer runs around a term that is worth as much are left out."""
    worth = {(t, s): w for t, s, w in known}
    out = []
    for t, s, w in sorted(learned, key=lambda x: (x[0].count(" "), x[0], x[1])):
        if w > max([worth.get((t, s), 0.0), *(1.1 * worth.get((g, s), 0.0) for g in _inner(t))]):
            worth[t, s] = w
            out.append((t, s, w))
    return out


def shortest_marks(marks: Sequence[str]) -> list[str]:
    """Marks without those that hold another one."""
    kept: set[str] = set()
    for m in sorted(marks, key=lambda m: (m.count(" "), m)):
        if not any(g in kept for g in _inner(m)):
            kept.add(m)
    return sorted(kept)


def match_terms(df: DataFrame, key: str, text: str, lexicon: Lexicon) -> DataFrame:
    """(``key``, length, sentences): of each document the number of its sentences, and the places hit in each that has hits; whole texts."""
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = T.StructType([slim.schema["_key"], T.StructField("length", T.IntegerType()), T.StructField("sentences", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [lexicon.document_hits(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(target.field(0).type), pa.array([n for n, _ in rows], target.field(1).type), pa.array([h for _, h in rows], target.field(2).type)], schema=target)

    return slim.mapInArrow(run, schema).withColumnRenamed("_key", key)


def rarity(matched: DataFrame) -> DataFrame:
    """(place, rarity): ln(1 + N / df) of each term over all documents that hit any, scaled to 1 for a term in 1 % of them."""
    total = matched.agg(F.count(F.lit(1))).scalar()
    df = matched.select(F.explode(F.array_distinct(F.flatten("sentences"))).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("df"))
    return df.select("place", (F.log1p(total / F.col("df")) / F.log1p(F.lit(100.0))).alias("rarity"))


def worths(rare: DataFrame, lexicon: Lexicon) -> list[float]:
    """What each place of the lexicon is worth: weight times rarity. A number a term, whatever the corpus."""
    seen = {r.place: r.rarity for r in rare.collect()}
    return [w * max(LEAST_RARITY, min(1.0, seen.get(i, 1.0))) for i, (_, _, w) in enumerate(lexicon.rows)]


def weigh(sentences: list[list[int]], worth: list[float], rows: list[tuple]) -> dict[str, float]:
    """The evidence of each subject in a document: in each sentence its best term counts."""
    total: dict[str, float] = {}
    for hits in sentences:
        best: dict[str, float] = {}
        for i in hits:
            s = rows[i][1]
            best[s] = max(best.get(s, 0.0), worth[i])
        for s, w in best.items():
            total[s] = total.get(s, 0.0) + w
    return total


def evidence(matched: DataFrame, key: str, worth: list[float], lexicon: Lexicon) -> DataFrame:
    """(``key``, subject, evidence, density) of each row and subject, without a shuffle.

    Normalized by length as density, the evidence a sentence of the document.
    """
    schema = T.StructType([matched.schema[key], T.StructField("subject", T.StringType()), T.StructField("evidence", T.DoubleType()), T.StructField("density", T.DoubleType())])
    terms = lexicon.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows: list[tuple] = []
            for k, length, sentences in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows += [(k, s, e, e / length) for s, e in weigh(sentences, worth, terms).items() if e > 0]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return matched.select(key, "length", "sentences").mapInArrow(run, schema)


#: Steps of the grids of thresholds, and their number.
STEP_E, STEPS_E, STEP_D, STEPS_D = 0.1, 31, 0.01, 51


def _best(cells: list[tuple[int, int, int, int]]) -> tuple[float, float] | None:
    """The (evidence, density) thresholds of the best F1 over cells (e, d, good, n); amid equals the middle one. None without any good."""
    total = sum(c[2] for c in cells)
    if not total:
        return None
    good, every = np.zeros((STEPS_E, STEPS_D)), np.zeros((STEPS_E, STEPS_D))
    for e, d, g, n in cells:
        good[e, d] += g
        every[e, d] += n
    above = lambda x: x[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]
    f1 = np.round(2 * above(good) / (above(every) + total), 9)[1:, :]
    places = np.argwhere(f1 == f1.max())
    e, d = places[len(places) // 2]
    return round(int(e + 1) * STEP_E, 6), round(int(d) * STEP_D, 6)


def calibrate(scored: DataFrame, sample: DataFrame, key: str) -> dict[str, tuple[float, float]]:
    """The (evidence, density) thresholds of each subject, of the best F1 on the ``sample`` (``key``, subjects) of labelled documents.

    ``scored`` holds the sample's documents only.
    Subjects of fewer than ``LEAST_LABELS`` labels take the thresholds that are best for all together.
    """
    truth = sample.select(key, F.explode("subjects").alias("subject")).withColumn("truth", F.lit(1))
    rows = scored.join(truth, [key, "subject"], "full")
    step = lambda c, size, most: F.least(F.floor(F.coalesce(c, F.lit(0.0)) / size + 1e-9), F.lit(most - 1))
    cell = rows.select("subject", step("evidence", STEP_E, STEPS_E).alias("e"), step("density", STEP_D, STEPS_D).alias("d"), F.coalesce("truth", F.lit(0)).alias("truth"))
    cells = cell.groupBy("subject", "e", "d").agg(F.sum("truth").alias("good"), F.count(F.lit(1)).alias("n")).collect()
    # a full join may name a subject in no text, so a cell of no evidence is a miss and never chosen
    pooled = _best([(c.e, c.d, c.good, c.n) for c in cells]) or DEFAULT_THRESHOLDS
    out = {}
    for subject in subject_terms.STRONG:
        own = [(c.e, c.d, c.good, c.n) for c in cells if c.subject == subject]
        out[subject] = (_best(own) or pooled) if sum(c[2] for c in own) >= LEAST_LABELS else pooled
    return out


def assign(df: DataFrame, key: str, text: str, labels: DataFrame | None = None) -> DataFrame:
    """(``key``, subject, evidence, density) of every subject whose evidence and density reach the subject's thresholds.

    ``labels``: ``key``, subject; half of a bounded sample teaches further terms and the marks of
    passing mentions, the other half the thresholds; without labels there are the curated terms and
    ``DEFAULT_THRESHOLDS``. NULL, empty and blank texts and texts without subject terms give no
    rows. Rows that repeat a key are judged each on its own, and the greatest evidence of each
    subject is given once.
    """
    sample = cut_lineage(labelled_sample(labels, key)) if labels is not None else None
    lexicon = learn(df, key, text, sample)
    matched = cut_lineage(match_terms(df.filter(F.col(text).isNotNull()), key, text, lexicon).filter(F.size("sentences") > 0))
    worth = worths(rarity(matched), lexicon)
    scored = evidence(matched, key, worth, lexicon)
    least = dict.fromkeys(subject_terms.STRONG, DEFAULT_THRESHOLDS)
    if sample is not None:
        held = sample.filter("half = 1")
        least = calibrate(evidence(matched.join(F.broadcast(held.select(key)), key, "left_semi"), key, worth, lexicon), held, key)
    limit = lambda i: F.coalesce(*[F.when(F.col("subject") == s, F.lit(t[i])) for s, t in least.items()])
    return scored.filter((F.col("evidence") >= limit(0) - 1e-9) & (F.col("density") >= limit(1) - 1e-9)).groupBy(key, "subject").agg(F.max("evidence").alias("evidence"), F.max("density").alias("density"))
