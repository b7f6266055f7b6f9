"""Personal information in free text: seed entities, patterns around them, and entities that only the patterns find."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import lookup_join
from strataloom.session import cut_lineage

KINDS = ["email", "phone", "idnum", "address", "name"]
#: What stands in a text for what was found.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: A pattern needs so many different instances, and a lower bound of the share of them that is known. Most formats
#: of numbers are known by no shape, so a quarter is enough for them; words that begin a sentence are mostly no names.
LEAST_INSTANCES, LEAST_SHARE = 4, {"name": 0.5, "phone": 0.25, "idnum": 0.25, "single": 0.1}
#: A word that stands before the comma of "Word, Name" in so many candidates, and in so many times those where it is a family name, is a greeting.
GREETED = 4
#: Confidence of the lower bound: 95 % on one side.
Z = 1.645
#: Rows of the counters that a task keeps before it passes them on.
COUNTERS = 100_000

# --- shapes (fixed values: formats of addresses, numbers and labels) ---------------------------------------------

_AT = r"(?:\s?[@＠]\s?|\s?[(\[{<]\s?(?:at|AT|ät|arroba)\s?[)\]}>]\s?)"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|punkt|punto|point)\s?[)\]}]\s?)"
_SPELT = r"[\w][\w.+%-]{1,63} (?:at|ät|arroba) [A-Za-z][\w-]+(?: (?:dot|punkt|punto|point) [A-Za-z][\w-]*)+\b"
EMAIL = re.compile(rf"{_SPELT}|(?:mailto:)?(?<![\w.+/@-])[\w][\w.+%'-]{{0,63}}(?<![.+-]){_AT}[A-Za-z][\w-]*(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,24}}(?![\w@])(?!:[\w~/]|/)")
_MAIL_MARK = re.compile(r"\w\s?(?:[@＠]|[(\[{<]\s?(?:at|AT|ät|arroba)\s?[)\]}>])\s?[A-Za-z][\w-]*\s?[.(\[{]|\w (?:at|ät|arroba) \w[\w-]* (?:dot|punkt|punto|point) \w")
#: Remotes of repositories are no addresses of people.
_REMOTE = re.compile(r"(?<![\w.+-])git@")

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_TAIL = (
    r"(?:,? (?:Apt|Flat|Suite|Unit|Apartment|Floor|Wohnung|Appt|piso)\.? ?\w+)?"
    rf"(?:\s*,\s*(?:\d{{1,3}}\s?[ºª]\s?\w\b|(?:[A-Z]{{1,2}}-)?\d{{4,6}} {_CAP}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]? ?\d[A-Z]{{2}}\b|[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?\b|{_CAP}(?= *,| *$|\.| *\n)|{_CAP}(?! [A-ZÀ-Þ])))*"
)
_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Crescent|Cres|Close|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Ter|Boulevard|Blvd|Parkway|Pkwy|Hill|Gardens|Grove|Row|Walk|Mews|Highway|Hwy|Circle|Cir|Trail|Quay)"
ADDRESS = re.compile(
    "(?:"
    + "|".join(
        [
            r"(?:P\.?\s?O\.?\s?Box|Post Office Box|Postfach|Apartado(?: de correos)?|Boîte postale|Casella postale|Postbus)\s?\d[\d ]{0,8}\b",
            rf"(?:(?:Flat|Apt|Apartment|Unit|Suite)\.? ?\w{{1,5}}, )(?:{_CAP} (?:House|Court|Building|Mansions|Lodge|Tower), )?\d{{1,5}}[a-zA-Z]? (?:{_CAP} ){{1,3}}{_STREET}\b\.?",
            rf"\b\d{{1,5}}[a-zA-Z]? (?:(?:N|S|E|W|North|South|East|West)\.? )?(?:{_CAP} ){{1,3}}{_STREET}\b\.?(?! \w+ \w+ly\b)",
            r"\b\d{1,5} [a-zß-ÿ'’]{3,}(?: [a-zß-ÿ'’]{3,})? (?:street|road|lane|avenue|crescent|drive|close|terrace|boulevard|court|place|square|gardens|grove)\b(?:, [a-zß-ÿ]{3,}\b)?(?:, [a-z]{1,2}\d{1,2} ?\d[a-z]{2}\b)?",
            rf"\b\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|av\.|boulevard|bd|place|allée|chemin|impasse|quai|route|cours|square) (?:de la |de l['’]|du |des |de |d['’]|l['’])?{_CAP}(?:[ -]{_CAP})?",
            r"\b[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|straat|laan|plein|gracht) \d{1,4} ?[a-z]?\b",
            rf"\b(?:{_CAP} ){{1,2}}(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer) \d{{1,4}}[a-z]?\b",
            rf"(?:C/|\b(?:Calle|Avda\.?|Avenida|Plaza|Paseo|Carrer|Ronda|Camino|Travesía)) ?(?:de la |de los |del |de )?{_CAP}(?: {_CAP})?,? (?:n[ºo°]\.? ?)?\d{{1,4}}\b",
            rf"\b(?:Via|Viale|Piazza|Corso|Vicolo|Rua|Travessa) (?:d[aeio]l?l?[ao]? )?{_CAP}(?: {_CAP})?,? \d{{1,4}}\b",
        ]
    )
    + ")"
    + _TAIL
)
#: Letters that every address, and every label of an identity number, has some of.
_ADDRESS_MARKS = "street|road|lane|avenue|crescent|drive|close|terrace|boulevard|court|place|square|gardens|grove|Box|fach|Apartado|oîte|Casella|Postbus|Flat|Unit|Suite| St| R| L| Av| D| C| Way| Pl| Sq| Te| Bl| Pa| Hi| G| Wa| M| Tr| Q|rue |venue |av. |oulevard |bd |place |allée |chemin |impasse |quai |route |cours |straße|strasse|str.|weg|gasse|platz|allee|ring|damm|ufer|steig|straat|laan|plein|gracht|Straße|Weg|Gasse|Platz|Allee|C/|Calle|Av|Plaza|Paseo|Via|Piazza|Corso|Rua".split("|")
_LABEL_MARKS = "ssn|sin|secur|tax|tin|ein|steuer|sozial|nation|ident|id card|pass|pasaporte|ausweis|licen|schein|permis|dni|nie|nif|ni number|nino|insur|curit|nir|insee|bsn|cpf|codice|pesel|aadhaar".split("|")

_LABEL = (
    r"(?:SSN|SIN|social security(?: number| no\.?)?|tax(?:payer)? (?:id|number|no\.?)|TIN|ITIN|EIN|Steuer-?(?:ID|nummer|identifikationsnummer)|Sozialversicherungsnummer|national id(?:entity)?(?: card| number| no\.?)?|identity (?:card|number)(?: no\.?)?|ID card"
    r"|passport(?: no\.?| number| #)?|Reisepass(?:nummer)?|passeport|pasaporte|Personalausweis(?:nummer| Nr\.?)?|driv(?:ing|er'?s?) licen[cs]e(?: no\.?| number)?|Führerschein(?:nummer)?|permis de conduire|DNI|NIE|NIF|NI number|NINO|national insurance(?: number| no\.?)?|num[ée]ro de s[ée]curit[ée] sociale|NIR|INSEE|BSN|CPF|codice fiscale|PESEL|Aadhaar|carte d'identit[ée])"
)
_VALUE = r"(?=[A-Z0-9 ./-]*\d[A-Z0-9 ./-]*\d[A-Z0-9 ./-]*\d[A-Z0-9 ./-]*\d)(?:[A-Z]{1,3} ?)?\d[A-Z0-9]*(?:[ ./-](?=[A-Z0-9]*\d)[A-Z0-9]+)*(?:[ -][A-Z]\b)?|[A-Z0-9]{6,12}\b"
LABELLED = re.compile(rf"(?<!\w){_LABEL}\s?(?:is |was |no\.? |nr\.? |number )?[:#=]?\s?({_VALUE})(?![\w@]|[.]\d)(?: \(US\))?", re.IGNORECASE)
#: Numbers of people among others: 7 to 15 digits, or letters and digits of an identity document.
NUMBER = re.compile(r"(?<![\w.@/:#+-])(?!\d{4}-\d\d-\d\d\b(?!-))(?!\d{1,3}(?:\.\d{1,3}){3}\b)(?:\+ ?\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d(?:[ ./-]?\d){5,14}(?: ?(?:ext\.?|x|extension|Durchwahl|poste) ?\d{1,5}\b)?(?![\w]|[.:/-]\d)(?: \(US\))?")
DOCUMENT = re.compile(r"(?<![\w.@/:#-])(?:[A-Z]{2} \d\d \d\d \d\d [A-D]|[A-Z]\d{3}-\d{4}-\d{4}|\d{7,8}[A-Z]|[A-Z]{1,2}\d{6,8}|[A-Z]\d{2,3}[A-Z]\d{2}[A-Z]\d)(?![\w-])")
STRONG_PHONE = re.compile(r"^(?:\+\d{1,3}[ ./-]?\(?\d|00[1-9]\d{0,2}[ /-]|\(\d{2,5}\) ?\d{3,4}[ -]?\d{3,5}$)|(?:ext\.?|x|extension|Durchwahl|poste) ?\d")
STRONG_ID = re.compile(r"^\d{3}-\d{2}-\d{4}(?: \(US\))$")

_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?|Signora?)"
_WORD = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[a-zß-öø-ÿ]+(?:-?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*(?!['’]\w)"
_INITIAL = r"[A-ZÀ-ÖØ-Þ]\."
_UPPER = r"[A-ZÀ-ÖØ-Þ][A-ZÀ-ÖØ-Þ'’-]{2,}"
NAME = re.compile(
    rf"(?<![\w@./`_'’-])(?!{_TITLES}\b)(?="
    rf"(?P<comma>{_WORD}, {_WORD}(?: {_INITIAL})?)(?![\w_@-])"
    rf"|(?P<full>{_WORD} (?:{_INITIAL} ?)*(?:(?:de|van|von|der|den|del|la|di|da|bin|al|el|le) )*{_WORD})(?![\w_@-])"
    rf"|(?P<initial>{_INITIAL} ?(?:{_INITIAL} ?)*{_WORD})(?![\w_@-])"
    rf"|(?P<upper>{_UPPER} (?:{_INITIAL} ?)*{_UPPER})(?![\w_@-]))"
)
TITLED = re.compile(rf"(?<![\w@]){_TITLES}\.? (?:{_INITIAL} ?)*({_WORD}(?: (?:{_INITIAL} ?)*{_WORD})?)(?![\w_@-])")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ][\w'’.]+,? [A-ZÀ-ÖØ-Þ]")
#: A single word that begins a sentence, with the words after it.
SINGLE = re.compile(rf"(?:(?<=\n)|(?<=[.?!] )|^)({_WORD})((?: [a-z]+){{3}})")

#: Contexts that hold a name whatever it is: labelled fields and greetings are the seeds of the name patterns.
NAME_SEEDS = ["signed-off-by :", "co-authored-by :", "reviewed-by :", "acked-by :", "reported-by :", "name :", "full_name :", "name =", "author :"]

#: Private characters that stand for what was taken out of a text, and their names in contexts.
_MASKS = {"email": "\ue001", "address": "\ue002", "phone": "\ue003", "number": "\ue003", "idnum": "\ue004"}
_MASK_NAMES = {"\ue001": "<email>", "\ue002": "<address>", "\ue003": "<number>", "\ue004": "<id>"}
_TOKEN = re.compile(r"[\ue001-\ue004]+|\n|[\w'’-]*\w|--+|[^\w\s\"'`(){}\[\]<>]")
#: The end of a sentence: not the dot of an abbreviation or initial.
_BOUNDARY = re.compile(r"(?<!\b[A-Za-z])(?<!\b(?:dr|nr|no|st|mr|ms))(?<!\b(?:tel|str|mrs|ext|fon|mob|ref))[.?!]\s", re.IGNORECASE)


class Found(NamedTuple):
    """An occurrence in a text: its kind (or ``number``), whether its shape alone decides, and the words around it."""

    start: int
    end: int
    kind: str
    strong: bool
    instance: str
    left: str
    right: str


def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("ß", "ss").replace("ø", "o"))
    return "".join(c for c in text if not unicodedata.combining(c))


def _plain(token: str) -> str:
    if token == "\n":
        return "¶"
    return _MASK_NAMES.get(token[0]) or ("0" if token.isdigit() else token)


_NEW = re.compile(r"\s+(?:[A-ZÀ-ÖØ-Þ@>`#]|\w+[:=(]|\w+ =|\w+_)")


def _left(masked: str, start: int) -> list[str]:
    chunk = masked[max(0, start - 60) : start]
    cut = 0
    for m in _BOUNDARY.finditer(chunk):
        cut = m.end()
    tokens = [_plain(t) for t in _TOKEN.findall(chunk[cut:].lower())]
    if start > 60 and cut == 0 and tokens:
        tokens = tokens[1:] or tokens
    return (["^"] + tokens if cut or start <= 60 else tokens)[-2:]


def _right(masked: str, end: int) -> list[str]:
    """The next two tokens; a capital letter, a mention, a quote or code begins something new."""
    out = []
    rest = masked[end : end + 40]
    if _NEW.match(rest):
        return ["$"]
    for t in _TOKEN.findall(rest.lower())[:3]:
        if t in ".?!\n":
            out.append("$")
            break
        out.append(_plain(t))
    return (out or ["$"])[:2]


def _around(masked: str, start: int, end: int) -> tuple[str, str]:
    return " ".join(_left(masked, start)), " ".join(_right(masked, end))


_DIGIT = re.compile(r"\d")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def occurrences(text: str) -> list[Found]:
    """All candidates of a text. Mail addresses, postal addresses and labelled numbers are masked before what is left is searched."""
    found: list[tuple[int, int, str, bool, str]] = []
    masked = text
    # where the label of a number begins: its context is what stands before the label
    before: dict[int, int] = {}

    def take(hits: list[tuple[int, int, str, bool, str]]) -> None:
        """Keep hits, which are in order and don't overlap, and mask them in one copy of the text."""
        nonlocal masked
        if not hits:
            return
        found.extend(hits)
        parts, at = [], 0
        for start, end, kind, _, _ in hits:
            parts += [masked[at:start], _MASKS[kind] * (end - start)]
            at = end
        masked = "".join([*parts, masked[at:]])

    if ("@" in text or "＠" in text or "at" in text.lower()) and _MAIL_MARK.search(_REMOTE.sub("git:", text) if "git@" in text else text):
        take([(m.start(), m.end(), "email", True, m.group().lower()) for m in EMAIL.finditer(text)])
    if _DIGIT.search(masked):
        low = masked.lower()
        if any(k in low for k in _LABEL_MARKS):
            labelled = [m for m in LABELLED.finditer(masked) if _digits(m.group(1)) >= 5]
            take([(m.start(1), m.end(), "idnum", True, m.group(1)) for m in labelled])
            before = {m.start(1): m.start() for m in labelled}
        if any(k in masked for k in _ADDRESS_MARKS):
            take([(m.start(), m.end(), "address", True, m.group()) for m in ADDRESS.finditer(masked)])
        numbers = []
        for m in NUMBER.finditer(masked):
            if 7 <= _digits(m.group()) <= 20:
                strong, ssn = bool(STRONG_PHONE.search(m.group())), bool(STRONG_ID.match(m.group()))
                numbers.append((m.start(), m.end(), "phone" if strong else "idnum" if ssn else "number", strong or ssn, m.group()))
        take(numbers)
        take([(m.start(), m.end(), "number", False, m.group()) for m in DOCUMENT.finditer(masked)])
    out = [Found(*f, *_around(masked, before.get(f[0], f[0]), f[1])) for f in found]
    if _CAPITALS.search(masked):
        for m in NAME.finditer(masked):
            shape = m.lastgroup
            name = m.group(shape)
            out.append(Found(m.start(), m.start() + len(name), "name", False, name, *_around(masked, m.start(), m.start() + len(name))))
    for m in TITLED.finditer(masked):
        out.append(Found(m.start(1), m.end(1), "name", True, m.group(1), *_around(masked, m.start(1), m.end(1))))
    return out


def name_words(instance: str) -> list[str]:
    """The folded words of a name, family name last; initials and particles are left out."""
    if ", " in instance:
        family, given = instance.split(", ", 1)
        instance = f"{given} {family}"
    return [w for w in (fold(x).strip(".") for x in instance.split(" ")) if len(w) > 1 and w not in ("de", "van", "von", "der", "den", "del", "la", "di", "da", "bin", "al", "el", "le")]


_OCCURRENCE = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("record_key", T.StringType()),
        T.StructField("text_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("strong", T.BooleanType()),
        T.StructField("instance", T.StringType()),
        T.StructField("left", T.StringType()),
        T.StructField("right", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def _slim(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("table_name").cast("string").alias("table_name"), F.col("record_key").cast("string").alias("record_key"), F.xxhash64("body").alias("text_id"), "body").filter("body IS NOT NULL")


def extract(texts: DataFrame) -> DataFrame:
    """One pass over ``texts`` (table_name, record_key, body): the occurrences of each, and counts of single words.

    Rows of kind ``single`` belong to no record: they count, for each task, how often a capitalized
    word begins a sentence that goes on with the three words in ``right``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(_OCCURRENCE)
        singles: dict[tuple[str, str], int] = {}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in target]
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        def counted() -> pa.RecordBatch:
            rows = [(None, None, None, None, None, "single", False, word, "", right, n) for (word, right), n in singles.items()]
            singles.clear()
            return batch_of(rows)

        for batch in batches:
            rows: list[tuple] = []
            for table, key, text_id, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for f in occurrences(body):
                    rows.append((table, key, text_id, f.start, f.end, f.kind, f.strong, f.instance, f.left, f.right, 1))
                for word, right in SINGLE.findall(body):
                    singles[word, right] = singles.get((word, right), 0) + 1
            yield batch_of(rows)
            if len(singles) > COUNTERS:
                yield counted()
        yield counted()

    return _slim(texts).mapInArrow(run, _OCCURRENCE)


#: Sides that are no context.
SAY_NOTHING = ["L ^", "L ¶", "L ^ ¶", "L ¶ ¶", "L ", "R $", "R , $", "R ; $"]


def _edges(found: DataFrame) -> DataFrame:
    """(kind, pattern, instance, strong) without repetition; the sides of a pattern are marked in it."""
    sides = F.array(F.concat(F.lit("L "), F.col("left")), F.concat(F.lit("R "), F.col("right")))
    rows = found.select("kind", F.explode(sides).alias("pattern"), "instance", "strong").filter(~F.col("pattern").isin(*SAY_NOTHING))
    return rows.groupBy("kind", "pattern", "instance").agg(F.max("strong").alias("strong"))


def _accepted(edges: DataFrame) -> DataFrame:
    """(kind, pattern, score, n) of the patterns around enough instances, of which enough are ``known``.

    The share of known instances counts by its lower confidence bound (Wilson), so a pattern stands
    or falls with its own instances, whatever else the corpus holds.
    """
    scored = edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("known").cast("double")).alias("k"))
    n, share = F.col("n"), F.col("k") / F.col("n")
    bound = (share + Z * Z / (2 * n) - Z * F.sqrt(share * (1 - share) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in LEAST_SHARE.items()])
    return scored.filter((n >= LEAST_INSTANCES) & (bound >= least)).select("kind", "pattern", share.alias("score"), "n")


def number_patterns(found: DataFrame) -> DataFrame:
    """Patterns (kind, pattern, score, n) of telephone and identity numbers, scored with the instances until nothing is added.

    Numbers whose shape or label decides are the seeds. Other numbers count for either kind as
    unknown until a pattern around them is accepted: from then on they are known, of the kind of
    their best pattern, and back other patterns. Known instances only grow, so this ends.
    """
    # what follows a number is often the next thing of a list, so only what stands before it counts, and the beginning of a line is nothing
    numbers = _edges(found.filter(F.col("kind").isin("phone", "idnum", "number"))).filter(F.col("pattern").startswith("L ") & ~F.col("pattern").endswith("¶"))
    either = numbers.filter("kind = 'number'").drop("kind").select(F.explode(F.array(F.lit("phone"), F.lit("idnum"))).alias("kind"), "pattern", "instance", F.lit(False).alias("strong"))
    either = either.filter((F.col("kind") != "phone") | ~_lettered(F.col("instance")))
    edges = cut_lineage(numbers.filter("kind <> 'number'").unionByName(either).groupBy("kind", "pattern", "instance").agg(F.max("strong").alias("strong")))
    given = None
    while True:
        known = edges.withColumn("known", F.col("strong"))
        if given is not None:
            known = edges.join(given.withColumn("_given", F.lit(True)), ["instance", "kind"], "left").withColumn("known", F.col("strong") | F.coalesce("_given", F.lit(False)))
        patterns = cut_lineage(_accepted(known))
        reached = lookup_join(edges.filter("NOT strong"), patterns.select("kind", "pattern", "score"), ["kind", "pattern"]).filter("score IS NOT NULL")
        best = reached.groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        if given is not None:
            best = best.join(given.select("instance"), "instance", "left_anti")
        new = cut_lineage(best)
        if new.isEmpty():
            return patterns
        given = new if given is None else cut_lineage(given.unionByName(new))


def _lettered(instance: Column) -> Column:
    """Whether a number holds letters, those of an extension aside: then it is no telephone number."""
    return F.regexp_replace(instance, r"ext|\(US\)", "").rlike(r"\p{L}")


_WORDS = T.StructType([T.StructField("instance", T.StringType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])


def _with_words(instances: DataFrame, split) -> DataFrame:
    """(instance, first, last, words) of distinct instances that have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(_WORDS)
        for batch in batches:
            rows = [(x, w[0], w[-1], w) for x in batch.column("instance").to_pylist() if (w := split(x))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

    return instances.mapInArrow(run, _WORDS)


def _openers(found: DataFrame) -> DataFrame:
    """(word, openings): how often a word begins a sentence that goes on in lower case."""
    counts = found.filter("kind = 'single'").groupBy("instance").agg(F.sum("n").alias("n"))
    return _with_words(counts.select("instance"), lambda x: [fold(x)]).join(counts, "instance").groupBy(F.col("first").alias("word")).agg(F.sum("n").alias("openings"))


def name_graph(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns, words, instances) of names, after scoring the graph of patterns and instances until nothing is added.

    patterns: as of ``_accepted``. words: (word, k), how many known names have it. instances:
    (instance, never, by_words), whether a candidate is none whatever stands around it, or one by
    its words alone. Seeds are names in labelled fields (``NAME_SEEDS``), beside a mail address, or
    after a title. A name is known if its first word is one of several known names; patterns with
    enough known instances are accepted, and their instances' words are known in the next round.
    Words that mostly begin sentences are none of names. Known names only grow, so this ends.
    """
    edges = cut_lineage(_edges(found.filter("kind = 'name'")))
    words = cut_lineage(_with_words(edges.select("instance").distinct(), name_words))
    openers = cut_lineage(_openers(found))
    seeded = F.col("strong") | F.col("pattern").isin([f"L {s}" for s in NAME_SEEDS]) | F.col("pattern").startswith("R <email>")
    seeds = cut_lineage(edges.filter(seeded).select("instance").distinct())

    def count_words(instances: DataFrame) -> DataFrame:
        each = instances.join(words, "instance").select(F.explode(F.array_distinct("words")).alias("word"))
        counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("k"))
        return cut_lineage(counts.join(openers, "word", "left").filter(F.coalesce("openings", F.lit(0)) <= 5 * F.col("k")).select("word", "k"))

    def counted(known_words: DataFrame, *places: str) -> DataFrame:
        """``words`` with the number of known names that have their first or last word."""
        out = words
        for place in places:
            out = lookup_join(out, known_words.select(F.col("word").alias(place), F.col("k").alias(f"k_{place}")), [place]).withColumn(f"k_{place}", F.coalesce(f"k_{place}", F.lit(0)))
        return out

    # "Thanks, Anna" has the form of "Berg, Anna": a greeting stands before many names and is nobody's family name
    comma = F.col("instance").contains(", ")
    sides = words.groupBy("last").agg(F.sum(comma.cast("int")).alias("c"), F.sum((~comma).cast("int")).alias("f"))
    greetings = sides.filter((F.col("c") >= GREETED) & (F.col("c") > GREETED * F.col("f"))).select("last")
    greeted = cut_lineage(words.filter(comma).join(greetings, "last", "left_semi").select("instance"))
    inducing = cut_lineage(edges.join(greeted, "instance", "left_anti"))
    known, size = seeds, -1
    while True:
        known_words = count_words(known)
        backed = counted(known_words, "first").select("instance", (F.col("k_first") >= 2).alias("backed"))
        judged = cut_lineage(inducing.join(backed, "instance", "left").select(F.lit("name").alias("kind"), "pattern", "instance", (seeded | F.coalesce("backed", F.lit(False))).alias("known")))
        patterns = cut_lineage(_accepted(judged))
        reached = lookup_join(judged.filter("known"), patterns.select("pattern", "n"), ["pattern"]).filter("n IS NOT NULL").select("instance")
        known = cut_lineage(reached.unionByName(seeds).distinct())
        before, size = size, known.count()
        if size == before:
            break
    whole = counted(known_words, "first", "last").join(greeted.withColumn("_g", F.lit(True)), "instance", "left")
    never = comma & (F.size("words") > 1) & (F.col("_g").isNotNull() | (F.col("k_last") >= F.col("k_first")))
    by_words = (F.size("words") > 1) & (F.col("k_first") >= 2) & (~comma | (F.col("k_last") >= 2))
    return patterns, known_words, cut_lineage(whole.select("instance", never.alias("never"), by_words.alias("by_words")))


def single_patterns(found: DataFrame, words: DataFrame) -> DataFrame:
    """(right, n) of a family name that begins a sentence: the words after it, if enough different known names stand before them."""
    singles = found.filter("kind = 'single'").select(F.lit("single").alias("kind"), F.col("right").alias("pattern"), "instance").distinct()
    # only endings with several different words before them can be patterns
    several = singles.groupBy("pattern").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= 2 * LEAST_INSTANCES).select("pattern")
    edges = singles.join(several, "pattern", "left_semi")
    spelt = _with_words(edges.select("instance").distinct(), lambda x: [fold(x)]).select("instance", F.col("first").alias("word"))
    known = lookup_join(edges.join(spelt, "instance"), words, ["word"]).withColumn("known", F.col("k").isNotNull())
    return cut_lineage(_accepted(known).select(F.col("pattern").alias("right"), "n"))


_SPAN = T.StructType([*_OCCURRENCE.fields[:5], T.StructField("kind", T.StringType())])
_SPAN_COLUMNS = _SPAN.fieldNames()


def _beginnings(texts: DataFrame) -> DataFrame:
    """(table_name, record_key, text_id, start, end, right) of every capitalized word that begins a sentence, with the three words after it."""
    schema = T.StructType([*_OCCURRENCE.fields[:5], T.StructField("right", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            rows = [(table, key, text_id, m.start(1), m.end(1), m.group(2)) for table, key, text_id, body in zip(*[c.to_pylist() for c in batch.columns], strict=True) for m in SINGLE.finditer(body)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(target)], schema=target)

    return _slim(texts).mapInArrow(run, schema)


def find(texts: DataFrame) -> DataFrame:
    """Spans (table_name, record_key, text_id, start, end, kind) of personal data in ``texts`` (table_name, record_key, body).

    Mail addresses, postal addresses, numbers with a country's prefix and labelled identity numbers
    are recognized by their shape and are the seeds; other numbers and names need patterns that
    the seeds induce over the whole corpus. Patterns, words and verdicts on candidates are tables
    that occurrences are joined with, so they may be as many as they are. NULL and empty bodies have
    none. text_id is xxhash64 of the body, as a record may come with several bodies. Offsets count
    code points.
    """
    found = cut_lineage(extract(texts))
    patterns, words, instances = name_graph(found)
    numbered = number_patterns(found)
    endings = single_patterns(found, words)
    open_ = found.filter("NOT strong").withColumns({"l": F.concat(F.lit("L "), F.col("left")), "r": F.concat(F.lit("R "), F.col("right"))})
    score = lambda k: numbered.filter(F.col("kind") == k).select(F.col("pattern").alias("l"), F.col("score").alias(k))
    numbers = lookup_join(lookup_join(open_.filter("kind = 'number'"), score("phone"), ["l"]), score("idnum"), ["l"])
    phone, idnum = F.when(~_lettered(F.col("instance")), F.col("phone")), F.col("idnum")
    numbers = numbers.withColumn("kind", F.when(phone.isNotNull() & (idnum.isNull() | (phone >= idnum)), "phone").when(idnum.isNotNull(), "idnum")).filter("kind IS NOT NULL")
    side = lambda c: patterns.select(F.col("pattern").alias(c), F.lit(True).alias(f"by_{c}"))
    names = lookup_join(open_.filter("kind = 'name'"), instances, ["instance"]).filter("NOT never")
    names = lookup_join(lookup_join(names, side("l"), ["l"]), side("r"), ["r"]).filter("by_words OR by_l OR by_r")
    begun = lookup_join(_beginnings(texts), endings, ["right"]).filter("n IS NOT NULL").withColumn("kind", F.lit("name"))
    parts = [p.select(*_SPAN_COLUMNS) for p in (found.filter("strong"), numbers, names, begun)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def mask(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with body_masked, in which typed placeholders stand for the spans; of overlapping spans the longest holds."""
    own = texts.withColumn("_table", F.col("table_name").cast("string")).withColumn("_key", F.col("record_key").cast("string")).withColumn("_id", F.xxhash64("body"))
    grouped = spans.groupBy("table_name", "record_key", "text_id").agg(F.collect_set(F.struct("start", "end", "kind")).alias("_spans"))
    joined = own.join(grouped.withColumnsRenamed({"table_name": "_t", "record_key": "_k"}), (own["_table"].eqNullSafe(F.col("_t"))) & (own["_key"].eqNullSafe(F.col("_k"))) & (own["_id"] == F.col("text_id")), "left")
    slim = joined.select(*[own[c] for c in texts.columns], F.col("_spans"))
    schema = T.StructType([*texts.schema.fields, T.StructField("body_masked", T.StringType())])
    at = texts.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            masked = [replace(b, s) if s else b for b, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = [c.cast(f.type) for c, f in zip(batch.columns[:-1], target, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(masked, target.field(len(columns)).type)], schema=target)

    return slim.mapInArrow(run, schema)


def replace(body: str | None, spans: list[dict]) -> str | None:
    """A text with the placeholders of its spans (start, end, kind), the longest first where they overlap."""
    if body is None:
        return None
    chosen: list[tuple[int, int, str]] = []
    for s, e, k in sorted(((x["start"], x["end"], x["kind"]) for x in spans), key=lambda x: (x[0] - x[1], x[0], x[2])):
        if all(e <= a or s >= b for a, b, _ in chosen):
            chosen.append((s, e, k))
    for s, e, k in sorted(chosen, reverse=True):
        body = body[:s] + PLACEHOLDERS[k] + body[e:]
    return body
